"""Sinks.  A table is replaced by writing beside it and swapping, so a lost executor never leaves half of it."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables between jobs, in the folder that the cluster shares and names in spark.checkpoint.dir.  Without
    one, a local session gets a temporary folder; on a cluster no machine's own folder will do."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(named or tempfile.mkdtemp(prefix='wikilake-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replace(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes a new version, keeps the old one as <path>.bak, then swaps, for readers that know a path alone; between the two renames
    they find none, and Versions spares them that."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fresh = f"{path}.{uuid.uuid4().hex}"
    df.write.format(fmt).save(fresh)
    fs = to(path).getFileSystem(conf)
    older = f"{fresh}.old"
    if fs.exists(to(path)):
        fs.rename(to(path), to(older))
    if not fs.rename(to(fresh), to(path)):
        fs.rename(to(older), to(path))
        raise RuntimeError(f"{path} could not be replaced")
    if fs.exists(to(older)):  # the new version stands, so the one before the old can go
        fs.delete(to(f"{path}.bak"), True)
        fs.rename(to(older), to(f"{path}.bak"))


class Versions:
    """Tables of one root that change together.  Each commit writes new folders and then a manifest that names the folder of every
    table; readers take the tables of the newest manifest, so they see all of a commit or nothing of it, and a commit that fails leaves the old
    state as it was.  A manifest is created by a rename that fails where its number is taken: of two writers at once one gets an error."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def numbers(self) -> list[int]:
        """The numbers of all commits."""
        if not self._fs.exists(self._path("_manifests")):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._path("_manifests")) if f.getPath().getName().isdigit())

    def folders(self, number: int | None = None) -> dict[str, str]:
        """The folder of each table in a commit, the newest unless one is named."""
        have = self.numbers()
        if not have:
            return {}
        stream = self._fs.open(self._path(f"_manifests/{have[-1] if number is None else number:020d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.folders(number)[name]}")

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Writes tables and makes them, with those that it doesn't name, the newest commit."""
        have = self.numbers()
        fresh = {name: f"{name}/{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{fresh[name]}")
        return self._publish((have[-1] if have else 0) + 1, {**self.folders(have[-1] if have else None), **fresh})

    def roll_back(self, number: int) -> int:
        """Makes an older commit the newest again."""
        return self._publish(self.numbers()[-1] + 1, self.folders(number))

    def _publish(self, number: int, folders: dict[str, str]) -> int:
        draft, final = self._path(f"_manifests/_{uuid.uuid4().hex}"), self._path(f"_manifests/{number:020d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"commit {number} of {self.root} is taken: read again and repeat")
        return number

    def prune(self, keep: int = 2) -> None:
        """Deletes all but the newest commits, and folders that none of them names; not while a commit is under way."""
        kept = self.numbers()[-keep:]
        named = {f for n in kept for f in self.folders(n).values()}
        for number in self.numbers()[:-keep]:
            self._fs.delete(self._path(f"_manifests/{number:020d}"), False)
        for table in self._fs.listStatus(self._path("")):
            name = table.getPath().getName()
            if name != "_manifests" and table.isDirectory():
                for folder in self._fs.listStatus(table.getPath()):
                    if f"{name}/{folder.getPath().getName()}" not in named:
                        self._fs.delete(folder.getPath(), True)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def issues_text(issues: DataFrame) -> DataFrame:
    """One line of text for each issue, errors first."""
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return issues.orderBy(order, "kind", "path").select(F.format_string("%-5s %s %s: %s", "severity", "kind", "path", "detail").alias("value"))


def markdown_table(df: DataFrame, most: int | None = None) -> str:
    """A report as a pipe table, for people; only the first rows, if `most` says so."""
    rows = (df if most is None else df.limit(most)).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)])
