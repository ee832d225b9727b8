"""What the operators of this subpackage share: reading tables, checked broadcasts, safe checkpoints, tidy workers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch where the session has Spark's default: whole texts are long, and a batch stands in the JVM and in Python.
BATCH_ROWS, _SPARKS_ROWS, _ROWS_KEY = 1_000, "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, whatever else the table has.  All rows stay.  Texts go to Python in batches of
    BATCH_ROWS, unless the session has a bound of its own."""
    conf = df.sparkSession.conf
    if conf.get(_ROWS_KEY) == _SPARKS_ROWS:
        conf.set(_ROWS_KEY, BATCH_ROWS)
    return df.select(*names)


def fold(key: Column, n: int) -> Column:
    """crc32 of a key's text modulo n; 0 for a null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


# --- memory ----------------------------------------------------------------------------------------------------------


def trim() -> None:
    """Returns freed memory to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if malloc_trim:
        malloc_trim(0)


def give_back(spark: SparkSession | None = None) -> None:
    """trim, after a collection of garbage; for the driver, before a later step needs its memory.  With a session its JVM's
    garbage is collected, too: results and broadcasts of rounds that are over would let the heap grow to its bound, and shuffle files stay.
    What the JVM has freed beside its heap goes back to the system."""
    import gc

    gc.collect()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
        trim_jvm(spark)
    trim()


def trim_jvm(spark: SparkSession) -> str:
    """trim for the driver's JVM, whose compiler and collector leave freed memory behind, beside its heap.  The JVM's
    report, or nothing from a JVM that doesn't offer this."""
    java, new_array = spark.sparkContext._jvm.java, spark.sparkContext._gateway.new_array
    kinds, values = new_array(java.lang.Class, 4), new_array(java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = java.lang.Class.forName(name)
    values[0], values[1] = spark.sparkContext._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke = java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        return invoke.invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:
        return ""


#: Functions that empty the caches of a worker, by the operator that has them.
CACHES: dict[str, Callable[[], None]] = {}


def tidy(f: Callable, owner: str | None = None) -> Callable:
    """f, a function for mapInArrow, whose worker gives its freed memory back when a task ends, and the caches
    of other operators than the owner when one begins: workers are used again by later steps, beside which it would stay."""

    @wraps(f)
    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # which gives back what is freed
        for name in [x for x in CACHES if x != owner]:
            CACHES.pop(name)()
        try:
            yield from f(batches)
        finally:
            trim()

    return run


# --- tables between jobs -----------------------------------------------------------------------------------------------


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that the context has been given.  Without
    either, a local session gets a temporary folder; on a cluster no machine's own folder will do."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    own = tempfile.mkdtemp(prefix="wikilake-")
    sc.setCheckpointDir(own)
    return own


#: Rows of a partition of a saved table, at least: small tables don't keep the many partitions of the shuffle they come from.
SAVED_ROWS = 10_000


def saved(df: DataFrame, least: int = 1) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder.  least: partitions that stay, whatever the rows."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    out = df.checkpoint()
    rows = out._jdf.queryExecution().toRdd()
    parts = max(least, -(-rows.count() // SAVED_ROWS))
    return out.coalesce(parts) if parts < rows.getNumPartitions() else out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables between jobs, beside the checkpoints that all machines share."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


# --- filters and small tables ------------------------------------------------------------------------------------------

BITS = 23
_CHUNK_BITS = 16


def bitset(df: DataFrame, name: str, bits: int = BITS) -> np.ndarray:
    """A filter of 2**bits bits with the low bits of a long column set, as a numpy array of 64-bit
    words.  Its size is fixed, however many rows there are: full, it lets more through, and the
    exact join that follows sorts that out.  The bits are set on the executors, in chunks, which come to the
    driver a partition at a time."""

    def chunks(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            for c in np.unique(slot >> _CHUNK_BITS):
                flags = held.setdefault(int(c), np.zeros(1 << _CHUNK_BITS, bool))
                flags[slot[slot >> _CHUNK_BITS == c] & ((1 << _CHUNK_BITS) - 1)] = True
        for c, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    slots = df.select(F.col(name).bitwiseAND((1 << bits) - 1).alias("slot"))
    n = 1 << max(0, bits - _CHUNK_BITS)
    rows = slots.repartition(min(n, 64), F.shiftright("slot", _CHUNK_BITS)).mapInArrow(tidy(chunks), "chunk long, bits binary")
    out = np.zeros(1 << bits - 6, np.uint64)
    words = 1 << _CHUNK_BITS - 6
    # All rows of a large filter would stand several times in the driver while they are sent.
    for r in saved(rows, least=64).toLocalIterator() if bits > BITS else rows.collect():
        out[r.chunk * words : (r.chunk + 1) * words] = np.frombuffer(r.bits, np.uint64)
    return out


def has(bits_set, h, bits: int = BITS):
    """Which of the 64-bit hashes have their bit set."""
    slot = h & np.uint64((1 << bits) - 1)
    return (bits_set[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def gathered(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Long columns of a table of a proven size, as numpy arrays.  They come packed, not as rows."""

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(k).to_numpy().tobytes()], pa.binary()) for k in names], list(names))

    packed = df.select(*(F.col(k).cast("long").alias(k) for k in names)).mapInArrow(tidy(pack), ", ".join(f"{k} binary" for k in names)).collect()
    return [np.frombuffer(b"".join(r[k] for r in packed), np.int64) for k in names]


#: Rows and bytes of a table that may be broadcast; larger ones are joined by a shuffle.
SMALL, SMALL_BYTES = 100_000, 1 << 25


def _size(kind: T.DataType, c: Column) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + _size(kind.elementType, x)), F.lit(0)) if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType) else F.coalesce(F.size(c), F.lit(0)) * 8
    return F.lit(8)


def small(df: DataFrame, rows: int = SMALL, size: int = SMALL_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes, which are counted; else df as it is."""
    each = sum((_size(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(16))
    n = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(each.cast("long")), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if n.n <= rows and n.b <= size else df


#: A key is hot with so many rows, or with this share of all rows: so there are at most HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 1_000, 10_000


def spread_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """many joined (inner or left) with one, which has a row for each key at most.  Rows of hot keys stay where they
    are and meet their row by a broadcast of HOT_KEYS rows at most; all others are shuffled.  counts: (key, n)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot = counts.where(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select(key)
    if not hot.limit(1).count():
        return many.join(one, key, how)
    keys = F.broadcast(hot)  # fewer than HOT_KEYS rows
    near = many.join(keys, key, "left_semi").join(F.broadcast(one.join(keys, key, "left_semi")), key, how)
    return near.unionByName(many.join(keys, key, "left_anti").join(one, key, how))


def frequent(counts: DataFrame, key: str, n: str, most: int) -> DataFrame:
    """The rows of counts with the largest values of n (1 or more), about `most` and not more: whole steps of an eighth
    of a power of two, and of the step that would be too much the part that fits, by a hash of the key.  Only
    the numbers of rows by step reach the driver."""
    step = F.floor(F.log2(n) * 8)
    sizes = {r.step: r["count"] for r in counts.groupBy(step.alias("step")).count().collect()}
    total = 0
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > most:
            part = int((most - total) * 0.98 / sizes[k] * (1 << 30))
            return counts.where((step > k) | ((step == k) & (F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < part)))
        total += sizes[k]
    return counts


def attach(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many joined (inner or left) with one, a saved table with a row for each key at most: by a broadcast if it is
    small, else by spread_join."""
    hinted = small(one)
    return many.join(hinted, key, how) if hinted is not one else spread_join(many, one, key, many.groupBy(key).agg(F.count("*").alias("n")), how)
