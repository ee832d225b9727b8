"""The ingest queue as a state machine: commands change an entry's state or are rejected with a reason.

Commands (id, seq, ts, command): add, start, done, errored, reset.  An entry begins with add; start is rejected once it is done, all others
before it exists, add when it does.  A stream keeps one state an entry and gives every command with what became of it, accepted or not, so
rejections are a filter of the same rows; the same in batch is a matter of windows.  Commands of an entry are in the order of seq; a stream sorts those of
one entry that come in one batch, and takes what comes later as later."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state that a command leads to.
LEADS_TO = {"add": "pending", "start": "in-progress", "done": "done", "errored": "errored", "reset": "pending"}
EXISTS, MISSING, FINISHED, UNKNOWN = "entry exists", "no entry", "already done", "unknown command"
OUT = "id long, seq long, command string, before string, accepted boolean, after string, reason string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def verdict(before: str | None, command: str) -> str | None:
    """Why a command is rejected; None if it isn't."""
    if command not in LEADS_TO:
        return UNKNOWN
    if command == "add":
        return EXISTS if before else None
    if before is None:
        return MISSING
    return FINISHED if command == "start" and before == "done" else None


class Transitions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        begun = now = self.status.get()[0] if self.status.exists() else None
        for r in sorted(rows, key=lambda r: r.seq):
            why = verdict(now, r.command)
            after = now if why else LEADS_TO[r.command]
            yield Row(id=key[0], seq=r.seq, command=r.command, before=now, accepted=why is None, after=after, reason=why)
            now = after
        if now != begun:
            self.status.update((now,))

    def close(self) -> None:
        pass


def replayed(commands: DataFrame) -> DataFrame:
    """The stream's answer to a stream of commands.  The session needs PROVIDER as spark.sql.streaming.stateStore.providerClass."""
    rows = commands.select("id", "seq", "command").groupBy("id")
    return rows.transformWithState(statefulProcessor=Transitions(), outputStructType=OUT, outputMode="Append", timeMode="None")


def answered(commands: DataFrame) -> DataFrame:
    """The same in batch.  A start changes nothing after done, so the state before a command follows from the last other
    command and whether a start came after it."""
    w = Window.partitionBy("id").orderBy("seq")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("command").isin(*LEADS_TO)
    rows = commands.select("id", "seq", "command").withColumn("n", F.row_number().over(w))
    added = F.coalesce(F.max(F.col("command") == "add").over(earlier), F.lit(False))
    rows = rows.withColumn("there", added)
    main = F.when(known & (F.col("command") != "start") & (F.col("there") != (F.col("command") == "add")), F.struct("n", "command"))
    begun = F.when((F.col("command") == "start") & F.col("there"), F.col("n"))
    rows = rows.withColumn("last", F.max(main).over(earlier)).withColumn("started", F.max(begun).over(earlier))
    led = F.when(F.col("last.command") == "done", "done").when(F.col("started") > F.col("last.n"), "in-progress").when(F.col("last.command") == "errored", "errored").otherwise("pending")
    rows = rows.withColumn("before", F.when(F.col("last").isNotNull(), led))
    before, command = F.col("before"), F.col("command")
    why: Column = F.when(~known | command.isNull(), UNKNOWN).when(command == "add", F.when(before.isNotNull(), EXISTS)).when(before.isNull(), MISSING).when((command == "start") & (before == "done"), FINISHED)
    to = F.create_map(*(F.lit(x) for pair in LEADS_TO.items() for x in pair))
    return rows.withColumn("reason", why).select("id", "seq", "command", "before", F.col("reason").isNull().alias("accepted"), F.when(F.col("reason").isNull(), F.try_element_at(to, command)).otherwise(before).alias("after"), "reason")
