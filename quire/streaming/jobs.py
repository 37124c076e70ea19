"""Jobs as a state machine over a stream of events: guarded transitions, refused ones told, and each job's last log lines."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: From which states an event may lead where. A job is pending when it is first heard of; stopping it is asked for while it is pending or runs; what fails
#: while it is being stopped is cancelled.
TRANSITIONS = {
    ("pending", "running"): "running",
    ("pending", "stopping"): "stopping",
    ("pending", "failed"): "failed",
    ("running", "stopping"): "stopping",
    ("running", "done"): "done",
    ("running", "failed"): "failed",
    ("stopping", "cancelled"): "cancelled",
    ("stopping", "failed"): "cancelled",
    ("stopping", "done"): "done",
}
#: Log lines that are kept of each job.
LINES = 1000
MOVED = "job string, id long, ts timestamp, event string, before string, state string, accepted boolean, first_line long, lines long"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Machine(StatefulProcessor):
    """State of a job: where it is and how many lines it had, and its last lines; both go when nothing was heard of it for ttl milliseconds (0: never). A batch's lines are put there
    together, as each call of the state's store is a message to it."""

    def __init__(self, lines: int = LINES, ttl: int = 0):
        self.most, self.ttl = lines, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.ttl or None
        self.at = handle.getValueState("at", "state string, seen long", ttl)
        self.last = handle.getListState("last", "line string", ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, seen = self.at.get() if self.at.exists() else ("pending", 0)
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts)
        batch = batch if len(batch) == 1 else batch.sort_values(["ts", "id"], kind="stable")
        out, lines, before = [], [], seen
        for id_, ts, event, line in batch[["id", "ts", "event", "line"]].itertuples(index=False):
            after = TRANSITIONS.get((state, event))
            if line is not None:
                lines.append((line,))
                seen += 1
            out.append((key[0], id_, ts, event, state, after or state, after is not None, max(0, seen - self.most), min(seen, self.most)))
            state = after or state
        if lines and seen <= self.most:
            self.last.appendList(lines)
        elif lines:
            kept = list(self.last.get()) if before and len(lines) < self.most else []
            self.last.put((kept + lines)[-self.most :])
        self.at.update((state, seen))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MOVED.split(", ")])

    def close(self) -> None:
        pass


def transitions(events: DataFrame, lines: int = LINES, ttl: int = 0) -> DataFrame:
    """A stream (job, id, ts, event, line) -> a row for each event: the state before and after it, whether it was accepted, and which log lines the job then has.

    Of one batch a job's events count in order of ts and id; those of a later batch come after. An event that the job's state doesn't allow changes nothing and is a row with
    accepted false; so is every event after an end, and one of an unknown name. A null line logs nothing. A job's state is two values and at most `lines` lines.
    """
    return events.select("job", "id", "ts", "event", "line").groupBy("job").transformWithStateInPandas(statefulProcessor=Machine(lines, ttl), outputStructType=MOVED, outputMode="Append", timeMode="ProcessingTime" if ttl else "None")


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Streams that start in here keep state of several variables, which the store in RocksDB can; the session's own store is put back."""
    key, value = PROVIDER
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
