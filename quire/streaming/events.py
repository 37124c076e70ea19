"""Streams of saved chapters, events and job states; what they keep is written by Spark's own commit protocol."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import scratch
from quire.operators import library

#: States of a job, in the order in which they supersede each other.
STATES = ["pending", "running", "stopping", "cancelled", "done", "failed"]


def read_stream(spark: SparkSession, path: str, schema: Any, files: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream; a single file counts as its folder's only one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString()) if single else reader.parquet(path)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Handle all that is there in micro-batches, then stop; a restart goes on after the last one committed."""
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _versions(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Complete versions of each part of a table ("" if it has no parts), in order: path/v<batch>[/part=<k>]. A list of folders, not of rows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda p: [s.getPath().getName() for s in fs.listStatus(at(p))]
    out: dict[str, list[int]] = {}
    for v in sorted((int(n[1:]) for n in names(path) if n[1:].isdigit()) if fs.exists(at(path)) else []):
        inside = names(f"{path}/v{v}")
        if "_SUCCESS" in inside:
            for part in [n for n in inside if n.startswith("part=")] or [""]:
                out.setdefault(part, []).append(v)
    return out


def versioned(spark: SparkSession, path: str, batch: int, parts: set[str] | None = None) -> DataFrame | None:
    """The table as the last batch before this one left it (or some parts of it), or None."""
    last = {part: max(k for k in vs if k < batch) for part, vs in _versions(spark, path).items() if min(vs) < batch and (parts is None or part in parts)}
    folders = [f"{path}/v{v}/{part}".rstrip("/") for part, v in sorted(last.items())]
    return spark.read.parquet(*folders) if folders else None


def upsert_chapters(path: str, overwrite: bool = False, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A batch of chapters into the table at path: kept as they were first, or replaced.

    The table is dealt by book and id into parts, and a batch rewrites only those it has chapters for. A batch that is run again writes the same version
    again, from the versions before it; of each part it rewrote, what is older than the version it read goes.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("part", F.pmod(F.xxhash64("book", "id"), F.lit(parts)).cast("int")).persist()
        try:
            touched = {f"part={r[0]}" for r in new.select("part").distinct().collect()}  # at most `parts`
            old = versioned(spark, path, number, touched)
            rows = batch.limit(0) if old is None else old.select(batch.columns)
            merged = (library.upsert if overwrite else library.insert_if_absent)(rows, new.drop("part"))
            merged = merged.withColumn("part", F.pmod(F.xxhash64("book", "id"), F.lit(parts)).cast("int"))
            merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/v{number}")
        finally:
            new.unpersist()
        for part, versions in _versions(spark, path).items():
            for v in [k for k in versions if k < number][:-1] if part in touched else []:
                scratch.delete(spark, f"{path}/v{v}/{part}")

    return each


def counters(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def write_version(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch as a version of its own; those before the last one go."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v{number}")
        for v in [k for k in _versions(batch.sparkSession, path).get("", []) if k < number][:-1]:
            scratch.delete(batch.sparkSession, f"{path}/v{v}")

    return each


def once(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each fingerprint's first event; what comes later than delay isn't remembered."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windows(events: DataFrame, time: str, keys: list[str], length: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts in windows of event time (an addition to what the surveyed operators do)."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, delay).groupBy(w, *keys).agg(F.count("*").alias("n"))


def job_states(events: DataFrame, time: str = "ts") -> DataFrame:
    """(job, state, time) events -> the state each job is in: the end it came to first, or else the furthest state before an end. Unknown states don't count.

    Both are plain aggregates, so the result doesn't depend on the order in which events arrive, and the state of a job is three values.
    """
    end = F.col("state").isin("cancelled", "done", "failed")
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    first_end = F.min(F.when(end, F.struct(F.col(time), rank.alias("rank"), "state")))
    furthest = F.max(F.when(~end & (rank > 0), F.struct(rank.alias("rank"), "state")))
    out = events.groupBy("job").agg(first_end.alias("end"), furthest.alias("way"))
    return out.select("job", F.coalesce("end.state", "way.state").alias("state"))


def pending_work(work: DataFrame, committed: DataFrame, hashes: list[str]) -> DataFrame:
    """Chapters (book, id, hashes) to do when a job goes on: those that weren't committed with these very inputs. work may be a stream."""
    return work.join(committed.select("book", "id", *hashes).distinct(), ["book", "id", *hashes], "left_anti")
