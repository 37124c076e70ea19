"""Where intermediates go: a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _clear(spark: SparkSession, path: str) -> None:
    local = path.removeprefix("file:")
    if local.startswith("/"):
        shutil.rmtree("/" + local.lstrip("/"), ignore_errors=True)
        return
    with contextlib.suppress(Exception):  # else the session is over, and the folder's owner cleans up
        delete(spark, path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir (or the context's checkpoint folder); deleted when the program ends.

    Where neither is set, a temporary folder if Spark runs in this process alone; on a cluster that is an error, as each executor would write to a
    disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, base, True)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_clear, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it is, if there is one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of whole texts that are read from a file at a time.
READ = 512


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to Python by at most so many rows at a time for the rest of the session: 10,000 long texts in one Arrow batch, held on both
    sides, are a large part of a small executor's memory. So are those of one batch that is read from a file (by default 4096 rows), whose texts lie in one array, which
    doubles until they fit: READ rows are read at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key, "4096")) > READ:
        spark.conf.set(key, str(READ))


class Tables:
    """Intermediates of one operator in a folder of their own, written so that no plan grows and a lost executor's rows are read again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, shared_folder(spark, name), 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a written table that nothing reads any more."""
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            delete(self.spark, path)
