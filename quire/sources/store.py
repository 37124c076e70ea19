"""A library's files as tables: JSON with fixed schemas, permissive or strict, and appended logs."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.sources.books import place

CHAPTER = "id long, title string, url string, body string, fetched_at double"
BOOK = (
    "book_id string, url string, title string, author string, cover_url string, language string, synopsis string, tags array<string>, saved_at double, "
    "toc array<struct<id long, title string, url string>>"
)
EVENT = "id string, timestamp string, operation string, event string, chapter long, model string, status string"


def _json(spark: SparkSession, path: str | list[str], schema: str, multiline: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, records that don't fit the schema) of JSON files, each a record, or of JSON lines."""
    raw = spark.read.text(path, wholetext=multiline).select(F.col("_metadata.file_path").alias("file"), "value")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    raw = raw.where(X.has_text(F.col("value"))).withColumn("j", F.from_json("value", schema + ", _corrupt_record string", options))
    bad = F.col("j").isNull() | F.col("j._corrupt_record").isNotNull()
    return raw.where(~bad).select("j.*", "file").drop("_corrupt_record"), raw.where(bad).select("file", F.col("value").alias("_corrupt_record"))


def read_books(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(books, files that can't be read)."""
    return _json(spark, path, BOOK, True)


def read_chapters(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chapters, records that can't be read) of files with a chapter each, or with one in each line, as write_chapters() writes them."""
    return _json(spark, path, CHAPTER, not lines)


def toc(books: DataFrame) -> DataFrame:
    """books -> (book, pos, id, title, url) of their tables of contents."""
    return books.select(F.col("book_id").alias("book"), F.posexplode("toc").alias("pos", "t")).select("book", "pos", "t.id", "t.title", "t.url")


def write_chapters(chapters: DataFrame, path: str, per_folder: int = 100) -> None:
    """One folder for each book and hundred of chapters, or per_folder of them; a read of one chapter prunes to its folder. Folders are to hold megabytes: where a hundred ids have a few
    chapters of a book, writing and listing cost a file each."""
    out = chapters.withColumn("chunk", X.chunk_label(F.col("id"), per_folder))
    out.repartition("book", "chunk").write.mode("overwrite").partitionBy("book", "chunk").json(path)


def publish(df: DataFrame, path: str) -> None:
    """Write a new version below a place, then point to it at once: readers see the old version or the new one, and a failed write changes nothing. Of older
    versions the last is kept, for those who still read it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    fs = at("").getFileSystem(conf)
    before = _current(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(at(version).toString())
    out = fs.create(at(f"_pointer-{version}"), True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(at(f"_pointer-{version}")), fs.makeQualified(at("_current")), overwrite)
    for status in fs.listStatus(at("")):
        if (name := status.getPath().getName()).startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)


def _current(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_current")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def published(spark: SparkSession, path: str) -> DataFrame:
    """The version that publish() pointed to last."""
    version = _current(spark, path)
    if version is None:
        raise ValueError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def _manifests(spark: SparkSession, path: str):
    """A catalog's file system, the path of a name in it, and the numbers of its manifests."""
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}".rstrip("/"))
    fs = at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at(""))] if fs.exists(at("")) else []
    return fs, at, sorted(int(x[9:]) for x in names if x.startswith("manifest-"))


def catalog_version(spark: SparkSession, path: str) -> int:
    """The number of the last manifest that was published at a path; 0: none."""
    return max(_manifests(spark, path)[2], default=0)


def catalog_tables(spark: SparkSession, path: str, version: int | None = None) -> dict[str, str]:
    """Folders of a version's tables, of the last one if none is named: all that a reader needs to see several tables as they were published together."""
    fs, at, numbers = _manifests(spark, path)
    version = max(numbers, default=0) if version is None else version
    if not version:
        return {}
    stream = fs.open(at(f"manifest-{version:09d}"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish_tables(tables: dict[str, DataFrame], path: str, base: int | None = None) -> int:
    """Publish several tables at once, as the version after base (None: the last); its number. Tables that aren't named stay what they were in base.

    Every table is written to a folder of its own, and then one file that names them all appears under the next number, by a rename that fails if that number is there. So
    a failure in between leaves the last version as it was, with folders that nothing points to; and of two writers that began at one version the first wins, and
    the other gets a FileExistsError and has changed nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    base = catalog_version(spark, path) if base is None else base
    folders = catalog_tables(spark, path, base)
    for name, df in tables.items():
        folders[name] = f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(folders[name])
    fs, at, _ = _manifests(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new = f"_writing-{uuid.uuid4().hex}"
    out = fs.create(at(new), False)
    out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(at(new)), fs.makeQualified(at(f"manifest-{base + 1:09d}")), how)
    except Exception as e:
        fs.delete(at(new), False)
        if base + 1 in _manifests(spark, path)[2]:
            raise FileExistsError(f"version {base + 1} was published by another writer") from e
        raise
    return base + 1


def read_published(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(catalog_tables(spark, path, version)[name])


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def _appends(spark: SparkSession, path: str) -> list[list[str]]:
    """A log's files by the append that wrote them (their names share its id), the newest first: names and times from the listing, no contents."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    groups: dict[str, tuple[int, list[str]]] = {}
    for top in fs.globStatus(p) or []:
        for f in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            name = f.getPath().getName()
            if f.isFile() and f.getLen() and not name.startswith(("_", ".")):
                write = re.sub(r"^part-\d+-|-c\d+.*$", "", name)
                time, files = groups.get(write, (0, []))
                groups[write] = max(time, f.getModificationTime()), [*files, f.getPath().toString()]
    return [files for _, files in sorted(groups.values(), key=lambda g: (-g[0], g[1]))]


def tail(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """The last n events of a log, the newest first; lines that aren't whole are skipped.

    A log is appended to in the order of its events, so the newest appends have its end: their files are read, and those of four times as many while they have too few events.
    All other files are only listed, whatever their number.
    """
    appends, k = _appends(spark, path), 4
    while True:
        files = [f for group in appends[:k] for f in group]
        if not files:
            return spark.createDataFrame([], EVENT + ", file string")
        good, _ = _json(spark, files, EVENT, False)
        if k >= len(appends) or good.limit(n).count() == n:
            return good.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)
        k *= 4


def cached(work: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work whose fingerprint the cache has, with its value; work still to do)."""
    return work.join(cache, "fingerprint"), work.join(cache, "fingerprint", "left_anti")


#: Bytes of texts that a task hands on at a time, and how many texts.
HELD, MANY = 8 << 20, 1000


def _hidden(path: str) -> bool:
    """Below a folder that is read: has any step a name that Spark's readers leave out?"""
    return any(p.startswith(".") or (p.startswith("_") and "=" not in p) for p in path.split("/"))


def _listed(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Files at and below entries of a folder, by their names in it."""
    fs, root = place(path)
    root = root.rstrip("/")
    for b in batches:
        for name, folder in zip(b.column("file").to_pylist(), b.column("folder").to_pylist(), strict=True):
            below = fs.get_file_info(arrow_fs.FileSelector(f"{root}/{name}", recursive=True)) if folder else []
            names = [f.path[len(root) + 1 :] for f in below if f.is_file] if folder else [name]
            names = [n for n in names if not _hidden(n)]
            for k in range(0, len(names), 10_000):
                yield pa.RecordBatch.from_pydict({"file": names[k : k + 10_000]}, pa.schema({"file": pa.string()}))


def _whole(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    fs, root = place(path)
    shown, root = path.rstrip("/"), root.rstrip("/")
    kind = pa.schema({"file": pa.string(), "value": pa.binary()})
    names, held = [], []
    out = lambda: pa.RecordBatch.from_pydict({"file": names, "value": held}, kind)
    size = 0
    for b in batches:
        for name in b.column("file").to_pylist():
            with fs.open_input_file(f"{root}/{name}") as f:
                held.append(f.read())
            names.append(f"{shown}/{name}")
            size += len(held[-1])
            if size >= HELD or len(held) >= MANY:
                yield out()
                names, held, size = [], [], 0
    yield out()


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of a file or of a folder's whole files, at any depth, without a byte-order mark; hidden files and folders are left out, as Spark's readers do.

    The driver lists the folder itself and tasks what is below each entry: Spark's index runs jobs of a task for each folder, one after the other for each folder above them.
    """
    fs, root = place(path.rstrip("/"))
    if fs.get_file_info(root).is_file:
        path, top = path.rpartition("/")[0], [(root.rpartition("/")[2], False)]
    else:
        top = [(f.base_name, not f.is_file) for f in fs.get_file_info(arrow_fs.FileSelector(root)) if not _hidden(f.base_name)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.createDataFrame(top, "file string, folder boolean").repartition(max(1, min(len(top), parts)), "file").mapInArrow(lambda b: _listed(b, path), "file string")
    t = files.repartition(parts, "file").mapInArrow(lambda b: _whole(b, path), "file string, value binary")
    return t.select("file", F.regexp_replace(F.col("value").cast("string"), "^\ufeff", "").alias("text"))


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """A log's events as a stream, as append_log() adds files to it."""
    return spark.readStream.schema(EVENT).json(path)


def newest_jobs(jobs: DataFrame, n: int = 100) -> DataFrame:
    """The n jobs changed last (job, mtime)."""
    return jobs.orderBy(F.col("mtime").desc(), "job").limit(n)
