"""A library of books as tables: toc(book, id, title, url), chapters(book, id, title, url, body, fetched_at), books(book, ..., saved_at)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import scratch
from quire.functions import text as X
from quire.operators import stats
from quire.scratch import Tables
from quire.sources.books import place
from quire.sources.store import CHAPTER

KEY = ["book", "id"]


def toc_with_saved(toc: DataFrame, chapters: DataFrame) -> DataFrame:
    """toc with saved: is there a chapter?"""
    have = chapters.select(*KEY).distinct().withColumn("saved", F.lit(True))
    return toc.join(have, KEY, "left").withColumn("saved", F.coalesce("saved", F.lit(False)))


def missing(toc: DataFrame, chapters: DataFrame) -> DataFrame:
    return toc.join(chapters, KEY, "left_anti")


def saved_in_order(toc: DataFrame, chapters: DataFrame, order: str = "id", required: bool = False) -> DataFrame:
    """Saved chapters in the order of the table of contents, for an export. required: none at all is an error."""
    place = [c for c in (order,) if c not in KEY]
    out = toc.select(*KEY, *place).join(chapters, KEY)
    if required and out.isEmpty():
        raise ValueError("no chapter is saved")
    return out.orderBy("book", order).drop(*place)


def upsert_books(books: DataFrame, new: DataFrame) -> DataFrame:
    """books with new ones in the place of those of the same name; of several rows of a book the last saved."""
    latest = new.groupBy("book").agg(F.max_by(F.struct(*new.columns), F.struct("saved_at", F.struct(*[c for c in new.columns if c != "book"]))).alias("b")).select("b.*")
    return books.join(latest.select("book"), "book", "left_anti").unionByName(latest)


def delete_books(books: DataFrame, gone: DataFrame) -> DataFrame:
    return books.join(gone.select("book"), "book", "left_anti")


def successful(chapters: DataFrame) -> DataFrame:
    """Chapters that were fetched; an unknown outcome isn't one."""
    return chapters.where(F.coalesce(F.col("success"), F.lit(False)))


def selected(toc: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Of each book its first chapters, or its last; if both are given, the first."""
    if first:
        return toc.withColumn("r_", F.row_number().over(Window.partitionBy("book").orderBy("id"))).where(F.col("r_") <= first).drop("r_")
    if last:
        return toc.withColumn("r_", F.row_number().over(Window.partitionBy("book").orderBy(F.col("id").desc()))).where(F.col("r_") <= last).drop("r_")
    return toc


def only(toc: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chapters that are asked for (book, id)."""
    return toc.join(wanted.select(*KEY), KEY, "left_semi")


def complete_chunk(toc: DataFrame, asked: DataFrame, size: int = 100) -> DataFrame:
    """(book, chunk_start, complete): are the ids asked for in a chunk exactly those that the table of contents has there?"""
    side = lambda d, k: d.select("book", X.chunk_start(F.col("id"), size).alias("chunk_start"), "id").distinct().withColumn(k, F.lit(1))
    j = side(asked, "a").join(side(toc, "t"), ["book", "chunk_start", "id"], "full")
    return j.groupBy("book", "chunk_start").agg(F.count("a").alias("n"), (F.count_if(F.col("a").isNull() | F.col("t").isNull()) == 0).alias("complete")).where("n > 0").drop("n")


def job_counts(results: DataFrame) -> DataFrame:
    """(job, success_count, failed_count) of results (job, success)."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return results.groupBy("job").agg(F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failed_count"))


def active_books(jobs: DataFrame) -> DataFrame:
    """Books with a job that is pending, running or stopping."""
    return jobs.where(F.col("status").isin("pending", "running", "stopping")).select("book").distinct()


def summary(books: DataFrame, toc: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row for each book: total and saved chapters; the newest first."""
    n = toc_with_saved(toc, chapters).groupBy("book").agg(F.count("*").alias("total_chapters"), F.count_if("saved").alias("saved_count"))
    out = books.join(n, "book", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("total_chapters", "saved_count")})
    return out.orderBy(F.col("saved_at").desc_nulls_last(), "book")


def valid(rows: DataFrame) -> DataFrame:
    """Rows whose book name can't leave the library's folder and whose id is above zero."""
    b = F.col("book")
    safe = (b != "") & ~b.isin(".", "..") & ~b.rlike(r"[/\\\x00]")
    return rows.where(safe & (F.col("id") > 0))


def insert_if_absent(chapters: DataFrame, new: DataFrame) -> DataFrame:
    """chapters and what of new they don't have; of several rows of new for a chapter the first fetched."""
    w = Window.partitionBy(*KEY).orderBy("fetched_at")
    first = valid(new).withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")
    return chapters.unionByName(first.join(chapters, KEY, "left_anti"))


def upsert(chapters: DataFrame, new: DataFrame) -> DataFrame:
    """chapters with new in their place; of several rows of new for a chapter the last fetched."""
    w = Window.partitionBy(*KEY).orderBy(F.col("new_").desc(), F.col("fetched_at").desc_nulls_last())
    both = chapters.withColumn("new_", F.lit(0)).unionByName(valid(new).withColumn("new_", F.lit(1)))
    return both.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_", "new_")


def delete(chapters: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the chapters of gone (book, id); the table of contents stays, so they count as missing."""
    return chapters.join(gone, KEY, "left_anti")


def unknown_ids(toc: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that no chapter of the table of contents has; an update is refused unless this is empty."""
    return changes.join(toc, KEY, "left_anti")


def update_titles(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """rows (of a table of contents or saved chapters) with the titles of titles (book, id, title) where there are any."""
    t = titles.select(*KEY, F.col("title").alias("new_title_"))
    return rows.join(t, KEY, "left").withColumn("title", F.coalesce("new_title_", "title")).drop("new_title_")


def translated_with_parent(translated: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose chapter is saved, rows to refuse)."""
    return translated.join(chapters, KEY, "left_semi"), translated.join(chapters, KEY, "left_anti")


def export_chunks(chapters: DataFrame, per_file: int = 100) -> DataFrame:
    """chapters with the file of an export they go to, and whether it is the book's first, which carries the front matter."""
    if not 1 <= per_file <= 10_000:
        raise ValueError("chapters per file must be between 1 and 10000")
    c = chapters.withColumns({"chunk_start": X.chunk_start(F.col("id"), per_file), "file": X.chunk_label(F.col("id"), per_file)})
    return c.withColumn("first_file", F.col("chunk_start") == F.min("chunk_start").over(Window.partitionBy("book")))


#: Characters of a partition's value that Spark writes as %XX in a folder's name.
_ESCAPED = re.compile(r"""["#%'*/:=?\\{\[\]^\x00-\x1f\x7f]""")


def _folder(name: str, value: str | None) -> str:
    """A partition's folder, as Spark names it."""
    return f"{name}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', value) if value is not None else '__HIVE_DEFAULT_PARTITION__'}"


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """One task's part of write_text(): its chapters, sorted by file and id."""
    fs, root = place(path)
    now, part, sink, n, after = None, None, None, 0, b""

    def done():
        sink.write(b"\n")
        sink.close()
        fs.move(part, f"{now}/text.txt")

    for b in batches:
        for book, file, data in zip(*[b.column(k).to_pylist() for k in ("book", "file", "data")], strict=True):
            at = f"{root}/{_folder('book', book)}/{_folder('file', file)}"
            if at != now:
                if now is not None:
                    done()
                fs.create_dir(at)
                now, part, n, after = at, f"{at}/.{uuid.uuid4().hex}", n + 1, b""
                sink = fs.open_output_stream(part)
            if data is not None:
                sink.write(after + data)
                after = b"\n"
    if now is not None:
        done()
    yield pa.RecordBatch.from_pydict({"n": [n]})


def write_text(exported: DataFrame, path: str, text: str = "text") -> int:
    """One folder for each book and file, one text file in each: exported (book, file, id, text), chapters in id order, null texts left out; earlier files go. How many files were written.

    Tasks write the files themselves, each under a hidden name until it is whole: Spark's writer takes ten milliseconds and more for a file on a local disk, as each gets a check sum and has
    its rights set by a process of its own. A task holds a batch of chapters, and no file as a whole.
    """
    scratch.text_batches(exported.sparkSession)
    scratch.delete(exported.sparkSession, path)
    fs, root = place(path)
    fs.create_dir(root)
    rows = exported.select("book", "file", "id", F.col(text).cast("binary").alias("data"))
    dealt = rows.repartition("book", "file").sortWithinPartitions("book", "file", "id", "data")
    return dealt.mapInArrow(lambda batches: _texts(batches, path), "n long").agg(F.sum("n")).first()[0] or 0


def needs_numbers(chapters: DataFrame, text: str, title: str | None = None) -> DataFrame:
    """For each book: has any chapter no number in what is seen of it (its text's start, or its title if given)?"""
    seen = F.coalesce(X.heading_has_number(F.col(text)), F.lit(False))
    if title:
        seen = seen | F.coalesce(X.heading_has_number(F.col(title)), F.lit(False))
    return chapters.groupBy("book").agg(F.max(~seen).alias("needs_numbers"))


def search(books: DataFrame, query: str) -> DataFrame:
    return books.where(F.contains(F.lower(F.concat_ws(" ", "title", "author")), F.lit(query.lower().strip())))


def chapter_status(toc: DataFrame, jobs: DataFrame, errors: DataFrame, translated: DataFrame, current: DataFrame) -> DataFrame:
    """toc with status: the active job's, else failed, else stale (the text or its terms have changed since), else done, else none.

    jobs (book, id, job_status), errors (book, id), translated and current (book, id, raw_hash, terms_hash).
    """
    t = translated.select(*KEY, F.col("raw_hash").alias("r0"), F.col("terms_hash").alias("t0"), F.lit(True).alias("has"))
    out = toc.join(jobs, KEY, "left").join(errors.select(*KEY).distinct().withColumn("failed", F.lit(True)), KEY, "left").join(t, KEY, "left").join(current, KEY, "left")
    stale = F.col("has") & ~(F.col("r0").eqNullSafe(F.col("raw_hash")) & F.col("t0").eqNullSafe(F.col("terms_hash")))
    status = F.coalesce(F.col("job_status"), F.when(F.col("failed"), "failed").when(stale, "stale").when(F.col("has"), "done").otherwise("none"))
    return out.select(*toc.columns, status.alias("status"))


def commit_if_unchanged(chapters: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """done (book, id, raw_hash, ...) -> (rows whose chapter still has that text, rows to refuse)."""
    now = chapters.select(*KEY, F.sha2("body", 256).alias("raw_hash"))
    on = [*KEY, "raw_hash"]
    return done.join(now, on, "left_semi"), done.join(now, on, "left_anti")


def latest_legacy_job(jobs: DataFrame, markers: DataFrame, raw_hash: Column, dictionary_hash: Column) -> DataFrame:
    """Of jobs (job, raw_hash, dictionary_hash, mtime) with equal inputs and without a version marker, the newest."""
    same = jobs.join(markers, "job", "left_anti").where((F.col("raw_hash") == raw_hash) & (F.col("dictionary_hash") == dictionary_hash))
    return same.agg(F.max_by("job", F.struct("mtime", "job")).alias("job")).where("job is not null")


#: What a stage of a job is called.
STAGES = {
    "Parsing RAW": "Parsing RAW", "Local parsing": "Parsing chapters", "Pre-dictionary resolution": "Resolving terminology", "Post-dictionary review": "Reviewing remaining terminology",
    "Local terminology scan": "Discovering terminology", "Terminology candidates ready": "Resolving terminology", "Dictionary resolution": "Resolving terminology",
    "Terminology resolution": "Resolving terminology", "Reviewing ignored candidates": "Reviewing ignored candidates", "Dictionary frozen": "Freezing dictionary", "Translating": "Translating",
    "Local final global audit": "Final audit", "Complete": "Completed", "Queued": "Preparing inputs",
}
ENDED = {"failed": "Failed", "cancelled": "Cancelled", "deleting": "Deleting batch"}


def job_display(jobs: DataFrame, chapters: DataFrame) -> DataFrame:
    """(job, display_title, book_title, chapter_start, chapter_end, total_chapters, stage_label) of jobs (job, status, stage, source_name, book_title, chapter_start,
    chapter_end, total_chapters) and what they parsed, chapters (job, number)."""
    n = chapters.where("number is not null").groupBy("job").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count("*").alias("n"))
    j = jobs.join(n, "job", "left")
    some = lambda c: F.nullif(c, F.lit(""))
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"^.*/(?=[^/])|/+$", ""), r"(?<=[^.])\.[^.]+$", "")
    source = stem(F.coalesce(some(F.col("source_name")), some(F.col("book_title"))))
    book = stem(F.coalesce(some(F.col("book_title")), source))
    start, end, total = (F.coalesce(a, b) for a, b in (("chapter_start", "lo"), ("chapter_end", "hi"), ("total_chapters", "n")))
    title = (
        F.when(start.isNotNull() & end.isNotNull(), F.concat(book, F.lit(" · Ch. "), start.cast("string"), F.lit("–"), end.cast("string")))
        .when(total.isNotNull(), F.concat(book, F.lit(" · "), total.cast("string"), F.lit(" chapters")))
        .otherwise(source)
    )
    label = lambda names, c: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[c]
    stage = F.coalesce(label(ENDED, F.col("status")), label(STAGES, F.col("stage")), F.col("stage"), F.col("status"), F.lit("Unknown"))
    shown = F.coalesce(title, F.concat(F.lit("Translation batch "), F.substring("job", 1, 8)))
    return j.select("job", shown.alias("display_title"), book.alias("book_title"), start.alias("chapter_start"), end.alias("chapter_end"), total.alias("total_chapters"), stage.alias("stage_label"))


def find_chapter(path: str, spark, book: str, id_: int, per_folder: int = 100) -> DataFrame:
    """One chapter of a library that store.write_chapters() wrote: only its book's folder of per_folder chapters is read, as the columns are known
    and no file has to be looked at for them."""
    start = (id_ - 1) // per_folder * per_folder + 1
    chunk = f"{start:04d}-{start + per_folder - 1:04d}"
    return spark.read.schema(f"{CHAPTER}, book string, chunk string").json(path).where((F.col("book") == book) & (F.col("chunk") == chunk) & (F.col("id") == id_))


def write_artifacts(path: str, chapters: DataFrame, notes: DataFrame, dictionary: DataFrame, unresolved: DataFrame, rejected: DataFrame) -> None:
    """What a finished batch leaves, a folder each below path: translated.json, translated.txt, author-notes.txt, dictionary.json, unresolved.json, rejected.json.

    chapters (number, title, paragraphs), notes (number, notes): texts are in chapter order in one file each, as they are read from start to end; a batch is what one
    job translates.
    """
    head = lambda tail: F.concat(F.lit("Chương "), F.col("number").cast("string"), tail)
    named = F.when(F.coalesce(F.col("title"), F.lit("")) == "", "").otherwise(F.concat(F.lit(": "), "title"))
    texts = {
        "translated.txt": chapters.select("number", F.concat(head(named), F.lit("\n"), F.array_join("paragraphs", "\n\n"), F.lit("\n")).alias("value")),
        "author-notes.txt": notes.select("number", F.concat(head(F.lit(" — Ghi chú tác giả\n")), F.array_join("notes", "\n\n"), F.lit("\n")).alias("value")),
    }
    for name, d in texts.items():
        d.coalesce(1).sortWithinPartitions("number").select("value").write.mode("overwrite").text(f"{path}/{name}")
    for name, d in {"translated.json": chapters, "dictionary.json": dictionary, "unresolved.json": unresolved, "rejected.json": rejected}.items():
        d.write.mode("overwrite").json(f"{path}/{name}")


def shelf_order(books: DataFrame, title: str, locale: str = "UNICODE") -> DataFrame:
    """books with place 0, 1, ... as a reader of the locale sorts titles: letters with marks beside those without, small before large, and code points for what is equal there.

    Sorted by ranges, so no task has all titles; null titles come first. Books are written once before that, as ranges are found by a read of their own.
    """
    tables = Tables(books.sparkSession, "shelf")
    rows = tables.write(books).withColumns({"collated_": F.collate(title, locale), "own_": F.col(title)})
    return stats.numbered(rows, [], ["collated_", "own_"], "place", tables).drop("collated_", "own_")


def spelled_alike(names: DataFrame, name: str, collation: str = "UNICODE_CI") -> DataFrame:
    """(name, n): names that a collation takes for one, by the least of them, and how many rows have it. Names meet by the collation's own keys, not by lowered texts; rows
    are counted by their very names first, so a collation's key is made once for a name, not for each of its rows."""
    own = names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    g = own.withColumn("key_", F.collate("name", collation))
    return g.groupBy("key_").agg(F.min("name").alias("name"), F.sum("n").alias("n")).select("name", "n")
