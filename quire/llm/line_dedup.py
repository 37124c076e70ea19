"""Line dedup by site-relative frequency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Workspace

#: Fixed patterns, understood alike by Java and RE2.
COMMENTS = r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>"
BLOCKS = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAGS = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def html_lines(html: Column) -> Column:
    """Text of a page with a line for each block element; scripts, styles and comments go."""
    text = F.regexp_replace(F.regexp_replace(html, COMMENTS, " "), BLOCKS, "\n")
    return F.regexp_replace(text, TAGS, "")


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; '' if it has none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def drop_boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = 0.3, min_pages: int = 3, distinct: bool = False) -> DataFrame:
    """pages with columns `line_host`, `lines` (kept lines joined by LF), `n_lines` and `n_dropped`; all other columns stay.

    A line is dropped if it is on more than ratio of its host's pages, and on min_pages at least. A page counts once for a line
    however often it repeats it; the host total counts all its pages. If distinct, equal texts of a host count as one page, so that
    many copies of a page don't make its own lines frequent (null texts are equal). Lines are compared as they are; those of spaces alone are
    kept and not counted. Repeated rows are pages each. Texts of any length are taken whole. Null text: null lines, 0 and 0, still a page of its host. Null host: a host of its own. Empty table:
    no rows. A column of pages named like one of the four above is replaced.

    Counts are summed map-side, by host and line, so neither a host nor a line with a third of all rows meets in one task. What
    is dropped is at most (lines a page) / ratio hashes a host, so the text side joins one short array for each host; Spark
    broadcasts that table only if its written size is below the session's limit, and splits a hot host's rows otherwise.
    """
    space = Workspace(pages.sparkSession)
    lines = F.split(F.col("x"), "\n", -1)
    hashes = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x, F.length(x)))
    seen = pages.select(host.alias("host"), text.alias("x")).select("host", F.array_distinct(F.coalesce(hashes, F.array().cast("array<long>"))).alias("h"))
    if distinct:
        once = pages.select(host.alias("host"), text.alias("x")).withColumn("th", F.xxhash64("x", F.length("x")))
        seen = once.select("host", "th", F.array_distinct(F.coalesce(hashes, F.array().cast("array<long>"))).alias("h")).dropDuplicates(["host", "th"])
    total = F.lit(None).cast("long")  # the row that counts the page itself
    counts = seen.select("host", F.explode(F.concat(F.array(total), "h")).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    counts = space.write(counts.where(F.col("h").isNull() | (F.col("n") >= min_pages)), "counts")
    # Both sides are one row for each host, or for each line on min_pages of its pages.
    totals = counts.where("h is null").select("host", F.col("n").alias("pages"))
    often = counts.where("h is not null").alias("a").join(totals.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host"))).where(F.col("n") > F.col("pages") * F.lit(ratio))
    drop = space.write(often.groupBy("a.host").agg(F.collect_list("h").alias("drop")).select(F.col("host").alias("drop_host"), "drop"), "drop")
    row = pages.select(F.struct("*").alias("row"), host.alias("host"), text.alias("x"))
    joined = row.join(drop, F.col("host").eqNullSafe(F.col("drop_host")), "left")
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("drop", F.xxhash64(x, F.length(x))) | (F.trim(x) == "")))
    joined = joined.withColumn("kept", kept)
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    own = [c for c in pages.columns if c.lower() not in ("line_host", "lines", "n_lines", "n_dropped")]
    some = F.col("x").isNotNull()
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in own],
        F.col("host").alias("line_host"),
        F.array_join("kept", "\n").alias("lines"),
        F.when(some, n(lines)).otherwise(0).alias("n_lines"),
        F.when(some, n(lines) - n(F.col("kept"))).otherwise(0).alias("n_dropped"),
    )
