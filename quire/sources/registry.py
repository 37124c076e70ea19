"""Which source a URL belongs to, as a table of prefixes (prefix, name, encoding), and a source's rules as columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.scratch import Tables


def normal(url: Column) -> Column:
    """Lower case, ending in one slash."""
    return F.concat(F.regexp_replace(F.lower(url), "^/+|/+$", ""), F.lit("/"))


def bind(pages: DataFrame, url: str, prefixes: DataFrame) -> DataFrame:
    """pages with source_name, the name of the longest prefix of their URL; null if none. Of equal prefixes the least name counts.

    A prefix ends in a slash, so it can only be equal to a URL's start up to one of its slashes. For each number of slashes that prefixes have (a few) that
    start is joined by equality, and the deepest match is taken: pages keep their rows, and where the prefixes are small Spark broadcasts them.
    """
    p = prefixes.select(normal(F.col("prefix")).alias("prefix_"), F.col("name").alias("name_")).groupBy("prefix_").agg(F.min("name_").alias("name_"))
    p = p.withColumn("depth_", F.regexp_count("prefix_", F.lit("/")))
    depths = sorted((r[0] for r in p.select("depth_").distinct().collect()), reverse=True)
    out = pages.withColumn("url_", normal(F.col(url)))
    for d in depths:
        own = p.where(F.col("depth_") == d).select(F.col("prefix_").alias(f"prefix_{d}_"), F.col("name_").alias(f"name_{d}_"))
        out = out.join(own, F.concat(F.substring_index("url_", "/", d), F.lit("/")) == F.col(f"prefix_{d}_"), "left")
    found = F.coalesce(*[F.col(f"name_{d}_") for d in depths], F.lit(None).cast("string"))
    return out.select(*pages.columns, found.alias("source_name"))


def fill_volumes(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """entries (keys, order, title, url, is_volume) -> chapters with the number of volume rows before each."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("volume", F.sum(F.col("is_volume").cast("int")).over(w)).where("not is_volume").withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def dedupe_links(entries: DataFrame, keys: list[str], link: str, order: str, first: bool = True) -> DataFrame:
    """One row for each link: the first, or the last."""
    o = F.col(order).asc() if first else F.col(order).desc()
    return entries.withColumn("r_", F.row_number().over(Window.partitionBy(*keys, link).orderBy(o))).where("r_ = 1").drop("r_")


def follow(links: DataFrame, start: DataFrame) -> DataFrame:
    """(chapter, n, url): the pages that each start (chapter, url) leads to by links (url, next), in order from 0, each once.

    List ranking by pointer doubling. Round k has, for each page, the one 2^k further on, and what a chapter has of its first 2^k pages gives the next 2^k by one join; so
    a chain of m pages takes log2(m) rounds and no round looks at more than pointers. A page's number stands for its URL in all of them. A chain ends at a page
    without a next, or whose next isn't among the pages; one that comes back to a page of its own ends before it: in the round after all its pages are known
    nothing is new to it. Chains may share pages. Of links with one URL the least next counts; null URLs lead nowhere.

    Each round is written to a shared folder and the one before dropped, so that no plan grows. A page that many link to is a row of one side of each join only.
    """
    tables = Tables(links.sparkSession, "follow")
    pages = tables.write(links.where("url is not null").groupBy("url").agg(F.min("next").alias("next")).withColumn("page", F.monotonically_increasing_id()))
    to = pages.select(F.col("url").alias("next"), F.col("page").alias("to"))
    jump = tables.write(pages.where("next is not null").join(to, "next").select("page", "to"))
    found = [tables.write(start.join(pages.select("url", "page"), "url").groupBy("chapter", "page").agg(F.lit(0).cast("long").alias("n")))]
    k = 0
    while not jump.isEmpty():
        reach = functools.reduce(DataFrame.unionByName, found)
        ahead = reach.join(jump, "page").groupBy("chapter", F.col("to").alias("page")).agg((F.min("n") + (1 << k)).alias("n")).alias("a")
        known = reach.select("chapter", "page").alias("r")
        fresh = tables.write(ahead.join(known, F.col("a.chapter").eqNullSafe(F.col("r.chapter")) & (F.col("a.page") == F.col("r.page")), "left_anti"))
        if fresh.isEmpty():
            break
        found.append(fresh)
        further = tables.write(jump.join(jump.select(F.col("page").alias("to"), F.col("to").alias("then")), "to").select("page", F.col("then").alias("to")))
        tables.drop(jump)
        jump, k = further, k + 1
    return functools.reduce(DataFrame.unionByName, found).join(pages.select("page", "url"), "page").select("chapter", "n", "url")


def chain(pages: DataFrame, start: DataFrame) -> DataFrame:
    """Split chapters put together: pages (url, next, body), start (chapter, url) -> (chapter, parts, body), as follow() finds their pages. Bodies are joined once,
    when all places are known; of pages with one URL the least body counts."""
    bodies = pages.groupBy("url").agg(F.min("body").alias("body"))
    parts = F.array_sort(F.collect_list(F.struct("n", "body")))
    out = follow(pages.select("url", "next"), start).join(bodies, "url").groupBy("chapter")
    return out.agg(F.count("*").alias("parts"), F.array_join(F.transform(parts, lambda p: p["body"]), "").alias("body"))


def chain_ends(links: DataFrame, start: DataFrame) -> DataFrame:
    """(chapter, parts, last, ended): how many pages a chapter has, its last one's URL, and why it ends there: `end` (no next), `missing` (its next isn't among the
    pages) or `loop` (its next is one of its own)."""
    known = links.where("url is not null").groupBy("url").agg(F.min("next").alias("next"))
    last = follow(links, start).groupBy("chapter").agg(F.count("*").alias("parts"), F.max_by("url", "n").alias("last"))
    out = last.join(known.select(F.col("url").alias("last"), "next"), "last").join(known.select(F.col("url").alias("next"), F.lit(True).alias("there")), "next", "left")
    return out.select("chapter", "parts", "last", F.when(F.col("next").isNull(), "end").when(F.col("there"), "loop").otherwise("missing").alias("ended"))


def scrub(body: Column, furniture: list[str]) -> Column:
    """Without a site's furniture, given as patterns."""
    for p in furniture:
        body = F.regexp_replace(body, p, "")
    return X.strip(body)


def chapter_slots(latest: DataFrame, keys: list[str], last: str, known: DataFrame) -> DataFrame:
    """Ids from 1 to the latest of each book that aren't known: (keys, id)."""
    ids = latest.select(*keys, F.explode(F.sequence(F.lit(1), F.col(last))).alias("id"))
    return ids.join(known.select(*keys, "id"), [*keys, "id"], "left_anti")


def walk_ids(latest: DataFrame, keys: list[str], last: str, seen: DataFrame, most_misses: int) -> DataFrame:
    """(keys, id): ids from 1 to the last that are worth asking for: not known yet (seen: keys, id, found), and not after most_misses ids in a row that were asked for
    and not found. Runs of misses are islands of a running count of finds."""
    ids = latest.select(*keys, F.explode(F.sequence(F.lit(1), F.col(last))).alias("id"))
    j = ids.join(seen.select(*keys, "id", "found"), [*keys, "id"], "left")
    w = Window.partitionBy(*keys).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("island", F.sum(F.coalesce(F.col("found"), F.lit(True)).cast("int")).over(w))
    run = Window.partitionBy(*keys, "island").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("missed", F.sum((~F.coalesce(F.col("found"), F.lit(True))).cast("int")).over(run))
    stop = j.groupBy(*keys).agg(F.min(F.when(F.col("missed") >= most_misses, F.col("id"))).alias("stop_"))
    out = j.where("found is null").join(stop, keys, "left").where(F.col("stop_").isNull() | (F.col("id") < F.col("stop_")))
    return out.select(*keys, "id")


def first_titles(entries: DataFrame, keys: list[str], id_: str, order: str, suffix: str = r"\s*[（(]\d+/\d+[)）]\s*$") -> DataFrame:
    """(keys, id, title): of a chapter's links the first one's title, without the mark of a split page."""
    return entries.groupBy(*keys, id_).agg(F.regexp_replace(F.min_by("title", order), suffix, "").alias("title"))


def pages_in_order(parts: DataFrame, keys: list[str], page: str, place: str, window: int | None = None) -> DataFrame:
    """Entries of a table of contents in several pages, in page order whatever order they came in, with id 1, 2, ...; window: pages of that many entries, and none counts
    after the first that has fewer."""
    if window:
        short = parts.groupBy(*keys, page).agg(F.count("*").alias("n")).where(F.col("n") < window).groupBy(*keys).agg(F.min(page).alias("end_"))
        parts = parts.join(short, keys, "left").where(F.col("end_").isNull() | (F.col(page) <= F.col("end_"))).drop("end_")
    return parts.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy(page, place)))


def reversed_ids(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Entries of a list that has the latest first, with id 1, 2, ... from its end."""
    return entries.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())))


def last_by_number(entries: DataFrame, keys: list[str], link: str, order: str) -> DataFrame:
    """Of links with the same number in their last step the last one, sorted by number, with id 1, 2, ..."""
    number = F.regexp_extract(link, r"(\d+)(?:\.\w+)?/?$", 1).try_cast("long")
    kept = dedupe_links(entries.withColumn("number", number).where("number is not null"), keys, "number", order, first=False)
    return kept.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy("number")))


def last_page(pages: DataFrame, keys: list[str], link: str, pattern: str) -> DataFrame:
    """(keys, last): the greatest page number that a group's links name, 1 if none does."""
    return pages.groupBy(*keys).agg(F.coalesce(F.max(F.nullif(F.regexp_extract(link, pattern, 1), F.lit("")).cast("int")), F.lit(1)).alias("last"))


def labelled(lines: Column, label: str) -> Column:
    """What follows a label in the first line that starts with it."""
    return F.get(F.transform(F.filter(lines, lambda x: F.startswith(X.strip(x), F.lit(label))), lambda x: X.strip(F.substr(X.strip(x), F.lit(len(label) + 1)))), F.lit(0))


def hidden_rest(shown: Column, rest: Column) -> Column:
    """A body of which a page hides the rest as base64."""
    return F.concat(shown, F.coalesce(F.unbase64(rest).cast("string"), F.lit("")))
