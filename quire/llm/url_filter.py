"""URL filter by a temporal join with dated block and allow lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.line_dedup import host_of

#: Path segments of a URL that entries may name, besides its host.
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?"


def keys_of(url: Column, depth: int) -> Column:
    """What an entry can name: the host and each parent domain, and the host with up to depth leading path segments.

    At most (labels of the host) + depth keys; a URL without a host has none.
    """
    host = host_of(url)
    labels = F.split(host, r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    path = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/", -1), lambda x: x != "")
    paths = F.transform(F.sequence(F.lit(0), F.least(F.lit(depth), F.size(path))), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, k), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (key, verdict, since): key string, verdict 'block', 'allow' or 'remove', since timestamp ->
    (key, verdict, since, until): what holds for a key from since until before until (null: for ever).

    The last of a key's entries decides; of several at one time the greatest by code point (so 'remove' ends what was added then). Removals
    leave no interval. Entries with a null key or time are void.
    """
    e = entries.where("key is not null and since is not null").groupBy("key", "since").agg(F.max("verdict").alias("verdict"))
    e = e.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since")))
    return e.where("verdict in ('block', 'allow')").select("key", "verdict", "since", "until")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per capture: capture_id, capture_url, fetched_at, n_active (entries active for it then), matched (the key that
    decides, or null), keep.

    Paths are compared to the depth of the list's longest one (one max over it). Every key of a capture is joined as of its fetch time with that key's interval (since <= fetched_at < until). The longest
    key decides (a tie: the greater by code point), block: it is not kept. Without an active entry it is kept. Distinct (key, time)
    would not help against a hot host, so the list is broadcast if counting it shows at most broadcast_rows intervals; otherwise
    both sides are shuffled on the key, and Spark splits a hot key's captures, as the list has few rows for a key.

    Null url, no host, or null time: no entry is active, and it is kept. Captures with the same id, url and time give as many
    equal rows. Empty tables are fine. Other columns aren't read.
    """
    c = captures.select(F.col(id_col).alias("capture_id"), F.col(url_col).alias("capture_url"), F.col(time_col).alias("fetched_at"))
    held = intervals(entries)
    depth = entries.select(F.max(F.size(F.split("key", "/", -1)) - 1)).first()[0] or 0
    if held.limit(broadcast_rows + 1).count() <= broadcast_rows:
        held = F.broadcast(held)
    spread = c.groupBy("capture_id", "capture_url", "fetched_at").agg(F.count("*").alias("same"))
    keyed = spread.select("*", F.explode_outer(keys_of(F.col("capture_url"), depth)).alias("k"))
    hit = keyed.join(held, (F.col("k") == F.col("key")) & (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))), "left")
    best = F.max(F.when(F.col("key").isNotNull(), F.struct(F.length("key").alias("n"), F.col("key"), F.col("verdict"))))
    out = hit.groupBy("capture_id", "capture_url", "fetched_at", "same").agg(F.count("key").alias("n_active"), best.alias("best"))
    return out.select("capture_id", "capture_url", "fetched_at", "n_active", F.col("best.key").alias("matched"), F.coalesce(F.col("best.verdict") != "block", F.lit(True)).alias("keep"), F.explode(F.expr("sequence(1L, same)")).alias("_")).drop("_")
