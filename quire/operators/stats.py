"""Request statistics, logs, outliers and duplicates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.scratch import Tables

#: Counter of each kind of event.
COUNTERS = {"logical": "logical_calls", "attempt": "api_attempts", "technical_retry": "technical_retries", "fallback": "fallbacks", "cache_hit": "cache_hits"}


def request_statistics(events: DataFrame, keys: list[str]) -> DataFrame:
    """events (keys, event) -> counters for each combination of keys, and in all (null keys)."""
    return events.rollup(*keys).agg(*[F.count_if(F.col("event") == k).alias(name) for k, name in COUNTERS.items()])


def models_used(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.array_sort(F.collect_set("model")).alias("models"))


def budget_anomalies(stats: DataFrame, chapters: Column) -> DataFrame:
    """stats (translation_calls, repair_calls, logical_calls, api_attempts) with code and severity of what is out of bounds, the gravest first."""
    hard = F.col("logical_calls") >= F.greatest(F.lit(30), chapters * 15)
    attempts = F.col("api_attempts") >= F.greatest(F.lit(60), chapters * 30)
    repair = (F.col("translation_calls") > 0) & (F.col("repair_calls") > F.col("translation_calls"))
    warn = F.col("logical_calls") == F.greatest(F.lit(20), chapters * 10)
    code = F.when(hard | attempts | warn, "REQUEST_BUDGET_ANOMALY").when(repair, "REPAIR_VOLUME_ANOMALY")
    return stats.withColumns({"severity": F.when(hard | attempts, "fatal").when(warn, "warning").when(repair, "severe"), "code": code})


def last_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group by order."""
    return rows.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r_") <= n).drop("r_")


def short_bodies(chapters: DataFrame, keys: list[str], size: str, share: float = 0.3, least: int = 0) -> DataFrame:
    """Chapters far below their group's median size, or below least, with the median."""
    m = chapters.groupBy(*keys).agg(F.median(size).alias("median"))
    return chapters.join(m, keys).where((F.col(size) < F.col("median") * share) | (F.col(size) < least))


def recheck(flagged: DataFrame, again: DataFrame, keys: list[str], size: str, share: float = 0.3, least: int = 0) -> DataFrame:
    """flagged with again's size as new_size, and recovered: is it now long enough?"""
    out = flagged.join(again.select(*keys, F.col(size).alias("new_size")), keys, "left")
    return out.withColumn("recovered", F.coalesce((F.col("new_size") >= F.col("median") * share) & (F.col("new_size") >= least), F.lit(False)))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations of keys with more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_and_unexpected(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, kind): ids that only one side has."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    return a.exceptAll(b).withColumn("kind", F.lit("missing_id")).unionByName(b.exceptAll(a).withColumn("kind", F.lit("unexpected_id")))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("r_ = 1").drop("r_")


def retained(rows: DataFrame, order: Column, n: int, active: Column) -> DataFrame:
    """The n newest rows and all active ones."""
    newest = rows.where(~active).orderBy(order.desc()).limit(n)
    return newest.unionByName(rows.where(active))


def upper_median_ratio(rows: DataFrame, keys: list[str], ratio: str, least: int, share: float) -> DataFrame:
    """Groups' threshold: share of the upper median of their ratios, if they have at least `least`."""
    g = rows.groupBy(*keys).agg(F.count(ratio).alias("n"), F.expr(f"percentile_disc(0.500000000001) WITHIN GROUP (ORDER BY {ratio})").alias("upper_median"))
    return g.where(F.col("n") >= least).withColumn("threshold", F.col("upper_median") * share)


def _same(a: str, b: str, keys: list[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, tables: Tables) -> DataFrame:
    """rows with a number 0, 1, ... in each group by order (nulls first), so that no group's rows meet in one task: rows are dealt by ranges of keys and order, numbered in
    each range, and moved on by the numbers of the ranges before, which are a row for each range and group."""
    dealt = tables.write(rows.repartitionByRange(*keys, *order).withColumn("range_", F.spark_partition_id()))
    sizes = dealt.groupBy("range_", *keys).agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("range_", *keys, before.alias("before_")).alias("b")
    own = dealt.withColumn("own_", F.row_number().over(Window.partitionBy("range_", *keys).orderBy(*order)) - 1).alias("a")
    out = own.join(starts, _same("a", "b", ["range_", *keys]))
    return tables.write(out.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("own_") + F.col("before_")).cast("long").alias(name)))


def _running(events: DataFrame, keys: list[str], counts: list[str], block: int) -> DataFrame:
    """events (keys, wave, ask, counts) with counts summed over the rows of their keys in earlier waves: by blocks of waves, and over a row for each block before."""
    e = events.withColumn("block_", F.floor(F.col("wave") / block))
    totals = e.groupBy(*keys, "block_").agg(*[F.sum(c).alias(c) for c in counts])
    blocks = Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "block_", *[F.coalesce(F.sum(c).over(blocks), F.lit(0)).alias(f"{c}_") for c in counts]).alias("t")
    inside = Window.partitionBy(*keys, "block_").orderBy("wave").rangeBetween(Window.unboundedPreceding, -1)
    e = e.select(*[c for c in e.columns if c not in counts], *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in counts]).where("ask").alias("e")
    return e.join(totals, _same("e", "t", [*keys, "block_"])).select("e.*", *[(F.col(f"e.{c}") + F.col(f"t.{c}_")).alias(f"{c}__") for c in counts]).drop("block_", *counts).withColumnsRenamed({f"{c}__": c for c in counts})


def _descend(sums: DataFrame, counts: list[str], keys: list[str], fanout: int) -> DataFrame:
    """Each question in the bucket in which its rank lies, and the rank there."""
    upto = F.aggregate(F.array(*counts), F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))  # `fanout` sums
    s = sums.withColumn("upto_", upto)
    child = F.greatest(F.size(F.filter("upto_", lambda x: x <= F.col("left_"))) - 1, F.lit(0))
    s = s.withColumn("child_", F.least(child, F.lit(fanout - 1)).cast("long"))
    return s.select(*keys, "wave", (F.col("node_") * fanout + F.col("child_")).alias("node_"), (F.col("left_") - F.get("upto_", F.col("child_").cast("int"))).alias("left_"), "n_")


def wave_baselines(chapters: DataFrame, keys: list[str], order: str, ratio: str, width: int, fanout: int = 32, block: int = 4096) -> DataFrame:
    """chapters with n and upper_median of the ratios known before each one's wave: chapters go in waves of `width` in order, and a wave knows those before it.

    Every wave's median is found at once, by histograms. A group's ratios are ranked, and ranks are dealt into `fanout` buckets; counts by bucket, summed over the waves
    before, tell each wave the bucket in which its median lies and how many are below it, and that bucket is dealt anew until it holds one rank: a level for each
    factor of `fanout` that the largest group has. Sums go by blocks of `block` waves, so a task sees a wave's counts once and no group as a whole, whatever a group's share.

    Null ratios aren't counted; ties are ranked by order; a wave that knows none has n 0 and no median. Null keys are a group. Empty table: no rows.
    """
    tables = Tables(chapters.sparkSession, "waves")
    c = numbered(chapters.select(F.struct("*").alias("row_"), *keys, F.col(order).alias("order_"), F.col(ratio).alias("ratio_")), keys, ["order_"], "number_", tables).withColumn("wave", F.floor(F.col("number_") / width))
    known = numbered(c.where("ratio_ is not null").select(*keys, "order_", "ratio_", "wave"), keys, ["ratio_", "order_"], "rank_", tables)
    most = known.agg(F.max("rank_")).first()[0] or 0
    levels = 1
    while fanout**levels <= most:
        levels += 1
    counts = [f"c{k}_" for k in range(fanout)]
    ask = c.select(*keys, "wave").distinct().select(*keys, "wave", F.lit(0).cast("long").alias("node_"), F.lit(None).cast("long").alias("left_"), F.lit(None).cast("long").alias("n_"))
    for level in range(1, levels + 1):
        node, child = F.floor(F.col("rank_") / fanout ** (levels - level + 1)), F.floor(F.col("rank_") / fanout ** (levels - level)) % fanout
        histogram = known.select(*keys, "wave", node.alias("node_"), child.alias("child_")).groupBy(*keys, "wave", "node_").agg(*[F.count_if(F.col("child_") == k).alias(x) for k, x in enumerate(counts)])
        nothing = {"left_": F.lit(None).cast("long"), "n_": F.lit(None).cast("long"), "ask": F.lit(False)}
        events = histogram.withColumns(nothing).unionByName(ask.withColumns({x: F.lit(0).cast("long") for x in counts} | {"ask": F.lit(True)}))
        sums = _running(events, [*keys, "node_"], counts, block)
        if level == 1:
            sums = sums.withColumn("n_", sum((F.col(x) for x in counts[1:]), F.col(counts[0]))).withColumn("left_", F.floor(F.col("n_") / 2))
        ask = tables.write(_descend(sums, counts, keys, fanout))
    value = known.select(*keys, F.col("rank_").alias("node_"), "ratio_").alias("v")
    ask = ask.alias("q").join(value, _same("q", "v", [*keys, "node_"]) & (F.col("q.n_") > 0), "left").select("q.*", "v.ratio_").alias("q")
    out = c.alias("c").join(ask, _same("c", "q", [*keys, "wave"]))
    return out.select("c.row_.*", F.col("q.n_").cast("int").alias("n"), F.col("q.ratio_").alias("upper_median"))


def length_ratios(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio): how long translations (text) are by their sources (raw)."""
    return pairs.groupBy(*keys).agg((F.sum(F.length("text")) / F.greatest(F.lit(1), F.sum(F.length("raw")))).alias("ratio"))


def within_upload(files: DataFrame, keys: list[str], size: str, limit: int) -> DataFrame:
    """(keys, total, ok): may a request upload so much?"""
    return files.groupBy(*keys).agg(F.sum(size).alias("total")).withColumn("ok", F.col("total") <= limit)
