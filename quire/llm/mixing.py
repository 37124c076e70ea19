"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Workspace, word_count

#: Hash bits, and bits of a bucket at each level of the histogram.
BITS, STEP = 60, 10


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat: int = 3) -> DataFrame:
    """totals (source, source_size), one row each -> with target double.

    Weights go to sources by code point, null last, repeating. Sharing the excess of capped sources by weight until none is
    above its cap ends where each source has min(repeat * size, weight * level), so the level is found from running sums over
    the sources sorted by cap / weight. The windows here see one row for each source, never documents.
    """
    every = Window.partitionBy()
    t = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("long"))
    t = t.withColumn("cap", F.col("source_size") * repeat)
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    # A source is capped if its cap is at most its part of what the sources before it in this order leave.
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  (words of all sources times weights of all sources may pass 64 bits)
    t = t.withColumn("capped", wide("cap") * wide("w_left") <= wide("left") * wide("w"))
    t = t.withColumns({
        "free": F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)),
        "free_w": F.sum(F.when(~F.col("capped"), F.col("w"))).over(every),
    })
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("free").cast("double") / F.col("free_w")))
    return t.select("source", "source_size", target.alias("target"))


def words_and_hash(documents: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """documents with size, source_ (the source) and h (60 bits of a hash of id and text; null: of the empty text)."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")
    return documents.withColumns({"size": word_count(text_col), "source_": F.col(source_col), "h": F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")})


def limits(d: DataFrame, space: Workspace, weights: tuple[int, ...] = (1, 2, 3), repeat: int = 3) -> DataFrame:
    """d (source_, size, h) -> one row for each source: source_, source_size, target, times, below. A document is taken
    times + (h < below) times."""
    d = d.withColumn("b", F.shiftright("h", BITS - STEP))
    first = space.write(d.groupBy("source_", "b").agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi")), "level0")
    goal = targets(first.groupBy(F.col("source_").alias("source")).agg(F.sum("words").alias("source_size")), weights, repeat).withColumnRenamed("source", "source_")
    goal = goal.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = space.write(goal.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")), "goal")

    def boundary(histogram: DataFrame) -> DataFrame:
        """The bucket of each source in which its rest runs out, and what is left of the rest there."""
        w = Window.partitionBy("source_").orderBy("b")
        h = histogram.withColumn("to", F.sum("words").over(w))
        h = h.withColumn("from", F.col("to") - F.col("words"))
        h = h.where((F.col("from") < F.col("rest")) & (F.col("to") >= F.col("rest")) & (F.col("words") > 0))
        return h.select("source_", "b", "lo", "hi", "words", (F.col("rest") - F.col("from")).alias("left"))

    same = lambda x: F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}"))
    edge = space.write(boundary(first.alias("a").join(goal.alias("b"), same("source_")).select("a.*", "rest")), "edge0")
    found, rows = [], d
    for level in range(1, BITS // STEP + 1):
        done = F.col("lo") == F.col("hi")
        # A single hash is left: it is taken if that comes nearer to the target than leaving it.
        found.append(edge.where(done).select("source_", F.when(F.col("words") - F.col("left") <= F.col("left"), F.col("hi") + 1).otherwise(F.col("lo")).alias("below")))
        left = edge.where(~done)
        if level == BITS // STEP or left.isEmpty():
            break
        rows = rows.alias("a").join(left.alias("b"), same("source_") & same("b")).select("a.source_", "a.size", "a.h", F.shiftright("a.h", BITS - STEP * (level + 1)).alias("b"), F.col("b.left").alias("rest"))
        rows = space.write(rows, f"rows{level}")
        edge = space.write(boundary(rows.groupBy("source_", "b", "rest").agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))), f"edge{level}")
    limit = found[0]
    for x in found[1:]:
        limit = limit.unionByName(x)
    # No rest: no threshold, and nothing is below 0.
    out = goal.alias("a").join(limit.alias("b"), same("source_"), "left").select("a.source_", "source_size", "target", "times", F.coalesce("below", F.lit(0)).alias("below"))
    return space.write(out, "limits")


def mix(documents: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target (of its source), copies, taken (size * copies).

    A source of size S and target T takes every document floor(T / S) times, and once more those below a threshold of the
    document's 60-bit hash, chosen so that the words come nearest to T (a tie: the larger threshold). The threshold is found
    from histograms of words by source and hash bucket: whole buckets fit or don't, and only the bucket in which the rest runs
    out is refined, by the next 10 bits, until it holds one hash; documents are then filtered by their hash, never sorted.
    Refining joins on source and bucket, so a source with a third of all rows is spread over 1024 keys; documents meet one row for
    each source, which Spark broadcasts if its written size is below the session's limit, and splits a hot source's rows otherwise.

    The hash is of id and text, so reruns agree, and the share at a smaller target is part of that at a larger one. Rows of a source with the
    same id (or null ids) and the same text share a fate, which is to be within half of their words of the target where they are many. Null text: size 0. Null source: a source of its own, last in the order.
    Empty documents are taken with 0 words. Empty table: no rows. Other columns are not read.
    """
    space = Workspace(documents.sparkSession)
    d = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(source_col).alias("s"))
    d = space.write(words_and_hash(d, seed, "i", "t", "s").select("i", "source_", "size", "h"), "sizes")
    out = d.alias("a").join(limits(d, space, weights, repeat).alias("b"), F.col("a.source_").eqNullSafe(F.col("b.source_")))
    copies = (F.col("times") + (F.col("h") < F.col("below")).cast("long")).alias("copies")
    return out.select(F.col("i").alias("doc_id"), "size", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def take(documents: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of documents, each as often as mix() takes it. Cases are as there; a row's other columns go with it."""
    space = Workspace(documents.sparkSession)
    d = documents.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(source_col).alias("s"))
    small = space.write(words_and_hash(d.select("i", "t", "s"), seed, "i", "t", "s").select("source_", "size", "h"), "sizes")
    table = limits(small, space, weights, repeat)
    out = words_and_hash(d, seed, "i", "t", "s").alias("a").join(table.alias("b"), F.col("a.source_").eqNullSafe(F.col("b.source_")))
    copies = F.col("times") + (F.col("h") < F.col("below")).cast("long")
    out = out.where(copies > 0).select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_"))
    return out.select("row.*")
