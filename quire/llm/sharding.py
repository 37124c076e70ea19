"""Sharding by vector bin packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Workspace, word_count


#: Parts of a group's rows for each whole of all bytes or rows: a part has about a thousandth of all.
PARTS = 1024
#: What bytes, tokens and rows count in the dot product: the law is on bytes.
WEIGHTS = (16.0, 1.0, 1.0)


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector (bytes, tokens, rows), largest first, where its weighted dot product with the residual capacity is highest.

    Capacities are equal shares of the totals; a tie goes to the lowest shard. A shard without room in a dimension counts
    with what it lacks, so a fuller one is not chosen before an emptier one.
    """
    total = vectors.sum(axis=0)
    scaled = vectors / np.where(total > 0, total, 1) * shards
    left, weights = np.ones((shards, vectors.shape[1])), np.array(WEIGHTS)
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -scaled.sum(axis=1))):
        out[i] = k = int(np.argmax(left @ (scaled[i] * weights)))
        left[k] -= scaled[i]
    return out


def shard(documents: DataFrame, shards: int = 8, bundles: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into a shard, balancing bytes, tokens and rows jointly (law `bytes`: sizes near equal).

    A group is all rows of an equal text. Groups with more than 1 / bundles of all bytes or rows are placed each by itself (at most 2 * bundles); the tail of lighter
    ones is bundled by text hash first, so that the sequential placing sees a fixed number of vectors, whatever the input: 3 * bundles + 2 * PARTS and a few.
    A group goes to one shard whole, unless it has more bytes or rows than a shard's equal share: such a group, of which there are at most 2 * shards, is dealt in parts, since
    a third of the rows can't be one shard's eighth, and all shards are to be balanced in bytes and rows.

    Rows of a group above 1 / PARTS of all are dealt into parts of about that size by their place in the written table, so neither one text, nor one id, nor null ids make
    a large part. Slots number a shard's rows from 0: each part's first slot is the sum of those before it, so rows are sorted by part, never by shard or
    large group.

    Null text: size 1 (no bytes, plus 1), CRC of nothing, one group of its own. Null ids are allowed; repeated rows are
    rows like any other. Empty table: no rows. Only the id and text columns are read, so other columns can't clash.
    """
    spark = documents.sparkSession
    space = Workspace(spark)
    text = F.col("t")
    rows = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).select(
        "i",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        word_count("t").alias("tokens"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("crc"),
        F.xxhash64(text, F.length(text)).alias("h"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = space.write(rows, "rows")  # from here a row's place is fixed
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    size, n = max(1, total["size"] or 0), max(1, total["n"])
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    most = F.greatest(F.col("bytes") / F.lit(size), F.col("n") / F.lit(n))
    # At most 2 * bundles rows, by what a share is.
    own = groups.where(most > 1 / bundles).select("h", F.ceil(most * F.lit(float(PARTS))).cast("int").alias("parts"), (most > 1 / shards).alias("heavy"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("place"), F.col("parts"))).otherwise(0)
    rows = rows.join(F.broadcast(own), "h", "left").withColumns(
        {"bundle": F.when(F.col("parts").isNull(), F.pmod("h", F.lit(bundles)).cast("string")).otherwise(F.concat(F.lit("g"), F.col("h").cast("string"))), "part": part.cast("int")}
    )
    # One row for each bundle, group and part: bounded as said above.
    sums = rows.groupBy("bundle", "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.coalesce(F.first("heavy"), F.lit(False)).alias("heavy")).toPandas()
    sums = sums.sort_values(["bundle", "part"], ignore_index=True)
    sums["unit"] = sums["bundle"] + ":" + sums["part"].where(sums["heavy"], 0).astype(str)
    units = sums.groupby("unit", sort=True)[["bytes", "tokens", "n"]].sum()
    sums["shard"] = sums["unit"].map(dict(zip(units.index, place(units.to_numpy(float), shards), strict=True))) if len(sums) else np.zeros(0, np.int64)
    sums["first"] = sums.groupby("shard")["n"].cumsum() - sums["n"]
    placed = spark.createDataFrame([(str(b), int(p), int(s), int(f)) for b, p, s, f in sums[["bundle", "part", "shard", "first"]].itertuples(index=False)], "bundle string, part int, shard int, first long")
    order = Window.partitionBy("bundle", "part").orderBy("i", "place")
    return (
        rows.join(F.broadcast(placed), ["bundle", "part"])
        .withColumn("slot", F.col("first") + F.row_number().over(order) - 1)
        .select(F.col("i").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
