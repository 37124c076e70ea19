"""Filter interaction audit: what each of several filters removes, keeps and duplicates in every order in which they can be applied."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WORD, Workspace
from quire.llm.components import with_totals

LETTERS = "ABCDE"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def failures(documents: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(i, part, mask), a row per document: its id, its part (a null one: the empty string) and the filters that it fails, A to E as bits 1, 2, 4, 8, 16.

    A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * capitals A-Z > 5 * code points; D: a character of #$%&*|; E: the text of a row with a smaller
    id, removed or not. Each whole text is read once and written as its first four bits and 128 bits of hash; what rows with one text have in common, their smallest id,
    reaches them by parts, so a text that a third of all rows share meets in no task.

    Null text: the empty text, of which the others are copies. A null id is smaller than none and none is smaller than it. Rows that share an id and a text don't fail E
    for each other. Texts of any length are whole. Other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = documents.select(F.col(id_col).alias("i"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    d = d.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    words, capitals = F.size("w"), F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [words < 50, F.size(F.array_distinct("w")) * F.lit(100) < words * 65, capitals * F.lit(100) > F.length("t") * 5, F.col("t").rlike(r"[#$%&*|]")]
    bits = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails[1:], 1)), fails[0].cast("int"))
    rows = space.write(d.select("i", "part", bits.alias("mask"), F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(13), "t").alias("h2")), "rows")
    rows = with_totals(rows, ["h1", "h2"], "i", "true", least=("min", "i"))
    return rows.select("i", "part", (F.col("mask") + F.when(F.col("least") < F.col("i"), 1 << 4).otherwise(0)).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, cells): for each part an array of at most 32 cells (mask, n, good, toxic): rows with exactly these failures, and how many of them are labelled.

    A row is labelled if any row of labels with its id has a 1; a null id has no label.
    """
    known = labels.groupBy(F.col(id_col).alias("i")).agg(F.max(F.col("quality").eqNullSafe(1).cast("int")).alias("good"), F.max(F.col("toxic").eqNullSafe(1).cast("int")).alias("toxic")).where("i is not null")
    c = rows.join(known, "i", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return c.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))


def _total(field: str, which: str) -> str:
    return f"aggregate(filter(c.cells, x -> {which}), 0L, (a, x) -> a + x.{field})"


@contextlib.contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    """Spark ends a recursion at a million rows by default, which the prefixes of 3,000 parts have."""
    was = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.unset(ROW_LIMIT) if was is None else spark.conf.set(ROW_LIMIT, was)


def enumerate_orders(table: DataFrame, space: Workspace, letters: str = LETTERS) -> DataFrame:
    """table (part, cells) -> (part, filter_order, step, and the counts), for every part a row for each order of the letters and each of its steps.

    A recursive CTE: a level puts each letter that a prefix doesn't have yet behind it, joins the part's mask cells, carries the bits applied so far, and emits the
    metrics of that step: what passes all bits (kept), what fails the new bit and passed the old ones (removed), what fails the new bit but was gone (redundant).
    A prefix is computed once, whatever orders begin with it (325 for five letters); the orders then take their prefixes' rows. The number of rows follows from the
    letters and parts alone, and all joins are by part.
    """
    spark = table.sparkSession
    listed = ", ".join(f"array({1 << k}, {k})" for k in range(len(letters)))
    gone = "x.mask & bit <> 0 AND x.mask & applied = 0"
    sql = f"""
WITH RECURSIVE r(part, prefix, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{table}}
  UNION ALL
  SELECT part, concat(prefix, substring('{letters}', place + 1, 1)), applied | bit, step + 1,
    {_total("n", "x.mask & (applied | bit) = 0")}, {_total("n", gone)},
    {_total("n", "x.mask & bit <> 0 AND x.mask & applied <> 0")}, {_total("n", "x.mask = bit")},
    {_total("good", gone)}, {_total("toxic", gone)}
  FROM (SELECT r.*, l.pair[0] AS bit, l.pair[1] AS place FROM r LATERAL VIEW explode(filter(array({listed}), p -> p[0] & r.applied = 0)) l AS pair) y
  JOIN {{table}} c USING (part)
) SELECT * FROM r WHERE step > 0"""
    with _unlimited(spark):
        steps = space.write(spark.sql(sql, table=table), "steps")
    n = len(letters)
    last = steps.withColumn("letter", F.substring("prefix", -1, 1))
    # A prefix of k letters begins (n - k)! orders, in each of which its last filter removes the same.
    begun = F.element_at(F.array(*[F.lit(factorial(n - k)) for k in range(1, n + 1)]), F.col("step")).cast("long")
    shapley = last.groupBy("part", "letter").agg(F.sum(F.col("removed") * begun).alias("shapley"))
    orders = steps.where(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    orders = orders.withColumn("prefix", F.substring(F.col("filter_order"), F.lit(1), F.col("step")))
    out = orders.join(last.drop("applied", "step").join(shapley, ["part", "letter"]), ["part", "prefix"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part that documents have, zeros included.

    Cases as in failures() and cells(). Repeated rows count each. An empty table has no part, and so no rows; without labels nothing is good or toxic.
    """
    space = Workspace(documents.sparkSession)
    table = space.write(cells(failures(documents, space, id_col, text_col, part_col), labels, id_col), "cells")
    return enumerate_orders(table, space)
