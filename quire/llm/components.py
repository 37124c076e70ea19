"""Distributed connected components, and the splitting of large groups into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Workspace


#: Parts into which the rows of each key are dealt where something about the whole key is joined to them.
PARTS = 64


def with_totals(members: DataFrame, keys: list[str], member: str, having: str, **totals: tuple[str, str]) -> DataFrame:
    """members with totals of their keys' groups, name=(count, min or max; column), of groups for which `having` is true.

    A group's rows are dealt by a hash of member into parts, summed by part and then by key, and its totals go to each of its parts; so no key's rows meet in one task,
    however many they are.
    """
    first = {"count": lambda c: F.count("*"), "min": F.min, "max": F.max}
    then = {"count": F.sum, "min": F.min, "max": F.max}
    dealt = members.withColumn("s_", F.pmod(F.xxhash64(F.col(member), F.lit(5)), F.lit(PARTS)).cast("int"))
    parts = dealt.groupBy(*keys, "s_").agg(*[first[how](c).alias(n) for n, (how, c) in totals.items()])
    whole = parts.groupBy(*keys).agg(*[then[how](n).alias(n) for n, (how, _) in totals.items()], F.collect_list("s_").alias("s_")).where(having)
    return dealt.join(whole.select(*keys, *totals, F.explode("s_").alias("s_")), [*keys, "s_"]).drop("s_")


def absorb(known: DataFrame | None, links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """known (node, component) and new links (a, b) -> (node, component) of both: links are taken between the components known so far, and only those that join two
    are followed."""
    if known is None:
        return space.write(connected_components(links, space, name), f"{name}-reach")
    side = lambda x: known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = space.write(between.where("a <> b").distinct(), f"{name}-between")
    if between.isEmpty():
        return known
    up = connected_components(between, space, name)
    moved = known.join(up.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return space.write(moved.unionByName(up.join(known, "node", "left_anti")), f"{name}-reach")


def connected_components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """edges (a, b), longs -> (node, component): the smallest node reachable, for each node that has a link to another.

    Alternating large-star and small-star rounds: links go from the larger to the smaller end, each round at most as many as the
    one before, in O(log n) rounds in practice. Each round is written to the shared folder; the driver sees a count and a sum.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = space.write(e, f"{name}-0")
    was, k = state(e), 0
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = with_totals(both, ["u"], "v", "true", m=("min", "v"))  # a star's hub may have a third of all links
        large = near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = space.write(small.select("x.u", "x.v").where("u <> v").distinct(), f"{name}-{k + 1}")
        now = state(e)
        space.drop(f"{name}-{k}")
        k += 1
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def block_pairs(members: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """members with columns bi, bj, side: groups by keys of more than block members are dealt by a hash of member to blocks, and each
    pair of blocks is one task's work; a group of up to block members is block pair (0, 0), and one of a single member is left out.

    So no task gets more than about 2 * block members, whatever a group's size, and each pair of members meets exactly once (side:
    0 or 1, for the first or second block; pairs in one block meet where bi = bj).
    """
    m = with_totals(members, keys, member, "n_ > 1", n_=("count", member)).withColumn("g_", F.ceil(F.col("n_") / F.lit(block)).cast("int"))
    m = m.withColumn("b_", F.pmod(F.xxhash64(member, F.lit(11)), F.col("g_")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("g_") - 1), lambda o: F.struct(F.least("b_", o).alias("bi"), F.greatest("b_", o).alias("bj"), (F.col("b_") > o).cast("int").alias("side")))
    return m.select("*", F.explode(other).alias("x_")).select(*members.columns, "x_.bi", "x_.bj", "x_.side")


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a stream sorted by keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy(np.int64)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held and tuple(held[-1][keys].iloc[-1]) == tuple(k[0]):
            if not len(cut):
                held.append(batch)
                continue
            yield pd.concat([*held, batch.iloc[: cut[0]]], ignore_index=True)
            cut, start = cut[1:], cut[0]
        else:
            if held:
                yield pd.concat(held, ignore_index=True)
            start = 0
        for c in cut:
            yield batch.iloc[start:c]
            start = c
        held = [batch.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)
