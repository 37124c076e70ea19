"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Workspace
from quire.llm.components import block_pairs, connected_components, groups


def plan(n: int, threshold: float, miss: float = 0.005, bucket: int = 64) -> tuple[int, int]:
    """Sign bits of a table's key, and number of tables, for n vectors.

    Bits grow by one for each doubling of n, so that a table's bucket stays near `bucket` unrelated vectors; tables, so that two vectors at
    the threshold, which agree on a sign with p = 1 - acos(threshold) / pi, share no bucket with a probability of at most miss.
    """
    bits = min(62, max(4, math.ceil(math.log2(max(2, n) / bucket))))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-p)) if p < 1 else 1


#: Signs of the sketch by which a bucket's members are told apart before their vectors are fetched, and how many standard deviations a pair at the
#: threshold may be beyond the mean of its differing signs: 3e-7 of such pairs are.
SKETCH, DEVIATIONS = 256, 5.0


def within(threshold: float) -> float:
    """Most differing signs of a sketch that two vectors of the cosine have."""
    p = math.acos(threshold) / math.pi
    return SKETCH * p + DEVIATIONS * math.sqrt(SKETCH * p * (1 - p))


def _near(group: pd.DataFrame, most: float) -> pd.DataFrame:
    """Of one block pair: the members that have another in reach by their sketches."""
    x = np.frombuffer(b"".join(group["sketch"]), np.uint64).reshape(len(group), -1)
    side = group["side"].to_numpy() if group["bi"].iloc[0] != group["bj"].iloc[0] else None
    keep = np.zeros(len(group), bool)
    for at in range(0, len(x), 128):
        near = np.bitwise_count(x[at : at + 128, None, :] ^ x[None, :, :]).sum(axis=2, dtype=np.int64) <= most
        near[np.arange(near.shape[0]), at + np.arange(near.shape[0])] = False
        if side is not None:
            near &= side[at : at + 128, None] != side[None, :]
        keep |= near.any(axis=0)
        keep[at : at + 128] |= near.any(axis=1)
    return group[keep]


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled by their greatest component first, as squares of very large or small ones would be lost."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _links(group: pd.DataFrame, threshold: float, kind: str) -> pd.DataFrame:
    """Of one block pair: each member's linked weight in pairs that no earlier table has, and the least member its links reach."""
    t = int(group["t"].iloc[0])
    dims = group["x"].map(len).to_numpy()
    parts = []
    for dim in np.unique(dims):
        g = group[dims == dim]
        x = directions(np.frombuffer(b"".join(g["x"]), kind).reshape(len(g), -1))
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if group["bi"].iloc[0] != group["bj"].iloc[0]:
            side = g["side"].to_numpy()
            near &= side[:, None] != side[None, :]
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            continue
        near = near[np.ix_(some, some)]
        keys = np.frombuffer(b"".join(g["keys"].iloc[some]), np.int64).reshape(len(some), -1)
        own = near.copy()
        for e in range(t):
            own &= keys[:, None, e] != keys[None, :, e]
        cid, w = g["cid"].to_numpy()[some], g["w"].to_numpy()[some]
        label = cid.copy()
        while True:
            new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (new == label).all():
                break
            label = new
        parts.append(pd.DataFrame({"cid": cid, "links": own @ w, "root": label}))
    return pd.concat(parts) if parts else pd.DataFrame({"cid": [], "links": [], "root": []}, dtype=np.int64)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = 1024, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept.

    Equal vectors are one class with a weight and link to each other, so copies are never paired. Of classes that share the signs of
    a table's hyperplanes, first only sketches of SKETCH other signs meet, and who has no other in reach of the threshold by these is left out of the bucket. The rest are
    compared by exact cosine in double precision; a pair counts in the first table that has it. A large
    bucket is cut into blocks, and each pair of blocks is a task. A task gives sums and each member's least reach, never pairs, and
    components are found from those in rounds. Vectors are shuffled for buckets in which they have a likely partner only.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing: n_links 0, own id as component.
    Vectors of different lengths don't link. Null ids count as vectors, but not for the smallest id (kept: the ids are both null or equal).
    Repeated rows are copies of each other. Empty table: no rows. Other columns aren't read.
    """
    space = Workspace(vectors.sparkSession)
    e = F.col("e")
    good = e.isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, number = ("<f4", "float") if single else ("<f8", "double")  # floats stay as they are, everything else is compared as doubles
    v = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).cast(f"array<{number}>").alias("e"))
    v = v.select("i", "e", F.coalesce(good, F.lit(False)).alias("good"))
    v = v.select("i", "e", "good", F.xxhash64("e").alias("h1"), F.xxhash64(F.reverse("e"), F.lit(1)).alias("h2"))
    c = v.where("good").groupBy("h1", "h2").agg(F.first("e").alias("e"), F.min("i").alias("doc"), F.count("*").alias("w"))
    c = space.write(c.withColumn("cid", F.monotonically_increasing_id()), "classes")
    bits, tables = plan(c.count(), threshold)

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        power = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            out = []
            for cid, w, vector in zip(batch["cid"], batch["w"], batch["e"], strict=True):
                x = np.asarray(vector, kind)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((len(x), bits * tables + SKETCH))
                sign = directions(x[None])[0] @ planes[len(x)] > 0
                keys = (sign[: bits * tables].reshape(tables, bits) * power).sum(axis=1)
                out.append((cid, w, x.tobytes(), keys, keys.astype("<i8").tobytes(), np.packbits(sign[bits * tables :]).tobytes()))
            yield pd.DataFrame(out, columns=["cid", "w", "x", "k", "keys", "sketch"])

    s = space.write(c.select("cid", "w", "e").mapInPandas(signs, "cid long, w long, x binary, k array<long>, keys binary, sketch binary"), "signs")
    order = ["t", "key", "bi", "bj"]
    arranged = lambda d: d.repartition(*order).sortWithinPartitions(*order)
    dealt = block_pairs(s.select("cid", F.posexplode("k").alias("t", "key")), ["t", "key"], "cid", block)
    most = within(threshold)

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups(batches, order):
            if len(found := _near(group, most)):
                yield found[[*order, "side", "cid"]]

    near = arranged(dealt.join(s.select("cid", "sketch"), "cid")).mapInPandas(sift, "t int, key long, bi int, bj int, side int, cid long")
    rows = arranged(near.join(s.select("cid", "w", "x", "keys"), "cid"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups(batches, order):
            found = _links(group, threshold, kind)
            if len(found):
                yield found

    found = space.write(rows.mapInPandas(compare, "cid long, links long, root long").groupBy("cid", "root").agg(F.sum("links").alias("links")), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    reach = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), space, "components")
    c = c.join(links, "cid", "left").join(reach, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    c = c.select("h1", "h2", "w", "doc", "component", F.coalesce("links", F.lit(0)).alias("links"))
    least = c.groupBy("component").agg(F.min("doc").alias("component_id"))
    c = space.write(c.join(least, "component").select("h1", "h2", (F.col("links") + F.col("w") - 1).alias("links"), "component_id"), "found")
    out = v.select("i", "good", "h1", "h2").alias("v").join(c.alias("c"), (F.col("v.h1") == F.col("c.h1")) & (F.col("v.h2") == F.col("c.h2")) & F.col("good"), "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("i"))
    return out.select(F.col("i").alias("vec_id"), F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("i").eqNullSafe(component).alias("kept"))
