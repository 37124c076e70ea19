"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Workspace, mix, release, shingle_set, text_batches
from quire.llm.components import absorb, block_pairs, groups, with_totals

#: A signature: CHUNKS of SYMBOLS each, of 16 bits. ERRORS symbols of a chunk may differ.
CHUNKS, SYMBOLS, ERRORS = 10, 5, 1
LENGTH = CHUNKS * SYMBOLS
#: By the pigeonhole principle, signatures that differ in at most so many symbols have a chunk with at most ERRORS differing.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Bins of a sketch; sets of at most SMALL shingles are compared by a bound that loses no pair, others by the share of agreeing bins,
#: which may be so many standard deviations below the similarity.
BINS, SMALL, DEVIATIONS = 512, 64, 5.0
_RNG = np.random.default_rng(75)
_A = _RNG.integers(1, 2**63, LENGTH, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(1, 2**63, LENGTH, dtype=np.uint64)
_K = _RNG.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of each of LENGTH minima over differently hashed shingles."""
    least = np.full(LENGTH, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        part = shingles[None, at : at + 4096] * _A[:, None] + _B[:, None]
        least = np.minimum(least, part.min(axis=1))
    return mix(least).astype(np.uint16)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One-permutation sketch: a byte of the least hash of each bin, 0 for an empty one."""
    out = np.zeros(BINS, np.uint8)
    h = np.sort(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    at, first = np.unique(h >> np.uint64(55), return_index=True)
    out[at.astype(np.int64)] = (h[first] % np.uint64(255)).astype(np.uint8) + 1
    return out


def reach(percent: int) -> float:
    """Least share of agreeing bins of two large sets of the similarity."""
    share = percent / 100
    return share - DEVIATIONS * (share * (1 - share) / BINS) ** 0.5


def hidden(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of n shingles aren't the least of their bin, of rows of sketches."""
    return n - (x > 0).sum(axis=-1)


def may_link(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets of nx and ny shingles with these sketches may have the similarity, of rows; and their likeness.

    In a bin that agrees all common shingles but one are hidden in both sets; in one that doesn't, all of them are hidden in the set
    whose least isn't common. So the agreeing bins and the hidden shingles of both sets are at least as many as the common ones,
    and of sets of at most SMALL shingles no pair is lost.
    """
    agree = ((x == y) & (x > 0)).sum(axis=-1)
    share = agree / np.maximum(1, ((x | y) > 0).sum(axis=-1))
    common = np.minimum(np.minimum(nx, ny), agree + hidden(x, nx) + hidden(y, ny))
    bound = 100 * common >= percent * (nx + ny - common)
    return np.where(np.maximum(nx, ny) <= SMALL, bound, share >= reach(percent)), share


def keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature and chunk, a 64-bit key of every choice of symbols that may agree when ERRORS = 1 of them doesn't.

    With one symbol left out, a key covers both a chunk without an error and one with an error in that symbol.
    """
    chunk = signatures.reshape(len(signatures), CHUNKS, SYMBOLS).astype(np.uint64) + np.uint64(1)
    terms = mix(chunk * _K + np.arange(CHUNKS, dtype=np.uint64)[None, :, None] * np.uint64(1 << 20))
    return mix(terms.sum(axis=2, dtype=np.uint64)[:, :, None] - terms + np.arange(SYMBOLS, dtype=np.uint64)).reshape(len(signatures), -1)


def first_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Place in keys() of the first key that two signatures share, of rows of signatures that share one."""
    agree = (x == y).reshape(len(x), CHUNKS, SYMBOLS)
    chunk = (agree.sum(axis=2) >= SYMBOLS - ERRORS).argmax(axis=1) if len(x) else np.zeros(0, int)
    return chunk * SYMBOLS + agree[np.arange(len(x)), chunk].argmin(axis=1)


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    if not len(a) or not len(b):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def near_duplicates(documents: DataFrame, percent: int = 75, width: int = 5, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept.

    Equal shingle sets are one class. Two classes are candidates if their signatures agree on a chunk of symbols but for one: that
    holds for every pair of signatures in at most DISTANCE of LENGTH places, and misses a pair of similarity 0.75 with a probability
    of 4e-5. Candidates whose set sizes and sketches allow the similarity are confirmed on full sets: with sets of at most SMALL
    shingles that is every pair of the similarity; of larger ones a sketch loses a pair of exactly the similarity with the probability
    of DEVIATIONS standard deviations, which the README gives.

    Of a key's classes, all are first compared with the least, and components of the links found settle most of a group of near
    copies with as many comparisons as members. Of keys whose classes are then in several components, each class outside the largest
    is compared with the one most like it by sketch in another component, then with four of them; so the
    components grow together wherever they are linked, again with as many comparisons as members. At last all pairs that are still
    across components are compared by sketch, and those in reach on full sets. So of the candidates in reach none is lost that could
    join two components (what isn't a candidate or in reach is: see above), and pairs within a component are never listed. A large group is cut into blocks,
    each pair of blocks is a task, and what is known of a whole key reaches its members by parts, so no key meets in one task. Components are kept from
    step to step, and a step only follows the links that join two of them. Texts are fetched once, for the classes that share a key with another.

    Null text or none: n_shingles 0, linked with nothing, own id as component. Null ids take part but are no smallest id (kept:
    both null or equal). Repeated rows are equal sets. Empty table: no rows. Other columns aren't read.
    """
    spark = documents.sparkSession
    space = Workspace(spark)
    text_batches(spark)
    d = documents.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).withColumn("th", F.xxhash64("t", F.length("t")))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, th, text in zip(batch["i"].tolist(), batch["th"].tolist(), batch["t"], strict=True):
                s = shingle_set(text, width)
                some = len(s) > 0
                out.append((None if pd.isna(i) else int(i), th, len(s), blake2b(s.tobytes(), digest_size=16).digest() if some else None, signature(s).tobytes() if some else None, sketch(s).tobytes() if some else None))
            yield pd.DataFrame(out, columns=["i", "th", "n", "set", "sig", "sketch"]).astype({"i": "Int64"})

    rows = space.write(d.mapInPandas(digest, "i long, th long, n long, set binary, sig binary, sketch binary"), "rows")
    c = rows.where("set is not null").groupBy("set").agg(F.min("i").alias("doc"), F.min(F.struct("i", "th")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    c = space.write(c.withColumn("cid", F.monotonically_increasing_id()).select("cid", "set", "doc", F.col("rep.i").alias("i"), F.col("rep.th").alias("th"), "n", "sig", "sketch"), "classes")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                k = keys(np.frombuffer(b"".join(batch["sig"]), np.uint16).reshape(len(batch), LENGTH)).view(np.int64)
                yield pd.DataFrame({"cid": batch["cid"], "k": list(k)})

    k = c.select("cid", "sig").mapInPandas(spread, "cid long, k array<long>").select("cid", F.posexplode("k").alias("p", "k"))
    shared = space.write(with_totals(k, ["k"], "cid", "hub < top", hub=("min", "cid"), top=("max", "cid")).select("k", "p", "hub", "cid"), "shared")
    release(spark)
    asked = c.join(shared.select("cid").distinct(), "cid", "left_semi").select("cid", "i", "th")
    own = F.col("p.i").eqNullSafe(F.col("d.i")) & (F.col("p.th") == F.col("d.th"))
    texts = space.write(asked.alias("p").join(d.alias("d"), own).select("p.cid", "d.t").dropDuplicates(["cid"]), "texts")
    release(spark)

    @F.pandas_udf("boolean")
    def close(x: pd.Series, nx: pd.Series, y: pd.Series, ny: pd.Series) -> pd.Series:
        rows = lambda z: np.frombuffer(b"".join(z), np.uint8).reshape(len(z), BINS)
        return pd.Series(may_link(rows(x), nx.to_numpy(), rows(y), ny.to_numpy(), percent)[0])

    @F.pandas_udf("boolean")
    def confirmed(x: pd.Series, y: pd.Series) -> pd.Series:
        out, last, own = [], None, None
        for a, b in zip(x, y, strict=True):
            if a is not last and a != last:
                last, own = a, shingle_set(a, width)
            out.append(similar(own, shingle_set(b, width), percent))
        return pd.Series(out, dtype=bool)

    def in_reach(pairs: DataFrame) -> DataFrame:
        """Pairs whose set sizes and sketches allow the similarity."""
        one = c.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        two = c.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        near = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        return near.where(close("sa", "na", "sb", "nb")).select("a", "b")

    def confirm(p: DataFrame, name: str) -> DataFrame:
        """Distinct pairs (a, b) of classes in reach, as written -> those that are linked."""
        text = lambda x: texts.select(F.col("cid").alias(x), F.col("t").alias(f"t{x}"))
        links = space.write(p.join(text("b"), "b").join(text("a"), "a").where(confirmed("ta", "tb")).select("a", "b"), f"{name}-links")
        release(spark)
        return links

    def across(top: int | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for g in groups(batches, order):
                sk = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), BINS)
                sig = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(g), LENGTH)
                place = g["p"].iloc[0]
                cid, comp, n = g["cid"].to_numpy(), g["comp"].to_numpy(), g["n"].to_numpy()
                side = g["side"].to_numpy() if g["bi"].iloc[0] != g["bj"].iloc[0] else None
                parts, sizes = np.unique(comp, return_counts=True)
                largest = parts[sizes.argmax()]
                rest = np.flatnonzero(comp != largest)  # one of each pair across components is outside the largest
                for at in range(0, len(rest), 8):
                    own = rest[at : at + 8]
                    ok = comp[own, None] != comp[None, :]
                    ok &= 100 * np.minimum(n[own, None], n[None, :]) >= percent * np.maximum(n[own, None], n[None, :])
                    if side is not None:
                        ok &= side[own, None] != side[None, :]
                    if top is None:
                        ok &= (comp[None, :] == largest) | (cid[own, None] < cid[None, :])
                    i, j = np.nonzero(ok)
                    mine = first_key(sig[own[i]], sig[j]) == place  # a pair counts in the first key that it shares
                    i, j = i[mine], j[mine]
                    may, same = may_link(sk[own[i]], n[own[i]], sk[j], n[j], percent)
                    keep = np.flatnonzero(may)
                    if top is not None and len(keep):
                        keep = keep[np.lexsort((cid[j[keep]], -same[keep], i[keep]))]
                        first = np.concatenate(([0], np.flatnonzero(np.diff(i[keep])) + 1))
                        keep = keep[np.arange(len(keep)) - np.repeat(first, np.diff(np.append(first, len(keep)))) < top]
                    if len(keep):
                        x, y = cid[own[i[keep]]], cid[j[keep]]
                        held.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}))
                if len(held) > 200:
                    yield pd.concat(held).drop_duplicates()
                    held = []
            if held:
                yield pd.concat(held).drop_duplicates()

        return run

    order = ["k", "bi", "bj"]
    star = shared.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    tried = space.write(in_reach(star), "star-pairs")  # a pair out of reach is so again whenever it is met
    reach = absorb(None, confirm(tried, "star"), space, "star-components")
    held = "shared"
    for name, top in (("near", 1), ("nearer", 4), ("all", None)):
        named = shared.join(reach, F.col("cid") == F.col("node"), "left").select("k", "p", "cid", F.coalesce("component", "cid").alias("comp"))
        mixed = with_totals(named, ["k"], "cid", "lo < hi", lo=("min", "comp"), hi=("max", "comp"))
        shared = space.write(mixed.select("k", "p", "cid", "comp"), f"{name}-members")
        space.drop(held)
        held = f"{name}-members"
        if shared.isEmpty():  # all that share a key are in one component
            break
        dealt = block_pairs(shared, ["k"], "cid", block).join(c.select("cid", "sig", "sketch", "n"), "cid")
        pairs = dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(across(top), "a long, b long").distinct()
        pairs = space.write(pairs.join(tried, ["a", "b"], "left_anti"), f"{name}-candidates")
        if not pairs.isEmpty():
            reach = absorb(reach, confirm(pairs, name), space, f"{name}-components")
            tried = tried.unionByName(pairs)
        shared = shared.select("k", "p", "cid")

    space.drop("texts")
    c = c.join(reach, F.col("cid") == F.col("node"), "left").select("set", "doc", F.coalesce("component", "cid").alias("component"))
    least = c.groupBy("component").agg(F.min("doc").alias("component_id"))
    c = space.write(c.join(least, "component").select("set", "component_id"), "found")
    out = rows.alias("r").join(c.alias("c"), F.col("r.set") == F.col("c.set"), "left")
    component = F.when(F.col("r.set").isNull(), F.col("i")).otherwise(F.col("component_id"))
    return out.select(F.col("i").alias("doc_id"), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("i").eqNullSafe(component).alias("kept"))
