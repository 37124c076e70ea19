"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words."""

from __future__ import annotations

import re
from base64 import urlsafe_b64encode
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_batches

#: Words of a leaf at most; words of a whole text up to which each word is a leaf; bytes of a digest; characters of it (6 bits each) that a fingerprint
#: shows of a leaf and of a branch.
LEAF, SHORT, DIGEST, LEAF_SHOWN, BRANCH_SHOWN = 8, 16, 16, 4, 12
SECTION = re.compile(r"\n[ \t]*(?:\n[ \t]*)+")
#: A leaf: up to LEAF words, ending early at a sentence's end. White space goes with the word before it.
RUN = re.compile(r"\s+|(?:\S*[^\s.!?]\s+){0,%d}\S+\s*" % (LEAF - 1))


WORD = re.compile(r"\s+|\S+\s*")


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


def _shown(digest: bytes, length: int) -> str:
    return urlsafe_b64encode(digest)[:length].decode()


def leaves_of(paragraph: str, short: bool) -> list[str]:
    """A paragraph's runs of words, which together are all of it: single words in a short text, else up to LEAF words that end with a sentence."""
    return (WORD if short else RUN).findall(paragraph)


def fingerprint(text: str | None) -> str:
    """`root/section:paragraph=leaves:paragraph=leaves/section...`: each branch's digest is of the whole digests of those below it.

    Sections are parted by blank lines, paragraphs by line feeds, and paragraphs into leaves_of(). Only what is shown of a digest is cut: leaves to 24 bits, sections
    and paragraphs to 72, the root to 128 (all of it), so a branch is told apart by its leaves' 128 bits. The root is of the whole text too, so equal roots mean
    equal texts. Null counts as empty.
    """
    text = text or ""
    short = len(text.split(maxsplit=SHORT)) <= SHORT
    sections, whole = [], []
    for section in SECTION.split(text):
        paragraphs, below = [], []
        for paragraph in section.split("\n"):
            leaves = [_digest(x.encode("utf-8", "surrogatepass")) for x in leaves_of(paragraph, short)]
            below.append(_digest(b"".join(leaves)))
            paragraphs.append(f"{_shown(below[-1], BRANCH_SHOWN)}={''.join(_shown(x, LEAF_SHOWN) for x in leaves)}")
        whole.append(_digest(b"".join(below)))
        sections.append(f"{_shown(whole[-1], BRANCH_SHOWN)}:{':'.join(paragraphs)}")
    root = _digest(_digest(text.encode("utf-8", "surrogatepass")) + b"".join(whole))
    return "/".join([_shown(root, 2 * BRANCH_SHOWN), *sections])


def branches(print_: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(section digest, [(paragraph digest, leaves)]) of a fingerprint."""
    out = []
    for section in print_.split("/")[1:]:
        head, *paragraphs = section.split(":")
        out.append((head, [tuple(p.split("=")) for p in paragraphs]))
    return out


def _leaves(print_: str) -> Counter:
    got: Counter = Counter()
    for _, paragraphs in branches(print_):
        for _, leaves in paragraphs:
            got.update(leaves[i : i + LEAF_SHOWN] for i in range(0, len(leaves), LEAF_SHOWN))
    return got


def likeness(a: str, b: str) -> float:
    """Leaves in common, with repeats, as a share of the mean number of leaves (0 to 1); 1 for equal roots."""
    if a.split("/", 1)[0] == b.split("/", 1)[0]:
        return 1.0
    x, y = _leaves(a), _leaves(b)
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if n else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of a whose branch differs from b's in the same place; equal branches aren't entered."""
    x, y = branches(a), branches(b)
    out = []
    for i, (head, paragraphs) in enumerate(x):
        other = y[i] if i < len(y) else ("", [])
        if head != other[0]:
            out += [(i, j) for j, (p, _) in enumerate(paragraphs) if j >= len(other[1]) or other[1][j][0] != p]
    return out


def add_fingerprints(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with the column `fingerprint` of each whole text (null: empty); nothing is shuffled."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return documents.withColumn("fingerprint", of(F.col(text_col)))


def edit(text: str, following: str) -> str:
    """The last third of the code points, rounded down, replaced by the first as many (or all) of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_neighbours(documents: DataFrame, range_bytes: int = 8 << 20, max_ranges: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document's next one is the one after it in descending order of id, then by a hash of the text and the text (null ids last), and the last's is the
    first. The ids are cut into ranges by quantiles, each range a stretch of the order and a partition of its own: its rows are sorted (beyond memory by spilling) and
    streamed, so that a task holds two texts, and the first row of each range is also sent to the range above, as the next of that one's last row. So
    texts are shuffled once, with one text more for each range, and no window spans all rows. Ranges have range_bytes up to max_ranges of them (0.5 TB), and
    grow from there on: 1.6 GB each at 100 TB.

    An id that many rows share, and null ids, are cut into ranges by that hash, so they don't meet in one task either, unless their texts are equal too.
    Null text: empty. Repeated rows follow each other in any order, as they are alike. A single document
    is its own next. Empty table: no rows. Only the two columns are read.
    """
    spark = documents.sparkSession
    text_batches(spark)
    ids = documents.select(F.col(id_col).cast("long").alias("i"), F.octet_length(F.col(text_col)).alias("n"))
    total, low, n, nulls = ids.agg(F.sum("n"), F.min("i"), F.count("*"), F.count_if(F.col("i").isNull())).first()
    ranges = min(max_ranges, int((total or 0) // range_bytes) + 1)
    bounds = ids.agg(F.percentile_approx("i", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 20 * ranges)).first()[0] if ranges > 1 and low is not None else []
    # Range 0 has the greatest ids; a bound begins a new one, which goes on to the ids below it, and the last ranges have the null ids. An id that is several bounds has
    # so many rows that it gets ranges of its own, one for each bound more, by its texts' hashes.
    edges, times = np.unique(np.array(bounds or [], np.int64), return_counts=True)
    own = times - 1
    begins = np.append((len(edges) - np.arange(len(edges))) + own.sum() - np.cumsum(own), 0)
    parts = max(1, -(-ranges * nulls // max(1, n)))

    def place(i: pd.Series, h: pd.Series) -> np.ndarray:
        null, ids_ = i.isna().to_numpy(), i.fillna(0).to_numpy(np.int64)
        at = np.searchsorted(edges, ids_, "left")
        unsigned = h.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)  # the hash's order, from 0
        cut = lambda k: (unsigned >> np.uint64(32)).astype(np.int64) * k // (1 << 32)
        more, bound = np.append(own, 0)[at], np.append(edges, 0)[at] == ids_
        known = begins[at] + np.where(bound & (more > 0), cut(more), more)
        return np.where(null, len(edges) + own.sum() + 1 + cut(parts), known)

    @F.pandas_udf("int")
    def range_of(i: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(place(i, h))

    d = documents.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("h", F.xxhash64("t"))
    # One row for each range: the id and hash with which it starts. The range before it needs its first row too.
    firsts = d.groupBy(range_of("i", "h").alias("r")).agg(F.min(F.struct(F.bitwise_not("i").alias("down"), "h")).alias("first")).orderBy("r").collect()
    order = [f["r"] for f in firsts]
    above = {(f["first"]["down"] is None, 0 if f["first"]["down"] is None else ~f["first"]["down"], f["first"]["h"]): k for k, f in enumerate(firsts)}
    shared = spark.sparkContext.broadcast((np.array(order, np.int64), above))

    @F.pandas_udf("array<int>")
    def ranges_of(i: pd.Series, h: pd.Series) -> pd.Series:
        """A row's range by its number among those that have rows, and if a range starts with the row's id, the number of the one above it."""
        starts, above_ = shared.value
        at = np.searchsorted(starts, place(i, h))
        null = i.isna().to_numpy()
        out = []
        for r, none, a, b in zip(at.tolist(), null.tolist(), i.fillna(0).astype(np.int64).tolist(), h.tolist(), strict=True):
            k = above_.get((none, 0 if none else a, b))
            out.append([r] if k is None else [r, (k - 1) % len(starts)])
        return pd.Series(out)

    spread = max(1, len(order))
    # Of the rows with a range's first id, only the first text is needed above; the least is chosen below, in the stream.
    d = d.select("i", "t", "h", F.posexplode(ranges_of("i", "h")).alias("tail", "r")).withColumn("tail", F.col("tail") == 1)
    d = d.repartitionById(spread, "r").sortWithinPartitions("tail", F.col("i").desc_nulls_last(), "h", "t").select("i", "t", "tail")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held, done, out, size = None, False, [], 0  # held: id, text, fingerprint of a row whose next is to come
        for batch in batches:
            for i, text, tail in zip(batch["i"].tolist(), batch["t"], batch["tail"].tolist(), strict=True):
                if done:
                    continue  # more rows with the id that the next range starts with
                own = fingerprint(text)
                if held is not None:
                    edited = edit(held[1], text)
                    changed = held[2] if edited == held[1] else fingerprint(edited)
                    out.append((held[0], len(held[1]), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), held[2], changed, likeness(held[2], changed), likeness(held[2], own)))
                    size += len(held[1])
                held, done = (None if pd.isna(i) else int(i), text, own), tail
                if size > 4 << 20:
                    yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})
                    out, size = [], 0
        if held is not None and not done:
            raise ValueError("a range ended without the next range's first row")
        yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    return d.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
