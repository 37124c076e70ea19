"""Substring dedup by level-wise doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Workspace, release, text_batches, window_hashes, word_hashes


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


#: Another base of the hash of whole windows, for their second 64 bits.
_SECOND = np.uint64(0xA0761D6478BD642F)


def lengths(window: int, shortest: int = 25) -> list[int]:
    """Levels of the doubling: the shortest length from which doubling reaches the window and that isn't below `shortest`, and so on; the last is the window."""
    out = [window]
    while (half := (out[0] + 1) // 2) >= shortest:
        out.insert(0, half)
    return out


def anchors(words: np.ndarray, window: int, length: int) -> np.ndarray:
    """Of each run of window words, the least hash of the runs of length words inside it.

    Equal windows have equal anchors, so a window can only repeat if its anchor does, and about two in window - length runs are anchors.
    """
    return sliding_min(window_hashes(words, length), window - length + 1)


def alive(words: np.ndarray, window: int, found: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Which windows may still repeat: those whose anchors at each length are among the repeated ones."""
    ok = np.ones(max(0, len(words) - window + 1), bool)
    for length, hashes in found:
        ok &= np.isin(anchors(words, window, length), hashes)
    return ok


def among(first: np.ndarray, second: np.ndarray, found: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of hashes are in a list of pairs, by 128 bits."""
    have = np.array(sorted((a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in found), np.uint64).reshape(-1, 2)
    at = np.minimum(np.searchsorted(have[:, 0], first), max(0, len(have) - 1))
    return (have[at, 0] == first) & (have[at, 1] == second) if len(have) else np.zeros(len(first), bool)


def covered(words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words a window from any of starts covers."""
    step = np.zeros(words + 1, np.int64)
    step[starts] += 1
    np.subtract.at(step, np.minimum(starts + window, words), 1)
    return np.cumsum(step[:-1]) > 0


def _array(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def dedup(documents: DataFrame, window: int = 50, shortest: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces).

    Each word is removed that a window of that many words covers whose words also start in a document with a smaller id. By levels (lengths()): what
    repeats at one length alone is extended to twice that length, the last one being the window, until the window is reached or nothing survives. A repeat
    longer than the window is the union of its windows, so doubling ends there.

    Below the window, of each window that is still alive only its anchor is dealt out, the least hash of the level's runs in it: about one row for every 13
    words at 25. Whole windows are dealt out only where their anchors at all levels are in two different texts, once for each text, with the least id.
    Equal texts are one text, of the least id; a later copy loses all its words if it has a window at all. Sums by hash are taken
    before and after the shuffle, so neither a passage in a third of all documents nor a group of copies meets in one task,
    and what is joined to a document is a list no longer than itself. Texts and whole windows are told apart by 128 bits, anchors by 64 (a collision there costs
    work only). Texts are shuffled once for each level above the first and once at last, to meet their lists.

    Null text: no words. Null ids: neither smaller nor greater, so such a document stays whole and removes nothing. Rows with the same id
    don't remove from each other. Fewer words than window: kept. Empty table: no rows. Only the two columns are read.
    """
    spark = documents.sparkSession
    space = Workspace(spark)
    text_batches(spark)
    levels = lengths(window, shortest)
    d = documents.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).withColumns({"th": F.xxhash64("t"), "tg": F.xxhash64(F.lit(7), "t")})
    text = ["th", "tg"]
    same = lambda x, y: (F.col(f"{x}.th") == F.col(f"{y}.th")) & (F.col(f"{x}.tg") == F.col(f"{y}.tg"))

    def deal(before: list[int], length: int):
        """Rows of texts -> their anchors at a length, or whole windows as pairs, of the windows alive after the lengths before."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                lists = batch[[f"a{k}" for k in before]].itertuples(index=False) if before else [()] * len(batch)
                for i, th, tg, t, found in zip(batch["i"], batch["th"], batch["tg"], batch["t"], lists, strict=True):
                    words, _, _ = word_hashes(t.encode("utf-8", "surrogatepass"))
                    if len(words) < window:
                        continue
                    ok = alive(words, window, [(k, np.asarray(x, np.int64).view(np.uint64)) for k, x in zip(before, found, strict=True)])
                    if length < window:
                        out.append((i, th, tg, _array(np.unique(anchors(words, window, length)[ok])), None))
                    else:
                        pairs = np.stack([window_hashes(words, window)[ok], window_hashes(words, window, _SECOND)[ok]], axis=1)
                        pairs = np.unique(pairs, axis=0)
                        out.append((i, th, tg, _array(np.ascontiguousarray(pairs[:, 0])), _array(np.ascontiguousarray(pairs[:, 1]))))
                yield pd.DataFrame(out, columns=["i", "th", "tg", "a", "b"])

        return run

    schema = "i long, th long, tg long, a array<long>, b array<long>"
    todo, texts = d.where("i is not null and t is not null"), None
    for k, length in enumerate(levels):
        dealt = space.write(todo.mapInPandas(deal(levels[:k], length), schema), f"level{length}")
        release(spark)
        if texts is None:  # the text of the least id stands for its copies
            texts = dealt.groupBy(*text).agg(F.min("i").alias("first"))
        if length == window:
            dealt = dealt.join(texts.select(*text, "first"), text).where("i = first") if k == 0 else dealt
            break
        spread = dealt.select(*text, F.explode("a").alias("a"))
        again = spread.groupBy("a").agg(F.min(F.struct(*text)).alias("lo"), F.max(F.struct(*text)).alias("hi")).where("lo <> hi").select("a")
        lists = spread.distinct().join(again, "a", "left_semi").groupBy(*text).agg(F.collect_list("a").alias(f"a{length}"))
        texts = space.write(texts.join(lists, text, "left"), f"texts{length}")
        space.drop(f"level{length}")
        release(spark)
        survivors = texts.where(F.col(f"a{length}").isNotNull())
        if survivors.isEmpty():
            dealt = dealt.sparkSession.createDataFrame([], schema)
            break
        todo = d.where("i is not null").alias("d").join(survivors.alias("s"), same("d", "s")).where("i = first").select("i", "d.th", "d.tg", "t", *[f"a{n}" for n in levels[: k + 1]])
    spread = dealt.select("i", *text, F.explode(F.arrays_zip("a", "b")).alias("w")).select("i", *text, F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    least = spread.groupBy("a", "b").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).where("lo < hi").select("a", "b", "lo")
    late = spread.join(least, ["a", "b"]).where("i > lo").groupBy(*text).agg(F.collect_list(F.struct("a", "b")).alias("w"))
    lists = space.write(texts.select(*text, "first").join(late, text, "left"), "lists")
    for n in levels:
        space.drop(f"level{n}")
    release(spark)

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t, begin, found in zip(batch["i"].tolist(), batch["t"], batch["first"].tolist(), batch["w"], strict=True):
                data = (t or "").encode("utf-8", "surrogatepass")
                words, starts, ends = word_hashes(data)
                gone = np.zeros(len(words), bool)
                own = not pd.isna(i) and not pd.isna(begin)
                if own and i > begin:
                    gone[:] = len(words) >= window
                elif own and found is not None and len(words) >= window:
                    hit = among(window_hashes(words, window), window_hashes(words, window, _SECOND), [(x["a"], x["b"]) for x in found])
                    gone = covered(len(words), np.flatnonzero(hit), window)
                keep = np.flatnonzero(~gone)
                kept = b" ".join([data[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]).decode("utf-8", "surrogatepass")
                out.append((None if pd.isna(i) else int(i), len(words), int(gone.sum()), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})

    done = d.alias("d").join(lists.alias("l"), same("d", "l"), "left").select("i", "t", "first", "w")
    return done.mapInPandas(last, "doc_id long, n_words long, n_removed long, kept string")
