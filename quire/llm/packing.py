"""Order-preserving packing by dynamic programming."""

from __future__ import annotations

import sys
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_batches

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Fixed value: the pattern by which a byte-level tokenizer splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_open: dict[str, "Encoder"] = {}


def _byte_of() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by a tokenizer's file, as little-endian unsigned 32-bit bytes.

    The merges of a byte-level BPE without further steps, whose merges are numbered as their results are, can be run by rank: of the
    pairs in a word the one with the lowest resulting id is merged first. Such a file's ids come from the rank library, which is
    several times as fast. Those of any other file come from the tokenizer itself, and so do those of a text that has the content of a token which was added to
    the vocabulary (a special token as a literal): the tokenizer gives it that token's id.
    """

    def __init__(self, path: str):
        import json

        self.path, self._whole = path, None
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        parts["added_tokens"] = parts.get("added_tokens") or []
        special = {t["id"] for t in parts["added_tokens"]}
        self.added = [t["content"] for t in parts["added_tokens"]]
        size = 1 + max([*parts["model"].get("vocab", {}).values(), *special])
        byte_of = _byte_of()
        self.raw = [b""] * size
        for token, i in (parts["model"].get("vocab") or {}).items():
            if i not in special and all(c in byte_of for c in token):
                self.raw[i] = bytes(byte_of[c] for c in token)
        #: Whether a sentence may end with a token.
        self.stop = np.array([t[-1:] in (b".", b"!", b"?") or b"\n" in t for t in self.raw])
        self.ranks = self._by_rank(parts)

    @property
    def tokenizer(self):
        """The tokenizer itself, which is opened when a text needs it: where ranks will do, no worker holds both."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def _by_rank(self, parts: dict):
        model, before = parts["model"], parts.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not parts.get("normalizer") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges"))
        plain = plain and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if not plain or sorted(t for t in self.raw[:256]) != [bytes([b]) for b in range(256)]:
            return None
        vocabulary = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocabulary.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.raw) if t}, special_tokens={})

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The ids, and how many ids there are up to each place where a sentence may end (after . ! ? or a line feed)."""
        if not text:
            return b"", np.empty(0, np.int64)
        ranked = self.ranks and not any(t in text for t in self.added)
        ids = array("I", self.ranks.encode_ordinary(text) if ranked else self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        data = ids.tobytes()
        return data, np.flatnonzero(self.stop[np.frombuffer(data, "<u4")]) + 1


def cuts(ends: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Indexes into ends of the window ends of least padding plus penalties, in O(n).

    ends: increasing positions at which a window may end, none more than size after the one before (or 0), the last the end of
    all. With cost(j) = penalty(j) + min over i of cost(i) + size - (ends(j) - ends(i)), i in a sliding range of at most size
    tokens, the term cost(i) + ends(i) doesn't depend on j, so a queue of increasing such terms has the best i in front. A tie
    goes to the longest window.
    """
    at, pen = [0, *ends.tolist()], [0, *penalty.tolist()]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    back = [0] * len(at)
    for j in range(1, len(at)):
        end = at[j]
        while at[queue[0][1]] < end - size:
            queue.popleft()
        best, back[j] = queue[0]
        term = best + size + pen[j]  # cost(j) + ends(j)
        while queue and queue[-1][0] > term:
            queue.pop()
        queue.append((term, j))
    out, j = [], len(at) - 1
    while j:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


class Packer:
    """Packs one stream of documents, in order; add() gives what is settled."""

    def __init__(self, size: int, sentence: float, inside: float, block: int, base: int):
        self.size, self.sentence, self.inside, self.block, self.next = size, sentence, inside, block, base
        self.docs: list[tuple[object, bytes, int]] = []  # id, all its ids, how many of them are settled
        self.stops: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: object, ids: bytes, stops: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.stops.append(stops)
        self.held += len(ids) // 4
        if self.held >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        ends, penalty, at = [], [], 0
        for (_, ids, done), stops in zip(self.docs, self.stops, strict=True):
            n = len(ids) // 4
            inner = stops[(stops > done) & (stops < n)]
            marks, costs = np.append(inner, n), np.append(np.full(len(inner), self.sentence), 0.0)
            gaps = np.diff(marks, prepend=done)
            if (gaps > self.size).any():  # a sentence longer than a window is cut inside
                more = np.concatenate([np.arange(m - g + self.size, m, self.size) for m, g in zip(marks, gaps, strict=True) if g > self.size])
                marks, costs = np.append(marks, more), np.append(costs, np.full(len(more), self.inside))
                order = np.argsort(marks, kind="stable")
                marks, costs = marks[order], costs[order]
            ends.append(marks - done + at)
            penalty.append(costs)
            at += n - done
        if not at:
            return
        ends_, penalty_ = np.concatenate(ends), np.concatenate(penalty)
        chosen = [0, *(int(ends_[j]) for j in cuts(ends_, penalty_, self.size))]
        tail = chosen[-1] - chosen[-2]
        if last:
            # Sequences of a power of two aren't padded: the last is cut into such if that costs less than its padding.
            powers = [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
            if len(powers) > 1 and self.inside * (len(powers) - 1) < self.size - tail:
                chosen[-1:] = [int(x) for x in chosen[-2] + np.cumsum(powers)]
        else:
            chosen = chosen[: max(2, 1 + (len(chosen) - 1) * 3 // 4)]  # later cuts may change with what follows
        begins = np.cumsum([0, *((len(ids) // 4) - done for _, ids, done in self.docs)])
        d = 0
        for a, b in zip(chosen, chosen[1:], strict=False):
            while begins[d + 1] <= a:
                d += 1
            k = d
            while k < len(self.docs) and begins[k] < b:
                doc_id, ids, done = self.docs[k]
                lo, hi = max(a, int(begins[k])), min(b, int(begins[k + 1]))
                start = done + lo - int(begins[k])
                yield doc_id, start, hi - lo, ids[4 * start : 4 * (start + hi - lo)], len(ids) // 4, self.next, lo - a
                k += 1
            self.next += 1
        end = chosen[-1]
        keep = [(i, (doc_id, ids, max(done, done + end - int(begins[i])))) for i, (doc_id, ids, done) in enumerate(self.docs) if begins[i + 1] > end]
        self.docs, self.stops = [x for _, x in keep], [self.stops[i] for i, _ in keep]
        self.held = at - end


def pack(documents: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, sentence: float = 4.0, inside: float = 64.0, block: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most size tokens: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.

    The rows of a partition are one stream, in their order; a document is its ids and then end_id. Windows end where padding
    plus penalties are least: 0 at a document's end, sentence at a sentence's, inside elsewhere (only a sentence longer than a
    window, or the last sequence, is cut so). The choice is exact for each block of tokens; three quarters of a block's windows are
    settled and the rest goes on into the next. Nothing is shuffled, a task holds about one block and one document, and a lost
    task is redone from its own input. Sequences are numbered from 2**33 times the partition. The last sequence of a partition is
    cut into powers of two, which aren't padded, if that costs less than padding it.

    Null or empty text: end_id alone. Null ids and repeated rows are packed like any others. Empty table: no rows. Only the two
    columns are read.
    """

    text_batches(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _open.get(tokenizer) or _open.setdefault(tokenizer, Encoder(tokenizer))
        packer = Packer(size, sentence, inside, block, TaskContext.get().partitionId() << 33)
        mark = np.array([end_id], "<u4").tobytes()
        out, held = [], 0
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
        for batch in batches:
            for doc_id, text in zip(batch["i"].tolist(), batch["t"], strict=True):
                ids, stops = encode(text)
                for piece in packer.add(None if pd.isna(doc_id) else int(doc_id), ids + mark, stops):
                    out.append(piece)
                    held += piece[2]
                if held >= 1 << 20:
                    yield frame(out)
                    out, held = [], 0
        out.extend(packer.flush(True))
        yield frame(out)

    return documents.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, SCHEMA)
