"""LM scoring: a gated recurrent language model with a class-factored softmax, trained by truncated backpropagation in numpy on the executors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Workspace, mix, text_batches, word_hashes

#: Words in a class of the softmax, such classes, classes of the other words (by their last three bytes), and units of the recurrent state.
WIDTH, HEADS, TAILS, UNITS = 32, 32, 31, 16
CLASSES, WORDS = HEADS + TAILS + 1, WIDTH * HEADS
END = CLASSES - 1
#: Rows of the input table: the softmax's words, a row for each class of others, and the start of a text.
START = WORDS + TAILS
INPUTS = START + 1
#: Steps of a window in training and scoring, texts side by side, tokens that are learnt from (or counted) and scored together.
WINDOW, SCORED, LANES, TOGETHER, SCORED_TOGETHER = 16, 32, 256, 1 << 21, 1 << 22
#: Tokens whose classes are told at a time, so that what is computed of them stays in a core's cache.
TILE = 1024
#: Weights that are changed at a time, for the same reason.
PART = 8192
#: Floats of a block in which weights are summed, and parts into which a block's sums are dealt.
BLOCK, SALTS = 4096, 16
SHAPES = {"x": (INPUTS, 3 * UNITS), "u": (UNITS, 3 * UNITS), "c": (UNITS, CLASSES), "cb": (CLASSES,), "w": (HEADS, UNITS, WIDTH), "wb": (HEADS, WIDTH)}
NEVER = np.float32(-1e9)
#: Bytes with A-Z as a-z.
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
#: Bits of the last three bytes that a word of so many bytes has (of more: all).
_HELD = np.array([0, 0xFF0000, 0xFFFF00, 0xFFFFFF], np.uint32)


def held_out(doc_id):
    """Whether a document isn't learnt from: CRC-32 of its id as text is divisible by 10 (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of texts, one after the other: 64-bit hash (A-Z as a-z) and class of others; and where each text's words begin, with the end."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begins = np.cumsum([0] + [len(b) + 1 for b in parts])
    data = b"\n".join(parts)
    hashes, starts, ends = word_hashes(data, lower=True)
    edges = np.searchsorted(starts, begins[:-1]) if len(texts) else np.zeros(0, np.int64)
    # The last three bytes as a number, and of a shorter word those it has: what lies before it is taken away again.
    small = np.zeros(len(data) + 2, np.uint32)
    small[2:] = _SMALL[np.frombuffer(data, np.uint8)]
    three = (small[2:] << np.uint32(16) | small[1:-1] << np.uint32(8) | small[:-2])[ends - 1] & _HELD[np.minimum(ends - starts, 3)]
    return hashes, (mix(three.astype(np.uint64) + np.uint64(1)) % np.uint64(TAILS)).astype(np.int32), np.append(edges, len(hashes))


@dataclass
class Vocabulary:
    """What is known of all training tokens: the most frequent words' hashes (sorted), counts and numbers in the softmax (-1: none), and sums over the rest by class.

    rest: sums of (count + 0.1) of a class's other words and of one unknown word, which are shared by frequency in their class.
    """

    hashes: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    heads: np.ndarray
    rest: np.ndarray
    ends: int = 0
    total: int = 0
    types: int = 0
    log_rest: np.ndarray = field(init=False)
    logs: np.ndarray = field(init=False)
    shift: np.uint64 = field(init=False)
    first: np.ndarray = field(init=False)
    keys: np.ndarray = field(init=False)

    def __post_init__(self):
        self.log_rest, self.logs = np.log10(self.rest), np.log10(self.counts + 0.1)
        bits = len(self.hashes).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(self.hashes, np.uint64((1 << 64) - 1))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: its place among these words, and whether it is there (if not, the place is any). Hashes are spread evenly, so by its first bits a word is a step or two away."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = self.first[hashes >> self.shift].astype(np.int64)
        on = np.flatnonzero(self.keys[at] < hashes)
        while len(on):
            at[on] += 1
            on = on[self.keys[at[on]] < hashes[on]]
        at = np.minimum(at, len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: its count, -1 if it isn't among these words, and its number in the softmax or -1."""
        at, here = self.places(hashes)
        if not len(self.hashes):
            return np.full(len(hashes), -1), np.full(len(hashes), -1)
        return np.where(here, self.counts[at], -1), np.where(here, self.number[at], -1)

    def listed(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: whether it is among these words, its number in the softmax or -1, and the logarithm of its count + 0.1, 0 if it isn't here."""
        at, here = self.places(hashes)
        if not len(self.hashes):
            return here, np.full(len(hashes), -1), np.zeros(len(hashes))
        return here, np.where(here, self.number[at], -1), np.where(here, self.logs[at], 0)

    def told(self) -> Vocabulary:
        """The words of the softmax alone: of those find() gives the same numbers, from a table that stays in a core's cache."""
        here = self.number >= 0
        return replace(self, hashes=self.hashes[here], counts=self.counts[here], number=self.number[here])

    def weights(self) -> dict[str, np.ndarray]:
        """Weights to begin with: what any text has by counts alone, and small numbers from a fixed seed."""
        rng = np.random.default_rng(11)
        out = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
        words = self.heads.reshape(HEADS, WIDTH).astype(float)
        mass = np.concatenate((words.sum(axis=1), self.rest, [self.ends + 0.1]))
        with np.errstate(divide="ignore"):
            out["cb"] = np.where(mass > 0, np.log(mass / mass.sum()), NEVER).astype(np.float32)
            out["wb"] = np.where(words > 0, np.log(words / np.maximum(words.sum(axis=1, keepdims=True), 1)), NEVER).astype(np.float32)
        out["c"] *= np.float32(0.1)
        out["w"] *= np.float32(0.1)
        return out


# ---------------------------------------------------------------- the network


def side_by_side(texts: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """lanes() one after the other in arrays: inputs, classes and words of all, where each lane begins, with the end, and the lanes' texts."""
    heap = [(0, k) for k in range(max(1, min(n, len(texts))))]
    dealt: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i][0])):
        length, k = heap[0]
        dealt[k].append(i)
        heapq.heapreplace(heap, (length + len(texts[i][0]) + 1, k))
    long = {k: length for length, k in heap}
    dealt = [dealt[k] for k in sorted(long, key=lambda k: (-long[k], k)) if dealt[k]]
    order = [i for own in dealt for i in own]
    number, other = (np.concatenate([texts[i][x] for i in order]).astype(np.int16) if order else np.zeros(0, np.int16) for x in (0, 1))  # all numbers are below 2000
    ends = np.cumsum([len(texts[i][0]) + 1 for i in order], dtype=np.int64) - 1
    size = len(number) + len(order)
    said = np.ones(size, bool)
    said[ends] = False
    head = number >= 0
    inputs, classes, words = np.full(size + 1, START, np.int16), np.full(size, END, np.int16), np.zeros(size, np.int16)
    inputs[1:][said] = np.where(head, number, WORDS + other)
    classes[said] = np.where(head, number // WIDTH, HEADS + other)
    words[said] = np.where(head, number % WIDTH, 0)
    return inputs[:size], classes, words, np.cumsum([0] + [sum(len(texts[i][0]) + 1 for i in own) for own in dealt]), dealt


def lanes(texts: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """texts (number or -1, class of others) side by side in n lanes of about one length, the longest first: (input, class, word in class or 0) of each step. A text is
    its words and an end; its first input is START, so where that is the state is empty."""
    *arrays, edges, dealt = side_by_side(texts, n)
    return [(*(x[a:b] for x in arrays), own) for a, b, own in zip(edges, edges[1:], dealt, strict=False)]


def step(p: dict, x: np.ndarray, h: np.ndarray) -> tuple:
    """One step of the gated unit: the new state, and what going back needs."""
    a = h @ p["u"]
    gates = 1 / (1 + np.exp(-(x[:, : 2 * UNITS] + a[:, : 2 * UNITS])))
    z, r = gates[:, :UNITS], gates[:, UNITS:]
    an = a[:, 2 * UNITS :]
    n = np.tanh(x[:, 2 * UNITS :] + r * an)
    return n + z * (h - n), z, r, n, an


def forward(p: dict, inputs: np.ndarray, h: np.ndarray, back: bool = True) -> tuple:
    """step() over a window (steps x lanes) from the state h (lanes x units), in arrays for all of it, whose last axis is the lanes: the states after each step and, for going back,
    those before, gates (update, reset), the state's part of the candidate, the candidate, how far the state before is from it, which lanes go on with a text, and for each
    step whether a text begins in it. A step allocates nothing, and what it does by elements lies side by side. Without `back` only the states are kept of all steps."""
    n, on = inputs.shape
    kind, two = p["u"].dtype, 2 * UNITS
    x, u = np.ascontiguousarray(p["x"].take(inputs, axis=0).transpose(0, 2, 1)), np.ascontiguousarray(p["u"].T)
    np.negative(x[:, :two], out=x[:, :two])  # a gate is 1 / (1 + exp(-a))
    np.negative(u[:two], out=u[:two])
    first = (inputs != START).astype(kind)[:, None]
    begins = (inputs == START).any(axis=1).tolist()
    states, room = np.empty((n, UNITS, on), kind), n if back else 1
    before, m, apart, gates, a = (np.empty((room, k, on), kind) for k in (UNITS, UNITS, UNITS, two, 3 * UNITS))
    each = (before, gates, gates[:, :UNITS], gates[:, UNITS:], m, a, a[:, :two], a[:, two:], apart)
    each = zip(*(each if back else (list(k) * n for k in each)), states, x[:, :two], x[:, two:], begins, first, strict=True)
    h = h.T
    for was, gate, update, reset, out, own, own_gates, own_out, off, now, add, add_out, begin, goes in each:
        if begin:
            np.multiply(h, goes, out=was)
        else:
            was[...] = h
        u.dot(was, own)
        np.add(add, own_gates, out=gate)
        np.exp(gate, out=gate)
        np.add(gate, 1, out=gate)
        np.reciprocal(gate, out=gate)
        np.multiply(reset, own_out, out=out)
        np.add(out, add_out, out=out)
        np.tanh(out, out=out)
        np.subtract(was, out, out=off)
        np.multiply(update, off, out=now)
        h = np.add(now, out, out=now)
    return states, before, gates, a[:, two:], m, apart, first, begins


def by_token(x: np.ndarray) -> np.ndarray:
    """An array of steps, numbers, lanes with a row for each step and lane."""
    return np.ascontiguousarray(x.transpose(0, 2, 1)).reshape(-1, x.shape[1])


def with_one(x: np.ndarray) -> np.ndarray:
    """by_token() with a one behind each row, for the bias in the weights' last row."""
    out = np.ones((x.shape[0], x.shape[2], x.shape[1] + 1), x.dtype)
    out[..., :-1] = x.transpose(0, 2, 1)
    return out.reshape(-1, out.shape[2])


def soft(logits: np.ndarray, target: np.ndarray, bounded: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural log-probability of the targets, and what the probabilities are in proportion to, with their sums. bounded: no exponential leaves a float's range as it is."""
    if not bounded:
        logits -= logits.max(axis=1, keepdims=True)
    log = logits[np.arange(len(target)), target]
    e = np.exp(logits, out=logits)
    s = e @ np.ones((e.shape[1], 1), e.dtype)
    return log - np.log(s[:, 0]), e, s


def bounded(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    """A bias less the most that a logit can be (of each softmax), and whether then no sum of exponentials is too small for a float: a state's units are within -1 and 1, so a logit is
    within the sum of its weights' sizes of its bias, and need not be compared with the others of its row."""
    most, safe = most_of(weights, bias)
    return bias - most, safe


def most_of(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    reach = np.abs(weights).sum(axis=-2)
    most = (bias + reach).max(axis=-1, keepdims=True)
    return most, bool(((bias - reach).max(axis=-1, keepdims=True) - most).min() > -60)


def limits(p: dict) -> tuple:
    """most_of() of the classes and of the words in them."""
    return *most_of(p["c"], p["cb"]), *most_of(p["w"], p["wb"])


def with_bias(p: dict, limits: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes, and of the words in each, with the bias less its limit as their last row."""
    return np.concatenate((p["c"], (p["cb"] - limits[0])[None])), np.concatenate((p["w"], (p["wb"] - limits[2])[:, None]), axis=1)


def by_class(classes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Places of softmax words among the targets in order of their classes, and where each class begins there, and the end."""
    order = np.argsort(classes.astype(np.int16), kind="stable")
    edge = np.searchsorted(classes[order], np.arange(HEADS + 1))
    return order[: edge[-1]], edge.tolist()


def in_classes(weights: np.ndarray, s: np.ndarray, edge: list[int], words: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """soft() of words in their classes; states (with a one behind, for the bias in the weights' last row) and words in order of the classes, which begin at edge."""
    logits = np.empty((len(s), WIDTH), s.dtype)
    for a, b, own in zip(edge, edge[1:], weights, strict=False):
        if a < b:
            s[a:b].dot(own, logits[a:b])
    return soft(logits, words, safe)


def score_texts(p: dict, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of each whole text's classes and softmax words; the state goes from window to window until the text ends."""
    out = np.zeros(len(texts))
    if not len(texts):
        return out
    *arrays, edges, dealt = side_by_side(texts, LANES)
    order = [i for own in dealt for i in own]
    arrays.append(np.repeat(np.array(order, np.int32), [len(texts[i][0]) + 1 for i in order]))
    length, h = np.diff(edges), np.zeros((len(dealt), UNITS), p["u"].dtype)
    most = limits(p)
    (outer, inner), (_, safe, _, safe_in) = with_bias(p, most), most
    for at in range(0, int(length[0]), SCORED):
        on = int((length > at).sum())
        time = np.arange(at, min(at + SCORED, int(length[0])))[:, None]
        real = time < length[:on]
        inputs, classes, words, doc = (x.take(edges[:on] + time, mode="clip") for x in arrays)  # what isn't real is of another lane
        states = forward(p, inputs, h[:on], False)[0]
        h = states[-1].T
        s, c, w, doc = with_one(states), classes.ravel(), words.ravel(), doc.ravel()
        if not real.all():
            real = real.ravel()
            s, c, w, doc = s[real], c[real], w[real], doc[real]
        log = np.empty(len(c))
        for k in range(0, len(c), TILE):
            tile = slice(k, k + TILE)
            log[tile] = soft(s[tile] @ outer, c[tile], safe)[0]
        order, edge = by_class(c)
        log[order] += in_classes(inner, s[order], edge, w[order], safe_in)[0]
        out += np.bincount(doc, log, len(out))
    return out / np.log(10)


def gradients(p: dict, inputs: np.ndarray, classes: np.ndarray, words: np.ndarray, h: np.ndarray, g: dict | None = None, most: tuple | None = None) -> tuple[dict, np.ndarray, float]:
    """Of the mean negative log-likelihood of a window (steps x lanes; class -1: nothing there): gradients (in g if it is given), the state after it, and the sum of the likelihood.
    most: limits() of these weights, or of what they were a little before."""
    kind, n, on = p["u"].dtype, *inputs.shape
    states, before, gates, an, m, apart, first, begins = forward(p, inputs, h)
    if g is None:
        g = {k: np.empty(s, kind) for k, s in SHAPES.items()}
    c, w, s, real = classes.ravel(), words.ravel(), with_one(states), None
    if len(c) and c.min() < 0:
        real = np.flatnonzero(c >= 0)
        s, c, w = s[real], c[real], w[real]
    share = kind.type(1 / max(1, len(c)))
    most = most or limits(p)
    outer, both = with_bias(p, most)
    log, e, sums = soft(s @ outer, c, most[1])
    total = float(log.sum())
    # The gradient of a logit is its probability, e / sums, less one at the target; the division by the sums is left to the narrower factor.
    e[np.arange(len(c)), c] -= sums[:, 0]
    per = share / sums
    slopes = (s * per).T @ e
    g["c"][...], g["cb"][...] = slopes[:UNITS], slopes[UNITS]
    ds = e @ p["c"].T
    ds *= per
    order, edge = by_class(c)
    inner, said = s.take(order, axis=0), w[order]
    log, e, sums = in_classes(both, inner, edge, said, most[3])
    total += float(log.sum())
    e[np.arange(len(said)), said] -= sums[:, 0]
    per = share / sums
    inner *= per
    back, slopes = np.empty((len(e), UNITS), kind), np.zeros_like(both)
    for a, b, slope, to in zip(edge, edge[1:], slopes, p["w"].transpose(0, 2, 1), strict=False):
        if a < b:
            own = e[a:b]
            inner[a:b].T.dot(own, slope)
            own.dot(to, back[a:b])
    g["w"][...], g["wb"][...] = slopes[:, :UNITS], slopes[:, UNITS]
    back *= per
    ds[order] += back
    if real is not None:
        ds, part = np.zeros((n * on, UNITS), kind), ds
        ds[real] = part
    d = np.ascontiguousarray(ds.reshape(n, on, UNITS).transpose(0, 2, 1))
    # What a step's gradient of its state (d, with what comes from the steps after) is multiplied by, for each gate; all but that gradient is known beforehand.
    z, r = gates[:, :UNITS], gates[:, UNITS:]
    inside = (1 - z) * (1 - m * m)
    factors = np.empty((n, 3, UNITS, on), kind)
    np.multiply(apart, z * (1 - z), out=factors[:, 0])
    np.multiply(inside, r, out=factors[:, 2])
    np.multiply(factors[:, 2], an * (1 - r), out=factors[:, 1])
    da, dh = np.empty((n, 3, UNITS, on), kind), np.zeros((UNITS, on), kind)
    flat, held, u = da.reshape(n, 3 * UNITS, on), np.empty_like(dh), p["u"]
    for now, factor, own, row, update, begin, goes in zip(d[::-1], factors[::-1], da[::-1], flat[::-1], z[::-1], begins[::-1], first[::-1], strict=True):
        np.add(now, dh, out=now)
        np.multiply(now, factor, out=own)
        u.dot(row, dh)
        np.multiply(now, update, out=held)
        np.add(dh, held, out=dh)
        if begin:
            np.multiply(dh, goes, out=dh)
    np.add.reduce(before @ flat.transpose(0, 2, 1), axis=0, out=g["u"])
    np.multiply(d, inside, out=da[:, 2])
    seen = inputs.ravel().astype(np.int16, copy=False)
    order = np.argsort(seen, kind="stable")
    seen = seen[order]
    edge = np.concatenate(([0], np.flatnonzero(seen[1:] != seen[:-1]) + 1))
    g["x"][...] = 0
    pairs = by_token(flat).take(order, axis=0).view(f"c{2 * kind.itemsize}")  # reduceat() goes by columns, so two numbers at a time take half the time
    g["x"][seen[edge]] = np.add.reduceat(pairs, edge, axis=0).view(kind)
    return g, states[-1].T, total


def train_texts(p: dict, texts: list[tuple[np.ndarray, np.ndarray]], least: int, most: int, rate: float, side: int = 64) -> tuple[dict, int]:
    """Weights after going over texts once, or so often that `least` steps are made, `most` times at most; and the tokens gone over in one pass.

    The texts, one after the other, are cut into lanes of one length, whatever theirs, so that each window is full; the state goes on from window to window.
    """
    if not texts:
        return p, 0
    inputs, classes, words, _ = lanes(texts, 1)[0]
    n = len(inputs)
    side = max(1, min(side, n // (4 * WINDOW)))
    length = -(-n // side)
    windows = -(-length // WINDOW)
    table = np.stack([np.concatenate((x, np.full(side * length - n, fill, x.dtype))).reshape(side, length).T for x, fill in ((inputs, START), (classes, -1), (words, 0))])
    # All weights, their gradients and the two moments (here of the gradients' sums, not means: by 10 and by 100 more) are one row of floats each, so that a step is a few operations.
    flat = _flat(p)
    p, grads = _shaped(flat), np.zeros_like(flat)
    g, rows, k = _shaped(grads), (grads, flat, np.zeros_like(flat), np.zeros_like(flat)), 0
    held = np.empty(PART, np.float32)
    parts = [(*(x[a : a + PART] for x in rows), held[: len(flat) - a]) for a in range(0, len(flat), PART)]
    # A step moves a weight by 2.4 times the rate at most and a logit, of 17 weights, by 41 times it, so that of limits some steps old no float goes out of range either.
    anew = max(1, int(0.32 / rate))
    for _ in range(min(most, max(1, -(-least // windows)))):
        h = np.zeros((side, UNITS), np.float32)
        for at in range(0, length, WINDOW):
            if k % anew == 0:
                limit = limits(p)
            h = gradients(p, *(x[at : at + WINDOW] for x in table), h, g, limit)[1]
            k += 1
            size = np.sqrt(float(grads @ grads))
            now = rate * min(1.0, k / 20) * np.sqrt(1 - 0.99**k)
            if size > 1:
                grads *= np.float32(1 / size)
            for x, own, m, v, held in parts:
                m *= np.float32(0.9)
                m += x
                v *= np.float32(0.99)
                np.multiply(x, x, out=held)
                v += held
                np.sqrt(v, out=held)
                held += np.float32(1e-7)
                np.divide(m, held, out=held)
                held *= np.float32(now)
                own -= held
    return p, n


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].astype(np.float32, copy=False).reshape(s)
        at += n
    return out


# ---------------------------------------------------------------- over a table


def count_words(texts: DataFrame, space: Workspace) -> DataFrame:
    """texts (t) -> (h, z, n): each distinct word of all texts by hash, its class of others, and how often it is there; counted in some batches before anything is shuffled."""

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        hashes, z = (np.concatenate(x) for x in zip(*held, strict=True))
        hashes, first, n = np.unique(hashes, return_index=True, return_counts=True)
        return pd.DataFrame({"h": hashes.view(np.int64), "z": z[first], "n": n})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            hashes, z, _ = tokens(list(batch["t"]))
            held.append((hashes, z))
            size += len(hashes)
            if size >= TOGETHER:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    rows = texts.select("t").mapInPandas(count, "h long, z int, n long")
    return space.write(rows.groupBy("h").agg(F.min("z").alias("z"), F.sum("n").alias("n")), "words")


def vocabulary(words: DataFrame, documents: int, listed: int) -> Vocabulary:
    """The most frequent words, `listed` at most: those above the least frequency that so few words reach (by steps of a sixteenth of a power of two)."""
    band = F.floor(F.log2("n") * 16).cast("int")
    bands = words.groupBy(band.alias("b")).agg(F.count("*").alias("types"), F.sum("n").alias("n")).collect()  # at most 64 * 16 rows
    types, total, seen, least = sum(r["types"] for r in bands), sum(r["n"] for r in bands), 0, 1 << 20
    for r in sorted(bands, key=lambda r: -r["b"]):
        seen += r["types"]
        if seen > listed:
            break
        least = r["b"]
    top = words.where(band >= least).select("h", "z", "n").toPandas()
    order = np.lexsort((top["h"], -top["n"]))
    number = np.full(len(top), -1)
    number[order[:WORDS]] = np.arange(min(WORDS, len(top)))
    heads = np.zeros(WORDS)
    heads[: min(WORDS, len(top))] = top["n"].to_numpy()[order[:WORDS]]
    sums = {r["z"]: (r["k"], r["n"]) for r in words.groupBy("z").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()}
    inside = top[number >= 0].groupby("z")["n"].agg(["count", "sum"]) if len(top) else pd.DataFrame(columns=["count", "sum"])
    rest = np.array([sums.get(z, (0, 0))[1] - (inside["sum"].get(z, 0)) + 0.1 * (sums.get(z, (0, 0))[0] - inside["count"].get(z, 0) + 1) for z in range(TAILS)], float)
    hashes = top["h"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hashes)
    return Vocabulary(hashes[by], top["n"].to_numpy(np.int64)[by], number[by], heads, rest, documents, total + documents, types + (documents > 0))


def fit(texts: DataFrame, known: Vocabulary, rounds: int, share: float, least: int, most: int, rate: float) -> dict[str, np.ndarray]:
    """Weights of the network. In each round every partition of the texts (t, k: a hash of the row) that are due goes over its own from the last round's weights, and the
    weights are averaged by tokens: so the work is the partitions', and what is gathered is a set of weights from each, summed by blocks."""
    spark, p = texts.sparkSession, known.weights()
    vocabulary_ = spark.sparkContext.broadcast(known.told())
    for r in range(rounds):
        start = spark.sparkContext.broadcast(p)
        speed = rate * 0.6**r

        def learn(batches: Iterator[pd.DataFrame], start=start, speed=speed) -> Iterator[pd.DataFrame]:
            now, seen, held, size = start.value, 0, [], 0

            def go(now, seen):
                after, n = train_texts(now, held, least, most, speed)
                return after, seen + n

            for batch in batches:
                hashes, other, edges = tokens(list(batch["t"]))
                number, other = vocabulary_.value.find(hashes)[1].astype(np.int16), other.astype(np.int16)
                held += [(number[a:b], other[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                size += len(hashes)
                if size >= TOGETHER:
                    now, seen = go(now, seen)
                    held, size = [], 0
            if held:
                now, seen = go(now, seen)
            if seen:
                flat = _flat(now).astype(np.float64) * seen
                cuts = range(0, len(flat), BLOCK)
                salt = int(abs(flat).sum()) % SALTS
                yield pd.DataFrame({"b": list(range(len(cuts))), "s": salt, "w": [flat[c : c + BLOCK].tobytes() for c in cuts], "n": float(seen)})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[int, int], list] = {}
            for batch in batches:
                for b, s, w, n in batch.itertuples(index=False):
                    own = sums.setdefault((b, s), [0.0, 0.0])
                    own[0] = own[0] + np.frombuffer(w, np.float64)
                    own[1] += n
            if sums:
                yield pd.DataFrame([(b, s, x.tobytes(), n) for (b, s), (x, n) in sums.items()], columns=["b", "s", "w", "n"])

        due = texts.where((F.col("k") >= int(r / rounds * share * (1 << 30))) & (F.col("k") < int((r + 1) / rounds * share * (1 << 30)))).select("t")
        fields = "b int, s int, w binary, n double"
        rows = due.mapInPandas(learn, fields).repartition("b", "s").mapInPandas(add, fields).collect()  # a set of weights for each salt
        blocks: dict[int, list] = {}
        for row in sorted(rows, key=lambda x: (x["b"], x["s"])):
            own = blocks.setdefault(row["b"], [0.0, 0.0])
            own[0], own[1] = own[0] + np.frombuffer(bytes(row["w"]), np.float64), own[1] + row["n"]
        if blocks:
            p = _shaped(np.concatenate([blocks[b][0] / blocks[b][1] for b in sorted(blocks)]))
    return p


def score(documents: DataFrame, listed: int = 1 << 17, rounds: int = 2, share: float = 1.0, least: int = 150, most: int = 6, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, of whole texts (null: empty), learning from those that aren't held out.

    A text is its words, A-Z as a-z, and one end. base_score is by counts of all training tokens alone. The model is a gated recurrent unit whose output is factored:
    a class, then a word in it. The WORDS most frequent words are in classes of WIDTH by frequency and told by a softmax; the others are in classes by their last bytes
    and are shared there by their counts; an unknown word is one more of its class, seen 0.1 times, and the end is a class of its own. So all counts are of all training
    documents, and the biases begin as their logarithms. The network's weights are fitted by truncated backpropagation on the whole texts of all training
    documents, each in one of the rounds, by a hash of id and text. (share: of how many; less is a choice of the caller's.) A partition with few texts goes over them
    again until it made `least` steps, `most` times at most. Scoring carries the state from window to window to the end of each text.

    Counts of the `listed` most frequent words go to each task; all other words of a text are joined with their counts by hash, whatever their number.
    Repeated rows get a row each, and the same score but for rounding; null ids count as held out. Empty table: no rows; without training documents N is 0 and every class that can be is as it
    begins. Other columns aren't read.
    """
    spark = documents.sparkSession
    space = Workspace(spark)
    text_batches(spark)
    d = documents.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    train = d.where(~held_out(F.col("i")))
    words = count_words(train, space)
    known = vocabulary(words, train.count(), listed)
    p = fit(train.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30))), known, rounds, share, least, most, rate)
    shared, model = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(p)
    base = float(np.log10(known.total + 0.1 * (known.types + 1)))

    fields = ["i", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, rows, texts, size = shared.value, [], [], 0
        end = np.log10(v.ends + 0.1) - base

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=fields)
            out["score"] += score_texts(model.value, texts)
            rows.clear()
            texts.clear()
            return out

        for batch in batches:
            hashes, other, edges = tokens(list(batch["t"]))
            here, number, logs = v.listed(hashes)
            total = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[edges])  # noqa: B023, E731
            known_, by_count = total(here), total(logs) - base * np.diff(edges) + end
            in_class = total(np.where(number < 0, logs - v.log_rest[other], 0))
            unlisted, short = hashes[~here].view(np.int64), (number.astype(np.int16), other.astype(np.int16))
            left = np.concatenate(([0], np.cumsum(~here)))[edges]
            for k, (i, held, a, b) in enumerate(zip(batch["i"], batch["held_out"], edges, edges[1:], strict=False)):
                rows.append((i, held, b - a + 1, int(known_[k]) + (v.ends > 0), by_count[k], in_class[k], unlisted[left[k] : left[k + 1]]))
                texts.append((short[0][a:b], short[1][a:b]))
            size += len(hashes)
            if size >= SCORED_TOGETHER:
                yield flush()
                size = 0
        if rows:
            yield flush()

    scored = d.select(F.col("i").cast("string").alias("i"), held_out(F.col("i")).alias("held_out"), "t").mapInPandas(run, "i string, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<long>")
    scored = space.write(scored.withColumn("k", F.monotonically_increasing_id()), "scored")
    # The words that aren't listed: each one's count by a join on its hash, then sums by text.
    rest = scored.select("k", F.explode("rest").alias("h")).join(words.select("h", "n"), "h", "left")
    rest = rest.groupBy("k").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("logs"), F.count("n").alias("known"))
    out, logs = scored.drop("rest").join(rest, "k", "left"), F.coalesce("logs", F.lit(0.0))
    return out.select(
        F.col("i").cast(d.schema["i"].dataType).alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"), (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
