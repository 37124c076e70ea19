import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.llm import language_model as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [*WORD.findall((text or "").translate(SMALL)), None]


def plain(rows):
    toks = [words_of(t) for _, t, *_ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, *_ in rows]
    c = Counter(w for ws, h in zip(toks, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for ws in toks]
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, pytest.approx(b, rel=1e-9)) for (i, *_), h, ws, b in zip(rows, held, toks, base, strict=True)]


def small_vocabulary(rng):
    n = 3000
    counts = np.sort(rng.integers(1, 500, n))[::-1]
    return L.Vocabulary(np.arange(1, n + 1).astype(np.uint64), counts, np.where(np.arange(n) < L.WORDS, np.arange(n), -1), counts[: L.WORDS].astype(float), rng.uniform(1, 900, L.TAILS), 50, int(counts.sum()) + 50, n + 1)


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in small_vocabulary(rng).weights().items()}
    texts = [(rng.integers(-1, L.WORDS, n).astype(np.int32), rng.integers(0, L.TAILS, n).astype(np.int32)) for n in (5, 9, 3)]
    side = L.lanes(texts, 2)
    n = max(len(x[0]) for x in side)
    table = [np.full((n, 2), fill, np.int32) for fill in (L.START, -1, 0)]
    for k, lane in enumerate(side):
        for to, of in zip(table, lane[:3], strict=True):
            to[: len(of), k] = of
    loss = lambda q: -L.gradients(q, *table, np.zeros((2, L.UNITS)))[2] / (table[1] >= 0).sum()
    g, _, total = L.gradients(p, *table, np.zeros((2, L.UNITS)))
    assert L.score_texts(p, texts).sum() == pytest.approx(total / math.log(10), rel=1e-5)
    for name in p:
        for at in rng.choice(np.flatnonzero(np.abs(g[name].ravel()) > 1e-6), 4):
            i, up, down = np.unravel_index(at, p[name].shape), {k: x.copy() for k, x in p.items()}, {k: x.copy() for k, x in p.items()}
            up[name][i] += 1e-4
            down[name][i] -= 1e-4
            assert (loss(up) - loss(down)) / 2e-4 == pytest.approx(g[name][i], rel=2e-2, abs=1e-6)


def test_probabilities_of_all_that_may_follow_add_up_to_one():
    rng = np.random.default_rng(1)
    v = small_vocabulary(rng)
    p = {k: x + (rng.standard_normal(x.shape) * 0.2).astype(np.float32) for k, x in v.weights().items()}
    said = rng.integers(-1, L.WORDS, 6).astype(np.int32), rng.integers(0, L.TAILS, 6).astype(np.int32)
    # After these words: the end, each word of the softmax, each class of others (whose words and one unknown word share it).
    h = np.zeros((1, L.UNITS), np.float32)
    for x in [L.START, *np.where(said[0] >= 0, said[0], L.WORDS + said[1])]:
        h = L.step(p, p["x"][[x]], h)[0]
    classes = np.exp([float(L.soft(h @ p["c"] + p["cb"], np.array([k]))[0][0]) for k in range(L.CLASSES)])
    inside = [np.exp([float(L.soft(h @ p["w"][k] + p["wb"][k], np.array([w]))[0][0]) for w in range(L.WIDTH)]).sum() for k in range(L.HEADS)]
    assert classes.sum() == pytest.approx(1, rel=1e-5) and inside == pytest.approx([1] * L.HEADS, rel=1e-5)
    assert L.score_texts(p, [said])[0] == pytest.approx(np.log10(classes[L.END]) + L.score_texts(p, [said])[0] - np.log10(classes[L.END]))


def test_untrained_weights_are_the_counts(spark, documents):
    """Before it is trained the network gives every token its frequency, but for what is added to counts."""
    rows = [tuple(r) for r in documents.collect()]
    out = {(r["doc_id"], r["n_tokens"]): r for r in L.score(documents, rounds=0).collect()}
    for i, _, n, *_, base in plain(rows):
        assert out[i, n]["score"] == pytest.approx(base.expected, rel=0.05)


def test_state_goes_over_windows_and_not_over_texts():
    rng = np.random.default_rng(2)
    v = small_vocabulary(rng)
    p = v.weights()
    texts = [(rng.integers(-1, L.WORDS, n).astype(np.int32), rng.integers(0, L.TAILS, n).astype(np.int32)) for n in (1, 40, 400, 0, 33, 32, 31, 1000)]
    together, alone = L.score_texts(p, texts), [L.score_texts(p, [t])[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-4)


def test_tokens():
    texts = ["Ab aB  ab", None, "", " \t", "zürich ZÜRICH", "A" * 30]
    h, z, e = L.tokens(texts)
    assert list(np.diff(e)) == [3, 0, 0, 0, 2, 1]
    assert len(set(h[:3])) == len(set(z[:3])) == 1 and h[3] != h[4]  # only A-Z are lowered
    assert h[5] == L.tokens(["a" * 30])[0][0] and len(L.tokens([])[2]) == 1


def test_counts_are_exact(spark, documents, clash):
    rows = sorted(map(tuple, documents.collect()), key=str)
    key = lambda r: (str(r[0]), r[2], r[1])
    want = sorted(plain(rows), key=key)
    for d, listed in ((documents, 1 << 17), (documents, 3), (clash, 20)):  # few listed words: the others' counts are joined
        got = sorted((tuple(r)[:6] for r in L.score(d, listed=listed, rounds=1).collect()), key=key)
        assert got == want
    assert L.score(documents, rounds=1).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_listed_words_or_joined_ones_score_alike(documents):
    a, b = ({(r["doc_id"], r["n_tokens"]): r["score"] for r in L.score(documents, listed=n, rounds=0).collect()} for n in (1 << 17, 1100))
    assert a == pytest.approx(b, rel=1e-6)


def test_empty_tables(spark, empty):
    assert L.score(empty).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = L.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert r["held_out"] and (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0


def test_it_learns(spark):
    """Two invented languages: a text's language is known after its first words, so held-out texts score above their words' frequencies."""
    rng = random.Random(4)
    words = {k: [f"{k}{rng.choice('aeiou')}{i}" for i in range(300)] for k in "xy"}
    rows = [(i, " ".join(words["xy"[i % 2]][int(rng.random() ** 2 * 300)] for _ in range(120))) for i in range(500)]
    out = L.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), share=1.0).where("held_out")
    r = out.agg(F.sum("base_score").alias("base"), F.sum("score").alias("score"), F.sum("n_tokens").alias("n")).first()
    assert (r["score"] - r["base"]) / r["n"] > 0.2  # of the 0.3 that a bit is


def test_all_training_documents_are_learnt_from(spark, monkeypatch):
    import inspect

    seen = []
    monkeypatch.setattr(L, "fit", lambda texts, known, rounds, share, *a: seen.append((texts.count(), share)) or known.weights())
    d = spark.range(50).selectExpr("id as doc_id", "concat('a b ', id) as text")
    L.score(d)
    assert seen == [(d.where("crc32(cast(doc_id as string)) % 10 <> 0").count(), 1.0)] and inspect.signature(L.score).parameters["share"].default == 1.0


def test_a_window_at_once_is_step_after_step():
    rng = np.random.default_rng(3)
    v = small_vocabulary(rng)
    p, on = v.weights(), 5
    inputs = rng.integers(0, L.INPUTS, (L.WINDOW, on))
    inputs[4, 2] = inputs[9, :] = L.START
    h = rng.standard_normal((on, L.UNITS)).astype(np.float32) * 0.5
    states = L.forward(p, inputs, h)[0]
    for t in range(L.WINDOW):
        h = L.step(p, p["x"][inputs[t]], h * (inputs[t] != L.START).astype(np.float32)[:, None])[0]
        assert states[t].T == pytest.approx(h, abs=1e-5)
    # No row is compared with itself for its greatest logit unless a float could not hold the exponentials: then the outcome is the same as with it.
    w, bias = p["c"] * 5000, p["cb"]
    assert L.bounded(p["c"], bias)[1] and not L.bounded(w, bias)[1]
    for weights in (p["c"], w):
        less, safe = L.bounded(weights, bias)
        want = L.soft(h @ weights + bias, np.arange(on))[0]
        assert L.soft(h @ weights + less, np.arange(on), safe)[0] == pytest.approx(want, rel=1e-4, abs=1e-4)
    hashes = rng.integers(0, 3500, 500).astype(np.uint64)
    assert len(v.told().hashes) == L.WORDS and (v.told().find(hashes)[1] == v.find(hashes)[1]).all()


def test_a_word_is_found_without_a_search(monkeypatch):
    """Steps to a listed word don't grow with the list, as they did when it was searched through by halves."""
    rng = np.random.default_rng(5)
    hashes = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    hashes[:3], hashes[-1] = (0, 1, 2), (1 << 64) - 1  # neighbours, and the ends
    counts, number = rng.integers(1, 90, len(hashes)), np.where(np.arange(len(hashes)) % 5 == 0, np.arange(len(hashes)) // 5, -1)
    v = L.Vocabulary(hashes, counts, number, np.ones(L.WORDS), np.ones(L.TAILS))
    asked = np.concatenate((hashes, hashes + np.uint64(1), rng.integers(0, 1 << 64, 5000, dtype=np.uint64)))
    where = {int(h): k for k, h in enumerate(hashes)}
    at = [where.get(int(h), -1) for h in asked]
    monkeypatch.setattr(np, "searchsorted", None)
    got, (here, n, logs) = v.find(asked), v.listed(asked)
    assert got[0].tolist() == [counts[k] if k >= 0 else -1 for k in at] and got[1].tolist() == n.tolist() == [number[k] if k >= 0 else -1 for k in at]
    assert here.tolist() == [k >= 0 for k in at] and logs == pytest.approx([math.log10(counts[k] + 0.1) if k >= 0 else 0 for k in at])
    monkeypatch.undo()
    none = L.Vocabulary(hashes[:0], counts[:0], number[:0], np.zeros(L.WORDS), np.ones(L.TAILS)).listed(asked)
    assert not none[0].any() and (none[1] == -1).all() and not none[2].any()


def test_scoring_keeps_no_more_than_states_and_training_no_limits_anew():
    rng = np.random.default_rng(6)
    p = small_vocabulary(rng).weights()
    inputs = rng.integers(0, L.INPUTS, (L.WINDOW, 7))
    inputs[5, 1:3] = L.START
    h = rng.standard_normal((7, L.UNITS)).astype(np.float32) * 0.5
    whole, states = L.forward(p, inputs, h), L.forward(p, inputs, h, False)
    assert (states[0] == whole[0]).all() and all(len(x) == 1 for x in states[1:6])
    # Limits of the weights some steps before give the same gradients.
    classes = rng.integers(0, L.CLASSES, inputs.shape)
    words = np.where(classes < L.HEADS, rng.integers(0, L.WIDTH, inputs.shape), 0)
    old = L.limits({k: x + (rng.standard_normal(x.shape) * 0.2).astype(np.float32) for k, x in p.items()})
    a, b = L.gradients(p, inputs, classes, words, h), L.gradients(p, inputs, classes, words, h, None, old)
    assert a[2] == pytest.approx(b[2], rel=1e-4)
    for k in p:
        assert a[0][k] == pytest.approx(b[0][k], rel=1e-3, abs=1e-5)


def test_texts_side_by_side_are_whole():
    rng = np.random.default_rng(7)
    texts = [(rng.integers(-1, L.WORDS, n), rng.integers(0, L.TAILS, n)) for n in (0, 3, 0, 50, 1, 7, 7)]
    side = L.lanes(texts, 3)
    assert sorted(i for *_, own in side for i in own) == list(range(len(texts))) and [len(x[0]) for x in side] == sorted((len(x[0]) for x in side), reverse=True)
    for inputs, classes, words, own in side:
        want = []
        for i in own:
            before = L.START
            for number, other in zip(*texts[i], strict=True):
                want.append((before, number // L.WIDTH, number % L.WIDTH) if number >= 0 else (before, L.HEADS + other, 0))
                before = number if number >= 0 else L.WORDS + other
            want.append((before, L.END, 0))
        assert list(zip(inputs, classes, words, strict=True)) == want


def test_class_of_others_is_of_the_last_bytes_of_the_word_alone():
    words = ["x", "Xy", "xyz", "axyz", "é", "\0", "a\0\0"]
    z = L.tokens([" ".join(words)])[1]
    assert [L.tokens([w])[1][0] for w in words] == z.tolist() and z[2] == z[3]
    for w, k in zip(words, z, strict=True):
        last = int.from_bytes(w.translate(SMALL).encode()[-3:].rjust(3, b"\0"), "little")
        assert k == L.mix(np.array([last + 1], np.uint64))[0] % np.uint64(L.TAILS)
