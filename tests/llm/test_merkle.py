import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle


def brute(rows):
    order = sorted(((i, t or "", h) for i, t, h in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[2] if r[0] is None else 0, r[1]))
    order = [r[:2] for r in order]
    out = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        f, g, h = merkle.fingerprint(t), merkle.fingerprint(e), merkle.fingerprint(n)
        out.append((i, len(t), sha256(e.encode()).hexdigest(), f, g, merkle.likeness(f, g), merkle.likeness(f, h)))
    return out


key = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("range_bytes", [8 << 20, 700])
def test_against_brute_force(clash, range_bytes):
    rows = [tuple(r) for r in clash.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    got = [tuple(r) for r in merkle.compare_neighbours(clash, range_bytes).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_one_document_and_none(spark, empty):
    assert merkle.compare_neighbours(empty).collect() == []
    r = merkle.compare_neighbours(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0 and r[0]["edited_sha256"] == sha256(b"abcdab").hexdigest()


def test_roots_and_edits():
    rng = random.Random(1)
    sentence = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(12)) + "."
    sections = [[sentence() for _ in range(4)] for _ in range(5)]
    text = "\n\n".join("\n".join(s) for s in sections)
    a = merkle.fingerprint(text)
    assert a == merkle.fingerprint(text) and merkle.likeness(a, a) == 1
    sections[2][1] = sentence()
    b = merkle.fingerprint("\n\n".join("\n".join(s) for s in sections))
    assert merkle.differing(a, b) == [(2, 1)] and merkle.differing(a, a) == []
    assert 0.9 < merkle.likeness(a, b) < 1
    assert merkle.likeness(a, merkle.fingerprint("\n".join(sentence() for _ in range(20)))) < 0.02
    assert merkle.fingerprint("a  b") != merkle.fingerprint("a b") and merkle.fingerprint(None) == merkle.fingerprint("")
    assert merkle.likeness(merkle.fingerprint(""), a) == 0


def test_every_word_is_in_one_leaf():
    rng = random.Random(2)
    for _ in range(50):
        p = "".join(rng.choice("ab .!? \t") for _ in range(rng.randrange(60)))
        assert "".join(merkle.RUN.findall(p)) == p == "".join(merkle.leaves_of(p, True))


def by_hand(text):
    """The tree of a text, built from the rules alone."""
    import base64
    import hashlib
    import re

    d = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    s = lambda b, n: base64.urlsafe_b64encode(b).decode()[:n]
    sections = []
    for section in re.split(r"\n[ \t]*(?:\n[ \t]*)+", text):
        paragraphs = []
        for p in section.split("\n"):
            words, runs = re.findall(r"\s+|\S+\s*", p), []
            if len(text.split()) <= 16:
                runs = words
            else:
                for w in words:
                    if not runs or w.isspace() or runs[-1].isspace() or len(runs[-1].split()) == 8 or re.search(r"[.!?]\s+$", runs[-1]):
                        runs.append("")
                    runs[-1] += w
            leaves = [d(r.encode()) for r in runs]
            paragraphs.append((d(b"".join(leaves)), "".join(s(x, 4) for x in leaves)))
        sections.append((d(b"".join(p for p, _ in paragraphs)), paragraphs))
    root = d(d(text.encode()) + b"".join(x for x, _ in sections))
    return "/".join([s(root, 24), *(":".join([s(x, 12), *(f"{s(p, 12)}={leaves}" for p, leaves in ps)]) for x, ps in sections)])


def test_trees_by_hand():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "c", " ", "  ", "x.", "y! ", "\n", "\n\n", "\n \n", "d e f g h i j k l m n o p q r s t u v w"]) for _ in range(rng.randrange(25)))
        assert merkle.fingerprint(text) == by_hand(text)
    a, b = "one two three four five six", "one two three four five two"
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) > 0.6


def test_many_null_ids(spark):
    rows = [(None, f"text {k % 40} " * 20) for k in range(300)] + [(k, f"some {k}") for k in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = [tuple(r) for r in d.select("doc_id", "text", F.xxhash64("text")).collect()]
    got = [tuple(r) for r in merkle.compare_neighbours(d, 3000).collect()]
    assert sorted(got, key=key) == sorted(brute(hashed), key=key)


def test_an_id_that_a_third_of_the_rows_have(spark):
    rng = random.Random(3)
    rows = [(7 if k % 3 == 0 else k, " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(1, 20)))) for k in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashed = [tuple(r) for r in d.select("doc_id", "text", F.xxhash64("text")).collect()]
    order = sorted(hashed, key=lambda r: (-r[0], r[2], r[1]))
    want = sorted((a[0], len(a[1]), sha256((a[1][: len(a[1]) - len(a[1]) // 3] + b[1][: len(a[1]) // 3]).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1], strict=True))
    out = merkle.compare_neighbours(d, 400)
    assert sorted(tuple(r)[:3] for r in out.collect()) == want
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 60 and len(sizes) > 30  # in one range they would be 300
