import itertools
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from quire.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """The audit by going over every order and document."""
    quality, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        if i is not None:
            quality[i] |= q == 1
            toxic[i] |= t == 1
    docs = [(i, s or "", t or "") for i, t, _, s, _ in rows]
    masks = []
    for i, s, t in docs:
        w = WORD.findall(t)
        copy = i is not None and any(j is not None and j < i and u == t for j, _, u in docs)
        masks.append((s, [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy], quality[i], toxic[i]))
    out, total = {}, defaultdict(int)
    for part in {s for s, *_ in masks}:
        for order in itertools.permutations("ABCDE"):
            left = [m for m in masks if m[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                k = "ABCDE".index(x)
                now = [m for m in left if m[1][k]]
                redundant = sum(m[1][k] for m in gone)
                left, gone = [m for m in left if not m[1][k]], gone + now
                alone = sum(m[0] == part and m[1][k] and sum(m[1]) == 1 for m in masks)
                out[part, "".join(order), step] = (len(left), len(now), redundant, alone, sum(m[2] for m in now), sum(m[3] for m in now))
                total[part, x] += len(now)
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def got(df):
    return {(r[0], r[1], r[2]): tuple(r)[3:] for r in df.collect()}


LABELS = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 44, 2)] + [(4, 1, 0), (6, None, None), (None, 1, 1), (999, 1, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_every_order_by_hand(spark, documents, labels):
    rows = [tuple(r) for r in documents.collect()]
    marked = [(*r[:1], (r[1] or "") + (" #" if k % 7 == 0 else "") + (" ABC" * 40 if k % 11 == 0 else ""), *r[2:]) for k, r in enumerate(rows)]
    d = spark.createDataFrame(marked, documents.schema)
    assert got(filter_audit.audit(d, labels)) == plain(marked, LABELS)


def test_clashing_columns(clash, documents, labels):
    assert got(filter_audit.audit(clash.withColumns({c: F.lit("q") for c in ("part", "mask", "h1", "h2", "cells", "step")}), labels)) == got(filter_audit.audit(documents, labels))


def test_empty(empty, documents, labels):
    assert filter_audit.audit(empty, labels).count() == 0
    a = got(filter_audit.audit(documents, labels.limit(0)))
    assert a and all(v[4] == v[5] == 0 for v in a.values())


def test_a_text_in_most_rows(spark, labels):
    rows = [(i, "the same text" if i % 3 else f"one {i}", None, "a", 1) for i in range(600)] + [(5, "the same text", None, "b", 1), (1, "the same text", None, "b", 1)]
    r = got(filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), labels))
    assert r["a", "EABCD", 1][1] == 399 and r["b", "EABCD", 1][1] == 1  # the row of id 1 has no smaller one


def test_limit_is_put_back(spark, documents, labels):
    filter_audit.audit(documents, labels)
    assert spark.conf.get(filter_audit.ROW_LIMIT, None) is None
    spark.conf.set(filter_audit.ROW_LIMIT, "77")
    try:
        filter_audit.audit(documents, labels)
        assert spark.conf.get(filter_audit.ROW_LIMIT) == "77"
    finally:
        spark.conf.unset(filter_audit.ROW_LIMIT)
