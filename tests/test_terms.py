import random

import pytest
from pyspark.sql import functions as F

from quire.operators import quality as Q
from quire.operators import terms as T
from quire.plans import fixtures


def test_longest_first_by_brute_force(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(15)})
    texts = [(k, "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 25)))) for k in range(40)]
    want = []
    for k, t in texts:
        hits = sorted(((-len(w), p, w) for w in words for p in range(len(t)) if t.startswith(w, p)))
        taken = set()
        for n, p, w in hits:
            if not taken & set(range(p, p - n)):
                taken |= set(range(p, p - n))
                want.append((k, p, w))
    d = spark.createDataFrame(texts, "id long, text string")
    s = spark.createDataFrame([(w,) for w in words], "surface string")
    for most in (200_000, 0):
        assert sorted(map(tuple, T.locked_matches(d, ["id"], "text", s, most).collect())) == sorted(want)


def entries(spark, *more):
    return spark.createDataFrame([*fixtures.ENTRIES, *more], fixtures.SCHEMA)


def test_dictionary_rules(spark):
    assert T.dictionary_problems(entries(spark)).collect() == []
    bad = entries(spark, ("邱途", "x", "character", "male", "locked", []), ("丙 ", "y", "place", "male", "open", [("丙 ", "y")]), ("丁", "z", "term", "male", "locked", [("甲乙", "q")]))
    assert {(r["source"], r["problem"]) for r in T.dictionary_problems(bad).collect()} == {
        ("邱途", "duplicate source"), ("邱途", "duplicate alias"), ("邱途", "several owners"), ("丙 ", "unknown type"), ("丙 ", "empty or untrimmed text"), ("丙 ", "duplicate alias"),
        ("丁", "gender of a non-character"), ("甲乙", "several owners"),
    }


def test_migration_and_merge(spark):
    old = spark.createDataFrame([("青云门", "QY", "faction", None, "locked", []), ("甲", "A", "character", None, "locked", [])], fixtures.SCHEMA)
    new, log = T.migrate(old, 7)
    assert {r["source"]: (r["type"], r["gender"]) for r in new.collect()} == {"青云门": ("institution", "not_applicable"), "甲": ("character", "unknown")}
    assert {(r["source"], r["field"], r["now"]) for r in log.collect()} == {("青云门", "type", "institution"), ("青云门", "gender", "not_applicable"), ("甲", "gender", "unknown"), (None, "version", "10")}
    raw = spark.createDataFrame([("李青云来了",)], "text string")
    add = spark.createDataFrame([("李青云", "L", "character", "male", "locked", [])], fixtures.SCHEMA)
    merged, problems = T.merge_entries(entries(spark), add, raw)
    assert problems.collect() == [] and merged.count() == 4
    add = spark.createDataFrame([("王小二", "W", "character", "male", "locked", []), ("李青云", "L", "character", "male", "locked", [("邱途", "q")])], fixtures.SCHEMA)
    merged, problems = T.merge_entries(entries(spark), add, raw)
    assert merged.count() == 3 and ("王小二", "unattested") in {tuple(r) for r in problems.collect()}


@pytest.mark.parametrize("source,problem", [("他们", "pronoun, generic role, or non-Chinese source"), ("abc", "pronoun, generic role, or non-Chinese source"), ("李", "contextual/action fragment"), ("李青说", "contextual/action fragment"), ("不是吗", "sentence fragment"), ("拿起长剑", "verb phrase"), ("那少年郎", "contextual/action fragment"), ("李青云", None), ("天龙集团", None)])
def test_source_problem(spark, source, problem):
    assert spark.createDataFrame([(source,)], "s string").select(T.source_problem(F.col("s"))).first()[0] == problem


def test_best_evidence(spark):
    rows = [("s", c, f"t{c}-{k}" + "x" * k, k) for c in range(8) for k in range(3)] + [("q", 1, "a", 0), ("q", 1, "a", 1), ("q", None, "b", 2)]
    got = T.best_evidence(spark.createDataFrame(rows, "source string, chapter long, sentence string, position long")).collect()
    s = sorted((r["chapter"], r["sentence"]) for r in got if r["source"] == "s")
    assert [c for c, _ in s] == [0, 1, 2, 3, 7] and all(t.endswith("xx") for _, t in s)
    assert len([r for r in got if r["source"] == "q"]) == 2


def test_counts(spark):
    a = spark.createDataFrame([("s", 1, 3), ("s", 2, 1), ("s", None, 2)], "source string, chapter long, n long")
    b = spark.createDataFrame([("s", 1, 2), ("s", 3, 4), ("s", None, 5)], "source string, chapter long, n long")
    assert {(r["chapter"], r["n"]) for r in T.merge_counts(a, b).collect()} == {(1, 3), (2, 1), (3, 4), (None, 7)}
    assert {(r["chapter"], r["n"]) for r in T.merge_counts(a, b, False).collect()} == {(1, 3), (2, 1), (3, 4), (None, 5)}
    s = spark.createDataFrame([("s", 7, [4, 2, 9])], "source string, occurrences long, chapters array<long>")
    assert sorted((r["chapter"], r["n"]) for r in T.spread_legacy(s).collect()) == [(2, 3), (4, 2), (9, 2)]
    c = spark.createDataFrame([("k", i, "x" * n) for i, n in enumerate([5, 5, 30, 1])], "k string, i long, j string")
    assert [r["batch"] for r in T.batches(c, ["k"], "i", "j", 10).orderBy("i").collect()] == [0, 0, 1, 2]


def test_not_owned(spark):
    f = spark.createDataFrame([("ab",), ("abc",), ("x",)], "source string")
    o = spark.createDataFrame([("zabz",), ("x",)], "surface string")
    assert [r[0] for r in T.not_owned(f, o).collect()] == ["abc"]


def test_structural_findings(spark):
    e = spark.createDataFrame([(c, k, f"P{k}") for c in (1, 2, 3) for k in (1, 2)], "chapter long, pos long, id string")
    a = spark.createDataFrame([(1, 1, "P2", "x"), (1, 2, "P1", "y"), (2, 1, "P1", " "), (2, 2, "P1", "z"), (2, 3, "P9", "z"), (3, 1, "P1", "x"), (3, 2, "P2", "x")], "chapter long, pos long, id string, text string")
    got = {tuple(r) for r in Q.structural(e, a).collect()}
    assert got == {(1, None, "out_of_order_id"), (2, "P1", "duplicate_id"), (2, "P2", "missing_id"), (2, "P9", "unexpected_id"), (2, "P1", "empty_segment")}


def test_segment_rules(spark):
    long = "这是一个很长的句子，里面有很多内容，而且还有更多。" * 3
    rows = [("wrap", "原文。", "# x."), ("han", "原文。", "có 中 đây."), ("copy", "x" * 81, "a " + "x" * 81), ("num", "有12人。", "có 13 người."), ("cut", "他走了，然后他又回来了，再也没有离开过这里了。", "Anh ấy đã đi và"), ("ok", "他说。", "Anh nói."), ("empty", "文", " "), ("short", long, "Ngắn.")]
    d = spark.createDataFrame([(1, k, r, t) for k, r, t in rows], "chapter long, id string, raw string, text string")
    m = spark.createDataFrame([(1, "ok", "他", "ANH"), (1, "han", "文", "văn")], "chapter long, id string, surface string, target string")
    got = {(r["id"], r["kind"]) for r in Q.segment_findings(d, m).collect()}
    assert got == {("wrap", "malformed_wrapper"), ("han", "chinese_residue"), ("copy", "raw_copied"), ("num", "numeric_mismatch"), ("cut", "obvious_truncation"), ("empty", "empty_segment"), ("short", "suspicious_truncation"), ("han", "locked_term_missing")}


def test_lengths_duplicates_repairs(spark):
    p = spark.createDataFrame([(1, 1, "a", "r" * 100, "t" * 20), (1, 2, "b", "q" * 100, "t" * 20), (2, 1, "c", "r" * 50, "t" * 50), (2, 2, "d", "s" * 50, "t" * 50)], "chapter long, pos long, id string, raw string, text string")
    assert {r["id"] for r in Q.length_findings(p).collect()} == {"a", "b"}
    base = spark.createDataFrame([(3.0,)] * 5, "ratio double")
    assert {r["id"] for r in Q.length_findings(p, baseline=base).collect()} == {"a", "b", "c", "d"}
    assert {r["id"] for r in Q.duplicate_outputs(p).collect()} == {"d"}
    r = spark.createDataFrame([(1, "P1", "他说。", "Anh nói rất nhiều điều (thật).", "Anh")], "chapter long, id string, raw string, original string, text string")
    assert {"repair_content_loss", "repair_unterminated"} <= {x["kind"] for x in Q.repair_findings(r).collect()}


def test_local_findings_stop_at_structure(spark):
    e = spark.createDataFrame([(1, 1, "P1", "甲。"), (2, 1, "P1", "有1人。")], "chapter long, pos long, id string, raw string")
    a = spark.createDataFrame([(1, 1, "P9", "中"), (2, 1, "P1", "có 2 người.")], "chapter long, pos long, id string, text string")
    t = spark.createDataFrame([(2, "C2", "题", "Chương 2: x")], "chapter long, id string, raw string, text string")
    got = {(r["chapter"], r["kind"]) for r in Q.local_findings(e, a, t).collect()}
    assert {(1, "missing_id"), (1, "unexpected_id"), (2, "numeric_mismatch"), (2, "malformed_title_wrapper")} <= got and (1, "chinese_residue") not in got
    soft, hard = Q.split_soft(Q.local_findings(e, a, t))
    assert soft.count() + hard.count() == Q.local_findings(e, a, t).count() == 5
