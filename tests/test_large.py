"""Operators that are made for large groups: chains, running medians, dictionaries, parsing in the row, digests, locale orders."""

import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quire.functions import canonical
from quire.operators import corpus, library, stats, terms
from quire.plans import fixtures
from quire.scratch import Tables
from quire.sources import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


# ---------------------------------------------------------------- chains


def walk(nexts, start):
    seen = []
    while start in nexts and start not in seen:
        seen.append(start)
        start = nexts[start]
    return seen, "end" if start is None else "loop" if start in seen else "missing"


def test_follow_by_walking(spark):
    rng = random.Random(1)
    for trial in range(1):
        n = 40
        nexts = {f"p{k}": rng.choice([None, f"p{rng.randrange(n + 4)}", f"p{k + 1}", f"p{k + 1}", f"p{k + 1}"]) for k in range(n)}
        starts = [(c, f"p{rng.randrange(n)}") for c in range(12)] + [(None, "p3"), (99, "nowhere"), (5, "p0")][: 3 - trial]
        links = spark.createDataFrame(list(nexts.items()) + [("p1", nexts["p1"]), (None, "p2")], "url string, next string")
        start = spark.createDataFrame(starts, "chapter long, url string")
        got = {}
        for r in registry.follow(links, start).orderBy("n").collect():
            got.setdefault(r["chapter"], []).append(r["url"])
        want = {c: walk(nexts, u) for c, u in starts}
        assert got == {c: w[0] for c, w in want.items() if w[0]}
        ends = {r["chapter"]: (r["parts"], r["last"], r["ended"]) for r in registry.chain_ends(links, start).collect()}
        assert ends == {c: (len(w), w[-1], e) for c, (w, e) in want.items() if w}


def test_a_chain_of_a_thousand_pages_takes_ten_rounds(spark, monkeypatch):
    written = []
    keep = Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, df: written.append(df.columns) or keep(self, df))
    links = spark.createDataFrame([(f"u{k}", f"u{k + 1}" if k < 999 else None) for k in range(1000)], "url string, next string")
    out = registry.follow(links, spark.createDataFrame([(1, "u0")], "chapter long, url string"))
    assert [r["url"] for r in out.orderBy("n").collect()] == [f"u{k}" for k in range(1000)]
    assert sum(c == ["page", "to"] for c in written) == 1 + 10  # the pointers themselves, and a doubling in each round


def test_no_pages_and_no_starts(spark):
    links = spark.createDataFrame([], "url string, next string")
    start = spark.createDataFrame([(1, "a")], "chapter long, url string")
    assert registry.follow(links, start).collect() == []
    assert registry.follow(spark.createDataFrame([("a", "b")], "url string, next string"), start.limit(0)).collect() == []


# ---------------------------------------------------------------- numbers and medians


def test_numbered(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(200)]), k) for k in range(300)]
    d = spark.createDataFrame(data, "g string, v long, k long").repartition(4)
    got = sorted(((r["g"], r["place"], r["k"]) for r in stats.numbered(d, ["g"], ["v", "k"], "place", Tables(spark, "t")).collect()), key=str)
    want = []
    for g in {x[0] for x in data}:
        own = sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want += [(g, n, x[2]) for n, x in enumerate(own)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize(("width", "fanout", "block"), [(4, 32, 4096), (3, 6, 5)])
def test_wave_baselines_by_hand(spark, width, fanout, block):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, *[round(rng.random(), 1) for _ in range(6)]]), f"x{k}") for k in range(150)]
    d = spark.createDataFrame(data, "g string, k long, ratio double, wave string").repartition(3)
    out = stats.wave_baselines(d, ["g"], "k", "ratio", width, fanout, block)
    assert out.columns == ["g", "k", "ratio", "wave", "n", "upper_median"]
    want = []
    for g in {x[0] for x in data}:
        own = sorted((x for x in data if x[0] == g), key=lambda x: x[1])
        for p, x in enumerate(own):
            before = [y[2] for y in own[: p // width * width] if y[2] is not None]
            want.append((*x, len(before), statistics.median_high(before) if before else None))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_wave_baselines_see_no_group_as_a_whole(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), F.col("id").alias("k"), (F.col("id") * 7 % 1000 / 3).alias("ratio"))
    out = stats.wave_baselines(d, ["g"], "k", "ratio", 4)
    assert "collect_list" not in plan(out)
    hot = [r for r in out.where("g = 'hot'").orderBy("k").collect()]
    values = [r["ratio"] for r in hot]
    assert all(r["upper_median"] == (statistics.median_high(values[: k // 4 * 4]) if k >= 4 else None) for k, r in enumerate(hot))
    assert stats.wave_baselines(d.limit(0), ["g"], "k", "ratio", 4).collect() == []


# ---------------------------------------------------------------- dictionaries


@pytest.mark.parametrize("bits", [1, 1 << 10, 1 << 27])
def test_surfaces_of_all_lengths(spark, bits):
    """Surfaces of 1 to 40 letters with shared prefixes, and texts longer than what is hashed at a time; a filter that is full loses nothing."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(n)) for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 40) for _ in range(3)} | {"😀", "a😀b", "里甲", "甲"})
    texts = [(k, "".join(rng.choice(["a", "b", "c", "😀", rng.choice(words)]) for _ in range(rng.randrange(0, 40)))) for k in range(30)] + [(98, None), (99, ""), (50, "里甲乙丙"), (51, "里甲x")]
    d = spark.createDataFrame(texts, "id long, text string")
    s = spark.createDataFrame([(w,) for w in words] + [("",), (None,)], "surface string")
    inside = {(k, w) for k, t in texts for w in words if t and w in t and not (w == "里甲" and t == "里甲乙丙")}
    assert {tuple(r) for r in terms.substrings(d, ["id"], "text", s, bits).collect()} == inside
    want = []
    for k, t in texts:
        taken = set()
        for n, p, w in sorted((-len(w), p, w) for w in words for p in range(len(t or "")) if t.startswith(w, p)):
            if not taken & set(range(p, p - n)) and not (w == "里甲" and t.startswith("乙丙", p + 2)):
                taken |= set(range(p, p - n))
                want.append((k, p, w))
    assert sorted(map(tuple, terms.locked_matches(d, ["id"], "text", s, bits).collect())) == sorted(want)


def test_texts_longer_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(terms, "STRETCH", 10)
    f = terms.Filter({2: 3, 16: 20}, __import__("numpy").full(2, 2**64 - 1, "uint64"))
    text = "abcdefghijklmnopqrstuvwxyz" * 3
    assert {(p, m) for p, m, _ in f.find(text)} == {(p, 2) for p in range(len(text) - 1)} | {(p, 16) for p in range(len(text) - 15)}
    assert all(rest == text[p : p + {2: 5, 16: 22}[m]] for p, m, rest in f.find(text))


def test_few_places_pass_the_filter(spark):
    words = [f"w{k:05}" for k in range(20_000)]
    s = spark.createDataFrame([(w, 4, w[:4]) for w in words], "surface string, m int, prefix string")
    f = terms._filter(s, 1 << 27)
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvxyz") for _ in range(20_000))
    assert len(f.find(text)) < 200 and len(f.find(" ".join(words[:50]))) >= 50


# ---------------------------------------------------------------- parsing


def test_parsing_shuffles_nothing(spark):
    d = spark.createDataFrame([(1, fixtures.RAW)], "id long, text string")
    p, bad = corpus.parse_chapters(d, "id", "text")
    assert "Exchange" not in plan(p) and "Exchange" not in plan(bad) and "Exchange" not in plan(corpus.first_chapters(d, "id", "text", 1))


def test_problems_come_in_order_of_lines(spark):
    cases = {
        "第5章 a\n文\n第3章 b\n第3章 c": ("backwards_chapter", 3, 3, 1),  # not the empty chapter that follows
        "第5章 a\n第3章 b\n文": ("empty_chapter", 5, 1, None),
        "第5章 a\n第5章 b\n文": ("duplicate_chapter", 5, 2, 1),
        "第5章 a\n文\n第7章 b\n文\n第5章 b\n文": ("duplicate_chapter", 5, 5, 1),
        "第5章 a b，c\n第6章 x\n文": None,  # a sentence in the heading is prose
        "第99999999999999999999章 a\n文\n第1章 b\n文": None,  # no number, and in no order
        "----\n" + "-" * 20: ("content_before_chapter", None, 1, None),
        "-" * 20: ("no_chapters", None, None, None),
        None: ("empty_raw", None, None, None),
    }
    d = spark.createDataFrame(list(enumerate(cases)), "id long, text string")
    got = {r["id"]: tuple(r)[1:] for r in corpus.parse_chapters(d, "id", "text")[1].collect()}
    assert got == {k: v for k, v in enumerate(cases.values()) if v}


def test_a_long_text_is_parsed(spark):
    text = "\n".join(f"第{k}章 T{k}\n" + "\n".join(f"line {k} {j}" for j in range(20)) for k in range(1, 1500))
    p, bad = corpus.parse_chapters(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text")
    assert bad.count() == 0 and p.count() == 1499 * 20
    assert tuple(p.where("chapter = 1499").orderBy("pos").first())[1:] == (1499, "T1499", 1498 * 21 + 1, 1, "P1499_0001", 1498 * 21 + 2, "line 1499 0")


# ---------------------------------------------------------------- digests


def same(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def test_doubles_and_texts(spark):
    rng = random.Random(5)
    numbers = [0.0, -0.0, 1.0, 0.1, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, 0.00012345, 1.5e300, -2.5, 100.0, 1e7, 1.2e22, float("inf"), float("-inf")] + [rng.uniform(-1e6, 1e6) * 10 ** rng.randrange(-9, 9) for _ in range(60)]
    d = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r["j"] for r in d.select(canonical.json_text(F.col("x"), d.schema["x"].dataType).alias("j")).collect()] == [same(x) for x in numbers]
    texts = ["", "plain", 'q"b\\', "".join(map(chr, range(40))), "日本é😀 \x7f", None]
    d = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r["j"] for r in d.select(canonical.json_text(F.col("x"), d.schema["x"].dataType).alias("j")).collect()] == [same(x) for x in texts]


def test_nested_values(spark):
    value = {"b": "x", "a": [{"k": [1, None], "Z": True}, None], "m": {"z": [False], "ä": None, "a b": []}, "é": None, "f": 2.0, "l": -(2**63)}
    kind = "b string, a array<struct<k:array<int>,Z:boolean>>, m map<string,array<boolean>>, `é` string, f double, l long"
    d = spark.createDataFrame([(value["b"], [([1, None], True), None], value["m"], None, 2.0, -(2**63))], kind)
    out = canonical.with_digest(d, "h", **{c: c for c in reversed(d.columns)})
    assert out.columns == [*d.columns, "h"] and out.first()["h"] == hashlib.sha256(same(value).encode()).hexdigest()


def test_what_a_group_and_a_review_depend_on(spark):
    kind = "chapter long, title string, first boolean, raw array<struct<id:string,text:string>>, dictionary map<string,string>, previous string, lookahead string"
    rows_ = [(3, "T", True, [("P0003_0001", "x"), ("P0003_0002", 'y"')], {"b": "B", "a": "A"}, None, "z"), (3, "T", False, [("P0003_0003", "x")], {}, "p", None)]
    got = [r["group_hash"] for r in canonical.group_hashes(spark.createDataFrame(rows_, kind).coalesce(1), "v1", "s", 9).collect()]
    want = [{"chapter": c, "title": t if f else "", "raw": [list(u) for u in raw], "dictionary": d, "previous_translation": p, "next_source": n, "policy": "v1", "schema": "s", "thinking_budget": 9} for c, t, f, raw, d, p, n in rows_]
    assert got == [hashlib.sha256(same(w).encode()).hexdigest() for w in want]
    r = spark.createDataFrame([("r", "t", [("a", "A")], ["f1"])], "raw string, text string, dictionary array<struct<source:string,translation:string>>, findings array<string>")
    entries = [{"source": "a", "translation": "A"}]
    out = canonical.review_hashes(r).first()
    assert out["dictionary_hash"] == hashlib.sha256(same(entries).encode()).hexdigest()
    assert out["review_hash"] == hashlib.sha256(same({"raw": "r", "text": "t", "dictionary": entries, "findings": ["f1"]}).encode()).hexdigest()


# ---------------------------------------------------------------- locales


def test_titles_in_the_order_of_a_locale(spark):
    titles = ["zebra", "Äpfel", "apple", "Apple", "éclair", "eclair", "Zoo", "ñandú", "nandu", None, "apple"]
    d = spark.createDataFrame([(t, k) for k, t in enumerate(titles)], "title string, place_ long").repartition(3)
    assert [r["title"] for r in library.shelf_order(d, "title").orderBy("place").collect()] == [None, "Äpfel", "apple", "apple", "Apple", "eclair", "éclair", "nandu", "ñandú", "zebra", "Zoo"]
    assert library.shelf_order(d.limit(0), "title").collect() == []


def test_names_spelled_alike(spark):
    d = spark.createDataFrame([("Ärger",), ("ärger",), ("ÄRGER",), ("Arger",), (None,), ("",)], "n string")
    assert rows(library.spelled_alike(d, "n"), "name") == [("", 1), ("Arger", 1), ("ÄRGER", 3)]


def test_a_line_meets_each_pattern_once(spark):
    """What a line is, is worked out once for all that asks for it, and most lines meet no pattern of headings at all."""
    text = "﻿　第1章 A \n x　\n-- \n" + "-" * 25 + " \n第2章　B\ny 第3章 z\n第三章 中记载\n第4章 T 他来了。\n第5 章\n第x章"
    p, bad = corpus.parse_chapters(spark.createDataFrame([(1, text[: text.rindex("\n第5")]), (2, text)], "id long, text string"), "id", "text")
    got = [(r["chapter"], r["title"], r["source_line"], r["line"], r["text"]) for r in p.orderBy("line").collect()]
    assert got == [(1, "A", 1, 2, "x"), (1, "A", 1, 3, "--"), (2, "B", 5, 6, "y 第3章 z"), (2, "B", 5, 7, "第三章 中记载"), (4, "T", 8, 8, "他来了。")]
    assert [tuple(r) for r in bad.collect()] == [(2, "malformed_heading", None, 10, None)]
    spent = p._jdf.queryExecution().optimizedPlan().toString()
    assert spent.count("regexp_replace") <= 6 and spent.count("RLIKE") <= 12 and spent.count("split(") <= 2
