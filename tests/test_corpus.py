import random

from pyspark.sql import functions as F

from quire.operators import corpus as C


def test_paragraphs_and_sections(spark):
    d = spark.createDataFrame([(1, "a\n\n b\r\n \nc"), (2, None), (3, "")], "id long, text string")
    plan = C.paragraphs(d, "id", "text")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    p = plan.orderBy("id", "pos").collect()
    assert [(r["line"], r["pid"], r["text"], r["previous"], r["following"]) for r in p] == [(1, "P0001_0001", "a", None, " b"), (3, "P0001_0002", " b", "a", "c"), (5, "P0001_0003", "c", " b", None)]
    assert [tuple(r) for r in C.section_after(d, "id", "text").orderBy("pos").collect()] == [(1, 1), (1, 2)]
    assert [r["chars"] for r in C.running_chars(d, "id", "text").orderBy("pos").collect()] == [1, 3, 4]


def test_clamped_depth(spark):
    rng = random.Random(1)
    steps = [(g, k, rng.choice([-2, -1, 0, 1, 1])) for g in range(3) for k in range(50)]
    got = {(r["g"], r["k"]): r["depth"] for r in C.clamped_depth(spark.createDataFrame(steps, "g long, k long, s int"), ["g"], ["k"], F.col("s")).collect()}
    for g in range(3):
        depth = 0
        for _, k, s in [x for x in steps if x[0] == g]:
            depth = max(0, depth + s)
            assert got[g, k] == depth


def test_chunk_groups(spark):
    rows = [("b", k, i) for k, i in enumerate([1, 2, 101, 3, 150, 199])]
    got = C.chunk_groups(spark.createDataFrame(rows, "book string, k long, id long"), ["book"], ["k"], "id").orderBy("k").collect()
    assert [r["group"] for r in got] == [1, 1, 2, 3, 4, 4]


def test_import_sections(spark):
    d = spark.createDataFrame([(1, "pre\n\nface\nChapter 1 <x>\na\n \t\nb\n第二章\nc", "file"), (2, "only\ntext", "f2"), (3, "\nChương IV\nz", "f3")], "id long, text string, name string")
    got = [tuple(r) for r in C.import_sections(d, "id", "text", "name").orderBy("id", "section").collect()]
    assert got == [
        (1, 1, "file", "<p>pre</p><p>face</p>"),
        (1, 2, "Chapter 1 <x>", "<p>Chapter 1 &lt;x&gt;<br/>a</p><p>b</p>"),
        (1, 3, "第二章", "<p>第二章<br/>c</p>"),
        (2, 1, "f2", "<p>only<br/>text</p>"),
        (3, 1, "Chương IV", "<p>Chương IV<br/>z</p>"),
    ]


def test_chapter_gaps_are_no_problem(spark):
    d = spark.createDataFrame([(1, "第21章 a\n文\n第102章 b\n第21章中记载\n文")], "id long, text string")
    p, bad = C.parse_chapters(d, "id", "text")
    assert bad.collect() == [] and [(r["chapter"], r["line"]) for r in p.orderBy("line").collect()] == [(21, 2), (102, 4), (102, 5)]


def test_format_novel(spark):
    c = spark.createDataFrame([("b", 7, "x", 5), ("b", 3, "", 2), ("b", 9, None, 99)], "book string, id long, title string, volume int")
    v = spark.createDataFrame([("b", 5, "five"), ("b", 2, "")], "book string, id int, title string")
    ch, vol = C.format_novel(c, v, ["book"], 100)
    assert [tuple(r)[1:] for r in ch.orderBy("id").collect()] == [(1, "Chapter 1", 1), (2, "x", 2), (3, "Chapter 3", 3)]
    assert [tuple(r)[1:] for r in vol.orderBy("volume").collect()] == [(1, "Volume 1", 1), (2, "five", 1), (3, "Unknown", 1)]


def test_groups_are_next_fit(spark):
    rng = random.Random(3)
    rows = [(g, k, "x" * rng.randrange(1, 30)) for g in range(4) for k in range(60)] + [(9, 0, "x" * 99)]
    got = {(r["g"], r["k"]): r["group"] for r in C.groups_of(spark.createDataFrame(rows, "g long, k long, t string"), ["g"], "k", "t", 100, 10**6, 7).collect()}
    for g in range(4):
        own = [r for r in rows if r[0] == g]
        assert [got[g, k] for _, k, _ in own] == C.next_fit([[len(t)] for _, _, t in own], [100], 7)
    assert got[9, 0] == 0


def test_split_paragraph():
    assert C.split_paragraph("一。二！三", 3) == ["一。", "二！三"] and C.split_paragraph("ab", 5) == ["ab"]
    assert C.split_paragraph("一，二，三。", 4) == ["一，二，", "三。"]
    try:
        C.split_paragraph("a" * 9, 4)
        raise AssertionError
    except ValueError:
        pass


def test_raws_hold_their_own_chapter(spark):
    rows = [
        (1, "a", "<p>One.</p>"), (2, "b", "<h3>第2章 b</h3><p>Two.</p>"), (3, "c", "<p>Three.</p><p>第4章 d</p><p>Four.</p>"), (4, "d", "<p>Four.</p><p>第2章 e</p><p>x</p>"),
        (5, "e", ""), (6, "f", "<p>bad \ufffd</p>"),
    ]
    c = spark.createDataFrame([("b", *r) for r in rows], "book string, id long, title string, body string")
    good, bad = C.checked_raws(c)
    assert {r["id"]: r["raw"].split("\n") for r in good.collect()} == {1: ["第1章 a", "One."], 2: ["第2章 b", "Two."]}
    assert {r["id"]: r["problem"] for r in bad.collect()} == {3: "other chapters", 4: "backwards_chapter", 5: "empty_chapter", 6: "invalid_encoding"}
