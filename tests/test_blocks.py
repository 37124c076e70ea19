import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import blocks as B


def test_whole_lines_and_sizes():
    rng = random.Random(1)
    for _ in range(40):
        lines = ["".join(rng.choice("字abc。，“”（） …1") for _ in range(rng.randrange(1, 400))).strip() or "x" for _ in range(rng.randrange(1, 30))]
        out = B.cut_blocks(lines, set(), 260, 300)
        assert max(out.sizes) <= 300 and [sum(map(len, b)) for b in out.blocks] == out.sizes
        flat = "".join(x for b in out.blocks for x in b)
        assert "".join(flat.split()) == "".join("".join(lines).split())


def test_shapes():
    assert B.cut_blocks(["第1章 甲", *["字" * 500] * 12]).sizes == [2505, 3000, 500]
    assert B.cut_blocks([]).blocks == []
    out = B.cut_blocks(["第2章 " + "x" * 3100])
    assert out.oversized_headings == 1 and len(out.blocks) == 1
    out = B.cut_blocks(["a" * 2400, "b" * 300, "c" * 200, "d" * 400], {0})
    assert out.blocks[0] == ["a" * 2400] and out.kinds[0] == "section"


def test_ranks_beat_scores():
    lines = ["甲" * 2400, "“乙" + "丙" * 300 + "”", "丁" * 3000]
    assert B.cut_blocks(lines, {0}).sizes[0] == 2400
    assert B.cut_blocks(lines).kinds[0] == "dialogue"


def test_long_lines_are_cut_at_stops():
    parts, forced = B.split_long_line("甲" * 90 + "。" + "乙" * 60, 100)
    assert parts == ["甲" * 90 + "。", "乙" * 60] and forced == 0
    parts, forced = B.split_long_line("“" + "甲" * 150 + "”", 100)
    assert forced == 1 and "".join(parts) == "“" + "甲" * 150 + "”"
    parts, _ = B.split_long_line("word " * 40, 22)
    assert all(p == "word word word word" or p == "word" or len(p) <= 22 for p in parts)
    parts, _ = B.split_long_line("a" * 50, 20)
    assert "".join(parts) == "a" * 50


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="字a1 。，；“”（）…\n", max_size=300), st.integers(5, 40))
def test_lossless(text, maximum):
    lines, breaks = B.layout(text)
    out = B.cut_blocks(lines, breaks, maximum, maximum)
    assert "".join("".join(x for b in out.blocks for x in b).split()) == "".join(text.split())
    assert all(s <= maximum for s in out.sizes)


def test_layout():
    assert B.layout("\n\na\n\nb\nc\r\n\r\n") == (["a", "b", "c"], {0})


def test_audit_and_export(spark):
    d = spark.createDataFrame([(1, "k", "一\n\n二"), (2, "k", "第2章\n" + "字" * 3100), (3, "k", None), (4, "j", "x")], "id long, book string, text string")
    a = {r["book"]: r.asDict() for r in B.block_audit(d, "text", ["book"]).collect()}
    assert a["k"]["chapters"] == 3 and a["k"]["empty_bodies"] == 1 and a["k"]["max_chars"] == 3000 and a["k"]["oversized_splits"] == 1
    t = d.select("id", B.chapter_text(F.col("text"), F.col("id"), True).alias("t"))
    got = {r["id"]: r["t"] for r in t.collect()}
    assert got[1] == f"\n{B.SEPARATOR}\nChương 1\n一\n二" and got[3] == f"\n{B.SEPARATOR}\nChương 3" and "Chương" not in got[2]
    w = d.withColumn("w", B.chapter_text(F.col("text"), F.col("id")))
    assert B.export_problems(w, "id", "text", "w").collect() == []
    bad = w.withColumn("w", F.replace("w", F.lit("一"), F.lit("")))
    assert [tuple(r) for r in B.export_problems(bad, "id", "text", "w").collect()] == [(1, "content")]
    h = B.heading_report(d, "id", "text", ["book"]).orderBy("book").collect()
    assert [(r["without_heading"], r["without_heading_ids"]) for r in h] == [(1, [4]), (1, [1])]


def test_front_matter(spark):
    d = spark.createDataFrame([("T", "A", "s\n\nt", "u", ["x", "y"])], "t string, a string, s string, u string, g array<string>")
    out = d.select(B.front_matter(F.col("t"), F.col("a"), F.col("s"), F.col("u"), F.col("g"), F.lit(2), F.lit(30))).first()[0]
    assert out == "\n".join(["T", "by A", "", B.SEPARATOR, "", "s\nt", "", "Source: u", "Tags: x, y", "Volumes: 2", "Chapters: 30", "", B.FRONT_END])
