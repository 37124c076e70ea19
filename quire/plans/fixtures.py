"""Queries on a few rows of Chinese and Vietnamese text, which the driver's tables don't have; the SQL states what has to come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import blocks, corpus, quality, terms

RAW = "-" * 60 + "\n\n第21章 风起 他来了。\n----\n第二段\n第102章 云涌\n第21章中记载了此事。\n尾声"
ENTRIES = [
    ("邱途", "Khâu Đồ", "character", "male", "locked", [("邱途哥", "anh Khâu Đồ")]),
    ("甲乙", "AB", "term", "not_applicable", "locked", []),
    ("乙丙丁", "BCD", "term", "not_applicable", "locked", []),
]
SCHEMA = "source string, translation string, type string, gender string, status string, aliases array<struct<source:string,translation:string>>"


def parsed_chapters(spark, sf_dir):
    t = spark.createDataFrame([(1, RAW)], "id long, text string")
    return corpus.parse_chapters(t, "id", "text")[0].select("chapter", "title", "source_line", "pid", "line", "text")


PARSED = """SELECT * FROM (VALUES (21::BIGINT, '风起', 3, 'P0021_0001', 3, '他来了。'), (21, '风起', 3, 'P0021_0002', 4, '----'), (21, '风起', 3, 'P0021_0003', 5, '第二段'),
(102, '云涌', 6, 'P0102_0001', 7, '第21章中记载了此事。'), (102, '云涌', 6, 'P0102_0002', 8, '尾声')) t(chapter, title, source_line, pid, line, text)"""


def parse_problems(spark, sf_dir):
    rows = [(1, "第1章 甲\n文\n第1章 乙\n文"), (2, "第2章 甲\n文\n第1章 乙\n文"), (3, "文\n第1章 甲\n文"), (4, "第1章 甲\n第2章 乙\n文"), (5, " \n"), (6, "第甲章 x\n文"), (7, "没有"), (8, "第3章 甲"), (9, "第1章 甲\n坏\x00字"), (10, "第1章 甲\n好")]
    return corpus.parse_chapters(spark.createDataFrame(rows, "id long, text string"), "id", "text")[1]


PROBLEMS = """SELECT * FROM (VALUES (1::BIGINT, 'duplicate_chapter', 1::BIGINT, 3, 1), (2, 'backwards_chapter', 1, 3, 1), (3, 'content_before_chapter', NULL, 1, NULL), (4, 'empty_chapter', 1, 1, NULL), (5, 'empty_raw', NULL, NULL, NULL),
(6, 'malformed_heading', NULL, 1, NULL), (7, 'content_before_chapter', NULL, 1, NULL), (8, 'empty_chapter', 3, 1, NULL), (9, 'invalid_encoding', NULL, 2, NULL)) t(id, error, chapter, line, previous_line)"""


def longest_matches(spark, sf_dir):
    p = spark.createDataFrame([(1, "邱途哥来了"), (2, "甲乙丙丁"), (3, "邱途和邱途哥"), (4, "")], "id long, text string")
    return terms.locked_matches(p, ["id"], "text", terms.surfaces(spark.createDataFrame(ENTRIES, SCHEMA)))


MATCHES = "SELECT * FROM (VALUES (1::BIGINT, 0, '邱途哥'), (2, 1, '乙丙丁'), (3, 0, '邱途'), (3, 3, '邱途哥')) t(id, position, surface)"


def number_differences(spark, sf_dir):
    rows = [(1, "长2.5714米", "dài 2,5714 mét"), (2, "两个人", "2 người"), (3, "2个人", "3 người"), (4, "162.5万元", "1.625 triệu đồng... 1,625 triệu"), (5, "1625000元", "1,625 tỷ"), (6, "一万二个", "12000"), (7, "3人", "ba người số ba"), (8, "无", "không")]
    d = spark.createDataFrame(rows, "id long, raw string, text string").withColumn("n", quality.numeric_difference(F.col("raw"), F.col("text")))
    show = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    return d.select("id", show(F.col("n.missing")).alias("missing"), show(F.col("n.extra")).alias("extra"), F.col("n.ambiguous").alias("ambiguous"))


NUMBERS = """SELECT * FROM (VALUES (1::BIGINT, NULL, NULL, NULL), (2, NULL, NULL, NULL), (3, '2:1', '3:1', FALSE), (4, '', '1625000:1', FALSE), (5, '1625000:1', '1625000000:1', FALSE), (6, '', '12000:1', TRUE), (7, NULL, NULL, NULL), (8, NULL, NULL, NULL))
t(id, missing, extra, ambiguous)"""


def mined_candidates(spark, sf_dir):
    rows = [(1, 1, "他名叫李青云。张三说：“走吧。”"), (1, 2, "天龙集团的王老师来了。"), (2, 1, "张三笑了。张三走了。")]
    p = spark.createDataFrame(rows, "chapter long, pos long, text string")
    return terms.summary(terms.candidates(p, "chapter", "pos", "text"), p, "chapter", "pos", "text").select("source", "occurrences", "first_seen", "last_seen", "possible_type")


MINED = "SELECT * FROM (VALUES ('李青云', 1::BIGINT, 1::BIGINT, 1::BIGINT, 'character'), ('张三', 3, 1, 2, 'character'), ('天龙集团', 1, 1, 1, 'institution')) t(source, occurrences, first_seen, last_seen, possible_type)"


def block_shapes(spark, sf_dir):
    line = lambda c, n: c * n
    rows = [(1, "\n".join(["第1章 甲", *(line("字", 500) for _ in range(12))])), (2, line("长", 6500)), (3, "第1章 " + line("x", 3200)), (4, "一\n\n二"), (5, "")]
    d = spark.createDataFrame(rows, "id long, text string")
    b = d.select("id", blocks.chapter_blocks(F.col("text")).alias("b")).select("id", "b.*")
    return b.select("id", F.size("blocks").alias("blocks"), F.array_join(F.transform("sizes", lambda s: s.cast("string")), ",").alias("sizes"), F.array_join("kinds", ",").alias("kinds"), "oversized_headings", "forced_splits")


SHAPES = """SELECT * FROM (VALUES (1::BIGINT, 3, '2505,3000,500', 'paragraph,paragraph', 0, 0), (2, 3, '3000,3000,500', '', 0, 0), (3, 1, '3204', '', 1, 0), (4, 1, '2', '', 0, 0), (5, 0, '', '', 0, 0))
t(id, blocks, sizes, kinds, oversized_headings, forced_splits)"""


def endings(spark, sf_dir):
    rows = [(1, "他说：", "“好”"), (2, "完了。”", "又"), (3, "其一；", "二"), (4, "甲，", "乙"), (5, "abc", "d")]
    d = spark.createDataFrame(rows, "id long, a string, b string")
    return d.select("id", X.ending_class(F.col("a")).alias("ending"), X.speech_intro(F.col("a"), F.col("b")).alias("intro"), X.is_note(F.lit("PS：求票")).alias("note"), X.heading_has_number(F.lit("Chương 12 x")).alias("numbered"))


ENDINGS = "SELECT * FROM (VALUES (1::BIGINT, 'weak', TRUE, TRUE, TRUE), (2, 'strong', FALSE, TRUE, TRUE), (3, 'medium', FALSE, TRUE, TRUE), (4, 'weak', FALSE, TRUE, TRUE), (5, 'none', FALSE, TRUE, TRUE)) t(id, ending, intro, note, numbered)"

QUERIES = {
    "fixture_parsed_chapters": (parsed_chapters, PARSED),
    "fixture_parse_problems": (parse_problems, PROBLEMS),
    "fixture_longest_matches": (longest_matches, MATCHES),
    "fixture_number_differences": (number_differences, NUMBERS),
    "fixture_mined_candidates": (mined_candidates, MINED),
    "fixture_block_shapes": (block_shapes, SHAPES),
    "fixture_endings": (endings, ENDINGS),
}
