import html
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import text as X
from quire.functions import unicode as U


def values(spark, rows, *columns, names="c string"):
    return [tuple(r) if len(columns) > 1 else r[0] for r in spark.createDataFrame(rows, names).select(*columns).collect()]


def test_lines_and_stripping(spark):
    texts = ["a\r\nb\rc\n\n d \n　\n", "", " x ", "a\x0bb\x85c d\n"]
    got = values(spark, [(t,) for t in texts], X.content_lines(F.col("c")), X.split_lines(F.col("c")), X.strip(F.col("c")))
    for t, (content, lines, bare) in zip(texts, got):
        assert content == [x for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
        assert (lines if t else []) == t.splitlines() and bare == t.strip()


def test_counts_and_balance(spark):
    texts = ["(a) “b”", "(a", "““”", '"x"', '"', "«»（）【】", "aaaa"]
    got = values(spark, [(t,) for t in texts], X.balanced(F.col("c")), X.count_of(F.col("c"), "aa"))
    assert [g[0] for g in got] == [True, False, False, True, False, True, True]
    assert [g[1] for g in got] == [t.count("aa") for t in texts]


def test_censorship_headings_notes(spark):
    got = values(spark, [("你*好",), ("a*b",), ("x**y",), ("第三章 风",), ("Chapter 7",), ("Chapterhouse",), ("#12 x",), ("作者有话说：谢",)], X.censored(F.col("c")), X.heading_has_number(F.col("c")), X.native_heading(F.col("c")), X.is_note(F.col("c")))
    assert [g[0] for g in got] == [True, False, True, *[False] * 5]
    assert [g[1] for g in got] == [False, False, False, True, True, False, True, False]
    assert got[3][2] and not got[4][2] and got[7][3] and not got[0][3]


def test_clean_text_and_sizes(spark):
    got = values(spark, [(" a\nb​<i> ",)], X.clean_text(F.col("c")), X.blacklist(F.col("c"), ["a", "<"]))
    assert got == [("ab&lt;i&gt;", "␣\nb​␣i>")]
    assert values(spark, [(0,), (1023,), (1536,), (1280,), (5 << 30,)], X.format_size(F.col("c")), names="c long") == ["0.0 B", "1023.0 B", "1.5 KB", "1.2 KB", "5.0 GB"]


def test_sentence_around(spark):
    rows = [("一。找他来！尾", "他"), ("找", "找"), ("a。b", "z"), ("x！\n他 y", "他")]
    assert values(spark, rows, X.sentence_around(F.col("c"), F.col("d")), names="c string, d string") == ["找他来！", "找", None, "他 y"]


def test_chunks(spark):
    got = values(spark, [(1,), (100,), (101,)], X.chunk_start(F.col("c")), X.chunk_label(F.col("c")), X.chunk_label(F.col("c"), 1), X.chapter_path(F.col("c")), names="c long")
    assert got == [(1, "0001-0100", "0001", "chapters/0001-0100/ch_0001.json"), (1, "0001-0100", "0100", "chapters/0001-0100/ch_0100.json"), (101, "0101-0200", "0101", "chapters/0101-0200/ch_0101.json")]


def test_absolute_url(spark):
    page = "https://a.org/x/y.html"
    cases = {"": "", "http://b/": "http://b", "//c/d": "https://c/d", "/r/": "https://a.org/r", "z": page + "/z", "./../q": "https://a.org/x/q", "./q": page + "/q"}
    got = values(spark, [(k,) for k in cases], X.absolute_url(F.col("c"), F.lit(page), F.lit(page)))
    assert got == list(cases.values())


def test_han_numerals(spark):
    cases = {"一二三": "123", "十": "10", "二十": "20", "三百零五": "305", "一万二": None, "一百二": None, "一万二千": "12000", "零": "0", "两千": "2000", "一亿": "100000000"}
    assert values(spark, [(k,) for k in cases], N.han_key(F.col("c"))) == list(cases.values())
    chapters = {"一二三": 3, "一百二十": 120, "42": 42, "４２": 42, "万": 10_000, "十万零三": 100_003, "": None, "9" * 30: None}
    assert values(spark, [(k,) for k in chapters], N.chapter_number(F.col("c"))) == list(chapters.values())


@pytest.mark.parametrize("text,source,keys", [("1,625 a 2.50", True, ["1625", "2.5"]), ("1,625 a 1.625", False, ["1.625", "1625"]), ("1.234.567", False, ["1234567"]), ("1.234.56", False, ["1234.56"]), ("162.5万", True, ["1625000"]), ("1,625 triệu", False, ["1625000"]), ("a1 2b 007", True, ["7"]), ("3 tỷ 0", False, ["3000000000", "0"])])
def test_number_keys(spark, text, source, keys):
    assert values(spark, [(text,)], N.number_keys(F.col("c"), source)) == [keys]


def test_unicode_functions(spark):
    texts = ["it's  a &amp; b\tthe END", "ﬁne ｆｕｌｌ", None, "Straße"]
    got = values(spark, [(t,) for t in texts], U.format_title("c"), U.normalize("c"), U.compose_fold("c"))
    for t, g in zip(texts, got):
        assert g == (" ".join(unicodedata.normalize("NFKC", html.unescape(t or "")).split()).title(), unicodedata.normalize("NFKD", t or "").casefold(), unicodedata.normalize("NFC", t or "").casefold())


def test_decoding(spark):
    rows = [(bytearray("中文".encode("gbk")),), (bytearray(b"\xff\xff"),), (None,)]
    assert values(spark, rows, U.decode("gbk")("c"), names="c binary") == ["中文", None, None]
    rows = [(bytearray("﻿a\r\nb".encode()),), (bytearray("ab\n".encode("utf-16")),), (bytearray(b"a\0"),), (bytearray(b"\xff"),), (bytearray(b" \n"),)]
    assert values(spark, rows, U.decode_sniffed("c"), names="c binary") == ["a\nb", "ab\n", None, None, None]


def test_unscrambling():
    from base64 import b64encode

    xor = lambda t, k: bytes(b ^ k[i % len(k)] for i, b in enumerate(t.encode()))
    parts = ["0002" + b64encode(xor("world", b"ab")).decode(), "0001" + b64encode(xor("héllo ", b"ab")).decode()]
    assert U.unscramble(parts, "ab") == "héllo world"
    assert U.unscramble(["0001" + b64encode(b"abc").decode()[::-1]], "", "base64_reverse") == "abc"
