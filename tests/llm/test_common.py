import re

import numpy as np

from quire.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_are_those_of_the_pattern(monkeypatch):
    texts = ["", " ", "a", "  a bb\tccc\n\x0b\x0c\rd ", "é b 日本 x", "x" * 50 + " " + "y" * 50]
    for size in (1 << 20, 7):
        monkeypatch.setattr(common, "SEGMENT", size)
        for text in texts:
            data = text.encode()
            h, s, e = common.word_hashes(data)
            assert [data[a:b].decode() for a, b in zip(s, e)] == WORD.findall(text)
            assert len(set(h.tolist())) == len(set(WORD.findall(text)))


def test_hashes_depend_on_words_alone():
    a, _, _ = common.word_hashes(b"the cat  sat on the mat")
    b, _, _ = common.word_hashes(b"\n\nsat\tthe CAT cat", lower=True)
    assert a[0] == a[4] and a[2] == b[0] and a[0] == b[1] and b[2] == b[3] == a[1]
    assert common.window_hashes(a, 2)[0] != common.window_hashes(a, 2)[4]
    assert (common.window_hashes(np.concatenate([a, a]), 3)[:4] == common.window_hashes(a, 3)).all()


def test_few_words_are_one_shingle():
    assert len(common.shingle_set(None)) == len(common.shingle_set(" \t")) == 0
    assert len(common.shingle_set("a b")) == 1 and len(common.shingle_set("a b c d e f")) == 2
    assert len(common.shingle_set("a b a b a b a b")) == 2


def test_whole_texts_are_read_by_few_rows_at_a_time(spark):
    from quire import scratch

    key = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.unset(key)
    scratch.text_batches(spark)
    assert int(spark.conf.get(key)) == scratch.READ < 4096
    spark.conf.set(key, "100")  # a session's smaller batches stay
    scratch.text_batches(spark)
    assert spark.conf.get(key) == "100"
    spark.conf.unset(key)
