import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quire.llm import language_id as L

STEMS = {"de": "sch ung über ver ein der die und ich", "en": "the ing ough tion and of wh th ly", "es": "que los ción ar el ado ñ una", "fr": "eau eux que les é è tion ou", "xx": "qzx zqk kxq"}


def sample(lang, rng, n):
    return " ".join("".join(rng.choice(STEMS[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def rows(n=400):
    rng = random.Random(3)
    return [(i, sample(l := rng.choice(sorted(STEMS)), rng, rng.randrange(4, 60)), l) for i in range(n)]


def test_held_out_accuracy(spark):
    d = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    out = L.identify(d, L.train(d)).withColumn("held", L.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_families_come_first(spark):
    d = spark.createDataFrame(rows(200), "doc_id long, text string, lang string")
    m = L.train(d)
    assert m.members == {"germanic": ["de", "en"], "romance": ["es", "fr"], "own:xx": ["xx"]}
    assert m.weights.shape[1] == 3 + 1 + 1


def test_labels_ids_and_sources_are_no_inputs(spark):
    d = spark.createDataFrame(rows(200), "doc_id long, text string, lang string")
    m = L.train(d)
    a = {r["text"]: r["lang_pred"] for r in L.identify(d, m).collect()}
    b = {r["text"]: r["lang_pred"] for r in L.identify(d.select("text"), m).collect()}
    assert a == b


def test_cases(spark, documents, empty, clash):
    m = L.train(documents)
    out = L.identify(clash, m).collect()
    assert len(out) == documents.count()
    for r in out:
        none = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == none and (not none or r["score"] == 0)
    assert L.identify(empty, m).collect() == []
    nothing = L.train(empty)
    assert {r["lang_pred"] for r in L.identify(documents, nothing).collect()} == {"und"}
    one = L.train(documents.where("lang = 'en'"))
    assert {r["lang_pred"] for r in L.identify(documents, one).collect()} == {"en", "und"}


def test_whole_text_counts_and_segments_agree(monkeypatch):
    text = "über den Fluss, 12 Häuser. " * 40
    whole = L.counts(text)
    monkeypatch.setattr(L, "SEGMENT", 37)
    assert np.abs(whole - L.counts(text)).sum() <= 4  # a unit more where segments meet
    assert L.counts("1 2 3 !") is None and L.counts(None) is None and L.counts("a") is not None


def test_a_row_that_is_there_many_times_is_one_row(spark):
    rng = __import__("random").Random(5)
    rows = [(i, " ".join(f"{'xy'[i % 2]}{rng.choice('abc')}o" for _ in range(9)), ["de", "fr"][i % 2]) for i in range(200)]
    many = [(7, rows[7][1], "fr")] * 3000
    once, often = (L.train(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(4)) for r in (rows, rows + many))
    assert (once.weights == often.weights).all()


def test_no_label_is_dropped(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03}") for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~L.held_out(F.col("doc_id")))
    assert len({x for own in L.train(d, most_rows=10).members.values() for x in own}) == d.count()
