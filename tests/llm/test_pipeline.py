import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import language_id, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "mixing", "packing"]


def shingles(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near(rows):
    """Rows that near-dedup keeps, by comparing all pairs: of each group the smallest id, of equal rows one."""
    rows = sorted(set(map(tuple, rows)), key=lambda r: (r[0] is None, r[0] or 0, key(r)))
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    lo, hi = sorted((group[a], group[b]))
                    group = [lo if g == hi else g for g in group]
                    changed = True
    return [r for k, r in enumerate(rows) if group[k] == k]


@pytest.mark.parametrize("clashing", [False, True])
def test_stages(spark, documents, clash, clashing):
    """Each stage over all that the one before kept, against what it should do worked out plainly; other columns go along as they are."""
    docs = clash if clashing else documents
    more = docs.columns[len(COLUMNS) :]
    own = lambda rows: [tuple(r)[: len(COLUMNS)] for r in rows]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, "")
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert all(r[c] == "clash" for r in rows for c in more)
        if name == "language ID":
            model = language_id.train(docs)
            told = [(r, *model.predict(r["text"])) for r in own_rows(before)]
            want = [(r[0], r[1], r[2] or lang, r[3], r[4]) for r, lang, score in told if lang != "und" and score >= 0.5]
            assert sorted(own(rows), key=key) == sorted(want, key=key) and 0 < len(rows) < len(before)
        elif name == "line dedup":
            assert len(rows) == len(before) and all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "MinHash near-dedup":
            assert sorted(own(rows), key=key) == sorted(near(own(before)), key=key) and len(rows) < len(before)
        elif name == "mixing":
            copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(docs).collect()}
            size = lambda text: len(language_words(text))
            want = [r for r in own(before) for _ in range(copies[r[0], size(r[1])])]
            assert sorted(own(rows), key=key) == sorted(want, key=key)
        else:
            pieces: dict = {}
            for r in rows:
                assert 0 < r["length"] <= 2048
                pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
            ids = {}
            for r in own(before):
                ids.setdefault(r[0], []).append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])
            assert set(pieces) == set(ids)
            for i, texts in ids.items():
                assert sum(p[1] for p in pieces[i]) == sum(map(len, texts))
                crcs = {(s, n): zlib.crc32(np.array(t[s : s + n], "<u4").tobytes()) for t in texts for s, n, _, _ in pieces[i]}
                if len({tuple(t) for t in texts}) == 1:
                    assert all(crcs[s, n] == c and t == len(texts[0]) for s, n, c, t in pieces[i])
        docs = spark.createDataFrame(rows, out.schema) if name != "packing" else out


def own_rows(rows):
    return [r[: len(COLUMNS)] if isinstance(r, list) else r for r in rows]


def language_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_columns_named_like_what_stages_compute_stay(spark):
    d = spark.createDataFrame([(k, f"some text about {k}\nand more", "en", "a", 9, f"mine{k}", k * 0.5, "x") for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long, lines string, score double, own string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        d = stage(spark, d, "")
    assert all(r["lines"] == f"mine{r['doc_id']}" and r["score"] == r["doc_id"] * 0.5 and r["own"] == "x" for r in d.collect()) and d.count() > 0


def test_of_repeated_rows_the_same_stays(spark):
    rows = [(1, "a b c d e f", "en", s, 11) for s in ("z", "b", "q")]
    for _ in range(3):
        rows = rows[1:] + rows[:1]
        got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), "").collect()
        assert [r["source"] for r in got] == ["b"]


def test_boilerplate_of_a_source_goes(spark):
    """On 10 of 100 texts a line goes and its neighbours stay; on 4, in another source or in 30 copies of one text it stays."""
    rows = [(k, f"first {k}\nall rights\nlast {k}" if k < 10 else f"first {k}\nrare\nlast {k}" if k < 14 else f"only {k}", "en", "a", 0) for k in range(100)]
    rows += [(100 + k, "of a copy\nalike", "en", "a", 0) for k in range(30)]
    rows += [(200, "all rights\nhere", "en", "b", 0), (201, None, "en", "a", None)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    want = {i: (t.replace("all rights\n", "") if s == "a" else t) if t else t for i, t, _, s, _ in rows}
    assert got == {i: (t, len(t or "")) for i, t in want.items()}


def test_without_labels_texts_stay(spark):
    d = spark.createDataFrame([(1, "some text", None, "a", 9), (2, "12 34", None, "a", 5), (3, None, None, "a", None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.identify_language(spark, d, "").collect()] == [1]


def test_null_labels_are_filled(spark):
    rng = np.random.default_rng(3)
    alphabet = {"en": "abcdefg", "fr": "mnopqrs"}
    text = lambda lang: " ".join("".join(rng.choice(list(alphabet[lang]), 5)) for _ in range(40))
    rows = [(k, text(lang), None if k % 7 == 0 else lang, "a", 1) for k, lang in enumerate(["en", "fr"] * 60)]
    got = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert len(got) == 120 and all(r["lang"] == ["en", "fr"][r["doc_id"] % 2] for r in got)


def test_empty(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []


def test_run(spark):
    from pathlib import Path

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no test data")
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {r["doc_id"] for r in out} <= {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id")).collect()}
