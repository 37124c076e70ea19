from pyspark.sql import functions as F

from quire.operators import library as L
from quire.operators import stats as S
from quire.sources import registry, store

CH = "book string, id long, body string, fetched_at double"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_upserts(spark):
    old = spark.createDataFrame([("b", 1, "x", 1.0)], CH)
    new = spark.createDataFrame([("b", 1, "y", 2.0), ("b", 2, "p", 5.0), ("b", 2, "q", 4.0), ("b", 0, "bad", 1.0), ("../c", 1, "bad", 1.0), ("..", 1, "bad", 1.0)], CH)
    assert rows(L.insert_if_absent(old, new), "id") == [("b", 1, "x", 1.0), ("b", 2, "q", 4.0)]
    assert rows(L.upsert(old, new), "id") == [("b", 1, "y", 2.0), ("b", 2, "p", 5.0)]


def test_contents(spark):
    toc = spark.createDataFrame([("b", 1, "t1"), ("b", 2, "t2"), ("c", 1, "u")], "book string, id long, title string")
    ch = spark.createDataFrame([("b", 2, "x", 1.0)], CH)
    assert [r["saved"] for r in L.toc_with_saved(toc, ch).orderBy("book", "id").collect()] == [False, True, False]
    assert rows(L.missing(toc, ch).select("book", "id"), "book", "id") == [("b", 1), ("c", 1)]
    books = spark.createDataFrame([("b", 1.0), ("c", 2.0), ("d", None)], "book string, saved_at double")
    assert [tuple(r) for r in L.summary(books, toc, ch).collect()] == [("c", 2.0, 1, 0), ("b", 1.0, 2, 1), ("d", None, 0, 0)]
    titles = spark.createDataFrame([("b", 2, "new"), ("z", 1, "no")], "book string, id long, title string")
    assert rows(L.update_titles(toc, titles), "book", "id") == [("b", 1, "t1"), ("b", 2, "new"), ("c", 1, "u")]
    assert rows(L.unknown_ids(toc, titles).select("book", "id"), "book") == [("z", 1)]


def test_export_chunks_and_text(spark, tmp_path):
    ch = spark.createDataFrame([("b", i, f"t{i}") for i in (1, 2, 3, 101)], "book string, id long, text string")
    c = L.export_chunks(ch, 2)
    assert [(r["file"], r["first_file"]) for r in c.orderBy("id").collect()] == [("0001-0002", True), ("0001-0002", True), ("0003-0004", False), ("0101-0102", False)]
    L.write_text(c, str(tmp_path / "out"))
    texts = {p.parent.name: p.read_text() for p in (tmp_path / "out").rglob("*.txt")}
    assert texts["file=0001-0002"] == "t1\nt2\n"


def test_status_precedence(spark):
    toc = spark.createDataFrame([("b", k) for k in range(1, 6)], "book string, id long")
    jobs = spark.createDataFrame([("b", 1, "running")], "book string, id long, job_status string")
    err = spark.createDataFrame([("b", 1), ("b", 2)], "book string, id long")
    h = "book string, id long, raw_hash string, terms_hash string"
    done = spark.createDataFrame([("b", k, "r", "t") for k in (2, 3, 4)], h)
    now = spark.createDataFrame([("b", 3, "r", "t2"), ("b", 4, "r", "t")], h)
    assert [r["status"] for r in L.chapter_status(toc, jobs, err, done, now).orderBy("id").collect()] == ["running", "failed", "stale", "done", "none"]


def test_commit_if_unchanged(spark):
    ch = spark.createDataFrame([("b", 1, "x", 1.0), ("b", 2, "y", 1.0)], CH)
    done = ch.select("book", "id", F.sha2(F.when(F.col("id") == 1, "x").otherwise("old"), 256).alias("raw_hash"))
    ok, refused = L.commit_if_unchanged(ch, done)
    assert [r["id"] for r in ok.collect()] == [1] and [r["id"] for r in refused.collect()] == [2]


def test_longest_prefix(spark):
    p = spark.createDataFrame([("https://a.org", "root"), ("https://a.org/x/", "deep"), ("http://b.org/", "b")], "prefix string, name string")
    u = spark.createDataFrame([(1, "HTTPS://A.org/x/1"), (2, "https://a.org/xy"), (3, "https://a.org"), (4, "http://c.org/"), (5, None)], "id long, url string")
    assert [r["source_name"] for r in registry.bind(u, "url", p).orderBy("id").collect()] == ["deep", "root", "root", None, None]


def test_chain_of_many_pages_is_whole(spark):
    pages = spark.createDataFrame([(f"u{k}", f"u{k + 1}" if k < 25 else None, f"{k},") for k in range(26)], "url string, next string, body string")
    start = spark.createDataFrame([(1, "u0"), (2, "u20")], "chapter long, url string")
    whole = [f"{k}," for k in range(26)]
    assert rows(registry.chain(pages, start), "chapter") == [(1, 26, "".join(whole)), (2, 6, "".join(whole[20:]))]


def test_chains_and_volumes(spark):
    pages = spark.createDataFrame([("u1", "u2", "a"), ("u2", "u3", "b"), ("u3", "u1", "c"), ("v", None, "d")], "url string, next string, body string")
    start = spark.createDataFrame([(1, "u1"), (2, "v")], "chapter long, url string")
    assert rows(registry.chain(pages, start), "chapter") == [(1, 3, "abc"), (2, 1, "d")]
    e = spark.createDataFrame([("b", 1, True), ("b", 2, False), ("b", 3, True), ("b", 4, False)], "book string, pos long, is_volume boolean")
    assert [(r["volume"], r["id"]) for r in registry.fill_volumes(e, ["book"], "pos").orderBy("pos").collect()] == [(1, 1), (2, 2)]


def test_json_library(spark, tmp_path):
    ch = spark.createDataFrame([("b", i, "t", "u", "x", 1.0) for i in (1, 150)], "book string, id long, title string, url string, body string, fetched_at double")
    store.write_chapters(ch, str(tmp_path / "lib"))
    assert (tmp_path / "lib" / "book=b" / "chunk=0101-0200").is_dir()
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "a.json").write_text('{"book_id": "b", "toc": [{"id": 1, "title": "t", "url": ""}]}')
    (tmp_path / "meta" / "bad.json").write_text("{nope")
    good, bad = store.read_books(spark, str(tmp_path / "meta"))
    assert [(r["book"], r["id"]) for r in store.toc(good).collect()] == [("b", 1)] and bad.count() == 1
    store.publish(ch, str(tmp_path / "pub"))
    first = store.published(spark, str(tmp_path / "pub"))
    store.publish(ch.limit(1), str(tmp_path / "pub"))
    assert store.published(spark, str(tmp_path / "pub")).count() == 1 and first.count() == 2  # the one before can still be read
    store.publish(ch, str(tmp_path / "pub"))
    assert len(list((tmp_path / "pub").glob("v-*"))) == 2
    assert [r["id"] for r in L.find_chapter(str(tmp_path / "lib"), spark, "b", 150).collect()] == [150]
    log = spark.createDataFrame([("1", "2024-01-01", "op", "logical"), ("2", "2024-01-02", "op", "attempt")], "id string, timestamp string, operation string, event string")
    store.append_log(log, str(tmp_path / "log"))
    assert [r["id"] for r in store.tail(spark, str(tmp_path / "log"), 1).collect()] == ["2"]


def test_statistics(spark):
    e = spark.createDataFrame([("a", "logical"), ("a", "attempt"), ("b", "attempt")], "operation string, event string")
    got = {r["operation"]: (r["logical_calls"], r["api_attempts"]) for r in S.request_statistics(e, ["operation"]).collect()}
    assert got == {"a": (1, 1), "b": (0, 1), None: (1, 2)}
    b = spark.createDataFrame([(5, 6, 11, 0), (5, 1, 20, 0), (5, 1, 30, 0), (5, 1, 3, 60), (5, 1, 3, 0)], "translation_calls long, repair_calls long, logical_calls long, api_attempts long")
    assert [r["severity"] for r in S.budget_anomalies(b, F.lit(1)).collect()] == ["severe", "warning", "fatal", "fatal", None]
    m = spark.createDataFrame([("k", float(x)) for x in (1, 2, 3, 4)], "k string, ratio double")
    assert S.upper_median_ratio(m, ["k"], "ratio", 4, 0.5).first()["upper_median"] == 3.0
    s = spark.createDataFrame([("k", i, n) for i, n in enumerate([100, 100, 100, 20, 5])], "k string, id long, n long")
    f = S.short_bodies(s, ["k"], "n", 0.3, 10)
    assert sorted(r["id"] for r in f.collect()) == [3, 4]
    again = spark.createDataFrame([("k", 3, 90), ("k", 4, 6)], "k string, id long, n long")
    assert {r["id"]: r["recovered"] for r in S.recheck(f, again, ["k", "id"], "n", 0.3, 10).collect()} == {3: True, 4: False}
