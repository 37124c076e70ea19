"""Queries against their SQL, on rows that the given tables of small sizes don't have."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__

from quire.plans import catalog
from quire.sources import store
from quire.streaming import jobs

WORDS = ["a", "a\n", "A", "is\n", "Straße", "STRASSE", "strasse", "Ære", "aere", "ære", "b1", "\nc", "ÿ", "×", "é", "É"]
PAGE = '<html><head><title>{0}</title></head><body><h1>{0}</h1><ul><li><a href="/x?a=1&amp;b=2&lt=3">x</a></li></ul><p>{0}</p><script>if (a && b) "&amp;"</script></body></html>'
TITLES = ["A &amp; B", "cut &amp", "cut &am", "cut &a", "a &quot;word&quot;", "cut &quot", "1 &lt; 2 &gt; 0", "&lt", "&copy; x", "&eacute &times y", "&", "&;", "R&D"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(k, f"{w} {v}") for k, w in enumerate(WORDS) for v in WORDS[k:]], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, PAGE.format(t)) for k, t in enumerate(TITLES * 3)], "page_id long, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["titles_by_locale", "names_spelled_alike", "page_title", "page_metadata", "html_text", "adapter_pages"])
def test_equal_to_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    d = __spark_entry__.queries()[name](spark, tables)
    want = con.execute(f"SELECT {', '.join(d.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, d.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["names_spelled_alike", "titles_by_locale"])
def test_words_of_whole_texts(spark, tmp_path, name):
    """Words after a text's first 400 characters, in a text's middle and at its end, and a name that begins before them and ends after."""
    long = " ".join(["ab", "Cd"] * 66) + " cut" + "x" * 30
    texts = [long + " Late late" + " y" * 3000 + " Éa éa end", "LATE", "z" * 500 + " É", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    d = __spark_entry__.queries()[name](spark, str(tmp_path))
    got = [tuple(r) for r in d.collect()]
    assert sorted(got) == sorted(con.execute(f"SELECT {', '.join(d.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())
    assert {"end", "z" * 500, "cut" + "x" * 30} < {r[0] for r in got}


def test_outcomes_of_blank_and_of_long_texts(spark, tmp_path):
    """A blank document is no book and isn't told of; a text that packs very well is one like any other."""
    texts = ["", " \n", "\t", "x", "y z", "a b " * 400_000]
    rows = [(50 * k + r, t, f"s{k % 2}") for k, t in enumerate(texts) for r in (0, 1, 5, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("upload_outcomes", "uploaded_chapters"):
        d = __spark_entry__.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(d.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, d.collect()), key=str) == sorted(want, key=str)


def test_a_library_has_few_folders(spark, tmp_path, monkeypatch):
    spark.range(0, 3000, 10).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(catalog, "shared_folder", lambda *_: str(tmp_path / "library"))
    assert catalog.library_round_trip(spark, str(tmp_path)).count() == 300
    assert len(list((tmp_path / "library").glob("book=*/chunk=*"))) == 1  # a hundred ids had a folder of their own, 30 of them
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000  # documents go to Python by so many rows


def test_text_files_are_written_and_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Against the SQL, with names that are escaped in folders and a book without one; no index of Spark's lists the folders, and what was there before goes."""
    names = ["a", "a b", "c/d:e=%f", "é+", "", ".x", None]
    rows = [(k, names[k % 7], f"t{k}\nÜ" if k % 5 else "") for k in range(0, 700, 3)] + [(k, "a", "same number") for k in (0, 300)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    folder = tmp_path / "texts"
    (folder / "book=old" / "file=0001-0100").mkdir(parents=True)
    (folder / "book=old" / "file=0001-0100" / "text.txt").write_text("old")
    monkeypatch.setattr(catalog, "shared_folder", lambda *_: str(folder))
    d = catalog.text_files(spark, str(tmp_path))
    assert not d.inputFiles()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(d.columns)} FROM ({catalog.oracle_sql()['text_files'].replace('ORDER BY doc_id', 'ORDER BY doc_id, text')})").fetchall()
    assert sorted(map(tuple, d.collect()), key=str) == sorted(want, key=str) and len(want) == 49
    assert len(list(folder.glob("book=*/file=*/text.txt"))) == len(want)


def test_hidden_texts_are_left_out(spark, tmp_path):
    for name, data in {"a.txt": b"\xef\xbb\xbfA", "x/y/b.txt": b"B\r\n", "x/empty.txt": b"", "_SUCCESS": b"", ".c.txt": b"C", "x/_temporary/d.txt": b"D", "_k=1/e.txt": b"E"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["file"].removeprefix(f"file:{tmp_path}/"): r["text"] for r in store.raw_texts(spark, f"file:{tmp_path}").collect()}
    assert got == {"a.txt": "A", "x/y/b.txt": "B\r\n", "x/empty.txt": "", "_k=1/e.txt": "E"}
    assert [tuple(r) for r in store.raw_texts(spark, f"{tmp_path}/a.txt").collect()] == [(f"{tmp_path}/a.txt", "A")]
    assert store.raw_texts(spark, f"{tmp_path}/x/_temporary/").count() == 1


class Kept:
    """A value and a list as the state's store has them, and the messages that it got."""

    def __init__(self):
        self.value, self.rows, self.calls = None, [], 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value if self.value is not None else iter(self.rows)

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def put(self, rows):
        self.rows, self.calls = list(rows), self.calls + 1

    def appendList(self, rows):  # noqa: N802
        self.put(self.rows + list(rows))


def test_a_batch_of_lines_is_one_message():
    m = jobs.Machine(5)
    m.at, m.last = Kept(), Kept()
    lines = [f"l{k}" if k % 4 else None for k in range(60)]
    for a, b in ((0, 3), (3, 6), (6, 9), (9, 40), (40, 42), (42, 60)):
        batch = pd.DataFrame({"id": range(a, b), "ts": pd.to_datetime(range(a, b), unit="s"), "event": "x", "line": lines[a:b]})
        list(m.handleInputRows(("j",), iter([batch.iloc[::-1]]), None))
        assert m.last.rows == [(x,) for x in lines[:b] if x][-5:]
    assert m.last.calls <= 12
