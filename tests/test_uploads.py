"""The data source of uploads, a log's tail, tables published together, and jobs as a state machine."""

import io
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.sources import archives, books, store
from quire.streaming import events as S
from quire.streaming import jobs


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_members_are_read_one_by_one(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped([(f"{k}.txt", f"text {k} " * 20) for k in range(9)] + [("../x.txt", "x"), ("__MACOSX/y.txt", "y"), ("c.pdf", "z"), ("0.txt", "again")]))
    (tmp_path / "b.txt").write_bytes("Ünder".encode())
    (tmp_path / "c.zip").write_bytes(b"no archive")
    (tmp_path / "d.doc").write_bytes(b"d")
    (tmp_path / ".hidden.txt").write_bytes(b"h")
    d = books.read_uploads(spark, f"file:{tmp_path}", task=100)
    assert d.rdd.getNumPartitions() >= 9  # no task has two members of over 100 bytes
    got = sorted((r["member"], r["kind"], r["problem"], bytes(r["data"]).decode()[:6] if r["data"] else None) for r in d.collect())
    assert got == sorted(
        [(f"a.zip/{k}.txt", "book", None, f"text {k}") for k in range(9)]
        + [("a.zip/../x.txt", "error", "unsafe path", None), ("a.zip/c.pdf", "skipped", None, None), ("a.zip/0.txt", "error", "duplicate member", None), ("b.txt", "book", None, "Ünder"), ("c.zip", "error", "File is not a zip file", None), ("d.doc", "error", "unsupported format", None)]
    )
    assert {"Exchange"} & set(d._jdf.queryExecution().executedPlan().toString().split()) == set()


def test_the_limits_of_a_request(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.zip").write_bytes(zipped([("t.txt", "x" * 100 * (k + 1))]))
    kinds = lambda **o: [r["kind"] for r in books.read_uploads(spark, str(tmp_path), **o).orderBy("file").collect()]
    assert kinds() == ["book"] * 4
    assert kinds(expanded=350) == ["book", "book", "error", "error"]  # 100 and 200; 300 is too much, and so is 400
    assert kinds(expanded=500) == ["book", "book", "error", "error"] and kinds(expanded=1000) == ["book"] * 4
    assert kinds(entries=2) == ["book", "book", "error", "error"]
    empty = tmp_path / "none"
    empty.mkdir()
    assert books.read_uploads(spark, str(empty)).collect() == []


def test_a_member_larger_than_it_says(tmp_path):
    data = bytearray(zipped([("t.txt", "x" * 3000)]))
    at = data.rindex(b"PK\x01\x02") + 24  # the expanded size in the directory
    data[at : at + 4] = (10).to_bytes(4, "little")
    (tmp_path / "a.zip").write_bytes(bytes(data))
    reader = books.Reader({"path": str(tmp_path)})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(r[2], r[4]) for r in rows] == [("error", None)]


def test_a_task_opens_no_directory(tmp_path, monkeypatch):
    texts = {f"{k}.txt": f"text {k} " * 200 for k in range(40)} | {"é.txt": "a name in UTF-8", "none.txt": ""}
    (tmp_path / "a.zip").write_bytes(b"before the archive" + zipped(texts.items()))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        for how in (zipfile.ZIP_STORED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA):
            z.writestr(f"{how}.txt", f"packed by {how} " * 50, how)
    reader = books.Reader({"path": str(tmp_path), "task": "3000"})
    parts = reader.partitions()
    opened, own = [], zipfile.ZipFile
    monkeypatch.setattr(zipfile, "ZipFile", lambda *a, **k: opened.append(1) or own(*a, **k))
    got = {r[1]: bytes(r[4]).decode() for p in parts for r in reader.read(p)}
    assert {k[6:]: v for k, v in got.items() if k.startswith("a.zip/")} == texts
    assert [got[f"b.zip/{how}.txt"] for how in (0, 12, 14)] == [f"packed by {how} " * 50 for how in (0, 12, 14)]
    assert len(opened) == 2  # for the two packed in a rare way; each member of an archive opened it before


def test_a_damaged_member_is_an_error(tmp_path):
    data = bytearray(zipped([("t.txt", "x" * 3000), ("u.txt", "y" * 3000), ("v.txt", "z" * 3000)]))
    at = data.rindex(b"PK\x01\x02") + 16  # the last one's CRC in the directory
    data[at] ^= 1
    data[data.index(b"u.txt")] = ord("w")  # another name in the second one's own header
    (tmp_path / "a.zip").write_bytes(bytes(data))
    reader = books.Reader({"path": str(tmp_path)})
    assert [(r[1], r[2]) for p in reader.partitions() for r in reader.read(p)] == [("a.zip/t.txt", "book"), ("a.zip/u.txt", "error"), ("a.zip/v.txt", "error")]


def test_the_limit_of_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "UPLOAD", 100)
    (tmp_path / "a.txt").write_bytes(b"x" * 200)
    kinds = lambda **o: [p.known and p.known[0][2] or "book" for p in books.Reader({"path": str(tmp_path), **o}).partitions()]
    assert kinds(upload="100") == ["error"] and kinds(upload="200") == ["book"]


def test_written_archives_come_back(spark, tmp_path):
    rows = [(f"f{k % 3}.zip", f"{k}.txt", f"Chapter 1 x\nbody {k}".encode()) for k in range(30)]
    d = spark.createDataFrame(rows, "file string, member string, data binary").repartition(5)
    assert sorted(tuple(r)[:2] for r in books.write_zips(d, f"{tmp_path}/z").collect()) == [(f"f{k}.zip", 10) for k in range(3)]
    chapters, outcomes = archives.import_books(books.read_uploads(spark, f"{tmp_path}/z"))
    assert chapters.count() == 30 and outcomes.where("kind <> 'book'").count() == 0
    assert chapters.where("book = 'f0.zip/3.txt'").first()["body"] == "<p>Chapter 1 x<br/>body 3</p>"


def test_attempts_beside_each_other(tmp_path):
    """A task's first attempt goes on while a second one begins and is ended: the archive is whole."""
    texts = {f"{k}.txt": random.Random(k).randbytes(50_000) for k in range(8)}
    batch = lambda *ks: pa.RecordBatch.from_pylist([{"file": "a.zip", "member": f"{k}.txt", "data": texts[f"{k}.txt"]} for k in ks])

    def ended():
        yield batch(0)
        raise InterruptedError

    def first():
        yield batch(0, 1, 2, 3)
        with pytest.raises(InterruptedError):
            list(books.zipped(ended(), str(tmp_path)))
        yield batch(4, 5, 6, 7)

    list(books.zipped(first(), str(tmp_path)))
    reader = books.Reader({"path": str(tmp_path)})
    assert {r[1]: r[4] for p in reader.partitions() for r in reader.read(p)} == {f"a.zip/{k}": v for k, v in texts.items()}


def test_the_tail_of_a_long_log_opens_its_last_files(spark, tmp_path):
    path, row = tmp_path / "log", '{{"id": "{0}", "timestamp": "{1:06d}", "operation": "o", "event": "logical"}}\n'
    path.mkdir()
    import os

    for k in range(300):
        f = path / f"part-00000-{k:08d}-c000.json"
        f.write_text(row.format(k, k) + ("{broken\n" if k % 2 else ""))
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    out = store.tail(spark, str(path), 5)
    assert [r["id"] for r in out.collect()] == ["299", "298", "297", "296", "295"]
    assert len(out.inputFiles()) == 16
    assert store.tail(spark, str(path), 400).count() == 300 and store.tail(spark, str(tmp_path / "none")).collect() == []


def test_several_tables_appear_at_once(spark, tmp_path):
    path = str(tmp_path / "catalog")
    a, b = spark.range(3), spark.range(5)
    assert store.catalog_version(spark, path) == 0 and store.catalog_tables(spark, path) == {}
    assert store.publish_tables({"a": a, "b": a}, path) == 1
    before = store.read_published(spark, path, "b")
    assert store.publish_tables({"b": b}, path) == 2
    assert [store.read_published(spark, path, n).count() for n in "ab"] == [3, 5] and before.count() == 3
    with pytest.raises(Exception, match="broken"):
        store.publish_tables({"a": b, "b": b.select(F.raise_error(F.lit("broken")))}, path)
    with pytest.raises(FileExistsError):  # began at version 1, as the second writer had
        store.publish_tables({"a": b}, path, base=1)
    assert store.catalog_version(spark, path) == 2 and store.read_published(spark, path, "a").count() == 3
    assert store.read_published(spark, path, "b", version=1).count() == 3


def test_jobs_move_as_they_may(spark, tmp_path):
    rng = random.Random(2)
    names = ["running", "stopping", "done", "failed", "cancelled", "other"]
    rows = [(f"j{rng.randrange(12)}", k, k // 3, rng.choice(names), rng.choice(["line", None])) for k in range(300)]
    src = str(tmp_path / "in")
    kind = "job string, id long, s long, event string, line string"
    spark.createDataFrame(rows[:150], kind).repartition(3).write.parquet(src)
    e = lambda: S.read_stream(spark, src, spark.read.parquet(src).schema).withColumn("ts", F.timestamp_seconds("s"))
    run = lambda: S.run(jobs.transitions(e(), 5), lambda batch, number: batch.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "c"))
    with jobs.state_store(spark):
        run()
        spark.createDataFrame(rows[150:], kind).write.mode("append").parquet(src)
        run()  # goes on from the state that the first run left
    assert spark.conf.get(jobs.PROVIDER[0], "").endswith("RocksDBStateStoreProvider") is False
    want, now, seen = {}, {}, {}
    for job, k, _, event, line in rows:
        before = now.get(job, "pending")
        after = jobs.TRANSITIONS.get((before, event))
        seen[job] = seen.get(job, 0) + (line is not None)
        now[job] = after or before
        want[k] = (job, event, before, now[job], after is not None, max(0, seen[job] - 5), min(seen[job], 5))
    got = {r["id"]: (r["job"], r["event"], r["before"], r["state"], r["accepted"], r["first_line"], r["lines"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and any(not w[4] for w in want.values())
