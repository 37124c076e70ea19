import hashlib
import re

from quire.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, repeat=3):
    size = [len(WORD.findall(r["text"] or "")) for r in rows]
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows) if r["source"] == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(size)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= repeat * total[s]}
        if not over:
            target |= share
            break
        target |= {s: float(repeat * total[s]) for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return size, total, target


def check(rows, out):
    size, total, target = brute(rows)
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], r)
    assert len(out) == len(rows)
    by = {}
    for n, r in zip(size, rows):
        o = got[r["doc_id"]]
        assert o["source_size"] == total[r["source"]] or r["doc_id"] is None
        if r["doc_id"] is not None:
            assert abs(o["target"] - target[r["source"]]) < 1e-6 and o["size"] == n
        assert o["taken"] <= 3 * o["size"] and (o["taken"] == 0 or o["taken"] % o["size"] == 0)
        by.setdefault(r["source"], []).append((n, o["taken"]))
    return by, total, target


def test_against_brute_force(documents, clash):
    rows = [r for r in documents.where("doc_id is not null").collect()]
    by, total, target = check(rows, mixing.mix(clash.where("doc_id is not null")).collect())
    for s, takes in by.items():
        largest = max(n for n, _ in takes)
        if s == "a":
            largest *= 2  # a repeated row shares its fate
        assert abs(sum(t for _, t in takes) - target[s]) <= largest


def test_nearest_threshold(spark):
    d = spark.createDataFrame([(i, "x " * (i % 7 + 1), "ab"[i % 5 == 0]) for i in range(500)], "doc_id long, text string, source string")
    out = mixing.mix(d).collect()
    for s in ("a", "b"):
        own = sorted((hashlib.md5(f"{r['doc_id']}:mix:{'x ' * (r['doc_id'] % 7 + 1)}".encode()).hexdigest()[:15], r["size"], r["taken"]) for r in out if (r["doc_id"] % 5 == 0) == (s == "b"))
        target = next(r["target"] for r in out if (r["doc_id"] % 5 == 0) == (s == "b"))
        times = [t // n for _, n, t in own]
        assert times == sorted(times, reverse=True) and len(set(times)) <= 2
        assert abs(sum(t for _, _, t in own) - target) <= 3.5
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(d.repartition(5)).collect()))


def test_take_repeats_rows(documents):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(documents.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    got = {}
    out = mixing.take(documents.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert out.columns == documents.columns
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_empty(empty, spark):
    assert mixing.mix(empty).collect() == [] and mixing.take(empty).collect() == []
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix(none).collect()} == {(0, 0.0, 0)}


def test_rows_with_one_id_are_told_apart_by_their_texts(spark):
    """Half of the ids null: the words taken come near their target all the same."""
    d = spark.createDataFrame([(None if i % 2 else i, f"w{i} " * (i % 7 + 1), "ab"[i % 3 == 0]) for i in range(3000)], "doc_id long, text string, source string")
    got = {}
    for r in mixing.mix(d).select("source_size", "target", "taken").collect():
        got.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert len(got) == 2 and all(abs(sum(taken) - target) <= 7 for (_, target), taken in got.items())
