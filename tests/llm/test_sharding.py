import zlib

import numpy as np
import pytest

from quire.llm import sharding


def test_law_and_slots(documents, clash):
    rows = {}
    for r in documents.collect():
        rows.setdefault(r["doc_id"], []).append((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())))
    out = sharding.shard(clash).collect()
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["size"], r["text_crc32"]))
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in rows.items()}
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_balance_with_a_hot_group(spark):
    rows = [(i, "same text here" if i % 3 == 0 else "x" * (i % 97) + str(i)) for i in range(6000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size, n = np.zeros(8), np.zeros(8)
    for r in out:
        size[r["shard"]] += r["size"]
        n[r["shard"]] += 1
    assert size.max() / size.min() < 1.02 and n.max() / n.min() < 1.03


def test_groups_stay_whole(spark):
    rows = [(i, f"text {i % 500} " * 3) for i in range(2000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    where = {}
    for r in out:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert {len(s) for s in where.values()} == {1}


@pytest.mark.parametrize("share", [0.03, 0.07, 0.10, 0.12, 0.33])
def test_a_group_is_whole_up_to_a_shards_share(spark, share):
    """One text in a part of the rows, of about the others' length: up to an eighth it has one shard; a third is dealt over all."""
    rng = np.random.default_rng(4)
    n = 6000
    rows = [(i, "the text of the group " * 3 if i < share * n else " ".join(f"w{x}" for x in rng.integers(0, 999, 8 + int(rng.integers(0, 14))))) for i in range(n)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).toPandas()
    group = out[out["doc_id"] < share * n].groupby("shard")["size"].sum()
    assert len(group) == (1 if share < 0.125 else 8)
    size = out.groupby("shard")["size"].sum()
    assert size.max() / size.min() < 1.02
    others = out[out["doc_id"] >= share * n].groupby("text_crc32")["shard"].nunique()
    assert others.max() == 1


def brute_place(vectors, shards):
    """The placement rule, one vector and shard at a time."""
    total = [sum(v[k] for v in vectors) or 1 for k in range(3)]
    left = [[1.0] * 3 for _ in range(shards)]
    scaled = [[v[k] / total[k] * shards for k in range(3)] for v in vectors]
    out = [0] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: (-sum(scaled[i]), i)):
        gain = [sum(left[s][k] * scaled[i][k] * w for k, w in enumerate(sharding.WEIGHTS)) for s in range(shards)]
        out[i] = best = max(range(shards), key=lambda s: (round(gain[s], 12), -s))
        for k in range(3):
            left[best][k] -= scaled[i][k]
    return out


def test_place_by_brute_force():
    rng = np.random.default_rng(9)
    for shards in (2, 3, 8):
        v = rng.integers(1, 10**6, (200, 3)).astype(float)
        assert sharding.place(v, shards).tolist() == brute_place(v.tolist(), shards)


def test_place_prefers_room():
    v = np.array([[4, 1, 1], [4, 1, 1], [1, 4, 1], [1, 4, 1]], float)
    got = sharding.place(v, 2)
    assert sorted(zip(got.tolist(), v[:, 0])) == [(0, 1.0), (0, 4.0), (1, 1.0), (1, 4.0)]


def test_empty(empty):
    assert sharding.shard(empty).collect() == []
