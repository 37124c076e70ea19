from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.llm import url_filter as U

DAY = datetime(2024, 1, 1)


def d(n):
    return DAY + timedelta(days=n)


ENTRIES = [("a.org", "block", d(1)), ("a.org", "remove", d(5)), ("a.org", "block", d(9)), ("x.a.org", "allow", d(2)), ("x.a.org/bad", "block", d(3)), ("b.com", "block", d(4)), ("b.com", "allow", d(4)), (None, "block", d(0)), ("c.com", "block", None), ("a.org", "block", d(1))]
URLS = ["http://x.a.org/ok", "https://x.a.org/bad/1?q#f", "http://a.org", "http://A.ORG:80/", "http://b.com/x/y/z/w", "nohost", None, "", "http://aa.org/"]


def brute(captures):
    out = []
    for i, url, t in captures:
        host = "" if not url or "://" not in url else url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].split(":")[0].lower()
        keys = set()
        if host:
            labels = host.split(".")
            keys = {".".join(labels[k:]) for k in range(len(labels))}
            path = [p for p in url.split("://")[1].partition("/")[2].split("?")[0].split("#")[0].split("/") if p]
            keys |= {host + "/" + "/".join(path[:k]) for k in range(min(3, len(path)) + 1)}
        active = {}
        for k in keys:
            past = [(s, v) for e, v, s in ENTRIES if e == k and s is not None and t is not None and s <= t]
            if past and max(past)[1] != "remove":
                active[k] = max(past)[1]
        best = max(active, key=lambda k: (len(k), k), default=None)
        out.append((i, url, t, len(active), best, active.get(best) != "block"))
    return out


key = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("limit", [100, 0])
def test_against_brute_force(spark, limit):
    captures = [(k, u, t) for k, (u, t) in enumerate((u, t) for u in URLS for t in (d(0), d(3), d(4), d(5), d(9), None))]
    captures += [captures[3], (None, URLS[0], d(3))]
    c = spark.createDataFrame(captures, "page_id long, url string, at timestamp").withColumns({x: F.lit(1) for x in ("key", "verdict", "since", "until", "same", "k", "best", "capture_id")})
    e = spark.createDataFrame(ENTRIES, "key string, verdict string, since timestamp")
    got = [tuple(r) for r in U.filter_urls(c, e, "page_id", "url", "at", broadcast_rows=limit).collect()]
    assert sorted(got, key=key) == sorted(brute(captures), key=key)


def test_deep_paths(spark):
    """An entry of any number of segments matches what is below it; the longest decides."""
    deep = "h.org/a/b/c/d/e"
    e = spark.createDataFrame([(deep, "block", d(0)), (deep + "/f", "allow", d(0)), ("h.org/", "block", d(1))], "key string, verdict string, since timestamp")
    urls = ["http://h.org/a/b/c/d", "http://h.org/a/b/c/d/e", "http://h.org/a/b/c/d/e/g/h", "http://h.org/a/b/c/d/e/f/g"]
    c = spark.createDataFrame([(k, u, d(0)) for k, u in enumerate(urls)], "page_id long, url string, at timestamp")
    got = {r["capture_id"]: (r["matched"], r["keep"]) for r in U.filter_urls(c, e, "page_id", "url", "at").collect()}
    assert got == {0: (None, True), 1: (deep, False), 2: (deep, False), 3: (deep + "/f", True)}


def test_empty(spark):
    c = spark.createDataFrame([(1, "http://a.org", d(1))], "page_id long, url string, at timestamp")
    e = spark.createDataFrame(ENTRIES, "key string, verdict string, since timestamp")
    assert U.filter_urls(c.limit(0), e, "page_id", "url", "at").collect() == []
    assert U.filter_urls(c, e.limit(0), "page_id", "url", "at").collect()[0]["keep"]
