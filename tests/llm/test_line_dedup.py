from collections import Counter

from pyspark.sql import functions as F

from quire.llm import line_dedup as L


def brute(rows, ratio, least):
    total, seen = Counter(h for _, h, _ in rows), Counter()
    for _, h, t in rows:
        seen.update((h, x) for x in set((t or "").split("\n")) if x.strip(" "))
    drop = {k for k, n in seen.items() if n >= least and n > total[k[0]] * ratio}
    out = []
    for i, h, t in rows:
        lines = t.split("\n") if t is not None else None
        kept = None if lines is None else [x for x in lines if (h, x) not in drop]
        out.append((i, h, None if lines is None else "\n".join(kept), len(lines or []), len(lines or []) - len(kept or [])))
    return out


key = lambda r: tuple((x is None, str(x)) for x in r)


def test_against_brute_force(spark):
    rows = [(i, ["x", "x", "y", None][i % 4], f"menu\nline {i}\n\n{'rare' if i % 7 == 0 else 'body'}\nline {i}\n ") for i in range(60)]
    rows += [(60, "x", None), (61, "x", ""), (62, "z", "menu\nmenu"), (63, "x", "menu\n" * 2000), rows[5]]
    d = spark.createDataFrame(rows, "page_id long, site string, body string").withColumns({c: F.lit(0) for c in ("row", "host", "x", "h", "n", "kept", "drop", "drop_host", "pages", "lines")})
    out = L.drop_boilerplate(d, F.col("site"), F.col("body"), 0.3, 3)
    got = [tuple(r) for r in out.select("page_id", "line_host", "lines", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 0.3, 3), key=key)
    assert [c for c in out.columns if c not in ("line_host", "lines", "n_lines", "n_dropped")] == [c for c in d.columns if c != "lines"]
    assert any(r[4] for r in got)


def test_native_plan(spark):
    d = spark.createDataFrame([(1, "x", "a\nb")], "page_id long, site string, body string")
    plan = L.drop_boilerplate(d, F.col("site"), F.col("body"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty(spark):
    d = spark.createDataFrame([], "page_id long, site string, body string")
    assert L.drop_boilerplate(d, F.col("site"), F.col("body")).collect() == []


def test_html_and_hosts(spark):
    row = [("https://u:p@WWW.Example.org:80/a?b#c", '<html><head><script>var t="</p>";</script></head><body><p><b>One<br>two</p><!-- x\n--><div>three<i>!</i></body>'), (None, None), ("nohost", "")]
    got = spark.createDataFrame(row, "u string, h string").select(L.host_of(F.col("u")), L.html_lines(F.col("h"))).collect()
    assert got[0][0] == "www.example.org" and [x for x in got[0][1].split("\n") if x.strip()] == ["One", "two", " three!".strip()]
    assert tuple(got[1]) == (None, None) and tuple(got[2]) == ("", "")
