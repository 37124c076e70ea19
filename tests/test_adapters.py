import re

import pytest

from quire.functions import html as H
from quire.sources import adapters as A

PAGE = """<html><head><meta property="og:title" content="T"><meta name="author" content="Au"></head><body><div id="d" class="a b"><ul><li><a href="/1">One</a></li><li>
<a href="/2" rel="x">Two</a></li><li><a href="/1">One again</a></li></ul><p class="c">x<img data-src="i.png"></p></div><div class="content"><p>Body</p><script>s</script></div></body></html>"""


def test_selectors():
    root = H.parse(PAGE)
    count = {"a": 3, "div.a a": 3, "#d > ul > li a[href='/1']": 2, "a[href*=2]": 1, "a:not([rel])": 2, "li:nth-child(2) a": 1, "p, .c": 2, "div > a": 0, "#d .zzz": 0, "*": 18, "a[rel]": 1}
    assert {k: len(H.select(root, k)) for k in count} == count


def test_pages(spark):
    sources = [{"prefix": "https://s.org/", "chapters": "#d li a", "body": ".content", "cover": "p.c img"}]
    d = spark.createDataFrame([(1, "https://s.org/x", PAGE), (2, "https://other.org/", PAGE), (3, None, None)], "id long, url string, html string")
    got = {r["id"]: r["page"] for r in A.read_pages(d, "url", "html", sources).collect()}
    assert (got[1]["title"], got[1]["author"], got[1]["cover"], got[1]["body"]) == ("T", "Au", "i.png", "<p>Body</p>")
    assert [(c["url"], c["title"]) for c in got[1]["chapters"]] == [("/1", "One"), ("/2", "Two")]
    assert got[2]["title"] == "T" and got[2]["body"] is None and got[3]["title"] is None


def element(simple):
    """An opening and a closing tag that a simple selector finds."""
    tag = re.match(r"[a-z]\w*", simple)
    tag = tag.group() if tag else "meta" if "property" in simple else "a" if "href" in simple else "div"
    attrs = "".join(f' id="{x}"' for x in re.findall(r"#([\w-]+)", simple)) + (f' class="{c}"' if (c := " ".join(re.findall(r"\.([A-Za-z][\w-]*)(?![^\[]*\])", simple))) else "")
    attrs += "".join(f' {k}="{v}"' for k, v in re.findall(r"\[([\w:-]+)[*^$]?='(.*?)'\]", simple))
    return tag, attrs


def page_for(selector, text, **more):
    """A page in which the first of a list of selectors finds an element with the text."""
    steps = re.findall(r"(?:\[[^\]]*\]|\([^)]*\)|[^\s>\[(])+", selector.split(",")[0])
    out = text
    for k, simple in enumerate(reversed(steps)):
        tag, attrs = element(simple)
        attrs += "".join(f' {n}="{v}"' for n, v in more.items() if k == 0 and f" {n}=" not in attrs)
        nth = re.search(r"nth-child\((\d+)\)", simple)
        out = "<i></i>" * (int(nth.group(1)) - 1 if nth else 0) + (f"<{tag}{attrs}>" if tag in H.VOID else f"<{tag}{attrs}>{out}</{tag}>")
    return f"<html><body>{out}</body></html>"


SITES = (
    "17ktxt novel543 powanjuan qbmfxs soxs trxs twkan truyenfull truyentr xtruyen hako docln 1qxs 27k lreads 69shuba.com 69shu.com 69xinshu 69shu.pro 69shuba.pro 69shuba.cx 69shu.me daocaorenshuwu ddxss ddtxt8 "
    "ixdzs8.tw ixdzs8.com tw.m.ixdzs aixdzs piaotian ptwxz piaotia.com shuhaige shw5 bq99 p2wt www.uukanshu tw.uukanshu sj.uukanshu xbanxia www.banxia xnunu"
)


def test_every_site_of_the_survey_has_a_source():
    assert not [s for s in SITES.split() if not any(s in x["prefix"] for x in A.SOURCES)]
    assert len({x["prefix"] for x in A.SOURCES}) == len(A.SOURCES)


@pytest.mark.parametrize("source", A.SOURCES, ids=lambda s: s["prefix"])
def test_a_page_of_each_source(source):
    for field in ("title", "author", "synopsis", "tags"):
        if source.get(field):
            got = A.read_page(page_for(source[field], "here", content="here"), source)[field]
            assert got == (["here"] if field == "tags" else "here"), field
    if source.get("cover"):
        assert A.read_page(page_for(source["cover"], "", content="c.png", **{"data-original": "c.png", "src": "wait.gif"}), source)["cover"] == "c.png"
    chapters = A.read_page(page_for(source["chapters"], "One", href="/1.html"), source)["chapters"]
    assert [c["title"] for c in chapters] == ["One"]
    assert "Body" in A.read_page(page_for(source["body"], "<p>Body</p>"), source)["body"]


def test_sources_are_bound(spark):
    d = spark.createDataFrame([(k, s["prefix"] + "book/1") for k, s in enumerate(A.SOURCES)], "id long, url string").selectExpr("*", "'<h1>x</h1>' AS html")
    got = {r["id"]: r["source_name"] for r in A.read_pages(d, "url", "html").collect()}
    assert got == {k: s["prefix"] for k, s in enumerate(A.SOURCES)}


def test_pages_as_they_were_fetched(spark):
    """Each in its site's encoding and order; other columns stay, and a page of no site is read as UTF-8."""
    listed = '<div id="catalog"><ul><li><a href="/b">乙</a></li><li><a href="/a">甲</a></li></ul></div>'
    rows = [
        (1, "https://www.69shuba.com/x", listed.encode("gbk"), "kept"), (2, "https://www.69shuba.com/x", "é乙".encode("utf-8") + b"\xff", "kept"), (3, "https://nowhere.org/", "<title>é</title>".encode(), "kept"),
        (4, "https://www.shuhaige.net/x", b'<a href="/9.html">z</a><a href="/1.html">a</a><a href="/q/9.html">y</a><a href="/n.html">n</a>', "kept"), (5, None, None, None),
    ]
    out = {r["id"]: r for r in A.read_fetched(spark.createDataFrame(rows, "id long, url string, content binary, bound_note string"), "url", "content").collect()}
    links = lambda i: [tuple(c) for c in out[i]["page"]["chapters"]]
    assert links(1) == [("/a", "甲"), ("/b", "乙")] and links(4) == [("/1.html", "a"), ("/q/9.html", "y")]
    assert out[2]["page"] is None and out[5]["page"] is None and out[3]["page"]["title"] == "é" and out[3]["source_name"] is None
    assert out[1]["bound_note"] == "kept" and set(out[1].asDict()) == {"id", "url", "content", "bound_note", "source_name", "page"}
