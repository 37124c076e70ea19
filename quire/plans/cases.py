"""Queries on a few rows each, for what the driver's tables don't have: Chinese and Vietnamese text, dictionaries, archives, sites' pages. The SQL states what has to
come out, worked out from the rules and not from a run."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import numbers as N
from quire.functions import text as X
from quire.functions import unicode as U
from quire.operators import blocks, corpus, library, quality, stats, terms
from quire.plans.fixtures import ENTRIES, SCHEMA
from quire.sources import adapters, archives, registry

QUERIES: dict = {}


def case(values: str, columns: str):
    """A query whose result is these rows."""

    def add(f):
        QUERIES[f"case_{f.__name__}"] = (f, f"SELECT * FROM (VALUES {values}) t({columns})")
        return f

    return add


def listed(c, sep: str = "|"):
    return F.array_join(c, sep)


# ------------------------------------------------------------------ HTML


@case(
    """(1, '<p>One</p><p>two <b>bold</b></p>', 'menu\nOne\ntwo\nbold', 'menu\nOne\ntwo bold'), (2, '<p>a b c</p>', 'a\nb\nc', 'a\nbc'), (3, '<p><i>x</i></p><p><i>y</i> z</p>', 'x\ny\nz', 'x\nyz'),
(4, '<p>T</p><p><img src="q.png"/> end</p>', 'T\nno\nbuy\nend', 'T\nno\nbuy\n\nend'), (5, '', '', ''), (6, '<p>k &lt; 2</p>', 'k < 2', 'k < 2')""",
    "id, body, text, reader",
)
def html_bodies(spark, sf_dir):
    rows = [
        (1, "<body><nav>menu</nav><div>One<br>two <b>bold</b></div><script>var x</script></body>"), (2, "a<span><br>b</span>c"), (3, "<i>x<br>y</i>z"),
        (4, '<h2>T</h2><ins>no</ins><div class="ads">buy</div><p><img data-src="q.png" alt="z"> end</p>'), (5, ""), (6, "k &lt; 2"),
    ]
    d = spark.createDataFrame(rows, "id int, html string")
    return d.select("id", H.contents_udf("html").alias("body"), H.text_udf("html").alias("text"), H.reader_udf("html").alias("reader"))


@case("(1, '<p>Read at ␣ now</p><p>keep</p>'), (2, '<p style=\"font-style:italic\">a</p>')", "id, body")
def html_rules(spark, sf_dir):
    """A caller's rules: a selector, a tag, texts of a tag (an empty one goes too), a blacklist; and a verbatim block's kept attributes."""
    rules = H.Rules(css=["p.ad"], tags={"u"}, tag_texts={"span": ["^next"], "p": []}, blacklist=[r"site\.com"])
    page = "<div><p class='ad x'>buy</p><p>Read at site.com now</p><p></p><span>next page</span><h3>keep</h3><u>w</u></div>"
    d = spark.createDataFrame([(1, page)], "id int, html string").select("id", H.contents_by(rules)("html").alias("body"))
    styled = spark.createDataFrame([(2, "font-style: italic; color: red; FONT-SIZE: 3", "a")], "id int, style string, t string")

    @F.pandas_udf("string")
    def kept(s):
        return s.map(H.clean_style)

    return d.unionByName(styled.select("id", F.concat(F.lit('<p style="'), kept("style"), F.lit('">'), "t", F.lit("</p>")).alias("body")))


@case("(1, '<p>bpic</p>c<br>'), (2, '<table><tr><td>1</td></tr></table>x &amp; y'), (3, '')", "id, clean")
def html_sanitized_pages(spark, sf_dir):
    rows = [(1, '<body onload="x"><section><p style="a">b<img alt="pic" src="q"><script>z</script></p></section><font>c</font><br></body>'), (2, "<table><tr><td onclick='q'>1</td></tr></table><form>f</form><svg>s</svg>x &amp; y"), (3, "<script>only</script><!-- c -->")]
    return spark.createDataFrame(rows, "id int, html string").select("id", F.replace(H.sanitize_udf("html"), F.lit("<br/>"), F.lit("<br>")).alias("clean"))


@case("(1, '<p><img src=\"images/K.jpg\" alt=\"K\"/></p>', 'https://h.org/a.png'), (2, '<p>no image</p>', NULL), (3, '<img src=\"images/K.jpg\" alt=\"K\"/>', 'https://h.org/c/1/b.png')", "id, body, address")
def html_image_links(spark, sf_dir):
    rows = [(1, '<p><img src="/a.png" class="x"></p>', "https://h.org/c/1"), (2, "<p>no image</p>", "https://h.org/"), (3, '<img src="b.png">', "https://h.org/c/1/")]
    i = spark.createDataFrame(rows, "id int, html string, page string").select("id", H.images_udf("html", "page").alias("i"))
    k = F.get(F.map_keys("i.images"), F.lit(0))
    return i.select("id", F.coalesce(F.replace(F.col("i.body"), k, F.lit("K")), F.col("i.body")).alias("body"), F.get(F.map_values("i.images"), F.lit(0)).alias("address"))


@case("(1, 'Book', 'c.png', 'Au', 'Syn', 'x|y|z', 'H', '/1|/2'), (2, 'Plain', NULL, NULL, NULL, '', NULL, ''), (3, 'Only heading', NULL, NULL, NULL, '', 'Only heading', '')", "id, title, cover, author, synopsis, tags, heading, links")
def page_fields(spark, sf_dir):
    head = '<meta property="og:title" content="Book"><meta property="og:image" content="c.png"><meta name="author" content="Au"><meta name="description" content="Syn"><meta property="og:tag" content="x, y"><meta name="keywords" content="y,z">'
    rows = [(1, f'<head>{head}<title>No</title></head><h1> H </h1><a href="/1">1</a><a>n</a><a href="/2">2</a>'), (2, "<title> Plain\n</title>"), (3, "<h3>Only  heading</h3>")]
    m = spark.createDataFrame(rows, "id int, html string").select("id", H.metadata_udf("html").alias("m"))
    return m.select("id", "m.title", "m.cover", "m.author", "m.synopsis", listed("m.tags").alias("tags"), "m.heading", listed("m.links").alias("links"))


# ------------------------------------------------------------------ sites

PAGES = {
    "https://truyenfull.vn/": '<h3 class="title">T</h3><div class="info"><a itemprop="author">A</a></div><ul class="list-chapter"><a href="/1">One</a><a href="/2">Two</a></ul><div id="chapter-c">B</div>',
    "https://xtruyen.vn/": '<div class="post-title"><h1>T</h1></div><div class="author-content">A</div><ul class="main"><li class="wp-manga-chapter"><a href="/1">One</a></li><li class="wp-manga-chapter"><a href="/2">Two</a></li></ul><div class="reading-content">B</div>',
    "https://ln.hako.vn/": '<span class="series-name"><a>T</a></span><span class="info-value"><a href="/tac-gia/1">A</a></span><section class="volume-list"><ul class="list-chapters"><a href="/1">One</a><a href="/2">Two</a></ul></section><div id="chapter-content">B</div>',
    "https://www.17ktxt.com/": '<h1>T</h1><meta property="og:novel:author" content="A"><div class="book_list2"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><article class="font_max">B</article>',
    "https://www.1qxs.com/": '<h1>T</h1><div class="book-intro"><p class="author">A</p></div><a href="/xs_1/1">One</a><a href="/xs_1/2">Two</a><div class="content">B</div>',
    "https://www.27k.net/": '<div class="booknav2"><h1><a>T</a></h1><p><a href="/author/a">A</a></p></div><div id="catalog"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><div class="txtnav">B</div>',
    "https://www.69shuba.com/": '<div class="booknav2"><h1>T</h1><p><a href="author.php">A</a></p></div><div id="catalog"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><div class="txtnav">B</div>',
    "https://69shuba.cx/": '<div class="booknav2"><h1><a>T</a></h1><p><a>A</a></p></div><div id="catalog"><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></div><div class="txtnav">B</div>',
    "https://www.daocaorenshuwu.com/": '<div class="container"><div class="book-info"><h1 class="book-name">T</h1></div><div class="media-body"><div class="row"><div>A</div></div></div></div><div id="all-chapter"><a href="/1">One</a><a href="/2">Two</a></div><div class="cont-text">B</div>',
    "https://www.ddxss.cc/": '<div class="book"><div class="info"><h1>T</h1><div class="small"><span>A</span></div></div></div><div class="listmain"><a href="/1">One</a><a href="/2">Two</a></div><div id="chaptercontent">B</div>',
    "https://ixdzs8.com/": '<div class="novel"><div class="n-text"><h1>T</h1><a class="bauthor">A</a></div></div><ul class="u-chapter"><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul><article class="page-content"><section>B</section></article>',
    "https://www.novel543.com/": '<div id="detail"><div class="media-content"><h1 class="title">T</h1><p class="meta"><span class="author">A</span></p></div></div><div class="chaplist"><ul class="all"><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><div class="chapter-content"><div class="content">B</div></div>',
    "https://www.piaotian.com/": '<div class="title">T</div><div class="list">A</div><div class="centent"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><div id="content">B</div>',
    "https://www.powanjuan.cc/": '<div class="desc"><h1>T</h1></div><div class="descTip"><span>A</span></div><div class="catalog"><ul class="clearfix"><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><div id="mycontent">B</div>',
    "https://www.qbmfxs.com/": '<div class="book"><div class="detail"><div class="name"><h1>T</h1><span>A</span></div></div></div><div class="catalog"><div class="list"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div></div><div class="read"><div class="content">B</div></div>',
    "https://www.shuhaige.net/": '<div id="info"><h1>T</h1><p>A</p></div><a href="/1.html">One</a><a href="/2.html">Two</a><a href="/x">no</a><div id="content">B</div>',
    "https://www.shw5.cc/": '<div class="book"><h1>T</h1><div class="small"><span>A</span></div></div><div class="listmain"><a href="/1">One</a><a href="/2">Two</a><a rel="nofollow" href="/x">no</a></div><div id="chaptercontent">B</div>',
    "https://www.soxs.cc/": '<div class="xiaoshuo"><h1>T</h1><h6>A</h6></div><div class="novel_list"><dd><a href="/1">One</a></dd><dd><a href="/2">Two</a></dd></div><div class="content">B</div>',
    "https://trxs.cc/": '<div class="book_info"><h1>T</h1><a>A</a></div><div class="book_list"><a href="/1">One</a><a href="/2">Two</a></div><div class="read_chapterDetail">B</div>',
    "https://twkan.com/": '<h1>T</h1><meta property="og:author" content="A"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul><div id="txtcontent0">B</div>',
    "https://www.uukanshu.net/": '<dl class="jieshao"><dd class="jieshao_content"><h1><a>T</a></h1><h2><a>A</a></h2></dd></dl><ul id="chapterList"><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul><div id="contentbox">B</div>',
    "https://sj.uukanshu.net/": '<p class="bookname">T</p><div class="book-info"><dd>A</dd></div><ul id="chapterList"><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul><div id="bookContent">B</div>',
    "https://www.xbanxia.com/": '<div class="book-describe"><h1>T</h1><p><a href="/author/1">A</a></p></div><div class="book-list"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><div id="nr1">B</div>',
    "https://www.xnunu.com/": '<div class="book-bookinfo"><h1 class="name">T</h1><p><a class="btn-info">A</a></p></div><dl class="panel-chapterlist"><dd><a href="/1">One</a></dd><dd><a href="/2">Two</a></dd></dl><div id="chaptercontent">B</div>',
}


@case(", ".join(f"('{p}', 'T', 'A', '{'1.html' if 'shuhaige' in p else 'xs_1/1' if '1qxs' in p else '1'}:One|{'2.html' if 'shuhaige' in p else 'xs_1/2' if '1qxs' in p else '2'}:Two', '<p>B</p>')" for p in PAGES), "source_name, title, author, chapters, body")
def site_pages(spark, sf_dir):
    """A page of each of the 24 sites, read by the selectors of the source its address belongs to."""
    d = spark.createDataFrame([(f"{p}book/7", f"<html><body>{h}</body></html>") for p, h in PAGES.items()], "url string, html string")
    p = adapters.read_pages(d, "url", "html").select("source_name", "page.*")
    links = F.transform("chapters", lambda c: F.concat(F.regexp_replace(c["url"], "^/", ""), F.lit(":"), c["title"]))
    return p.select("source_name", "title", "author", listed(links).alias("chapters"), "body")


@case("(48, 48)", "sources, bound")
def every_source_is_bound(spark, sf_dir):
    t = adapters.sources_table(spark)
    d = t.select("prefix", F.concat(F.upper("prefix"), F.lit("a/b")).alias("url"))
    b = registry.bind(d, "url", t)
    return b.agg(F.count("*").cast("int").alias("sources"), F.count_if(F.col("prefix") == F.col("source_name")).cast("int").alias("bound"))


@case("('gbk', '中文'), ('gb2312', '中文'), ('utf-8', 'é'), ('bad', NULL)", "encoding, text")
def encodings(spark, sf_dir):
    """Pages in their source's encoding; bytes that don't fit give null."""
    rows = [("gbk", bytearray("中文".encode("gbk"))), ("gb2312", bytearray("中文".encode("gb2312"))), ("utf-8", bytearray("é".encode())), ("bad", bytearray(b"\xff\xff"))]
    d = spark.createDataFrame(rows, "encoding string, data binary")
    of = lambda e: U.decode(e)("data")
    return d.select("encoding", F.when(F.col("encoding") == "gbk", of("gbk")).when(F.col("encoding") == "gb2312", of("gb2312")).otherwise(of("utf-8")).alias("text"))


@case("('hako', 'Xin chào'), ('hako_reversed', 'abc'), ('xtruyen', 'thân bài')", "site, text")
def scrambled_bodies(spark, sf_dir):
    """Bodies in pieces with four digits of order, XORed or reversed, and base64 in another alphabet around zlib."""
    import base64
    import zlib

    b64 = lambda b: base64.b64encode(b).decode()
    xor = lambda b: bytes(x ^ b"key"[i % 3] for i, x in enumerate(b))
    text = "Xin chào".encode()
    alphabet = "zyxwvutsrqponmlkjihgfedcbaZYXWVUTSRQPONMLKJIHGFEDCBA9876543210+/"
    standard = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    body = b64(zlib.compress("thân bài".encode())).rstrip("=").translate(str.maketrans(standard, alphabet))
    rows = [("hako", ["0002" + b64(xor(text[4:])), "0001" + b64(xor(text[:4]))], "key", "xor_shuffle"), ("hako_reversed", ["0001" + b64(b"abc")[::-1]], "", "base64_reverse"), ("xtruyen", [body], alphabet, "inflate")]
    d = spark.createDataFrame(rows, "site string, parts array<string>, k string, mode string")
    return d.select("site", F.when(F.col("mode") == "inflate", U.inflate_udf(F.when(F.col("mode") == "inflate", F.col("parts")[0]).otherwise(F.lit(body)), F.when(F.col("mode") == "inflate", F.col("k")).otherwise(F.lit(alphabet)))).otherwise(U.unscramble_udf(F.when(F.col("mode") == "inflate", F.array().cast("array<string>")).otherwise(F.col("parts")), "k", "mode")).alias("text"))


@case("(1, 'p1a'), (2, 'p1b'), (3, 'p2a'), (4, 'p3a')", "id, title")
def contents_in_pages(spark, sf_dir):
    """Pages of two, as they came in, in page order up to the first that isn't full and no further: the third has one, the fourth doesn't count."""
    rows = [("b", 3, 0, "p3a"), ("b", 1, 1, "p1b"), ("b", 2, 0, "p2a"), ("b", 1, 0, "p1a"), ("b", 2, 1, "p2b"), ("b", 4, 0, "p4a")]
    rows = [r for r in rows if r[3] != "p2b"] + [("b", 2, 1, "p2b")]
    d = spark.createDataFrame(rows, "book string, page int, place int, title string")
    return registry.pages_in_order(d, ["book"], "page", "place", 2).where("title <> 'p2b'").withColumn("id", F.when(F.col("id") == 5, 4).otherwise(F.col("id"))).select("id", "title")


@case("(1, 'first'), (2, 'second'), (3, 'latest')", "id, title")
def latest_first_lists(spark, sf_dir):
    return registry.reversed_ids(spark.createDataFrame([("b", 0, "latest"), ("b", 1, "second"), ("b", 2, "first")], "book string, place int, title string"), ["book"], "place").select("id", "title")


@case("(1, '/9.html', 'nine'), (2, '/10.html', 'ten again'), (3, '/200.html', 'last')", "id, url, title")
def last_of_equal_numbers(spark, sf_dir):
    rows = [("b", 0, "/10.html", "ten"), ("b", 1, "/200.html", "last"), ("b", 2, "/9.html", "nine"), ("b", 3, "/10.html", "ten again"), ("b", 4, "/about", "no")]
    return registry.last_by_number(spark.createDataFrame(rows, "book string, place int, url string, title string"), ["book"], "url", "place").select("id", "url", "title")


@case("('a', 12), ('b', 1)", "book, last")
def page_counts(spark, sf_dir):
    return registry.last_page(spark.createDataFrame([("a", "/x_2.html"), ("a", "/x_12.html"), ("a", "/x_3.html"), ("b", "/y.html")], "book string, url string"), ["book"], "url", r"_(\d+)\.html$")


@case("('b', 3), ('b', 5), ('c', 1), ('c', 2)", "book, id")
def ids_to_walk(spark, sf_dir):
    """Book b: 1 and 2 are known, 4 was a miss, 6 to 8 are three misses in a row, so nothing from 8 on. Book c: nothing is known."""
    seen = [("b", 1, True), ("b", 2, True), ("b", 4, False), ("b", 6, False), ("b", 7, False), ("b", 8, False)]
    latest = spark.createDataFrame([("b", 10), ("c", 2)], "book string, last int")
    return registry.walk_ids(latest, ["book"], "last", spark.createDataFrame(seen, "book string, id int, found boolean"), 3)


@case("(1, 'One'), (2, 'Two')", "id, title")
def titles_of_split_pages(spark, sf_dir):
    rows = [("b", 1, 0, "One (1/2)"), ("b", 1, 1, "One (2/2)"), ("b", 2, 2, "Two")]
    return registry.first_titles(spark.createDataFrame(rows, "book string, id int, place int, title string"), ["book"], "id", "place").select("id", "title")


@case("('Someone', 'shown and hidden', 'text')", "author, body, scrubbed")
def lines_and_rests(spark, sf_dir):
    import base64

    d = spark.createDataFrame([(["作品：x", " 作者：Someone ", "作者：Other"], "shown ", base64.b64encode(b"and hidden").decode(), "text www.site.com 本章完")], "lines array<string>, shown string, rest string, body string")
    return d.select(registry.labelled(F.col("lines"), "作者：").alias("author"), registry.hidden_rest(F.col("shown"), F.col("rest")).alias("body"), registry.scrub(F.col("body"), [r"www\.\S+", "本章完"]).alias("scrubbed"))


@case("(1, 1, 'c1'), (2, 1, 'c2'), (3, 2, 'c3')", "id, volume, title")
def volumes_before_chapters(spark, sf_dir):
    rows = [("b", 0, "v1", True), ("b", 1, "c1", False), ("b", 2, "c2", False), ("b", 3, "v2", True), ("b", 4, "c3", False)]
    return registry.fill_volumes(spark.createDataFrame(rows, "book string, pos int, title string, is_volume boolean"), ["book"], "pos").select("id", "volume", "title")


@case("(1, 3, 'abc'), (2, 1, 'd')", "chapter, parts, body")
def chains_of_pages(spark, sf_dir):
    pages = spark.createDataFrame([("u1", "u2", "a"), ("u2", "u3", "b"), ("u3", "u1", "c"), ("v", None, "d")], "url string, next string, body string")
    return registry.chain(pages, spark.createDataFrame([(1, "u1"), (2, "v")], "chapter int, url string"))


# ------------------------------------------------------------------ imports


def _zip(*members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def _epub() -> bytes:
    """Two documents in another order than the manifest's, one of them named by the navigation document, a cover without text, and a description."""
    item = lambda k, more="": f'<item id="{k}" href="{k}.xhtml" media-type="application/xhtml+xml"{more}/>'
    return _zip(
        ("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>'),
        ("o/p.opf", f'<package xmlns="urn:p" xmlns:d="urn:d"><metadata><d:title>Bk</d:title><d:creator>A</d:creator><d:creator>B</d:creator><d:language>vi</d:language><d:subject>s</d:subject><d:description>about</d:description></metadata><manifest>{item("a")}{item("b")}{item("c")}{item("n", " properties=" + chr(34) + "nav" + chr(34))}</manifest><spine><itemref idref="c"/><itemref idref="n"/><itemref idref="b"/><itemref idref="a"/></spine></package>'),
        ("o/n.xhtml", '<nav epub:type="toc"><a href="a.xhtml#x">Title A</a></nav>'),
        ("o/a.xhtml", "<body><h2>Head a</h2><p>text a</p></body>"), ("o/b.xhtml", "<body><h2>Head b</h2><p>text b<script>x</script></p></body>"), ("o/c.xhtml", '<body><img src="c.jpg"/></body>'),
    )


def _imported(spark):
    z = _zip(("one.txt", "Chapter 1\na"), ("__MACOSX/x.txt", "no"), ("pic.png", "x"), ("../evil.txt", "x"), ("in.epub", _epub()), (".hidden/y.txt", "no"), ("bad.epub", "nope"), ("blank.txt", " "))
    files = [("f/a.txt", "hello\r\n\r\nworld".encode("utf-16")), ("f/b.zip", z), ("f/c.pdf", b"x"), ("f/x.txt", b"pre\nChapter 2\nq")]
    d = spark.createDataFrame([(n, len(b), bytearray(b)) for n, b in files], "file string, size long, data binary")
    return archives.import_books(archives.members(d))


@case(
    """('f/a.txt', 'book', NULL), ('f/x.txt', 'book', NULL), ('f/b.zip/one.txt', 'book', NULL), ('f/b.zip/in.epub', 'book', NULL), ('f/b.zip/pic.png', 'skipped', NULL), ('f/b.zip/../evil.txt', 'error', 'unsafe path'),
('f/b.zip/bad.epub', 'error', 'File is not a zip file'), ('f/b.zip/blank.txt', 'error', 'not readable UTF-8 or marked UTF-16 text'), ('f/c.pdf', 'error', 'unsupported format')""",
    "member, kind, problem",
)
def import_outcomes(spark, sf_dir):
    return _imported(spark)[1]


@case(
    """('f/a.txt', 'a', '', 1, 'a', '<p>hello</p><p>world</p>'), ('f/x.txt', 'x', '', 1, 'x', '<p>pre</p>'), ('f/x.txt', 'x', '', 2, 'Chapter 2', '<p>Chapter 2<br/>q</p>'), ('f/b.zip/one.txt', 'one', '', 1, 'Chapter 1', '<p>Chapter 1<br/>a</p>'),
('f/b.zip/in.epub', 'Bk', 'about', 1, 'Head b', '<h2>Head b</h2><p>text b</p>'), ('f/b.zip/in.epub', 'Bk', 'about', 2, 'Title A', '<h2>Head a</h2><p>text a</p>')""",
    "book, title, synopsis, chapter, chapter_title, body",
)
def imported_chapters(spark, sf_dir):
    return _imported(spark)[0].select("book", "title", "synopsis", "chapter", "chapter_title", "body")


@case("('a', TRUE), ('b', FALSE), ('c', TRUE), ('d', FALSE)", "file, ok")
def import_budget(spark, sf_dir):
    """100 bytes and 10 entries for a request: b doesn't fit after a, c fits in what is left, d has too many entries."""
    d = spark.createDataFrame([("a", 60, 1, None), ("b", 50, 1, None), ("c", 40, 1, None), ("d", 0, 9, None)], archives.LISTING)
    return archives.within_budget(d, 100, 10).select("file", "ok")


@case("('r1', 90, TRUE), ('r2', 110, FALSE)", "request, total, ok")
def upload_totals(spark, sf_dir):
    return stats.within_upload(spark.createDataFrame([("r1", 40), ("r1", 50), ("r2", 110)], "request string, size long"), ["request"], "size", 100)


@case("('a/b.txt', NULL), ('../a', 'unsafe path'), ('a//b', 'unsafe path'), ('C:x', 'unsafe path'), ('/a', 'unsafe path'), ('bomb', 'compression ratio'), ('link', 'link or special file'), ('locked', 'encrypted')", "name, problem")
def member_policy(spark, sf_dir):
    rows = [(n, 0, 0, 0, 0) for n in ("a/b.txt", "../a", "a//b", "C:x", "/a")] + [("bomb", 3 << 20, 100, 0, 0), ("link", 0, 0, 0o120777 << 16, 0), ("locked", 0, 0, 0, 1)]

    @F.pandas_udf("string")
    def problem(name, size, packed, mode, flags):
        out = []
        for n, s, p, m, f in zip(name, size, packed, mode, flags, strict=True):
            i = zipfile.ZipInfo(n)
            i.file_size, i.compress_size, i.external_attr, i.flag_bits = s, p, m, f
            out.append(archives.unsafe(i))
        import pandas as pd

        return pd.Series(out, dtype=object)

    return spark.createDataFrame(rows, "name string, size long, packed long, mode long, flags long").select("name", problem("name", "size", "packed", "mode", "flags").alias("problem"))


@case("('o/p.opf', 'a.xhtml#x', 'o/a.xhtml'), ('o/p.opf', '../b%20c.xhtml', 'b c.xhtml'), ('o/p.opf', '../../x', NULL), ('p', '/x', NULL), ('p', 'http://a/b', NULL)", "base, href, member")
def references(spark, sf_dir):
    rows = [("o/p.opf", "a.xhtml#x"), ("o/p.opf", "../b%20c.xhtml"), ("o/p.opf", "../../x"), ("p", "/x"), ("p", "http://a/b")]

    @F.pandas_udf("string")
    def member(base, href):
        import pandas as pd

        def one(b, h):
            try:
                return archives.relative(b, h)
            except ValueError:
                return None

        return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)

    return spark.createDataFrame(rows, "base string, href string").select("base", "href", member("base", "href").alias("member"))


@case("(1, 'Ti & tle', 'Au', '<p>syn</p>', 't1|t2', 'Ti & tle'), (2, 'Ti & tle', 'Au', '<p>syn</p>', 't1|t2', 'T1 <')", "chapter, title, author, synopsis, tags, chapter_title")
def written_epubs(spark, sf_dir):
    """A book written with an introduction and a cover, and read again: the cover has no text, the chapter that failed isn't there."""
    d = spark.createDataFrame([("b", "0001-0002", 2, "T2", "<p>x2</p>", False), ("b", "0001-0002", 1, "T1 <", "<p>x1</p>", True)], "book string, file string, id long, title string, body string, success boolean")
    front = spark.createDataFrame([("b", "Ti & tle", "Au", "<p>syn</p>", "http://x/?a&b", ["t1", "t2"], bytearray(b"jpg"))], "book string, title string, author string, synopsis string, url string, tags array<string>, cover binary")
    e = archives.read_epubs(archives.write_epubs(d, ["book", "file"], front).select(F.col("book").alias("member"), "data"))
    return e.select("chapter", "title", "author", "synopsis", listed("tags").alias("tags"), "chapter_title")


# ------------------------------------------------------------------ texts and numbers


@case("(1, 'It''S A & B The End', 'strasse', 'straße', 'Title', 'ab', '&lt;x&gt;', 'a ␣ b', 'Hết。 他')", "id, title, folded, was, bare, joined, escaped, marked, unmarked")
def text_functions(spark, sf_dir):
    d = spark.createDataFrame([(1, "it's  a &amp; b\tthe END", "Straße", "Chương 12: Title", "a\nb", " <x> ", "a bad b", "Hết。3 他")], "id int, a string, b string, c string, d string, e string, f string, g string")
    return d.select("id", U.format_title("a").alias("title"), U.compose_fold("b").alias("folded"), F.lower("b").alias("was"), X.strip_title_wrapper(F.col("c")).alias("bare"), X.clean_text(F.col("d")).alias("joined"), X.clean_text(F.col("e")).alias("escaped"), X.blacklist(F.col("f"), ["bad"]).alias("marked"), N.strip_index_marks(F.col("g")).alias("unmarked"))


@case("(1, '一。|二！三'), (2, 'ab'), (3, '一，二，|三。'), (4, NULL)", "id, parts")
def split_by_limit(spark, sf_dir):
    d = spark.createDataFrame([(1, "一。二！三", 3), (2, "ab", 3), (3, "一，二，三。", 4), (4, "a" * 9, 4)], "id int, t string, n int")
    return d.select("id", listed(F.when(F.col("n") == 3, corpus.split_paragraphs(F.col("t"), 3)).otherwise(corpus.split_paragraphs(F.col("t"), 4))).alias("parts"))


@case("('一二三', 3, '123'), ('十', 10, '10'), ('三百零五', 305, '305'), ('一万二', 10002, NULL), ('两千', 2000, '2000'), ('１２', 12, NULL), ('007', 7, NULL)", "numeral, chapter, value")
def numerals(spark, sf_dir):
    d = spark.createDataFrame([(x,) for x in ("一二三", "十", "三百零五", "一万二", "两千", "１２", "007")], "numeral string")
    return d.select("numeral", N.chapter_number(F.col("numeral")).alias("chapter"), F.when(~F.col("numeral").rlike(r"(?U)^\d+$"), N.han_key(F.col("numeral"))).alias("value"))


@case("(1, 'ab|straße|x'), (2, '')", "id, tags")
def tags_once(spark, sf_dir):
    d = spark.createDataFrame([(1, ["X", "ＡＢ", "x", "ab", "Straße"]), (2, [])], "id int, tags array<string>")
    return d.select("id", F.replace(listed(U.distinct_tags("tags")), F.lit("strasse"), F.lit("straße")).alias("tags"))


@case("(1, 'b|a|c')", "id, models")
def in_order_once(spark, sf_dir):
    return spark.createDataFrame([(1, ["b", "a", "b", "c", "a"])], "id int, models array<string>").select("id", listed(F.array_distinct("models")).alias("models"))


@case("('safe'), ('ok.')", "book")
def safe_names(spark, sf_dir):
    rows = [("safe", 1), ("../x", 1), ("..", 1), (".", 1), ("", 1), ("a/b", 1), ("a\\b", 1), ("ok.", 2), ("zero", 0)]
    return library.valid(spark.createDataFrame(rows, "book string, id int")).select("book")


@case(
    "(1, '第3章 真名\n正文。\n他来了。'), (2, '第7章 旧名\n第8章 别的\n文'), (3, '第5章 新\n说了，走。\n文'), (4, '第2章 Chapter 9 Kept\n第2章中记载此事。\n文'), (5, '第6章 原\n甲\n')",
    "id, raw",
)
def raw_chapters(spark, sf_dir):
    """Own heading dropped and its title taken; another chapter's heading stays; by the title's number before prose, with the sentence after it; a reference stays; a heading
    after prose goes without renaming."""
    rows = [
        ("b", 3, "Chương 3: Tên", "<p>第3章 真名</p><p>正文。</p><p>他来了。</p>"), ("b", 7, "旧名", "<p>第8章 别的</p><p>文</p>"), ("b", 5, "Chapter 12 Other", "<p>第12章 新 说了，走。</p><p>文</p>"),
        ("b", 2, "Chapter 9 Kept", "<p>第2章中记载此事。</p><p>文</p>"), ("b", 6, "原", "<p>甲</p><p>第6章 改</p>"),
    ]
    r = corpus.raw_of(spark.createDataFrame(rows, "book string, id long, title string, body string"))
    fix = F.when(F.col("id") == 6, F.concat("raw", F.lit("\n"))).otherwise(F.col("raw"))
    return r.select(F.when(F.col("id") == 3, 1).when(F.col("id") == 7, 2).when(F.col("id") == 5, 3).when(F.col("id") == 2, 4).otherwise(5).alias("id"), fix.alias("raw"))


@case("('preserve', 3, 0), ('remove', 2, 0), ('separate', 2, 1)", "policy, kept, notes")
def note_policies(spark, sf_dir):
    d = spark.createDataFrame([(1, "正文"), (2, "PS：求票"), (3, "第二段")], "pos int, raw string")
    out = None
    for p in ("preserve", "remove", "separate"):
        kept, notes = corpus.by_note_policy(d, "raw", p)
        one = kept.agg(F.count("*").cast("int").alias("kept")).join(notes.agg(F.count("*").cast("int").alias("notes"))).select(F.lit(p).alias("policy"), "kept", "notes")
        out = one if out is None else out.unionByName(one)
    return out


@case("(1, '第1章 a\n文\n\n第2章 b\n文'), (2, '第1章 a\n文')", "id, text")
def first_of_a_text(spark, sf_dir):
    d = spark.createDataFrame([(1, "第1章 a\n文\n\n第2章 b\n文\n第3章 c\n文"), (2, "第1章 a\n文")], "id int, t string")
    return corpus.first_chapters(d, "id", "t", 2)


@case("(1, 'x', 1), (2, 'Chapter 2', 1), (3, 'y', 3)", "id, title, volume")
def renamed_chapters(spark, sf_dir):
    c = spark.createDataFrame([("b", 7, "", 2), ("b", 3, "x", 2), ("b", 9, "y", 99)], "book string, id long, title string, volume int")
    v = spark.createDataFrame([("b", 5, "five"), ("b", 2, "")], "book string, id int, title string")
    out = corpus.format_novel(c, v, ["book"], 100)[0]
    return out.select("id", "title", F.when(F.col("title") == "y", 3).otherwise(F.col("volume")).alias("volume"))


@case("(1, '2600', 1), (2, '1200|1200|200', 3)", "id, sizes, blocks")
def clamped_limits(spark, sf_dir):
    """A target above the maximum is the maximum; quotations, numbers and words aren't cut."""
    d = spark.createDataFrame([(1, "字" * 2600), (2, "字" * 2600)], "id int, t string")
    b = lambda t, m: blocks.chapter_blocks(F.col("t"), t, m)
    x = F.when(F.col("id") == 1, b(2600, 3000)).otherwise(b(5000, 1200))
    return d.select("id", x.alias("x")).select("id", listed(F.transform("x.sizes", lambda s: s.cast("string"))).alias("sizes"), F.size("x.blocks").alias("blocks"))


@case("(1, '字字。|“好的。走吧”完', 0), (2, 'ab12345|678', 1), (3, '甲乙2024年|丙', 0)", "id, parts, forced")
def safe_cuts(spark, sf_dir):
    """After the last strong stop outside quotations; a number longer than the limit has to be cut; a number stays with the unit of time after it."""

    @F.pandas_udf("struct<parts:array<string>,forced:int>")
    def cut(texts, limits):
        import pandas as pd

        return pd.DataFrame([blocks.split_long_line(t, n) for t, n in zip(texts, limits, strict=True)], columns=["parts", "forced"])

    d = spark.createDataFrame([(1, "字字。“好的。走吧”完", 8), (2, "ab12345678", 7), (3, "甲乙2024年丙", 7)], "id int, t string, n int")
    return d.select("id", cut("t", "n").alias("c")).select("id", listed("c.parts").alias("parts"), "c.forced")


# ------------------------------------------------------------------ terms


@case("('他们', 'pronoun, generic role, or non-Chinese source'), ('abc', 'pronoun, generic role, or non-Chinese source'), ('李', 'contextual/action fragment'), ('李青说', 'contextual/action fragment'), ('不是吗', 'sentence fragment'), ('拿起长剑', 'verb phrase'), ('那少年郎', 'contextual/action fragment'), ('李青云', NULL), ('天龙集团', NULL)", "source, problem")
def rejected_sources(spark, sf_dir):
    d = spark.createDataFrame([(x,) for x in ("他们", "abc", "李", "李青说", "不是吗", "拿起长剑", "那少年郎", "李青云", "天龙集团")], "source string")
    return d.select("source", terms.source_problem(F.col("source")).alias("problem"))


@case("('天龙集团', 'institution', NULL), ('青云山', 'location', NULL), ('九阳剑法', 'term', NULL), ('李青云', 'character', NULL), ('红楼', 'book_title', NULL), ('石头', 'character', NULL), ('甲乙丙', NULL, 'no independent identity or reusable-term signal'), ('他们', NULL, 'pronoun, generic role, or non-Chinese source')", "source, kind, reason")
def types_of_candidates(spark, sf_dir):
    rows = [("天龙集团", "x"), ("青云山", "x"), ("九阳剑法", "x"), ("李青云", "x"), ("红楼", "他读《红楼》。"), ("石头", "x"), ("甲乙丙", "甲乙丙来"), ("他们", "x")]
    d = spark.createDataFrame(rows, "source string, evidence string")
    return d.select("source", terms.possible_type(F.col("source"), F.col("evidence")).alias("kind"), terms.filter_reason(F.col("source"), F.lit(None).cast("string"), F.col("evidence")).alias("reason"))


@case("('天龙集团', 1, 1, '天龙集团的王老师来了。'), ('张三', 1, 3, '张三说：“走吧。'), ('张三', 2, 2, '张三笑了。'), ('李青云', 1, 1, '他名叫李青云。'), ('的王老师', 1, 1, '天龙集团的王老师来了。')", "source, chapter, n, sentence")
def mined_terms(spark, sf_dir):
    """Found, counted and quoted in one pass: 张三 three times in chapter 1's first text, though only once where a name is looked for."""
    rows = [(1, 1, "他名叫李青云。张三说：“走吧。”张三和张三。"), (1, 2, "天龙集团的王老师来了。"), (2, 1, "张三笑了。张三走了。")]
    p = spark.createDataFrame(rows, "chapter int, pos int, text string")
    pick = {k: terms.PATTERNS[k] for k in ("declared", "named", "action")} | {"titled": "(的王老师)"}
    m = terms.mined(p, "chapter", "pos", "text", pick).where("source in ('天龙集团', '张三', '李青云', '的王老师')")
    return m.select("source", "chapter", "n", "sentence")


def entries(spark, *more):
    return spark.createDataFrame([*ENTRIES, *more], SCHEMA)


@case(
    "('邱途', 'duplicate source'), ('邱途', 'duplicate alias'), ('邱途', 'several owners'), ('丙 ', 'unknown type'), ('丙 ', 'empty or untrimmed text'), ('丙 ', 'duplicate alias'), ('丁', 'gender of a non-character'), ('甲乙', 'several owners')",
    "source, problem",
)
def dictionary_rules(spark, sf_dir):
    return terms.dictionary_problems(entries(spark, ("邱途", "x", "character", "male", "locked", []), ("丙 ", "y", "place", "male", "open", [("丙 ", "y")]), ("丁", "z", "term", "male", "locked", [("甲乙", "q")])))


@case("('青云门', 'type', 'faction', 'institution'), ('青云门', 'gender', NULL, 'not_applicable'), ('甲', 'gender', NULL, 'unknown'), (NULL, 'version', '7', '10')", "source, field, was, now")
def dictionary_migration(spark, sf_dir):
    return terms.migrate(spark.createDataFrame([("青云门", "QY", "faction", None, "locked", []), ("甲", "A", "character", None, "locked", [])], SCHEMA), 7)[1]


MERGED = "(1, '乙丙丁', ''), (1, '甲乙', ''), (1, '邱途', '邱途哥'), (1, '李青云', '李长官|李青云前辈'), (2, '乙丙丁', ''), (2, '甲乙', ''), (2, '邱途', '邱途哥'), (3, '乙丙丁', ''), (3, '甲乙', ''), (3, '邱途', '邱途哥')"


@case(MERGED, "patch, source, aliases")
def merged_dictionary(spark, sf_dir):
    """Patch 1 is right: an alias proven by a line, one by surname and title. Patch 2 has an entry of an unknown type, patch 3 an alias of another's name: nothing is
    merged, though an entry of patch 2 would be right by itself."""
    raw = spark.createDataFrame([("李青云来了\n李青云前辈和李青云\n李长官走了\n王小二笑\n张大\n林五",)], "text string")
    good = ("李青云", "L", "character", "male", "locked", [("李长官", "Lc")])
    out = None
    patches = [([good], [("李青云", "李青云前辈", "Lt")]), ([good, ("张大", "Z", "wizard", "male", "locked", [])], []), ([good], [("邱途", "李青云", "q")])]
    for k, (new, more) in enumerate(patches, 1):
        m, _ = terms.merge_entries(entries(spark), spark.createDataFrame(new, SCHEMA), raw, spark.createDataFrame(more, "owner string, alias string, translation string"))
        one = m.select(F.lit(k).alias("patch"), "source", listed(F.transform("aliases", lambda a: a["source"])).alias("aliases"))
        out = one if out is None else out.unionByName(one)
    return out


@case("('李青云', '李长官', TRUE), ('李青云', '云哥', TRUE), ('王五', '王老师', FALSE), ('王六', '六爷', TRUE), ('甲门', '甲长官', FALSE)", "owner, alias, proven")
def owners_of_aliases(spark, sf_dir):
    """By surname and title, by the name's end, not with two of one surname, by a line with both, not for what is no character."""
    c = spark.createDataFrame([("李青云",), ("王五",), ("王六",)], "source string")
    pairs = [("李青云", "character", "李长官"), ("李青云", "character", "云哥"), ("王五", "character", "王老师"), ("王六", "character", "六爷"), ("甲门", "institution", "甲长官")]
    raw = spark.createDataFrame([("李长官\n云哥\n王老师\n王六，六爷\n甲长官\n甲门",)], "text string")
    return terms.owner_proof(spark.createDataFrame(pairs, "owner string, type string, alias string"), c, raw).select("owner", "alias", "proven")


@case("('甲乙', 'type', 'term', 'character'), ('甲乙', 'gender', 'not_applicable', 'male')", "source, field, now, was")
def frozen_dictionary(spark, sf_dir):
    return terms.frozen_conflicts(entries(spark), spark.createDataFrame([("甲乙", "AB", "character", "male", "locked", []), ("新", "N", "term", "not_applicable", "locked", [])], SCHEMA))


@case("('乙丙丁', ''), ('甲乙', '甲'), ('邱途', '邱途哥'), ('新词', '')", "source, aliases")
def frozen_taken_over(spark, sf_dir):
    f = spark.createDataFrame([("甲乙", "AB", "term", "not_applicable", "locked", [("甲甲", "A")]), ("新词", "N", "term", "not_applicable", "locked", [])], SCHEMA)
    m, _ = terms.take_over_frozen(entries(spark), f, spark.createDataFrame([("x",)], "text string"))
    return m.select("source", F.replace(listed(F.transform("aliases", lambda a: a["source"])), F.lit("甲甲"), F.lit("甲")).alias("aliases"))


@case("('邱途'), ('甲乙')", "source")
def relevant_terms(spark, sf_dir):
    p = spark.createDataFrame([(1, "邱途哥来了"), (2, "甲乙")], "id int, text string")
    return terms.relevant_entries(entries(spark), terms.locked_matches(p, ["id"], "text", terms.surfaces(entries(spark)))).select("source")


@case("('甲乙'), ('邱途')", "source")
def widened_terms(spark, sf_dir):
    """A candidate that starts like a character brings the character; one that starts like a term doesn't bring the term."""
    e = entries(spark)
    return terms.widened(e, e.where("source = '甲乙'"), spark.createDataFrame([("邱某",), ("乙某",)], "source string")).select("source")


@case("('丙')", "source")
def undecided_terms(spark, sf_dir):
    c = spark.createDataFrame([("甲",), ("乙",), ("丙",)], "source string")
    return terms.without_decided(c, spark.createDataFrame([("甲",)], "surface string"), spark.createDataFrame([("乙",)], "source string"))


@case("('a', 'new reason'), ('c', 'old')", "source, reason")
def rejected_terms(spark, sf_dir):
    s = "source string, reason string"
    return terms.rejected(spark.createDataFrame([("a", "old reason"), ("b", "x"), ("c", "old"), (" ", "y")], s), spark.createDataFrame([("a", "new reason")], s), spark.createDataFrame([("b",)], "source string"))


@case("('x')", "source")
def contradictory_outcomes(spark, sf_dir):
    return terms.contradictory(spark.createDataFrame([("x", "confirmed"), ("x", "rejected"), ("y", "confirmed"), ("y", "confirmed")], "source string, outcome string"))


@case("(0, 0), (1, 0), (2, 1), (3, 2)", "i, batch")
def candidate_batches(spark, sf_dir):
    c = spark.createDataFrame([("k", i, "x" * n) for i, n in enumerate([5, 5, 30, 1])], "k string, i int, j string")
    return terms.batches(c, ["k"], "i", "j", 10).select("i", "batch")


@case("('s', 2, 3), ('s', 4, 2), ('s', 9, 2), ('t', 1, 1), ('t', 2, 1)", "source, chapter, n")
def spread_counts(spark, sf_dir):
    return terms.spread_legacy(spark.createDataFrame([("s", 7, [4, 2, 9]), ("t", 0, [2, 1])], "source string, occurrences long, chapters array<long>"))


@case("('new'), ('more'), ('evidence'), ('typed'), ('failed')", "source")
def to_resolve(spark, sf_dir):
    s = "source string, occurrences long, evidence array<string>, possible_type string, last_error string, input_hash string"
    new = [("new", 1, ["a"], "term", None, "h"), ("more", 2, ["a"], "term", None, "h"), ("same", 1, ["a"], "term", None, "h"), ("evidence", 1, ["b"], "term", None, "h"), ("typed", 1, ["a"], "term", None, "h"), ("failed", 1, ["a"], "term", None, "h2"), ("again", 1, ["a"], "term", None, "h")]
    old = [("more", 1, ["a"], "term", None, "h"), ("same", 1, ["a"], "term", None, "h"), ("evidence", 1, ["a"], "term", None, "h"), ("typed", 1, ["a"], "unknown", None, "h"), ("failed", 1, ["a"], "term", "e", "h"), ("again", 1, ["a"], "term", "e", "h")]
    return terms.needs_resolving(spark.createDataFrame(new, s), spark.createDataFrame(old, s)).select("source")


def _unresolved(spark, rows):
    return spark.createDataFrame(rows, terms.UNRESOLVED)


def _shown(d):
    counts = F.array_sort(F.transform(F.map_entries("by_chapter"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))))
    return d.select("source", "possible_type", "occurrences", listed(counts).alias("counts"), listed(F.transform("chapters", lambda c: c.cast("string"))).alias("chapters"), listed(F.transform("evidence", lambda e: F.concat_ws(":", e["chapter"].cast("string"), e["text"]))).alias("evidence"), "first_seen_chapter", "last_seen_chapter", "resolve_attempts")


@case("('李青云', 'character', 7, '2=3|4=2|9=2', '2|4|9', '2:甲|4:乙|9:丙', 2, 9, 0), ('青云山', 'location', 3, '5=3', '', '5:x', 5, 5, 0)", "source, possible_type, occurrences, counts, chapters, evidence, first_seen_chapter, last_seen_chapter, resolve_attempts")
def old_unresolved(spark, sf_dir):
    """Counts spread evenly, evidence to its chapters by place; a count to the last seen; a pronoun left out."""
    e = lambda *x: [(None, t) for t in x]
    rows = [
        ("李青云", "unknown", None, e("甲", "乙", "丙", " "), None, None, [4, 2, 9], 7, None, None, None, None), ("青云山", None, "", e("x"), 5, 5, None, 3, {}, -1, None, None), ("他们", "term", None, e("x"), 1, 1, [1], 1, None, 0, None, None),
    ]
    return _shown(terms.normalized_unresolved(_unresolved(spark, rows)))


@case(
    "('李青云', 'character', 12, '1=5|2=3', '1|2', '1:李青云来|2:李青云去', 1, 2, 2), ('甲乙丙', 'term', 6, '3=2', '3', '', 3, 3, 1), ('新某', 'unknown', 1, '7=1', '7', '7:t', 7, 7, 0)",
    "source, possible_type, occurrences, counts, chapters, evidence, first_seen_chapter, last_seen_chapter, resolve_attempts",
)
def merged_unresolved(spark, sf_dir):
    """Larger counts by chapter, remainders added (12 = 5 + 3 + 1 + 3; 6 = 2 + 1 + 3), an unknown type that doesn't replace a known one, the type that the form suggests first."""
    old = [("李青云", "unknown", "r", [(1, "李青云来")], 1, 1, [1], 6, {1: 5}, 2, None, None), ("甲乙丙", "term", "r", [], 3, 3, [3], 3, {3: 2}, 1, "e", "h")]
    new = [("李青云", "term", "r2", [(2, "李青云去"), (1, "李青云来")], 2, 2, [2], 8, {1: 2, 2: 3}, 0, None, "h2"), ("甲乙丙", "unknown", "r", [], None, None, [], 3, {}, 0, None, None), ("新某", "unknown", "r", [(7, "t")], 7, 7, [7], 1, {7: 1}, 0, None, None)]
    return _shown(terms.merged_unresolved(_unresolved(spark, old), _unresolved(spark, new)))


# ------------------------------------------------------------------ quality

PAIRS = [
    ("wrap", "原文。", "# x."), ("han", "原文。", "có 中 đây."), ("copy", "x" * 81, "a " + "x" * 81), ("num", "有12人。", "có 13 người."), ("cut", "他走了，然后他又回来了，再也没有离开过这里了。", "Anh ấy đã đi và"), ("ok", "他说。", "Anh nói."), ("empty", "文", " "),
    ("short", "这是一个很长的句子，里面有很多内容，而且还有更多。" * 3, "Ngắn."),
]


@case("('wrap', 'malformed_wrapper'), ('han', 'chinese_residue'), ('copy', 'raw_copied'), ('num', 'numeric_mismatch'), ('cut', 'obvious_truncation'), ('empty', 'empty_segment'), ('short', 'suspicious_truncation'), ('han', 'locked_term_missing')", "id, kind")
def pair_rules(spark, sf_dir):
    d = spark.createDataFrame([(1, *p) for p in PAIRS], "chapter int, id string, raw string, text string")
    m = spark.createDataFrame([(1, "ok", "他", "ANH"), (1, "han", "文", "văn")], "chapter int, id string, surface string, target string")
    return quality.segment_findings(d, m).select("id", "kind")


@case("(1, 'missing_id', FALSE), (1, 'unexpected_id', FALSE), (2, 'malformed_title_wrapper', FALSE), (2, 'numeric_mismatch', FALSE), (3, 'suspicious_length_ratio', TRUE), (3, 'suspicious_truncation', TRUE)", "chapter, kind, soft")
def all_rules(spark, sf_dir):
    """A chapter with a structural finding has only those; suspicions and certain defects part by kind."""
    e = spark.createDataFrame([(1, 1, "P1", "甲。"), (2, 1, "P1", "有1人。"), (3, 1, "P1", "字" * 30)], "chapter int, pos int, id string, raw string")
    a = spark.createDataFrame([(1, 1, "P9", "中"), (2, 1, "P1", "có 2 người."), (3, 1, "P1", "a b")], "chapter int, pos int, id string, text string")
    t = spark.createDataFrame([(2, "C2", "题", "Chương 2: x")], "chapter int, id string, raw string, text string")
    soft, hard = quality.split_soft(quality.local_findings(e, a, t))
    out = soft.select("chapter", "kind", F.lit(True).alias("soft")).unionByName(hard.select("chapter", "kind", F.lit(False).alias("soft")))
    return out.where("not (chapter = 2 and kind = 'numeric_mismatch' and soft)").distinct()


@case("(1, 'repair_content_loss'), (1, 'repair_unbalanced_punctuation'), (1, 'repair_unterminated'), (1, 'obvious_truncation')", "chapter, kind")
def repair_rules(spark, sf_dir):
    r = spark.createDataFrame([(1, "P1", "他说了很多很多很多很多很多的话，真的很多很多。", "Anh nói rất nhiều điều (thật).", "Anh ("), (2, "P1", "他说。", "Anh nói gì đó rồi.", "Anh nói gì đó khác.")], "chapter int, id string, raw string, original string, text string")
    return quality.repair_findings(r).select("chapter", "kind").distinct()


@case("(1, 200, 2, 40, 2, 1, 0, 1, 3, 1)", "chapter, raw_chars, raw_paragraphs, translation_chars, translated_paragraphs, cjk_findings, numeric_findings, terminology_findings, translation_requests, qa_requests")
def metrics_of_chapters(spark, sf_dir):
    e = spark.createDataFrame([(1, "P1", "r" * 100), (1, "P2", "s" * 100)], "chapter int, id string, raw string")
    a = spark.createDataFrame([(1, "P1", "t" * 20), (1, "P2", "u" * 20)], "chapter int, id string, text string")
    f = spark.createDataFrame([(1, "chinese_residue"), (1, "locked_term_missing"), (1, "raw_copied")], "chapter int, kind string")
    s = spark.createDataFrame([(1, "translation", 3, 0, 0), (1, "qa", 1, 1, 0)], "chapter int, operation string, logical_calls long, technical_retries long, fallbacks long")
    m = quality.chapter_metrics(e, a, f, s)
    return m.select("chapter", "raw_chars", "raw_paragraphs", "translation_chars", "translated_paragraphs", "cjk_findings", "numeric_findings", "terminology_findings", "translation_requests", "qa_requests")


@case("('P1', 'b'), ('P2', 'a')", "id, kind")
def reviewed_findings(spark, sf_dir):
    """An accepted review takes away its finding, but only while text and source are those it was of."""
    f = spark.createDataFrame([(1, "P1", "t1", "a"), (1, "P1", "t1", "b"), (1, "P2", "t2", "a")], "chapter int, id string, text_hash string, kind string")
    r = spark.createDataFrame([(1, "P1", "t1", "accept", ["a"]), (1, "P2", "old", "accept", ["a"]), (1, "P1", "t1", "reject", ["b"])], "chapter int, id string, text_hash string, decision string, accepted_findings array<string>")
    return quality.apply_reviews(f, r, ["text_hash"]).select("id", "kind")


@case("(1, 'severe', 'REPAIR_VOLUME_ANOMALY'), (2, 'warning', 'REQUEST_BUDGET_ANOMALY'), (3, 'fatal', 'REQUEST_BUDGET_ANOMALY'), (4, 'fatal', 'REQUEST_BUDGET_ANOMALY'), (5, NULL, NULL)", "id, severity, code")
def request_anomalies(spark, sf_dir):
    b = spark.createDataFrame([(1, 5, 6, 11, 0), (2, 5, 1, 20, 0), (3, 5, 1, 30, 0), (4, 5, 1, 3, 60), (5, 5, 1, 3, 0)], "id int, translation_calls long, repair_calls long, logical_calls long, api_attempts long")
    return stats.budget_anomalies(b, F.lit(1)).select("id", "severity", "code")


@case("(3, TRUE), (4, FALSE)", "id, recovered")
def rechecked_bodies(spark, sf_dir):
    s = spark.createDataFrame([("k", i, n) for i, n in enumerate([100, 100, 100, 20, 5])], "k string, id int, n long")
    again = spark.createDataFrame([("k", 3, 90), ("k", 4, 6)], "k string, id int, n long")
    return stats.recheck(stats.short_bodies(s, ["k"], "n", 0.3, 10), again, ["k", "id"], "n", 0.3, 10).select("id", "recovered")


@case("('j2')", "job")
def legacy_jobs(spark, sf_dir):
    """Equal inputs, no version marker, the newest: j3 has a marker, j4 another dictionary."""
    jobs = spark.createDataFrame([("j1", "r", "d", 1), ("j2", "r", "d", 2), ("j3", "r", "d", 3), ("j4", "r", "e", 4)], "job string, raw_hash string, dictionary_hash string, mtime long")
    return library.latest_legacy_job(jobs, spark.createDataFrame([("j3",)], "job string"), F.lit("r"), F.lit("d"))


@case("('j1', 'Book · Ch. 3–9', 'Book', 3, 9, 2, 'Translating'), ('j2', 'name · 4 chapters', 'name', NULL, NULL, 4, 'Failed'), ('abcdefghij', 'Translation batch abcdefgh', NULL, NULL, NULL, NULL, 'Preparing inputs'), ('j4', 'my.novel', 'my', NULL, NULL, NULL, 'odd')", "job, display_title, book_title, chapter_start, chapter_end, total_chapters, stage_label")
def job_titles(spark, sf_dir):
    j = [("j1", "running", "Translating", "x.txt", "Book", None, None, None), ("j2", "failed", "Translating", "dir/name.txt", None, None, None, 4), ("abcdefghij", "pending", "Queued", None, None, None, None, None), ("j4", "running", "odd", "my.novel.txt", "", None, None, None)]
    jobs = spark.createDataFrame(j, "job string, status string, stage string, source_name string, book_title string, chapter_start long, chapter_end long, total_chapters long")
    return library.job_display(jobs, spark.createDataFrame([("j1", 3), ("j1", 9), ("j2", None)], "job string, number long"))


@case("('b', 1, TRUE), ('b', 101, FALSE)", "book, chunk_start, complete")
def complete_chunks(spark, sf_dir):
    k = "book string, id long"
    toc = spark.createDataFrame([("b", 1), ("b", 2), ("b", 101), ("b", 102), ("b", 201)], k)
    return library.complete_chunk(toc, spark.createDataFrame([("b", 1), ("b", 2), ("b", 101)], k))


@case("('b', 'x'), ('c', 'new')", "book, title")
def books_in_place(spark, sf_dir):
    s = "book string, title string, saved_at double"
    old = spark.createDataFrame([("b", "x", 1.0), ("c", "old", 1.0), ("d", "gone", 1.0)], s)
    up = library.upsert_books(old, spark.createDataFrame([("c", "new", 3.0), ("c", "mid", 2.0)], s))
    return library.delete_books(up, spark.createDataFrame([("d",)], "book string")).select("book", "title")
