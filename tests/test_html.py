import hashlib

from pyspark.sql import functions as F

from quire.functions import html as H


def test_contents():
    page = '<html><body><nav>x</nav><div class="ads">y</div><p>One<br>two <b>bold</b></p><!-- c --><script>var t="</p>";</script><a href="http://patreon.com/z">p</a><img data-src="i.png"><p> </p></body>'
    assert H.extract_contents(page) == '<p>One</p><p>two <b>bold</b></p><p><img src="i.png"/></p>'
    assert H.extract_contents(None) == "" and H.extract_contents("a & b < c") == "<p>a & b &lt; c</p>"


def test_unclosed_tags():
    assert H.extract_contents("<p><b>a<p>c</p>") == "<p><b>a</b></p><p>c</p>"
    assert H.extract_text("<div>a<p>b</p><p>c\n\nd</p>") == "a\nb\nc\nd"


def test_sanitize():
    assert H.sanitize('<body onload="x"><section><p style="a">b<img alt="pic" src="q"><script>z</script></p></section><font>c</font><br/>') == "<p>bpic</p>c<br/>"


def test_images_and_metadata():
    body, found = H.rewrite_images('<p><img src="/a.png"></p>', "https://h.org/c/1")
    key = hashlib.md5(str(["https://h.org/c/1", "https://h.org/a.png"]).encode()).hexdigest()
    assert found == {key: "https://h.org/a.png"} and body == f'<p><img src="images/{key}.jpg" alt="{key}"/></p>'
    m = H.metadata('<head><title> A  b </title><meta property="og:image" content="c.jpg"><meta name="keywords" content="x, y, x"></head><h2>H</h2><a href="/l">l</a>')
    assert m == {"title": "A b", "cover": "c.jpg", "author": None, "synopsis": None, "tags": ["x", "y"], "heading": "H", "links": ["/l"]}
    assert H.clean_style("Font-Weight: bold; color:red;;font-style:") == "font-weight:bold"


def test_columns(spark):
    d = spark.createDataFrame([("<p>a</p>", "u"), (None, None)], "h string, u string")
    got = d.select(H.contents_udf("h"), H.text_udf("h"), H.sanitize_udf("h"), H.metadata_udf("h")["title"], H.images_udf("h", "u")["body"]).collect()
    assert tuple(got[0]) == ("<p>a</p>", "a", "<p>a</p>", None, "<p>a</p>") and got[1][0] is None


def test_pages_of_any_depth():
    for page in ("<b>x " * 100_000, "<div><i>" * 50_000 + "y", "<p><span>x<br>" * 30_000):
        assert len(H.extract_text(page)) > 0 and H.extract_contents(page).startswith("<p>") and H.sanitize(page) and H.reader_text(page)
        assert H.metadata(page)["title"] is None and H.rewrite_images(page, None)[1] == {}
        assert H.select(H.parse(page), "body > b, div i i") is not None


def test_breaks_at_edges():
    assert H.extract_contents("a<span><br>b<br></span>c") == "<p>a b c</p>"
    assert H.extract_contents("a<br><span></span>b") == "<p>a b</p>" and H.extract_contents("a<br> <span></span>b") == "<p>a</p><p>b</p>"
    assert H.extract_contents("<i>x<b>y<br>z</b></i>w") == "<p><i>x <b>y</b></i></p><p><i><b>z</b></i> w</p>"


def test_callers_rules():
    page = "<div><p class='ad x'>buy</p><p>Read at site.com now</p><p></p><span>next page</span><h3>keep</h3><u>w</u></div>"
    rules = H.Rules(css=["p.ad"], tags={"u"}, tag_texts={"span": ["^next"], "p": []}, blacklist=[r"site\.com"])
    assert H.extract_contents(page, rules) == "<p>Read at ␣ now</p><p>keep</p>"
    assert H.bad_text(H.Node("p"), rules) and not H.bad_text(H.Node("h3"), rules)


def test_reader_text():
    assert H.reader_text("<p>a&nbsp;b<br> c</p>\n\n<div><h2>t</h2>x</div><noscript>n</noscript>") == "a b\nc\n\nt\nx"
