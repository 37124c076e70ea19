"""Site adapters as a table of selectors: one generic reader of pages already fetched, driven by the row of the page's source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import text as X
from quire.sources import registry

FIELDS = ["title", "cover", "author", "synopsis", "tags", "chapters", "body"]
#: What a page has if its source doesn't say otherwise.
DEFAULTS = {
    "title": 'meta[property="og:title"], meta[name="title"], title',
    "cover": 'meta[property="og:image"], meta[name="image"]',
    "author": 'meta[property="og:author"], meta[name="author"]',
    "tags": 'meta[property="og:tag"], meta[name="keywords"]',
    "synopsis": 'meta[property="og:description"], meta[name="description"]',
}
#: What the sites of a template have in common.
MADARA = {"title": ".post-title h1", "cover": ".summary_image a img", "author": ".author-content a[href*='manga-author']", "synopsis": ".description-summary a", "tags": ".genres-content a[rel='tag']", "chapters": "ul.main .wp-manga-chapter a", "body": "div.reading-content"}
UUKANSHU = {"title": "dl.jieshao dd.jieshao_content h1 > a", "cover": "dl.jieshao dt.jieshao-img img", "author": "dl.jieshao dd.jieshao_content h2 > a", "synopsis": "dl.jieshao dd.jieshao_content h3", "chapters": "ul#chapterList li a", "body": "div#contentbox"}


def _at(prefixes: str, **config: str) -> list[dict]:
    """A row for each of a site's addresses."""
    return [{"prefix": p, **config} for p in prefixes.split()]


#: Prefix, encoding, and selectors of each source.
SOURCES = [
    {"prefix": "https://www.17ktxt.com/", "title": "h1", "cover": "meta[property='og:image']", "author": "meta[property='og:novel:author']", "synopsis": "meta[property='og:description']", "chapters": "div.book_list2 ul li a", "body": "article.font_max"},
    {"prefix": "https://www.novel543.com/", "title": "#detail .media-content h1.title", "cover": "#detail .media-left .cover img", "author": "#detail .media-content p.meta span.author", "synopsis": "#detail .mod .intro", "chapters": "div.chaplist ul.all li a[href]", "body": "div.chapter-content div.content"},
    {"prefix": "https://www.powanjuan.cc/", "encoding": "gb2312", "title": ".desc h1", "author": ".descTip span", "synopsis": ".descInfo p", "chapters": ".catalog ul.clearfix li a", "body": "#mycontent"},
    {"prefix": "https://www.qbmfxs.com/", "title": "div.book div.detail div.name h1", "author": "div.book div.detail div.name span", "synopsis": "div.bookinfo div.desc div.description", "chapters": "div.catalog div.list ul li a", "body": "div.read div.content, div.content"},
    {"prefix": "https://www.soxs.cc/", "title": ".xiaoshuo h1", "author": ".xiaoshuo h6", "cover": ".book_cover img", "chapters": ".novel_list dd a", "body": ".content"},
    {"prefix": "https://trxs.cc/", "encoding": "gb2312", "title": ".book_info h1", "cover": ".book_info img", "synopsis": ".book_info p", "author": ".book_info a", "chapters": ".book_list a", "body": ".read_chapterDetail"},
    {"prefix": "https://twkan.com/", "title": "h1", "chapters": "ul li a", "body": "div#txtcontent0"},
    *_at("https://truyenfull.vn/ https://truyentr.info/ https://truyenfull.today/", title="h3.title, h1.title", cover=".book-thumb img, .books .book img", author=".info a[itemprop='author']", chapters=".list-chapters a, .list-chapter a", body="#chapter-c, .chapter-c"),
    *_at("https://xtruyen.vn/", **MADARA | {"title": "meta[property='og:title'], .post-title h1", "cover": ".summary_image img", "author": ".author-content", "synopsis": ".description-summary .summary__content, .description-summary"}),
    *_at("https://ln.hako.vn/ https://docln.net/", title=".series-name a", author=".info-value a[href*='/tac-gia/']", synopsis=".series-summary .summary-content", tags=".series-gernes a[href*='/the-loai/']", chapters=".volume-list .list-chapters a[href]", body="#chapter-content"),
    *_at("https://www.1qxs.com/ https://m.1qxs.com/", title="h1", cover=".book-intro .cover img", author=".book-intro .author", synopsis="p#in-details", tags=".book-intro .type", chapters="a[href*='/xs_']", body="div.content"),
    *_at("https://so.27k.net/ https://www.27k.net/ https://m.27k.net/ https://tw.27k.net/ https://www.lreads.com/", title="div.booknav2 h1 a", cover="div.bookimg2 img", author=".booknav2 p a[href*='/author/']", synopsis="div.newnav .ellipsis_2", tags=".booknav2 p a[href*='/sort/']", chapters="div#catalog ul li a", body="div.txtnav"),
    *_at("https://www.69shuba.com/ https://www.69shu.com/ https://www.69xinshu.com/ https://www.69shu.pro/ https://www.69shuba.pro/", encoding="gbk", title="div.booknav2 h1", cover="div.bookimg2 img", author=".booknav2 p a[href*='author']", synopsis="div.navtxt", tags=".booknav2 p a[href*='/class/']", chapters="div#catalog ul li a", body="div.txtnav"),
    *_at("https://69shuba.cx/ https://69shu.me/", encoding="gbk", title="div.booknav2 h1 a", cover="div.bookimg2 img", author=".booknav2 p a", tags="div.booknav2 > p:nth-child(4) > a", chapters="div#catalog li a", body="div.txtnav"),
    *_at("https://www.daocaorenshuwu.com/", title=".container .book-info h1.book-name", cover=".container .media-left a img", author=".container .media-body .row div", chapters="#all-chapter a", body=".cont-text"),
    *_at("https://www.ddxss.cc/ https://www.ddtxt8.cc/", title=".book > .info h1", cover=".book > .info .cover > img", author=".book > .info .small span", synopsis=".book > .info .intro", chapters="div.listmain a", body="div#chaptercontent"),
    *_at("https://ixdzs8.tw/ https://ixdzs8.com/ https://tw.m.ixdzs.com/ https://www.aixdzs.com/", title="div.novel div.n-text h1", cover="div.novel div.n-img > img", author="div.novel div.n-text a.bauthor", synopsis="p#intro", chapters="ul.u-chapter > li > a", body="article.page-content section"),
    *_at("https://www.piaotian.com/ https://www.ptwxz.com/ https://www.piaotia.com/", encoding="gbk", title="div.title", author="div.list", chapters="div.centent ul li a", body="div#content"),
    *_at("https://www.shuhaige.net/ https://m.shuhaige.net/", title="#info h1, h1", cover="#fmimg img", author="meta[property='og:novel:author'], #info p", synopsis="#intro", chapters="a[href$='.html']", body="#content"),
    *_at("https://www.shw5.cc/ https://www.bq99.cc/ https://www.p2wt.com/", title=".book h1", cover=".book img", author=".book .small span", synopsis=".intro dd", chapters=".listmain a:not([rel])", body="#chaptercontent"),
    *_at("https://www.uukanshu.net/", encoding="gbk", **UUKANSHU),
    *_at("https://tw.uukanshu.net/", encoding="utf-8", **UUKANSHU),
    *_at("https://sj.uukanshu.net/", title=".bookname", cover=".book-info img", author=".book-info dd", chapters="ul#chapterList li a", body="#bookContent"),
    *_at("https://www.xbanxia.com/ https://www.banxia.cc/", title="div.book-describe h1", cover="div.book-img img", author="[href*='author']", synopsis="div.book-describe .describe-html", chapters="div.book-list ul li a", body="div#nr1"),
    *_at("https://www.xnunu.com/", title=".book-bookinfo h1.name", cover=".book-bookinfo img.thumbnail", author=".book-bookinfo p>a.btn-info", synopsis=".book-bookinfo #bookIntro", tags="ol.breadcrumb > li:nth-child(2) > a", chapters="dl.panel-chapterlist>dd>a", body="#chaptercontent"),
]

#: How a site's list of chapters is to be read, where that isn't as it stands: `latest first` (turned round), or `numbered` (of links with one number the last, by number).
ORDERS = {
    "latest first": "https://xtruyen.vn/ https://www.69shuba.com/ https://www.69shu.com/ https://www.69xinshu.com/ https://www.69shu.pro/ https://www.69shuba.pro/ https://69shuba.cx/ https://69shu.me/ https://www.uukanshu.net/ https://tw.uukanshu.net/",
    "numbered": "https://www.shuhaige.net/ https://m.shuhaige.net/",
}


def value_of(node: H.Node | None) -> str | None:
    """A meta tag's content, an image's address, or a tag's text."""
    if node is None:
        return None
    if node.tag == "meta":
        return node.attrs.get("content")
    if node.tag == "img":
        return next((node.attrs[k] for k in ("data-original", *H.IMAGE_SOURCES) if node.attrs.get(k)), None)
    return " ".join(node.text().split())


def read_page(html: str | None, config: dict, references: tuple[str, ...] | None = None) -> dict:
    """Fields of a page. A field whose selector finds nothing is null; chapters are links in order, each address once; body is cleaned."""
    root = H.parse(H.with_references(html, references))
    pick = lambda f: next(iter(H.select(root, config.get(f) or DEFAULTS.get(f) or "#")), None) if config.get(f) or f in DEFAULTS else None
    links = {}
    for a in H.select(root, config["chapters"]) if config.get("chapters") else []:
        links.setdefault(a.attrs.get("href", ""), " ".join(a.text().split()))
    bodies = H.select(root, config["body"])[:1] if config.get("body") else []
    return {
        "title": value_of(pick("title")),
        "cover": value_of(pick("cover")),
        "author": value_of(pick("author")),
        "synopsis": value_of(pick("synopsis")),
        "tags": [t.strip() for t in (value_of(pick("tags")) or "").split(",") if t.strip()],
        "chapters": [{"url": u, "title": t} for u, t in links.items() if u],
        "body": H.extract_contents(bodies[0].render()) if bodies else None,
    }


def sources_table(spark: SparkSession, sources: list[dict] = SOURCES) -> DataFrame:
    """The registry as a dimension table."""
    names = ["prefix", "encoding", *FIELDS]
    return spark.createDataFrame([tuple(s.get(k) for k in names) for s in sources], ", ".join(f"{k} string" for k in names)).withColumn("name", F.col("prefix"))


def read_pages(pages: DataFrame, url: str, html: str, sources: list[dict] = SOURCES, references: tuple[str, ...] | None = None) -> DataFrame:
    """pages with source_name and page (title, cover, author, synopsis, tags, chapters, body), by the selectors of the longest matching prefix, else the
    defaults; references are the character references that count (None: all). The sources are a list in the program, so what each task gets is bounded by it."""
    bound = registry.bind(pages, url, sources_table(pages.sparkSession, sources))
    by_name = {s["prefix"]: s for s in sources}

    @F.pandas_udf("title string, cover string, author string, synopsis string, tags array<string>, chapters array<struct<url:string,title:string>>, body string")
    def read(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(t, by_name.get(n) or {}, references) for n, t in zip(names, texts, strict=True)], columns=FIELDS)

    return bound.withColumn("page", read(F.col("source_name"), F.col(html)))


def decoded(content: Column, encoding: Column) -> Column:
    """Bytes as text, each row's by its own encoding (null: UTF-8); null if they don't fit or there is no such encoding."""

    @F.pandas_udf("string")
    def of(data: pd.Series, names: pd.Series) -> pd.Series:
        def one(b, name):
            try:
                return None if b is None else bytes(b).decode(name or "utf-8")
            except (UnicodeDecodeError, LookupError):
                return None

        return pd.Series([one(b, n) for b, n in zip(data, names, strict=True)], dtype=object)

    return of(content, encoding)


def in_order(chapters: Column, order: Column) -> Column:
    """A list of links as its site means it: without links that have no title, turned round where the latest comes first, or by number, each number's last link."""
    named = F.filter(chapters, lambda c: X.has_text(F.coalesce(c["title"], F.lit(""))))
    number = lambda c: F.regexp_extract(c["url"], r"(\d+)(?:\.\w+)?/?$", 1).try_cast("long")
    placed = F.array_sort(F.filter(F.transform(named, lambda c, k: F.struct(number(c).alias("n"), k.alias("k"), c["url"].alias("url"), c["title"].alias("title"))), lambda c: c["n"].isNotNull()))
    following = lambda k: F.get(placed, k + 1)["n"]
    last = F.filter(placed, lambda c, k: following(k).isNull() | (following(k) != c["n"]))
    by_number = F.transform(last, lambda c: F.struct(c["url"].alias("url"), c["title"].alias("title")))
    return F.when(order == "numbered", by_number).when(order == "latest first", F.reverse(named)).otherwise(named)


def read_fetched(pages: DataFrame, url: str, content: str, sources: list[dict] = SOURCES) -> DataFrame:
    """pages as they were fetched (content: bytes) with source_name and page, in one read: each is decoded as its source's pages are, read by its selectors, and its list of
    chapters brought into order. Bytes that don't fit are a page without anything. The sources' rules are a small table that each row's source is joined with once."""
    orders = {p: k for k, prefixes in ORDERS.items() for p in prefixes.split()}
    table = sources_table(pages.sparkSession, sources).select(F.col("name").alias("rule_"), "encoding")
    named = F.create_map(*[F.lit(x) for pair in orders.items() for x in pair])
    own = pages.columns
    bound = registry.bind(pages, url, sources_table(pages.sparkSession, sources)).withColumnRenamed("source_name", "bound_")
    text = bound.join(table, F.col("bound_") == F.col("rule_"), "left").withColumn("text_", decoded(F.col(content), F.col("encoding")))
    read = read_pages(text.select(*own, "text_", "bound_"), url, "text_", sources)
    page = F.col("page").withField("chapters", F.when(F.col("text_").isNotNull(), in_order(F.col("page.chapters"), named[F.col("source_name")])))
    return read.select(*own, "source_name", F.when(F.col("text_").isNotNull(), page).alias("page"))
