"""HTML as a small tree by the standard library's parser, and what is read from it; pandas UDFs over whole pages.

A parser that repairs differently gives a different tree, so the rules are this module's own: void tags have no content; an open p ends where a
block starts; a closing tag closes the nearest open tag of its name, or nothing; what is open at the end is closed. Everything goes over the tree
by a list of its own rather than by recursion, so that a page may nest as deeply as it is long.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tag sets and attributes, space-separated.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BAD_TAGS = set(
    "address amp-auto-ads audio button figcaption footer form header iframe input ins map nav noscript object output pirate script select "
    "source style textarea tfoot video".split()
)
BAD_CLASSES = set(
    "adblock-service sharedaddy saboxplugin-wrap adbox ads-middle ads adsbygoogle adsense-code cb_p6_patreon_button code-block ezoic-ad-adaptive "
    "ezoic-ad ezoic-adpicker-ad googlepublisherads inline-ad-slot jp-relatedposts wp-post-navigation".split()
)
BAD_LINKS = ("patreon.com", "paypal.me")
BLOCKS = set("article aside div h1 h2 h3 h4 h5 h6 main p section".split())
VERBATIM = set("canvas img pre".split())
PLAIN = set("a abbr acronym label span time".split())
KEPT_ATTRIBUTES = set("src style colspan rowspan headers scope axis id".split())
KEPT_STYLES = ("font-style", "font-weight")
IMAGE_SOURCES = ("data-lazy-src", "data-src", "src")
IMPORT_TAGS = set(
    "p div span br hr h1 h2 h3 h4 h5 h6 blockquote pre code em strong b i u s small sub sup ul ol li dl dt dd table thead tbody tfoot tr th td "
    "ruby rt rp a".split()
)
IMPORT_DROPS = set(
    "script style iframe frame frameset object embed applet svg math link meta base form input button select textarea audio video source track "
    "canvas template noscript".split()
)
READER_BLOCKS = set("address article blockquote dd div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header li main ol p pre section table tr ul".split())
MARK = "␣"


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def events(self, enter: Callable[[Node], bool] = lambda n: True) -> Iterator[tuple[str, Node | str]]:
        """("text", s), ("open", node) and ("close", node) of all below, in order; a node that enter() refuses is left out with all in it."""
        todo: list[tuple[Node, Iterator[Node | str]]] = [(self, iter(self.children))]
        while todo:
            node, rest = todo[-1]
            c = next(rest, None)
            if c is None:
                todo.pop()
                if todo:
                    yield "close", node
            elif isinstance(c, str):
                yield "text", c
            elif enter(c):
                yield "open", c
                todo.append((c, iter(c.children)))

    def walk(self) -> Iterator[Node]:
        return (n for what, n in self.events() if what == "open")

    def strings(self) -> Iterator[str]:
        return (s for what, s in self.events(lambda n: n.tag not in ("script", "style", "template")) if what == "text")

    def text(self) -> str:
        return "".join(self.strings())

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def drop(self, bad: Callable[[Node], bool]) -> None:
        """Remove every node below for which bad is true."""
        todo = [self]
        while todo:
            n = todo.pop()
            n.children = [c for c in n.children if isinstance(c, str) or not bad(c)]
            todo += [c for c in n.children if isinstance(c, Node)]

    def inner(self) -> str:
        out = []
        for what, x in self.events():
            if what == "text":
                out.append(escape(x, quote=False))
            elif what == "open":
                out.append(_start(x))
            elif x.tag not in VOID:
                out.append(f"</{x.tag}>")
        return "".join(out)

    def render(self) -> str:
        return Node("#", {}, [self]).inner()


def _start(n: Node) -> str:
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items())
    return f"<{n.tag}{attrs}/>" if n.tag in VOID else f"<{n.tag}{attrs}>"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.count: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and self.count["p"]:
            self.handle_endtag("p")
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        node.attrs = dict(reversed(node.attrs.items()))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while self.count[tag]:
            closed = self.open.pop().tag
            self.count[closed] -= 1
            if closed == tag:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; comments, declarations and instructions are left out."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def with_references(html: str | None, names: tuple[str, ...] | None) -> str:
    """A page of whose character references only those of the names count, with their semicolon; all others stay as they are written. None: all that HTML knows count, also
    those that it reads without a semicolon. (For texts and attributes: in scripts and styles, which have no references, it changes what is written.)"""
    return html or "" if names is None else re.sub(rf"&(?!(?:{'|'.join(names)});)", "&amp;", html or "")


def body_of(root: Node) -> Node:
    return root.find("body") or root


# ------------------------------------------------------------------ selectors

_PART = re.compile(r"""([\w-]+|\*)|\#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:([*^$]?=)(["']?)(.*?)\6)?\]|:nth-child\((\d+)\)|:not\(\[([\w:-]+)\]\)""")
_STEP = re.compile(r"(>)?\s*((?:\[[^\]]*\]|\([^)]*\)|[^\s>\[(])+)")


def _matches(node: Node, place: int, simple: str) -> bool:
    for tag, id_, cls, attr, op, _, value, nth, no in _PART.findall(simple):
        have = node.attrs.get(attr) if attr else None
        ok = (
            (not tag or tag in ("*", node.tag))
            and (not id_ or node.attrs.get("id") == id_)
            and (not cls or cls in node.attrs.get("class", "").split())
            and (not attr or have is not None and (not op or {"=": have == value, "*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value)}[op]))
            and (not nth or place == int(nth))
            and (not no or no not in node.attrs)
        )
        if not ok:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes below root that a selector finds, in their order: tags, ids, classes, attributes, nth-child, not an attribute, descent, child and lists.

    What of each selector has been met is carried downwards (by the parent itself, and by any ancestor), so a node costs the same at any depth.
    """
    chains = [[(child == ">", simple) for child, simple in _STEP.findall(one)] for one in selector.split(",")]
    out: list[Node] = []
    own = [[set() for _ in chains]]  # steps met by each open node itself
    above = [[set() for _ in chains]]  # and by it or any node around it
    place = [0]
    for what, n in root.events():
        if what == "open":
            place[-1] += 1
            met = [{k for k, (child, simple) in enumerate(chain) if (k == 0 or k - 1 in (own if child else above)[-1][c]) and _matches(n, place[-1], simple)} for c, chain in enumerate(chains)]
            if any(chain and len(chain) - 1 in m for chain, m in zip(chains, met, strict=True)):
                out.append(n)
            above.append([a if m <= a else a | m for a, m in zip(above[-1], met, strict=True)])
            own.append(met)
            place.append(0)
        elif what == "close":
            own.pop()
            above.pop()
            place.pop()
    return out


# ------------------------------------------------------------------ cleaning


@dataclass
class Rules:
    """What a caller adds to the cleaning: selectors of nodes that go, tags, patterns by tag of texts whose nodes go (nodes of those tags without text
    go too), and patterns that are replaced by a mark in the result."""

    css: list[str] = field(default_factory=list)
    tags: set[str] = field(default_factory=set)
    tag_texts: dict[str, list[str]] = field(default_factory=dict)
    blacklist: list[str] = field(default_factory=list)
    mark: str = MARK


NO_RULES = Rules()


def _clean(text: str) -> str:
    kept = "".join(c for c in text.strip() if unicodedata.category(c) not in ("Cc", "Cf"))
    return kept.replace("<", "&lt;").replace(">", "&gt;")


def _bad(n: Node) -> bool:
    classes = n.attrs.get("class", "").split()
    return n.tag in BAD_TAGS or not BAD_CLASSES.isdisjoint(classes) or (n.tag == "a" and any(x in n.attrs.get("href", "") for x in BAD_LINKS))


def bad_text(n: Node, rules: Rules) -> bool:
    """Whether a node of a listed tag has no text at all, or one that a pattern of its tag finds."""
    if n.tag not in rules.tag_texts:
        return False
    text = n.text()
    return not text or any(re.search(p, text, re.M) for p in rules.tag_texts[n.tag] if p)


def clean_style(style: str) -> str:
    """The kept properties of a style, in a fixed order; of one given twice the last."""
    given = dict(re.findall(r"\s*([^:;]*[^:;\s])\s*:\s*([^;]*)", style))
    given = {k.lower(): v.strip() for k, v in given.items()}
    return ";".join(f"{k}:{given[k]}" for k in KEPT_STYLES if given.get(k))


def clean_tree(root: Node, rules: Rules = NO_RULES) -> Node:
    """Without bad tags, advertising classes and donation links, repeated br or hr, images without a source, attributes beyond a few, and what the
    caller's rules name."""
    if rules.css:
        gone = {id(n) for n in select(root, ",".join(rules.css))}
        root.drop(lambda n: id(n) in gone)
    if rules.tag_texts:
        gone = {id(n) for n in root.walk() if bad_text(n, rules)}
        root.drop(lambda n: id(n) in gone)
    root.drop(lambda n: _bad(n) or n.tag in rules.tags)
    root.drop(lambda n: n.tag == "img" and not any(n.attrs.get(k) for k in IMAGE_SOURCES))
    for n in [root, *root.walk()]:
        if n.tag == "img":
            n.attrs = {"src": next(n.attrs[k] for k in IMAGE_SOURCES if n.attrs.get(k))}
        elif n.tag not in ("br", "hr"):
            n.attrs = {k: w for k, v in n.attrs.items() if k in KEPT_ATTRIBUTES and (w := clean_style(v) if k == "style" else v)}
        after = [*n.children[1:], None]
        n.children = [c for c, d in zip(n.children, after, strict=False) if not (isinstance(c, Node) and c.tag in ("br", "hr") and isinstance(d, Node) and d.tag == c.tag)]
    return root


class _Lines:
    """Builds lines from a tree's events, in time linear in what comes out.

    A break is only asked for, and made when content follows; so breaks at an element's edges come to nothing. `tails` has for each open element what it
    got since its last content: True for a break, False for blank text. Tags other than blocks and plain ones stay around their text: they are
    opened in a line with its first content in them, and closed where the line ends, to be opened again in the next.
    """

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.content = 0  # pieces so far
        self.since: list[int] = [0]  # pieces before each open element
        self.tails: list[list[bool]] = [[]]
        self.waiting: list[int] = []  # depths of elements that ask for a break
        self.around: list[str] = []
        self.opened = 0
        self.gap = ""  # what parts the next piece from the line so far

    def ask(self) -> None:
        self.tails[-1].append(True)
        if not self.waiting or self.waiting[-1] != len(self.tails) - 1:
            self.waiting.append(len(self.tails) - 1)

    def _tail_of(self, depth: int) -> None:
        if True not in self.tails[depth] and self.waiting and self.waiting[-1] == depth:
            self.waiting.pop()

    def put(self, piece: str) -> None:
        if not piece:
            self.tails[-1].append(False)
            return
        if self.waiting and self.content > self.since[self.waiting[0]]:
            self.end()
        for depth in self.waiting:
            self.tails[depth].clear()
        self.tails[-1].clear()
        self.waiting.clear()
        for tag in self.around[self.opened :]:
            self.line.append(f"{self.gap}<{tag}>")
            self.gap = ""
        self.opened = len(self.around)
        self.line.append(self.gap + piece)
        self.gap = " "
        self.content += 1

    def end(self) -> None:
        self.line += [f"</{tag}>" for tag in reversed(self.around[: self.opened])]
        self.opened = 0
        if text := "".join(self.line).strip():
            self.lines.append(text)
        self.line, self.gap = [], ""

    def enter(self, n: Node) -> None:
        if n.tag in BLOCKS:
            self.ask()
        elif n.tag not in PLAIN:
            self.around.append(n.tag)
        self.since.append(self.content)
        self.tails.append([])

    def leave(self, n: Node) -> None:
        full = self.content > self.since.pop()
        self.tails.pop()
        if self.waiting and self.waiting[-1] == len(self.tails):
            self.waiting.pop()
        if n.tag in BLOCKS:
            if full:
                self.ask()
            return
        if n.tag not in PLAIN:
            if self.opened == len(self.around):
                self.line.append(f"</{n.tag}>")
                self.opened -= 1
            self.around.pop()
        if full:
            self.tails[-1].clear()
        elif self.tails[-1] and self.tails[-1][-1]:  # an empty one takes back the break before it
            self.tails[-1].pop()
        self._tail_of(len(self.tails) - 1)


def paragraphs_of(root: Node) -> list[str]:
    """A cleaned tree's lines: blocks, br and hr end them."""
    b = _Lines()
    for what, n in root.events(lambda n: n.tag not in VERBATIM or (b.put(n.render()), False)[1]):
        if what == "text":
            b.put(_clean(n))
        elif n.tag in ("br", "hr"):
            if what == "open":
                b.ask()
        elif what == "open":
            b.enter(n)
        else:
            b.leave(n)
    b.end()
    return b.lines


def extract_contents(html: str | None, rules: Rules = NO_RULES) -> str:
    """A chapter's body as <p> paragraphs."""
    out = "".join(f"<p>{p}</p>" for p in paragraphs_of(clean_tree(body_of(parse(html)), rules)))
    return re.sub("|".join(f"(?:{p})" for p in rules.blacklist), rules.mark, out) if rules.blacklist else out


def sanitize(html: str | None) -> str:
    """Only harmless tags without attributes; images become their alternative texts, other tags their contents."""
    out = []
    for what, x in body_of(parse(html)).events(lambda n: n.tag not in IMPORT_DROPS):
        if what == "text":
            out.append(escape(x, quote=False))
        elif x.tag == "img":
            out += [escape(x.attrs.get("alt", ""), quote=False)] if what == "open" else []
        elif x.tag in IMPORT_TAGS:
            out += [_start(Node(x.tag))] if what == "open" else [f"</{x.tag}>"] if x.tag not in VOID else []
    return "".join(out).strip()


def extract_text(html: str | None, references: tuple[str, ...] | None = None) -> str:
    """Each piece of text on a line of its own, without blank lines."""
    pieces = (s.strip() for s in parse(with_references(html, references).replace("</p><p", "</p>\n<p")).strings())
    return re.sub(r"[\r\n]+", "\n", "\n".join(p for p in pieces if p))


def reader_text(html: str | None) -> str:
    """A chapter as a reader sees it: blocks and br end lines, at most one blank line in a row, scripts and styles left out."""
    out = []
    for what, x in body_of(parse(html)).events(lambda n: n.tag not in ("script", "style", "noscript")):
        if what == "text":
            out.append(x)
        elif x.tag in READER_BLOCKS or (x.tag == "br" and what == "open"):
            out.append("\n")
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(out).replace(" ", " "))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def rewrite_images(html: str | None, page: str | None) -> tuple[str, dict[str, str]]:
    """Sources of images with an absolute http address become images/<id>.jpg; the ids' addresses. An id is the MD5 of page and address."""
    root, found = parse(html), {}
    for n in root.walk():
        src = (n.attrs.get("src") or "").strip().rstrip("/") if n.tag == "img" else ""
        if src and not src.startswith("http") and page:
            base = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", page)
            src = (base[0] if base else "") + src if src.startswith("/") and not src.startswith("//") else (f"{page.split(':')[0]}:{src}" if src.startswith("//") else f"{page.rstrip('/')}/{src}")
        if src.startswith("http"):
            key = hashlib.md5(str([page, src]).encode()).hexdigest()
            found[key] = src
            n.attrs = {"src": f"images/{key}.jpg", "alt": key}
    return (body_of(root).inner() if found else html or ""), found


def metadata(html: str | None, references: tuple[str, ...] | None = None) -> dict:
    """title, cover, author, synopsis, tags, first heading, links: by og: and twitter: properties first, then by tags. What is missing is null."""
    root = parse(with_references(html, references))
    meta: dict[str, str] = {}
    tags, links = [], []
    for n in root.walk():
        if n.tag == "meta":
            name = (n.attrs.get("property") or n.attrs.get("name") or "").lower()
            if name.endswith(":tag") or name == "keywords":
                tags += [x.strip() for x in n.attrs.get("content", "").split(",")]
            meta.setdefault(name, n.attrs.get("content", "").strip())
        elif n.tag == "a" and n.attrs.get("href"):
            links.append(n.attrs["href"])
    title, heading = root.find("title"), root.find("h1", "h2", "h3", "h4", "h5", "h6")
    pick = lambda *names: next((meta[k] for k in names if meta.get(k)), None)
    spaced = lambda n: " ".join(n.text().split()) if n else None
    return {
        "title": pick("og:novel:novel_name", "og:title", "twitter:title") or spaced(title) or spaced(heading),
        "cover": pick("og:image", "twitter:image"),
        "author": pick("og:novel:author", "author", "twitter:creator"),
        "synopsis": pick("og:description", "description", "twitter:description"),
        "tags": [t for t in dict.fromkeys(tags) if t],
        "heading": spaced(heading),
        "links": links,
    }


def _string_udf(function):
    @F.pandas_udf(T.StringType())
    def of(s: pd.Series) -> pd.Series:
        return s.map(function, na_action="ignore")

    return of


contents_udf, sanitize_udf, text_udf, reader_udf = _string_udf(extract_contents), _string_udf(sanitize), _string_udf(extract_text), _string_udf(reader_text)


def contents_by(rules: Rules):
    """extract_contents() by a caller's rules, as a UDF."""
    return _string_udf(lambda s: extract_contents(s, rules))


def text_by(references: tuple[str, ...]):
    """extract_text() by the character references that count, as a UDF."""
    return _string_udf(lambda s: extract_text(s, references))


_TEXTS = T.ArrayType(T.StringType())
_METADATA = {"title": T.StringType(), "cover": T.StringType(), "author": T.StringType(), "synopsis": T.StringType(), "tags": _TEXTS, "heading": T.StringType(), "links": _TEXTS}


def metadata_by(references: tuple[str, ...] | None):
    """metadata() by the character references that count, as a UDF."""

    @F.pandas_udf(T.StructType([T.StructField(k, t) for k, t in _METADATA.items()]))
    def of(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([metadata(x, references) for x in s], columns=list(_METADATA))

    return of


metadata_udf = metadata_by(None)


@F.pandas_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("images", T.MapType(T.StringType(), T.StringType()))]))
def images_udf(html: pd.Series, page: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rewrite_images(h, p) for h, p in zip(html, page, strict=True)], columns=["body", "images"])


def parse_page(html: Column) -> Column:
    return metadata_udf(html)
