"""Text expressions on columns, JVM-side. Lengths are in code points; white space, digits and words are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as a text is split into lines, and quotation and bracket pairs that have to balance.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
PAIRS = (("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』"), ("(", ")"), ("[", "]"), ("（", "）"), ("【", "】"), ("«", "»"))
#: Fixed pattern: a line that shows its chapter's number.
NUMBERED_HEADING = r"(?iU)^\s*(?:第\s*(?:\d+|[零〇一二三四五六七八九十百千万两]+)\s*[章回节卷篇]|(?:Chương|Chapter)\s+\d+\b|#\s*\d+\b)"
#: Fixed pattern: a heading in the source's own form.
NATIVE_HEADING = r"(?U)^\s*第\s*(?:\d+|[零〇一二三四五六七八九十百千万两]+)\s*[章回节]"
#: Fixed pattern: where a note by the author or the platform starts.
NOTE = r"(?iU)^\s*(?:作者(?:有话说|的话|注|按|后记)\s*[:：]?|P\.?S\.?\s*[:：]|PS\s*[:：]|求(?:月票|推荐票|订阅|打赏|收藏)\b|(?:平台|网站|站内)(?:提示|公告)\s*[:：])"


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once however often body has it: an expression in a lambda, and what follows one, is else evaluated wherever it is."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_text(c: Column) -> Column:
    return c.rlike(r"(?U)\S")


def normalize_newlines(c: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_lines(c: Column) -> Column:
    """Lines as they are, without those of white space alone."""
    return F.filter(F.split(normalize_newlines(c), "\n", -1), has_text)


def split_lines(c: Column) -> Column:
    """All lines, by any Unicode line end; a final line end starts no further line."""
    return let(F.split(c, LINE_ENDS, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def count_of(c: Column, what: str | Column) -> Column:
    """Occurrences that don't overlap."""
    what = F.lit(what) if isinstance(what, str) else what
    return ((F.octet_length(c) - F.octet_length(F.replace(c, what, F.lit("")))) / F.octet_length(what)).cast("int")


def balanced(c: Column) -> Column:
    """As many openers as closers of each pair, and an even number of straight double quotes."""
    out = count_of(c, '"') % 2 == 0
    for left, right in PAIRS:
        out = out & (count_of(c, left) == count_of(c, right))
    return out


def censored(c: Column) -> Column:
    """Asterisks in place of words: two or more, or any between Han characters."""
    return c.rlike(r"(?<=[㐀-鿿])\*+(?=[㐀-鿿])|\*{2,}")


def heading_has_number(c: Column) -> Column:
    return c.rlike(NUMBERED_HEADING)


def native_heading(c: Column) -> Column:
    return c.rlike(NATIVE_HEADING)


def is_note(c: Column) -> Column:
    return c.rlike(NOTE)


def clean_text(c: Column) -> Column:
    """Stripped, without control and format characters (a line end inside joins its words), < and > escaped."""
    bare = F.regexp_replace(strip(c), r"[\p{Cc}\p{Cf}]", "")
    return F.replace(F.replace(bare, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def blacklist(c: Column, patterns: list[str], mark: str = "␣") -> Column:
    """Each match of a pattern becomes the mark; without patterns only stripped."""
    return F.regexp_replace(strip(c), "|".join(f"(?:{p})" for p in patterns), mark) if patterns else strip(c)


def estimated_tokens(c: Column) -> Column:
    """A cautious output size: 1.9 for each Han character, 0.6 for each other, 5 for each quotation mark, rounded down."""
    han = F.regexp_count(c, F.lit("[㐀-鿿]"))
    quotes = F.regexp_count(c, F.lit('[“”「」『』"]'))
    return F.floor(han * F.lit(1.9) + F.greatest(F.lit(0), F.length(c) - han) * F.lit(0.6) + quotes * F.lit(5)).cast("int")


def ending_class(c: Column) -> Column:
    """strong, medium, weak or none, by the last character before closing marks."""
    last = F.regexp_extract(c, r"(?U)([^”’」』）》〉])[”’」』）》〉]*\s*$", 1)
    return F.when(last.isin(*"。！？…"), "strong").when(last == "；", "medium").when(last.isin(*"，：、"), "weak").otherwise("none")


def speech_intro(previous: Column, following: Column) -> Column:
    """A line that ends with a colon before one that opens a quotation."""
    return previous.rlike(r"(?U)：\s*$") & following.rlike(r"(?U)^\s*[“‘「『]")


def sentence_around(c: Column, what: Column) -> Column:
    """The sentence in which what first occurs, stripped; null if it doesn't."""
    at = F.instr(c, what)
    # Greedy to the last mark, so that a long text is gone through once.
    before = F.regexp_replace(F.substring(c, F.lit(1), at - 1), r"(?s)^.*[。！？!?；\n]", "")
    after = F.regexp_extract(F.substring(c, at + F.length(what), F.length(c)), r"(?s)^([^。！？!?；\n]*[。！？!?；\n]?)", 1)
    return F.when(at > 0, strip(F.concat(before, what, after)))


def sentences(c: Column) -> Column:
    """All sentences of a text, each with the mark that ends it."""
    return F.regexp_extract_all(c, F.lit(r"[^。！？!?；\n]*[。！？!?；\n]|[^。！？!?；\n]+"), F.lit(0))


def strip_title_wrapper(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iU)^\s*(?:Chương|Chapter)\s*\d+\s*[:：.\-]?\s*", "")


def format_size(c: Column) -> Column:
    """A whole number of bytes as 1.5 KB and the like: powers of 1024, one decimal, half to even."""
    units = ["B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB"]
    one = lambda k, unit: F.format_string(f"%.1f {unit}", F.bround(c / F.lit(float(1024**k)), 1))
    out = one(8, "YB")
    for k in range(len(units) - 1, -1, -1):
        out = F.when(F.abs(c.cast("double")) < float(1024 ** (k + 1)), one(k, units[k])).otherwise(out)
    return out


def chunk_start(id_: Column, size: int = 100) -> Column:
    """First id of the chunk of size ids that holds id_."""
    return (F.floor((id_ - 1) / F.lit(size)) * size + 1).cast("long")


def chunk_label(id_: Column, size: int = 100) -> Column:
    """0001-0100, or 0007 for chunks of one."""
    start = chunk_start(id_, size)
    return F.format_string("%04d", start) if size == 1 else F.format_string("%04d-%04d", start, start + size - 1)


def chapter_path(id_: Column) -> Column:
    return F.concat(F.lit("chapters/"), chunk_label(id_), F.format_string("/ch_%04d.json", id_))


def paragraph_id(chapter: Column, position: Column) -> Column:
    return F.format_string("P%04d_%04d", chapter, position)


def title_id(chapter: Column) -> Column:
    return F.format_string("C%04d_TITLE", chapter)


def digest(c: Column, names: list[str] | None = None) -> Column:
    """SHA-256 of a struct's JSON; names: only these fields, by name in order, so that the fields' order in the table doesn't matter (null fields are left out)."""
    return F.sha2(F.to_json(F.struct(*[c.getField(n).alias(n) for n in sorted(names)]) if names else c), 256)


def md5_of(*columns: Column) -> Column:
    """MD5 of texts one after the other; null counts as empty."""
    return F.md5(F.concat(*[F.coalesce(c, F.lit("")) for c in columns]).cast("binary"))


def absolute_url(url: Column, base: Column, page: Column) -> Column:
    """A link made absolute: by scheme, //host, /path, or else below the page; ./ and ../ are followed."""
    url = F.regexp_replace(strip(F.coalesce(url, F.lit(""))), "/+$", "")
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    here = F.regexp_replace(F.coalesce(page, base), "/+$", "")
    ups = F.size(F.filter(F.split(F.regexp_extract(url, r"^((?:\.\.?/)*(?:\.\.?$)?)", 1), "/"), lambda x: x == ".."))
    # The first of the leading dots stands for the page itself.
    first = F.regexp_extract(url, r"^(\.\.?)(?:/|$)", 1)
    climbs = ups - F.when(first == "..", 1).otherwise(0)
    parts = F.split(here, "/")
    rest = F.regexp_replace(url, r"^(?:\.\.?(?:/|$))+", "")
    relative = F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - climbs, F.lit(0))), "/"), F.when(rest == "", "").otherwise(F.concat(F.lit("/"), rest)))
    return (
        F.when((url == "") | F.split(url, ":")[0].isin("http", "https"), url)
        .when(url.startswith("//"), F.concat(F.split(root, ":")[0], F.lit(":"), url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url.startswith("."), relative)
        .otherwise(F.concat(here, F.lit("/"), url))
    )
