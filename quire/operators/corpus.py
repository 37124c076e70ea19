"""Lines, paragraphs and chapters of long texts; numbering, chunks and running computations over ordered rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import numbers as N
from quire.functions import text as X

#: Fixed patterns: headings of an imported text; a chapter heading, its like, and sentences that only refer to one; a separator line.
IMPORT_HEADING = (
    r"(?iU)^\s*(?:(?:chương|chuong|chapter|chap\.?|book|volume|quyển|quyen)\s+(?:(?:thứ|thu)\s+)?(?:\d+|[ivxlcdm]+)\b"
    r"|第\s*[零〇一二两兩三四五六七八九十百千万萬億亿\d]+\s*[章节節卷回]).*$"
)
CHAPTER_HEADING = r"(?U)^\s*第\s*(\d+|[零〇一二三四五六七八九十百千万亿两]+)\s*章\s*(.*)\s*$"
LIKE_HEADING = r"(?U)^\s*第\s*([^\s章]+)\s*章"
REFERENCE = r"^(?:中|里|里面)(?:记载|提到|描述|说过|写道)|^(?:所述|提到|说过)"
RULE = r"^-{20,}$"


def _numbered(text: Column) -> Column:
    """Lines of a text that aren't blank, with their numbers: array of (line, text)."""
    parts = F.split(X.normalize_newlines(text), "\n", -1)
    return F.filter(F.transform(parts, lambda x, k: F.struct((k + 1).alias("line"), x.alias("text"))), lambda x: X.has_text(x["text"]))


def lines(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, line, text) of lines that aren't blank, with their numbers in the source."""
    return docs.select(F.col(id_).alias("id"), F.explode(_numbered(F.col(text))).alias("l")).select("id", "l.line", "l.text")


def paragraphs(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, line, text, pos, pid, previous, following): lines that aren't blank, numbered 1, 2, ... in each text, and the lines around.

    A text's lines are numbered and meet their neighbours in its own row, by arrays beside each other, so nothing is shuffled.
    """
    d = docs.select(F.col(id_).alias("id"), _numbered(F.col(text)).alias("l"))
    d = d.select("id", F.col("l.line").alias("line"), F.col("l.text").alias("text"))
    none, rest = F.array(F.lit(None).cast("string")), F.greatest(F.size("text") - 1, F.lit(0))
    z = F.arrays_zip("line", "text", F.concat(none, F.slice("text", F.lit(1), rest)).alias("previous"), F.concat(F.slice("text", F.lit(2), rest), none).alias("following"))
    d = d.where(F.size("text") > 0).select("id", F.posexplode(z).alias("p", "z")).select("id", "z.line", "z.text", (F.col("p") + 1).alias("pos"), "z.previous", "z.following")
    return d.withColumn("pid", X.paragraph_id(F.col("id"), F.col("pos")))


def section_after(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, pos) of lines after which a blank line follows before the next."""
    d = docs.select(F.col(id_).alias("id"), F.transform(_numbered(F.col(text)), lambda x: x["line"]).alias("line")).where(F.size("line") > 1)
    z = F.arrays_zip("line", F.slice("line", F.lit(2), F.size("line") - 1).alias("next"))
    return d.select("id", F.posexplode(z).alias("p", "z")).where("z.next > z.line + 1").select("id", (F.col("p") + 1).alias("pos"))


def running_chars(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, pos, chars): characters of a text's lines up to each; only their lengths are ordered."""
    d = docs.select(F.col(id_).alias("id"), F.posexplode(F.transform(_numbered(F.col(text)), lambda x: F.length(x["text"]))).alias("p", "n"))
    return d.select("id", (F.col("p") + 1).alias("pos"), F.sum("n").over(Window.partitionBy("id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)).alias("chars"))


def clamped_depth(ordered: DataFrame, keys: list[str], order: list[str], step: Column) -> DataFrame:
    """ordered with depth: the running sum of step that never falls below zero, by its identity sum - min(0, least sum so far)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ordered.withColumn("sum_", F.sum(step).over(w))
    return out.withColumn("depth", F.col("sum_") - F.least(F.lit(0), F.min("sum_").over(w))).drop("sum_")


def number_by(ordered: DataFrame, keys: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """ordered with a number that grows by one at each row with flag (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumn(name, F.sum(flag.cast("int")).over(w))


def chunk_groups(chapters: DataFrame, keys: list[str], order: list[str], id_: str, size: int = 100) -> DataFrame:
    """chapters with chunk_start and group: a new group whenever the chunk changes from one row to the next."""
    w = Window.partitionBy(*keys).orderBy(*order)
    c = chapters.withColumn("chunk_start", X.chunk_start(F.col(id_), size))
    changed = ~F.col("chunk_start").eqNullSafe(F.lag("chunk_start").over(w)) | (F.row_number().over(w) == 1)
    return c.withColumn("group", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def import_sections(texts: DataFrame, id_: str, text: str, title: str) -> DataFrame:
    """(id, section, title, body) of decoded plain texts: cut before each heading line; what comes before the first is a section
    titled by the file, and so is a text without headings. A body is its paragraphs in <p>, parted by blank lines, with <br/> for line ends.

    Heading lines get a NUL, which decoded texts don't have, and the text is split there: all in its own row, without a shuffle.
    """
    marked = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.when(x.rlike(IMPORT_HEADING), F.concat(F.lit("\0"), x)).otherwise(x))
    e = texts.select(F.col(id_).alias("id"), F.col(title).alias("file"), F.split(F.array_join(marked, "\n"), r"\n?\x00", -1).alias("parts"))
    e = e.withColumn("opens", X.has_text(F.col("parts")[0])).select("id", "file", "opens", F.posexplode("parts").alias("part", "x")).where("part > 0 or opens")
    escaped = F.col("x")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(entity))
    paragraph = lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))
    html = F.array_join(F.transform(F.filter(F.split(escaped, r"\n[ \t]*\n", -1), lambda p: p != ""), paragraph), "")
    name = F.when(F.col("part") == 0, F.col("file")).otherwise(X.strip(F.substring_index("x", "\n", 1)))
    return e.select("id", (F.col("part") + F.col("opens").cast("int")).alias("section"), name.alias("title"), html.alias("body"))


def _parsed(texts: DataFrame, id_: str, text: str) -> DataFrame:
    """texts -> (id, own: the text, t: without a byte order mark, kept (its lines that count, as structs) and wrong: error, chapter, line, previous_line; null error: nothing).

    All in the text's own row: what each line is, by itself; then a fold whose state is a few numbers, which stops at the first thing that is wrong. Up to there
    chapter numbers grow, so a number that doesn't exceed the last one is wrong, and is looked up among the ones before once, behind the fold.
    """
    t = texts.select(F.col(id_).alias("id"), F.col(text).alias("own"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^\ufeff", "").alias("t"))

    def line(raw: Column, k: Column) -> Column:
        def of(bad, x, head, malformed, n, title, prose, own):
            counts = bad | ~(x.startswith("-") & x.rlike(RULE))
            return F.struct(
                (k + 1).alias("line"), bad.alias("bad"), counts.alias("counts"), head.alias("head"), malformed.alias("malformed"), n.cast("long").alias("n"), title.cast("string").alias("title"), prose.alias("prose"), own.alias("text")
            )

        def opening(bad, x):
            def named(a, b):
                sentence, text = b["head"] & b["after"].rlike("[，。！？；：,.!?;:]"), a["rest"]
                title = F.when(b["head"], F.when(sentence, F.regexp_extract(text, r"(?U)^(\S+)", 1)).otherwise(text))
                number = F.when(b["head"], N.chapter_number(F.regexp_extract(x, CHAPTER_HEADING, 1)))
                return of(bad, x, b["head"], ~a["looks"] & x.rlike(LIKE_HEADING), number, title, ((~b["head"] & (x != "")) | sentence), F.when(sentence, X.strip(b["after"])).otherwise(x))

            after = lambda a: F.struct((a["looks"] & ~a["rest"].rlike(REFERENCE)).alias("head"), F.regexp_extract(a["rest"], r"(?sU)^(\S+)\s+(\S.*)$", 2).alias("after"))
            found = F.struct(x.rlike(CHAPTER_HEADING).alias("looks"), X.strip(F.regexp_extract(x, CHAPTER_HEADING, 2)).alias("rest"))
            return X.let(found, lambda a: X.let(after(a), lambda b: named(a, b)))

        def whole(x):
            bad, no = F.contains(raw, F.lit("\ufffd")) | F.contains(raw, F.lit("\0")), F.lit(False)
            # Both kinds of headings begin, where white space ends, with this character; most lines don't, and meet no pattern.
            return F.when(x.startswith("第"), opening(bad, x)).otherwise(of(bad, x, no, no, F.lit(None), F.lit(None), x != "", x))

        return X.let(F.when(F.concat(F.left(raw, F.lit(1)), F.right(raw, F.lit(1))).rlike(r"(?U)\s"), X.strip(raw)).otherwise(raw), whole)

    none, no = F.lit(None).cast("long"), F.lit(None).cast("int")
    wrong = lambda error, chapter=none, line=no, previous=no: F.struct(error.alias("error"), chapter.alias("chapter"), line.alias("line"), previous.alias("previous_line"))
    state = lambda parts, n, at, prose, w: F.struct(parts.alias("parts"), n.alias("n"), at.alias("at"), prose.alias("prose"), w.alias("wrong"))

    def step(s: Column, x: Column) -> Column:
        empty = (s["parts"] > 0) & ~s["prose"]
        order = x["head"] & F.coalesce(x["n"] <= s["n"], F.lit(False))
        w = (
            F.when(x["bad"], wrong(F.lit("invalid_encoding"), x["n"], x["line"]))
            .when(x["malformed"], wrong(F.lit("malformed_heading"), none, x["line"]))
            .when(order, wrong(F.when(empty, F.lit("empty or order")).otherwise(F.lit("order")), x["n"], x["line"], s["at"]))
            .when(x["head"] & empty, wrong(F.lit("empty_chapter"), s["n"], s["at"]))
            .when((s["parts"] == 0) & x["prose"] & ~x["head"], wrong(F.lit("content_before_chapter"), none, x["line"]))
            .otherwise(s["wrong"])
        )
        after = F.when(x["head"], state(s["parts"] + 1, F.coalesce(x["n"], s["n"]), x["line"], x["prose"], w)).otherwise(state(s["parts"], s["n"], s["at"], s["prose"] | x["prose"], w))
        return F.when(s["wrong"]["error"].isNotNull(), s).otherwise(after)

    begin = state(F.lit(0), none, no, F.lit(False), wrong(F.lit(None).cast("string")))
    # Each step's value is a row of one generated: else the optimizer would put the expression itself wherever its value is used, in filters and in lambdas, for each line anew.
    once = lambda d, name, value: d.select("*", F.explode_outer(F.array(value)).alias(name))
    d = once(once(t, "kept", F.filter(F.transform(X.split_lines(F.col("t")), line), lambda x: x["counts"])), "end", F.aggregate("kept", begin, step))
    w, before = F.col("end.wrong"), F.filter("kept", lambda x: x["head"] & (x["line"] < F.col("end.wrong.line")))
    same = F.get(F.filter(before, lambda x: x["n"] == F.col("end.wrong.chapter")), F.lit(0))["line"]
    last = F.element_at(before, -1)
    found = (
        F.when(~X.has_text(F.col("t")), wrong(F.lit("empty_raw")))
        .when(w["error"].isin("order", "empty or order") & same.isNotNull(), wrong(F.lit("duplicate_chapter"), w["chapter"], w["line"], same))
        .when(w["error"] == "empty or order", wrong(F.lit("empty_chapter"), last["n"], last["line"]))
        .when(w["error"] == "order", wrong(F.lit("backwards_chapter"), w["chapter"], w["line"], w["previous_line"]))
        .when(w["error"].isNotNull(), w)
        .when(F.col("end.parts") == 0, wrong(F.lit("no_chapters")))
        .when(~F.col("end.prose"), wrong(F.lit("empty_chapter"), F.col("end.n"), F.col("end.at")))
        .otherwise(wrong(F.lit(None).cast("string")))
    )
    return once(d, "wrong", found)


def parse_chapters(texts: DataFrame, id_: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Numbered chapters of raw texts, and what is wrong with them.

    -> (paragraphs: id, chapter, title, source_line, pos, pid, line, text), (problems: id, error, chapter, line, previous_line, the first by
    line in each text). A chapter starts at a heading line; lines of 20 or more dashes are skipped; a heading that only refers to a
    chapter is prose; a title with a sentence after it has that as its first paragraph. Texts with a problem have no paragraphs.

    Nothing is shuffled: a text's chapters are slices of its lines between headings, which leave its row as they are. A number too large for a long is null, and in no order.
    """
    d = _parsed(texts, id_, text)
    problems = d.where("wrong.error is not null").select("id", "wrong.*")
    heads = F.filter(F.transform("kept", lambda x, k: F.when(x["head"], k + 1)), lambda k: k.isNotNull())
    good = d.where("wrong.error is null").select("id", "kept", F.explode_outer(F.array(heads)).alias("heads"))
    until = lambda k: F.coalesce(F.get("heads", k + 1), F.size("kept") + 1)
    cut = F.transform("heads", lambda p, k: F.struct(F.element_at("kept", p).alias("head"), F.filter(F.slice("kept", p, until(k) - p), lambda x: x["prose"]).alias("lines")))
    c = good.select("id", F.explode(cut).alias("c")).select("id", F.col("c.head.n").alias("chapter"), F.col("c.head.title").alias("title"), F.col("c.head.line").alias("source_line"), F.posexplode("c.lines").alias("p", "x"))
    pos = F.col("p") + 1
    return c.select("id", "chapter", "title", "source_line", pos.alias("pos"), X.paragraph_id(F.col("chapter"), pos).alias("pid"), "x.line", "x.text"), problems


def format_novel(chapters: DataFrame, volumes: DataFrame, keys: list[str], per_volume: int = 100) -> tuple[DataFrame, DataFrame]:
    """Renumber a book's volumes and chapters from 1 in id order, and count each volume's chapters.

    chapters (keys, id, title, volume), volumes (keys, id, title). A book without volumes gets one for each per_volume chapters; a chapter of an
    unknown volume goes to that of its place, or to one more, `Unknown`.
    """
    n = chapters.groupBy(*keys).agg(F.count("*").alias("n"))
    made = n.join(volumes.select(*keys).distinct(), keys, "left_anti").select(*keys, F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / per_volume).cast("int"))).alias("old")).withColumn("title", F.lit(None).cast("string"))
    v = volumes.select(*keys, F.col("id").cast("int").alias("old"), "title").unionByName(made)
    v = v.withColumn("volume", F.row_number().over(Window.partitionBy(*keys).orderBy("old")))
    c = chapters.withColumn("new_id", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
    c = c.join(v.select(*keys, F.col("old").alias("volume"), F.lit(True).alias("known")), [*keys, "volume"], "left")
    c = c.withColumn("old", F.when(F.col("known"), F.col("volume")).otherwise(1 + F.floor((F.col("new_id") - 1) / per_volume)).cast("int")).drop("volume", "known")
    c = c.join(v.select(*keys, "old", "volume"), [*keys, "old"], "left")
    c = c.join(v.groupBy(*keys).agg(F.max("volume").alias("volumes")), keys, "left").withColumn("volume", F.coalesce("volume", F.col("volumes") + 1))
    named = lambda title, word, k: F.when(F.coalesce(title, F.lit("")) == "", F.concat(F.lit(word + " "), k.cast("string"))).otherwise(title)
    out = c.select(*keys, F.col("new_id").alias("id"), named(F.col("title"), "Chapter", F.col("new_id")).alias("title"), "volume")
    counts = out.groupBy(*keys, "volume").agg(F.count("*").alias("chapters"))
    both = v.select(*keys, "volume", "title").join(counts, [*keys, "volume"], "full")
    known = both.join(v.groupBy(*keys).agg(F.max("volume").alias("volumes")), keys, "left")
    title = F.when(F.col("volume") > F.col("volumes"), "Unknown").otherwise(named(F.col("title"), "Volume", F.col("volume")))
    return out, known.select(*keys, "volume", title.alias("title"), F.coalesce("chapters", F.lit(0)).alias("chapters"))


def next_fit(sizes: list[list[float]], limits: list[float], most: int | None = None) -> list[int]:
    """Group of each item in order: a new one where a limit would be passed; an item above a limit stands alone."""
    out, group, count, held = [], -1, 0, [0.0] * len(limits)
    for item in sizes:
        if group < 0 or (count and (any(h + s > m for h, s, m in zip(held, item, limits, strict=True)) or (most and count >= most))):
            group, count, held = group + 1, 0, [0.0] * len(limits)
        out.append(group)
        count += 1
        held = [h + s for h, s in zip(held, item, strict=True)]
    return out


SENTENCE = re.compile(r"[^。！？!?\n]*[。！？!?][”’」』]?|[^。！？!?\n]+$")
CLAUSE = re.compile(r"[^，；]*[，；][”’」』]?|[^，；]+$")


def split_paragraph(text: str, limit: int) -> list[str]:
    """Pieces of whole sentences, else clauses, of at most limit characters, next-fit; an error if a clause alone is longer."""
    if len(text) <= limit:
        return [text]
    parts: list[str] = []
    for sentence in SENTENCE.findall(text):
        parts += [sentence] if len(sentence) <= limit else CLAUSE.findall(sentence)
    if "".join(parts) != text or any(len(p) > limit for p in parts):
        raise ValueError("a clause is longer than the limit")
    groups = next_fit([[len(p)] for p in parts], [limit])
    return ["".join(p for p, g in zip(parts, groups, strict=True) if g == k) for k in range(groups[-1] + 1)]


def split_paragraphs(text: Column, limit: int) -> Column:
    """split_paragraph() on a column; null where a clause alone is longer than limit."""

    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str] | None:
            try:
                return None if t is None else split_paragraph(t, limit)
            except ValueError:
                return None

        return texts.map(one)

    return of(text)


def first_chapters(texts: DataFrame, id_: str, text: str, n: int) -> DataFrame:
    """(id, text): a raw text up to the line before its chapter n + 1, or all of it. Texts that can't be parsed into chapters have no row."""
    if n < 1:
        raise ValueError("at least one chapter")
    d = _parsed(texts, id_, text).where("wrong.error is null")
    end = F.get(F.filter("kept", lambda x: x["head"]), F.lit(n))["line"]
    cut = F.array_join(F.slice(X.split_lines(F.col("own")), F.lit(1), end - 1), "\n")
    return d.select("id", F.when(end.isNull(), F.col("own")).otherwise(cut).alias("text"))


#: Fixed pattern: a saved title that shows its chapter's number.
SAVED_TITLE = r"(?iU)^\s*(?:Chương|Chapter)\s*(\d+)(?:\s*[:：.\-]\s*|\s+)(.*)$"


def raw_of(chapters: DataFrame) -> DataFrame:
    """(book, id, raw) of saved chapters (book, id, title, body as HTML): a heading line of the chapter's number and title, then its lines.

    A heading of this chapter in the body (by its id, or before any prose by the number that the saved title shows) goes; the title it has counts if it comes before
    prose, and a sentence after it stays. A fold over a chapter's lines, JVM-side.
    """
    c = chapters.select("book", "id", F.coalesce("title", F.lit("")).alias("title"), F.split(H.text_udf("body"), "\n").alias("lines"))
    c = c.withColumn("printed", N.chapter_number(F.regexp_extract("title", SAVED_TITLE, 1)))
    c = c.withColumn("title", F.when(F.col("printed") == F.col("id"), X.strip(F.regexp_extract("title", SAVED_TITLE, 2))).otherwise(F.col("title")))
    state = lambda title, prose, out: F.struct(title.alias("title"), prose.alias("prose"), out.alias("out"))

    def step(s: Column, line: Column) -> Column:
        x = X.strip(line)
        number, rest = N.chapter_number(F.regexp_extract(x, CHAPTER_HEADING, 1)), X.strip(F.regexp_extract(x, CHAPTER_HEADING, 2))
        by_title = ~s["prose"] & F.col("printed").isNotNull() & (number == F.col("printed"))
        own = F.coalesce(x.rlike(CHAPTER_HEADING) & ~rest.rlike(REFERENCE) & ((number == F.col("id")) | by_title), F.lit(False))
        after = F.regexp_extract(rest, r"(?sU)^(\S+)\s+(\S.*)$", 2)
        sentence = after.rlike("[，。！？；：,.!?;:]")
        named = F.when(sentence, F.regexp_extract(rest, r"(?U)^(\S+)", 1)).otherwise(rest)
        out = F.when(own & sentence, F.array_append(s["out"], X.strip(after))).when(own, s["out"]).otherwise(F.array_append(s["out"], line))
        return state(F.when(own & (named != "") & ~s["prose"], named).otherwise(s["title"]), s["prose"] | F.when(own, sentence).otherwise(X.has_text(line)), out)

    f = F.aggregate("lines", state(F.col("title"), F.lit(False), F.array().cast("array<string>")), step)
    c = c.select("book", "id", f.alias("f"))
    return c.select("book", "id", F.concat(F.lit("第"), F.col("id").cast("string"), F.lit("章 "), F.col("f.title"), F.lit("\n"), F.array_join("f.out", "\n")).alias("raw"))


#: Fixed value: characters that a chapter's raw text has fewer of.
RAW_LIMIT = 20_000_000


def checked_raws(chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw_of(chapters) that hold exactly their own chapter and are short enough (book, id, raw), and what is wrong with the others (book, id, problem): the problem that
    parse_chapters() finds first, `other chapters` (the text has another number's heading, or not one heading alone), or `too long`. In the text's own row."""
    d = _parsed(raw_of(chapters).select(F.struct("book", "id").alias("key"), "raw"), "key", "raw")
    numbers = F.transform(F.filter("kept", lambda x: x["head"]), lambda x: x["n"])
    own = F.coalesce((F.size(numbers) == 1) & (numbers[0] == F.col("id.id")), F.lit(False))
    d = d.select("id.book", "id.id", F.col("own").alias("raw"), F.when(F.length("own") >= RAW_LIMIT, "too long").when(F.col("wrong.error").isNotNull(), F.col("wrong.error")).when(~own, "other chapters").alias("problem"))
    d = d.select("book", "id", "raw", F.explode_outer(F.array("problem")).alias("problem"))
    return d.where("problem is null").drop("problem"), d.where("problem is not null").drop("raw")


def by_note_policy(paragraphs_: DataFrame, raw: str, policy: str) -> tuple[DataFrame, DataFrame]:
    """(paragraphs for readers, notes kept apart): policy preserve keeps notes in place, remove drops them, separate keeps them apart."""
    if policy not in ("preserve", "remove", "separate"):
        raise ValueError("policy is preserve, remove or separate")
    note = F.coalesce(X.is_note(F.col(raw)), F.lit(False))
    return paragraphs_ if policy == "preserve" else paragraphs_.where(~note), paragraphs_.where(note if policy == "separate" else F.lit(False))


def groups_of(paragraphs_: DataFrame, keys: list[str], order: str, text: str, chars: int = 9000, tokens: int = 12_000, most: int = 40) -> DataFrame:
    """paragraphs with group: one for a whole chapter that fits, else next-fit by characters, estimated tokens and number.

    The state is a fold over a chapter's ordered sizes (never its texts), JVM-side.
    """
    s = paragraphs_.select(*keys, order, F.length(text).alias("c_"), X.estimated_tokens(F.col(text)).alias("k_"))
    a = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "c_", "k_"))).alias("s"))
    zero = F.struct(F.lit(0).alias("g"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("k"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["c"] + x["c_"] > chars) | (acc["k"] + x["k_"] > tokens) | (acc["n"] >= most))
        g = acc["g"] + full.cast("int")
        keep = lambda f, v: F.when(full, v.cast("long")).otherwise(acc[f] + v)
        return F.struct(g.alias("g"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), keep("c", x["c_"]).alias("c"), keep("k", x["k_"]).alias("k"), F.concat(acc["out"], F.array(g)).alias("out"))

    total = lambda f: F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + x[f])
    whole = (total("c_") <= chars) & (total("k_") <= tokens)
    g = F.when(whole, F.transform("s", lambda x: F.lit(0))).otherwise(F.aggregate("s", zero, step)["out"])
    found = a.select(*keys, F.explode(F.arrays_zip(F.transform("s", lambda x: x[order]).alias(order), g.alias("group"))).alias("z")).select(*keys, f"z.{order}", "z.group")
    return paragraphs_.join(found, [*keys, order])
