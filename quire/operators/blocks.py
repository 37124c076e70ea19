"""Cutting chapters into blocks of a bounded size at their best boundaries, the export text made of them, and its audit.

A chapter is one row, so the cutting (greedy, each block depending on the one before) is a kernel over rows in Arrow batches; nothing is shuffled. The
audit over many chapters is a plain aggregate.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

#: Sizes in characters, ranks and scores of boundaries, and marks.
TARGET, MAXIMUM, SLACK, SHORT_TAIL = 2600, 3000, 300, 200
RANKS = {"section": 5, "dialogue": 4, "paragraph": 4}
SCORES = {"section": 120, "dialogue": 140, "paragraph": 100}
ENDINGS = {"strong": 0, "medium": -10, "weak": -20, "none": -30}
INTRO, OPEN, SHORT, IN_WINDOW, SWEET, SWEET_SPOT, SWEET_HALF = -60, -1000, -30, 30, 20, 2800, 100
QUOTE_OPEN, QUOTE_CLOSE = "“‘「『", "”’」』"
BRACKET_OPEN, BRACKET_CLOSE = "《（(【〈", "》）)】〉"
STOPS = ("。！？…", "；", "，：、")
CLOSERS = "”’」』）》〉"
DATES = "年月日时分秒岁次"
SEPARATOR, FRONT_END = "-" * 60, "+" * 60
HEADING = re.compile(r"\s*第\s*(?:\d+|[零〇一二三四五六七八九十百千万两]+)\s*[章回节]")
_ENDING = {**dict.fromkeys(STOPS[0], "strong"), **dict.fromkeys(STOPS[1], "medium"), **dict.fromkeys(STOPS[2], "weak")}
SCHEMA = (
    "blocks array<array<string>>, sizes array<int>, kinds array<string>, oversized_splits int, oversized_segments int, oversized_headings int, "
    "forced_splits int, short_tails int, open_quote_cuts int"
)


def depth_after(text: str, openers: str, closers: str, depth: int = 0) -> int:
    """Open marks after a text; a closer without an opener counts for nothing."""
    for c in text:
        if c in openers:
            depth += 1
        elif depth and c in closers:
            depth -= 1
    return depth


def layout(text: str) -> tuple[list[str], set[int]]:
    """A text's lines that aren't blank, and those after which a blank line follows before the next."""
    lines: list[str] = []
    breaks: set[int] = set()
    blank = False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.strip():
            if blank and lines:
                breaks.add(len(lines) - 1)
            lines.append(line)
        blank = not line.strip()
    return lines, breaks


@dataclass
class Blocks:
    blocks: list[list[str]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    oversized_splits: int = 0
    oversized_segments: int = 0
    oversized_headings: int = 0
    forced_splits: int = 0
    short_tails: int = 0
    open_quote_cuts: int = 0


def _safe_places(text: str, quote: int, bracket: int, limit: int) -> list[bool]:
    """For each place up to limit: may a text be cut there? Not inside quotations, brackets, runs of dots, numbers, dates or Latin words."""
    ok = [False]
    token = [c.isascii() and c.isalnum() for c in text[: limit + 1]]
    for p in range(1, limit + 1):
        before, after = text[p - 1], text[p]
        quote = depth_after(before, QUOTE_OPEN, QUOTE_CLOSE, quote)
        bracket = depth_after(before, BRACKET_OPEN, BRACKET_CLOSE, bracket)
        number = before.isdigit() and (after.isdigit() or after in DATES)
        ok.append(not (quote or bracket or number or "…" in (before, after) or (token[p - 1] and token[p])))
    return ok


def split_long_line(line: str, maximum: int, quote: int = 0, bracket: int = 0) -> tuple[list[str], int]:
    """Segments of at most maximum characters, and how many cuts found no safe place.

    Of the strong stops the last safe one, else of the medium, else of the weak ones, else the last safe place, else maximum; marks that close
    stay with what they close.
    """
    out, forced = [], 0
    while len(line) > maximum:
        limit = min(maximum, len(line) - 1)
        cut = 0
        if limit >= 1:
            ok = _safe_places(line, quote, bracket, limit)
            for stops in STOPS:
                for p in range(limit, 0, -1):
                    if line[p - 1] in stops:
                        end = p
                        while end < limit and (line[end] == "…" or line[end] in CLOSERS):
                            end += 1
                        if ok[end]:
                            cut = end
                            break
                if cut:
                    break
            cut = cut or next((p for p in range(limit, 0, -1) if ok[p]), 0)
        if not cut:
            cut, forced = limit if limit >= 1 else len(line), forced + 1
        if not line[:cut].strip():
            cut, forced = maximum, forced + 1
            if not line[:cut].strip():
                break
        part = line[:cut].rstrip()
        out.append(part)
        quote = depth_after(part, QUOTE_OPEN, QUOTE_CLOSE, quote)
        bracket = depth_after(part, BRACKET_OPEN, BRACKET_CLOSE, bracket)
        line = line[cut:].lstrip()
    if line.strip():
        out.append(line.strip())
    return out, forced


def _ending(line: str) -> str:
    bare = line.rstrip().rstrip(CLOSERS)
    return _ENDING.get(bare[-1:], "none")


def cut_blocks(lines: list[str], breaks: set[int] | frozenset[int] = frozenset(), target: int = TARGET, maximum: int = MAXIMUM) -> Blocks:
    """Blocks of whole lines of at most maximum characters, each cut at the best boundary not far below target.

    What a boundary is worth but for its place in the block is found once, ahead: its rank, its score by the lines around it, the depth
    of open quotations, and whether little is left after it. A block then fills up with lines, and the best of its boundaries by rank,
    score, low depth and length ends it.
    """
    out, n = Blocks(), len(lines)
    total, quotes, brackets = [0], [0], [0]
    for line in lines:
        total.append(total[-1] + len(line))
        quotes.append(depth_after(line, QUOTE_OPEN, QUOTE_CLOSE, quotes[-1]))
        brackets.append(depth_after(line, BRACKET_OPEN, BRACKET_CLOSE, brackets[-1]))
    kind, worth, left = [""], [0], [total[-1]]
    for c in range(1, n + 1):
        before = lines[c - 1]
        closed = quotes[c] == 0 and any(q in before for q in QUOTE_CLOSE)
        kind.append("section" if c - 1 in breaks else "dialogue" if closed else "paragraph")
        left.append(total[-1] - total[c])
        intro = c < n and before.rstrip().endswith("：") and lines[c].lstrip()[:1] in set(QUOTE_OPEN) | {""}
        worth.append(SCORES[kind[c]] + ENDINGS[_ending(before)] + INTRO * intro + OPEN * (quotes[c] > 0) + OPEN * (brackets[c] > 0) + SHORT * (0 < left[c] < SHORT_TAIL))
    start = 0
    while start < n:
        end = start + 1
        while end < n and total[end + 1] - total[start] <= maximum:
            end += 1
        if total[end] - total[start] > maximum:  # a single line, too long
            if HEADING.match(lines[start]):
                out.blocks.append([lines[start]])
                out.sizes.append(len(lines[start]))
                out.oversized_headings += 1
            else:
                parts, forced = split_long_line(lines[start], maximum, quotes[start], brackets[start])
                out.blocks += [[p] for p in parts]
                out.sizes += map(len, parts)
                out.oversized_splits += 1
                out.oversized_segments += len(parts)
                out.forced_splits += forced
            start = end
            continue
        best = None
        for c in range(end, start, -1):
            size = total[c] - total[start]
            if c < end and size < max(0, target - SLACK):
                break
            bonus = 0
            if target <= size <= maximum:
                bonus = IN_WINDOW + SWEET * (abs(size - SWEET_SPOT) <= SWEET_HALF)
            value = (RANKS[kind[c]], worth[c] + bonus, -quotes[c])
            if best is None or value > best[0]:
                best = value, c
        cut = best[1]
        out.blocks.append(lines[start:cut])
        out.sizes.append(total[cut] - total[start])
        if cut < n:
            out.kinds.append(kind[cut])
            out.open_quote_cuts += quotes[cut] > 0
            out.short_tails += 0 < left[cut] < SHORT_TAIL
        start = cut
    return out


def chapter_blocks(text: Column, target: int = TARGET, maximum: int = MAXIMUM) -> Column:
    """Struct of the blocks of a chapter's plain text and their counters; null and blank texts have no blocks."""
    target = min(target, maximum)

    @F.pandas_udf(SCHEMA)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            b = cut_blocks(*layout(t or ""), target, maximum)
            rows.append((b.blocks, b.sizes, b.kinds, b.oversized_splits, b.oversized_segments, b.oversized_headings, b.forced_splits, b.short_tails, b.open_quote_cuts))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return of(text)


def block_audit(chapters: DataFrame, text: str, keys: list[str], target: int = TARGET, maximum: int = MAXIMUM) -> DataFrame:
    """One row for each group of keys: blocks made, their sizes, boundaries by kind, and what had to be forced."""
    b = chapters.select(*keys, chapter_blocks(F.col(text), target, maximum).alias("b")).select(*keys, "b.*")
    extra = F.greatest(F.col("oversized_segments") - 1, F.lit(0))
    of = lambda k: F.sum(F.size(F.filter("kinds", lambda x: x == k)))
    out = b.groupBy(*keys).agg(
        F.count("*").alias("chapters"),
        F.sum(F.size("blocks")).alias("blocks"),
        F.sum(F.greatest(F.size("blocks") - 1, F.lit(0))).alias("blank_boundaries"),
        F.coalesce(F.min(F.array_min("sizes")), F.lit(0)).alias("min_chars"),
        F.coalesce(F.max(F.array_max("sizes")), F.lit(0)).alias("max_chars"),
        F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("chars"),
        of("section").alias("at_section"),
        of("dialogue").alias("at_dialogue"),
        of("paragraph").alias("at_paragraph"),
        F.sum(extra).alias("at_oversized_split"),
        F.sum("oversized_splits").alias("oversized_splits"),
        F.sum("oversized_headings").alias("oversized_headings"),
        F.sum("forced_splits").alias("forced_splits"),
        F.sum("short_tails").alias("short_tails"),
        F.sum("open_quote_cuts").alias("open_quote_cuts"),
        F.sum((F.size("blocks") == 0).cast("int")).alias("empty_bodies"),
    )
    return out.withColumn("average_chars", F.coalesce(F.bround(F.col("chars") / F.nullif(F.col("blocks"), F.lit(0)), 1), F.lit(0.0)))


def heading_report(chapters: DataFrame, id_: str, text: str, keys: list[str], most: int = 50) -> DataFrame:
    """For each group: chapters without a native heading and with a repeated one, and the first ids of each (reports, at most `most`)."""
    lines = X.content_lines(F.col(text))
    headings = F.transform(F.filter(lines, X.native_heading), lambda x: F.regexp_replace(x, r"(?U)\s", ""))
    c = chapters.select(*keys, F.col(id_).alias("id"), lines.alias("lines"), headings.alias("headings")).where(F.size("lines") > 0)
    missing = ~X.native_heading(F.col("lines")[0])
    repeated = ~missing & (F.size("headings") > F.size(F.array_distinct("headings")))
    c = c.select(*keys, "id", missing.alias("missing"), repeated.alias("repeated"))
    counts = c.groupBy(*keys).agg(F.count_if("missing").alias("without_heading"), F.count_if("repeated").alias("repeated_heading"))
    kind = c.select(*keys, "id", F.explode(F.filter(F.array(F.when(F.col("missing"), "m"), F.when(F.col("repeated"), "r")), lambda x: x.isNotNull())).alias("kind"))
    # A row number that is kept up to a limit: Spark cuts every part of a group to it before the shuffle.
    first = kind.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("id"))).where(F.col("k") <= most)
    ids = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("id"))))
    listed = first.groupBy(*keys).agg(ids("m").alias("m_"), ids("r").alias("r_")).alias("l")
    same = functools.reduce(lambda x, y: x & y, [F.col(f"c.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys])
    none = F.array().cast(f"array<{c.schema['id'].dataType.simpleString()}>")
    return counts.alias("c").join(listed, same, "left").select(*[F.col(f"c.{k}") for k in keys], "without_heading", F.coalesce("m_", none).alias("without_heading_ids"), "repeated_heading", F.coalesce("r_", none).alias("repeated_heading_ids"))


def chapter_text(text: Column, id_: Column, number: bool = False, target: int = TARGET, maximum: int = MAXIMUM) -> Column:
    """A chapter as it is exported: a blank line, the separator, its blocks with a blank line between. number: with a line for its number, if
    its first line has none."""
    blocks = F.transform(chapter_blocks(text, target, maximum)["blocks"], lambda b: F.array_join(b, "\n"))
    body = F.array_join(blocks, "\n\n")
    head = F.concat(F.lit("\n" + SEPARATOR + "\n"), F.when(F.lit(number) & ~F.coalesce(X.heading_has_number(F.get(X.content_lines(text), F.lit(0))), F.lit(False)), F.concat(F.lit("Chương "), id_.cast("string"), F.lit("\n"))).otherwise(""))
    return F.regexp_replace(F.concat(head, body), r"\n+$", "")


def front_matter(title: Column, author: Column, synopsis: Column, url: Column, tags: Column, volumes: Column, chapters: Column) -> Column:
    """A book's header lines."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    lines = [
        empty(title),
        F.when(empty(author) != "", F.concat(F.lit("by "), author)).otherwise(""),
        F.lit(""),
        F.lit(SEPARATOR),
        F.lit(""),
        F.array_join(X.content_lines(empty(synopsis)), "\n"),
        F.lit(""),
        F.concat(F.lit("Source: "), empty(url)),
        F.concat(F.lit("Tags: "), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", ")),
        F.concat(F.lit("Volumes: "), volumes.cast("string")),
        F.concat(F.lit("Chapters: "), chapters.cast("string")),
        F.lit(""),
        F.lit(FRONT_END),
    ]
    return F.concat_ws("\n", *lines)


def export_problems(chapters: DataFrame, id_: str, text: str, written: str, target: int = TARGET, maximum: int = MAXIMUM) -> DataFrame:
    """Rows of chapters whose exported text breaks a rule: (id, problem). Rules: LF only, no line of white space alone, the content as it was and in
    order, no block above the maximum but a heading."""
    lines = X.content_lines(F.col(text))
    b = chapters.select(F.col(id_).alias("id"), lines.alias("source"), chapter_blocks(F.col(text), target, maximum).alias("b"), F.col(written).alias("w"))
    bare = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    body = F.array_join(F.filter(F.split("w", "\n", -1), lambda x: (x != "") & (x != SEPARATOR) & ~x.rlike(r"^Chương \d+$")), "")
    over = F.size(F.filter("b.sizes", lambda s: s > maximum)) > F.col("b.oversized_headings")
    problem = (
        F.when(F.contains("w", F.lit("\r")), "line ending")
        .when(F.exists(F.split("w", "\n", -1), lambda x: (x != "") & ~X.has_text(x)), "blank line")
        .when(bare(body) != bare(F.array_join(F.filter("source", lambda x: (x != SEPARATOR) & ~x.rlike(r"^Chương \d+$")), "")), "content")
        .when(over, "size")
    )
    return b.select("id", problem.alias("problem")).where("problem is not null")
