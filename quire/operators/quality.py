"""Rules on pairs of source and translated paragraphs: structure, length, numbers, terms, punctuation. Findings are rows (chapter, id, kind, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import text as X
from quire.functions import unicode as U

#: Fixed patterns and values of the rules.
WRAPPER = r"(?i)^\s*(?:```|#\s|<(?:translation|chapter)>|\{\s*\"(?:title|segments)\")"
TITLE_WRAPPER = r"(?iU)^\s*(?:Chương|Chapter)\s*\d+\s*[:：.\-]?\s*"
SOURCE_END = r"[。！？!?…」』”）】]$"
TARGET_END = r"[.!?…:;”’\"')\]]$"
FUNCTION_END = (
    r"(?iU)\b(?:và|hoặc|nhưng|mà|vì|bởi|để|với|của|rằng|thì|là|đã|đang|sẽ|không|chẳng|chưa|mới|vừa|bị|được|từ|đến|trong|ngoài|trên|dưới|như|nếu|khi|"
    r"bắt đầu|không phải)\s*$"
)
CLAUSES = "[，,；;：:。.!！？?]"
SOFT = ["suspicious_length_ratio", "suspicious_truncation", "suspicious_numeric_mismatch"]
ORDER = [
    "duplicate_id", "missing_id", "unexpected_id", "out_of_order_id", "empty_segment", "empty_title", "suspicious_length_ratio", "malformed_title_wrapper",
    "malformed_wrapper", "chinese_residue", "raw_copied", "duplicate_output", "suspicious_numeric_mismatch", "numeric_mismatch", "locked_term_missing",
    "obvious_truncation", "suspicious_truncation",
]


def structural(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected (chapter, pos, id), actual (chapter, pos, id, text): ids that are repeated, missing, unexpected or out of order, and empty texts."""
    a = actual.groupBy("chapter", "id").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    e = expected.select("chapter", "id", F.col("pos").alias("want"))
    found = lambda d, kind: d.select("chapter", "id", F.lit(kind).alias("kind"))
    out = found(a.where("n > 1"), "duplicate_id")
    out = out.unionByName(found(e.join(a, ["chapter", "id"], "left_anti"), "missing_id"))
    out = out.unionByName(found(a.join(e, ["chapter", "id"], "left_anti"), "unexpected_id"))
    order = actual.select("chapter", F.row_number().over(Window.partitionBy("chapter").orderBy("pos")).alias("r"), "id")
    want = expected.select("chapter", F.row_number().over(Window.partitionBy("chapter").orderBy("pos")).alias("r"), F.col("id").alias("w"))
    moved = order.join(want, ["chapter", "r"], "full").where("not (id <=> w)").select("chapter").distinct()
    moved = moved.join(out.where("kind in ('missing_id', 'unexpected_id')"), "chapter", "left_anti")
    out = out.unionByName(moved.select("chapter", F.lit(None).cast("string").alias("id"), F.lit("out_of_order_id").alias("kind")))
    return out.unionByName(found(actual.where(~F.coalesce(X.has_text(F.col("text")), F.lit(False))), "empty_segment"))


def truncation_signals(raw: Column, text: Column) -> Column:
    """Names of the signs that a translation was cut off."""
    r, t = F.length(raw), F.length(text)
    clauses = lambda c: F.regexp_count(c, F.lit(CLAUSES)) + 1
    signs = {
        "very_low_length_ratio": (r >= 24) & (t / F.greatest(r, F.lit(1)) < 0.34),
        "clause_loss": (r >= 45) & (clauses(text) < F.greatest(F.lit(2.0), clauses(raw) * F.lit(0.4))),
        "unmatched_punctuation": X.balanced(raw) & ~X.balanced(text),
        "missing_terminal_punctuation": F.regexp_replace(raw, r"(?U)\s+$", "").rlike(SOURCE_END) & ~F.regexp_replace(text, r"(?U)\s+$", "").rlike(TARGET_END),
        "function_word_ending": F.regexp_replace(text, r"[ \t\n,;:]+$", "").rlike(FUNCTION_END),
    }
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in signs.items()]))
    return F.when((raw == "") | (text == ""), F.array().cast("array<string>")).otherwise(names)


def numeric_difference(raw: Column, text: Column) -> Column:
    """Struct of missing and extra numbers (maps of keys to counts) and ambiguous; null if the numbers agree.

    Number words after some nouns stand for what is missing, and Han numerals before what they count for what is extra.
    """
    s, t = N.strip_index_marks(raw), N.strip_index_marks(text)
    source = N.multiset(N.number_keys(s, True))
    target = N.multiset(N.number_keys(t, False, N.source_literals(s)))
    word = F.create_map(*[F.lit(x) for pair in N.NUMBER_WORDS.items() for x in pair])
    words = N.multiset(F.transform(F.regexp_extract_all(t, F.lit(N.WORD_CONTEXT), F.lit(1)), lambda w: word[F.lower(w)]))
    counted = F.transform(F.regexp_extract_all(s, F.lit(N.COUNTED), F.lit(1)), N.han_key)
    missing = N.minus(N.minus(source, target), words)
    extra = N.minus(N.minus(target, source), N.multiset(F.array_compact(counted)))
    ambiguous = F.exists(counted, lambda x: x.isNull())
    return F.when((F.size(missing) > 0) | (F.size(extra) > 0), F.struct(missing.alias("missing"), extra.alias("extra"), ambiguous.alias("ambiguous")))


def _has_target(text: Column, target: Column) -> Column:
    return F.contains(U.compose_fold(text), U.compose_fold(target))


def segment_findings(pairs: DataFrame, matches: DataFrame | None = None, truncation: bool = True) -> DataFrame:
    """pairs (chapter, id, raw, text) -> findings of single pairs. matches (chapter, id, surface, target): locked terms in the sources."""
    p = pairs.withColumn("text", X.strip(F.coalesce("text", F.lit(""))))
    empty = p.where("text = ''").select("chapter", "id", F.lit("empty_segment").alias("kind"), F.lit(None).cast("string").alias("detail"))
    p = p.where("text <> ''").withColumns({"signs": truncation_signals(F.col("raw"), F.col("text")), "numbers": numeric_difference(F.col("raw"), F.col("text"))})
    has = lambda s: F.array_contains("signs", s)
    obvious = has("function_word_ending") | ((F.length("raw") >= 20) & has("missing_terminal_punctuation"))
    doubtful = has("very_low_length_ratio") | has("unmatched_punctuation") | (F.size("signs") >= 2)
    one = lambda cond, kind, detail=F.lit(None).cast("string"): F.when(cond, F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), detail.alias("detail")))
    rules = [
        one(F.col("text").rlike(WRAPPER), "malformed_wrapper"),
        one(F.col("text").rlike("[㐀-鿿]"), "chinese_residue"),
        one((F.length("raw") > 80) & F.contains("text", F.col("raw")), "raw_copied"),
        one(F.col("numbers").isNotNull(), F.when(F.col("numbers.ambiguous"), "suspicious_numeric_mismatch").otherwise("numeric_mismatch"), F.to_json("numbers")),
    ]
    if truncation:
        rules.append(one(obvious | doubtful, F.when(obvious, "obvious_truncation").otherwise("suspicious_truncation"), F.array_join("signs", ",")))
    out = empty.unionByName(p.select("chapter", "id", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("chapter", "id", "f.kind", "f.detail"))
    if matches is not None:
        m = matches.join(p.select("chapter", "id", "text"), ["chapter", "id"]).where(~_has_target(F.col("text"), F.col("target")))
        out = out.unionByName(m.select("chapter", "id", F.lit("locked_term_missing").alias("kind"), F.col("surface").alias("detail")))
    return out


def length_findings(pairs: DataFrame, least: float = 0.30, baseline: DataFrame | None = None, paragraph_baseline: DataFrame | None = None) -> DataFrame:
    """Chapters, and with a baseline paragraphs, that are too short. baseline, paragraph_baseline (ratio): what earlier ones had; they count from 5 and 20
    on, by their upper median."""
    middle = F.expr("percentile_disc(0.500000000001) WITHIN GROUP (ORDER BY ratio)")
    p = pairs.withColumn("ratio", F.length("text") / F.greatest(F.length("raw"), F.lit(1)))
    c = p.groupBy("chapter").agg((F.sum(F.length("text")) / F.greatest(F.sum(F.length("raw")), F.lit(1))).alias("chapter_ratio"), F.max((F.col("ratio") < 0.40).cast("int")).alias("some"))
    low = F.col("chapter_ratio") < least
    if baseline is not None:
        c = c.crossJoin(F.broadcast(baseline.agg(F.count("*").alias("n"), middle.alias("m"))))
        low = low | ((F.col("n") >= 5) & (F.col("chapter_ratio") < F.col("m") * 0.45))
    c = c.where(low).select("chapter", "chapter_ratio", "some")
    out = p.join(c, "chapter").where("ratio < 0.40 or some = 0").select("chapter", "id", F.lit("suspicious_length_ratio").alias("kind"), F.bround("chapter_ratio", 3).cast("string").alias("detail"))
    if paragraph_baseline is not None:
        b = paragraph_baseline.agg(F.count("*").alias("n"), middle.alias("m"))
        q = p.crossJoin(F.broadcast(b)).where((F.col("n") >= 20) & (F.length("raw") >= 40) & (F.col("ratio") < F.col("m") * 0.35))
        out = out.unionByName(q.select("chapter", "id", F.lit("suspicious_length_ratio").alias("kind"), F.bround("ratio", 3).cast("string").alias("detail")))
    return out


def duplicate_outputs(pairs: DataFrame) -> DataFrame:
    """Translations over 30 characters that a chapter has again for another source than where it had them first. pairs has pos."""
    p = pairs.withColumn("out", X.strip(F.col("text")))
    w = Window.partitionBy("chapter", "out").orderBy("pos")
    p = p.withColumn("first_raw", F.first("raw").over(w)).where((F.length("out") > 30) & (F.col("first_raw") != F.col("raw")))
    return p.select("chapter", "id", F.lit("duplicate_output").alias("kind"), F.lit(None).cast("string").alias("detail"))


def title_findings(titles: DataFrame) -> DataFrame:
    """titles (chapter, id, raw, text): empty ones, those with a chapter's number, and the findings of single pairs but truncation."""
    t = titles.where("raw <> ''")
    none = F.lit(None).cast("string").alias("detail")
    empty = t.where(~F.coalesce(X.has_text(F.col("text")), F.lit(False))).select("chapter", "id", F.lit("empty_title").alias("kind"), none)
    wrapped = t.where(F.col("text").rlike(TITLE_WRAPPER)).select("chapter", "id", F.lit("malformed_title_wrapper").alias("kind"), none)
    return empty.unionByName(wrapped).unionByName(segment_findings(t, truncation=False))


def prioritized(findings: DataFrame) -> DataFrame:
    """Each kind once for an id, with its rank in the rules' order."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    f = findings.withColumn("rank", rank)
    return f.withColumn("r_", F.row_number().over(Window.partitionBy("chapter", "id", "kind").orderBy("rank", F.col("detail").asc_nulls_first()))).where("r_ = 1").drop("r_")


def local_findings(expected: DataFrame, actual: DataFrame, titles: DataFrame, matches: DataFrame | None = None, **baselines: DataFrame | None) -> DataFrame:
    """All rules: a chapter with a structural finding has only those. expected (chapter, pos, id, raw), actual (chapter, pos, id, text)."""
    s = structural(expected, actual).withColumn("detail", F.lit(None).cast("string"))
    sound = lambda d: d.join(s.select("chapter").distinct(), "chapter", "left_anti")
    pairs = sound(expected).join(actual.select("chapter", "id", "text"), ["chapter", "id"])
    out = s.unionByName(length_findings(pairs, **baselines)).unionByName(duplicate_outputs(pairs)).unionByName(segment_findings(pairs, matches)).unionByName(title_findings(sound(titles)))
    return prioritized(out)


def repair_findings(repairs: DataFrame) -> DataFrame:
    """repairs (chapter, id, raw, original, text): what keeps a repair from taking the original's place, besides the findings of the pair."""
    r = repairs.withColumns({"original": X.strip(F.col("original")), "text": X.strip(F.col("text"))})
    lost = (F.length("original") >= 20) & (F.length("text") < F.greatest(F.lit(12), F.floor(F.length("original") * F.lit(0.55))))
    kinds = {
        "repair_content_loss": lost,
        "repair_unbalanced_punctuation": X.balanced(F.col("original")) & ~X.balanced(F.col("text")),
        "repair_unterminated": F.col("original").rlike(TARGET_END) & ~F.col("text").rlike(TARGET_END),
    }
    own = r.select("chapter", "id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).alias("kind"), F.lit(None).cast("string").alias("detail"))
    title = F.col("id").rlike("^C.*_TITLE$")
    return own.unionByName(segment_findings(r.where(~title))).unionByName(segment_findings(r.where(title), truncation=False))


def split_soft(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suspicions for a reader to judge, certain defects)."""
    return findings.where(F.col("kind").isin(SOFT)), findings.where(~F.col("kind").isin(SOFT))


def source_quality(paragraphs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, kind): sources with asterisks for words, and those whose punctuation doesn't balance."""
    kinds = F.array_compact(F.array(F.when(X.censored(F.col(text)), "asterisk_censorship"), F.when(~X.balanced(F.col(text)), "unbalanced_source_punctuation")))
    return paragraphs.select(*keys, F.explode(kinds).alias("kind"))


def chapter_metrics(expected: DataFrame, actual: DataFrame, findings: DataFrame, stats: DataFrame) -> DataFrame:
    """One row for each chapter: sizes, findings by kind, requests by operation (stats: chapter, operation, logical_calls, technical_retries, fallbacks)."""
    a = expected.groupBy("chapter").agg(F.sum(F.length("raw")).alias("raw_chars"), F.count("*").alias("raw_paragraphs"))
    b = actual.groupBy("chapter").agg(F.sum(F.length("text")).alias("translation_chars"), F.count("*").alias("translated_paragraphs"))
    f = findings.groupBy("chapter").agg(
        F.count_if(F.col("kind") == "chinese_residue").alias("cjk_findings"),
        F.count_if(F.col("kind").isin("numeric_mismatch", "suspicious_numeric_mismatch")).alias("numeric_findings"),
        F.count_if(F.col("kind") == "locked_term_missing").alias("terminology_findings"),
    )
    calls = lambda op: F.sum(F.when(F.col("operation") == op, F.col("logical_calls"))).alias(f"{op}_requests")
    s = stats.groupBy("chapter").agg(calls("translation"), calls("qa"), calls("repair"), F.sum("technical_retries").alias("technical_retries"), F.sum("fallbacks").alias("fallbacks"))
    out = a.join(b, "chapter", "left").join(f, "chapter", "left").join(s, "chapter", "left")
    return out.na.fill(0)


def apply_reviews(findings: DataFrame, reviews: DataFrame, hashes: list[str]) -> DataFrame:
    """findings without those that a review of exactly this text, source and dictionary (by their hashes) has accepted."""
    ok = reviews.where("decision = 'accept'").select("chapter", "id", *hashes, F.explode("accepted_findings").alias("kind"))
    return findings.join(ok, ["chapter", "id", *hashes, "kind"], "left_anti")


def reassemble(fragments: DataFrame) -> DataFrame:
    """(chapter, id, text) of fragments (chapter, id like P0001_0002.F0001, text): a paragraph's fragments in order, joined by spaces."""
    g = fragments.groupBy("chapter", F.split_part("id", F.lit(".F"), F.lit(1)).alias("pid")).agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("f"))
    return g.select("chapter", F.col("pid").alias("id"), F.array_join(F.transform("f", lambda x: X.strip(x["text"])), " ").alias("text"))
