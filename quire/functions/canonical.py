"""JSON in one canonical form, and digests of it: what a value's bytes are doesn't depend on the order of its fields, on the engine or on the platform.

Keys in order of code points, `, ` and `: ` between, nothing but quotes, backslashes and control characters escaped, null fields as null. The text is put together by column
expressions that follow the value's schema, so that any nesting of structs, arrays and maps stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What control characters, quotes and backslashes are in JSON.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
ESCAPES |= {chr(k): f"\\u{k:04x}" for k in range(32) if chr(k) not in ESCAPES}


def _quoted(c: Column) -> Column:
    escaped = c
    for mark, text in ESCAPES.items():
        escaped = F.replace(escaped, F.lit(mark), F.lit(text))
    return F.concat(F.lit('"'), F.when(c.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(c), F.lit('"'))


def _number(c: Column) -> Column:
    """A double by its shortest digits: as they are from 1e-4 to below 1e16, else with an exponent of two digits at least."""
    c = c.cast("double")
    s = F.abs(c).cast("string")
    mantissa = F.substring_index(s, "E", 1)
    power = F.coalesce(F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    every = F.concat(whole, part)
    digits = F.regexp_replace(F.regexp_replace(every, "^0+", ""), "0+$", "")
    point = F.length(whole) + power - (F.length(every) - F.length(F.regexp_replace(every, "^0+", "")))
    power, long = point - 1, F.length(digits)
    cut = lambda at: F.concat(F.substring(digits, F.lit(1), at), F.lit("."), F.substring(digits, at + 1, long))
    fixed = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)).when(long <= point, F.concat(digits, F.repeat(F.lit("0"), point - long), F.lit(".0"))).otherwise(cut(point))
    sign = F.when(power < 0, "-").otherwise("+")
    first = F.when(long > 1, cut(F.lit(1))).otherwise(digits)
    scientific = F.concat(first, F.lit("e"), sign, F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    text = F.when(digits == "", "0.0").when(power.between(-4, 15), fixed).otherwise(scientific)
    out = F.concat(F.when((c < 0) | s.startswith("-") | (c.cast("string") == "-0.0"), "-").otherwise(""), text)
    return F.when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.when(c > 0, "Infinity").otherwise("-Infinity")).otherwise(out)


def json_text(c: Column, kind: T.DataType) -> Column:
    """A value's canonical JSON; kind is its type. Map keys are texts; binaries are base64, and what JSON has no form for (dates, decimals) is its text."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(_quoted(F.lit(f.name)), F.lit(": "), json_text(c.getField(f.name), f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_text(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.concat(_quoted(e["key"].cast("string")), F.lit(": "), json_text(e["value"], kind.valueType))
        ordered = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        out = F.concat(F.lit("{"), F.array_join(F.transform(ordered, pair), ", "), F.lit("}"))
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        out = c.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = _number(c)
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        out = _quoted(F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string"))
    return F.when(c.isNull(), F.lit("null")).otherwise(out)


def digest(c: Column, kind: T.DataType) -> Column:
    """SHA-256 of a value's canonical JSON, lower-case hex."""
    return F.sha2(json_text(c, kind), 256)


def with_digest(rows: DataFrame, name: str, **fields: Column | str) -> DataFrame:
    """rows with a column of digests of an object for each: its fields are these columns, whatever order they are named in."""
    made = rows.select("*", F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in fields.items()]).alias("object_"))
    return made.select(*rows.columns, digest(F.col("object_"), made.schema["object_"].dataType).alias(name))


def group_hashes(groups: DataFrame, policy: str, schema: str, budget: int | None = None) -> DataFrame:
    """groups (chapter, title, first, raw array<struct<id, text>>, dictionary, previous, lookahead) with group_hash: what a translated group depends on. A chapter's title
    counts in its first group only; a unit is a pair of its id and text."""
    units = F.transform("raw", lambda u: F.array(u["id"], u["text"]))
    title = F.when(F.col("first"), F.coalesce("title", F.lit(""))).otherwise(F.lit(""))
    return with_digest(groups, "group_hash", chapter="chapter", title=title, raw=units, dictionary="dictionary", previous_translation="previous", next_source="lookahead", policy=F.lit(policy), schema=F.lit(schema), thinking_budget=F.lit(budget).cast("int"))


def review_hashes(reviews: DataFrame) -> DataFrame:
    """reviews (raw, text, dictionary: its relevant entries, findings) with review_hash and dictionary_hash: a review holds while both are what they were."""
    out = with_digest(reviews, "review_hash", raw="raw", text="text", dictionary="dictionary", findings="findings")
    return out.select("*", digest(F.col("dictionary"), reviews.schema["dictionary"].dataType).alias("dictionary_hash"))
