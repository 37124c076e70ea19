"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing, each over all that the one before kept.

What all stages do: null texts, empty and blank ones are rows like others until language ID drops them; texts of any length are taken whole; an empty table stays empty;
other columns of documents, whatever their names, go along untouched, as each stage carries the row as one value beside what it computes; none looks at lang, source
or doc_id but where it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import language_id, line_dedup, minhash, mixing, packing
from quire.llm.common import Workspace

#: SQL can't express the language model, the tokenizer or the packing; the stages are held against brute force in tests/llm.
ORACLE_SQL = None
#: A source holds many sites, so that a line of one kind of page is on a smaller share of it than of a web host.
SOURCE_RATIO, SOURCE_TEXTS = 0.05, 5
#: The score is a family's probability times that of a language in it; below this the two together are not sure.
LEAST_SCORE = 0.5


def _with(docs: DataFrame, row: str, **changed: Column) -> list[Column]:
    """docs' columns from a struct column of its rows, with some of them changed."""
    return [changed[c].cast(t).alias(c) if c in changed else F.col(row).getField(c).alias(c) for c, t in docs.dtypes]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents; those in which no language can be told go (no text, no letter in it, or a score below LEAST_SCORE), and a null lang becomes
    the language told. Without a usable label nothing is learnt, and texts with a letter stay as they are. Repeated rows share a fate."""
    model = language_id.train(docs)
    if model.predict("a")[0] == language_id.UNDETERMINED:  # of a text with a letter: only if nothing was learnt
        return docs.where(F.col("text").rlike(r"\p{L}"))
    out = language_id.identify(docs.select(F.struct("*").alias("row"), "text"), model)
    sure = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return out.where(sure).select(*_with(docs, "row", lang=F.coalesce("row.lang", "lang_pred")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in more than SOURCE_RATIO of a source's distinct texts, and in SOURCE_TEXTS at least, go; the documents stay, with what is left of their text and its
    length. A null source is a source of its own. Copies of a text count once, so they don't make its own lines frequent."""
    rows = docs.select(F.struct("*").alias("own"), F.col("source"), F.col("text"))
    out = line_dedup.drop_boilerplate(rows, F.col("source"), F.col("text"), SOURCE_RATIO, SOURCE_TEXTS, distinct=True)
    return out.select(*_with(docs, "own", text=F.col("lines"), n_chars=F.coalesce(F.length("lines"), F.lit(0))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays; texts without a word stay all. Of rows with the same id and text one stays, the least by
    its JSON, so reruns keep the same. A null id is smaller than none."""
    found = Workspace(spark).write(minhash.near_duplicates(docs).where("kept").select("doc_id", "text_hash"), "kept")
    repeated = not found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("i"), F.xxhash64("text", F.length("text")).alias("th")).alias("d")
    out = row.join(found.alias("f"), F.col("i").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("text_hash")), "left_semi")
    if repeated:
        out = out.groupBy("i", "th").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, by source (a null one is a source of its own, the last) and a hash of the id; rows with one id share a fate, and a text
    without words is taken with none."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; each row is packed, repeated ones and those with null ids too, and a text without tokens as its end mark."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else space.write(out, f"stage{k}")
    return docs
