"""Language ID by hierarchical discrimination: family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import text_batches

#: Families of languages by ISO 639-1 code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt ug uz",
    "indo_aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms su tl",
    "sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Bits of the hashed feature space, and code points handled at a time (bounds memory, whatever a text's length).
BITS, SEGMENT = 14, 1 << 19
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: is it a letter (category L*)?"""
    if not _letters:
        table = np.zeros(0x110000, bool)
        for lo in (*range(0, 0x33480, 0x1000), 0xF000):
            table[lo : lo + 0x1000] = [unicodedata.category(chr(c))[0] == "L" for c in range(lo, lo + 0x1000)]
        _letters.append(table)
    return _letters[0]


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed features of a whole text, by segments: one to three letters or spaces in a row, in lower case, where whatever isn't a
    letter counts as one space. Nothing if there is no letter."""
    table, carry = letters(), np.zeros(1, np.uint32)
    for at in range(0, len(text or ""), SEGMENT):
        codes = np.frombuffer(text[at : at + SEGMENT].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(table[codes], codes, np.uint32(0))
        codes = np.concatenate((carry, codes, np.zeros(1 if at + SEGMENT >= len(text) else 0, np.uint32)))
        codes = codes[np.concatenate(([True], (codes[1:] | codes[:-1]) != 0))]
        if len(codes) > 2 and codes.any():
            a, b, c = codes[:-2], codes[1:-1], codes[2:]
            two = a * np.uint32(2654435761) + b * np.uint32(2246822519)
            three = two ^ (c * np.uint32(3266489917))
            shift = np.uint32(32 - BITS)
            for h in (b * np.uint32(668265263), two * np.uint32(374761393), three * np.uint32(2654435769)):
                yield (h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> shift
        carry = codes[-2:]


def counts(text: str | None) -> np.ndarray | None:
    total = None
    for h in grams(text):
        one = np.bincount(h, minlength=1 << BITS)
        total = one if total is None else total + one
    return total


def unit(count: np.ndarray) -> np.ndarray:
    root = np.sqrt(count.astype(np.float32))
    return root / np.float32(np.sqrt(root @ root))


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 8.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last: bias) of a linear L2-loss SVM by dual coordinate descent; rows are unit vectors as (indexes, values)."""
    w, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            g = y[i] * (w[at] @ x + w[-1]) - 1 + alpha[i] / (2 * c)
            new = max(0.0, alpha[i] - g / (2.0 + 1 / (2 * c)))
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                w[-1] += step
                alpha[i] = new
    return w


@dataclass
class Model:
    """families: names; members: their languages; weights: a column for each pair (of families, then of languages in each)."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_pairs: list[tuple[str, str]] = field(default_factory=list)
    pairs: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    weights: np.ndarray | None = None

    def choose(self, labels: list[str], pairs: list[tuple[str, str]], margins: np.ndarray) -> tuple[str, float]:
        """Most duels won (a tie: the larger sum of margins, then the first); the sure one's least margin as a probability."""
        if len(labels) == 1:
            return labels[0], 1.0
        won, total, least = dict.fromkeys(labels, 0), dict.fromkeys(labels, 0.0), dict.fromkeys(labels, np.inf)
        for (a, b), m in zip(pairs, margins, strict=True):
            won[a if m >= 0 else b] += 1
            for k, s in ((a, m), (b, -m)):
                total[k] += s
                least[k] = min(least[k], s)
        best = max(labels, key=lambda k: (won[k], total[k]))
        return best, float(1 / (1 + np.exp(-4 * np.clip(least[best], -20, 20))))

    def predict(self, text: str | None) -> tuple[str, float]:
        count = counts(text)
        if count is None or not self.families:
            return UNDETERMINED, 0.0
        x = unit(count)
        at = np.flatnonzero(x)
        margins = x[at] @ self.weights[at] + self.weights[-1] if self.weights.shape[1] else np.empty(0)
        n = len(self.family_pairs)
        family, sure = self.choose(self.families, self.family_pairs, margins[:n])
        for name in self.families:
            if name == family:
                lang, inner = self.choose(self.members[name], self.pairs[name], margins[n : n + len(self.pairs[name])])
                return lang, sure * inner
            n += len(self.pairs[name])
        raise AssertionError(family)


def fit(langs: list[str], rows: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """rows: unit vectors as (indexes, values)."""
    model = Model()
    for lang in sorted(set(langs)):
        model.members.setdefault(FAMILY_OF.get(lang, f"own:{lang}"), []).append(lang)
    model.families = sorted(model.members)
    family = np.array([FAMILY_OF.get(x, f"own:{x}") for x in langs])
    lang = np.array(langs)

    def duel(label: np.ndarray, a: str, b: str) -> np.ndarray:
        take = np.flatnonzero((label == a) | (label == b))
        return svm([rows[i] for i in take], np.where(label[take] == a, 1.0, -1.0))

    model.family_pairs = list(combinations(model.families, 2))
    columns = [duel(family, a, b) for a, b in model.family_pairs]
    for name in model.families:
        model.pairs[name] = list(combinations(model.members[name], 2))
        columns += [duel(lang, a, b) for a, b in model.pairs[name]]
    model.weights = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros(((1 << BITS) + 1, 0), np.float32)
    return model


def held_out(doc_id):
    """Whether a document isn't learnt from: CRC-32 of its id as text is divisible by 5 (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(documents: DataFrame, per_lang: int = 1000, most_rows: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a sample of at most per_lang labelled documents of each language that aren't held out, chosen by a hash of id and text; of so many labels that they
    were more than most_rows together, on an equal part of these for each, at least one. Whole texts become sparse feature counts on the executors, all of which count.

    The sample is bounded before it leaves them: rows with one id and text count once, so a row that is there many times is one row, and of the rest those with the least hashes
    are kept by label, which Spark does before the shuffle. The driver gets 1 << BITS features of 6 bytes for each row at most.

    Every label is learnt, however rare. Null or letterless texts and null labels teach nothing. Texts of any length are read whole, by segments. Other columns aren't
    read. Empty table: a model that knows nothing.
    """
    text_batches(documents.sparkSession)
    d = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    d = d.where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}") & ~held_out(F.col("i")))
    d = d.withColumn("k", F.xxhash64("i", "t"))
    langs = d.agg(F.count_distinct("l")).first()[0]
    if not langs:
        return Model()
    rows = max(1, min(per_lang, most_rows // langs))
    once = d.select("l", "k").distinct()
    order = Window.partitionBy("l").orderBy("k")
    taken = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows).select("l", "k")
    # At most most_rows pairs of a label and a hash.
    d = d.join(F.broadcast(taken), ["l", "k"], "left_semi")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            out = []
            for lang, k, text in zip(batch["l"], batch["k"], batch["t"], strict=True):
                if (lang, k) in seen:
                    continue
                seen.add((lang, k))
                count = counts(text)
                if count is not None:
                    x = unit(count)
                    at = np.flatnonzero(x)
                    out.append((lang, k, at.astype("<u2").tobytes(), x[at].tobytes()))
            yield pd.DataFrame(out, columns=["l", "k", "at", "x"])

    found = d.select("l", "k", "t").mapInPandas(features, "l string, k long, at binary, x binary").groupBy("l", "k").agg(F.first("at").alias("at"), F.first("x").alias("x")).collect()
    found.sort(key=lambda r: (r["l"], r["k"]))
    return fit([r["l"] for r in found], [(np.frombuffer(bytes(r["at"]), "<u2").astype(np.int64), np.frombuffer(bytes(r["x"]), np.float32).astype(float)) for r in found])


def identify(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """documents with columns lang_pred and score (0 to 1), from each whole text alone; nothing is shuffled.

    Null text, or one without a letter: `und`, score 0; so is every text if the model has learnt nothing. Texts of any length are read whole, by segments;
    repeated rows get the same answer each. Empty table: no rows. Columns of documents named like one of the two are replaced, all others stay as they are. The model is
    a fixed number of weights for each pair of languages in a family and of families.
    """
    text_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    own = [c for c in documents.columns if c.lower() not in ("lang_pred", "score")]
    found = documents.select(F.struct("*").alias("row"), predict(F.col(text_col)).alias("found"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in own], F.col("found.lang_pred").alias("lang_pred"), F.col("found.score").alias("score"))
