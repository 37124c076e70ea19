import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def make(seed=1, n=40, long=3000):
    """Documents with nulls, empty, blank and very long texts, exact and near copies, and a shared passage."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 30))
    base = words(rng, 60)
    rows = []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            text = " ".join(base)
        elif kind == 1:
            copy = list(base)
            copy[rng.randrange(60)] = "changed"
            text = " ".join(copy)
        elif kind == 2:
            text = " ".join(words(rng, 20)) + "\n" + passage + "\t" + " ".join(words(rng, 10))
        elif kind == 3:
            text = " ".join(words(rng, rng.randrange(1, 8)))
        else:
            text = ". ".join(" ".join(words(rng, rng.randrange(3, 30))) for _ in range(4))
        rows.append((i, text, ["en", "de", None][i % 3], ["a", "b", "B", None][i % 4 if i % 2 else 0], len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \t\n\r\f\v ", "en", "a", 7), (n + 3, "12 34", "en", "c", 5)]
    rows += [(n + 4, " ".join(words(rng, long)) + " é x y 日本", "de", "a", 1), (None, " ".join(base), "en", "a", 1), (None, "alone without an id", "en", "a", 1)]
    rows.append(rows[2])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clash(documents):
    """The documents with more columns, named like those that the operators use."""
    from pyspark.sql import functions as F

    names = "i t th h b n size tokens crc row host x lines kept source_ below times shard slot score lang_pred cid k key words left".split()
    return documents.withColumns({c: F.lit("clash") for c in names})
