"""What the training-data operators share: written intermediates and vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
import shutil

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import scratch
from quire.scratch import text_batches  # noqa: F401

#: A word is a longest run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    """Number of words of a text column, null: none; JVM-side."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


class Workspace:
    """Folder for intermediates that the executors share (scratch.shared_folder).

    A written table cuts lineage: when an executor is lost, what it held is read again rather than recomputed. What results are read from goes when the
    program ends; an operator drops earlier what nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = scratch.shared_folder(spark, "quire")
        atexit.register(self._clear)

    def _clear(self) -> None:
        local = self.base.removeprefix("file:")
        if local.startswith("/"):
            shutil.rmtree("/" + local.lstrip("/"), ignore_errors=True)
            return
        with contextlib.suppress(Exception):  # else the session is over, and the folder's owner cleans up
            self.drop("")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        scratch.delete(self.spark, f"{self.base}/{name}".rstrip("/"))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are over: its cleaner acts when the driver collects garbage, which it is asked to do here, since else the
    files of all steps add up on the executors' disks."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------- word hashes

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
#: Bytes hashed at a time; bounds the memory of the arrays below whatever a text's length.
SEGMENT = 1 << 21
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n (at least)."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        n = max(1 << 12, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, inverse):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[int(base)] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _segment(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = powers(_ODD, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], out=total[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * inverse[starts] + length * _ODD2), starts, ends


def word_hashes(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end byte of each word of UTF-8 bytes; A-Z count as a-z if lower."""
    table = _BYTE_LOWER if lower else _BYTE
    array = np.frombuffer(data, np.uint8)
    if len(array) <= SEGMENT:
        return _segment(array, table)
    parts, at = [], 0
    while at < len(array):
        end = min(at + SEGMENT, len(array))
        while end < len(array) and not _SPACE[array[end]]:  # a word stays whole
            end += 1
        h, s, e = _segment(array[at:end], table)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def window_hashes(words: np.ndarray, width: int, base: np.uint64 = _ODD2) -> np.ndarray:
    """64-bit hash of each run of width words; another base, which is odd, gives another hash."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[width:] - total[:n]) * inverse[:n])


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than width: the whole sequence as one."""
    words, _, _ = word_hashes((text or "").encode("utf-8", "surrogatepass"), lower=True)
    if len(words) == 0:
        return words
    return np.unique(window_hashes(words, min(width, len(words))))
