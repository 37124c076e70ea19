"""What only Python's Unicode tables do, as pandas UDFs."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def title_of(text: str | None) -> str:
    """Entities resolved, compatibility forms composed, white space collapsed, each word's first letter upper case."""
    return " ".join(unicodedata.normalize("NFKC", html.unescape(text or "")).split()).title()


def folded(text: str | None) -> str:
    return unicodedata.normalize("NFKD", text or "").casefold()


def composed(text: str | None) -> str:
    return unicodedata.normalize("NFC", text or "").casefold()


@F.pandas_udf(T.StringType())
def format_title(s: pd.Series) -> pd.Series:
    return s.map(title_of)


@F.pandas_udf(T.StringType())
def normalize(s: pd.Series) -> pd.Series:
    return s.map(folded)


@F.pandas_udf(T.StringType())
def compose_fold(s: pd.Series) -> pd.Series:
    return s.map(composed)


@F.pandas_udf(T.ArrayType(T.StringType()))
def distinct_tags(s: pd.Series) -> pd.Series:
    """Distinct tags by their folded forms, sorted."""
    return s.map(lambda tags: sorted({folded(t) for t in tags if t is not None}) if tags is not None else None)


@F.pandas_udf(T.StringType())
def unscramble_udf(parts: pd.Series, key: pd.Series, mode: pd.Series) -> pd.Series:
    return pd.Series([unscramble(p, k, m) for p, k, m in zip(parts, key, mode, strict=True)])


@F.pandas_udf(T.StringType())
def inflate_udf(body: pd.Series, alphabet: pd.Series) -> pd.Series:
    return pd.Series([inflate(b, a) for b, a in zip(body, alphabet, strict=True)])


def decode(encoding: str):
    """BINARY -> text by a Python codec (GBK and others that Spark doesn't know); null if it doesn't fit."""

    @F.pandas_udf(T.StringType())
    def of(s: pd.Series) -> pd.Series:
        def one(b):
            try:
                return None if b is None else bytes(b).decode(encoding)
            except UnicodeDecodeError:
                return None

        return s.map(one)

    return of


@F.pandas_udf(T.StringType())
def decode_sniffed(s: pd.Series) -> pd.Series:
    """BINARY -> text: UTF-16 by its mark, else UTF-8 with or without one; CRLF and CR become LF. Null if it doesn't fit, has a NUL or is
    blank."""

    def one(b):
        data = bytes(b) if b is not None else b""
        try:
            text = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig")
        except UnicodeDecodeError:
            return None
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        return text if text.strip() and "\0" not in text else None

    return s.map(one)


def unscramble(parts: list[str] | None, key: str, mode: str = "xor_shuffle") -> str:
    """Text of chunks: four digits of order, then base64; XORed with a repeating key, or reversed first, or only base64."""
    from base64 import b64decode

    out = []
    for part in sorted([] if parts is None else list(parts), key=lambda p: p[:4]):
        body = part[4:]
        if mode == "base64_reverse":
            body = body[::-1]
        data = b64decode(body)
        if mode == "xor_shuffle" and key:
            k = key.encode()
            data = bytes(x ^ k[i % len(k)] for i, x in enumerate(data))
        out.append(data)
    return b"".join(out).decode("utf-8", "replace")


def inflate(body: str, alphabet: str) -> str:
    """Text of base64 in a permuted alphabet around zlib."""
    from base64 import b64decode

    standard = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    plain = re.sub(r"[^A-Za-z0-9+/]", "", body).translate(str.maketrans(alphabet, standard))
    data = b64decode(plain + "=" * (-len(plain) % 4))
    return zlib.decompress(data).decode("utf-8")
