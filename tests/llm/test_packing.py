import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(tokenizer):
    texts = ["", " ", "a", "a  b", "a \nb", "a\n b", "a\nb c.", "a\n\nb", "é x　y\x1cz !\x1c", "<|endoftext|> it's  1234 don't\n", "a <|endoftext|> b", "end<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext |>", " lead", "trail ", "\n", "日本 語", "a\tb", "x " * 500]
    encode = packing.Encoder(PATH)
    for _ in range(2):
        for text in texts:
            ids, stops = encode(text)
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
            assert all(0 <= s <= len(want) for s in stops)


def test_windows_are_the_best():
    rng = random.Random(2)
    for _ in range(60):
        size = rng.randrange(4, 12)
        ends, at = [], 0
        for _ in range(rng.randrange(1, 12)):
            at += rng.randrange(1, size + 1)
            ends.append(at)
        pen = [rng.choice([0.0, 1.0, 5.0]) for _ in ends]

        def cost(chosen):
            total, a = 0.0, 0
            for j in chosen:
                if ends[j] - a > size:
                    return float("inf")
                total += size - (ends[j] - a) + pen[j]
                a = ends[j]
            return total

        n = len(ends)
        best = min(cost([j for j in range(n - 1) if m >> j & 1] + [n - 1]) for m in range(1 << (n - 1)))
        chosen = packing.cuts(np.array(ends), np.array(pen), size)
        assert chosen[-1] == n - 1 and cost(chosen) == best


@pytest.mark.parametrize("size,block", [(64, 1 << 17), (64, 500), (16, 200)])
def test_round_trip(documents, clash, tokenizer, size, block):
    out = packing.pack(clash, PATH, size, block=block).collect()
    docs, where = {}, {}
    for r in out:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        docs.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = total = 0
    for parts in where.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding <= 0.25 * total
    copies = {}
    for i, text in documents.select("doc_id", "text").collect():
        copies.setdefault(i, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    for i, texts in copies.items():
        parts = docs[i]
        assert sum(len(p[1]) for p in parts) == sum(map(len, texts))
        if len(texts) == 1:
            assert [x for p in sorted(parts) for x in p[1]] == texts[0] and {p[2] for p in parts} == {len(texts[0])}


def test_empty(empty):
    assert packing.pack(empty, PATH).collect() == []


def test_a_worker_opens_the_tokenizer_only_for_texts_that_need_it():
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    plain = encode("Hello world. This is text.\n")[0]
    assert encode._whole is None
    assert encode("a <|endoftext|> b")[0] and encode._whole is not None
    assert encode.tokenizer.encode("Hello world. This is text.\n", add_special_tokens=False).ids == [*memoryview(plain).cast("I")]
