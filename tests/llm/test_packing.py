"""Packing: pieces against the plain tokenizer, sequences against their laws and a plain count of padding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import packing, tokens
from gridlark.llm.common import Workspace

PATH = tokens.default_path("word_bpe_49k.json")


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeéßÅ'.!1", k=rng.randint(1, 9)))
    some = [" ".join(word() for _ in range(rng.choice([3, 40, 400]))) for _ in range(60)]
    odd = [None, "", " ", "  a  b ", "\ta\nb   c", "it's <|endoftext|> don't", "Å é ́x", "ẞΣ Σ", "x" * 30_000, "the " * 9000, "\x00 \x1f y z"]
    return some + odd + [some[0]] * 5


@pytest.fixture(scope="module")
def plain():
    made = tokens.byte_tokenizer(PATH, special=True)
    return [[*made.encode(t or "", add_special_tokens=False).ids, 2] for t in texts()]


def checked(rows, plain, ids_of, capacity=4096):
    """Each id in one piece, crc and lengths right, sequences without gaps; the padding as a share of the tokens."""
    docs: dict = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    for d, rs in docs.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            own = np.array(plain[ids_of(d)][r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.length > 0 and zlib.crc32(own) == r.ids_crc32 and r.doc_tokens == len(plain[ids_of(d)])
            at += r.length
        assert at == len(plain[ids_of(d)])
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    whole = used = 0
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        whole, used = whole + packing.padded(at, capacity), used + at
    return (whole - used) / used


@pytest.mark.parametrize("parts", [1, 7])
def test_pieces_and_sequences(spark, plain, parts):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").withColumns({"start": F.lit("clash"), "ids": F.lit(1), "_at": F.lit(2), "length": F.lit("x")})
    packed = packing.pack(Workspace(spark, "pack"), docs.repartition(parts), PATH, keep_ids=True)
    rows = packed.collect()
    assert len({r.doc_id for r in rows}) == len(plain)
    assert checked(rows, plain, lambda d: d) < 0.01
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    got = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    by: dict = {}
    for r in sorted(rows, key=lambda r: r.offset):
        by.setdefault(r.sequence_id, []).extend(plain[r.doc_id][r.start : r.start + r.length])
    assert got == by


def test_small_store_and_small_capacity(spark, plain, monkeypatch):
    monkeypatch.setattr(tokens, "MOST", 20)
    monkeypatch.setattr(tokens, "LOOK", 500)
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts())], "doc_id string, text string").repartition(3)
    rows = packing.pack(Workspace(spark, "pack"), docs, PATH, capacity=64).drop("ids").collect()
    checked(rows, plain, int, 64)


def test_null_and_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b")] * 3 + [(1, "a"), (1, "a")], "doc_id long, text string")
    rows = packing.pack(Workspace(spark, "pack"), docs, PATH).collect()
    assert sum(r.length for r in rows) == 3 * 3 + 2 * 2 and sum(r.doc_tokens == 3 and r.start == 0 for r in rows) == 3
    assert packing.pack(Workspace(spark, "pack"), docs.where("false"), PATH).count() == 0


def test_classes():
    lengths = packing.class_lengths(4096)
    assert lengths[:5] == [4096, 2048, 1365, 1024, 819] and lengths[-64:] == list(range(64, 0, -1)) and len(lengths) <= 128
    up = np.array(lengths[::-1])
    for n in [1, 2, 63, 1000, 4095, 4096, 4097, 100_000]:
        assert sum(packing.cuts(n, 4096, up)) == n
    assert max(len(packing.cuts(n, 4096, up)) for n in range(1, 4097)) <= 5
    assert max(4096 % v for v in lengths) < 64
    assert packing.powers_of_two(13) == [8, 4, 1] and packing.powers_of_two(0) == []


def test_word_ids_are_the_library_s():
    rng = random.Random(1)
    made, library = tokens.WordIds(PATH), tokens.byte_tokenizer(PATH, special=True)
    marks = [chr(c) for c in [*range(1, 0x180), 0x301, 0x3A3, 0x130, 0x2028, 0x3000, 0x1F642, 0xAC00, 0x1100] if chr(c) != " "] + ["'s", "'LL", "<|endoftext|>", "<|startoftext|>", "the", "ing"]
    chunks = ["", "aaaaaaa", "AAAA'S'LLx", "a" * 3000, *["".join(rng.choices(marks, k=rng.randint(1, 12))) for _ in range(3000)], *["".join(rng.choices("abcdefé'.1", k=rng.randint(1, 15))) for _ in range(3000)]]
    for some in (chunks, chunks[:2], [], ["\u0130"], ["x"]):
        ids, count = made(some)
        at = tokens.cut(count)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(some))] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_merges_of_a_byte_level_file():
    rng = random.Random(1)
    path = tokens.default_path("byte_bpe_50k.json")
    library = tokens.byte_tokenizer(path, special=False)
    words = [" " + "".join(rng.choices("aabetinrs", k=rng.randint(1, 30))) for _ in range(2000)] + ["a", "aa", "aaa" * 50]
    ids, count = tokens.Merges(path).ids([w.encode() for w in words], 300)
    at = tokens.cut(count)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(words))] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
