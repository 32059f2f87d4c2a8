"""Hashes under a secret key: what collides without one is told apart, and ids of any kind come back as they were."""

from __future__ import annotations

import hashlib

import brute
import numpy as np
import pytest

from gridlark.llm import neardup, substrings
from gridlark.llm.common import _FIRST, Workspace, _U, keyed_hashes, mix, word_hashes


def partner(words, size, seed=1):
    """Two words of ``size`` bytes with one plain hash: for two first pieces, the second pieces are solved for."""
    start = mix(np.array([size], np.uint64) + _U(seed * 0x632BE59BD9B4E019 % 2**64))[0]
    with np.errstate(over="ignore"):
        step = lambda w: mix((start ^ np.frombuffer(w, "<u8")) * _U(0x9FB21C651E98DF25) + _U(0xD1342543DE82EF95))[0]
        return (step(words[0][:8]) ^ step(words[1][:8]) ^ np.frombuffer(words[0][8:16], "<u8")[0]).tobytes()


def test_words_solved_for_are_told_apart(spark):
    first = b"rs18bf38pbapataa"
    known = np.frombuffer(b"rs18bf38pbapataaoyhp5kxw1ct9i8u3", np.uint8)
    at = np.array([0, 16])
    assert len(set(word_hashes(known, at, at + 16, 1).tolist())) == 1 and len(set(keyed_hashes(known, at, at + 16, (3, 4)).tolist())) == 2
    for size in (16, 24, 40):
        a, b = first + b"q" * (size - 16), b"zzzzzzzz"
        b += partner((a, b), size) + b"q" * (size - 16)
        data = np.frombuffer(a + b, np.uint8)
        at = np.array([0, size])
        plain, keyed = word_hashes(data, at, at + size, 1), keyed_hashes(data, at, at + size, (5, 6))
        assert plain[0] == plain[1] and keyed[0] != keyed[1]
    docs = [(1, "rs18bf38pbapataa"), (2, "oyhp5kxw1ct9i8u3"), (3, "other"), (4, "rs18bf38pbapataa one two three"), (5, "oyhp5kxw1ct9i8u3 one two three")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(Workspace(spark, "keyed"), df, k=4).collect()}
    assert got == brute.near_duplicates(docs, 4, 80)


def test_keyed_hashes_are_of_the_bytes_and_the_key():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 3000)
    end = start + rng.integers(1, 100, 3000)
    seen: dict = {}
    for h, s, e in zip(keyed_hashes(data, start, end, (1, 2)).tolist(), start, end, strict=True):
        assert seen.setdefault(h, data[s:e].tobytes()) == data[s:e].tobytes()
    assert len(seen) == len({data[s:e].tobytes() for s, e in zip(start, end, strict=True)})
    assert not set(keyed_hashes(data, start, end, (1, 3)).tolist()) & set(seen) and len(_FIRST) == 9


@pytest.mark.parametrize("kind", ["string", "long"])
def test_repeated_substrings_give_the_ids_back(spark, kind):
    long = "abcdefghij" * 30
    ids = ["x", "x", None, "-", "-", "y:1", None] if kind == "string" else [1, 1, None, 0, 0, 2, None]
    texts = ["short", "hello", long, "own", long, "z", ""]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.without_repeats(Workspace(spark, "ids"), docs).collect()]
    plain = brute.repeats(list(enumerate(texts)), 200)
    assert sorted(got, key=str) == sorted(((ids[i], n, gone, sha) for i, (n, gone, _, sha) in plain.items()), key=str)
