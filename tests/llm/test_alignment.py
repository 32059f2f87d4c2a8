"""Alignment: whole texts through both tokenizers, aligned by plain loops over bytes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import alignment, tokens
from gridlark.llm.common import Workspace

A, B = tokens.default_path("byte_bpe_50k.json"), tokens.default_path("piece_bpe_32k.model")


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeéßÅ'.!1\t日", k=rng.randint(1, 9)))
    some = [" ".join(word() for _ in range(rng.choice([1, 5, 60]))) for _ in range(40)]
    marks = " \t\n\r 　\x1f\x85​"
    wild = ["".join(rng.choices(marks + "  ab'é", k=rng.randint(1, 30))) for _ in range(120)]
    odd = [None, "", " ", "   ", "a ", " a", "a▁b c", "▁", "it's <|endoftext|> <s> </s> don't", "\x00", "x" * 20_000, "the cat " * 4000, "é ́ x", "🙂 🙂🙂", "a \n  b", "<0x41> A"]
    return some + wild + odd + [some[0]] * 4


def loops(pair, text):
    """Ids, cuts, overlaps, groups and links of one text."""
    none = [], [], [], [], [], []
    if not text:
        return none
    a, b = pair.a.library.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text)
    raw = f" {text}".encode()
    if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
        return none
    end_a, end_b = np.cumsum([len(pair.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(pair.b_bytes[i]) for i in b]).tolist()
    cuts = sorted(set(end_a) & set(end_b))
    over, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        over.append((i, j))
        x, y = end_a[i], end_b[j]
        i, j = i + (x <= y), j + (y <= x)
    groups, links, i, j = [], [], 0, 0
    for c in cuts:
        x, y = end_a.index(c) + 1, end_b.index(c) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        links.append((a[x - 1], b[y - 1]))
        i, j = x, y
    return a, b, cuts, over, groups, links


@pytest.fixture(scope="module")
def plain():
    pair = alignment.Pair(A, B)
    return [loops(pair, t) for t in texts()]


def frame(spark, parts=3):
    rows = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("link", "n", "b", "a", "best", "cuts")})
    return rows.repartition(parts)


@pytest.mark.parametrize("most", [10, 300_000])
def test_digests(spark, plain, monkeypatch, most):
    monkeypatch.setattr(tokens, "MOST", most)
    monkeypatch.setattr(tokens, "LOOK", 2000 if most == 10 else 1 << 20)
    counts = Counter(x for p in plain for x in p[5])
    top: dict = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.digests(Workspace(spark, "align"), frame(spark), A, B).collect()}
    for d, (a, b, cuts, _, groups, links) in enumerate(plain):
        best = sum(counts[x] == top[x[1]] for x in links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        assert got[d] == (len(a), len(b), len(cuts), len(links), best, sum(counts[x] for x in links), sha), repr(texts()[d])
    assert any(t and not p[0] for t, p in zip(texts(), plain, strict=True))


def test_alignments(spark, plain):
    for r in alignment.alignments(frame(spark), A, B).collect():
        a, b, cuts, over, _, _ = plain[r.doc_id]
        assert (r.a, r.b, r.cuts, [tuple(o) for o in r.overlaps]) == (a, b, cuts, over)


def test_pairs_have_a_bound(plain):
    """Of two linked tokens the bytes of one end those of the other."""
    pair = alignment.Pair(A, B)
    for a, b in {x for p in plain for x in p[5]}:
        x, y = pair.a_bytes[a], pair.b_bytes[b]
        assert x.endswith(y) or y.endswith(x)


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b")] * 2 + [(1, None)], "doc_id long, text string")
    rows = alignment.digests(Workspace(spark, "align"), docs, A, B).collect()
    assert sorted((r.doc_id is None, r.n_a, r.groups_sha256 != "") for r in rows) == [(False, 0, False), (True, 2, True), (True, 2, True)]
    assert alignment.digests(Workspace(spark, "align"), docs.where("false"), A, B).count() == 0
    assert alignment.alignments(docs.where("false"), A, B).count() == 0


def test_byte_ids_are_the_library_s():
    rng = random.Random(1)
    made = alignment.ByteIds(A)
    marks = [chr(c) for c in [*range(1, 0x180), 0x301, 0x2028, 0x3000, 0x1F642] if chr(c) != " "] + ["'s", "'LL", "<|endoftext|>", "the", "ing", "12"]
    chunks = ["", "aaaaaaa", "it's'll", " x", "a" * 3000, *["".join(rng.choices(marks, k=rng.randint(1, 12))) for _ in range(3000)], *["".join(rng.choices("abcDEFé'.1²", k=rng.randint(1, 15))) for _ in range(3000)]]
    for some in (chunks, chunks[:2], [], ["x"]):
        ids, count = made(some)
        at = tokens.cut(count)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(some))] == [e.ids for e in made.library.encode_batch([f" {c}" for c in some], add_special_tokens=False)]
