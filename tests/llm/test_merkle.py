"""The Merkle manifest against a plain tree in memory, with tiers of few levels so that several are passed."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridlark.llm import merkle
from gridlark.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_levels(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_proof(levels, i):
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append("-" if j >= len(level) else ("<" if j < i else ">") + level[j])
        i >>= 1
    return out


def plain(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    made = lambda r, more=0: sha("".join(map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    for rs in trees.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, made(r)))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    levels = {k: plain_levels([made(r) for r in trees[k]]) for k in names}
    top = plain_levels([levels[k][-1][0] for k in names])
    out = []
    for n, k in enumerate(names):
        for i, r in enumerate(trees[k]):
            proof = plain_proof(levels[k], i) + plain_proof(top, n)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = made(r, 1) if hit else made(r)
            for s in proof:
                acc = sha(acc) if s == "-" else sha(s[1:] + acc) if s[0] == "<" else sha(acc + s[1:])
            out.append((r[0], made(r), levels[k][-1][0], top[-1][0], sha("".join(s[1:] for s in proof if s != "-")), acc, acc == top[-1][0]))
    return sorted(out, key=str)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", "fr", None, "ü", "="]
    rows = [(i * 3, "".join(rng.choices("abcé ", k=rng.randint(0, 40))), rng.choice(langs), rng.choice(["s", None, "t1"]), rng.choice([None, 5, 99])) for i in range(n)]
    return rows + [rows[0], rows[0], (0, "other", rows[0][2], "s", 1), (None, "no id", "en", "s", 1), (None, None, "en", None, None), (7, "", "one", "", 0), (8, "x" * 200_000, "two", "s", 0), (9, "y", "two", "s", 0)]


def query(spark, folder):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in cols) for r in merkle.op11_merkle_manifest(spark, folder).collect()), key=str)


@pytest.mark.parametrize("tier", [2, 9])
def test_manifest_is_the_plain_one(spark, tmp_path, monkeypatch, tier):
    monkeypatch.setattr(merkle, "TIER", tier)
    rows = rows_of(230)
    # every column name that the operator makes is there already
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("tree", "node", "place", "width", "level", "block", "proof", "root", "changed", "half")})
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = query(spark, str(tmp_path))
    assert got == plain(rows)
    # a changed leaf is caught, unless it has no n_chars to change
    ok = {r[0]: r[4] is None for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert any(ok.values()) and not all(ok.values())
    assert all(v is ok.get(d, True) for d, *_, v in got)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_small_and_empty_tables(spark, tmp_path, n):
    rows = [(i, "t", "en", "s", 1) for i in range(n)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/{n}/documents.parquet")
    assert query(spark, f"{tmp_path}/{n}") == plain(rows)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none{n}/documents.parquet")
    assert query(spark, f"{tmp_path}/none{n}") == []


def test_proofs_and_store_of_one_tree(spark):
    nodes = [sha(str(i)) for i in range(77)]
    leaves = spark.createDataFrame([("t", n, i) for i, n in enumerate(nodes)], "tree string, node string, i long").repartition(4)
    made = merkle.Manifest(Workspace(spark, "merkle-test"), leaves, [F.col("i")])
    levels = plain_levels(nodes)
    # a tree of one subroot: the root is that node
    assert made.root == levels[-1][0]
    stored = {(r.level, r.place): r.node for r in made.store().collect()}
    assert stored == {(k, i): n for k, level in enumerate(levels) for i, n in enumerate(level)}
    for r in made.proofs(["i"]).collect():
        assert r.proof == plain_proof(levels, r.i) and r.place == r.i
    with pytest.raises(ValueError):
        merkle.Manifest(made.ws, leaves.withColumn("Place", F.lit(1)), [F.col("i")])
