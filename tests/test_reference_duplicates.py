import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridlark.functions import hashes
from gridlark.operators import duplicates
from gridlark.plans import more_queries

SF = "/root/testdata/sf0.001"


def plain_hash(pixels, size=16):
    """The bits of the difference hash, first one first."""
    return [int(pixels[y * (size + 1) + x] > pixels[y * (size + 1) + x + 1]) for y in range(size) for x in range(size)]


def test_difference_hash(spark):
    rng = random.Random(3)
    pictures = [[rng.randrange(256) for _ in range(272)] for _ in range(3)]
    rows = spark.createDataFrame([(p,) for p in [*pictures, [1, 2]]], "p array<int>").coalesce(1)
    *got, short = [list(r) for r in rows.select(*hashes.difference_hash(F.col("p"))).collect()]
    assert got == [[sum(b << i for i, b in enumerate(plain_hash(p)[32 * k : 32 * k + 32])) for k in range(8)] for p in pictures]
    assert short == [None] * 8


def test_a_picture_encoded_anew_is_verified(spark):
    rng = random.Random(4)
    p = [rng.randrange(256) for _ in range(272)]
    again, other = [v // 2 * 2 for v in p], p[::-1]
    assert sum(a != b for a, b in zip(plain_hash(p), plain_hash(again), strict=True)) <= 10
    names = [f"d{i}" for i in range(8)]
    schema = "image_id long, base string, h0 long, h1 long, digest string, p array<int>"
    hashed = lambda rows: spark.createDataFrame(rows, schema).withColumns(dict(zip(names, hashes.difference_hash(F.col("p")), strict=True)))
    own = hashed([(1, "a", 7, 7, "x", p)])
    reference = hashed([(2, "b", 7, 7, "y", again), (3, "c", 7, 7, "z", other), (4, "d", 7, 7, "x", other), (5, "e", 7, 7, "y", None)])
    got = duplicates.against_reference(own, reference, ["h0", "h1"], 0, verify_digest="digest", verify_limbs=names).collect()
    assert {r.reference_id: r.verified for r in got} == {2: True, 3: False, 4: True, 5: False}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_verified_duplicates_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.sql(more_queries.ORACLES["j13_verified_duplicates"]).fetchall()
    got = [tuple(r) for r in more_queries.QUERIES["j13_verified_duplicates"](spark, SF).select("image_id", "reference_id", "kind", "verified").collect()]
    assert sorted(want) == sorted(got)
    # some matches by hash without equal digests are verified, and some are not
    by_hash = [r for r in got if r[2] == "hash" and not (r[0] == r[1] and r[0] % 5 == 0)]
    assert {r[3] for r in by_hash} == {True, False}
