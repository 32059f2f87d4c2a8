from __future__ import annotations

from gridlark.sources import pool


def files(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_a_pool_grows_and_never_doubles(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    key = lambda df: sorted(tuple(r) for r in df.collect())
    one = pool.candidates(files(spark, "/new/ripe/b/x.jpg", "/new/ripe/a/x.jpg", "/new/ripe/y.PNG", "/new/z.jpg", "/new/ripe/notes.txt", "/other/ripe/x.jpg", "/new/unripe/x.jpg"), "/new")
    assert key(one.drop("path")) == [("ripe", "x.jpg"), ("ripe", "x.jpg"), ("ripe", "y.PNG"), ("unripe", "x.jpg")]
    assert pool.ledger(spark, path).count() == 0
    added = key(pool.append(spark, one, path, "1"))
    assert added == [("ripe", "x.jpg", "/new/ripe/a/x.jpg"), ("ripe", "y.PNG", "/new/ripe/y.PNG"), ("unripe", "x.jpg", "/new/unripe/x.jpg")]
    # the same batch again, and the same files as another batch
    assert key(pool.append(spark, one, path, "1")) == added
    assert key(pool.append(spark, one, path, "2")) == []
    more = pool.candidates(files(spark, "/next/ripe/x.jpg", "/next/ripe/X.jpg"), "/next/")
    assert key(pool.append(spark, more, path, "3")) == [("ripe", "X.jpg", "/next/ripe/X.jpg")]
    assert key(pool.append(spark, one, path, "1")) == added
    assert {(r.place, r.name, r.batch) for r in pool.ledger(spark, path).collect()} == {("ripe", "x.jpg", "1"), ("ripe", "y.PNG", "1"), ("unripe", "x.jpg", "1"), ("ripe", "X.jpg", "3")}
    assert key(pool.append(spark, one.where("false"), path, "4")) == []


def test_scenes(spark):
    got = {tuple(r) for r in pool.scenes(files(spark, "/p/A b/2.jpg", "/p/A b/x/1.jpg", "/p/9.jpg", "/q/1.jpg", "/p/A b/1.txt"), "/p").collect()}
    assert got == {("A b", 2, "/p/A b/2.jpg", "/p/A b/x/1.jpg"), ("root_scene", 2, "/p/9.jpg", "/q/1.jpg")}
