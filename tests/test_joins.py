"""Tolerance joins, ordered choices, ragged rows and the SQL function of label texts against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gridlark.operators import joins
from gridlark.sources import labels, sinks


def values(rng, n):
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e300, -1e300, 1e16]
    return odd + [round(rng.uniform(-3, 3), 1) + rng.choice([0, 1e-3, 9.9e-4, -9.9e-4, 1.1e-3]) for _ in range(n)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_tolerance_join_is_the_loop(spark, how):
    rng = random.Random(3)
    left, right = [(i, rng.choice("ab"), v) for i, v in enumerate(values(rng, 150))], [(i, rng.choice("ab"), v) for i, v in enumerate(values(rng, 150))]
    l = spark.createDataFrame(left, "i int, g string, x double").withColumn("_cell", F.lit("clash"))  # noqa: E741
    r = spark.createDataFrame(right, "j int, g string, y double")
    near = lambda a, b: a is not None and b is not None and math.isfinite(a) and math.isfinite(b) and abs(a - b) < 1e-3
    for on in ([], ["g"]):
        got = joins.within_tolerance(l, r if on else r.withColumnRenamed("g", "h"), "x", "y", 1e-3, on, how)
        want = sorted((a, b) for a, g, x in left for b, h, y in right if near(x, y) and (not on or g == h))
        if how == "left":
            want += [(a, -1) for a, *_ in left if a not in {p[0] for p in want}]
        assert sorted((row.i, -1 if row.j is None else row.j) for row in got.collect()) == sorted(want)
        assert {row["_cell"] for row in got.collect()} == {"clash"}


def test_values_at_the_edges_of_cells(spark):
    width = 1e-9 * joins._CELL
    xs = [k * width for k in range(-50, 50)]
    l = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")  # noqa: E741
    r = spark.createDataFrame([(i, x + s * 9e-10) for i, x in enumerate(xs) for s in (-1, 1)], "j int, y double")
    got = joins.within_tolerance(l, r, "x", "y", 1e-9).collect()
    assert sorted((g.i, g.j) for g in got) == sorted((i, i) for i in range(100) for _ in range(2))


def test_first_listed(spark):
    rows = spark.createDataFrame([(n, i) for i, n in enumerate("dcbaa")], "name string, i int").withColumn("_at", F.lit("clash"))
    listed = lambda *names: spark.createDataFrame(list(enumerate(names)), "o int, name string")
    one = lambda names, n=3: [(r.place, r.name) for r in joins.first_listed(rows, "name", ["i"], listed(*names), ["o"], n).orderBy("place", "i").collect()]
    assert one(["c", "zz", None, "c", "d"]) == [(1, "c"), (2, "c"), (3, "d")]
    assert one(["zz", "yy"]) == [(1, "d"), (2, "c"), (3, "b")]
    assert one([None]) == [(1, "d"), (2, "c"), (3, "b")]
    assert joins.first_listed(rows.where("false"), "name", ["i"], listed("c"), ["o"], 3).count() == 0


def test_ragged_rows(spark):
    rows = [(3, [("z", "1")]), (1, [("b", "x,y"), ("a", None)]), (2, [("a", 'q"'), ("c", "2"), ("a", "last\n")]), (4, [])]
    df = spark.createDataFrame(rows, "row int, cells array<struct<key:string,value:string>>").repartition(3)
    got = sinks.from_ragged(df)
    assert got.columns == ["row", "b", "a", "c", "z"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x,y", "", "", ""), (2, "", "last\n", "2", ""), (3, "", "", "", "1"), (4, "", "", "", "")]
    lines = {r.row: r.line for r in got.select("row", sinks.csv_line(["b", "a"]).alias("line")).collect()}
    assert lines == {1: '"x,y",', 2: ',"last\n"', 3: ",", 4: ","}


def test_label_function_is_the_lenient_scan(spark):
    texts = [(1, "3 .5 .5 .2 .2\n9 1 1 1 1\n\n 4.9\t0.1 0.1  1e-1 2 \nx 1 1 1 1\n1 1 1 1\n0 1 1 1 nan\n-0.5 1 1 1 +1."), (2, ""), (3, None)]
    files = spark.createDataFrame(texts, "k int, value string")
    labels.register_label_boxes(spark)
    got = spark.sql("SELECT k, b.* FROM (SELECT k, label_boxes(value) AS boxes FROM {f}) f, LATERAL inline(f.boxes) b", f=files)
    lines = files.select("k", F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("line_no", "line"))
    key = lambda df: sorted(tuple(r) for r in df.select("k", "line_no", "class_id", "xc", "yc", "w", "h").collect())
    assert key(got) == key(labels.lenient(lines)) and [r[:3] for r in key(got)] == [(1, 0, 3), (1, 3, 4), (1, 7, 0)]
