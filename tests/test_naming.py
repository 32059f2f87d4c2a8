"""Names against a loop over the rows in order."""

from __future__ import annotations

import random
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from gridlark.operators.naming import unique_names
from gridlark.tables import fresh


def loop(names):
    used, out = set(), []
    for n in names:
        stem, suffix, given, i = PurePosixPath(n).stem, PurePosixPath(n).suffix, n, 1
        while given.lower() in used:
            given, i = f"{stem}_{i}{suffix}", i + 1
        used.add(given.lower())
        out.append(given)
    return out


def checked(spark, cases):
    rows = [(w, i, n) for w, names in cases.items() for i, n in enumerate(names)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "w string, i int, name string").withColumns({"_t": F.lit("clash"), "k": F.lit("clash"), "key": F.lit(1)})
    got = unique_names(df.repartition(3), "w", "name", ["w", "i"])
    assert got.columns == [*df.columns, "sample_name"]
    by: dict = {}
    for r in got.collect():
        assert (r["_t"], r["k"]) == ("clash", "clash")
        by.setdefault(r.w, {})[r.i] = r.sample_name
    for w, names in cases.items():
        assert [by[w][i] for i in range(len(names))] == loop(names), names


def test_names_as_a_loop_gives_them(spark):
    rng = random.Random(2)
    fixed = {
        "verdict": ["a.jpg", "A.jpg", "a_1.jpg"],
        "chain": ["a_1_1.jpg", "a_1.jpg", "a.jpg", "A.jpg", "a.JPG", "a_1.jpg", "a_2.jpg", "a_1_1.jpg"],
        "before": [f"a_{k}.jpg" for k in (1, 2, 4, 7)] + ["a.jpg"] * 6,
        "after": ["a.jpg"] * 6 + [f"a_{k}.jpg" for k in (1, 2, 4, 7)] * 2,
        "between": ["a.jpg", "a.jpg", "a_2.jpg", "a.jpg", "a_4.jpg", "a_3.jpg", "a.jpg", "a.jpg", "a_5.jpg"],
        "odd": [".jpg", ".jpg", "_1.jpg", "_1.jpg", "a.", "a.", "a", "a", "a_01", "a_0", "a_1", "a_99999999999999999999", "x.y_1", "x.y", "x.y", "..b", "..b"],
    }
    letters = ["a", "A", "a_1", "a_2", "a_3", "a_1_1", "A_1_2", "a_2_1", "b", "a_1_1_1"]
    drawn = {str(i): [rng.choice(letters[: rng.randint(2, 10)]) + rng.choice([".jpg", ".JPG", ".jpg", ".png", ""]) for _ in range(rng.randint(1, 25))] for i in range(150)}
    checked(spark, fixed | drawn)


def test_one_name_in_most_rows_and_small_bins(spark, monkeypatch):
    from gridlark.operators import naming

    monkeypatch.setattr(naming, "_BIN", 2)
    rng = random.Random(3)
    checked(spark, {"hot": [rng.choice(["img.jpg", "img.jpg", f"IMG_{rng.randint(1, 80)}.jpg"]) for _ in range(400)]})


def test_null_names_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "a"), ("x", 3, None), ("x", 4, None), ("-", 5, "a")], "w string, i int, name string")
    got = {r.i: r.sample_name for r in unique_names(df, "w", "name", ["i"]).collect()}
    assert got == {1: "a", 2: "a_1", 3: None, 4: None, 5: "a"}
    assert unique_names(df.where("false"), "w", "name", ["i"]).count() == 0


def test_fresh_names():
    assert fresh(["A", "_a", "b"], "a", "c", "c") == ["__a", "c", "_c"]
