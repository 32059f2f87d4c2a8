"""Plans and steps that have to hold at any size of the tables."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridlark.operators import duplicates, matching
from gridlark.plans import fixtures as fx
from gridlark.sources import labels

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_keys_of_hashes_are_never_broadcast(spark):
    hashes = spark.range(64).select(F.col("id").alias("image_id"), (F.col("id") * 2654435761 % 4294967296).alias("h0"), (F.col("id") * 40503).alias("h1"))
    found = duplicates.near_hashes(hashes, hashes, ["h0", "h1"], 12)
    joins = [line for line in _plan(found).splitlines() if re.search(r"Join \[_key#\d+L?\]", line)]
    assert joins and all("SortMergeJoin" in line for line in joins)


@needs_tables
@pytest.mark.parametrize("made, text", [(fx.truth, fx.TRUTH), (fx.predictions, fx.PREDICTIONS), (fx.views, fx.VIEWS)])
def test_tables_made_in_one_pass_are_those_of_their_texts(spark, made, text):
    got, want = made(spark, SF), fx.table(spark, SF, text)
    assert got.dtypes == want.dtypes and want.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@needs_tables
def test_parts_follow_the_lines(spark, monkeypatch):
    monkeypatch.setattr(fx, "_LINES_OF_PART", 1000)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert fx.views(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() >= lines // 1000


@needs_tables
@pytest.mark.parametrize("name", ["j06_view_support", "p06_decisions", "w05_capped_boxes", "a21_image_summary"])
def test_boxes_made_of_lines_are_not_shuffled(spark, monkeypatch, name):
    """What is shuffled is lines, once for predictions and once for views, not the boxes made of them."""
    monkeypatch.setattr(fx, "_LINES_OF_PART", 1000, raising=False)
    found = entry.queries()[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan.split("== Initial Plan ==")[-1])) == 2


def test_support_of_missing_and_repeated_views(spark):
    box = "image_id long, pred_idx long, class_id int, xc double, yc double, w double, h double"
    p = spark.createDataFrame([(1, 0, 3, 0.5, 0.5, 0.2, 0.2), (1, 0, 3, 0.5, 0.5, 0.2, 0.2), (1, 1, None, 0.5, 0.5, 0.2, 0.2), (2, 0, 3, 0.5, 0.5, 0.2, 0.2), (None, 0, 3, 0.5, 0.5, 0.2, 0.2), (3, 0, 3, 0.5, 0.5, 0.0, 0.0)], box)
    v = spark.createDataFrame([(1, 7, 3, 0.5, 0.5, 0.2, 0.2), (1, 7, 3, 0.5, 0.5, 0.2, 0.2), (1, 8, 4, 0.5, 0.5, 0.2, 0.2), (1, 9, 3, 0.9, 0.9, 0.1, 0.1), (1, None, 3, 0.5, 0.5, 0.2, 0.2), (None, 7, 3, 0.5, 0.5, 0.2, 0.2), (3, 7, 3, 0.5, 0.5, 0.0, 0.0)], box.replace("pred_idx", "view_id"))
    rows = lambda df: sorted((str(r["image_id"]), r["pred_idx"], r["support"]) for r in df.collect())
    assert rows(matching.view_support(p, v)) == [("1", 0, 2), ("1", 0, 2), ("1", 1, 1), ("2", 0, 1), ("3", 0, 1), ("None", 0, 1)]
    assert rows(matching.view_support(p, v, allowed=(3, 4))) == [("1", 0, 3), ("1", 0, 3), ("1", 1, 3), ("2", 0, 1), ("3", 0, 1), ("None", 0, 1)]


# lines of white space of all kinds, signs, exponents, words that only Java takes for numbers, more and fewer fields
_ODD = ["3 .5 .5 .2 .2", " 3\t.5  .5\x0b.2\f.2 \r", "+3. 5e-1 .5 2E-1 -.2", "3.9 .5 .5 .2 .2", "9 .5 .5 .2 .2", "3 .5 .5 .2", "3 .5 .5 .2 .2 .1", "", "  ", "nan .5 .5 .2 .2", "3 .5 .5 .2 1d", "3 .5 .5 .2 inf", "3 .5 .5 .2 .2\x85", "3 .5 .5 .2\xa0.2", "3 . .5 .2 .2", "3 .5 .5 .2 1e999", None]


def test_lines_are_parsed_as_before(spark):
    got = labels.parsed(spark.createDataFrame(list(enumerate(_ODD)), "line_no int, line string")).orderBy("line_no").collect()
    inf = float("inf")
    want = {0: (3, 0.5, 0.5, 0.2, 0.2), 1: (3, 0.5, 0.5, 0.2, 0.2), 2: (3, 0.5, 0.5, 0.2, -0.2), 3: (3, 0.5, 0.5, 0.2, 0.2), 15: (3, 0.5, 0.5, 0.2, inf)}
    assert [r["line_no"] for r in got] == list(range(len(_ODD)))
    assert {r["line_no"]: tuple(r[c] for c in ("class_id", "xc", "yc", "w", "h")) for r in got if r["class_id"] is not None} == want
    assert [r["line_no"] for r in got if r["blank"]] == [7, 8]
    labels.register_label_boxes(spark)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(_ODD) if t is not None], "k int, value string")
    found = spark.sql("SELECT k, b.* FROM (SELECT k, label_boxes(value) AS boxes FROM {f}) f, LATERAL inline_outer(f.boxes) b WHERE b.line_no IS NOT NULL", f=texts).collect()
    assert {r["k"]: tuple(r[c] for c in ("class_id", "xc", "yc", "w", "h")) for r in found} == want


def test_a_line_is_split_once(spark):
    """However many columns come of it, and a filter on one of them."""
    found = labels.remapped(spark.createDataFrame([(0, "3 .5 .5 .2 .2")], "line_no int, line string"), {3: 5})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("RLIKE") == 1


@needs_tables
def test_label_texts_are_parsed_once(spark):
    plan = entry.queries()["t06_label_function"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1


@needs_tables
@pytest.mark.parametrize("name", ["t02_self_training", "l11_box_quota", "s10_harmonized_datasets"])
def test_what_is_read_again_is_written(spark, name):
    """The result reads what was made of the lines from the shared folder, and makes none of it anew."""
    assert not [f for f in entry.queries()[name](spark, SF).inputFiles() if "lineitem" in f]


@needs_tables
def test_catalogs_share_files(spark):
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet").count()
    found = entry.queries()["k04_catalog_texts"](spark, SF)
    assert found.count() == suppliers > len(found.inputFiles())
