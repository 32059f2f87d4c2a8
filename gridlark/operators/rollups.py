"""Reports over stages, seeds and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_stage(rows: DataFrame, word: str, order: str, exact: bool = False) -> DataFrame:
    """The last row whose stage is, or contains, the word."""
    hit = F.col("stage") == word if exact else F.contains("stage", F.lit(word))
    return rows.where(hit).agg(F.max_by(F.struct(*rows.columns), order).alias("x")).where("x is not null").select("x.*")


def deltas(rows: DataFrame, key: str, baseline: str, values: Sequence[str]) -> DataFrame:
    """rows with value - baseline's value for each value; no row without a baseline, an error if it has several rows."""
    own = F.col(key) == baseline
    base = rows.where(own).agg(F.count("*").alias("_n"), *[F.first(v).alias(f"_{v}") for v in values])
    several = F.raise_error(F.lit(f"the baseline {baseline} has several rows"))
    base = base.where("_n > 0").select(*[F.when(F.col("_n") > 1, several).otherwise(F.col(f"_{v}")).alias(f"_{v}") for v in values])
    return rows.crossJoin(F.broadcast(base)).select(*rows.columns, *[(F.col(v) - F.col(f"_{v}")).alias(f"delta_{v}") for v in values])


def guardrails(rows: DataFrame, exact: Sequence[str], slack: Sequence[str], allowance: float = 0.02) -> DataFrame:
    """rows of deltas with passes: no loss in the exact values, a small one allowed in the others."""
    ok = F.lit(True)
    for v in exact:
        ok &= F.col(f"delta_{v}") >= 0
    for v in slack:
        ok &= F.col(f"delta_{v}") >= -allowance
    return rows.withColumn("passes", ok)


def seed_results(scene: DataFrame, locked: DataFrame) -> DataFrame:
    """Measures of both evaluations of each (seed, stage) that has both, as scene_<measure> and locked_<measure>."""
    key = ["seed", "stage"]
    own = lambda df, name: df.select(*key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in key])
    return own(scene, "scene").join(own(locked, "locked"), key)


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    """n by all keys, by each shorter run of them from the first, and of all rows, where the keys left out are null."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"))


def joined_reports(base: DataFrame, *reports: DataFrame, key: str = "model") -> DataFrame:
    """The base table with the columns of every report of its model, where there is one."""
    for r in reports:
        base = base.join(r, key, "left")
    return base


def without_seed(name: str = "model") -> Column:
    """The name without its seed suffix, as the key of runs that differ by seed alone."""
    return F.regexp_replace(name, r"_seed\d+$", "")


def mean_curve(curve: DataFrame) -> DataFrame:
    """Mean precision and recall of each rank over classes and models, in the order of recall."""
    return curve.groupBy("rank").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.count("*").alias("curves"))


def source_masks(rows: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """source, kind, classes, observed, mask: each source's class masks as arrays of 0/1, and one row of kind combined (source null).

    rows (source, class_id) are the boxes; declared (source, classes array), if given, what sources say they label. A
    source's mask is the declared one, or the observed one of a source that declares nothing; the combined row is the
    logical OR over all sources. A declared source without boxes has an empty observed mask.
    """
    bits = lambda ids: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.array_contains(ids, i).cast("int"))
    own = rows.groupBy("source").agg(F.array_sort(F.collect_set("class_id")).alias("classes"))
    if declared is not None:
        said = declared.groupBy("source").agg(F.array_distinct(F.flatten(F.collect_list(F.col("classes").cast("array<int>")))).alias("_said"))
        own, said = own.alias("o"), said.alias("s")
        own = own.join(said, F.col("o.source").eqNullSafe(F.col("s.source")), "full").select(F.coalesce("o.source", "s.source").alias("source"), F.coalesce("classes", F.array().cast("array<int>")).alias("classes"), "_said")
    else:
        own = own.withColumn("_said", F.lit(None).cast("array<int>"))
    each = own.select("source", F.lit("source").alias("kind"), "classes", bits(F.col("classes")).alias("observed"), bits(F.coalesce("_said", "classes")).alias("mask"))
    union = lambda c: F.array(*[F.coalesce(F.max(F.get(c, F.lit(i))), F.lit(0)) for i in range(6)]).alias(c)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes")
    whole = each.agg(ids, union("observed"), union("mask")).select(F.lit(None).cast(dict(each.dtypes)["source"]).alias("source"), F.lit("combined").alias("kind"), "classes", "observed", "mask")
    return each.unionByName(whole)
