"""Queries of sources and names: scenes by folder, label files, source masks, title classes, pseudo-labelled unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import names
from gridlark.operators import decisions, splits
from gridlark.plans import fixtures as fx
from gridlark.plans.more_queries import ORACLES, QUERIES
from gridlark.plans.queries import _P, named_sql, query
from gridlark.sources import labels

__all__ = ["ORACLES", "QUERIES"]

_PLACE = "CASE o_orderkey % 4 WHEN 0 THEN 'pool/' WHEN 1 THEN 'pool/Scene-A/images/' WHEN 2 THEN 'pool/b c/' ELSE 'other/x/' END"


def _images(spark: SparkSession, d: str) -> DataFrame:
    place = F.expr(_PLACE)
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.concat(place, F.lit("img"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 1 THEN 'scene_a' WHEN 2 THEN 'b_c' ELSE 'root_scene' END AS scene, CASE o_orderkey % 4 WHEN 1 THEN 'Scene-A' WHEN 2 THEN 'b c' ELSE 'root_scene' END AS raw_scene FROM orders")
def f04_scene_from_folder(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return _images(spark, d).select("k", names.scene_folder(path, "pool").alias("scene"), names.scene_folder(path, "pool", False).alias("raw_scene"))


# Label files lie in one or two of the places where they may be, or nowhere.
@query(f"""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN {_PLACE} || 'img' || o_orderkey::VARCHAR || '.txt'
WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 = 1 THEN 'pool/Scene-A/labels/img' || o_orderkey::VARCHAR || '.txt'
WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 <> 3 THEN 'pool/labels/img' || o_orderkey::VARCHAR || '.txt' ELSE 'none' END AS label_path FROM orders""")
def s19_label_files(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d)
    name = F.concat(F.lit("img"), F.col("k").cast("string"), F.lit(".txt"))
    beside = rows.where("k % 3 = 0").select(F.regexp_replace("path", "jpg$", "txt").alias("path"))
    root = rows.where("k % 3 < 2").select(F.concat(F.lit("pool/labels/"), name).alias("path"))
    scene = rows.where("k % 3 = 1 and k % 4 = 1").select(F.concat(F.lit("pool/Scene-A/labels/"), name).alias("path"))
    return labels.with_label_file(rows, beside.union(root).union(scene), "pool").select("k", F.coalesce("label_path", F.lit("none")).alias("label_path"))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 1 THEN '101010' WHEN p_partkey % 5 = 2 THEN '000111' ELSE '111111' END AS mask FROM part""")
def p20_image_masks(spark: SparkSession, d: str) -> DataFrame:
    """Source 1 has an observed mask, 2 a declared one, 3 none; names of rest 0 have no prefix, 4 an unknown source."""
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.lit("plain.jpg")).otherwise(F.concat(F.when(k % 2 == 0, "src").otherwise("SRC"), (k % 5).cast("string"), F.lit("_a.jpg")))
    masks = spark.createDataFrame([(1, [1, 0, 1, 0, 1, 0], [0] * 6), (2, None, [0, 0, 0, 1, 1, 1]), (3, None, None)], "source int, observed array<int>, declared array<int>")
    rows = labels.source_masks_of(spark.read.parquet(f"{d}/part.parquet").select(k.alias("k"), name.alias("name")), masks)
    return rows.select("k", F.array_join(F.transform("mask", lambda v: v.cast("int").cast("string")), "").alias("mask"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN '4' WHEN 1 THEN '3' WHEN 2 THEN '3,4' WHEN 3 THEN '2,3' WHEN 4 THEN '0,5' WHEN 5 THEN '2' ELSE '' END AS classes FROM part""")
def p22_title_classes(spark: SparkSession, d: str) -> DataFrame:
    titles = ("Kurang_Masak 01", "TBS masak", "kurang  masak dan masak", "terlalu masak", "abnormal_mentah", "OverRipe", "masakan lain")
    k = F.col("p_partkey")
    title = F.element_at(F.array(*[F.lit(t) for t in titles]), (k % 7 + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("k"), F.array_join(names.weak_classes(title).cast("array<string>"), ",").alias("classes"))


# Some originals have the name that a pseudo-labelled image will get, or the one with a number after it.
_OLD = """CASE WHEN o_orderkey % 10 = 1 THEN concat('PSEUDO', CAST((o_orderkey - 1) % 3 + 1 AS STRING), '_img', CAST((o_orderkey - 1) % 5000 AS STRING), '_', CAST(o_orderkey - 1 AS STRING), '.JPG')
WHEN o_orderkey % 10 = 3 THEN concat('pseudo', CAST((o_orderkey - 3) % 3 + 1 AS STRING), '_img', CAST((o_orderkey - 3) % 5000 AS STRING), '_', CAST(o_orderkey - 3 AS STRING), '_1.jpg') ELSE concat('old', CAST(o_orderkey AS STRING), '.jpg') END"""
_BOTH = f"""(SELECT CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, {_OLD} AS name, 0 AS s FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'valid' ELSE 'test' END, 'pseudo' || s::VARCHAR || '_' || name, s FROM (
SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('42:' || s::VARCHAR || ':' || name), s::VARCHAR || ':' || name) AS r, count(*) OVER (PARTITION BY s) AS n FROM
(SELECT o_orderkey % 3 + 1 AS s, 'img' || (o_orderkey % 5000)::VARCHAR || '_' || o_orderkey::VARCHAR || '.jpg' AS name, o_orderkey % 11 AS valid FROM orders WHERE o_orderkey % 2 = 0) p) q WHERE valid > 0)"""


@query(f"SELECT split, sample_name, s > 0 AS pseudo FROM {named_sql(_BOTH, 's, name')} z")
def u02_with_pseudo(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{d}/orders.parquet")
    split = F.when(k % 3 == 0, "train").when(k % 3 == 1, "valid").otherwise("test")
    original = rows.where(k % 2 == 1).select(split.alias("split"), F.expr(_OLD).alias("name"))
    name = F.concat(F.lit("img"), (k % 5000).cast("string"), F.lit("_"), k.cast("string"), F.lit(".jpg"))
    pseudo = rows.where(k % 2 == 0).select((k % 3 + 1).alias("source_idx"), name.alias("name"), (k % 11).alias("valid"))
    return splits.with_pseudo(original, pseudo)


@query(f"""SELECT image_id, pred_idx, CASE WHEN class_id NOT BETWEEN 0 AND 5 THEN 'unknown_class' WHEN pred_idx % 3 = 0 THEN 'low_support' WHEN confidence < 0.68 THEN 'low_quality' WHEN scene % 2 = 0 THEN 'folder_mismatch' ELSE 'none' END AS failure FROM ({_P}) p""")
def p07_first_failure(spark: SparkSession, d: str) -> DataFrame:
    mismatch = F.when(F.col("scene") % 2 == 0, F.array(F.lit("folder_class_mismatch"))).otherwise(F.array().cast("array<string>"))
    rows = fx.predictions(spark, d).withColumns({"support": F.when(F.col("pred_idx") % 3 == 0, 1).otherwise(2), "quality_score": F.col("confidence"), "reasons": mismatch})
    return rows.select("image_id", "pred_idx", F.coalesce(decisions.first_failure(), F.lit("none")).alias("failure"))
