"""Queries of joins, reports and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.operators import joins
from gridlark.plans import fixtures as fx
from gridlark.plans.dataset_queries import ORACLES, QUERIES
from gridlark.plans.queries import _P, _T, query
from gridlark.sources import labels, sinks

__all__ = ["ORACLES", "QUERIES"]

# Two ways to one price, which differ in the last digits, and a shift below or above the tolerance.
_SHIFT = "CASE o_orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0000000005 WHEN 2 THEN -0.0000000006 ELSE 0.000000003 END"


@query(f"""WITH l AS (SELECT o_orderkey AS k, o_totalprice / 7 AS a FROM orders), r AS (SELECT o_orderkey AS j, o_totalprice * 3 / 21 + ({_SHIFT})::DOUBLE AS b FROM orders)
SELECT k, j FROM l JOIN r ON b BETWEEN a - 1 AND a + 1 AND abs(a - b) < 1e-9""")
def j16_within_tolerance(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet")
    l = rows.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 7).alias("a"))  # noqa: E741
    r = rows.select(F.col("o_orderkey").alias("j"), (F.col("o_totalprice") * 3 / 21 + F.expr(_SHIFT).cast("double")).alias("b"))
    return joins.within_tolerance(l, r, "a", "b", 1e-9).select("k", "j")


@query("""WITH l AS (SELECT p_name AS name, l_orderkey * 10 + l_linenumber AS o, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45),
h AS (SELECT p_partkey, row_number() OVER (ORDER BY o, p_partkey) AS place FROM l), f AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place FROM part)
SELECT 'listed' AS way, p_partkey AS k, place FROM h WHERE place <= 40 UNION ALL SELECT 'fallback', p_partkey, place FROM f WHERE place <= 40""")
def j18_first_listed(spark: SparkSession, d: str) -> DataFrame:
    """Parts in the order of a list that names some twice, and of one that names none."""
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    one = lambda listed, way: joins.first_listed(parts, "p_partkey", ["p_partkey"], listed, ["o", "p_partkey"], 40).select(F.lit(way).alias("way"), F.col("p_partkey").alias("k"), F.col("place").cast("long").alias("place"))
    return one(lines, "listed").unionByName(one(lines.withColumn("p_partkey", -F.col("p_partkey") - 1), "fallback"))


# Rows of different keys in different orders; some have a key twice.
@query('''SELECT event_id AS row, CASE event_id % 4 WHEN 0 THEN '"x, ""' || event_id::VARCHAR || '""",' || event_id::VARCHAR || '-a,,' WHEN 1 THEN ',' || event_id::VARCHAR || '-a2,' || event_id::VARCHAR || '-c,' WHEN 2 THEN ',,,' || event_id::VARCHAR || '-d' ELSE ',,,' END AS line,
'b,a,c,d' AS header FROM events''')
def k01_ragged_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of maps as CSV lines under the keys in the order in which they are first seen."""
    k = F.col("event_id").cast("string")
    cell = lambda key, tail: F.struct(F.lit(key).alias("key"), (F.concat(F.lit('x, "'), k, F.lit('"')) if key == "b" else F.concat(k, F.lit(f"-{tail}"))).alias("value"))
    kinds = {0: [("b", ""), ("a", "a")], 1: [("a", "a"), ("c", "c"), ("a", "a2")], 2: [("d", "d")]}
    cells = F.array().cast("array<struct<key:string,value:string>>")
    for rest, found in kinds.items():
        cells = F.when(F.col("event_id") % 4 == rest, F.array(*[cell(*c) for c in found])).otherwise(cells)
    table = sinks.from_ragged(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("row"), cells.alias("cells")))
    keys = table.columns[1:]
    return table.select("row", sinks.csv_line(keys).alias("line"), F.lit(",".join(keys)).alias("header"))


@query(f"""SELECT image_id, gt_idx AS line_no, class_id, round(xc, 6) AS xc, round(w, 6) AS w FROM ({_T}) t WHERE NOT (image_id % 5 = 0 AND gt_idx = 0)""")
def t06_label_function(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of label texts by the SQL function in a lateral join; the first line of every fifth image's text is spoilt."""
    rows = fx.truth(spark, d)
    text = sinks.label_text(rows).withColumn("value", F.when(F.col("image_id") % 5 == 0, F.regexp_replace("text", r"^\S+", "ripe")).otherwise(F.col("text")))
    labels.register_label_boxes(spark)
    found = spark.sql("SELECT image_id, b.* FROM (SELECT image_id, label_boxes(value) AS boxes FROM {files}) f, LATERAL inline_outer(f.boxes) b WHERE b.line_no IS NOT NULL", files=text)
    return found.select("image_id", F.col("line_no").cast("long").alias("line_no"), "class_id", F.round("xc", 6).alias("xc"), F.round("w", 6).alias("w"))


@query(f"""SELECT image_id, class_id, round(greatest(0.40, least(0.85, 0.55 + greatest(0.0, 0.90 - coalesce(ap, 0.90)) * 0.30)), 9) AS threshold
FROM (SELECT image_id, class_id, CASE WHEN count(*) = 1 THEN NULL ELSE min(confidence) * 1.5 - 0.25 END AS ap FROM ({_P}) p GROUP BY image_id, class_id) x""")
def a23_image_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Dynamic thresholds from a precision of each image and class; null where there is a single box."""
    rows = fx.predictions(spark, d).groupBy("image_id", "class_id").agg(F.when(F.count("*") > 1, F.min("confidence") * 1.5 - 0.25).alias("ap"))
    return rows.select("image_id", "class_id", F.round(B.dynamic_threshold(F.col("ap")), 9).alias("threshold"))
