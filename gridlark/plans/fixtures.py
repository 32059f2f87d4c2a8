"""Detection tables derived from the driver's tables by integer formulas. The texts are SQL for the oracle and for Spark; predictions and
views are made by Spark in one pass over the ordered lines of an image, where their texts take a pass for each of their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = """
SELECT *, l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS idx
FROM {lineitem}
"""
_X = "(pk * 37 + sk * 11) % 801 + 100"
_Y = "(pk * 53 + sk * 29) % 801 + 100"
_SIZE = "CAST((pk * 17) % 151 + 50 AS DOUBLE) / 1000 AS w, CAST((sk * 19) % 151 + 50 AS DOUBLE) / 1000 AS h"
_SPLIT = "CASE WHEN l_orderkey % 2 = 0 THEN 'calibration' ELSE 'locked_final_test' END AS split, sk % 7 AS scene"
_PREDICTED = "CAST(CASE WHEN (pk + sk) % 10 < 7 THEN pk % 6 ELSE (pk + 1) % 6 END AS INT)"
_CONFIDENCE = "CAST((pk * 7919 + sk * 104729 + ln * 31) % 1000 AS DOUBLE) / 1000"

TRUTH = f"""
SELECT l_orderkey AS image_id, idx AS gt_idx, CAST(pk % 6 AS INT) AS class_id,
       CAST({_X} AS DOUBLE) / 1000 AS xc, CAST({_Y} AS DOUBLE) / 1000 AS yc, {_SIZE}, {_SPLIT}
FROM ({_ROWS}) r
"""
PREDICTIONS = f"""
SELECT l_orderkey AS image_id, idx * 2 AS pred_idx, {_PREDICTED} AS class_id,
       CAST({_X} + (sk * 13) % 41 - 20 AS DOUBLE) / 1000 AS xc, CAST({_Y} + (pk * 7) % 31 - 15 AS DOUBLE) / 1000 AS yc,
       {_SIZE}, {_CONFIDENCE} AS confidence, {_SPLIT}
FROM ({_ROWS}) r WHERE ln <> 7
UNION ALL
SELECT l_orderkey, idx * 2 + 1, CAST(pk % 6 AS INT),
       CAST({_X} + (sk * 5) % 23 - 11 AS DOUBLE) / 1000, CAST({_Y} AS DOUBLE) / 1000, {_SIZE},
       CAST((pk * 31 + sk * 17) % 500 AS DOUBLE) / 1000, {_SPLIT}
FROM ({_ROWS}) r WHERE pk % 11 = 0
"""
VIEWS = "\nUNION ALL\n".join(
    f"""
SELECT l_orderkey AS image_id, {k} AS view_id, idx * 2 AS pred_idx, {_PREDICTED} AS class_id,
       CAST({_X} + (sk * 13) % 41 - 20 + (sk * {13 + k}) % 61 - 30 AS DOUBLE) / 1000 AS xc,
       CAST({_Y} + (pk * 7) % 31 - 15 AS DOUBLE) / 1000 AS yc, {_SIZE}
FROM ({_ROWS}) r WHERE ln <> 7 AND (pk + {k}) % 5 <> 0"""
    for k in range(1, 5)
)
#: File-like names over documents, for the name functions.
NAMES = """
SELECT doc_id AS image_id, source AS dataset,
       concat('root/', lang, '/', CASE WHEN doc_id % 2 = 0 THEN 'Clip' ELSE 'src1_Clip-' END, CAST(doc_id % 97 AS VARCHAR(9)),
              CASE doc_id % 5 WHEN 0 THEN '_IMG_003' WHEN 1 THEN '--22x' WHEN 2 THEN '_jpg.rf.ab' WHEN 3 THEN 'frame-12' ELSE '' END, '.JPG') AS path
FROM {documents}
"""
#: Label lines with every kind of defect.
LINES = """
SELECT l_orderkey AS image_id, CAST(l_linenumber AS INT) AS line_no,
       CASE l_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'x .5 .5 .2 .2' WHEN 2 THEN '9 0.5 0.5 0.2 0.2' WHEN 3 THEN '3 1.2 0.5 0.2 0.2'
            WHEN 4 THEN '3.9 0.5 0.5 0.2 0.2' WHEN 5 THEN '4 0.5 0.5 0 0.2' WHEN 6 THEN ' 5  0.25 0.5 0.125 0.25 ' WHEN 7 THEN '0 0.5 0.5 0.5' ELSE '0 0.5 0.25 0.5 0.5' END AS line
FROM {lineitem}
"""


def plain(sql: str) -> str:
    """The text for an engine that has the tables by name."""
    return sql.replace("{lineitem}", "lineitem").replace("{documents}", "documents")


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("lineitem", "documents") if f"{{{n}}}" in sql]
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


# Fixed value: lines of a part. Parts follow the number of lines, so what a task holds of the rows made from its lines doesn't grow with the table.
_LINES_OF_PART = 250_000


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with their place in their image, whole images to a part; what is joined or grouped by image alone is shuffled no more."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = lines.count() // _LINES_OF_PART + 1  # from the files' footers
    return spark.sql(_ROWS, lineitem=lines.repartition(parts, "l_orderkey"))


def _made(rows: DataFrame, columns: str) -> DataFrame:
    return rows.sparkSession.sql(f"SELECT {columns} FROM {{rows}}", rows=rows)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(_rows(spark, sf_dir), f"l_orderkey AS image_id, idx AS gt_idx, CAST(pk % 6 AS INT) AS class_id, CAST({_X} AS DOUBLE) / 1000 AS xc, CAST({_Y} AS DOUBLE) / 1000 AS yc, {_SIZE}, {_SPLIT}")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As PREDICTIONS: up to two boxes (n = 0, 1) of each line."""
    rows = _rows(spark, sf_dir).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).where("CASE n WHEN 0 THEN ln <> 7 ELSE pk % 11 = 0 END")
    xc = f"CAST({_X} + CASE n WHEN 0 THEN (sk * 13) % 41 - 20 ELSE (sk * 5) % 23 - 11 END AS DOUBLE) / 1000 AS xc"
    yc = f"CAST({_Y} + CASE n WHEN 0 THEN (pk * 7) % 31 - 15 ELSE 0 END AS DOUBLE) / 1000 AS yc"
    confidence = f"CASE n WHEN 0 THEN {_CONFIDENCE} ELSE CAST((pk * 31 + sk * 17) % 500 AS DOUBLE) / 1000 END AS confidence"
    return _made(rows, f"l_orderkey AS image_id, idx * 2 + n AS pred_idx, CASE n WHEN 0 THEN {_PREDICTED} ELSE CAST(pk % 6 AS INT) END AS class_id, {xc}, {yc}, {_SIZE}, {confidence}, {_SPLIT}")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As VIEWS: up to four boxes (k = 1 .. 4) of each line."""
    rows = _rows(spark, sf_dir).where("ln <> 7").withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(1, 5)]))).where("(pk + k) % 5 <> 0")
    xc = f"CAST({_X} + (sk * 13) % 41 - 20 + (sk * (13 + k)) % 61 - 30 AS DOUBLE) / 1000 AS xc"
    return _made(rows, f"l_orderkey AS image_id, k AS view_id, idx * 2 AS pred_idx, {_PREDICTED} AS class_id, {xc}, CAST({_Y} + (pk * 7) % 31 - 15 AS DOUBLE) / 1000 AS yc, {_SIZE}")
