"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are words. Each source gets a share of all words by its weight; a target stops at ``most`` times its
source's size and the excess is shared again by weight until none is above, which is a water level: with sources
sorted by most * size / weight, those below the level are full and the rest share what is left by weight.

A source's target is filled by complete epochs of all its documents first. What is left is taken from the
documents in the order of exponential keys -ln(u) / quality, with u from a hash of the document's id, by a
running sum of sizes up to the budget; the document that crosses the budget is taken if that brings the sum
nearer. Documents are taken whole, so a source ends within half a document of its target.

Null text: size 0, never taken. Null source: a source of its own, last in order. Repeated rows are documents of
their own; rows of one id, or of none, are drawn and ordered by their texts, so that reruns agree and only rows alike
in all that counts are interchangeable. An empty table gives an empty mix. Extra columns don't matter: only the
named ones are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.common import Workspace, doubtful_ids, numbered, ordered_prefix, prepare
from gridlark.tables import fresh

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
SEED = "mix-1"
#: Weight of a document in the draw by its quality label; unlabelled documents weigh 1.
QUALITY_WEIGHT = {1: 2.0, 0: 0.5}


def targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """source, source_size, weight -> and target. One row per source: the windows run over sources, not documents."""
    ratio = F.col("source_size") * most / F.col("weight")
    everything = Window.partitionBy(F.lit(0))
    below = everything.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    df = sources.withColumn("_rank", F.col("rank")).withColumn("_ratio", ratio)
    df = df.withColumn("_all", F.sum("source_size").over(everything).cast("double")).withColumn("_weights", F.sum("weight").over(everything))
    full = F.coalesce(F.sum("source_size").over(below), F.lit(0)) * most
    weight = F.col("_weights") - F.coalesce(F.sum("weight").over(below), F.lit(0))
    df = df.withColumn("_level", (F.col("_all") - full) / weight)
    # the level is that of the first source which it doesn't fill
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(everything)
    df = df.withColumn("_water", level["_level"])
    target = F.when(F.col("_water").isNull(), F.col("source_size") * most).otherwise(F.least(F.col("source_size") * F.lit(float(most)), F.col("_water") * F.col("weight")))
    return df.withColumn("target", target.cast("double")).select(*sources.columns, "target")


def mix(ws: Workspace, docs: DataFrame, weight_of_rank=None, most: float = MOST, seed: str = SEED) -> DataFrame:
    """docs (doc_id, source, size, digest, quality_weight, more) -> and source_size, target, taken.

    weight_of_rank gives a source's weight from its rank (from 1) by code point, null last; 1, 2, 3, repeating.
    """
    weight_of_rank = weight_of_rank or (lambda r: (r - 1) % 3 + 1)
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-:"), F.col("digest").cast("string")))
    uniform = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), own)), 1, 13), 16, 10).cast("double") + 0.5
    rows = docs.withColumn("_u", uniform / float(1 << 52))
    rows = rows.withColumn("_draw", -F.log("_u") / F.col("quality_weight"))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    sizes = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight_of_rank(F.col("rank")).cast("double"))
    goal = ws.table(targets(sizes, most)).select(F.col("source").alias("_source"), "source_size", "target")
    # rows alike in every ordering column are interchangeable copies; the row number only keeps the order total
    order = [F.col("_draw").asc(), F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("digest").asc(), F.col("_tie").asc()]
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    rows = ordered_prefix(ws, rows, order, ["source"], {"_before": "size"})
    joined = rows.join(goal, rows["source"].eqNullSafe(goal["_source"]), "left").drop("_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    epochs = F.least(epochs, F.lit(int(most)))
    joined = joined.withColumn("_epochs", epochs).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    once_more = (F.col("size") > 0) & (F.col("_before") + F.col("size") / 2.0 <= F.col("_rest"))
    taken = F.col("size") * (F.col("_epochs") + F.when(once_more, 1).otherwise(0))
    return joined.withColumn("taken", taken.cast("long")).drop("_u", "_draw", "_tie", "_before", "_epochs", "_rest")


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, quality_weight from labels; of repeated labels the best counts."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"))
    weight = F.coalesce(F.when(F.col("q") == 1, QUALITY_WEIGHT[1]).when(F.col("q") == 0, QUALITY_WEIGHT[0]), F.lit(1.0))
    return best.select("doc_id", weight.alias("quality_weight"))


def sized(docs: DataFrame, labels: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, source, size, digest, quality_weight of whole documents, and key: the column of that name, if one is given."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("digest"), *([F.col(key).alias("key")] if key else []))
    return rows.join(quality_weights(labels), "doc_id", "left").withColumn("quality_weight", F.coalesce("quality_weight", F.lit(1.0)))


def mixed(ws: Workspace, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it."""
    key, copies, copy = fresh(docs.columns, "_key", "_copies", "_copy")
    known = numbered(ws, docs, key) if doubtful_ids(docs) else docs.withColumn(key, F.col("doc_id"))
    taken = mix(ws, sized(known, labels, key)).where("taken > 0")
    taken = ws.table(taken.select(F.col("key").alias(key), F.expr("taken div size").alias(copies)))
    # the taken ids grow with the documents, so they are never broadcast, whatever their size here
    rows = known.join(taken.hint("merge"), key).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    ws = Workspace(spark, "mix")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sized(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(ws, rows).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLES: dict[str, str] = {
    "op2_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), q AS (
  SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS w FROM labels GROUP BY doc_id
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source
), l AS (
  SELECT *, source_size * 3.0::DOUBLE / weight AS ratio,
         (sum(source_size) OVER ()::DOUBLE - 3 * coalesce(sum(source_size) OVER b, 0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY source_size * 3.0::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT arg_min(level, rn) AS level FROM (SELECT *, row_number() OVER (ORDER BY ratio, rank) AS rn FROM l) WHERE level <= ratio
), t AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, coalesce(water.level * weight, source_size * 3.0::DOUBLE)) AS target FROM l, water
), k AS (
  SELECT d.*, -ln((('0x' || substr(md5('mix-1:' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
              / coalesce(q.w, 1.0) AS key
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id
), c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef FROM k
), e AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, c.bef,
         CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 3) ELSE 0 END AS ep
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (ep + CASE WHEN size > 0 AND bef + size / 2.0 <= target - ep * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
"""
}
