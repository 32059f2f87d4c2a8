"""Further queries: sources and projections, caps and samples, set operations, and the self-training loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.functions import catalog, hashes, names
from gridlark.operators import duplicates, matching, profile, rollups, splits
from gridlark.plans import fixtures as fx
from gridlark.plans import self_training
from gridlark.plans.queries import _CURVE, _EXPECTED, _IOUS, _P, _SUPPORT, _T, ORACLES, PLANTED, QUERIES, _greedy, planted_hashes, query
from gridlark.sources import labels, sinks

__all__ = ["ORACLES", "QUERIES"]

_FOLDERS = "CASE o_orderkey % 5 WHEN 0 THEN 'Under Ripe' WHEN 1 THEN 'masak' WHEN 2 THEN 'flower' WHEN 3 THEN 'misc' ELSE 'empty-bunch' END"
_FILES = f"(SELECT o_orderkey AS k, 'pool/' || CASE o_orderkey % 4 WHEN 0 THEN 'FFBtest' WHEN 1 THEN 'my_train' WHEN 2 THEN 'latest' ELSE 'valid-set' END || '/' || {_FOLDERS} || '/IMG_' || o_orderkey::VARCHAR || '.jpg' AS path FROM orders)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    folder = F.when(k % 4 == 0, "FFBtest").when(k % 4 == 1, "my_train").when(k % 4 == 2, "latest").otherwise("valid-set")
    path = F.concat(F.lit("pool/"), folder, F.lit("/"), F.expr(_FOLDERS), F.lit("/IMG_"), k.cast("string"), F.lit(".jpg"))
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("k"), path.alias("path"))


@query(f"SELECT k, CASE k % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 4 THEN 1 ELSE -1 END AS expected FROM {_FILES} f")
def p02_expected_class(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("k", catalog.class_id(names.parent(F.col("path")), -1).alias("expected"))


@query(f"SELECT k, CASE k % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS class_id, 0.5::DOUBLE AS xc, 1.0::DOUBLE AS w FROM {_FILES} f WHERE k % 5 IN (0, 1, 4)")
def s09_class_folders(spark: SparkSession, d: str) -> DataFrame:
    return labels.class_folders(_files(spark, d)).select("k", "class_id", "xc", "w")


@query(f"SELECT k, CASE k % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'train' WHEN 2 THEN 'test' ELSE 'valid' END AS split FROM {_FILES} f")
def s08_folder_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _files(spark, d)
    return rows.select("k", labels.darknet_split(F.get(names.parts(F.col("path")), F.lit(1))).alias("split"))


@query(f"SELECT k, CASE k % 5 WHEN 0 THEN 3 WHEN 4 THEN 1 ELSE -1 END AS path_class, CASE k % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'unknown' END AS split FROM {_FILES} f")
def s16_path_class_and_split(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return _files(spark, d).select("k", F.coalesce(names.path_class(path), F.lit(-1)).alias("path_class"), names.path_split(path).alias("split"))


@query(f"SELECT k FROM {_FILES} f WHERE k % 100 < 3")
def s15_official_list(spark: SparkSession, d: str) -> DataFrame:
    rows = _files(spark, d)
    listed = rows.where("k % 100 < 3").select(F.upper(names.file_name(F.col("path"))).alias("value"))
    return labels.official_list(rows, listed.unionByName(listed)).select("k")


@query(f"SELECT k FROM {_FILES} f WHERE k % 50 NOT IN (7, 9)")
def s17_without_rejected(spark: SparkSession, d: str) -> DataFrame:
    rows = _files(spark, d)
    by_name = rows.where("k % 50 = 7").select(F.concat(names.file_name(F.col("path")), F.lit("  # blurred")).alias("value"))
    by_stem = rows.where("k % 50 = 9").select(names.stem(F.col("path")).alias("value"))
    return labels.without_rejected(rows, by_name.unionByName(by_stem)).select("k")


@query(f"SELECT image_id, CASE WHEN bool_or(class_id = 4) THEN 'positive' WHEN bool_or(class_id = 3) THEN 'ripe_boundary' ELSE 'unripe_boundary' END AS boundary FROM ({_T}) t GROUP BY image_id HAVING bool_or(class_id IN (3, 4, 5))")
def p13_boundary_groups(spark: SparkSession, d: str) -> DataFrame:
    has = lambda c: F.max(F.col("class_id") == c)
    rows = fx.truth(spark, d).groupBy("image_id").agg(*[has(c).alias(f"has_{c}") for c in (3, 4, 5)])
    kind = F.when(F.col("has_4"), "positive").when(F.col("has_3"), "ripe_boundary").when(F.col("has_5"), "unripe_boundary")
    return rows.select("image_id", kind.alias("boundary")).where("boundary is not null")


@query(f"SELECT class_id, count(*)::BIGINT AS n FROM ({_P}) p WHERE confidence >= CASE class_id WHEN 0 THEN 0.3 WHEN 3 THEN 0.6 ELSE 1.0 END GROUP BY class_id")
def p10_class_thresholds(spark: SparkSession, d: str) -> DataFrame:
    floor = F.create_map(F.lit(0), F.lit(0.3), F.lit(3), F.lit(0.6))
    rows = fx.predictions(spark, d).where(F.col("confidence") >= F.coalesce(floor[F.col("class_id")], F.lit(1.0)))
    return rows.groupBy("class_id").agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT image_id, pred_idx, class_id, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, pred_idx) AS r FROM ({_P}) p),
b AS (SELECT image_id, class_id, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, pred_idx) AS r FROM ({_P}) p WHERE class_id <> 1)
SELECT a.image_id, CASE a.class_id WHEN 4 THEN 5 ELSE a.class_id END AS top_then_map, coalesce(b.class_id, -1) AS map_then_top FROM a LEFT JOIN b ON a.image_id = b.image_id AND b.r = 1 WHERE a.r = 1""")
def p04_remap_order(spark: SparkSession, d: str) -> DataFrame:
    """The best box first and its class mapped after, against unmapped classes dropped first."""
    p = fx.predictions(spark, d)
    top = matching.top_per_image(p).select("image_id", F.when(F.col("class_id") == 4, 5).otherwise(F.col("class_id")).alias("top_then_map"))
    other = matching.top_per_image(p.where("class_id <> 1")).select("image_id", F.col("class_id").alias("map_then_top"))
    return top.join(other, "image_id", "left").withColumn("map_then_top", F.coalesce("map_then_top", F.lit(-1)))


@query("SELECT event_type, arg_max(event_id, (ts, event_id))::BIGINT AS last_id FROM events GROUP BY event_type")
def w11_last_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


@query("SELECT o_orderkey, o_orderpriority AS stage FROM orders WHERE o_orderpriority LIKE '%MEDIUM%' ORDER BY o_orderkey DESC LIMIT 1")
def p15_last_stage(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("stage"))
    return rollups.last_stage(rows, "MEDIUM", "o_orderkey")


@query(f"SELECT scene, count(DISTINCT image_id)::BIGINT AS images, count(*)::BIGINT AS boxes FROM ({_T}) t WHERE scene <> 3 GROUP BY scene")
def p17_scenes_held_out(spark: SparkSession, d: str) -> DataFrame:
    return fx.truth(spark, d).where("scene <> 3").groupBy("scene").agg(F.countDistinct("image_id").alias("images"), F.count("*").alias("boxes"))


@query(f"SELECT scene, string_agg(m::VARCHAR, '' ORDER BY i) AS mask FROM (SELECT s.scene, i, max(CASE WHEN t.class_id = i THEN 1 ELSE 0 END) AS m FROM (SELECT DISTINCT scene FROM ({_T}) x WHERE gt_idx = 0) s JOIN ({_T}) t ON t.scene = s.scene, range(0, 6) r(i) GROUP BY s.scene, i) q GROUP BY scene")
def a04_source_masks(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.truth(spark, d).select(F.col("scene").alias("source"), "class_id")
    return rollups.source_masks(rows).where("kind = 'source'").select(F.col("source").alias("scene"), F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"))


# Scenes lack classes by formula, no scene shows class 5, and scenes 0 to 4 and 9 (which has no box) declare classes.
_OBSERVED = "class_id <> 5 AND (class_id + scene) % 4 <> 0"


@query(f"""WITH o AS (SELECT DISTINCT scene, class_id FROM ({_T}) t WHERE {_OBSERVED}), s AS (SELECT unnest([0, 1, 2, 3, 4, 9]) AS scene),
d AS (SELECT scene, c AS class_id FROM s, range(0, 5) r(c) WHERE (c + scene) % 3 <> 0), a AS (SELECT scene FROM o UNION SELECT scene FROM s),
b AS (SELECT a.scene, i, EXISTS (SELECT 1 FROM o WHERE o.scene = a.scene AND o.class_id = i) AS seen, CASE WHEN a.scene IN (SELECT scene FROM s) THEN EXISTS (SELECT 1 FROM d WHERE d.scene = a.scene AND d.class_id = i) ELSE EXISTS (SELECT 1 FROM o WHERE o.scene = a.scene AND o.class_id = i) END AS said FROM a, range(0, 6) r(i)),
u AS (SELECT scene, 'source' AS kind, i, seen, said FROM b UNION ALL SELECT -1, 'combined', i, bool_or(seen), bool_or(said) FROM b GROUP BY i)
SELECT scene::BIGINT AS scene, kind, string_agg(seen::INT::VARCHAR, '' ORDER BY i) AS observed, string_agg(said::INT::VARCHAR, '' ORDER BY i) AS mask FROM u GROUP BY scene, kind""")
def a04_merged_masks(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.truth(spark, d).where(_OBSERVED).select(F.col("scene").cast("bigint").alias("source"), "class_id")
    declared = spark.createDataFrame([(s, [c for c in range(5) if (c + s) % 3]) for s in (0, 1, 2, 3, 4, 9)], "source bigint, classes array<int>")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "").alias(c)
    return rollups.source_masks(rows, declared).select(F.coalesce("source", F.lit(-1)).cast("bigint").alias("scene"), "kind", text("observed"), text("mask"))


@query("SELECT s.c AS class_id, round(greatest(0.40, least(0.85, 0.55 + greatest(0.0, 0.90 - coalesce(ap, 0.90)) * 0.30)), 9) AS threshold FROM (VALUES (0, 0.4::DOUBLE), (1, 0.95::DOUBLE), (2, NULL), (3, -2.0::DOUBLE)) s(c, ap)")
def a23_dynamic_thresholds(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(0, 0.4), (1, 0.95), (2, None), (3, -2.0)], "class_id int, ap double")
    return rows.select("class_id", F.round(B.dynamic_threshold(F.col("ap")), 9).alias("threshold"))


@query(f"""WITH m AS (SELECT scene, image_id, round_even(avg(confidence), 9) AS mean FROM ({_P}) p GROUP BY scene, image_id),
r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY mean DESC, image_id) AS r FROM m WHERE mean >= 0.72) SELECT scene, image_id FROM r WHERE r <= 250""")
def w06_scene_quota(spark: SparkSession, d: str) -> DataFrame:
    mean = fx.predictions(spark, d).groupBy("scene", "image_id").agg(F.bround(F.avg("confidence"), 9).alias("mean")).where("mean >= 0.72")
    return splits.capped_per_group(mean, ["scene"], [F.col("mean").desc(), F.col("image_id")], 250).select("scene", "image_id")


@query(f"""WITH r AS (SELECT class_id, scene, image_id, pred_idx, row_number() OVER (PARTITION BY class_id, scene ORDER BY confidence DESC, image_id, pred_idx) AS r FROM ({_P}) p) SELECT class_id, scene, image_id, pred_idx FROM r WHERE r <= 20""")
def w08_category_caps(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.predictions(spark, d)
    return splits.capped_per_group(rows, ["class_id", "scene"], [F.col("confidence").desc(), F.col("image_id"), F.col("pred_idx")], 20).select("class_id", "scene", "image_id", "pred_idx")


@query(f"SELECT image_id, gt_idx, c::INT AS copy FROM ({_T}) t, range(0, 3) r(c) WHERE class_id = 4")
def l09_replicated(spark: SparkSession, d: str) -> DataFrame:
    return splits.replicate(fx.truth(spark, d).where("class_id = 4").select("image_id", "gt_idx"), 3)


@query("SELECT p_partkey AS k, array_to_string(list_distinct([round_even(p_size * (1 - 0.8::DOUBLE) / 2 + ((p_size - 1) - p_size * (1 - 0.8::DOUBLE) / 2 - p_size * (1 - 0.8::DOUBLE) / 2) * i / 4, 0)::INT FOR i IN range(0, 5)]).list_sort(), ',') AS indices FROM part WHERE p_size >= 5")
def l12_even_indices(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    rows = spark.read.parquet(f"{d}/part.parquet").where("p_size >= 5")
    return rows.select(F.col("p_partkey").alias("k"), F.array_join(F.array_sort(splits.even_indices(size, 5)).cast("array<string>"), ",").alias("indices"))


@query("SELECT 0 AS source_idx, 'src0_' || s_name AS sample_name FROM supplier UNION ALL SELECT 1, 'src1_' || c_name FROM customer")
def u01_sources_united(spark: SparkSession, d: str) -> DataFrame:
    a = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("name"))
    b = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"))
    return profile.sources_united(a, b).select("source_idx", "sample_name")


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 1")
def u05_split_leakage(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("k"))
    return duplicates.leakage(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), "k")


@query("SELECT doc_id AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j01_images_without_labels(spark: SparkSession, d: str) -> DataFrame:
    images = spark.read.parquet(f"{d}/documents.parquet").select(F.lit("all").alias("split"), F.col("doc_id").alias("stem"))
    marks = spark.read.parquet(f"{d}/labels.parquet").select(F.lit("all").alias("split"), F.col("doc_id").alias("stem"))
    return profile.unpaired(images, marks)[0].select(F.col("stem").alias("image_id"))


@query("SELECT s_name AS name, s_acctbal AS balance, '' AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def k01_union_of_columns(spark: SparkSession, d: str) -> DataFrame:
    a = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return sinks.union_of_columns(a, b).fillna("", ["segment"])


_BITS = "list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + {o}] > 0 THEN (1::BIGINT << i::INT) ELSE 0 END))::BIGINT"


@query(f"""WITH h AS (SELECT *, 'k' || (vec_id // 3)::VARCHAR AS base FROM ({PLANTED}) x)
SELECT DISTINCT a.vec_id AS image_id, b.vec_id AS reference_id, 'name' AS kind, true AS verified FROM h a JOIN h b ON a.base = b.base WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1
UNION SELECT a.vec_id, b.vec_id, 'hash', a.label + 1 = b.label FROM h a JOIN h b ON bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)) <= 5 WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1""")
def j13_reference_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = planted_hashes(spark, d).withColumn("base", F.concat(F.lit("k"), F.floor(F.col("image_id") / 3).cast("string")))
    own = rows.where("image_id % 2 = 0").withColumn("digest", F.col("label") + 1)
    other = rows.where("image_id % 2 = 1").withColumn("digest", F.col("label"))
    return duplicates.against_reference(own, other, ["h0", "h1"], 5, verify_digest="digest")


# Pictures of 16 rows of 17 grey values drawn from an embedding; the reference has them encoded anew, in coarse steps, and
# its digests agree for every fifth.
_GREY = "list_transform(range(0, 272), lambda k: floor(embedding[k % 64 + 1]::DOUBLE * {s})::BIGINT)"
_STEP = "CASE vec_id % 4 WHEN 0 THEN 2000 WHEN 1 THEN 200 WHEN 2 THEN 40 ELSE 4 END"


@query(f"""WITH e AS (SELECT vec_id, embedding, 'k' || (vec_id // 3)::VARCHAR AS base, {_BITS.format(o=1)} AS h0, {_BITS.format(o=33)} AS h1 FROM embeddings),
a AS (SELECT vec_id, base, h0, h1, {_GREY.format(s=2000)} AS g FROM e WHERE vec_id % 2 = 0), b AS (SELECT vec_id, base, h0, h1, {_GREY.format(s=_STEP)} AS g FROM e),
c AS (SELECT a.vec_id AS image_id, b.vec_id AS reference_id, a.vec_id = b.vec_id AND a.vec_id % 5 = 0 AS same,
list_sum(list_transform(range(0, 256), lambda k: CASE WHEN (a.g[k + k // 16 + 1] > a.g[k + k // 16 + 2]) <> (b.g[k + k // 16 + 1] > b.g[k + k // 16 + 2]) THEN 1 ELSE 0 END)) AS far
FROM a JOIN b ON bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)) <= 5)
SELECT DISTINCT a.vec_id AS image_id, b.vec_id AS reference_id, 'name' AS kind, true AS verified FROM a JOIN b ON a.base = b.base
UNION SELECT image_id, reference_id, 'hash', same OR far <= 10 FROM c""")
def j13_verified_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Hash matches verified by equal digests or by the difference hash."""
    limbs = [f"d{i}" for i in range(8)]
    h0, h1 = hashes.sign_hash(F.col("embedding"))
    base = F.concat(F.lit("k"), F.floor(F.col("vec_id") / 3).cast("string"))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "vec_id", "embedding", base.alias("base"), h0.alias("h0"), h1.alias("h1"))
    grey = lambda s: F.transform(F.sequence(F.lit(0), F.lit(271)), lambda k: F.floor(F.get("embedding", k % 64).cast("double") * s))
    hashed = lambda r, s: r.withColumn("_grey", grey(s)).withColumns(dict(zip(limbs, hashes.difference_hash(F.col("_grey")), strict=True)))
    own = hashed(rows.where("vec_id % 2 = 0"), F.lit(2000)).withColumn("digest", F.col("vec_id"))
    other = hashed(rows, F.expr(_STEP)).withColumn("digest", F.when(F.col("vec_id") % 5 == 0, F.col("vec_id")))
    return duplicates.against_reference(own, other, ["h0", "h1"], 5, verify_digest="digest", verify_limbs=limbs)


@query(f"SELECT image_id, gt_idx, greatest(0, least(639, trunc((xc - w / 2) * 640)::INT)) AS x1, greatest(0, least(479, trunc((yc - h / 2) * 480)::INT)) AS y1 FROM ({_T}) t")
def f13_pixel_corners(spark: SparkSession, d: str) -> DataFrame:
    at = B.pixels(B.box(), F.lit(640), F.lit(480))
    return fx.truth(spark, d).select("image_id", "gt_idx", at[0].alias("x1"), at[1].alias("y1"))


def _ap(found: str) -> str:
    """Mean average precision of each class over the overlap thresholds."""
    return f"""(WITH RECURSIVE {_greedy(thresholds=_IOUS, where="class_id IN (0, 3, 4, 5)", found=found)}, {_CURVE.format(thr=_IOUS)} SELECT class_id, avg(ap) AS ap FROM ap GROUP BY class_id)"""


def _accepted(ap: str) -> str:
    """What the thresholds that follow from the average precision accept."""
    return f"""(SELECT * FROM (SELECT ps.*, 0.42::DOUBLE * least(1.0, confidence / threshold)
      + 0.25::DOUBLE * (0.7::DOUBLE * CASE WHEN w * h < 0.0005 THEN w * h / 0.0005 WHEN w * h > 0.7 THEN greatest(0.0, 1 - (w * h - 0.7) / 0.7) ELSE 1.0 END + 0.3::DOUBLE * greatest(0.0, 1 - (greatest(w / h, h / w) - 1) / 5.0))
      + 0.15::DOUBLE * CASE WHEN xc - w / 2 < 0.002 OR yc - h / 2 < 0.002 OR xc + w / 2 > 0.998 OR yc + h / 2 > 0.998 THEN 0.0 ELSE 1.0 END
      + 0.18::DOUBLE * CASE WHEN ({_EXPECTED}) IS NULL THEN 0.75 WHEN ({_EXPECTED}) = ps.class_id THEN 1.0 ELSE 0.0 END AS quality
      FROM ps JOIN (SELECT c.class_id, round(greatest(0.40::DOUBLE, least(0.85::DOUBLE, 0.55::DOUBLE + greatest(0.0::DOUBLE, 0.90::DOUBLE - coalesce(a.ap, 0.0::DOUBLE)) * 0.30::DOUBLE)), 9) AS threshold FROM (VALUES (0), (3), (4), (5)) c(class_id) LEFT JOIN {ap} a ON a.class_id = c.class_id) th ON th.class_id = ps.class_id) q
      WHERE support >= 2 AND quality >= 0.72 AND coalesce(({_EXPECTED}) = class_id, true))"""


@query(f"""WITH {_SUPPORT}, a0 AS MATERIALIZED {_ap(_P)}, d0 AS MATERIALIZED {_accepted("a0")}, a1 AS MATERIALIZED {_ap("SELECT * FROM d0")}, d1 AS MATERIALIZED {_accepted("a1")}
SELECT 0 AS round, image_id, pred_idx, class_id, round(quality + 1e-10, 6) AS quality_score FROM d0 UNION ALL SELECT 1, image_id, pred_idx, class_id, round(quality + 1e-10, 6) FROM d1""")
def t02_self_training(spark: SparkSession, d: str) -> DataFrame:
    rows = matching.view_support(fx.predictions(spark, d), fx.views(spark, d)).withColumn("expected", F.expr(_EXPECTED))
    found = self_training.rounds(rows, fx.truth(spark, d), catalog.EVALUATED)
    return found.withColumn("quality_score", F.round(F.col("quality_score") + 1e-10, 6))
