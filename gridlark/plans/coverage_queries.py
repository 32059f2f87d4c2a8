"""Further queries of operators over the tables: joins of reports, counts, caps, set operations, parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.functions import names, overrides
from gridlark.operators import duplicates, matching, profile, rollups, splits
from gridlark.plans import fixtures as fx
from gridlark.plans.queries import _BEST, _P, _T, _truth, query
from gridlark.plans.report_queries import ORACLES, QUERIES
from gridlark.plans.source_queries import _images
from gridlark.sources import pool, sinks
from gridlark.tables import shared_dir

__all__ = ["ORACLES", "QUERIES"]


@query("""WITH s AS (SELECT o_custkey % 5 AS seed, o_orderpriority AS stage, round(avg(o_totalprice), 4) AS map50 FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL),
l AS (SELECT o_custkey % 5 AS seed, o_orderpriority AS stage, round(avg(o_totalprice), 4) AS map50, count(*) AS images FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey % 5 <> 2 GROUP BY ALL)
SELECT seed, stage, s.map50 AS scene_map50, l.map50 AS locked_map50, l.images AS locked_images FROM s JOIN l USING (seed, stage)""")
def j14_seed_results(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").withColumns({"seed": F.col("o_custkey") % 5, "stage": F.col("o_orderpriority")})
    mean = F.round(F.avg("o_totalprice"), 4).alias("map50")
    scene = rows.where("o_orderkey % 3 = 0").groupBy("seed", "stage").agg(mean)
    locked = rows.where("o_orderkey % 3 = 1 and seed <> 2").groupBy("seed", "stage").agg(mean, F.count("*").alias("images"))
    return rollups.seed_results(scene, locked)


@query("""WITH c AS (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, g) AS r, count(*) OVER () AS k FROM c),
s AS (SELECT g, CASE WHEN r > k - greatest(1, round_even(k * 0.25, 0)) THEN 'test' WHEN r > k - greatest(1, round_even(k * 0.25, 0)) - greatest(1, round_even(k * 0.15, 0)) THEN 'valid' ELSE 'train' END AS split FROM r)
SELECT c_custkey AS k, split FROM customer JOIN s ON g = c_nationkey""")
def j17_with_split(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"))
    return splits.with_split(rows, splits.group_split(rows, "g"), "g").select("k", "split")


@query(f"""WITH a AS (SELECT image_id, count(*) AS n, max(confidence) AS top, string_agg(class_id::VARCHAR, ',' ORDER BY confidence DESC, pred_idx) AS classes FROM ({_P}) p WHERE confidence >= 0.4 GROUP BY image_id),
b AS (SELECT image_id, count(*) AS n, max(confidence) AS top, string_agg(class_id::VARCHAR, ',' ORDER BY confidence DESC, pred_idx) AS classes FROM ({_P}) p WHERE pred_idx % 2 = 1 GROUP BY image_id)
SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.n, 0)::BIGINT AS first_boxes, coalesce(b.n, 0)::BIGINT AS second_boxes, coalesce(a.classes, '') AS first_classes, coalesce(b.classes, '') AS second_classes FROM a FULL JOIN b ON a.image_id = b.image_id""")
def j19_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    p = fx.predictions(spark, d)
    return matching.side_by_side(p.where("confidence >= 0.4"), p.where("pred_idx % 2 = 1"))


@query("""WITH b AS (SELECT s_suppkey AS k, 'm' || (s_suppkey % 40)::VARCHAR AS model FROM supplier), e AS (SELECT 'm' || (s_suppkey % 40)::VARCHAR AS model, count(*) AS runs, round(max(s_acctbal), 2) AS best FROM supplier WHERE s_suppkey % 40 < 30 GROUP BY 1),
c AS (SELECT 'm' || (c_custkey % 40)::VARCHAR AS model, count(*) AS calibrated FROM customer WHERE c_custkey % 40 > 10 GROUP BY 1)
SELECT k, model, coalesce(runs, -1)::BIGINT AS runs, coalesce(best, -1.0) AS best, coalesce(calibrated, -1)::BIGINT AS calibrated FROM b LEFT JOIN e USING (model) LEFT JOIN c USING (model)""")
def j21_joined_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of models, whose names carry a seed in the runs, beside each other; missing ones are -1."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    runs = s.withColumn("run", F.concat(F.lit("m"), (F.col("s_suppkey") % 40).cast("string"), F.lit("_seed"), F.col("s_suppkey").cast("string")))
    base = runs.select(F.col("s_suppkey").alias("k"), rollups.without_seed("run").alias("model"))
    external = runs.where("s_suppkey % 40 < 30").groupBy(rollups.without_seed("run").alias("model")).agg(F.count("*").alias("runs"), F.round(F.max("s_acctbal"), 2).alias("best"))
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 40 > 10")
    calibration = c.groupBy(F.concat(F.lit("m"), (F.col("c_custkey") % 40).cast("string")).alias("model")).agg(F.count("*").alias("calibrated"))
    out = rollups.joined_reports(base, external, calibration)
    return out.select("k", "model", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("runs", "best", "calibrated")])


_CASES = f"""WITH {_BEST}, im AS (SELECT DISTINCT image_id FROM t), fp AS (SELECT bo.*, CASE WHEN im.image_id IS NULL THEN 'no_ground_truth' WHEN any_iou >= 0.5 THEN 'class_confusion' WHEN any_iou >= 0.1 THEN 'localization' ELSE 'background' END AS category
FROM bo LEFT JOIN im ON bo.image_id = im.image_id WHERE same_iou < 0.5)"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return matching.false_positives(fx.predictions(spark, d), _truth(spark, d))


@query(f"{_CASES} SELECT coalesce(category, 'all') AS category, coalesce(class_id, -1) AS class_id, count(*)::BIGINT AS n FROM fp GROUP BY GROUPING SETS ((category, class_id), (category), ())")
def a20_case_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.counted(_cases(spark, d), "category", "class_id").select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("class_id", F.lit(-1)).alias("class_id"), "n")


@query(f"""{_CASES}, o AS (SELECT fp.image_id, fp.pred_idx, fp.category, row_number() OVER (PARTITION BY fp.category ORDER BY fp.confidence DESC, round(fp.any_iou, 9) DESC, fp.image_id, fp.pred_idx) AS r FROM fp) SELECT image_id, pred_idx, category FROM o WHERE r <= 30""")
def w07_capped_cases(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("confidence").desc(), F.round("any_iou", 9).desc(), F.col("image_id"), F.col("pred_idx")]
    return splits.capped_per_group(_cases(spark, d), ["category"], order, 30).select("image_id", "pred_idx", "category")


@query(f"{_CASES} SELECT image_id, pred_idx, category FROM fp ORDER BY confidence DESC, image_id, pred_idx LIMIT 25")
def l02_top_cases(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).orderBy(F.col("confidence").desc(), "image_id", "pred_idx").limit(25).select("image_id", "pred_idx", "category")


@query(f"SELECT max(n)::BIGINT AS target FROM (SELECT class_id, count(DISTINCT image_id) AS n FROM ({_T}) t GROUP BY class_id) x")
def a24_oversample_target(spark: SparkSession, d: str) -> DataFrame:
    return profile.oversample_target(fx.truth(spark, d))


@query("SELECT doc_id::VARCHAR AS path, strlen(coalesce(text, ''))::BIGINT AS length, sha256(coalesce(text, '')) AS sha256 FROM documents")
def a26_checksums(spark: SparkSession, d: str) -> DataFrame:
    content = F.coalesce("text", F.lit("")).cast("binary")
    files = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return sinks.checksums(files)


@query("""WITH p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 2), r AS (SELECT k, row_number() OVER (ORDER BY md5('7:' || k::VARCHAR), k) AS r, count(*) OVER () AS n FROM p)
SELECT k, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM r""")
def u03_pooled_again(spark: SparkSession, d: str) -> DataFrame:
    """The rows of old splits in one pool, split anew."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    old = {s: rows.where(f"k % 3 = {i}") for i, s in enumerate(("train", "valid", "test"))}
    return splits.ratio_split(splits.pooled(old).drop("split"), "k", 7)


@query("SELECT DISTINCT c_nationkey * 2 AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier")
def u04_unknown_keys(spark: SparkSession, d: str) -> DataFrame:
    used = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 9000").select((F.col("c_nationkey") * 2).alias("k"))
    return duplicates.unknown(used, spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_suppkey FROM lineitem")
def u06_distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey").distinct()


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'train' ELSE 'valid' END AS split FROM orders WHERE o_orderkey % 3 < 2")
def u07_mined_splits(spark: SparkSession, d: str) -> DataFrame:
    """Train and valid are mined, test never."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    return splits.pooled({s: rows.where(f"k % 3 = {i}") for i, s in enumerate(("train", "valid", "test"))}, leave_out=("test",)).select("k", "split")


@query(f"SELECT scene, string_agg(DISTINCT class_id::VARCHAR, ',' ORDER BY class_id::VARCHAR) AS classes FROM ({_T}) t WHERE class_id <> (scene % 6) GROUP BY scene")
def u08_union_of_classes(spark: SparkSession, d: str) -> DataFrame:
    """The union over images of the sets of classes that each shows."""
    images = fx.truth(spark, d).where("class_id <> scene % 6").groupBy("scene", "image_id").agg(F.collect_set("class_id").alias("classes"))
    union = images.groupBy("scene").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"))
    return union.select("scene", F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN '0=0.5,4=' || (p_size / 100.0::DOUBLE)::VARCHAR WHEN 1 THEN '3=' || (p_size / 100.0::DOUBLE)::VARCHAR ELSE '' END AS vals,
CASE p_partkey % 3 WHEN 0 THEN '0:1,4:3|5' ELSE '' END AS sources FROM part""")
def f05_class_overrides(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), (F.col("p_size") / 100.0).cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("Under-Ripe="), size, F.lit(", abnormal=0.4, abnormal = 0.5"))).when(k % 3 == 1, F.concat(F.lit(" masak="), size, F.lit(",")))
    said = F.when(k % 3 == 0, F.lit("under_ripe:unripe|ripe|ripe, abnormal: empty"))
    show = lambda m, f: F.array_join(F.transform(F.array_sort(F.map_entries(m)), f), ",")
    values = show(overrides.class_values(text), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))
    sources = show(overrides.class_sources(said), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.array_join(e["value"].cast("array<string>"), "|")))
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("k"), values.alias("vals"), sources.alias("sources"))


@query("SELECT p_partkey AS k, (p_size + 2)::DOUBLE AS total, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '_', 'g'), '^_+', ''), '_+$', '') AS slug FROM part")
def f06_numbers_and_slugs(spark: SparkSession, d: str) -> DataFrame:
    numbers = names.parsed_numbers(F.concat(F.lit("1.5, ,"), F.col("p_size").cast("string"), F.lit(" ,0.5,")))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v).alias("total"), names.slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")), 1 << 20).alias("slug"))


@query(f"""SELECT image_id, gt_idx, round(greatest(0.0, xc - w) + 0, 9) AS x1, round((greatest(0.0, xc - w) + least(1.0, xc + w)) / 2, 9) AS xc, round(least(1.0, xc + w) - greatest(0.0, xc - w), 9) AS w FROM ({_T}) t""")
def f11_corner_forms(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of double size to corners and back, clamped to the image."""
    wide = fx.truth(spark, d).withColumns({"w": F.col("w") * 2, "h": F.col("h") * 2})
    back = B.centred(*B.corners(B.box()))
    return wide.select("image_id", "gt_idx", F.round(B.clamp(B.corners(B.box())[0]), 9).alias("x1"), F.round(back.x, 9).alias("xc"), F.round(back.w, 9).alias("w"))


@query("""SELECT c_custkey AS k, 'python run.py --name ' || CASE WHEN c_name LIKE '% %' THEN '"' || c_name || '"' ELSE c_name END || ' --note "' || c_mktsegment || ' x" --seed ' || (c_custkey % 7)::VARCHAR AS command FROM customer""")
def k10_command_lines(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array(*map(F.lit, ("python", "run.py", "--name")), F.col("c_name"), F.lit("--note"), F.concat("c_mktsegment", F.lit(" x")), F.lit("--seed"), (F.col("c_custkey") % 7).cast("string"))
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), sinks.command_line(parts).alias("command"))


@query(f"""SELECT image_id, gt_idx, CASE WHEN held THEN 'test' ELSE 'train' END AS split FROM (SELECT *, scene IN (2, 5) AS held FROM ({_T}) t)""")
def p17_held_out_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes 2 and 5 are held out; names that no scene has hold nothing out."""
    rows = fx.truth(spark, d)
    out = splits.held_out(rows, "scene", [2, 5, 99])
    return out.select("image_id", "gt_idx", F.when(F.col("held_out"), "test").otherwise("train").alias("split"))


# Groups of images by number; a group shows the classes up to its own number.
_SEEN = "class_id <= image_id % 7"


@query(f"""WITH i AS (SELECT DISTINCT image_id, image_id % 7 AS k FROM ({_T}) t), b AS (SELECT image_id % 7 AS k, bit_or(1 << class_id) AS c FROM ({_T}) t WHERE {_SEEN} GROUP BY 1),
g AS (SELECT i.k, count(*) AS n, any_value(coalesce(c, 0)) AS c FROM i LEFT JOIN b ON b.k = i.k GROUP BY i.k),
m AS (SELECT m, count(*) AS s, sum(n) AS n, bit_or(c) AS c, string_agg(k::VARCHAR, ',' ORDER BY k) AS names FROM range(1, 128) r(m) JOIN g ON (m >> k) & 1 = 1 GROUP BY m),
best AS (SELECT a.m AS test, v.m AS valid FROM m a JOIN m v ON a.m & v.m = 0 WHERE a.s <= 4 AND v.s <= 3
ORDER BY bit_count(a.c) DESC, bit_count(v.c) DESC, least(a.n, 1200) DESC, least(v.n, 800) DESC, abs(a.n - 0.2::DOUBLE * (SELECT sum(n) FROM g)), a.s, a.names, v.s, v.names LIMIT 1)
SELECT k::VARCHAR AS "group", CASE WHEN (test >> k) & 1 = 1 THEN 'test' WHEN (valid >> k) & 1 = 1 THEN 'valid' ELSE 'train' END AS split FROM g, best""")
def l06_chosen_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups chosen for the classes and images that they hold: what each holds is counted in Spark, the choice is among a few groups."""
    t = fx.truth(spark, d).withColumn("g", (F.col("image_id") % 7).cast("string"))
    images = t.select("image_id", "g").distinct()
    counts, sizes = splits.group_counts(images, t.where(_SEEN).select("image_id", "class_id"), "g")
    test, valid = splits.choose_groups(counts, sizes)
    split = F.when(F.col("g").isin(*test), "test").when(F.col("g").isin(*valid), "valid").otherwise("train")
    return images.select("g").distinct().select(F.col("g").alias("group"), split.alias("split"))


# Two batches of images: the second brings those of the first again, and further ones, some for places that are filled.
_NEW = "concat('/new/', CASE o_orderkey % 3 WHEN 0 THEN 'ripe' WHEN 1 THEN 'unripe' ELSE 'empty' END, '/', CAST(o_orderkey % 7 AS STRING), '/i', CAST(o_custkey AS STRING), CASE o_orderkey % 50 WHEN 49 THEN '.txt' ELSE '.jpg' END)"


@query(f"""WITH f AS (SELECT o_orderkey % 4 < 3 AS early, CASE o_orderkey % 3 WHEN 0 THEN 'ripe' WHEN 1 THEN 'unripe' ELSE 'empty' END AS place, 'i' || o_custkey::VARCHAR || '.jpg' AS name, {_NEW} AS path FROM orders WHERE o_orderkey % 50 <> 49),
a AS (SELECT place, name, min(path) AS path FROM f WHERE early GROUP BY ALL), b AS (SELECT place, name, min(path) AS path FROM f GROUP BY ALL)
SELECT *, '1' AS batch FROM a UNION ALL SELECT *, '2' FROM b WHERE (place, name) NOT IN (SELECT (place, name) FROM a)""")
def s23_growing_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr(_NEW).alias("path"))
    place = f"{shared_dir(spark)}/pool-{spark.sql('select uuid()').first()[0]}"
    for batch, own in (("1", rows.where("o_orderkey % 4 < 3")), ("2", rows), ("1", rows.where("o_orderkey % 4 < 3"))):
        pool.append(spark, pool.candidates(own, "/new"), place, batch)
    return pool.ledger(spark, place)


@query("""SELECT CASE o_orderkey % 4 WHEN 1 THEN 'Scene-A' WHEN 2 THEN 'b c' ELSE 'root_scene' END AS scene, count(*)::BIGINT AS images, min(p) AS first, max(p) AS last
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'pool/' WHEN 1 THEN 'pool/Scene-A/images/' WHEN 2 THEN 'pool/b c/' ELSE 'other/x/' END || 'img' || o_orderkey::VARCHAR || '.jpg' AS p FROM orders) x GROUP BY 1""")
def s18_scenes(spark: SparkSession, d: str) -> DataFrame:
    return pool.scenes(_images(spark, d), "pool")
