"""The library's queries over the derived detection tables, and the same results in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.functions import catalog, hashes, names
from gridlark.operators import decisions, duplicates, matching, metrics, profile, quota, rollups, splits
from gridlark.plans import fixtures as fx
from gridlark.sources import labels, sinks

EVAL = catalog.EVALUATED
_T, _P, _V, _N, _L = (fx.plain(s) for s in (fx.TRUTH, fx.PREDICTIONS, fx.VIEWS, fx.NAMES, fx.LINES))
_R = B.rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _inter(a: str, b: str) -> str:
    return (
        f"greatest(0.0, least({a}.xc + {a}.w / 2, {b}.xc + {b}.w / 2) - greatest({a}.xc - {a}.w / 2, {b}.xc - {b}.w / 2)) * "
        f"greatest(0.0, least({a}.yc + {a}.h / 2, {b}.yc + {b}.h / 2) - greatest({a}.yc - {a}.h / 2, {b}.yc - {b}.h / 2))"
    )


def _area(a: str) -> str:
    return f"(({a}.xc + {a}.w / 2) - ({a}.xc - {a}.w / 2)) * (({a}.yc + {a}.h / 2) - ({a}.yc - {a}.h / 2))"


def _iou(a: str, b: str) -> str:
    return f"({_inter(a, b)}) / ({_area(a)} + {_area(b)} - ({_inter(a, b)}))"


def _greedy(same_class: bool = True, thresholds: str = "(VALUES (0.5::DOUBLE)) v(thr)", where: str = "true", name: str = "m", found: str = _P) -> str:
    """CTEs up to ``m`` (image_id, pred_idx, thr, gt, gt_class, iou): what the greedy match gives each prediction."""
    on = "AND p.class_id = t.class_id" if same_class else ""
    cls = "p.class_id" if same_class else "0"
    return f"""
t AS (SELECT * FROM ({_T}) x WHERE {where}), p AS (SELECT * FROM ({found}) x WHERE {where}),
pairs AS (SELECT p.image_id, p.pred_idx, {cls} AS grp, p.confidence, t.gt_idx, t.class_id AS gt_class, {_iou("p", "t")} AS iou FROM p JOIN t ON p.image_id = t.image_id {on}),
cand AS (SELECT image_id, grp, pred_idx, any_value(confidence) AS confidence, list({{'iou': iou, 'gt': gt_idx, 'cls': gt_class}} ORDER BY iou DESC, gt_idx) AS cands FROM pairs WHERE iou > 0 GROUP BY image_id, grp, pred_idx),
r AS (SELECT cand.*, thr, row_number() OVER (PARTITION BY image_id, grp, thr ORDER BY confidence DESC, pred_idx) AS rn FROM cand, {thresholds}),
s AS (
  SELECT image_id, grp, thr, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS took, CAST(NULL AS BIGINT) AS pred_idx, CAST(NULL AS BIGINT) AS gt, CAST(NULL AS INTEGER) AS gt_class, CAST(NULL AS DOUBLE) AS iou
  FROM (SELECT DISTINCT image_id, grp, thr FROM r) d
  UNION ALL
  SELECT r.image_id, r.grp, r.thr, r.rn, CASE WHEN b.iou >= r.thr THEN list_append(s.took, b.gt) ELSE s.took END, r.pred_idx, b.gt, b.cls, b.iou
  FROM s JOIN r ON s.image_id = r.image_id AND s.grp = r.grp AND s.thr = r.thr AND r.rn = s.rn + 1,
       LATERAL (SELECT list_filter(r.cands, lambda x: NOT list_contains(s.took, x.gt))[1] AS b) q
),
{name} AS (SELECT image_id, pred_idx, thr, gt, gt_class, iou, coalesce(iou >= thr, false) AS tp FROM s WHERE pred_idx IS NOT NULL)"""


def _truth(spark, d):
    return fx.truth(spark, d)


def _matches(spark: SparkSession, d: str, classes=None, misses: bool = False) -> DataFrame:
    inside = lambda df: df if classes is None else df.where(F.col("class_id").isin(*classes))
    return matching.greedy_match(inside(fx.predictions(spark, d)), inside(_truth(spark, d)), misses=misses)


# ---------------------------------------------------------------- labels and profiles

_PARSED = rf"""
parsed AS (
  SELECT image_id, line_no, line, trim(line) = '' AS blank, string_split_regex(trim(line), '\s+') AS tok FROM ({_L}) l
), num AS (
  SELECT *, len(tok) = 5 AND len(list_filter(tok, lambda x: regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)'))) = 5 AS five FROM parsed
), boxes AS (
  SELECT image_id, line_no, line, blank, CASE WHEN five AND trunc(tok[1]::DOUBLE)::INT BETWEEN 0 AND 5 THEN trunc(tok[1]::DOUBLE)::INT END AS class_id,
         CASE WHEN five THEN tok[2]::DOUBLE END AS xc, CASE WHEN five THEN tok[3]::DOUBLE END AS yc, CASE WHEN five THEN tok[4]::DOUBLE END AS w, CASE WHEN five THEN tok[5]::DOUBLE END AS h
  FROM num
), strict AS (
  SELECT *, coalesce(class_id IS NOT NULL AND xc BETWEEN 0 AND 1 AND yc BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1 AND w > 0 AND h > 0, false) AS ok FROM boxes
)"""
_BOXES = ", ".join(f"count(*) FILTER (WHERE ok AND class_id = {i})::BIGINT AS boxes_{n}" for i, n in catalog.CLASSES.items())


def _lines(spark, d):
    return fx.table(spark, d, fx.LINES)


@query(f"WITH {_PARSED} SELECT image_id, count(*) FILTER (WHERE ok)::BIGINT AS valid, count(*) FILTER (WHERE NOT ok)::BIGINT AS bad, {_BOXES} FROM strict GROUP BY image_id")
def s02_strict_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.strict_counts(_lines(spark, d))


@query(f"WITH {_PARSED} SELECT image_id, count(*) FILTER (WHERE ok)::BIGINT AS valid, count(*) FILTER (WHERE NOT ok)::BIGINT AS bad, {_BOXES} FROM strict WHERE NOT blank GROUP BY image_id")
def s02b_strict_counts_skipping_blank(spark: SparkSession, d: str) -> DataFrame:
    return labels.strict_counts(_lines(spark, d), skip_blank=True)


@query(f"WITH {_PARSED} SELECT image_id, line_no, class_id, xc, yc, w, h FROM boxes WHERE class_id IN (0, 3, 4, 5)")
def s03_lenient_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.lenient(_lines(spark, d), EVAL).select("image_id", "line_no", "class_id", "xc", "yc", "w", "h")


@query(f"WITH {_PARSED} SELECT image_id, line_no, CASE class_id WHEN 4 THEN 5 WHEN 3 THEN 3 END AS class_id, xc, yc, w, h FROM boxes WHERE class_id IN (3, 4)")
def s04_remapped_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.remapped(_lines(spark, d), {4: 5, 3: 3}).select("image_id", "line_no", "class_id", "xc", "yc", "w", "h")


@query(f"WITH {_PARSED}, i AS (SELECT DISTINCT image_id FROM boxes) SELECT i.image_id, coalesce(string_agg(line, chr(10) ORDER BY line_no, line) FILTER (WHERE class_id = 3), '') AS text FROM i LEFT JOIN boxes b ON i.image_id = b.image_id GROUP BY i.image_id")
def s05_masked_label_text(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return labels.masked_lines(lines.select("image_id").distinct(), lines, (3,)).select("image_id", "text")



@query(f"""
WITH c AS (SELECT image_id, class_id, (xc * 640 - w * 320) AS x, (yc * 480 - h * 240) AS y, w * 640 AS bw, h * 480 AS bh, gt_idx FROM ({_T}) z)
SELECT image_id, class_id, count(*)::BIGINT AS n, round_even(sum((x + bw / 2) / 640), 4) AS sum_xc, round_even(sum(bh / 480), 4) AS sum_h
FROM c WHERE class_id NOT IN (1, 2) AND gt_idx % 5 <> 4 GROUP BY image_id, class_id""")
def s07_coco_boxes(spark: SparkSession, d: str) -> DataFrame:
    t = _truth(spark, d)
    box = F.array(F.col("xc") * 640 - F.col("w") * 320, F.col("yc") * 480 - F.col("h") * 240, F.col("w") * 640, F.col("h") * 480)
    notes = t.select("image_id", (F.col("class_id") + 10).alias("category_id"), box.alias("bbox"), (F.col("gt_idx") % 5 == 4).cast("int").alias("iscrowd"))
    images = t.select(F.col("image_id").alias("id")).distinct().select("id", F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    kinds = spark.createDataFrame([(10, "Damaged"), (11, "ffb"), (12, "no such class"), (13, "Masak"), (14, "Under-Ripe"), (15, "TBS mentah")], "id int, name string")
    return labels.coco_boxes(images, notes, kinds).groupBy("image_id", "class_id").agg(F.count("*").alias("n"), _R(F.sum("xc"), 4).alias("sum_xc"), _R(F.sum("h"), 4).alias("sum_h"))


@query(f"""
WITH {_PARSED}, st AS (SELECT image_id, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS bad, {_BOXES} FROM strict GROUP BY image_id),
i AS (SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'valid' ELSE 'test' END AS split FROM orders)
SELECT split, count(*)::BIGINT AS images, count(st.image_id)::BIGINT AS labels, coalesce(sum(valid), 0)::BIGINT AS objects, count(*) FILTER (WHERE valid = 0)::BIGINT AS empty_labels,
       count(*) FILTER (WHERE st.image_id IS NULL)::BIGINT AS missing_labels, coalesce(sum(bad), 0)::BIGINT AS bad_rows, {", ".join(f"coalesce(sum(boxes_{n}), 0)::BIGINT AS boxes_{n}" for n in catalog.CLASSES.values())}
FROM i LEFT JOIN st ON i.image_id = st.image_id GROUP BY split""")
def a01_dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    split = F.when(key % 10 < 8, "train").when(key % 10 == 8, "valid").otherwise("test")
    images = spark.read.parquet(f"{d}/orders.parquet").select(key.alias("image_id"), split.alias("split"))
    return profile.dataset_profile(images, labels.strict_counts(_lines(spark, d)))


@query(f"SELECT image_id, count(*)::BIGINT AS objects, {', '.join(f'count(*) FILTER (WHERE class_id = {i})::BIGINT AS boxes_{n}' for i, n in catalog.CLASSES.items())} FROM ({_T}) t GROUP BY image_id")
def a02_image_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.image_profile(_truth(spark, d))


@query(f"SELECT scene, string_agg(DISTINCT class_id::VARCHAR, ',' ORDER BY class_id::VARCHAR) AS classes FROM ({_T}) t GROUP BY scene")
def a03_observed_classes(spark: SparkSession, d: str) -> DataFrame:
    return profile.observed_classes(_truth(spark, d), ["scene"]).select("scene", F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"))


@query(f"SELECT class_id, count(DISTINCT image_id)::BIGINT AS images FROM ({_T}) t GROUP BY class_id")
def a06_class_presence(spark: SparkSession, d: str) -> DataFrame:
    return profile.presence(_truth(spark, d))


@query(f"SELECT count(DISTINCT image_id)::BIGINT AS images, count(*)::BIGINT AS boxes FROM ({_T}) t WHERE class_id IN (0, 3, 4, 5)")
def p03_masked_view(spark: SparkSession, d: str) -> DataFrame:
    t = _truth(spark, d)
    images, kept = profile.masked(t.select("image_id").distinct(), t, EVAL)
    return images.agg(F.count("*").alias("images")).crossJoin(kept.agg(F.count("*").alias("boxes")))


_ALIAS = ", ".join(f"('{a}', {repr(c) if c else 'NULL'})" for a, c in (catalog.ALIASES | {c: c for c in catalog.IDS}).items())
_RAW = "CASE o_orderkey % 9 WHEN 0 THEN ' Under-Ripe ' WHEN 1 THEN 'FFB' WHEN 2 THEN 'Masak' WHEN 3 THEN 'zzz' WHEN 4 THEN 'TBS mentah' WHEN 5 THEN 'empty bunch' WHEN 6 THEN 'RIPE' WHEN 7 THEN o_orderstatus ELSE 'partially_ripe' END"


@query(f"""
SELECT o.raw, a.c AS class_name, CASE a.c {" ".join(f"WHEN '{n}' THEN {i}" for n, i in catalog.IDS.items())} ELSE -1 END AS class_id, count(*)::BIGINT AS n
FROM (SELECT {_RAW} AS raw FROM orders) o LEFT JOIN (VALUES {_ALIAS}) a(k, c) ON replace(replace(lower(trim(o.raw)), '-', '_'), ' ', '_') = a.k GROUP BY 1, 2, 3""")
def p01_class_names(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.expr(_RAW).alias("raw"))
    rows = rows.select("raw", catalog.canonical_class(F.col("raw")).alias("class_name"), catalog.class_id(F.col("raw"), -1).alias("class_id"))
    return rows.groupBy("raw", "class_name", "class_id").agg(F.count("*").alias("n"))


_STEM = r"regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '')"
_SCENE = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part({_STEM}, '.rf.', 1), '(?i)(?:frame|img|image|copy)[_-]?\d+$', ''), '(?i)[_-]?(?:jpg|jpeg|png|bmp)$', ''), '--\d+.*$', ''), '\d+$', ''), '_- ')"
_BASE = rf"trim(regexp_replace(regexp_replace(regexp_replace(split_part(lower({_STEM}), '.rf.', 1), '^(?:src\d+_|pseudo\d+_)', ''), '[_-](?:jpg|jpeg|png|bmp)$', ''), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"SELECT image_id, path, CASE WHEN {_SCENE} <> '' THEN {_SCENE} ELSE {_STEM} END AS scene, {_BASE} AS base FROM ({_N}) n")
def f02_f03_scene_and_base_names(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, fx.NAMES).select("image_id", "path", names.scene_group(F.col("path")).alias("scene"), names.base_name(F.col("path")).alias("base"))


# ---------------------------------------------------------------- matching and metrics


@query(f"WITH RECURSIVE {_greedy()} SELECT p.image_id, p.pred_idx, p.class_id, p.confidence, coalesce(tp, false) AS is_tp, round_even(coalesce(iou, 0.0), 6) AS best_iou, coalesce(CASE WHEN tp THEN gt END, -1) AS gt_idx FROM p LEFT JOIN m ON p.image_id = m.image_id AND p.pred_idx = m.pred_idx")
def j04_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, misses=True).select("image_id", "pred_idx", "class_id", "confidence", "is_tp", _R(F.col("best_iou")).alias("best_iou"), F.coalesce("gt_idx", F.lit(-1)).alias("gt_idx"))


_GRID = "(VALUES " + ", ".join(f"({i + 1}, {t}::DOUBLE)" for i, t in enumerate(metrics.THRESHOLDS)) + ") g(threshold_no, threshold)"
_CGRID = "(VALUES " + ", ".join(f"({i + 1}, {t}::DOUBLE)" for i, t in enumerate(metrics.CLASSWISE)) + ") g(threshold_no, threshold)"


def _sweep(grid: str, where: str = "true") -> str:
    return f"""{_greedy(where=f"class_id IN (0, 3, 4, 5) AND {where}")},
pm AS (SELECT p.class_id, p.confidence, coalesce(tp, false) AS tp FROM p LEFT JOIN m ON p.image_id = m.image_id AND p.pred_idx = m.pred_idx),
gt AS (SELECT c.class_id, count(t.image_id) AS gt FROM (VALUES (0), (3), (4), (5)) c(class_id) LEFT JOIN t ON t.class_id = c.class_id GROUP BY c.class_id),
sw AS (SELECT threshold_no, threshold, gt.class_id, gt, count(*) FILTER (WHERE pm.tp)::BIGINT AS tp, count(*) FILTER (WHERE NOT pm.tp)::BIGINT AS fp
       FROM gt, {grid} LEFT JOIN pm ON pm.class_id = gt.class_id AND pm.confidence >= threshold GROUP BY ALL),
sc AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS precision, tp / greatest(gt, 1)::DOUBLE AS recall FROM sw),
sf AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12::DOUBLE) AS f1, greatest(gt - tp, 0) AS fn FROM sc)"""


@query(f"""WITH RECURSIVE {_sweep(_GRID)}
SELECT threshold, class_id, tp, fp, fn::BIGINT AS fn, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(f1, 6) AS f1 FROM sf
UNION ALL SELECT threshold, -1, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round_even(avg(precision), 6), round_even(avg(recall), 6), round_even(avg(f1), 6) FROM sf GROUP BY threshold""")
def a12_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.with_macro(metrics.sweep(_matches(spark, d, EVAL), metrics.class_counts(_truth(spark, d), EVAL), metrics.THRESHOLDS))
    return rows.select("threshold", F.coalesce("class_id", F.lit(-1)).alias("class_id"), "tp", "fp", "fn", *[_R(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH RECURSIVE {_sweep(_CGRID)},
o AS (SELECT *, precision >= 0.85 AS okay, row_number() OVER (PARTITION BY class_id ORDER BY precision >= 0.85 DESC, CASE WHEN precision >= 0.85 THEN recall ELSE f1 END DESC, CASE WHEN precision >= 0.85 THEN f1 ELSE precision END DESC, threshold) AS k FROM sf)
SELECT class_id, threshold, tp, fp, fn::BIGINT AS fn, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(f1, 6) AS f1,
       CASE WHEN okay THEN 'max_recall_with_precision>=0.85' ELSE 'fallback_max_f1_no_threshold_met_target_precision' END AS selection_rule FROM o WHERE k = 1""")
def a13_operating_points(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.operating_points(metrics.sweep(_matches(spark, d, EVAL), metrics.class_counts(_truth(spark, d), EVAL), metrics.CLASSWISE))
    return rows.select("class_id", "threshold", "tp", "fp", "fn", *[_R(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "selection_rule")


@query(f"""WITH RECURSIVE {_greedy(where="class_id IN (0, 3, 4, 5)")},
pm AS (SELECT p.split, p.class_id, p.confidence, coalesce(tp, false) AS tp FROM p LEFT JOIN m ON p.image_id = m.image_id AND p.pred_idx = m.pred_idx),
gt AS (SELECT split, class_id, count(*) AS gt FROM t GROUP BY split, class_id),
sw AS (SELECT gt.split, threshold_no, threshold, gt.class_id, gt, count(*) FILTER (WHERE pm.tp)::BIGINT AS tp, count(*) FILTER (WHERE NOT pm.tp)::BIGINT AS fp
       FROM gt, {_GRID} LEFT JOIN pm ON pm.split = gt.split AND pm.class_id = gt.class_id AND pm.confidence >= threshold GROUP BY ALL),
sc AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS precision, tp / greatest(gt, 1)::DOUBLE AS recall FROM sw),
sf AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12::DOUBLE) AS f1 FROM sc),
best AS (SELECT threshold FROM (SELECT threshold_no, threshold, avg(f1) AS f1 FROM sf WHERE split = 'calibration' GROUP BY ALL) x ORDER BY f1 DESC, threshold_no LIMIT 1)
SELECT sf.threshold, class_id, tp, fp, gt::BIGINT AS gt, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(f1, 6) AS f1
FROM sf JOIN best ON sf.threshold = best.threshold WHERE split = 'locked_final_test'""")
def a12_locked_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Fit the threshold on the calibration split, freeze it, and evaluate the locked split with it."""
    truth, found = _truth(spark, d), _matches(spark, d, EVAL)
    part = lambda df, s: df.where(F.col("split") == s)
    rows = {s: metrics.sweep(part(found, s), metrics.class_counts(part(truth, s), EVAL), metrics.THRESHOLDS) for s in ("calibration", "locked_final_test")}
    best = metrics.best_threshold(rows["calibration"]).select("threshold")
    kept = rows["locked_final_test"].join(F.broadcast(best), "threshold")  # one row
    return kept.select("threshold", "class_id", "tp", "fp", "gt", *[_R(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


_IOUS = "(VALUES " + ", ".join(f"({t!r}::DOUBLE)" for t in matching.IOU_STEPS) + ") v(thr)"
_CURVE = """
cu AS (SELECT p.class_id, m0.thr, row_number() OVER w AS rank, coalesce(tp, false) AS is_tp, sum(coalesce(tp, false)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS tp
       FROM (SELECT p.*, v.thr FROM p, {thr}) p JOIN (SELECT DISTINCT thr FROM {thr}) m0 ON m0.thr = p.thr LEFT JOIN m ON p.image_id = m.image_id AND p.pred_idx = m.pred_idx AND m.thr = p.thr
       WINDOW w AS (PARTITION BY p.thr, p.class_id ORDER BY p.confidence DESC, p.image_id, p.pred_idx)),
gt AS (SELECT class_id, count(*) AS gt FROM t GROUP BY class_id),
pr AS (SELECT cu.class_id, cu.thr, rank, is_tp, tp, tp / rank::DOUBLE AS precision, tp / gt::DOUBLE AS recall, gt FROM cu JOIN gt ON gt.class_id = cu.class_id),
sfx AS (SELECT *, max(precision) OVER (PARTITION BY thr, class_id ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) AS best FROM pr),
ap AS (SELECT thr, class_id, sum(b) / 101 AS ap FROM (SELECT s.thr, s.class_id, st.x, arg_min(best, rank) AS b FROM sfx s JOIN (SELECT unnest(range(0, 101)) AS x) st ON s.recall >= st.x / 100.0::DOUBLE GROUP BY s.thr, s.class_id, st.x) q GROUP BY thr, class_id)"""


@query(f"""WITH RECURSIVE {_greedy(thresholds=_IOUS, where="class_id IN (0, 3, 4, 5)")}, {_CURVE.format(thr=_IOUS)},
rows AS (SELECT ap.class_id, any_value(gt.gt) AS gt, max(CASE WHEN ap.thr = 0.5 THEN ap.ap END) AS ap50, avg(ap.ap) AS ap50_95 FROM ap JOIN gt ON gt.class_id = ap.class_id GROUP BY ap.class_id)
SELECT class_id, gt::BIGINT AS gt, round_even(ap50, 6) AS ap50, round_even(ap50_95, 6) AS ap50_95 FROM rows
UNION ALL SELECT -1, sum(gt)::BIGINT, round_even(avg(ap50), 6), round_even(avg(ap50_95), 6) FROM rows""")
def a10_masked_evaluator(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.evaluate(fx.predictions(spark, d), _truth(spark, d), EVAL)
    return rows.select(F.coalesce("class_id", F.lit(-1)).alias("class_id"), "gt", _R(F.col("ap50")).alias("ap50"), _R(F.col("ap50_95")).alias("ap50_95"))


@query(f"""WITH RECURSIVE {_greedy(where="class_id IN (0, 3, 4, 5)")}, {_CURVE.format(thr="(VALUES (0.5::DOUBLE)) v(thr)")}
SELECT class_id, rank::BIGINT AS rank, is_tp, tp::BIGINT AS tp, (rank - tp)::BIGINT AS fp, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall FROM pr""")
def a14_pr_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = metrics.pr_curve(_matches(spark, d, EVAL), metrics.class_counts(_truth(spark, d), EVAL))
    return curve.select("class_id", F.col("rank").cast("long").alias("rank"), "is_tp", "tp", "fp", _R(F.col("precision")).alias("precision"), _R(F.col("recall")).alias("recall"))


@query(f"""WITH RECURSIVE {_greedy(where="class_id IN (0, 3, 4, 5)")}, {_CURVE.format(thr="(VALUES (0.5::DOUBLE)) v(thr)")}
SELECT rank::BIGINT AS rank, round_even(avg(precision), 5) AS precision, round_even(avg(recall), 5) AS recall, count(*)::BIGINT AS curves FROM pr GROUP BY rank""")
def a19_mean_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = metrics.pr_curve(_matches(spark, d, EVAL), metrics.class_counts(_truth(spark, d), EVAL))
    return rollups.mean_curve(curve).select(F.col("rank").cast("long").alias("rank"), _R(F.col("precision"), 5).alias("precision"), _R(F.col("recall"), 5).alias("recall"), "curves")


_CONFUSED = f"""{_greedy(same_class=False)},
cells AS (
  SELECT CASE WHEN tp THEN gt_class ELSE -1 END AS gt_class, p.class_id AS pred_class FROM p LEFT JOIN m ON p.image_id = m.image_id AND p.pred_idx = m.pred_idx
  UNION ALL SELECT t.class_id, -1 FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tp AND m.image_id = t.image_id AND m.gt = t.gt_idx)
)"""


@query(f"WITH RECURSIVE {_CONFUSED} SELECT coalesce(gt_class, -1) AS gt_class, pred_class, count(*)::BIGINT AS n FROM cells GROUP BY 1, 2")
def j05_confusion_pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.confusion_pairs(fx.predictions(spark, d), _truth(spark, d))


@query(f"""WITH RECURSIVE {_CONFUSED} SELECT dm.c AS gt_class, {", ".join(f"count(*) FILTER (WHERE pred_class = {c})::BIGINT AS pred_{c if c >= 0 else 'none'}" for c in (*range(6), -1))}
FROM (VALUES (0), (1), (2), (3), (4), (5), (-1)) dm(c) LEFT JOIN cells ON coalesce(gt_class, -1) = dm.c GROUP BY dm.c""")
def a07_confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_matrix(matching.confusion_pairs(fx.predictions(spark, d), _truth(spark, d)), range(6))


_BEST = f"""
t AS ({_T}), p AS ({_P}),
pairs AS (SELECT p.image_id, p.pred_idx, p.class_id, t.class_id AS gt_class, t.gt_idx, {_iou("p", "t")} AS iou FROM p JOIN t ON p.image_id = t.image_id),
best AS (SELECT image_id, pred_idx, max(iou) FILTER (WHERE class_id = gt_class) AS same_iou, max(iou) AS any_iou, first(gt_class ORDER BY iou DESC, gt_idx) AS any_class FROM pairs WHERE iou > 0 GROUP BY image_id, pred_idx),
bo AS (SELECT p.*, coalesce(same_iou, 0.0) AS same_iou, coalesce(any_iou, 0.0) AS any_iou, coalesce(any_class, -1) AS any_class FROM p LEFT JOIN best b ON p.image_id = b.image_id AND p.pred_idx = b.pred_idx)"""


@query(f"WITH {_BEST} SELECT image_id, pred_idx, round_even(same_iou, 6) AS same_iou, round_even(any_iou, 6) AS any_iou, any_class FROM bo")
def j07_best_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = matching.best_overlap(fx.predictions(spark, d), _truth(spark, d))
    return rows.select("image_id", "pred_idx", _R(F.col("same_iou")).alias("same_iou"), _R(F.col("any_iou")).alias("any_iou"), "any_class")


@query(f"""WITH {_BEST}, im AS (SELECT DISTINCT image_id FROM t)
SELECT bo.image_id, pred_idx, class_id, CASE WHEN im.image_id IS NULL THEN 'no_ground_truth' WHEN any_iou >= 0.5 THEN 'class_confusion' WHEN any_iou >= 0.1 THEN 'localization' ELSE 'background' END AS category
FROM bo LEFT JOIN im ON bo.image_id = im.image_id WHERE same_iou < 0.5""")
def j08_false_positives(spark: SparkSession, d: str) -> DataFrame:
    return matching.false_positives(fx.predictions(spark, d), _truth(spark, d)).select("image_id", "pred_idx", "class_id", "category")


@query(f"""WITH t AS ({_T}), p AS ({_P}),
pairs AS (SELECT t.image_id, t.gt_idx, p.class_id AS pred_class, p.confidence, {_iou("p", "t")} AS iou FROM p JOIN t ON p.image_id = t.image_id WHERE t.class_id = 4),
seen AS (SELECT image_id, gt_idx, bool_or(pred_class = 4) AS found, first(pred_class ORDER BY iou DESC, confidence DESC, pred_class DESC) FILTER (WHERE pred_class IN (3, 5)) AS confused_with FROM pairs WHERE iou >= 0.5 GROUP BY image_id, gt_idx)
SELECT t.image_id, t.gt_idx, CASE WHEN confused_with IS NOT NULL THEN 'misclassified' ELSE 'missed' END AS category, coalesce(confused_with, -1) AS confused_with FROM t LEFT JOIN seen s ON t.image_id = s.image_id AND t.gt_idx = s.gt_idx WHERE t.class_id = 4 AND NOT coalesce(found, false)""")
def j09_missed_boxes(spark: SparkSession, d: str) -> DataFrame:
    return matching.missed(fx.predictions(spark, d), _truth(spark, d), 4, (3, 5)).select("image_id", "gt_idx", "category", F.coalesce("confused_with", F.lit(-1)).alias("confused_with"))


_CORNERS = "xc - w / 2 AS x1, yc - h / 2 AS y1, xc + w / 2 AS x2, yc + h / 2 AS y2, ((xc + w / 2) - (xc - w / 2)) * ((yc + h / 2) - (yc - h / 2)) AS area"
_SUPPORT = f"""
p AS MATERIALIZED ({_P}), pb AS MATERIALIZED (SELECT image_id, pred_idx, class_id, {_CORNERS} FROM p), vb AS MATERIALIZED (SELECT image_id, view_id, class_id, {_CORNERS} FROM ({_V}) v),
pv AS MATERIALIZED (SELECT pb.image_id, pb.pred_idx, vb.view_id, pb.area + vb.area AS both_areas, greatest(0.0, least(pb.x2, vb.x2) - greatest(pb.x1, vb.x1)) * greatest(0.0, least(pb.y2, vb.y2) - greatest(pb.y1, vb.y1)) AS common
  FROM pb JOIN vb ON pb.image_id = vb.image_id AND pb.class_id = vb.class_id),
votes AS MATERIALIZED (SELECT image_id, pred_idx, count(*) AS votes FROM (SELECT DISTINCT image_id, pred_idx, view_id FROM pv WHERE common / (both_areas - common) >= 0.6) n GROUP BY image_id, pred_idx),
ps AS MATERIALIZED (SELECT p.*, (coalesce(votes, 0) + 1)::INT AS support FROM p LEFT JOIN votes x ON p.image_id = x.image_id AND p.pred_idx = x.pred_idx)"""


@query(f"WITH {_SUPPORT} SELECT image_id, pred_idx, support FROM ps")
def j06_view_support(spark: SparkSession, d: str) -> DataFrame:
    return matching.view_support(fx.predictions(spark, d), fx.views(spark, d)).select("image_id", "pred_idx", "support")


# ---------------------------------------------------------------- decisions

_EXPECTED = "CASE WHEN scene = 6 THEN NULL ELSE CAST(scene AS INT) END"
_THRESHOLD = "0.40 + class_id * 0.05"
_SCORED = f"""
e AS (SELECT *, {_EXPECTED} AS expected, ({_THRESHOLD})::DOUBLE AS threshold, w * h AS area, greatest(w / h, h / w) AS asp,
      (xc - w / 2 < 0.002 OR yc - h / 2 < 0.002 OR xc + w / 2 > 0.998 OR yc + h / 2 > 0.998) AS edge FROM ps),
q AS (SELECT *, 0.42::DOUBLE * least(1.0, confidence / threshold)
      + 0.25::DOUBLE * (0.7::DOUBLE * CASE WHEN area < 0.0005 THEN area / 0.0005 WHEN area > 0.7 THEN greatest(0.0, 1 - (area - 0.7) / 0.7) ELSE 1.0 END + 0.3::DOUBLE * greatest(0.0, 1 - (asp - 1) / 5.0))
      + 0.15::DOUBLE * CASE WHEN edge THEN 0.0 ELSE 1.0 END + 0.18::DOUBLE * CASE WHEN expected IS NULL THEN 0.75 WHEN expected = class_id THEN 1.0 ELSE 0.0 END AS quality,
      list_filter([CASE WHEN confidence < threshold THEN 'below_dynamic_threshold' END, CASE WHEN area < 0.0005 THEN 'small_box' END, CASE WHEN area > 0.7 THEN 'large_box' END,
                   CASE WHEN asp > 6 THEN 'bad_aspect_ratio' END, CASE WHEN edge THEN 'edge_contact' END, CASE WHEN expected <> class_id THEN 'folder_class_mismatch' END], lambda x: x IS NOT NULL) AS reasons FROM e)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = matching.view_support(fx.predictions(spark, d), fx.views(spark, d))
    return decisions.scored(rows.withColumns({"expected": F.expr(_EXPECTED), "threshold": F.expr(_THRESHOLD).cast("double")}))


@query(f"WITH {_SUPPORT}, {_SCORED} SELECT image_id, pred_idx, round(quality + 1e-10, 6) AS quality_score, array_to_string(reasons, '|') AS reasons FROM q")
def f17_quality_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("image_id", "pred_idx", F.round(F.col("quality_score") + 1e-10, 6).alias("quality_score"), F.array_join("reasons", "|").alias("reasons"))


_DECIDED = f"""{_SUPPORT}, {_SCORED},
rs AS (SELECT *, coalesce(expected = 4 AND class_id IN (3, 5) AND confidence >= 0.45 AND round(quality, 9) >= 0.72 AND support >= 2, false) AS rescued FROM q),
r2 AS (SELECT * EXCLUDE (class_id, reasons), class_id AS was, CASE WHEN rescued THEN 4 ELSE class_id END AS class_id,
       CASE WHEN rescued THEN list_append(list_filter(reasons, lambda x: x NOT IN ('folder_class_mismatch', 'below_dynamic_threshold')), 'ordinal_under_ripe_rescue_from_' || CASE class_id WHEN 3 THEN 'ripe' ELSE 'unripe' END) ELSE reasons END AS reasons,
       NOT list_contains(reasons, 'folder_class_mismatch') AS folder_ok FROM rs),
rl AS (SELECT *, coalesce(expected = 5 AND class_id = 3 AND confidence >= 0.55 AND round(quality, 9) >= 0.8 AND support >= 1 AND NOT list_contains(reasons, 'edge_contact'), false) AS relabelled FROM r2),
dc AS (SELECT image_id, pred_idx, scene, confidence, support, quality, CASE WHEN relabelled THEN expected ELSE class_id END AS class_id,
       (support >= 2 AND round(quality, 9) >= 0.72 AND folder_ok) OR rescued OR relabelled AS accepted,
       CASE WHEN relabelled THEN list_append(list_filter(reasons, lambda x: x NOT IN ('folder_class_mismatch', 'below_dynamic_threshold')), 'folder_guided_relabel_from_ripe')
            WHEN (support >= 2 AND round(quality, 9) >= 0.72 AND folder_ok) OR rescued THEN reasons
            ELSE list_concat(reasons, list_filter([CASE WHEN support < 2 THEN 'low_consistency_support' END, CASE WHEN round(quality, 9) < 0.72 THEN 'low_quality_score<0.720' END], lambda x: x IS NOT NULL)) END AS reasons FROM rl)"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumn("quality_score", F.round("quality_score", 9)).withColumn("ordinal_votes", F.lit(2))
    return decisions.decide(rows, rescue={"confidence": 0.45, "quality": 0.72, "support": 2, "votes": 2}, relabel={5: (3,)})


@query(f"WITH {_DECIDED} SELECT image_id, pred_idx, class_id::INT AS class_id, accepted, array_to_string(reasons, '|') AS reasons FROM dc")
def p06_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("image_id", "pred_idx", "class_id", "accepted", F.array_join("reasons", "|").alias("reasons"))


_CAPPED = f"""{_DECIDED},
cp AS (SELECT *, accepted AND row_number() OVER (PARTITION BY image_id, accepted ORDER BY round(quality, 9) DESC, confidence DESC, support DESC, pred_idx) > 1 AS over FROM dc),
ca AS (SELECT * EXCLUDE (accepted, reasons), accepted AND NOT over AS accepted, CASE WHEN over THEN list_append(reasons, 'per_image_top_quality_truncation') ELSE reasons END AS reasons FROM cp)"""


@query(f"WITH {_CAPPED} SELECT image_id, pred_idx, accepted, array_to_string(reasons, '|') AS reasons FROM ca")
def w05_capped_boxes(spark: SparkSession, d: str) -> DataFrame:
    return decisions.capped(_decided(spark, d), 1).select("image_id", "pred_idx", "accepted", F.array_join("reasons", "|").alias("reasons"))


@query(f"WITH {_CAPPED} SELECT reason, count(*)::BIGINT AS n FROM (SELECT unnest(reasons) AS reason FROM ca) u GROUP BY reason")
def a17_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return decisions.reason_counts(decisions.capped(_decided(spark, d), 1))


@query(f"""WITH {_CAPPED}, u AS (SELECT image_id, unnest(reasons) AS reason FROM ca), ur AS (SELECT image_id, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons FROM u GROUP BY image_id)
SELECT ca.image_id, count(*) FILTER (WHERE accepted)::BIGINT AS accepted_boxes, count(*) FILTER (WHERE NOT accepted)::BIGINT AS rejected_boxes, round_even(avg(round(quality, 9)) FILTER (WHERE accepted), 6) AS mean_quality,
       CASE WHEN bool_or(accepted) THEN 'accepted' ELSE 'rejected' END AS status, coalesce(any_value(ur.reasons), 'no_valid_box') AS reasons
FROM ca LEFT JOIN ur ON ca.image_id = ur.image_id GROUP BY ca.image_id""")
def a21_image_summary(spark: SparkSession, d: str) -> DataFrame:
    return decisions.image_summary(decisions.capped(_decided(spark, d), 1))


@query(f"""WITH RECURSIVE {_DECIDED},
per AS (SELECT scene, image_id, class_id, count(*) AS n, sum(round(quality, 9)) AS q FROM dc WHERE accepted GROUP BY ALL),
im AS (SELECT scene, image_id, round_even(sum(q) / sum(n), 9) AS mean, list(class_id::INT ORDER BY class_id) AS cls FROM per GROUP BY scene, image_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY mean DESC, image_id) AS rn FROM im),
st AS (
  SELECT scene, CAST(0 AS BIGINT) AS rn, [0, 0, 0, 0, 0, 0] AS used, CAST(NULL AS BIGINT) AS image_id, false AS sel FROM (SELECT DISTINCT scene FROM rk) d0
  UNION ALL
  SELECT rk.scene, rk.rn, CASE WHEN f.ok THEN list_transform(range(0, 6), lambda i: (st.used[i + 1] + CASE WHEN list_contains(rk.cls, i::INT) THEN 1 ELSE 0 END)::INT) ELSE st.used END, rk.image_id, f.ok
  FROM st JOIN rk ON rk.scene = st.scene AND rk.rn = st.rn + 1, LATERAL (SELECT len(list_filter(rk.cls, lambda c: st.used[c + 1] >= 50)) = 0 AS ok) f
)
SELECT scene AS "group", image_id, sel AS selected FROM st WHERE image_id IS NOT NULL""")
def l11_class_quota(spark: SparkSession, d: str) -> DataFrame:
    return quota.class_quota(_decided(spark, d).withColumnRenamed("scene", "group"), images_per_class=50)


@query(f"""SELECT class_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE confidence < 0.5)::BIGINT AS low_confidence,
count(*) FILTER (WHERE w * h < 0.0005 OR w * h > 0.7 OR least(w, h) < 0.01 OR greatest(w / h, h / w) > 6 OR xc - w / 2 < 0.002 OR yc - h / 2 < 0.002 OR xc + w / 2 > 0.998 OR yc + h / 2 > 0.998)::BIGINT AS bad_shape FROM ({_P}) p GROUP BY class_id""")
def p05_hard_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.predictions(spark, d).withColumn("r", decisions.hard_gates())
    low = F.array_contains("r", "low_confidence")
    return rows.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(low).alias("low_confidence"), F.count_if(F.size("r") > low.cast("int")).alias("bad_shape"))


@query(f"SELECT image_id, pred_idx, view_id, round_even(CASE view_id WHEN 1 THEN 1 - xc WHEN 3 THEN greatest(0.0, least(1.0, 0.075 + xc * 0.85)) ELSE xc END, 6) AS xc, round_even(CASE view_id WHEN 2 THEN 1 - yc WHEN 3 THEN greatest(0.0, least(1.0, 0.075 + yc * 0.85)) ELSE yc END, 6) AS yc FROM ({_V}) v")
def f18_undone_views(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("hflip"), F.lit("vflip"), F.lit("crop"), F.lit("identity")), F.col("view_id"))
    undone = B.undo_view(kind, B.box())
    return fx.views(spark, d).select("image_id", "pred_idx", "view_id", _R(undone.x).alias("xc"), _R(undone.y).alias("yc"))


# ---------------------------------------------------------------- duplicates


@query(f"WITH n AS (SELECT image_id, dataset, {_BASE} AS base FROM ({_N}) x), g AS (SELECT base FROM n GROUP BY base HAVING count(*) > 1 AND count(DISTINCT dataset) > 1) SELECT image_id, dataset, base FROM n WHERE base IN (SELECT base FROM g)")
def j10_name_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, fx.NAMES).select("image_id", "dataset", names.base_name(F.col("path")).alias("base"))
    return duplicates.by_name(rows)


_BITS = "list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + {o}] > 0 THEN (1::BIGINT << i::INT) ELSE 0 END))::BIGINT"
# Every vector and a copy of it with planted flips: none, 3, 5, 6, 9 or 12 bits; copies are in another dataset.
_FLIPS = ("CASE vec_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 28 WHEN 3 THEN 2016 WHEN 4 THEN 511 ELSE 65520 END", "CASE vec_id % 6 WHEN 2 THEN 6 ELSE 0 END")
PLANTED = f"""SELECT vec_id * 2 AS vec_id, label, vec_id % 3 AS dataset, {_BITS.format(o=1)} AS h0, {_BITS.format(o=33)} AS h1 FROM embeddings
UNION ALL SELECT vec_id * 2 + 1, label, (vec_id + 1) % 3, xor({_BITS.format(o=1)}, ({_FLIPS[0]})::BIGINT), xor({_BITS.format(o=33)}, ({_FLIPS[1]})::BIGINT) FROM embeddings"""


def planted_hashes(spark: SparkSession, d: str) -> DataFrame:
    """image_id (even: a vector, odd: its copy), label, dataset, h0, h1."""
    h0, h1 = hashes.sign_hash(F.col("embedding"))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").withColumns({"h0": h0, "h1": h1})
    own = rows.select((F.col("vec_id") * 2).alias("image_id"), "label", (F.col("vec_id") % 3).alias("dataset"), "h0", "h1")
    flipped = [F.col(h).bitwiseXOR(F.expr(f).cast("long")).alias(h) for f, h in zip(_FLIPS, ("h0", "h1"), strict=True)]
    return own.unionByName(rows.select((F.col("vec_id") * 2 + 1).alias("image_id"), "label", ((F.col("vec_id") + 1) % 3).alias("dataset"), *flipped))


@query(f"""WITH h AS ({PLANTED})
SELECT a.vec_id AS left_id, b.vec_id AS right_id, (bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)))::INT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND a.dataset <> b.dataset
WHERE bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)) <= 5""")
def j11_hash_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.by_hash(planted_hashes(spark, d), ["h0", "h1"], 5)


@query(f"""WITH h AS ({PLANTED})
SELECT a.vec_id AS left_id, b.vec_id AS right_id, (bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)))::INT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND a.dataset <> b.dataset
WHERE bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)) <= 12""")
def j11_far_hashes(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.by_hash(planted_hashes(spark, d), ["h0", "h1"], 12)


# ---------------------------------------------------------------- splits and samples


@query("SELECT scene, image_id FROM (SELECT o_custkey % 7 AS scene, o_orderkey AS image_id, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) AS r FROM orders) x WHERE r <= 50")
def l03_sample_per_scene(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 7).alias("scene"), F.col("o_orderkey").alias("image_id"))
    return splits.sample_per_group(rows, "scene", "image_id", 50, 42)


@query("""WITH r AS (SELECT o_custkey % 7 AS scene, o_orderkey AS image_id, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey % 7) AS n FROM orders)
SELECT scene, image_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM r""")
def l04_ratio_split(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 7).alias("scene"), F.col("o_orderkey").alias("image_id"))
    return splits.ratio_split(rows, "image_id", 42, within="scene")


@query("""WITH c AS (SELECT c_mktsegment AS "group", count(*) AS n FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, "group") AS r, count(*) OVER () AS g FROM c)
SELECT "group", n::BIGINT AS n, CASE WHEN r > g - greatest(1, round_even(g * 0.25, 0)) THEN 'test' WHEN r > g - greatest(1, round_even(g * 0.25, 0)) - greatest(1, round_even(g * 0.15, 0)) THEN 'valid' ELSE 'train' END AS split FROM r""")
def l05_group_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_split(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("group")), "group")


@query(f"""WITH RECURSIVE im AS (SELECT image_id, list(DISTINCT class_id) FILTER (WHERE class_id IN (0, 3, 4, 5)) AS cls FROM ({_T}) t GROUP BY image_id),
b AS (SELECT 'clip_' || (image_id // 3)::VARCHAR AS g, unnest(coalesce(cls, []) || [-1]) AS c FROM im), k AS (SELECT g, c, count(*) AS n FROM b GROUP BY g, c),
tg AS (SELECT c, greatest(1, round_even(sum(n) * 0.5, 0)) AS target FROM k WHERE c >= 0 GROUP BY c),
gr AS (SELECT g, max(n) FILTER (WHERE c = -1) AS size, count(*) FILTER (WHERE c >= 0) AS classes,
       coalesce(max(n) FILTER (WHERE c = 0), 0) AS n0, coalesce(max(n) FILTER (WHERE c = 3), 0) AS n3, coalesce(max(n) FILTER (WHERE c = 4), 0) AS n4, coalesce(max(n) FILTER (WHERE c = 5), 0) AS n5 FROM k GROUP BY g),
lm AS (SELECT greatest(1, round_even(count(*) * 0.5, 0)) AS most FROM gr),
tt AS (SELECT coalesce(max(target) FILTER (WHERE c = 0), 0) AS t0, coalesce(max(target) FILTER (WHERE c = 3), 0) AS t3, coalesce(max(target) FILTER (WHERE c = 4), 0) AS t4, coalesce(max(target) FILTER (WHERE c = 5), 0) AS t5 FROM tg),
rk AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY classes DESC, size DESC, md5('42:' || g), g) AS rn FROM gr),
st AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS g, false AS took, 0::BIGINT AS u0, 0::BIGINT AS u3, 0::BIGINT AS u4, 0::BIGINT AS u5, 0::BIGINT AS n
  UNION ALL SELECT rk.rn, rk.g, f.ok, u0 + CASE WHEN f.ok THEN n0 ELSE 0 END, u3 + CASE WHEN f.ok THEN n3 ELSE 0 END, u4 + CASE WHEN f.ok THEN n4 ELSE 0 END, u5 + CASE WHEN f.ok THEN n5 ELSE 0 END, n + f.ok::BIGINT
  FROM st JOIN rk ON rk.rn = st.rn + 1, lm, tt, LATERAL (SELECT n < lm.most AND ((n0 > 0 AND u0 < t0) OR (n3 > 0 AND u3 < t3) OR (n4 > 0 AND u4 < t4) OR (n5 > 0 AND u5 < t5)) AS ok) f),
fold AS MATERIALIZED (SELECT g, took FROM st WHERE g IS NOT NULL), nt AS (SELECT count(*) FILTER (WHERE took) AS n FROM fold),
up AS (SELECT g, row_number() OVER (ORDER BY md5('42:' || g), g) AS r FROM fold WHERE NOT took)
SELECT fold.g AS "group", CASE WHEN took OR up.r <= (SELECT most FROM lm) - (SELECT n FROM nt) THEN 'calibration' ELSE 'locked_final_test' END AS split FROM fold LEFT JOIN up ON up.g = fold.g""")
def l07_calibration_split(spark: SparkSession, d: str) -> DataFrame:
    """Half of the base names, each of up to three exports of one frame, with the evaluated classes of their images."""
    held = F.array_compact(F.collect_set(F.when(F.col("class_id").isin(*catalog.EVALUATED), F.col("class_id"))))
    images = _truth(spark, d).groupBy("image_id").agg(held.alias("classes"))
    k = F.col("image_id")
    path = F.concat(F.lit("pool/src1_Clip-"), F.floor(k / 3).cast("string"), F.lit("_jpg.rf."), (k % 3).cast("string"), F.lit(".jpg"))
    return splits.calibration_fraction_split(images.select(names.base_name(path).alias("group"), "classes"), 0.5, 42)


@query("""WITH i AS (SELECT p_partkey AS k, CAST(p_size % 6 AS INT) AS class_id FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY k) AS r, count(*) OVER (PARTITION BY class_id) AS n FROM i),
s AS (SELECT class_id, max(n) AS n FROM r GROUP BY class_id HAVING max(n) < 350), x AS (SELECT class_id, n, unnest(range(n + 1, 351)) AS i FROM s),
l AS (SELECT class_id, (i - n)::INT AS copy, ('0x' || substr(md5('42:' || class_id::VARCHAR || ':' || i::VARCHAR), 1, 8))::BIGINT % n + 1 AS lot FROM x)
SELECT class_id, k AS image_id, 0::INT AS copy FROM r WHERE r <= 350 UNION ALL SELECT r.class_id, r.k, l.copy FROM r JOIN l ON r.class_id = l.class_id AND r.r = l.lot""")
def l08_oversample(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") % 6).cast("int").alias("class_id"))
    return splits.oversample(rows, "image_id", 350, 42)


@query(f"""WITH r AS (SELECT class_id, image_id * 100 + pred_idx AS k, row_number() OVER (PARTITION BY class_id ORDER BY confidence DESC, image_id * 100 + pred_idx) AS r FROM ({_P}) p),
c AS (SELECT *, CASE WHEN r <= 50 THEN 'rank' ELSE 'random' END AS chosen_by FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY chosen_by <> 'rank', CASE WHEN chosen_by = 'random' THEN md5('42:' || k::VARCHAR) END NULLS FIRST, r) AS q FROM c)
SELECT class_id, k, chosen_by FROM o WHERE q <= 100""")
def w09_top_and_random(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.predictions(spark, d).select("class_id", (F.col("image_id") * 100 + F.col("pred_idx")).alias("k"), "confidence")
    return splits.top_and_random(rows, "class_id", "k", [F.col("confidence").desc()], 100, 42).select("class_id", "k", "chosen_by")


def named_sql(rows: str, order: str) -> str:
    """Rows (split, name, more) with sample_name, given out one after another within families of names that can meet."""
    return f"""(WITH RECURSIVE b AS (SELECT *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS ext FROM {rows}),
c AS (SELECT *, substr(name, 1, length(name) - length(ext)) AS bare FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY split, family ORDER BY {order}) AS r FROM (SELECT *, regexp_replace(lower(bare), '^(.+?)((_[1-9][0-9]*)*)$', '\\1') || lower(ext) AS family FROM c) f),
s AS (SELECT DISTINCT split, family, 0::BIGINT AS r, []::VARCHAR[] AS used, NULL::VARCHAR AS given FROM n
UNION ALL SELECT s.split, s.family, n.r, list_append(s.used, lower(g.given)), g.given FROM s JOIN n ON n.split = s.split AND n.family = s.family AND n.r = s.r + 1,
LATERAL (SELECT CASE WHEN NOT list_contains(s.used, lower(n.name)) THEN n.name ELSE list_filter(list_transform(range(1, len(s.used) + 2), lambda i: n.bare || '_' || i::VARCHAR || n.ext), lambda x: NOT list_contains(s.used, lower(x)))[1] END AS given) g)
SELECT n.* EXCLUDE (ext, bare, family, r), s.given AS sample_name FROM n JOIN s ON n.split = s.split AND n.family = s.family AND n.r = s.r)"""


# Names that meet in letter case, and names that carry numbers which others would be given.
_NAME = "concat(CASE WHEN p_partkey % 2 = 0 THEN 'IMG_' ELSE 'img_' END, CAST(p_size % 5 AS STRING), CASE WHEN p_partkey % 7 = 0 THEN '_1' WHEN p_partkey % 11 = 0 THEN '_1_1' WHEN p_partkey % 13 = 0 THEN '_3' ELSE '' END, '.jpg')"


@query(f"SELECT k, split, sample_name FROM {named_sql(f'(SELECT p_partkey AS k, p_brand AS split, {_NAME} AS name FROM part)', 'k')} z")
def w10_unique_names(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("split"), F.expr(_NAME).alias("name"))
    return splits.unique_names(rows, "split", "name", ["k"]).select("k", "split", "sample_name")


# ---------------------------------------------------------------- image level and roll-ups

_OUTDOOR = (0, 1, 2, 3, 5)
_TOP = f"""
top1 AS (SELECT image_id, class_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, pred_idx) AS r FROM ({_P}) p) x WHERE r = 1),
im AS (SELECT t.image_id, t.class_id AS gt_class, CASE top1.class_id WHEN 4 THEN 5 ELSE top1.class_id END AS pred_class, coalesce(confidence, 0.0) AS confidence FROM ({_T}) t LEFT JOIN top1 ON t.image_id = top1.image_id WHERE t.gt_idx = 0),
ex AS (SELECT threshold, gt_class, CASE WHEN confidence >= threshold THEN pred_class END AS pred_class FROM im, (VALUES (0.001::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) th(threshold)),
pc AS (SELECT threshold, c AS class_id, count(*) FILTER (WHERE gt_class = c)::BIGINT AS gt_images, count(*) FILTER (WHERE pred_class = c)::BIGINT AS predicted_images, count(*) FILTER (WHERE gt_class = c AND pred_class = c)::BIGINT AS tp,
       count(*) FILTER (WHERE gt_class <> c AND pred_class = c AND gt_class IN (0, 1, 2, 3, 5))::BIGINT AS fp, count(*) FILTER (WHERE gt_class = c AND pred_class IS DISTINCT FROM c)::BIGINT AS fn FROM ex, (VALUES (0), (1), (2), (3), (5)) cl(c) GROUP BY threshold, c),
pq AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall FROM pc),
pf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pq)"""


def _image_rows(spark: SparkSession, d: str) -> DataFrame:
    top = matching.top_per_image(fx.predictions(spark, d)).select("image_id", F.when(F.col("class_id") == 4, 5).otherwise(F.col("class_id")).alias("pred_class"), "confidence")
    images = _truth(spark, d).where("gt_idx = 0").select("image_id", F.col("class_id").alias("gt_class"))
    return images.join(top, "image_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


@query(f"""WITH {_TOP}, mc AS (SELECT threshold, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f FROM pf GROUP BY threshold),
wh AS (SELECT threshold, count(*) AS n, count(pred_class) AS det, count(*) FILTER (WHERE gt_class = pred_class) AS good FROM ex GROUP BY threshold)
SELECT wh.threshold, n::BIGINT AS images, det::BIGINT AS detected_images, round_even(det / n::DOUBLE, 6) AS coverage, round_even(good / n::DOUBLE, 6) AS top1_accuracy, round_even(p, 6) AS macro_precision, round_even(r, 6) AS macro_recall, round_even(f, 6) AS macro_f1 FROM wh JOIN mc ON wh.threshold = mc.threshold""")
def a15_image_report(spark: SparkSession, d: str) -> DataFrame:
    summary, _ = metrics.image_report(_image_rows(spark, d), _OUTDOOR, (0.001, 0.25, 0.5))
    return summary.select("threshold", "images", "detected_images", *[_R(F.col(c)).alias(c) for c in ("coverage", "top1_accuracy", "macro_precision", "macro_recall", "macro_f1")])


@query(f"WITH {_TOP} SELECT threshold, class_id, gt_images, predicted_images, tp, fp, fn, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(f1, 6) AS f1 FROM pf")
def a16_class_report(spark: SparkSession, d: str) -> DataFrame:
    _, per = metrics.image_report(_image_rows(spark, d), _OUTDOOR, (0.001, 0.25, 0.5))
    return per.select("threshold", "class_id", "gt_images", "predicted_images", "tp", "fp", "fn", *[_R(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT o_orderpriority AS stage, count(*)::BIGINT AS seeds, round_even(avg(o_totalprice), 4) AS mean, round_even(coalesce(stddev_samp(o_totalprice), 0), 4) AS sd, round_even(stddev_pop(o_totalprice), 4) AS sd_population FROM orders GROUP BY 1")
def a18_over_seeds(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("stage"), F.col("o_totalprice").alias("x"))
    a, b = metrics.over_seeds(rows, ["stage"], ["x"]), metrics.over_seeds(rows, ["stage"], ["x"], sample=False)
    return a.join(b.select("stage", F.col("x_sd").alias("p")), "stage").select("stage", "seeds", _R(F.col("x_mean"), 4).alias("mean"), _R(F.col("x_sd"), 4).alias("sd"), _R(F.col("p"), 4).alias("sd_population"))


@query("""WITH s AS (SELECT o_orderpriority AS variant, round(avg(o_totalprice), 6) AS f1, round(avg(o_custkey), 6) AS recall FROM orders GROUP BY 1)
SELECT s.variant, round_even(s.f1 - b.f1, 4) AS delta_f1, round_even(s.recall - b.recall, 4) AS delta_recall, s.f1 - b.f1 >= 0 AND s.recall - b.recall >= -0.02 AS passes FROM s, (SELECT * FROM s WHERE variant = '1-URGENT') b""")
def j15_baseline_deltas(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("variant")).agg(F.round(F.avg("o_totalprice"), 6).alias("f1"), F.round(F.avg("o_custkey"), 6).alias("recall"))
    out = rollups.guardrails(rollups.deltas(rows, "variant", "1-URGENT", ["f1", "recall"]), ["f1"], ["recall"])
    return out.select("variant", _R(F.col("delta_f1"), 4).alias("delta_f1"), _R(F.col("delta_recall"), 4).alias("delta_recall"), "passes")


# ---------------------------------------------------------------- sinks


@query(f"""SELECT image_id, string_agg(class_id::VARCHAR || ' ' || printf('%.6f', xc) || ' ' || printf('%.6f', yc) || ' ' || printf('%.6f', w) || ' ' || printf('%.6f', h), chr(10) ORDER BY gt_idx) AS text FROM ({_T}) t GROUP BY image_id""")
def k03_label_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.label_text(_truth(spark, d))


@query("""SELECT event_id, '{"time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","event":"' || event_type || '","payload":{"user_id":' || user_id::VARCHAR || '}}' AS line FROM events""")
def t03_event_log(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet")
    line = sinks.event_json(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_type"), F.struct("user_id"))
    return ev.select("event_id", line.alias("line"))
