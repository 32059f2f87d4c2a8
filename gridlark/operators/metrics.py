"""Detection and image-level metrics over match tables.

Counts at thresholds are taken over bins of confidence, rankings over parts of the order (see ranking.py), and a
curve's interpolation over its 101 steps of recall, so no window holds all predictions of a class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.boxes import ratio, rounded
from gridlark.operators.matching import IOU_STEPS, hit_masks
from gridlark.operators.ranking import by_confidence, running
from gridlark.tables import Written

# Confidence thresholds of the global and the class-wise sweep, and the precision asked for.
THRESHOLDS = (0.05, 0.10, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90)
CLASSWISE = tuple(i / 100 for i in range(20, 100, 5))
TARGET_PRECISION = 0.85


def class_counts(truth: DataFrame, classes: Sequence[int]) -> DataFrame:
    """class_id, gt of every configured class, also those without a box."""
    domain = truth.sparkSession.createDataFrame([(c,) for c in classes], "class_id int")
    counts = truth.groupBy(F.col("class_id").alias("_class")).agg(F.count("*").alias("gt"))
    return domain.join(F.broadcast(counts), F.col("class_id") == F.col("_class"), "left").select("class_id", F.coalesce("gt", F.lit(0)).cast("long").alias("gt"))


def scores(tp: Column, fp: Column, gt: Column) -> dict[str, Column]:
    precision = tp / F.greatest(tp + fp, F.lit(1))
    recall = tp / F.greatest(gt, F.lit(1))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    return {"precision": precision, "recall": recall, "f1": f1, "fn": F.greatest(gt - tp, F.lit(0))}


def sweep(matches: DataFrame, counts: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """threshold_no, threshold, class_id, tp, fp, gt, precision, recall, f1, fn, from one match pass.

    A prediction counts for every threshold up to its confidence, so each is put in the bin of the last one and
    bins are summed from above: one aggregation of (classes x thresholds) rows instead of a match for each.
    """
    spark = matches.sparkSession
    last = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col("confidence")))
    bins = matches.withColumn("_bin", last).where("_bin > 0").groupBy("class_id", "_bin").agg(F.sum(F.col("is_tp").cast("long")).alias("_tp"), F.count("*").alias("_n"))
    grid = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)], "threshold_no int, threshold double")
    grid = counts.join(F.broadcast(grid))
    rows = grid.alias("g").join(bins.alias("b"), (F.col("g.class_id") == F.col("b.class_id")) & (F.col("b._bin") >= F.col("g.threshold_no")), "left")
    rows = rows.groupBy("threshold_no", "threshold", F.col("g.class_id").alias("class_id"), "gt").agg(F.coalesce(F.sum("_tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("_n") - F.sum("_tp"), F.lit(0)).alias("fp"))
    return rows.withColumns(scores(F.col("tp"), F.col("fp"), F.col("gt")))


def with_macro(rows: DataFrame) -> DataFrame:
    """Sweep rows and, per threshold, their unweighted mean over the configured classes (class_id null)."""
    macro = rows.groupBy("threshold_no", "threshold").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "gt")])
    return rows.unionByName(macro.withColumn("class_id", F.lit(None).cast("int")))


def best_threshold(rows: DataFrame) -> DataFrame:
    """The threshold of the best macro F1, the first one of equals: one row."""
    macro = rows.groupBy("threshold_no", "threshold").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return macro.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold_no"))).alias("x")).select("x.*")


def operating_points(rows: DataFrame, target: float = TARGET_PRECISION) -> DataFrame:
    """Per class the threshold of most recall among those that are precise enough, else of the best F1."""
    enough = F.col("precision") >= target
    case = lambda a, b: F.when(enough, a).otherwise(b)
    order = Window.partitionBy("class_id").orderBy(enough.desc(), case(F.col("recall"), F.col("f1")).desc(), case(F.col("f1"), F.col("precision")).desc(), "threshold")
    picked = rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    # fixed values: how the two rules are named in reports
    rule = F.when(enough, F.lit(f"max_recall_with_precision>={target:.2f}")).otherwise("fallback_max_f1_no_threshold_met_target_precision")
    return picked.withColumn("selection_rule", rule)


def pr_curve(matches: DataFrame, counts: DataFrame) -> DataFrame:
    """Every prediction's rank with running tp, fp, precision and recall, per class and overlap threshold."""
    rows = matches.join(F.broadcast(counts), "class_id")  # a row per configured class
    rows = rows.withColumns({"_one": F.lit(1).cast("long"), "_hit": F.col("is_tp").cast("long")})
    rows = running(rows, ["iou_thr", "class_id"], *by_confidence(), {"rank": "_one", "tp": "_hit"}).drop("_one", "_hit")
    rows = rows.withColumn("fp", F.col("rank") - F.col("tp"))
    return rows.withColumns({"precision": F.col("tp") / F.col("rank"), "recall": F.when(F.col("gt") > 0, F.col("tp") / F.col("gt")).otherwise(0.0)})


def average_precision(masks: DataFrame, counts: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """iou_thr, class_id, gt, precision and recall of all predictions, ap (101 points, interpolated), from predictions
    with hits (see hit_masks). Classes without boxes or predictions get 0.

    The interpolated precision at a recall step is the best precision of any hit of at least that recall. So each hit
    only counts for the last step that it reaches, and the steps' maxima are carried down from the highest one.
    """
    spark = masks.sparkSession
    numbers = range(len(thresholds))
    bit = {i: F.shiftright("hits", i).bitwiseAND(F.lit(1)).cast("long") for i in numbers}
    rows = masks.select("class_id", "confidence", "image_id", "pred_idx", "hits", F.lit(1).cast("long").alias("_one"), *[b.alias(f"_b{i}") for i, b in bit.items()])
    ranked = running(rows, ["class_id"], *by_confidence(), {"rank": "_one"} | {f"tp{i}": f"_b{i}" for i in numbers})
    each = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"tp{i}").alias("tp"), (F.col(f"_b{i}") == 1).alias("hit")) for i in numbers]), lambda x: x["hit"])
    hits = ranked.where("hits <> 0").select("class_id", "rank", F.explode(each).alias("x")).join(F.broadcast(counts), "class_id")
    recall = F.col("x.tp") / F.col("gt")
    step = F.least(F.floor(recall * 100 + 1e-9), F.lit(100)).cast("int")
    step = F.when(step / 100 > recall, step - 1).otherwise(step)
    best = hits.groupBy(F.col("x.i").alias("i"), "class_id", step.alias("step")).agg(F.max(F.col("x.tp") / F.col("rank")).alias("best"))
    # a row per step that occurs: each also serves the steps below it, down to the next one that occurs
    down = Window.partitionBy("i", "class_id").orderBy(F.col("step").desc())
    upper = F.max("best").over(down.rowsBetween(Window.unboundedPreceding, 0))
    below = F.coalesce(F.lead("step").over(down), F.lit(-1))
    served = best.select("i", "class_id", (upper * (F.col("step") - below)).alias("part"))
    ap = served.groupBy(F.col("i").alias("_i"), F.col("class_id").alias("_class")).agg((F.sum("part") / 101).alias("ap"))
    totals = rows.groupBy(F.col("class_id").alias("_c")).agg(F.count("*").alias("n"), F.array(*[F.sum(f"_b{i}") for i in numbers]).alias("tps"))
    grid = spark.createDataFrame([(i, float(t)) for i, t in enumerate(thresholds)], "i int, iou_thr double")
    grid = counts.join(F.broadcast(grid)).join(ap, (F.col("i") == F.col("_i")) & (F.col("class_id") == F.col("_class")), "left").join(totals, F.col("class_id") == F.col("_c"), "left")
    some, tp = F.col("gt") > 0, F.get("tps", F.col("i"))
    value = {"precision": tp / F.col("n"), "recall": tp / F.col("gt"), "ap": F.col("ap")}
    return grid.select("iou_thr", "class_id", "gt", *[F.when(some, F.coalesce(v, F.lit(0.0))).otherwise(0.0).alias(c) for c, v in value.items()])


def evaluate(predictions: DataFrame, truth: DataFrame, classes: Sequence[int]) -> DataFrame:
    """class_id (null: mean of the classes), gt, precision, recall, ap50, ap50_95 over ten overlap thresholds."""
    inside = lambda df: df.where(F.col("class_id").isin(*classes))
    truth, predictions = inside(truth), inside(predictions)
    counts = class_counts(truth, classes)
    masks = hit_masks(predictions.select("image_id", "pred_idx", "class_id", "confidence", "xc", "yc", "w", "h"), truth, IOU_STEPS)
    masks = Written(masks.sparkSession, "masks").table(masks.select("image_id", "pred_idx", "class_id", "confidence", "hits"))
    ap = average_precision(masks, counts, IOU_STEPS)
    at_half = F.col("iou_thr") == IOU_STEPS[0]
    rows = ap.groupBy("class_id", "gt").agg(*[F.max(F.when(at_half, F.col(c))).alias(n) for c, n in (("precision", "precision"), ("recall", "recall"), ("ap", "ap50"))], F.avg("ap").alias("ap50_95"))
    macro = rows.agg(F.lit(None).cast("int").alias("class_id"), F.sum("gt").alias("gt"), *[F.avg(c).alias(c) for c in ("precision", "recall", "ap50", "ap50_95")])
    return rows.unionByName(macro)


def confusion_matrix(pairs: DataFrame, classes: Sequence[int]) -> DataFrame:
    """gt_class by a column for each predicted class and none, over the whole class domain."""
    domain = [*classes, -1]
    rows = pairs.sparkSession.createDataFrame([(c,) for c in domain], "gt_class int")
    wide = pairs.groupBy(F.col("gt_class").alias("_gt")).pivot("pred_class", domain).agg(F.sum("n"))
    named = wide.select("_gt", *[F.col(f"`{c}`").alias(f"pred_{c if c >= 0 else 'none'}") for c in domain])
    return rows.join(named, F.col("gt_class") == F.col("_gt"), "left").drop("_gt").fillna(0)


def image_report(rows: DataFrame, classes: Sequence[int], thresholds: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """rows (gt_class, pred_class or null, confidence) -> per threshold: a summary row, and a row per class.

    Below the threshold a prediction counts as none. A class's false positives count images of the evaluated
    classes alone.
    """
    spark = rows.sparkSession
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    each = rows.select(F.explode(grid).alias("threshold"), "gt_class", "pred_class", "confidence")
    kept = F.when(F.col("confidence") >= F.col("threshold"), F.col("pred_class"))
    cells = each.groupBy("threshold", "gt_class", kept.alias("pred_class")).agg(F.count("*").alias("n"))
    domain = spark.createDataFrame([(c,) for c in classes], "class_id int")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    own, said = F.col("gt_class") == F.col("class_id"), F.coalesce(F.col("pred_class") == F.col("class_id"), F.lit(False))
    per = cells.join(F.broadcast(domain)).groupBy("threshold", "class_id").agg(
        total(own).alias("gt_images"), total(said).alias("predicted_images"), total(own & said).alias("tp"), total(~own & said & F.col("gt_class").isin(*classes)).alias("fp"), total(own & ~said).alias("fn")
    )
    per = per.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    whole = cells.groupBy("threshold").agg(F.sum("n").alias("images"), total(F.col("pred_class").isNotNull()).alias("detected_images"), total(F.col("gt_class") == F.col("pred_class")).alias("_right"))
    macro = per.groupBy(F.col("threshold").alias("_t")).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    summary = whole.join(macro, F.col("threshold") == F.col("_t")).select("threshold", "images", "detected_images", ratio(F.col("detected_images"), F.col("images")).alias("coverage"), ratio(F.col("_right"), F.col("images")).alias("top1_accuracy"), "macro_precision", "macro_recall", "macro_f1")
    return summary, per


def over_seeds(rows: DataFrame, by: Sequence[str], values: Sequence[str], sample: bool = True) -> DataFrame:
    """Mean and standard deviation of values over seeds; the sample's (of one: 0) or the population's."""
    sd = F.stddev_samp if sample else F.stddev_pop
    return rows.groupBy(*by).agg(F.count("*").alias("seeds"), *[f for v in values for f in (rounded(F.avg(v)).alias(f"{v}_mean"), rounded(F.coalesce(sd(v), F.lit(0.0))).alias(f"{v}_sd"))])
