"""Joins of predicted and true boxes by overlap.

Tables: truth (image_id, gt_idx, class_id, xc, yc, w, h) and predictions (image_id, pred_idx, class_id, xc, yc, w,
h, confidence). Candidate pairs come from an equi-join on the image (and class) with the overlap as a residual
filter; only pairs that overlap reach the greedy fold, so a fold's array holds one image's overlapping pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.boxes import Box, corners
from gridlark.tables import fresh

_SIDES = ("x1", "y1", "x2", "y2", "area")
IOU_STEPS = tuple(0.50 + 0.05 * i for i in range(10))


def overlaps(predictions: DataFrame, truth: DataFrame, same_class: bool = True, least: float = 0.0) -> DataFrame:
    """image_id, pred_idx, pred_class, confidence, gt_idx, gt_class, iou of all pairs that overlap at all, and by
    ``least`` at least."""
    p = predictions.select("image_id", "pred_idx", F.col("class_id").alias("pred_class"), "confidence", *_sides("p"))
    t = truth.select(F.col("image_id").alias("_image"), "gt_idx", F.col("class_id").alias("gt_class"), *_sides("g"))
    on = F.col("image_id") == F.col("_image")
    if same_class:
        on &= F.col("pred_class") == F.col("gt_class")
    share = _share("p", "g")
    near = p.join(t, on & (share > 0) & (share >= least))
    return near.select("image_id", "pred_idx", "pred_class", "confidence", "gt_idx", "gt_class", share.alias("iou"))


def _sides(name: str) -> list[Column]:
    """Corners and area, computed once per box before the join, so that the join's condition stays short."""
    b = Box(*[F.col(c) for c in ("xc", "yc", "w", "h")])
    x1, y1, x2, y2 = corners(b)
    area = F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)
    return [c.alias(f"{name}_{n}") for c, n in zip((x1, y1, x2, y2, area), _SIDES, strict=True)]


def _share(a: str, b: str) -> Column:
    """The overlap of boxes given by _sides: as iou()."""
    return _overlap(*[{n: F.col(f"{s}_{n}") for n in _SIDES} for s in (a, b)])


def _overlap(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    common = wide * F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return F.coalesce(F.try_divide(common, a["area"] + b["area"] - common), F.lit(0.0))


def _greedy(pairs: Column, threshold: Column) -> Column:
    """Fold over pairs in the order of confidence and overlap: the first pair of a prediction whose true box is free
    is its best; it takes the box if it overlaps enough."""
    start = F.array().cast("array<struct<pred_idx:bigint,gt_idx:bigint,gt_class:int,iou:double,tp:boolean>>")

    def entry(x: Column) -> Column:
        return F.struct(x["pred_idx"].cast("long").alias("pred_idx"), x["gt_idx"].cast("long").alias("gt_idx"), x["gt_class"].cast("int").alias("gt_class"), x["iou"].alias("iou"), (x["iou"] >= threshold).alias("tp"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda a: (a["pred_idx"] == x["pred_idx"]) | (a["tp"] & (a["gt_idx"] == x["gt_idx"])))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(entry(x))))

    # where no box is in two pairs there is nothing to decide
    alone = (F.size(F.array_distinct(pairs["pred_idx"])) == F.size(pairs)) & (F.size(F.array_distinct(pairs["gt_idx"])) == F.size(pairs))
    return F.when(alone, F.transform(pairs, entry)).otherwise(F.aggregate(pairs, start, step))


def greedy_match(predictions: DataFrame, truth: DataFrame, thresholds: Sequence[float] = (0.5,), same_class: bool = True, misses: bool = True) -> DataFrame:
    """predictions with iou_thr, is_tp, best_iou and the matched gt_idx and gt_class, for each overlap threshold.

    Predictions are taken by confidence, ties by pred_idx; each takes the free true box it overlaps most (ties: the
    least gt_idx). One pass serves all confidence thresholds, since what a prediction gets depends only on those
    before it.
    """
    pairs = overlaps(predictions, truth, same_class)
    keys = ["image_id", "pred_class"] if same_class else ["image_id"]
    item = F.struct((-F.col("confidence")).alias("order"), "pred_idx", (-F.col("iou")).alias("far"), "gt_idx", "iou", "gt_class")
    groups = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("pairs"))
    steps = F.array(*[F.lit(float(t)) for t in thresholds])
    runs = groups.select(*keys, "pairs", F.explode(steps).alias("iou_thr")) if len(thresholds) > 1 else groups.withColumn("iou_thr", F.lit(float(thresholds[0])))
    found = runs.select("image_id", "iou_thr", F.explode(_greedy(F.col("pairs"), F.col("iou_thr"))).alias("m"))
    found = found.select(F.col("image_id").alias("_image"), F.col("iou_thr").alias("_thr"), F.col("m.pred_idx").alias("_pred"), "m.iou", "m.tp", "m.gt_idx", "m.gt_class")
    every = predictions.withColumn("iou_thr", F.explode(steps))
    joined = every.join(found, (F.col("image_id") == F.col("_image")) & (F.col("iou_thr") == F.col("_thr")) & (F.col("pred_idx") == F.col("_pred")), "left")
    matched = F.coalesce("tp", F.lit(False))
    return joined.select(*[every[c] for c in every.columns], matched.alias("is_tp"), F.coalesce("iou", F.lit(0.0)).alias("best_iou"), F.when(matched, F.col("gt_idx")).alias("gt_idx"), F.when(matched, F.col("gt_class")).alias("gt_class"))


def _hits_of_fold(pairs: Column, preds: Column, boxes: Column, every: int) -> Column:
    """The greedy fold for all thresholds at once: pred_idx and hits of each prediction.

    A pair is its prediction's best at the thresholds, as bits, at which the prediction is open and the box free; it takes the
    box at those that its overlap reaches. The state is a number for each prediction and box.
    """
    zeros = lambda of: F.transform(of, lambda _: F.lit(0))
    start = F.struct(zeros(boxes).alias("taken"), zeros(preds).alias("done"), zeros(preds).alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        box, pred = F.array_position(boxes, x["gt_idx"]).cast("int") - 1, F.array_position(preds, x["pred_idx"]).cast("int") - 1
        open_ = F.bitwise_not(F.get(acc["taken"], box).bitwiseOR(F.get(acc["done"], pred))).bitwiseAND(F.lit(every))
        won = open_.bitwiseAND(x["bits"])
        add = lambda name, at, more: F.transform(acc[name], lambda v, i: F.when(i == at, v.bitwiseOR(more)).otherwise(v)).alias(name)
        return F.when(open_ == 0, acc).otherwise(F.struct(add("taken", box, won), add("done", pred, open_), add("hits", pred, won)))

    return F.aggregate(pairs, start, step, lambda acc: F.zip_with(preds, acc["hits"], lambda p, h: F.struct(p.alias("pred_idx"), h.alias("hits"))))


def hit_masks(predictions: DataFrame, truth: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """predictions with hits: bit i is set if the prediction is a match of its class at the i-th overlap threshold.

    As greedy_match for each threshold, but each image's pairs and each prediction are one row for all thresholds. In an
    image without a contested box a prediction's overlap says it all; only others are folded, once for all thresholds.
    """
    pairs = overlaps(predictions, truth, least=min(thresholds))
    keys = ["image_id", "pred_class"]
    bits = sum((F.when(F.col("iou") >= t, 1 << i).otherwise(0) for i, t in enumerate(thresholds)), F.lit(0)).cast("int")
    item = F.struct((-F.col("confidence")).alias("order"), "pred_idx", (-F.col("iou")).alias("far"), "gt_idx", bits.alias("bits"))
    groups = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("pairs"), F.count("*").alias("n"))
    groups = groups.withColumns({"_preds": F.array_distinct("pairs.pred_idx"), "_boxes": F.array_distinct("pairs.gt_idx")})
    lone = (F.size("_preds") == F.col("n")) & (F.size("_boxes") == F.col("n"))
    plain = F.transform("pairs", lambda x: F.struct(x["pred_idx"].alias("pred_idx"), x["bits"].alias("hits")))
    folded = _hits_of_fold(F.col("pairs"), F.col("_preds"), F.col("_boxes"), (1 << len(thresholds)) - 1)
    one = lambda df, found: df.select(*keys, F.explode(found).alias("m")).select(*keys, "m.pred_idx", "m.hits")
    found = one(groups, F.when(lone, plain).otherwise(folded)).where("hits <> 0")
    found = found.select(F.col("image_id").alias("_image"), F.col("pred_class").alias("_class"), F.col("pred_idx").alias("_pred"), "hits")
    on = (F.col("image_id") == F.col("_image")) & (F.col("class_id") == F.col("_class")) & (F.col("pred_idx") == F.col("_pred"))
    return predictions.join(found, on, "left").drop("_image", "_class", "_pred").withColumn("hits", F.coalesce("hits", F.lit(0)))


def best_overlap(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """predictions with the best overlap with a box of their class, and of any class with that class (-1: none)."""
    pairs = overlaps(predictions, truth, same_class=False)
    best = pairs.groupBy(F.col("image_id").alias("_image"), F.col("pred_idx").alias("_pred")).agg(
        F.max(F.when(F.col("pred_class") == F.col("gt_class"), F.col("iou"))).alias("same_iou"),
        F.max("iou").alias("any_iou"),
        F.max_by("gt_class", F.struct("iou", -F.col("gt_idx"))).alias("any_class"),
    )
    joined = predictions.join(best, (F.col("image_id") == F.col("_image")) & (F.col("pred_idx") == F.col("_pred")), "left").drop("_image", "_pred")
    return joined.withColumns({"same_iou": F.coalesce("same_iou", F.lit(0.0)), "any_iou": F.coalesce("any_iou", F.lit(0.0)), "any_class": F.coalesce("any_class", F.lit(-1))})


def false_positives(predictions: DataFrame, truth: DataFrame, has_truth: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Predictions that overlap no box of their class enough, with a category of what they are.

    Not exclusive: a second prediction of one true box isn't false here, though the greedy match counts it so.
    """
    rows = best_overlap(predictions, truth).where(F.col("same_iou") < threshold)
    images = truth.select(F.col("image_id").alias("_image")).distinct()
    rows = rows.join(images, F.col("image_id") == F.col("_image"), "left")
    kind = F.when(F.col("_image").isNull(), "no_ground_truth").when(F.col("any_iou") >= 0.5, "class_confusion").when(F.col("any_iou") >= 0.1, "localization").otherwise("background")
    return rows.withColumn("category", kind).drop("_image")


def missed(predictions: DataFrame, truth: DataFrame, target: int, confusing: Sequence[int], threshold: float = 0.5) -> DataFrame:
    """True boxes of the target class without a good prediction of it, with the best confusing one if there is one."""
    own = truth.where(F.col("class_id") == target)
    pairs = overlaps(predictions, own, same_class=False).where(F.col("iou") >= threshold)
    seen = pairs.groupBy(F.col("image_id").alias("_image"), F.col("gt_idx").alias("_gt")).agg(
        F.max(F.col("pred_class") == target).alias("found"),
        F.max(F.when(F.col("pred_class").isin(*confusing), F.struct("iou", "confidence", F.col("pred_class").alias("pred_class")))).alias("other"),
    )
    rows = own.join(seen, (F.col("image_id") == F.col("_image")) & (F.col("gt_idx") == F.col("_gt")), "left").where("not coalesce(found, false)")
    kind = F.when(F.col("other").isNotNull(), "misclassified").otherwise("missed")
    return rows.select("image_id", "gt_idx", "class_id", kind.alias("category"), F.col("other.pred_class").alias("confused_with"), F.col("other.iou").alias("iou"), F.col("other.confidence").alias("confidence"))


def view_support(predictions: DataFrame, views: DataFrame, threshold: float = 0.60, allowed: Sequence[int] | None = None) -> DataFrame:
    """predictions with support: one more than the views (or teachers) holding a box that overlaps enough, of the
    prediction's class or, if given, of an allowed class."""
    # an image's view boxes are one array, so each table is dealt by image once, or not at all if it is already
    boxes, image = fresh([*predictions.columns, *views.columns], "_boxes", "_image")
    v = views if allowed is None else views.where(F.col("class_id").isin(*allowed))
    v = v.where("view_id is not null").select(F.col("image_id").alias(image), F.struct("view_id", "class_id", *_sides("v")).alias(boxes))
    v = v.groupBy(image).agg(F.collect_list(boxes).alias(boxes))
    sides = fresh([*predictions.columns, boxes, image], *[f"_p_{n}" for n in _SIDES])
    joined = predictions.withColumns(dict(zip(sides, _sides("p"), strict=True))).join(v, F.col("image_id") == F.col(image), "left")
    share = lambda x: _overlap(dict(zip(_SIDES, map(F.col, sides), strict=True)), {n: x[f"v_{n}"] for n in _SIDES}) >= threshold
    near = F.filter(boxes, lambda x: ((x["class_id"] == F.col("class_id")) & share(x)) if allowed is None else share(x))
    votes = F.size(F.array_distinct(F.transform(near, lambda x: x["view_id"])))
    return joined.withColumn("support", F.when(F.col(boxes).isNull(), 1).otherwise(votes + 1).cast("int")).drop(boxes, image, *sides)


def confusion_pairs(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """gt_class, pred_class, n of the class-blind greedy match; -1 stands for no box on that side."""
    found = greedy_match(predictions, truth, (threshold,), same_class=False, misses=False)
    hits = found.groupBy(F.coalesce(F.col("gt_class"), F.lit(-1)).alias("gt_class"), F.col("class_id").alias("pred_class")).agg(F.count("*").alias("n"))
    # what of a class isn't matched is missed: its boxes less its cells
    taken = hits.groupBy(F.col("gt_class").alias("_class")).agg(F.sum("n").alias("_taken"))
    every = truth.groupBy(F.col("class_id").alias("gt_class")).agg(F.count("*").alias("_all"))
    left = every.join(taken, F.col("gt_class") == F.col("_class"), "left").select("gt_class", F.lit(-1).alias("pred_class"), (F.col("_all") - F.coalesce("_taken", F.lit(0))).alias("n"))
    return hits.unionByName(left.where("n > 0"))


def top_per_image(predictions: DataFrame, n: int = 1, by: Sequence[Column] | None = None) -> DataFrame:
    """predictions with rank, the first n of each image by the given order (confidence, then pred_idx)."""
    order = list(by) if by else [F.col("confidence").desc()]
    w = Window.partitionBy("image_id").orderBy(*order, "pred_idx")
    return predictions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def side_by_side(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per image, the boxes of two models: how many, and their classes by confidence. Images that one model leaves out have none of it."""

    def own(predictions: DataFrame, name: str) -> DataFrame:
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "pred_idx", "class_id")))
        classes = F.array_join(F.transform(ranked, lambda b: b["class_id"].cast("string")), ",")
        return predictions.groupBy("image_id").agg(F.count("*").alias(f"{name}_boxes"), classes.alias(f"{name}_classes"))

    both = own(first, "first").join(own(second, "second"), "image_id", "full")
    filled = lambda n: [F.coalesce(f"{n}_boxes", F.lit(0)).alias(f"{n}_boxes"), F.coalesce(f"{n}_classes", F.lit("")).alias(f"{n}_classes")]
    return both.select("image_id", *filled("first"), *filled("second"))
