"""Acceptance of predicted boxes as labels: gates, relabelling, caps and quotas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.boxes import aspect, box, quality, rounded, touches_edge
from gridlark.functions.catalog import CLASSES, IDS, class_name

# Limits of the hard gates, and the words used as reasons below.
LEAST_SIDE, LEAST_AREA, MOST_AREA, MOST_ASPECT, EDGE = 0.01, 0.0005, 0.70, 6, 0.002


def hard_gates(least_confidence: float = 0.5) -> Column:
    """Reasons against a predicted box by geometry alone; a box without extent has no further ones."""
    b = box()
    area = b.w * b.h
    size = [
        (F.least(b.w, b.h) < LEAST_SIDE, "side_too_small"),
        (area < LEAST_AREA, "area_too_small"),
        (area > MOST_AREA, "area_too_large"),
        (aspect(b) > MOST_ASPECT, "bad_aspect_ratio"),
        (touches_edge(b, EDGE), "edge_contact"),
    ]
    first = [(~F.col("class_id").isin(*CLASSES), "unknown_class"), (F.col("confidence") < least_confidence, "low_confidence")]
    named = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules]))
    empty = (b.w <= 0) | (b.h <= 0)
    return F.concat(named(first), F.when(empty, F.array(F.lit("non_positive_box"))).otherwise(named(size)))


def scored(predictions: DataFrame) -> DataFrame:
    """predictions (with threshold and expected class, which may be null) and quality_score, reasons."""
    score, reasons = quality(F.col("class_id"), F.col("confidence"), F.col("threshold"), box(), F.col("expected"))
    return predictions.withColumns({"quality_score": score, "reasons": reasons})


def decide(
    rows: DataFrame,
    least_quality: float = 0.72,
    least_support: int = 2,
    least_votes: int | None = None,
    reject_edge: bool = False,
    allow_mismatch: bool = False,
    rescue: Mapping[str, float] | None = None,
    relabel: Mapping[int, Sequence[int]] | None = None,
    relabel_rules: tuple[float, float, int] = (0.80, 0.55, 1),
) -> DataFrame:
    """Scored rows (support, votes, ordinal_votes) with accepted and the final class and reasons.

    Accepted is what has support, quality, no class mismatch, votes and no forbidden edge; or what is rescued: a
    neighbour on the ripeness scale where the folder says under-ripe, with votes of the scale's classes; or what is
    relabelled by the folder. The relabelling sees the class after a rescue. Reasons of failed gates come last.
    """
    drops = F.array(F.lit("folder_class_mismatch"), F.lit("below_dynamic_threshold"))
    cleaned = lambda r: F.filter(r, lambda x: ~F.array_contains(drops, x))
    no = F.lit(False)
    under = IDS["under_ripe"]
    out = rows.withColumn("_support_ok", F.col("support") >= least_support).withColumn("_quality_ok", F.col("quality_score") >= least_quality)
    out = out.withColumn("_folder_ok", F.lit(allow_mismatch) | ~F.array_contains("reasons", "folder_class_mismatch"))
    out = out.withColumn("_edge_ok", F.lit(not reject_edge) | ~F.array_contains("reasons", "edge_contact"))
    out = out.withColumn("_votes_ok", F.lit(True) if least_votes is None else F.col("votes") >= least_votes)
    out = out.withColumn("_rescued", no)
    if rescue is not None:
        fits = (F.col("expected") == under) & F.col("class_id").isin(IDS["ripe"], IDS["unripe"])
        fits &= (F.col("confidence") >= rescue["confidence"]) & (F.col("quality_score") >= rescue["quality"]) & (F.col("support") >= rescue["support"]) & (F.col("ordinal_votes") >= rescue["votes"])
        out = out.withColumn("_rescued", F.coalesce(fits, no))
        note = F.concat(F.lit("ordinal_under_ripe_rescue_from_"), class_name(F.col("class_id")))
        out = out.withColumn("reasons", F.when(F.col("_rescued"), F.concat(cleaned(F.col("reasons")), F.array(note))).otherwise(F.col("reasons")))
        out = out.withColumn("class_id", F.when(F.col("_rescued"), F.lit(under)).otherwise(F.col("class_id")))
    out = out.withColumn("_relabelled", no)
    if relabel is not None:
        source = F.create_map(*[x for k, v in relabel.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
        q, c, s = relabel_rules
        fits = F.array_contains(source[F.col("expected")], F.col("class_id")) & (F.col("confidence") >= c) & (F.col("quality_score") >= q) & (F.col("support") >= s) & ~F.array_contains("reasons", "edge_contact")
        out = out.withColumn("_relabelled", F.coalesce(fits, no))
        note = F.concat(F.lit("folder_guided_relabel_from_"), class_name(F.col("class_id")))
        out = out.withColumn("reasons", F.when(F.col("_relabelled"), F.concat(cleaned(F.col("reasons")), F.array(note))).otherwise(F.col("reasons")))
        out = out.withColumn("class_id", F.when(F.col("_relabelled"), F.col("expected")).otherwise(F.col("class_id")))
    ok = F.col("_support_ok") & F.col("_quality_ok") & F.col("_folder_ok") & F.col("_votes_ok") & F.col("_edge_ok")
    failed = [("_support_ok", "low_consistency_support"), ("_quality_ok", f"low_quality_score<{least_quality:.3f}"), ("_votes_ok", f"low_ensemble_support<{least_votes}"), ("_edge_ok", "strict_edge_rejection")]
    more = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(r)) for c, r in failed]))
    out = out.withColumn("accepted", ok | F.col("_rescued") | F.col("_relabelled"))
    out = out.withColumn("reasons", F.when(F.col("accepted"), F.col("reasons")).otherwise(F.concat("reasons", more)))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def first_failure(least_support: int = 2, least_quality: float = 0.68) -> Column:
    """The simpler rule: the first thing that fails, null for an accepted box."""
    return F.when(~F.col("class_id").isin(*CLASSES), "unknown_class").when(F.col("support") < least_support, "low_support").when(F.col("quality_score") < least_quality, "low_quality").when(F.array_contains("reasons", "folder_class_mismatch"), "folder_mismatch")


def capped(decisions: DataFrame, most: int = 40, reject_all: bool = False) -> DataFrame:
    """Accepted boxes beyond the best ``most`` of an image are rejected, or all of such an image's."""
    order = Window.partitionBy("image_id", "accepted").orderBy(F.col("quality_score").desc(), F.col("confidence").desc(), F.col("support").desc(), "pred_idx")
    whole = Window.partitionBy("image_id", "accepted")
    over = (F.count("*").over(whole) > most) if reject_all else (F.row_number().over(order) > most)
    rows = decisions.withColumn("_over", over & F.col("accepted"))
    note = "too_many_boxes" if reject_all else "per_image_top_quality_truncation"
    rows = rows.withColumn("reasons", F.when(F.col("_over"), F.concat("reasons", F.array(F.lit(note)))).otherwise(F.col("reasons")))
    return rows.withColumn("accepted", F.col("accepted") & ~F.col("_over")).drop("_over")


def image_summary(decisions: DataFrame) -> DataFrame:
    """Per image: accepted and rejected boxes, mean quality of the accepted, the sorted reasons."""
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons"))))
    rows = decisions.groupBy("image_id").agg(F.count_if("accepted").alias("accepted_boxes"), F.count_if(~F.col("accepted")).alias("rejected_boxes"), rounded(F.avg(F.when(F.col("accepted"), F.col("quality_score")))).alias("mean_quality"), reasons.alias("_r"))
    joined = F.array_join(F.when(F.size("_r") > 0, F.col("_r")).otherwise(F.array(F.lit("no_valid_box"))), "|")
    return rows.withColumn("status", F.when(F.col("accepted_boxes") > 0, "accepted").otherwise("rejected")).withColumn("reasons", joined).drop("_r")


def reason_counts(decisions: DataFrame) -> DataFrame:
    """reason, n over all boxes."""
    return decisions.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
