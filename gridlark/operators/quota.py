"""Class quotas: images of a group in the order of their quality, each admitted if all of its classes have quota left.

The rule is a fold over a group's images, but what it decides changes only where a quota stops an image. So images are
admitted in runs: over the candidates of all groups at once, running sums find each group's first image that a quota stops;
all before it are admitted, and with what they use, every later image that can't fit any more leaves. Then the next run
begins behind the stop. A class's image quota stops one image; its box quota stops at most one for each number of boxes that
images have of it, as what is left falls below that number. Each run is a join and running sums over bins, so no group, and
no list of its images, is in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.catalog import CLASSES
from gridlark.operators.ranking import running
from gridlark.tables import Written

#: Fixed value: the reason in reports.
REASON = "balanced_class_quota"
_BIN = 13


def class_quota(decisions: DataFrame, images_per_class: int = 0, boxes_per_class: int = 0, box_overrides: Mapping[int, int] | None = None) -> DataFrame:
    """image_id, group, selected of the images with accepted boxes. Quotas of 0 or less don't limit; overrides are box quotas
    of single classes. Of images of equal quality the least image_id comes first."""
    boxes = {c: (box_overrides or {}).get(c, boxes_per_class) for c in CLASSES}
    # column of an image's use, and its quota, for every class and kind that is limited
    limits = {f"b{c}": (c, q) for c, q in boxes.items() if q > 0} | ({f"i{c}": (c, images_per_class) for c in CLASSES} if images_per_class > 0 else {})
    count = lambda c: F.count_if(F.col("class_id") == c)
    uses = {k: (count(c) if k[0] == "b" else F.least(count(c), F.lit(1))).cast("long").alias(k) for k, (c, _) in limits.items()}
    # mean quality is rounded for the order, so that equal images tie whatever the order of their sums
    images = decisions.where("accepted").groupBy("group", "image_id").agg(F.bround(F.avg("quality_score"), 9).alias("mean"), *uses.values())
    if not limits:
        return images.select("group", "image_id", F.lit(True).alias("selected"))
    ws = Written(decisions.sparkSession, "quota")
    # written before it is ordered, since the order's ranges are found by a pass of their own
    images = ws.table(ws.table(images).orderBy("group", F.col("mean").desc(), "image_id").withColumn("t", F.monotonically_increasing_id()))
    # every image carries what its group has used so far
    ahead, chosen = images.select("group", "t", *limits, *[F.lit(0).cast("long").alias(f"u_{k}") for k in limits]), None
    while ahead.limit(1).count():
        run = running(ahead, ["group"], F.shiftright("t", _BIN), [F.col("t")], {f"s_{k}": k for k in limits})
        over = reduce(Column.__or__, [(F.col(k) > 0) & (F.col(f"u_{k}") + F.col(f"s_{k}") > q) for k, (_, q) in limits.items()])
        # the first image that is stopped, and what was used up to it
        stop = F.min(F.when(over, F.struct("t", *[(F.col(f"u_{k}") + F.col(f"s_{k}") - F.col(k)).alias(k) for k in limits])))
        stops = run.groupBy(F.col("group").alias("_g")).agg(stop.alias("stop"))
        run = ahead.drop(*[f"u_{k}" for k in limits]).join(stops, F.col("group").eqNullSafe(F.col("_g")))
        run = ws.table(run.select("group", "t", *limits, F.col("stop.t").alias("stop"), *[F.col("stop")[k].alias(f"u_{k}") for k in limits]))
        taken = run.where("stop is null or t < stop").select("t")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        fits = reduce(Column.__and__, [(F.col(k) == 0) | (F.col(f"u_{k}") + F.col(k) <= q) for k, (_, q) in limits.items()])
        ahead = run.where("t > stop").where(fits).drop("stop")
    if chosen is None:
        return images.select("group", "image_id", F.lit(True).alias("selected"))
    marked = images.join(chosen.withColumn("_in", F.lit(True)), "t", "left")
    return marked.select("group", "image_id", F.coalesce("_in", F.lit(False)).alias("selected"))


def with_quota(decisions: DataFrame, chosen: DataFrame, earlier_rejects: bool = False) -> DataFrame:
    """decisions where the images that a quota left out have no accepted box, and the reason for it on the boxes that were.

    With ``earlier_rejects`` such an image's boxes that were rejected before get the reason, too.
    """
    left_out = chosen.where("not selected").select(F.col("group").alias("_g"), F.col("image_id").alias("_i"), F.lit(True).alias("_out"))
    rows = decisions.join(left_out, F.col("group").eqNullSafe(F.col("_g")) & (F.col("image_id") == F.col("_i")), "left")
    out = F.coalesce("_out", F.lit(False))
    told = out if earlier_rejects else out & F.col("accepted")
    rows = rows.withColumn("reasons", F.when(told, F.concat("reasons", F.array(F.lit(REASON)))).otherwise(F.col("reasons")))
    return rows.withColumn("accepted", F.col("accepted") & ~out).drop("_g", "_i", "_out")
