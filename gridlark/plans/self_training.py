"""The self-training loop over a predictions table: thresholds and accepted boxes carried from round to round.

What is carried is a map of one number per class and the rounds' accepted boxes, written to the shared folder like the
predictions themselves, so no lineage grows: each round starts from written tables. Training a detector between rounds is outside; its predictions are the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.boxes import dynamic_threshold
from gridlark.operators import decisions, metrics
from gridlark.tables import Written


def class_thresholds(ap: dict[int, float], classes: Sequence[int], spark) -> dict[int, float]:
    """By the average precision, to nine decimals."""
    rows = spark.createDataFrame([(c, ap.get(c)) for c in classes], "class_id int, ap double")
    return {r["class_id"]: r["t"] for r in rows.select("class_id", F.round(dynamic_threshold(F.col("ap")), 9).alias("t")).collect()}


def rounds(predictions: DataFrame, truth: DataFrame, classes: Sequence[int], count: int = 2) -> DataFrame:
    """round, image_id, pred_idx, class_id, quality_score of the boxes accepted in each round.

    predictions have expected and support. A round's thresholds come from the average precision, over all overlap
    thresholds, of the boxes that the round before accepted (at first: of all predictions).
    """
    spark, out = predictions.sparkSession, None
    ws = Written(spark, "rounds")
    # every round reads them twice
    current = predictions = ws.table(predictions)
    for number in range(count):
        rows = metrics.evaluate(current, truth, classes).where("class_id is not null").select("class_id", "ap50_95").collect()
        ap = {r["class_id"]: r["ap50_95"] for r in rows}
        thresholds = class_thresholds(ap, classes, spark)
        floor = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
        rows = predictions.where(F.col("class_id").isin(*classes)).withColumn("threshold", floor[F.col("class_id")])
        accepted = ws.table(decisions.decide(decisions.scored(rows)).where("accepted").select(*predictions.columns, "quality_score"))
        current = accepted.select(*predictions.columns)
        part = accepted.select(F.lit(number).alias("round"), "image_id", "pred_idx", "class_id", "quality_score")
        out = part if out is None else out.unionByName(part)
    return out
