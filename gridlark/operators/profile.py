"""Dataset profiles and views: images (dataset, split, image_id, stem), boxes or label statistics by image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.catalog import CLASSES


def dataset_profile(images: DataFrame, stats: DataFrame) -> DataFrame:
    """Per split: images, labels, objects, empty and missing labels, bad rows, boxes of each class.

    images (split, image_id); stats (image_id, valid, bad, boxes_<class>) has a row per label file.
    """
    rows = images.join(stats.withColumn("_has", F.lit(True)), "image_id", "left")
    has = F.coalesce("_has", F.lit(False))
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy("split").agg(
        F.count("*").alias("images"), F.count_if(has).alias("labels"), F.coalesce(F.sum("valid"), F.lit(0)).alias("objects"), F.count_if(has & (F.col("valid") == 0)).alias("empty_labels"),
        F.count_if(~has).alias("missing_labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_rows"), *[some(f"boxes_{n}") for n in CLASSES.values()],
    )


def image_profile(boxes: DataFrame) -> DataFrame:
    """Per image: objects and boxes of each class."""
    return boxes.groupBy("image_id").agg(F.count("*").alias("objects"), *[F.count_if(F.col("class_id") == i).alias(f"boxes_{n}") for i, n in CLASSES.items()])


def observed_classes(boxes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sorted classes that occur, per key."""
    return boxes.groupBy(*by).agg(F.array_sort(F.collect_set("class_id")).alias("classes"))


def masked(images: DataFrame, boxes: DataFrame, allowed: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Images and boxes of the allowed classes alone; images left without a box go."""
    kept = boxes.where(F.col("class_id").isin(*allowed))
    return images.join(kept.select("image_id").distinct(), "image_id", "left_semi"), kept


def presence(boxes: DataFrame) -> DataFrame:
    """class_id, images: in how many images a class occurs."""
    return boxes.groupBy("class_id").agg(F.countDistinct("image_id").alias("images"))


def unpaired(images: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images without a label file, and label files without an image."""
    key = ["split", "stem"]
    return images.join(labels, key, "left_anti"), labels.join(images, key, "left_anti")


def sources_united(*tables: DataFrame) -> DataFrame:
    """Rows of several sources under names that can't clash: src<i>_ before each name."""
    out = None
    for i, t in enumerate(tables):
        own = t.withColumns({"source_idx": F.lit(i), "sample_name": F.concat(F.lit(f"src{i}_"), F.col("name"))})
        out = own if out is None else out.unionByName(own)
    return out


def oversample_target(boxes: DataFrame) -> DataFrame:
    return presence(boxes).agg(F.max("images").alias("target"))
