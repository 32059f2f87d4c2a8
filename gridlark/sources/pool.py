"""A pool of images that grows: what is there already is skipped, by a written ledger of what every batch added.

A pool's places are (class folder, file name), letter case counting. Of the files of a batch that want one place the first path
gets it, and only if no other batch has filled it. A batch's rows are one folder of the ledger, written as a whole: a batch that is run again
under its name, after a failure or by mistake, replaces its own rows with the same ones and changes nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.catalog import IMAGE_EXTENSIONS
from gridlark.functions.names import extension, file_name, scene_folder
from gridlark.sources.datasets import below

_LEDGER = "place string, name string, path string, batch string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """place, name, path, batch of everything in the pool; an empty table where there is none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or not fs.listStatus(hadoop):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).option("basePath", path).parquet(path)


def candidates(files: DataFrame, folder: str) -> DataFrame:
    """place (the folder right below ``folder``), name, path of the images further down; images in ``folder`` itself have no place and go."""
    rest = below(F.col("path"), folder)
    rows = files.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS) & F.contains(rest, F.lit("/")))
    return rows.select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("place"), file_name(F.col("path")).alias("name"), "path")


def append(spark: SparkSession, wanted: DataFrame, path: str, batch: str) -> DataFrame:
    """Adds the batch (place, name, path) to the pool's ledger, and returns the rows that it added."""
    there = ledger(spark, path).where(F.col("batch") != batch).select("place", "name")
    first = wanted.groupBy("place", "name").agg(F.min("path").alias("path"))
    target = f"{path.rstrip('/')}/batch={batch}"
    first.join(there, ["place", "name"], "left_anti").select("place", "name", "path").write.mode("overwrite").parquet(target)
    return spark.read.schema("place string, name string, path string").parquet(target)


def scenes(files: DataFrame, root: str) -> DataFrame:
    """scene, images, first, last: the images of each scene folder below a root, with the first and last path in order."""
    images = files.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS))
    return images.groupBy(scene_folder(F.col("path"), root, False).alias("scene")).agg(F.count("*").alias("images"), F.min("path").alias("first"), F.max("path").alias("last"))
