"""Tables written to the folder that the driver and all executors share, and names that no column has yet."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A session of one process without one gets a temporary folder, a cluster an error.

    ``local-cluster[..]`` is a cluster: its executors are processes of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gridlark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Written:
    """Written tables of one call: each cuts the lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it differ from all columns, letter case aside."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
