from pyspark.sql import functions as F

from gridlark.functions import catalog
from gridlark.streaming import batches


def test_batches_get_the_operator(spark, tmp_path):
    spark.createDataFrame([("Masak",), ("ffb",)], "name string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string").parquet(str(tmp_path / "in"))
    run = batches.each_batch(stream, lambda df: df.withColumn("class_id", catalog.class_id(F.col("name"), -1)), str(tmp_path / "out"), str(tmp_path / "log"))
    run.awaitTermination(60)
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.name, r.class_id) for r in got) == [("Masak", 3), ("ffb", -1)]


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")]
    spark.createDataFrame(rows, "ts string, kind string").select(F.to_timestamp("ts").alias("ts"), "kind").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    run = batches.windowed_counts(stream, "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r.kind, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_log_lines(spark):
    df = spark.createDataFrame([("t", "start", 1)], "time string, event string, n int").withColumn("payload", F.struct("n"))
    assert batches.log_lines(df).first().value == '{"time":"t","event":"start","payload":{"n":1}}'
