"""Sharding by Hilbert-curve order, in DataFrame functions only.

Metadata dimensions are quantised to ``bits`` bits each, turned into a Hilbert index (Skilling's transform as
column expressions), and rows sorted by that index are cut into runs of equal counts, so each shard covers a
compact box in every dimension and files prune on each of them. Values are quantised by their place in the cumulative
share of rows, which keeps their order and uses all codes; numbers are put on a log scale of 2^FINE steps before, so
that few values are left to count.

The order is total: index, a hash of the id, the id. A hot cell (equal metadata in a third of all rows) therefore
spans many tasks and shards. Law ``rows``: counts differ by one at most. That law can't keep equal texts in one
shard: a text in a third of all rows would make its shard five times too large; text_crc32 names such a group. Null
text has size 1; null metadata are the first code; repeated rows are placed one by one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.common import Workspace, ordered_prefix, prepare

SHARDS = 16
BITS = 5
FINE = 10


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a point with 0 .. 2^bits - 1 in each of two or more axes."""
    n = len(axes)
    tops = F.array(*[_long(1 << b) for b in range(bits - 1, 0, -1)])
    numbers = F.array(*[F.lit(i) for i in range(n)])
    start = F.array(*[a.cast("long") for a in axes])

    def undo(x: Column, q: Column) -> Column:
        p = q - _long(1)

        def one(acc: Column, i: Column) -> Column:
            own, first = F.get(acc, i), F.get(acc, F.lit(0))
            hit, swap = own.bitwiseAND(q) != 0, first.bitwiseXOR(own).bitwiseAND(p)
            at_first = F.when(hit, first.bitwiseXOR(p)).otherwise(first.bitwiseXOR(swap))
            return F.transform(acc, lambda v, j: F.when(j == 0, at_first).when((j == i) & ~hit, v.bitwiseXOR(swap)).otherwise(v))

        return F.aggregate(numbers, x, one)

    def gray(acc: Column, i: Column) -> Column:
        return F.transform(acc, lambda v, j: F.when((j == i) & (i > 0), v.bitwiseXOR(F.get(acc, i - 1))).otherwise(v))

    def flip(acc: Column, q: Column) -> Column:
        return F.when(F.get(acc, F.lit(n - 1)).bitwiseAND(q) != 0, F.get(acc, F.lit(n)).bitwiseXOR(q - _long(1))).otherwise(F.get(acc, F.lit(n)))

    x = F.aggregate(tops, start, undo)
    x = F.aggregate(numbers, x, gray)
    x = F.aggregate(tops, F.concat(x, F.array(_long(0))), lambda acc, q: F.transform(acc, lambda v, j: F.when(j == n, flip(acc, q)).otherwise(v)))
    # x holds the Gray code and, last, what flips it; read the bits from the top, axis by axis
    places = F.array(*[F.struct(F.lit(i).alias("axis"), _long(1 << b).alias("bit")) for b in range(bits - 1, -1, -1) for i in range(n)])
    bit = lambda acc, at: F.when(F.get(acc, at["axis"]).bitwiseXOR(F.get(acc, F.lit(n))).bitwiseAND(at["bit"]) != 0, 1).otherwise(0)
    walk = F.aggregate(places, F.concat(x, F.array(_long(0))), lambda acc, at: F.transform(acc, lambda v, j: F.when(j == n + 1, v * 2 + bit(acc, at)).otherwise(v)))
    return F.get(walk, F.lit(n + 1))


def log_code(number: Column, bits: int = BITS) -> Column:
    """Numbers from 1 to 2^40 on a log scale, as 0 .. 2^bits - 1; null is 0."""
    scaled = F.floor(F.log2(F.greatest(number, F.lit(1)).cast("double")) * ((1 << bits) / 40.0))
    return F.coalesce(F.least(scaled, F.lit((1 << bits) - 1)), F.lit(0)).cast("long")


def share_codes(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """column, code: values by their place in the cumulative share of rows. One row per value is sorted."""
    counts = rows.groupBy(column).agg(F.count("*").alias("_n"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy(F.col(column).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("_n").over(before), F.lit(0)) * (1 << bits) / F.sum("_n").over(every)
    return counts.select(column, F.floor(place).cast("long").alias("_code"))


def shard(ws: Workspace, docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """docs (doc_id, size, lang, source, more; no text needed) -> and hilbert, shard, slot."""
    rows = docs.withColumn("_step", log_code(F.col("size"), FINE))
    axes = {"lang": "_lang", "source": "_source", "_step": "_size"}
    for column, name in axes.items():
        codes = share_codes(rows, column, bits).withColumnsRenamed({column: "_value", "_code": name})
        rows = rows.join(codes, rows[column].eqNullSafe(codes["_value"]), "left").drop("_value")
    rows = rows.withColumn("hilbert", hilbert_index([F.col(c) for c in axes.values()], bits)).drop("_step", *axes.values())
    rows = rows.withColumn("_hash", F.xxhash64("doc_id")).withColumn("_tie", F.monotonically_increasing_id()).withColumn("_one", F.lit(1).cast("long"))
    order = [F.col("hilbert"), F.col("_hash"), F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    rows = ordered_prefix(ws, rows.withColumn("_all", F.lit(0)), order, ["_all"], {"_rank": "_one"})
    # one number for the whole table; row r of N goes to the last shard that starts at or before it; shard k starts at ceil(k * N / shards)
    total = max(docs.count(), 1)
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    rows = rows.withColumn("shard", F.expr(f"(_rank * {shards}L) div {total}L").cast("int")).withColumn("slot", (F.col("_rank") - first).cast("long"))
    return rows.drop("_hash", "_tie", "_one", "_all", "_rank")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, size, text_crc32 of whole texts; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def write(placed: DataFrame, path: str, files: int = 1) -> None:
    """One folder per shard and about ``files`` files in it, each a run of slots in their order, so that readers prune files by each
    dimension's range and no task sorts more than one file's rows."""
    shards = max(placed.select("shard").distinct().count(), 1)
    dealt = placed.repartition("shard") if files == 1 else placed.repartitionByRange(shards * files, "shard", "slot")
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = shard(Workspace(spark, "shards"), measured(docs))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


QUERIES = {"op10_hilbert_shards": op10_hilbert_shards}
ORACLES: dict[str, str] = {}
