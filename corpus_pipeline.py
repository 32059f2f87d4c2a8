"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

Language identification drops documents of no language, near-duplicate removal keeps one document of each group,
decontamination cuts benchmark passages out of texts, mixing takes each document as often as its source's
target asks, and sharding gives every row its shard and slot. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm import decontaminate, language, mixing, neardup, sharding
from gridlark.llm.common import Workspace, doubtful_ids, numbered, packed_up, prepare, unpacked
from gridlark.tables import fresh

#: Columns that stages look at; others go along as one.
NEEDED = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters are in no language and go; all others stay.

    Where no language can be learned (no labels, or only labels of held-out rows), texts with a letter stay by that rule alone.
    """
    prepare(spark)
    langs, logs = language.learned(docs.select("doc_id", "text", "lang"))
    if not langs:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    needed = [c for c in docs.columns if c in NEEDED]
    packed, rest = packed_up(docs, needed)
    return unpacked(language.identify(packed, langs, logs).where("lang_pred <> 'und'"), docs, needed, rest)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by shingles of five words at 0.8, the one with the least id stays.

    Rows are judged by their texts, also where they share an id or have none: rows without an id come after all
    others, rows of one id are told apart by their contents. Rows of one id and text are one document.
    """
    prepare(spark)
    ws = Workspace(spark, "neardup")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not doubtful_ids(docs):
        found = neardup.linked(ws, docs.select(F.col("doc_id").alias("key"), "text"), k=5)
        gone = ws.table(found.where("key <> component").select(F.col("key").alias("doc_id")))
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    name, = fresh(docs.columns, "_key")
    keyed = numbered(ws, docs, name)
    found = neardup.linked(ws, keyed.select(F.col(name).alias("key"), "text"), k=5)
    gone = found.where("key <> component").select("key")
    # texts without a word are linked to nothing; of those of one id, equal ones are one document
    bare = found.where("n_shingles = 0").select("key")
    text = [F.coalesce("text", F.lit("")).alias("shown"), F.col("text").isNull().alias("none")]
    bare = keyed.where("doc_id is not null").select("doc_id", F.col(name).alias("key"), *text).join(bare, "key")
    first = bare.groupBy("doc_id", "shown", "none").agg(F.min("key").alias("first"))
    again = bare.join(first, ["doc_id", "shown", "none"]).where("key <> first").select("key")
    gone = ws.table(gone.unionByName(again))
    return keyed.join(gone.withColumnRenamed("key", name), name, "left_anti").select(*columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages leave the texts; documents of nothing else go."""
    prepare(spark)
    needed = [c for c in docs.columns if c in NEEDED]
    packed, rest = packed_up(docs, needed)
    clean = decontaminate.cleaned(packed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    if "n_chars" in needed:
        clean = clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return unpacked(clean, docs, needed, rest)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to three times."""
    prepare(spark)
    return mixing.mixed(Workspace(spark, "mix"), docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, size, text_crc32, hilbert, shard and slot of every row."""
    prepare(spark)
    return sharding.shard(Workspace(spark, "shards"), sharding.measured(docs))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Language models, sketches and checksums have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = ws.table(docs)
    return docs
