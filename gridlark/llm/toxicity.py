"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, a sample of all texts is unlabelled. A linear model over log counts of
lower-cased words and of their beginnings of 4 to 8 bytes, hashed to 2^18 places of which the PLACES most telling
and the COMMON most frequent are kept, is trained in numpy on the non-negative risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic loss: where the corrected negative risk
falls below zero, the step goes against its gradient, as published. The class prior is the share of toxic rows
among the labels learned from. Weights shrink by a soft threshold, so that words without evidence weigh nothing.

The fit uses at most POSITIVES toxic and UNLABELLED whole texts, those with the least hash of their id;
every document is scored. Scores lie in 0 .. 1; 0.7 is the threshold. Null and empty texts get the score of no
words. Null labels teach nothing; of repeated labels the highest counts, of the texts of a repeated id one; without
positives all scores are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import NOT_ALNUM, Spans, Workspace, arrow_map, byte_values, mix, prepare, slices, words
from gridlark.llm.language import fold

BITS = 18
BEGINNINGS = (4, 5, 6, 7, 8)
POSITIVES = 3000
UNLABELLED = 9000
PLACES = 4096
COMMON = 600
LEAST = 4  # positives with a telling place
EVIDENCE = 15.0  # of a telling place, as chi-squared
STEPS = 250
RATE = 0.05
SHRINK = 1e-3
THRESHOLD = 0.7
_U = np.uint64


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, log count) of the distinct hashed words and beginnings of each row of lower-cased text."""
    start, end, row = words(data, at, NOT_ALNUM)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    spans = Spans(data, byte_values(3))
    keys = [(row.astype(np.uint64) << _U(BITS)) | (spans.hash(start, end) >> _U(64 - BITS))]
    for n in BEGINNINGS:
        long = end - start >= n
        first, own = start[long], row[long].astype(np.uint64)
        keys.append((own << _U(BITS)) | (mix(spans.hash(first, first + n) + _U(n)) >> _U(64 - BITS)))
    key = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> _U(BITS)).astype(np.int64), (key & _U((1 << BITS) - 1)).astype(np.int64), np.log1p(count).astype(np.float32)


class Rows:
    """A sparse matrix of some documents."""

    def __init__(self, n: int, row: np.ndarray, place: np.ndarray, value: np.ndarray):
        self.n, self.row, self.place, self.value = n, row, place, value

    def dot(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.place], self.n) + b

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.place, self.value * g[self.row], size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The non-negative risk of scores of positives and unlabelled texts; logistic loss."""
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    return float(prior * np.logaddexp(0, -fp).mean() + max(negative, 0.0))


def risk_gradient(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the non-negative risk, by the scores of positives and unlabelled; logistic loss."""
    sp, su = sigmoid(fp), sigmoid(fu)
    # losses: of +1 log(1 + e^-f), of -1 log(1 + e^f)
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    if negative >= 0:
        return ((sp - 1) - sp) * prior / len(fp), su / len(fu)
    return sp * prior / len(fp), -su / len(fu)


def train(positive: Rows, unlabelled: Rows, size: int, prior: float, steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK) -> tuple[np.ndarray, float]:
    """Weights and bias: Adam steps with soft thresholds, then slope and bias alone, which undo the shrinkage."""
    w, b = np.zeros(size), np.log(prior / (1 - prior))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        gp, gu = risk_gradient(positive.dot(w, b), unlabelled.dot(w, b), prior)
        g = np.append(positive.back(gp, size) + unlabelled.back(gu, size), gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        scale = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        step = scale * m / (1 - 0.9**t)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - shrink * np.minimum(scale[:-1], 1e3), 0)
        b = b - step[-1]
    fp, fu, slope = positive.dot(w, 0), unlabelled.dot(w, 0), 1.0
    m, v = np.zeros(2), np.zeros(2)
    for t in range(1, 2 * steps + 1):
        gp, gu = risk_gradient(slope * fp + b, slope * fu + b, prior)
        g = np.array([gp @ fp + gu @ fu, gp.sum() + gu.sum()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        slope, b = np.array([slope, b]) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return slope * w, float(b)


def frequencies(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many positives and in how many unlabelled texts each place occurs; sample: (text, positive)."""

    def run(batches):
        for batch in batches:
            positive = batch.column(1).to_numpy(zero_copy_only=False)
            total = np.zeros((2, 1 << BITS), np.int64)
            for i, j, data, at in slices(pc.utf8_lower(batch.column(0).cast(pa.string()))):
                row, place, _ = features(data, at)
                for c in (0, 1):
                    total[c] += np.bincount(place[positive[i:j][row] == c], minlength=1 << BITS)
            there = np.flatnonzero(total.sum(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[1][there]), pa.array(total[0][there])], ["place", "p", "u"])

    rows = arrow_map(sample.select("text", F.col("positive").cast("int")), run, "place long, p long, u long")
    found = rows.groupBy("place").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toPandas()
    p, u = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    p[found["place"]], u[found["place"]] = found["p"], found["u"]
    return p, u


def matrix(sample: DataFrame, places: np.ndarray) -> list[Rows]:
    """Unlabelled and positive rows over the chosen places alone."""
    sent = sample.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        places = sent.value
        for batch in batches:
            positive = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, at in slices(pc.utf8_lower(batch.column(0).cast(pa.string()))):
                row, place, value = features(data, at)
                where = np.minimum(np.searchsorted(places, place), len(places) - 1)
                kept = places[where] == place
                cut = np.searchsorted(row[kept], np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(positive[i:j]), pa.ListArray.from_arrays(pa.array(cut), pa.array(where[kept].astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut), pa.array(value[kept]))], ["positive", "place", "value"])

    table = arrow_map(sample.select("text", F.col("positive").cast("int")), run, "positive int, place array<int>, value array<float>").toArrow()
    out = []
    for c in (0, 1):
        own = table.filter(pc.equal(table["positive"], c)).combine_chunks()
        n = own.num_rows
        length = np.asarray(pc.list_value_length(own["place"]))
        out.append(Rows(n, np.repeat(np.arange(n), length), np.asarray(pc.list_flatten(own["place"])), np.asarray(pc.list_flatten(own["value"]))))
    return out


def learn(ws: Workspace, docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Places, weights and bias from docs (doc_id, text) and labels (doc_id, toxic), rows held out already left away."""
    toxic = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = toxic.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    if not counts["p"] or counts["p"] == counts["n"]:
        return None
    least = [F.xxhash64("doc_id"), F.col("doc_id")]
    # ids first, so that only the chosen texts are read back; both lists are bounded by the parameters
    positive = toxic.where("toxic = 1").orderBy(*least).limit(POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    # the unlabelled come from all documents, so that positives are among them at the rate of the prior
    other = docs.select("doc_id").distinct().orderBy(*least).limit(UNLABELLED).select("doc_id", F.lit(False).alias("positive"))
    chosen = docs.join(F.broadcast(positive.union(other)), "doc_id").groupBy("doc_id", "positive")
    sample = ws.table(chosen.agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).select("text", "positive"))
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if len(sizes) < 2:
        return None
    p, u = frequencies(sample)
    # places far more frequent in positives than chance allows, and the most frequent ones, which stand for
    # language and length
    odds = np.log((p + 0.5) / (sizes[True] + 1)) - np.log((u + 0.5) / (sizes[False] + 1))
    due = (u + 0.5) * sizes[True] / sizes[False]
    telling = np.flatnonzero((p >= LEAST) & (odds > 1) & ((p - due) ** 2 / due > EVIDENCE))
    telling = telling[np.argsort(-(p * odds)[telling], kind="stable")[:PLACES]]
    common = np.argsort(-u, kind="stable")[:COMMON]
    places = np.unique(np.concatenate([telling, common[u[common] > 0]]))
    if not len(places):
        return None
    unlabelled, positives = matrix(sample, places)
    return places, *train(positives, unlabelled, len(places), counts["p"] / counts["n"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """docs and score; the columns must include text."""
    names, kinds = docs.columns, docs.dtypes
    column = names.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        if model is not None:
            weights = np.zeros(1 << BITS, np.float32)
            weights[model[0]] = model[1]
        for batch in batches:
            out = []
            for i, j, data, at in slices(pc.utf8_lower(batch.column(column).cast(pa.string()))):
                if model is None:
                    out.append(np.zeros(j - i))
                    continue
                row, place, value = features(data, at)
                out.append(sigmoid(np.bincount(row, value * weights[place], j - i) + model[2]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], [*names, "score"])

    return arrow_map(docs, run, ", ".join([*[f"`{c}` {t}" for c, t in kinds], "score double"]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    open_rows = fold(F.col("doc_id"), 3) != 1
    model = learn(Workspace(spark, "toxicity"), docs.where(open_rows), labels.where(open_rows).select("doc_id", "toxic"))
    found = score(docs, model)
    return found.select("doc_id", (~open_rows).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
