"""Language identification as inference of a multilingual mixture.

Each language has a distribution over hashed 4-byte n-grams of lower-cased letters. For a document,
expectation-maximisation estimates the proportion of each language from its n-grams' likelihoods; then the sets of
the 1, 2, 3, .. languages with the largest proportions are compared by penalised likelihood (a language more costs
PENALTY * log(n) / 2), and the largest language of the chosen set is the prediction. A set of a size is tried only
where the likelihood of all languages together, which no set exceeds, could still pay its penalty. The score is the
prediction's proportion, lessened where the runner-up is close.

The model is fitted on at most TRAIN_DOCS different labelled documents per language, those with the least hash of
their id and text, of whole texts; every document is scored. Nothing but the sample's counts (languages x 32768) and
the languages' row counts reach the driver, and no documents are shuffled for scoring.

Null text or text without a letter: ``und``, score 0. If no language can be learned, all are ``und``. Null
languages teach nothing; repeated rows teach once and are scored alike; extra columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.common import SLICE_BYTES, arrow_map, prepare, slices, with_fields

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
GRAM = 4
TRAIN_DOCS = 1000
SMOOTHING = 0.05
ROUNDS = 12
PENALTY = 8.0
MIX = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
#: Letters of ASCII and all bytes of longer characters stay, anything else is a space.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row * BUCKETS + bucket), sorted, and their counts; each row is set in spaces."""
    rows = len(at) - 1
    pad = GRAM - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    text = np.full(len(data) + pad * (rows + 1), 0x20, np.uint8)
    text[np.arange(len(data)) + pad * (row + 1)] = LETTERS[data]
    code = text[: len(text) - pad].astype(np.uint32)
    for j in range(1, GRAM):
        code |= text[j : len(text) - pad + j].astype(np.uint32) << np.uint32(8 * j)
    # a window belongs to the row whose text or leading spaces it begins in
    owner = np.repeat(np.arange(rows), np.diff(at) + pad)
    code = code[: len(owner)]
    real = code != 0x20202020
    bucket = (code[real] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    key = np.sort((owner[real].astype(np.uint32) << np.uint32(BUCKET_BITS)) | bucket)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new].astype(np.int64), np.diff(np.append(new, len(key)))


def has_letter(text: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)


def fit(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of buckets, from (text, lang) rows."""

    def run(batches):
        for batch in batches:
            lower = pc.utf8_lower(batch.column(0).cast(pa.string()))
            langs = batch.column(1).to_pylist()
            totals: dict[str, np.ndarray] = {}
            for i, _, data, at in slices(lower):
                key, count = grams(data, at)
                row, bucket = key >> BUCKET_BITS, key & (BUCKETS - 1)
                ends = np.searchsorted(row, np.arange(len(at)))
                for r in range(len(at) - 1):
                    own = totals.setdefault(langs[i + r], np.zeros(BUCKETS, np.int64))
                    own[bucket[ends[r] : ends[r + 1]]] += count[ends[r] : ends[r + 1]]
            for lang, own in totals.items():
                there = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there)), pa.array(there), pa.array(own[there])], ["lang", "bucket", "n"])

    rows = arrow_map(sample.select("text", "lang"), run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = rows.toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.full((len(langs), BUCKETS), SMOOTHING)
    counts[np.searchsorted(langs, found["lang"]), found["bucket"]] += found["n"]
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def mixture(p: np.ndarray, count: np.ndarray, doc: np.ndarray, start: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM of each document's proportions: (share, log-likelihood). p: n-gram likelihoods; start: first row of each document."""
    for _ in range(rounds):
        w = p * share[doc]
        w *= (count / np.maximum(w.sum(axis=1), 1e-30))[:, None]
        share = np.add.reduceat(w, start, axis=0)
        share /= share.sum(axis=1, keepdims=True)
    seen = np.maximum((p * share[doc]).sum(axis=1), 1e-30)
    return share, np.add.reduceat(count * np.log(seen), start)


def infer(key: np.ndarray, count: np.ndarray, logs: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, its certainty, proportions of the chosen set) for each row; -1 and zeros without n-grams."""
    best, score, shares = np.full(rows, -1), np.zeros(rows), np.zeros((rows, logs.shape[0]), np.float32)
    doc, bucket = key >> BUCKET_BITS, key & (BUCKETS - 1)
    if not len(doc):
        return best, score, shares
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ids = doc[start]
    doc = np.repeat(np.arange(len(ids)), np.diff(np.append(start, len(doc))))
    count = count.astype(np.float32)
    logp = np.ascontiguousarray(logs[:, bucket].T)
    alone = np.add.reduceat(logp * count[:, None], start, axis=0)
    # scaled by the best language's likelihood, which the proportions don't feel
    top = logp.max(axis=1, keepdims=True)
    p = np.exp(logp - top)
    share, most = mixture(p, count, doc, start, np.full((len(ids), logs.shape[0]), 1 / logs.shape[0], np.float32), ROUNDS)
    n = np.add.reduceat(count, start)
    pick = alone.argmax(axis=1)
    value = alone.max(axis=1)
    part = np.ones(len(ids), np.float32)
    of_set = np.zeros((len(ids), logs.shape[0]), np.float32)
    of_set[np.arange(len(ids)), pick] = 1
    order = np.argsort(-share, axis=1, kind="stable")
    offset = np.add.reduceat(count * top[:, 0], start)
    for size in range(2, logs.shape[0] + 1):
        some = np.flatnonzero(most + offset - PENALTY * (size - 1) * np.log(np.maximum(n, 2)) / 2 > value)
        if not len(some):
            break
        chosen = np.zeros((len(ids), logs.shape[0]), np.float32)
        rows_some = np.repeat(some, size)
        chosen[rows_some, order[some, :size].ravel()] = share[rows_some, order[some, :size].ravel()]
        inside = np.isin(doc, some)
        number = np.full(len(ids), -1)
        number[some] = np.arange(len(some))
        d = number[doc[inside]]
        s = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        first = chosen[some] / np.maximum(chosen[some].sum(axis=1, keepdims=True), 1e-30)
        got, like = mixture(p[inside], count[inside], d, s, first.astype(np.float32), 5)
        like = like + offset[some] - PENALTY * (size - 1) * np.log(np.maximum(n[some], 2)) / 2
        better = like > value[some]
        value[some[better]] = like[better]
        pick[some[better]] = got[better].argmax(axis=1)
        part[some[better]] = got[better].max(axis=1)
        of_set[some[better]] = got[better]
    best[ids], shares[ids] = pick, of_set
    # the evidence against the runner-up, per document, bounds the certainty of a set of one
    others = np.where(np.arange(logs.shape[0]) == pick[:, None], -np.inf, alone)
    margin = alone[np.arange(len(ids)), pick] - others.max(axis=1) if logs.shape[0] > 1 else np.full(len(ids), 50.0)
    score[ids] = np.clip(part / (1 + np.exp(-np.clip(margin / 4, -30, 30))), 0, 1)
    return best, score, shares


def identify(docs: DataFrame, langs: list[str], logs: np.ndarray, text: str = "text") -> DataFrame:
    """docs and lang_pred, lang_score, and lang_mix: the languages of the chosen set and their proportions, largest first.

    Columns of these names are replaced."""
    docs = docs.drop("lang_pred", "lang_score", "lang_mix")
    names = docs.columns
    column = names.index(text)
    sent = docs.sparkSession.sparkContext.broadcast((langs, logs))

    def run(batches):
        langs, logs = sent.value
        most = max(SLICE_BYTES * 8 // max(len(langs), 8), 1 << 16)
        for batch in batches:
            raw = batch.column(column).cast(pa.string())
            lower, letters = pc.utf8_lower(raw), has_letter(raw)
            pred, score, mixes = [], [], []
            for i, j, data, at in slices(lower, most):
                best, s, shares = infer(*grams(data, at), logs, j - i) if langs else (np.full(j - i, -1), np.zeros(j - i), np.zeros((j - i, 0)))
                best = np.where(letters[i:j], best, -1)
                pred += [langs[b] if b >= 0 else "und" for b in best.tolist()]
                score += np.where(best >= 0, s, 0.0).tolist()
                shares = np.where(best[:, None] >= 0, shares, 0)
                order = np.argsort(-shares, axis=1, kind="stable")
                for row, first, n in zip(shares, order, np.count_nonzero(shares, axis=1).tolist(), strict=True):
                    mixes.append([{"lang": langs[c], "share": float(row[c])} for c in first[:n].tolist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixes, MIX)], [*names, "lang_pred", "lang_score", "lang_mix"])

    return arrow_map(docs, run, with_fields(docs, "lang_pred string, lang_score double, lang_mix array<struct<lang:string,share:double>>"))


def fold(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def training_sample(docs: DataFrame, rows: Column, per_language: int = TRAIN_DOCS) -> DataFrame:
    """(text, lang) of at most per_language different documents of each language among ``rows``, least hash first.

    A threshold of the hash, from the language's number of different texts and ids, leaves about twice as many as wanted, so that
    the sample alone is ordered within languages, however many documents one of them has.
    """
    known = docs.where(rows & F.col("lang").isNotNull())
    known = known.where(F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n")).collect()  # a row per language
    if counts:
        below = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * per_language / max(r["n"], 1)))])
        known = known.where(F.pmod("_h", F.lit(1 << 31)) < below[F.col("lang")] * float(1 << 31))
    once = known.groupBy("lang", "_h").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("_h")
    return once.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_language).select("text", "lang")


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return fit(training_sample(docs, fold(F.col("doc_id"), 4) != 2))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), *learned(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_mix").alias("mixture"))


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
