"""Methods against plain versions of their formulas, bounds of samples, and odd tables: repeated rows, clashing columns, no rows."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import language, media, secrets, sharding, toxicity
from gridlark.llm.common import Workspace


@pytest.fixture()
def ws(spark):
    return Workspace(spark, "test")


def lot(rng, alphabet, n):
    return "".join(rng.choices(alphabet, k=n))


# ---------------------------------------------------------------- 7


def normal_tail(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def plain_battery(token):
    """The three statistics and their combined p-value, one by one."""
    bare = token.replace("-", "+").replace("_", "/").rstrip("=")
    if all(c in "0123456789abcdef" for c in bare) or all(c in "0123456789ABCDEF" for c in bare):
        k, bare = 16, bare.lower()
    elif all(c in secrets.ALPHABETS[32] for c in bare):
        k = 32
    else:
        k = 64
    x = [secrets.ALPHABETS[k].index(c) for c in bare]
    n = len(x)
    chi = k / n * sum(x.count(v) ** 2 for v in set(x)) - n
    df, excess = k - 1, n * secrets.TEXT_EXCESS[k]
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [v >= k / 2 for v in x]
    n1 = sum(high)
    turns = sum(a != b for a, b in zip(high, high[1:], strict=False))
    mu = 1 + 2 * n1 * (n - n1) / n
    z_runs = (turns + 1 - mu) / math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9)) if 0 < n1 < n and mu > 2 else 99
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    z_serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / spread * math.sqrt(n) if spread else 99
    if max(abs(z_chi), abs(z_runs), abs(z_serial)) > secrets.TEST_Z:
        return 1.0
    wide = math.sqrt(1 + n * secrets.SPREAD)
    p = [max(normal_tail((chi - df - excess) / math.sqrt(2 * (df + 2 * excess))), 1e-30), *[max(2 * normal_tail(abs(z) / wide) - 1, 1 / n) for z in (z_runs, z_serial)]]
    y = -sum(map(math.log, p))
    return max(min(math.exp(-y) * (1 + y + y * y / 2), 1.0), 1e-30)


def test_battery_against_plain_formulas(spark):
    rng = random.Random(2)
    tokens = [lot(rng, secrets.ALPHABETS[k], n) for k in (16, 32, 64) for n in (20, 33, 64, 200)]
    tokens += ["internationalizationandlocalization", "ABCABCABCABCABCABCABCABC", "a" * 40, lot(rng, "0123456789ABCDEF", 40), "ab-cd_ef" * 5 + "=="]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(F.col("t")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(plain_battery(r.t), rel=0.02, abs=1e-7), r.t


def test_sweep_drops_tokens_that_touch_a_base_span(spark):
    rng = random.Random(3)
    span = "array<struct<s:bigint,e:bigint,t:string>>"
    rows = []
    for i in range(60):
        at, tokens = 0, []
        for _ in range(rng.randint(0, 150)):
            s = at + rng.randint(1, 9)
            at = s + rng.randint(1, 9)
            tokens.append((s, at, "t"))
        base = [(s, s + rng.randint(1, 30), "b") for s in sorted(rng.sample(range(900), rng.randint(0, 40)))]
        rows.append((i, tokens, base))
    got = spark.createDataFrame(rows, f"i int, tokens {span}, base {span}").select("i", secrets.clear_of(F.col("tokens"), F.col("base")).alias("k")).collect()
    for r, (_, tokens, base) in zip(sorted(got), rows, strict=True):
        assert [(x.s, x.e) for x in r.k] == [(s, e) for s, e, _ in tokens if not any(b < e and s < f for b, f, _ in base)]


def test_a_text_of_ten_thousand_matches_takes_seconds(spark, ws):
    rng = random.Random(4)
    text = " ".join(lot(rng, "0123456789abcdef", 30) + " " + lot(rng, secrets.ALPHABETS[64], 30) for _ in range(5000))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    began = time.time()
    rows = secrets.secrets(ws, df).select("n_hex", F.size("spans").alias("n")).collect()
    assert time.time() - began < 60
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].n_hex == 5000 and rows[0].n > 9000


# ---------------------------------------------------------------- 8


@pytest.mark.parametrize("shift", [0.0, 4.0])
def test_gradient_is_that_of_the_non_negative_risk(shift):
    rng = np.random.default_rng(5)
    fp, fu, prior, step = rng.normal(size=7) + shift, rng.normal(size=11) - shift, 0.3, 1e-6
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    gp, gu = toxicity.risk_gradient(fp, fu, prior)

    def change(f, i, of):
        up, down = f.copy(), f.copy()
        up[i] += step
        down[i] -= step
        return (of(up) - of(down)) / (2 * step)

    if negative >= 0:
        plain = lambda p, u: prior * np.mean(np.log1p(np.exp(-p))) + max(np.mean(np.log1p(np.exp(u))) - prior * np.mean(np.log1p(np.exp(p))), 0)
        assert toxicity.risk(fp, fu, prior) == pytest.approx(plain(fp, fu))
        of_p, of_u = (lambda p: plain(p, fu)), (lambda u: plain(fp, u))
    else:  # the step goes against the gradient of the corrected negative risk
        part = lambda p, u: -(np.mean(np.log1p(np.exp(u))) - prior * np.mean(np.log1p(np.exp(p))))
        of_p, of_u = (lambda p: part(p, fu)), (lambda u: part(fp, u))
    assert gp == pytest.approx([change(fp, i, of_p) for i in range(len(fp))], abs=1e-6)
    assert gu == pytest.approx([change(fu, i, of_u) for i in range(len(fu))], abs=1e-6)


def test_repeated_ids_teach_once(spark, ws, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "frequencies", lambda sample: taken.append(sample.count()) or (np.zeros(1 << toxicity.BITS, np.int64),) * 2)
    rows = [(i % 40, f"text {i} bad" if i % 40 < 5 else f"text {i}", "clash") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(40)] * 3, "doc_id long, toxic int")
    toxicity.learn(ws, docs, labels)
    assert taken == [45]


def test_toxicity_of_odd_tables(spark, ws):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.learn(ws, docs, labels) is None
    assert toxicity.score(docs, None).count() == 0
    two = spark.createDataFrame([(1, "a", "x")] * 2, "doc_id long, text string, positive string")
    assert [r.score for r in toxicity.score(two, None).collect()] == [0.0, 0.0]


# ---------------------------------------------------------------- 9


def plain_inference(counts, logs):
    """The set of languages and its proportions for one document: all nested sets, without any shortcut."""
    probability = np.exp(logs - logs.max(axis=0))

    def em(share, rounds):
        for _ in range(rounds):
            w = probability.T * share
            w = w / w.sum(axis=1, keepdims=True) * counts[:, None]
            share = w.sum(axis=0) / w.sum()
        return share, float((counts * np.log(probability.T @ share)).sum() + (counts * logs.max(axis=0)).sum())

    share, _ = em(np.full(len(logs), 1 / len(logs)), language.ROUNDS)
    order = np.argsort(-share, kind="stable")
    single = (logs * counts).sum(axis=1)
    best, kept = single.max(), {int(single.argmax()): 1.0}
    for size in range(2, len(logs) + 1):
        start = np.zeros(len(logs))
        start[order[:size]] = share[order[:size]]
        got, like = em(start / start.sum(), 5)
        like -= language.PENALTY * (size - 1) * np.log(counts.sum()) / 2
        if like > best:
            best, kept = like, {int(i): got[i] for i in order[:size]}
    return kept


def test_mixture_against_plain_expectation_maximisation():
    rng = np.random.default_rng(6)
    langs, used = 6, 80
    logs = np.full((langs, language.BUCKETS), -20.0, np.float32)
    logs[:, :used] = np.log(rng.dirichlet(np.full(used, 0.2), langs) + 1e-5)
    keys, counts, want = [], [], []
    for d, parts in enumerate([[0], [1, 2], [3, 4, 5], [0, 1, 2, 3, 4], [5], [2, 5]]):
        mix = np.exp(logs[parts, :used]).mean(axis=0)
        n = rng.multinomial(900, mix / mix.sum())
        there = np.flatnonzero(n)
        keys.append(d * language.BUCKETS + there)
        counts.append(n[there])
        want.append(plain_inference(n[there].astype(float), logs[:, there].astype(float)))
    best, _, shares = language.infer(np.concatenate(keys), np.concatenate(counts), logs, len(want))
    assert max(map(len, want)) > 3  # no cap at three languages
    for b, row, plain in zip(best, shares, want, strict=True):
        assert set(np.flatnonzero(row)) == set(plain)
        assert b == max(plain, key=plain.get) and [row[i] for i in plain] == pytest.approx(list(plain.values()), abs=0.01)


def test_training_sample_is_bounded(spark):
    rows = [(1, "one text", "en")] * 300 + [(2, f"text {i}", "en") for i in range(300)] + [(i, f"texte {i}", "fr") for i in range(400)] + [(None, None, "fr"), (5, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = {r.lang: r["count"] for r in language.training_sample(docs, F.lit(True), 50).groupBy("lang").count().collect()}
    assert n["fr"] == 50 and 0 < n["en"] <= 50
    assert language.training_sample(docs.where("false"), F.lit(True), 50).count() == 0


def test_languages_of_odd_tables(spark):
    none = language.learned(spark.createDataFrame([], "doc_id long, text string, lang string"))
    two = spark.createDataFrame([(1, "some words", "x")] * 2, "doc_id long, text string, bucket string")
    rows = language.identify(two, *none).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].lang_pred == "und" and rows[0].bucket == "x"


# ---------------------------------------------------------------- 1 and 10


def test_media_of_odd_tables(spark):
    rows = [(None, "text", "x"), (1, "text", "y"), (1, "text", "y"), (2, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = media.fingerprint(media.encode_wav(docs)).collect()
    assert len(got) == 4 and len({(r.media_sha256, tuple(r.codes)) for r in got if r.n_bytes == 4}) == 1


def plain_hilbert(x, bits):
    """Skilling's transform, with loops."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def metadata(seed, n):
    rng = random.Random(seed)
    text = lambda: "x" * int(2 ** rng.uniform(0, 14))
    return [(i, text(), rng.choice("abcdefgh") * 2, f"s{rng.randint(0, 19):02}") for i in range(n)]


def test_shards_against_a_plain_version(spark, ws):
    rows = metadata(7, 300) + [(None, None, None, None), (5, "again", "aa", "s01"), (5, "again", "aa", "s01")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, hilbert string").drop("hilbert")
    got = sharding.shard(ws, sharding.measured(docs)).collect()

    def codes(value):
        values = sorted((value(r) for r in rows), key=lambda v: (v is not None, v or ""))
        return {v: values.index(v) * 32 // len(rows) for v in set(values)}

    step = lambda r: min(int(math.log2(len(r[1] or "") + 1) * 1024 / 40), 1023) or None
    axes = [(f, codes(f)) for f in (lambda r: r[2], lambda r: r[3], step)]
    want = sorted(plain_hilbert([c[f(r)] for f, c in axes], 5) for r in rows)
    placed = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in placed] == want
    n = len(rows)
    assert [(r.shard, r.slot) for r in placed] == [(k * 16 // n, k - -(-(k * 16 // n) * n // 16)) for k in range(n)]


def test_written_shards_prune_in_every_dimension(spark, ws, tmp_path):
    docs = sharding.measured(spark.createDataFrame(metadata(8, 4000), "doc_id long, text string, lang string, source string"))
    path = f"file://{tmp_path}/shards"
    sharding.write(sharding.shard(ws, docs), path)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(*[g(c).alias(f"{k}_{c}") for c in ("lang", "source", "size") for k, g in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n")).collect()
    assert len(files) == 16 and sum(f["n"] for f in files) == 4000
    for column, wanted in (("lang", ["aa", "hh"]), ("source", ["s00", "s19"]), ("size", [3, 12000])):
        for v in wanted:
            read = sum(f[f"lo_{column}"] <= v <= f[f"hi_{column}"] for f in files)
            assert read <= 10, (column, v, read)
    table = spark.read.parquet(path)
    assert table.where("lang = 'aa' and source = 's00'").count() == docs.where("lang = 'aa' and source = 's00'").count()
