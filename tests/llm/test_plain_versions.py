"""Spectral peaks and pairs, and positive-unlabelled training and scoring, against plain versions of the whole result."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from gridlark.llm import media, toxicity
from gridlark.llm.common import Workspace


def plain_fingerprint(payload: bytes):
    """(time, code), sorted: peaks frame by frame and bin by bin, pairs peak by peak."""
    x = [(b - 128) / 128 for b in payload]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / (media.BLOCK - 1)) for k in range(media.BLOCK)]
    found = []
    for t in range(2 * len(x) // media.BLOCK - 1):
        part = x[t * media.BLOCK // 2 : t * media.BLOCK // 2 + media.BLOCK]
        m = np.abs(np.fft.rfft(np.array(part, np.float32) * np.array(window, np.float32))).astype(np.float32)
        mean = m.mean()
        tops = [k for k in range(1, len(m) - 1) if m[k] >= m[k - 1] and m[k] > m[k + 1] and m[k] > mean]
        found += [(t, k) for k in sorted(sorted(tops, key=lambda k: -m[k])[: media.PEAKS_A_FRAME])]
    out = []
    for i, (t, k) in enumerate(found):
        later = [p for p in found[i + 1 :] if p[0] > t][: media.FAN]
        out += [(t, k << 20 | b << 8 | u - t) for u, b in later if u - t <= media.SPAN]
    return sorted(out)


def test_fingerprints_are_the_plain_ones(spark):
    rng = random.Random(4)
    texts = ["", None, "short", "".join(rng.choices("abcdefgh éü", k=4000)), "tone " * 900, "".join(chr(rng.randint(32, 500)) for _ in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.fingerprint(media.encode_wav(docs)).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert list(zip(r.times, r.codes, strict=True)) == plain_fingerprint(payload), r.doc_id


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    count: dict = {}
    for w in WORD.findall((text or "").lower()):
        raw = w.encode()
        for f in [("word", raw), *[(n, raw[:n]) for n in toxicity.BEGINNINGS if len(raw) >= n]]:
            count[f] = count.get(f, 0) + 1
    return {f: math.log1p(n) for f, n in count.items()}


def plain_scores(docs, toxic, open_, steps):
    """Scores of all texts by the published risk, with dense matrices: every feature of the open texts has a weight."""
    names = sorted({f for d, t in docs.items() if d in open_ for f in plain_features(t)}, key=str)
    row = lambda t: np.array([plain_features(t).get(f, 0.0) for f in names])
    xu = np.array([row(docs[d]) for d in open_])
    xp = np.array([row(docs[d]) for d in open_ if toxic.get(d)])
    prior = sum(toxic[d] for d in open_ if d in toxic) / sum(d in toxic for d in open_)
    sig = lambda z: 1 / (1 + np.exp(-z))

    def gradient(fp, fu):
        corrected = np.mean(np.log(1 + np.exp(fu))) - prior * np.mean(np.log(1 + np.exp(fp)))
        if corrected >= 0:
            return -np.ones(len(fp)) * prior / len(fp), sig(fu) / len(fu)
        return sig(fp) * prior / len(fp), -sig(fu) / len(fu)

    w, b = np.zeros(len(names)), math.log(prior / (1 - prior))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        gp, gu = gradient(xp @ w + b, xu @ w + b)
        g = np.append(xp.T @ gp + xu.T @ gu, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        scale = toxicity.RATE / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        step = scale * m / (1 - 0.9**t)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - toxicity.SHRINK * np.minimum(scale[:-1], 1e3), 0)
    fp, fu, slope, m, v = xp @ w, xu @ w, 1.0, np.zeros(2), np.zeros(2)
    for t in range(1, 2 * steps + 1):
        gp, gu = gradient(slope * fp + b, slope * fu + b)
        g = np.array([gp @ fp + gu @ fu, gp.sum() + gu.sum()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        move = toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        slope, b = slope - move[0], b - move[1]
    return {d: sig(slope * (row(t) @ w) + b) for d, t in docs.items()}


def test_toxicity_is_the_plain_training(spark):
    rng = random.Random(9)
    clean = [f"{a}{b}" for a in ("ta", "mo", "ré") for b in ("lin", "dor", "sa")]
    bad = ["vilegrub", "snarlig", "Vilepox"]
    docs = {i: " ".join(rng.choices(clean, k=rng.randint(2, 30)) + rng.choices(bad, k=rng.randint(1, 3)) * (i % 5 == 0)) for i in range(160)}
    docs |= {200: None, 201: "", 202: "12 !", 203: "unknownword vilegrub", 204: "VILEGRUB " * 50}
    toxic = {i: int(i % 5 == 0) for i in range(0, 160, 2)} | {3: 1, 203: 0}
    open_ = [d for d in docs if d % 3 != 1]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(d, t) for d, t in toxic.items()] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(Workspace(spark, "toxic"), df.where("doc_id % 3 <> 1"), labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    want = plain_scores(docs, toxic, open_, toxicity.STEPS)
    assert set(got) == set(want)
    for d in docs:
        assert got[d] == pytest.approx(want[d], abs=2e-3), (d, docs[d])
    assert got[204] > 0.5 > got[1] and len({got[200], got[201], got[202]}) == 1
