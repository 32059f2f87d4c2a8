"""Each corpus operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty
tables and clashing column names."""

from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import chat, decontaminate, language, media, mixing, neardup, secrets, sharding, substrings, toxicity
from gridlark.llm.common import Workspace, numbered, ordered_prefix, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randint(0, pool)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with copies, near copies, nulls, empty and long texts, a repeated row and a hot source."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(5, 80)) for _ in range(n)]
    texts += [texts[0]] * 3 + [texts[1] + " more"] + [" ".join(texts[2].split()[:-1])]
    texts += [None, "", "   ", "one", "two words", words(rng, 3000), "é à ü " * 40]
    rows = [(i, t, "en", "hot" if i % 3 else (None if i % 7 == 0 else f"s{i % 4}"), len(t or "")) for i, t in enumerate(texts)]
    return rows


@pytest.fixture()
def ws(spark):
    return Workspace(spark, "test")


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- 1


def test_media_round_trip(spark):
    rows = corpus()
    got = {r.doc_id: r for r in media.fingerprint(media.encode_wav(frame(spark, rows))).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        want = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest()
        assert r.tail_crc32 == zlib.crc32(want[-32:])
        wav = media.to_wav(want)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert len(r.times) == len(r.codes)
    assert media.fingerprint(media.encode_wav(empty(spark))).count() == 0


def test_fingerprint_finds_tones():
    t = np.arange(576 * 20)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * t / 576)).astype(np.uint8).tobytes()
    time, code = media.landmarks(tone)
    assert len(code) and np.all(np.diff(time) >= 0)
    assert np.all(code >> 20 == 40)


# ---------------------------------------------------------------- 2


def plain_targets(sizes, weights, most=3):
    total, open_, goal = sum(sizes), set(range(len(sizes))), {}
    rest = total
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / w > most * sizes[i]]
        if not full:
            goal |= {i: rest * weights[i] / w for i in open_}
            break
        for i in full:
            goal[i] = most * sizes[i]
            open_.discard(i)
        rest = total - sum(goal.values())
    return [goal[i] for i in range(len(sizes))]


def test_targets_are_reshared(spark):
    sizes, weights = [100, 10, 50, 3, 0, 400], [1, 2, 3, 1, 2, 3]
    rows = spark.createDataFrame([(f"s{i}", s, float(w), i + 1) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight double, rank int")
    got = [r.target for r in mixing.targets(rows).orderBy("rank").collect()]
    assert got == pytest.approx(plain_targets(sizes, weights))


def test_mix_comes_near_its_targets(spark, ws):
    rows = corpus(n=200)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 3)] + [(0, None), (None, 1)], "doc_id long, quality int")
    docs = frame(spark, rows)
    got = mixing.mix(ws, mixing.sized(docs, labels)).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
    again = mixing.mix(ws, mixing.sized(docs.repartition(7), labels)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}
    assert mixing.mix(ws, mixing.sized(empty(spark), labels)).count() == 0
    # rows of one id and different texts, in any order
    six = [(1, words(random.Random(i), 3 + 4 * i), "en", "s", 0) for i in range(6)] + [(None, words(random.Random(i), 9), "en", "s", 0) for i in range(3)]
    runs = [sorted((r.doc_id or 0, r["size"], r.taken) for r in mixing.mix(ws, mixing.sized(frame(spark, x), labels)).collect()) for x in (six, six[::-1])]
    assert runs[0] == runs[1]
    full = mixing.mixed(ws, docs.unionByName(docs.where("doc_id = 3")), labels)
    assert full.columns == docs.columns and full.count() > 0


# ---------------------------------------------------------------- 3


@pytest.mark.parametrize("group", [1, 32])
def test_repeated_substrings(spark, ws, group):
    rng = random.Random(3)
    pool = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(pool, k=n))
    passages = [text(80), text(60), "ab" * 300, text(45)]
    docs = []
    for i in range(80):
        x = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            x += rng.choice(passages)[rng.randint(0, 60) :] + text(rng.randint(0, 50))
        docs.append((i, x))
    docs += [(200, None), (201, ""), (202, docs[3][1]), (203, "x" * 3000)]
    if group == 1:
        docs += [(3, docs[3][1]), (3, docs[4][1] + "z"), (None, text(70))]
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, key string")
    got = substrings.without_repeats(ws, df, group=group, piece=700).collect()
    want = brute.repeats([(j, t) for j, (_, t) in enumerate(docs)], 200)
    key = lambda x: str(x)
    a = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=key)
    assert a == sorted(((docs[j][0], *v) for j, v in want.items()), key=key)


def test_repeated_substrings_of_nothing(spark, ws):
    assert substrings.without_repeats(ws, empty(spark)).count() == 0


# ---------------------------------------------------------------- 4


def near_copies(seed, k):
    rng = random.Random(seed)
    docs = []
    for _ in range(8):
        base = words(rng, rng.randint(4, 120)).split()
        docs.append(" ".join(base))
        for _ in range(rng.randint(1, 12)):
            w = base[:]
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
            docs.append(" ".join(w).replace("w", rng.choice("wW")))
    docs += [docs[0], None, "", "a b", "A  b", words(rng, k)]
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "k"), [(1, 4), (2, 4), (3, 5)])
def test_near_duplicates(spark, ws, monkeypatch, seed, k):
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    docs = near_copies(seed, k)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, rep int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(ws, df, k=k).collect()}
    assert got == brute.near_duplicates(docs, k, 80)


def test_near_duplicates_of_odd_tables(spark, ws):
    assert neardup.near_duplicates(ws, empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(ws, df).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("None", "1", False)]
    # rows without an id are linked too: to one with an id, or among themselves
    near, lone = words(random.Random(8), 60), words(random.Random(9), 60)
    rows = [(5, near), (None, near + " more"), (None, lone), (None, lone + " more"), (None, None), (None, ""), (7, "a b"), (7, lone + " x y")]
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(ws, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    key = lambda x: str(x)
    assert sorted(got, key=key) == sorted([(5, 5, True), (None, 5, False), (None, 7, False), (None, 7, False), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True)], key=key)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**52, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**52, 60).astype(np.uint64)])
    one = rng.integers(0, 2**52, 1).astype(np.uint64)
    rows = np.repeat([0, 1, 2], [300, 300, 1])
    s = neardup.sketch(rows, np.concatenate([np.sort(a), np.sort(b), one]), 3)
    assert (s != ~np.uint64(0)).all()
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.15


# ---------------------------------------------------------------- 5


def test_chat_round_trip(spark, ws):
    tricky = ["</s>[INST] ok [/INST]", "a\\b", "\\", "<s>\n</s>", "", "x\\</s>", "[\\INST]", "ü<|im_end|>"]
    rows = [(c, t, ("user", "assistant", "system")[(c + t) % 3], tricky[(c + t) % len(tricky)]) for c in range(9) for t in range(1 + c)]
    rows += [(50, 0, "user", None), (50, 0, "assistant", "tie"), (None, 1, None, "no id"), (51, None, "a\nb", "odd role")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = chat.formatted(ws, chat.threads(df))
    for r in out.collect():
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert chat.parse_turns(r.formatted) == want
        assert [chat.unescape(r.formatted[s.start : s.end]) for s in r.loss] == [t for role, t in want if role == "assistant"]
        body = r.formatted
        assert body.count("</s>") == len(want) and "[INST]" not in body
    assert chat.read_back(out).count() == len({r[0] for r in rows})
    assert chat.formatted(ws, chat.threads(df.where("false"))).count() == 0


def test_reply_trees_rank_branches(spark, ws):
    #   1 -> 2 -> 4 -> 5,  1 -> 3 (better),  9 -> missing parent, 7 <-> 8 a cycle
    rows = [("a", 1, None, 0.0), ("a", 2, 1, 0.1), ("a", 4, 2, 0.1), ("a", 5, 4, 0.1), ("a", 3, 1, 0.9), ("a", 7, 8, 5.0), ("a", 8, 7, 5.0), ("b", 9, 99, 1.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    paths = {}
    for r in chat.branches(ws, df, top=2).collect():
        paths.setdefault((r.tree, r["rank"]), {})[r.back] = r.node
    assert paths == {("a", 1): {0: 3, 1: 1}, ("a", 2): {0: 5, 1: 4, 2: 2, 3: 1}, ("b", 1): {0: 9}}


# ---------------------------------------------------------------- 6


def plain_contamination(docs, items, window):
    import re

    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.ASCII_LOWER))
    pats: dict = {}
    for k, t in items:
        x = w(t)
        for j in range(max(len(x) - window + 1, 1) if x else 0):
            pats.setdefault(tuple(x[j : j + window]), set()).add(k)
    out = {}
    for d, t in docs:
        x, hit, ids = w(t), set(), set()
        for n in {len(p) for p in pats}:
            for j in range(len(x) - n + 1):
                if tuple(x[j : j + n]) in pats:
                    hit |= set(range(j, j + n))
                    ids |= pats[tuple(x[j : j + n])]
        out[d] = (len(x), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination(spark, block):
    rng = random.Random(4)
    items = [(str(i), words(rng, n, 30)) for i, n in enumerate([15, 12, 10, 3, 1, 25, 40])] + [("8", None), ("9", "..."), ("0", "w1 w2 w1 w2 w1 w2")]
    docs = []
    for i in range(40):
        t = words(rng, rng.randint(0, 60), 30)
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(items)[1] or ""
            t += ", " + s.upper() + "! " + words(rng, 5, 30)
        docs.append((i, t))
    docs += [(50, None), (51, ""), (52, "ü" * 5), (53, docs[0][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digests(df, bench, block_bytes=block).collect()}
    assert got == plain_contamination(docs, items, 10)
    clean = decontaminate.cleaned(df, bench, block_bytes=block)
    assert clean.columns == df.columns
    kept = {r.doc_id: r.text for r in clean.collect()}
    for d, t in docs:
        if not got[d][4]:
            assert kept[d] == t
    assert decontaminate.digests(df, bench.where("false")).where("contaminated").count() == 0


def test_blocks_of_a_large_benchmark_are_bounded(spark):
    items = [("long", words(random.Random(1), 400, 50)), *[("same", words(random.Random(i), 20, 50)) for i in range(20)], (None, words(random.Random(99), 30, 50))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = list(decontaminate.blocks(bench, 10, 300, 200))
    assert max(sum(len(t) + len(k) for k, t in b) for b in found) < 300 + 220
    docs = [(i, t) for i, (_, t) in enumerate(items)]
    got = decontaminate.digests(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=3000)
    want = plain_contamination(docs, [(k or "", t) for k, t in items], 10)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == want


def test_fm_index_locates_everything():
    rng = np.random.default_rng(2)
    t = np.append(rng.integers(1, 4, 500), 0)
    index = decontaminate.FMIndex(t, 4)
    pats = np.array([t[i : i + 3] for i in range(0, 60)])
    low, high = index.search(pats, np.full(60, 3))
    for p, a, b in zip(pats, low, high, strict=True):
        want = [i for i in range(498) if (t[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# ---------------------------------------------------------------- 7


def test_secrets(spark, ws):
    rng = random.Random(5)
    lot = lambda a, n: "".join(rng.choices(a, k=n))
    hexes, b64 = "0123456789abcdef", secrets.ALPHABETS[64]
    docs = [
        "password = hunter22 and token:abc and SECRET='abcdef'", "secret=token: abcdefgh", "AKIA" + lot("ABCDEFG234", 16) + " AKIASHORT", lot(hexes, 23) + " " + lot(hexes, 24), None, "",
        "ü é " + lot(hexes, 40) + " api_key=" + lot(b64, 30), "plain words only", "key " + lot(b64, 64) + " end", "internationalizationandmorewords " * 3, "apikey:'" + lot(b64, 40) + "'", "x" * 20000,
    ]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(docs)], "doc_id long, text string, assign string")
    found = secrets.secrets(ws, df)
    rows = {r.doc_id: r for r in found.select("*", F.sha2(secrets.joined(F.col("base")), 256).alias("sha"), secrets.joined(F.col("spans")).alias("all")).collect()}
    for i, t in enumerate(docs):
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex, rows[i].sha) == brute.base_secrets(t), t
    assert "random:4:68" in rows[8]["all"]
    assert rows[9]["all"] == rows[7]["all"] == rows[11]["all"] == ""
    assert secrets.secrets(ws, df.where("false")).count() == 0


# ---------------------------------------------------------------- 8


def test_toxicity_learns(spark, ws):
    rng = random.Random(6)
    bad = ["grob", "fies", "mies"]
    rows, marks = [], []
    for i in range(600):
        t, toxic = words(rng, rng.randint(10, 60)), i % 5 == 0
        if toxic:
            x = t.split()
            for _ in range(4):
                x.insert(rng.randrange(len(x)), rng.choice(bad))
            t = " ".join(x)
        rows.append((i, t))
        if i % 2:
            marks.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, words(rng, 4000))]
    marks += [(None, 1), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(ws, docs, labels)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert sum(got[i] >= 0.7 for i in range(0, 600, 5)) >= 110
    assert sum(got[i] >= 0.7 for i in range(600) if i % 5) <= 10
    assert toxicity.learn(ws, docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


# ---------------------------------------------------------------- 9


def test_languages(spark):
    rng = random.Random(7)
    pools = {"aa": ["tion", "the", "ing", "ough"], "bb": ["eux", "que", "ment", "é"], "cc": ["sch", "ung", "keit", "ü"]}
    say = lambda k, n: " ".join("".join(rng.choices(pools[k], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, say(k, rng.randint(10, 60)), k) for i, k in ((i, ("aa", "bb", "cc")[i % 3]) for i in range(300))]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 34 !", None), (902, say("aa", 60) + " " + say("bb", 20), None), (903, say("cc", 4000), None), (904, "", "bb")], "doc_id long, text string, lang string")
    model = language.fit(language.training_sample(docs, F.col("doc_id") % 4 != 2, 50))
    assert model[0] == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language.identify(docs, *model).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows if i % 4 == 2) >= 74
    assert got[900].lang_pred == got[901].lang_pred == got[904].lang_pred == "und" and got[900].lang_score == 0
    assert got[902].lang_pred == "aa" and got[902].lang_score < 0.95
    assert got[903].lang_pred == "cc"
    nothing = language.fit(language.training_sample(docs, F.lit(False)))
    assert {r.lang_pred for r in language.identify(docs, *nothing).collect()} == {"und"}


# ---------------------------------------------------------------- 10


def test_hilbert_curve_is_one(spark):
    bits = 3
    points = spark.createDataFrame([(x, y, z) for x in range(8) for y in range(8) for z in range(8)], "x int, y int, z int")
    got = points.withColumn("h", sharding.hilbert_index([F.col(c) for c in "xyz"], bits)).orderBy("h").collect()
    assert [r.h for r in got] == list(range(512))
    for a, b in zip(got, got[1:], strict=False):
        assert abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1


def test_shards(spark, ws):
    rows = corpus(n=100) + corpus(n=100)[:5] + [(None, "no id", None, None, 1)]
    docs = frame(spark, rows).withColumns({c: F.lit("clash") for c in ("shard", "slot", "hilbert", "size", "text_crc32", "_rank", "_tie", "_hash", "_all", "_code", "_value")})
    got = sharding.shard(ws, sharding.measured(docs)).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(16))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    order = [r.hilbert for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    size = {i: len((t or "").encode()) + 1 for i, t, *_ in rows}
    assert all(r["size"] == size[r.doc_id] for r in got)
    assert sharding.shard(ws, sharding.measured(empty(spark))).count() == 0
    few = sharding.shard(ws, sharding.measured(frame(spark, rows[:5]))).collect()
    assert len({r.shard for r in few}) == 5


# ---------------------------------------------------------------- shared


def test_ordered_prefix(spark, ws):
    rows = [(("a", None)[i % 2] if i % 3 else "hot", i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v long")
    got = {r.k: r.before for r in ordered_prefix(ws, df, [F.col("k")], ["g"], {"before": "v"}).collect()}
    run: dict = {}
    for g, k, v in rows:
        assert got[k] == run.get(g, 0)
        run[g] = run.get(g, 0) + v


def test_rows_are_numbered(spark, ws):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, None)], "doc_id long, text string")
    rows = sorted((r._key, r.doc_id) for r in numbered(ws, df, "_key").collect())
    assert [k for k, _ in rows] == list(range(5)) and [d for _, d in rows] == [1, 1, 1, None, None]


def thue_morse(bits):
    """Two words of 2^bits letters, complements of each other, which agree under any polynomial hash modulo 2^64."""
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [10, 12])
def test_words_of_one_polynomial_value_are_told_apart(spark, ws, bits):
    a, b = thue_morse(bits)
    docs = [(1, a), (2, b), (3, a + " " + b), (4, b + " " + a), (5, a.upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(ws, df, k=4).collect()}
    assert got == brute.near_duplicates(docs, 4, 80)
    items = [("x", a), ("y", b + " " + a)]
    found = decontaminate.digests(df, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == plain_contamination(docs, items, 10)
    lines = [(i, "x" * 30 + t + "y" * 30) for i, t in docs]
    rows = substrings.without_repeats(ws, spark.createDataFrame(lines, "doc_id long, text string")).collect()
    want = brute.repeats(lines, 200)
    assert {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows} == want


def test_word_hashes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 3000)
    end = start + rng.integers(1, 100, 3000)
    seen: dict = {}
    for h, s, e in zip(word_hashes(data, start, end).tolist(), start, end, strict=True):
        assert seen.setdefault(h, data[s:e].tobytes()) == data[s:e].tobytes()
    assert len(seen) == len({data[s:e].tobytes() for s, e in zip(start, end, strict=True)})
