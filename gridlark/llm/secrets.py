"""Secret scans by patterns and by a battery of randomness tests, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three patterns: assignments, access keys, hex runs. The
positions come from the pieces between matches: their lengths, summed up, are the starts in code points.

The battery looks at every other run of 20 or more characters of [A-Za-z0-9+/_=-]. Its encoding (hex, base32 or
base64) is inferred from its characters. Three tests ask whether its symbols look drawn at random from that
alphabet: chi-squared uniformity, runs above and below the alphabet's middle, and lag-one serial correlation. A token
that one of them rejects isn't random. Of the others, each test gives the probability that ordinary text of this length
would look as random: the lower tail of the non-central chi-squared distribution whose non-centrality grows with
length, and the chance of a score as near zero as this where text spreads the more the longer it is. Fisher's method
makes one p-value of the three, and Benjamini-Hochberg control over all candidates of the table sets the level (a
histogram of at most 301 bins), so short words can't become finds.

Each document stays one row; nothing is joined, and only histogram counts are shuffled. Arrays are folded in blocks,
so that time grows with the matches of a text, not with their square. Null text is empty. Repeated rows are scanned
alike; extra columns are left aside; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import Workspace, prepare

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 or more: a run that is too short holds no other start
HEX = r"[0-9a-f]{24,}"  # likewise
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: k * sum(p^2) - 1 of ordinary text written in each alphabet, with sum(p^2) = 0.065 (for hex, of six letters, 0.2).
TEXT_EXCESS = {16: 2.2, 32: 1.08, 64: 3.16}
TEST_Z = 3.3
#: Spread of ordinary text's runs and serial scores: sqrt(1 + length * SPREAD).
SPREAD = 0.06
BLOCK = 64
DISCOVERY_RATE = 0.001
SPAN = "array<struct<s:bigint,e:bigint,t:string>>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def states(items: Column, start: Column, step, kind: str) -> Column:
    """The states of a fold after each item. Appending copies a block's states, never those of all items."""

    def fold(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.slice(z, b * BLOCK + 1, BLOCK))

        def one(acc: Column, x: Column) -> Column:
            return let(step(acc["now"], x), lambda s: F.struct(s.alias("now"), F.concat(acc["out"], F.array(s)).alias("out")))

        def block(acc: Column, b: Column) -> Column:
            inside = F.aggregate(b, F.struct(acc["now"].alias("now"), F.array().cast(f"array<{kind}>").alias("out")), one)
            return let(inside, lambda r: F.struct(r["now"].alias("now"), F.concat(acc["all"], F.array(r["out"])).alias("all")))

        zero = F.struct(start.cast(kind).alias("now"), F.array().cast(f"array<array<{kind}>>").alias("all"))
        return F.when(F.size(z) > 0, F.flatten(F.aggregate(blocks, zero, block, lambda acc: acc["all"]))).otherwise(F.array().cast(f"array<{kind}>"))

    return let(items, fold)


def matches(text: Column, pattern: str) -> Column:
    """Spans (s, e, t) of all matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the piece before each match; the one after the last has no match beside it
    pieces = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), m.alias("t")))
    pieces = F.filter(pieces, lambda x: x["t"].isNotNull())

    def spans(z: Column) -> Column:
        ends = states(z, F.lit(0), lambda at, x: at + x["gap"] + F.length(x["t"]), "bigint")
        return F.zip_with(z, ends, lambda x, e: F.struct((e - F.length(x["t"])).alias("s"), e.alias("e"), x["t"].alias("t")))

    return F.when(F.rlike(text, F.lit(pattern)), let(pieces, spans)).otherwise(F.array().cast(SPAN))


def clear_of(tokens: Column, base: Column) -> Column:
    """The tokens (s, e, t) that touch no base span: one sweep from the left, one from the right."""
    event = lambda kind: lambda m: F.struct(m["s"].alias("s"), F.lit(kind).alias("kind"), m["e"].alias("e"), m["t"].alias("t"))

    def sweep(z: Column) -> Column:
        own = lambda x, value, other: F.when(x["kind"] == 0, value).otherwise(other)
        ends = states(z, F.lit(-1), lambda far, x: own(x, F.greatest(far, x["e"]), far), "bigint")
        starts = F.reverse(states(F.reverse(z), F.lit(1 << 60), lambda near, x: own(x, F.least(near, x["s"]), near), "bigint"))
        beside = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
        kept = F.zip_with(z, beside, lambda x, y: F.when((x["kind"] == 1) & (y["e"] <= x["s"]) & (y["s"] >= x["e"]), F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"))))
        return F.filter(kept, lambda x: x.isNotNull())

    both = F.array_sort(F.concat(F.transform(base, event(0)), F.transform(tokens, event(1))))
    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(let(both, sweep))


def lower_tail(z: Column) -> Column:
    """P(Z <= z) of the standard normal, by the polynomial of Abramowitz and Stegun 26.2.17."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """The combined p-value of the token's three tests against ordinary text; 1 if one rejects its randomness."""
    bare = F.rtrim(F.translate(token, "-_", "+/"), F.lit("="))
    k = F.when(F.rlike(bare, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), 16).when(F.rlike(bare, F.lit("^[A-Z2-7]+$")), 32).otherwise(64)

    def tests(x: Column) -> Column:
        codes, k = x["codes"], x["k"].cast("double")
        n = F.size(codes).cast("double")
        squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda acc, d: acc + F.pow(F.size(F.filter(codes, lambda c: c == d)).cast("double"), F.lit(2.0)))
        chi, df = k / n * squares - n, k - 1
        excess = n * F.when(k == 16, TEXT_EXCESS[16]).when(k == 32, TEXT_EXCESS[32]).otherwise(TEXT_EXCESS[64])

        def runs(high: Column) -> Column:
            n1 = F.aggregate(high, F.lit(0), lambda acc, h: acc + h).cast("double")
            turns = F.aggregate(F.sequence(F.lit(1), F.size(high) - 1), F.lit(0), lambda acc, i: acc + F.when(F.get(high, i) != F.get(high, i - 1), 1).otherwise(0))
            mu = 1 + 2 * n1 * (n - n1) / n
            return F.when((n1 > 0) & (n1 < n) & (mu > 2), (turns + 1 - mu) / F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9)))).otherwise(99.0)

        def serial(mean: Column) -> Column:
            spread = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + (c - mean) * (c - mean))
            beside = F.aggregate(F.sequence(F.lit(1), F.size(codes) - 1), F.lit(0.0), lambda acc, i: acc + (F.get(codes, i) - mean) * (F.get(codes, i - 1) - mean))
            return F.when(spread > 0, beside / spread * F.sqrt(n)).otherwise(99.0)

        def combined(z: Column) -> Column:
            # Wilson-Hilferty for the uniform hypothesis
            z_chi = (F.pow(z["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
            passed = (F.abs(z_chi) <= TEST_Z) & (F.abs(z["runs"]) <= TEST_Z) & (F.abs(z["serial"]) <= TEST_Z)
            wide = F.sqrt(1 + n * SPREAD)
            near = lambda v: F.greatest(2 * lower_tail(F.abs(v) / wide) - 1, 1 / n)
            p = F.greatest(lower_tail((z["chi"] - df - excess) / F.sqrt(2 * (df + 2 * excess))), F.lit(1e-30))
            fisher = let(-F.log(p) - F.log(near(z["runs"])) - F.log(near(z["serial"])), lambda y: F.exp(-y) * (1 + y + y * y / 2))
            return F.when(passed, F.greatest(F.least(fisher, F.lit(1.0)), F.lit(1e-30))).otherwise(1.0)

        high = F.transform(codes, lambda c: (c >= k / 2).cast("int"))
        mean = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + c) / n
        return let(F.struct(chi.alias("chi"), let(high, runs).alias("runs"), let(mean, serial).alias("serial")), combined)

    def coded(x: Column) -> Column:
        own = F.when(x["k"] == 16, F.lower(x["t"])).otherwise(x["t"])
        alphabet = F.when(x["k"] == 16, ALPHABETS[16]).when(x["k"] == 32, ALPHABETS[32]).otherwise(ALPHABETS[64])
        # a symbol outside the alphabet ('=' inside a token) counts as the last symbol
        codes = F.transform(F.filter(F.split(own, ""), lambda c: c != ""), lambda c: F.coalesce(F.nullif(F.call_function("locate", c, alphabet), F.lit(0)), x["k"]) - 1)
        return F.when(F.length(own) >= 8, let(F.struct(codes.alias("codes"), x["k"].alias("k")), tests)).otherwise(1.0)

    return let(F.struct(bare.alias("t"), k.alias("k")), coded)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans per kind, and candidates (s, e, p) of the battery that no base span touches."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.select("doc_id", *[matches(F.col("text"), p).alias(c) for c, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("tokens", TOKEN))])
    df = df.withColumn("assign", F.filter("assign", lambda m: F.length(F.regexp_extract(m["t"], ASSIGN, 2)) >= 6))
    clear = clear_of(F.col("tokens"), F.concat("assign", "access", "hex"))
    tokens = F.transform(clear, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), battery(m["t"]).alias("p")))
    bare = lambda c: F.transform(c, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))).alias(c)
    return df.select("doc_id", bare("assign"), bare("access"), bare("hex"), tokens.alias("tokens"))


def discovery_level(scanned: DataFrame, rate: float = DISCOVERY_RATE) -> float:
    """The largest p-value that Benjamini-Hochberg control lets pass, on a grid of a tenth of a decade."""
    p = scanned.select(F.explode("tokens.p").alias("p"))
    bins = {r["bin"]: r["n"] for r in p.groupBy(F.floor(-F.log10("p") * 10).alias("bin")).agg(F.count("*").alias("n")).collect()}
    total, seen, level = sum(bins.values()), 0, 0.0
    for b in sorted(bins, reverse=True):
        seen += bins[b]
        edge = 10 ** (-b / 10)
        if total * edge <= rate * seen:
            level = edge
    return level


def secrets(ws: Workspace, docs: DataFrame) -> DataFrame:
    """doc_id, and the spans (kind number, s, e): base kinds and the battery's finds."""
    scanned = ws.table(scan(docs))
    level = discovery_level(scanned)
    tagged = lambda c, k: F.transform(c, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("kind"), m["e"].alias("e")))
    base = F.array_sort(F.concat(*[tagged(F.col(c), k) for k, c in enumerate(KINDS[:3])]))
    finds = tagged(F.filter("tokens", lambda m: m["p"] <= level), 3)
    return scanned.select("doc_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in KINDS[:3]], base.alias("base"), F.array_sort(F.concat(base, finds)).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["s"].cast("string"), m["e"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secrets(Workspace(spark, "secrets"), docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op7_secret_scan": op7_secret_scan}


def _sql() -> str:
    """The same scan in plain SQL: spans by lengths of pieces, the battery over one row per candidate."""
    quote = lambda x: x.replace("'", "''")
    kinds = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN)]
    pieces = ",\n".join(f"m{k} AS (SELECT doc_id, {k} AS kind, regexp_extract_all(text, '{quote(p)}') AS m, string_split_regex(text, '{quote(p)}') AS g FROM d)" for k, (_, p) in enumerate(kinds))
    by_k = lambda a, b, c: f"CASE k WHEN 16 THEN {a} WHEN 32 THEN {b} ELSE {c} END"
    u = lambda z: f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = lambda z: f"exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * {u(z)} * (0.319381530 + {u(z)} * (-0.356563782 + {u(z)} * (1.781477937 + {u(z)} * (-1.821255978 + {u(z)} * 1.330274429))))"
    named = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END || ':' || s::VARCHAR || ':' || e::VARCHAR"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{pieces},
mm AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3),
ix AS (SELECT doc_id, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM mm WHERE len(m) > 0),
sp AS (SELECT doc_id, kind, m[i] AS t, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM ix),
sf AS (SELECT doc_id, kind, t, s, s + length(t) AS e FROM sp WHERE kind <> 0 OR length(regexp_extract(t, '{quote(ASSIGN)}', 2)) >= 6),
base AS (SELECT * FROM sf WHERE kind < 3),
tk AS (SELECT * FROM sf c WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
b1 AS (SELECT doc_id, s, e, rtrim(translate(t, '-_', '+/'), '=') AS bare FROM tk),
b2 AS (SELECT *, CASE WHEN regexp_full_match(bare, '[0-9a-f]+|[0-9A-F]+') THEN 16 WHEN regexp_full_match(bare, '[A-Z2-7]+') THEN 32 ELSE 64 END AS k FROM b1),
b3 AS (SELECT doc_id, s, e, k, list_transform(string_split(CASE WHEN k = 16 THEN lower(bare) ELSE bare END, ''), lambda c: coalesce(nullif(strpos({by_k(*[f"'{ALPHABETS[x]}'" for x in (16, 32, 64)])}, c), 0), k) - 1) AS codes, length(bare) AS n FROM b2 WHERE length(bare) >= 8),
b4 AS (SELECT *, k::DOUBLE / n * list_sum(list_transform(list_distinct(codes), lambda v: pow(len(list_filter(codes, lambda c: c = v)), 2))) - n AS chi, k - 1.0 AS df, n * {by_k(*[f"{TEXT_EXCESS[x]}" for x in (16, 32, 64)])} AS excess,
  len(list_filter(codes, lambda c: c >= k / 2))::DOUBLE AS n1, len(list_filter(range(2, n + 1), lambda i: (codes[i] >= k / 2) <> (codes[i - 1] >= k / 2))) AS turns, list_sum(codes)::DOUBLE / n AS mean FROM b3),
b5 AS (SELECT *, 1 + 2 * n1 * (n - n1) / n AS mu, list_sum(list_transform(codes, lambda c: (c - mean) * (c - mean))) AS spread, list_sum(list_transform(range(2, n + 1), lambda i: (codes[i] - mean) * (codes[i - 1] - mean))) AS serial FROM b4),
b6 AS (SELECT *, (pow(chi / df, 1.0 / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df)) AS z_chi,
  CASE WHEN n1 > 0 AND n1 < n AND mu > 2 THEN (turns + 1 - mu) / sqrt(greatest((mu - 1) * (mu - 2) / (n - 1), 1e-9)) ELSE 99 END AS z_runs,
  CASE WHEN spread > 0 THEN serial / spread * sqrt(n) ELSE 99 END AS z_serial, (chi - df - excess) / sqrt(2 * (df + 2 * excess)) AS z FROM b5),
b7 AS (SELECT *, {tail('z')} AS tail, {tail(f'z_runs / sqrt(1 + n * {SPREAD})')} AS tail_runs, {tail(f'z_serial / sqrt(1 + n * {SPREAD})')} AS tail_serial FROM b6),
b8 AS (SELECT *, -ln(greatest(CASE WHEN z < 0 THEN tail ELSE 1 - tail END, 1e-30)) - ln(greatest(2 * (1 - tail_runs) - 1, 1.0::DOUBLE / n)) - ln(greatest(2 * (1 - tail_serial) - 1, 1.0::DOUBLE / n)) AS y FROM b7),
pv AS (SELECT doc_id, s, e, CASE WHEN abs(z_chi) <= {TEST_Z} AND abs(z_runs) <= {TEST_Z} AND abs(z_serial) <= {TEST_Z} THEN greatest(least(exp(-y) * (1 + y + y * y / 2), 1.0), 1e-30) ELSE 1.0 END AS p FROM b8
       UNION ALL SELECT doc_id, s, e, 1.0 FROM b2 WHERE length(bare) < 8),
bins AS (SELECT floor(-log10(p) * 10) AS bin, count(*) AS n FROM pv GROUP BY 1),
cum AS (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS seen, sum(n) OVER () AS total FROM bins),
lv AS (SELECT coalesce(max(pow(10, -bin / 10)), 0) AS level FROM cum WHERE total * pow(10, -bin / 10) <= {DISCOVERY_RATE} * seen),
al AS (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT doc_id, 3, s, e FROM pv, lv WHERE p <= level),
di AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2,
  string_agg({named}, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg({named}, ',' ORDER BY s, kind) AS spans FROM al GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN di ON d.doc_id = di.doc_id"""


ORACLES: dict[str, str] = {"op7_secret_scan": _sql()}
