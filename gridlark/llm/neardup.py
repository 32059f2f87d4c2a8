"""Near duplicates by fast similarity sketching, banding and exact verification.

Sketch: a document's distinct word shingles are thrown into t bins in rounds. In rounds 0 .. t-1 a shingle goes to
a hashed bin; in rounds t .. 2t-1 all go to bin round - t, so every bin fills. A bin keeps the least
(round, hash), and rounds end once all bins are full: long sets need one or two rounds, and the agreement of
two sketches estimates similarity with the concentration of independent minima. With t = 128 in 32 bands of 4 bins, a pair of
similarity 0.8 meets in no band with probability 5e-8.

Verification: documents with equal sets are one class, and classes that share a band's values are candidates.
All pairs of a bucket are never made. First each bucket's most central member (the one with the most company over
all bands) is compared with the others on full sets, and links merge components; a bucket whose members lie in
one component is done. For what is left, a pair's common tokens m are bounded, and with them its similarity
m / (|x| + |y| - m): m is at most the lesser number of tokens that other open classes have too, and at most the lesser
number of tokens common with the bucket's central member plus the lesser number of shared tokens outside it. Members
that no other can reach leave. Then, wave by wave, the members outside a bucket's largest component are its pivots
(PIVOTS of them, in each wave twice as many as before); every member in another component within the bound is
compared with them on full sets, and the pivots leave. Waves go on until no bucket is left, so every pair that
shares a band is compared, connected already, or proven too far apart.

Sets hold 52-bit hashes of the shingles (of three hundred words: chance of a false match in a pair about 1e-10) over
64-bit hashes of the words under a key that every run draws anew, so no unlike documents can be written that are alike by
it; equal sets are told by 128 bits. The result is that of the full sets whatever the key.

Null or wordless texts have the empty set and stay alone. Rows are judged by their texts: where ids are missing or
repeated, each row is numbered, and rows without an id come after all others. A component is named by its least id,
null if no row of it has one; then the first row of it is kept. Extra columns don't matter, as only the named ones
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.common import LOWER, SPACE, Workspace, arrow_map, distinct, doubtful_ids, keyed_hashes, mix, numbered, prepare, secret, shingles, slices, words
from gridlark.llm.graph import components

BINS = 128
ROWS = 4
BANDS = BINS // ROWS
SIMILARITY = 80  # percent
PIVOTS = 256
_U = np.uint64


def token_sets(data: np.ndarray, at: np.ndarray, k: int, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the distinct k-word shingles of each row, sorted."""
    low = LOWER[data]
    start, end, row = words(low, at, SPACE)
    return distinct(*shingles(keyed_hashes(low, start, end, key), row, len(at) - 1, k))


def sketch(row: np.ndarray, token: np.ndarray, rows: int, bins: int = BINS) -> np.ndarray:
    """rows x bins of (round, hash) minima; all ones where a row has no token."""
    out = np.full(rows * bins, ~_U(0), np.uint64)
    start = np.searchsorted(row, np.arange(rows + 1))
    open_rows = np.flatnonzero(start[1:] > start[:-1])
    which = np.arange(len(row))
    for i in range(2 * bins):
        if not len(open_rows):
            break
        if i and len(open_rows) < rows:
            keep = np.zeros(rows, bool)
            keep[open_rows] = True
            which = which[keep[row[which]]]
        h = mix(token[which] * _U(0xC2B2AE3D27D4EB4F) + _U((i + 1) * 0x165667B19E3779F9 % 2**64))
        # the low bits choose the bin, the high ones are the value below the round
        place = (h & _U(bins - 1)).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        value = (_U(i) << _U(54)) | (h >> _U(10))
        np.minimum.at(out, row[which] * bins + place, value)
        full = out.reshape(rows, bins)[open_rows] != ~_U(0)
        open_rows = open_rows[~full.all(axis=1)]
    return out.reshape(rows, bins)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """rows x bands of 64-bit keys; a key holds the band's number too."""
    part = minima.reshape(len(minima), BANDS, ROWS)
    acc = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), part.shape[:2]).copy()
    for j in range(ROWS):
        acc = mix(acc + part[:, :, j])
    return acc


def sketched(docs: DataFrame, k: int, key: tuple[int, int]) -> DataFrame:
    """docs (key, text) -> key, n_shingles, set_a, set_b (128 bits that tell sets apart), bands."""
    kind = dict(docs.dtypes)["key"]
    names = ["key", "n_shingles", "set_a", "set_b", "bands"]

    def run(batches):
        for batch in batches:
            for i, j, data, at in slices(batch.column(1)):
                n = j - i
                row, token = token_sets(data, at, k, key)
                count = np.bincount(row, minlength=n)
                ends = np.concatenate([[0], np.cumsum(count)])
                total = lambda v: np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
                a, b = total(mix(token + _U(11))), total(mix(token * _U(3) + _U(17)))
                own = lambda v: pa.array((v[ends[1:]] - v[ends[:-1]]).astype(np.int64))
                keys = band_keys(sketch(row, token, n)).astype(np.int64)
                cut = pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32))
                bands = pa.ListArray.from_arrays(cut, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(count), own(a), own(b), bands], names)

    return arrow_map(docs.select("key", "text"), run, f"key {kind}, n_shingles long, set_a long, set_b long, bands array<long>")


def full_sets(docs: DataFrame, k: int, key: tuple[int, int]) -> DataFrame:
    """rep, tokens (binary of sorted 64-bit numbers) of docs (key, text)."""
    kind = dict(docs.dtypes)["key"]

    def run(batches):
        for batch in batches:
            for i, j, data, at in slices(batch.column(1)):
                row, token = token_sets(data, at, k, key)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                sets = [token[ends[r] : ends[r + 1]].tobytes() for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], ["rep", "tokens"])

    return arrow_map(docs.select("key", "text"), run, f"rep {kind}, tokens binary")


def compared(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, tokens_a, tokens_b): a, b, common tokens, and whether the sets are similar enough."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches):
        for batch in batches:
            shared, good = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs are merged
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                shared.append(common)
                good.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(good, pa.bool_())], ["a", "b", "common", "linked"])

    return arrow_map(pairs.select("a", "b", "tokens_a", "tokens_b"), run, f"a {kind}, b {kind}, common long, linked boolean")


def linked(ws: Workspace, docs: DataFrame, k: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """docs (key, text), keys unique -> key, n_shingles, component (least key reachable)."""
    key = secret()
    flat = ws.table(sketched(docs, k, key))
    some = flat.where("n_shingles > 0")
    same = ["n_shingles", "set_a", "set_b"]
    classes = ws.table(some.groupBy(*same).agg(F.min("key").alias("rep")))
    bands = some.join(classes.select(*same, F.col("rep").alias("key")), [*same, "key"], "left_semi").select(F.col("key").alias("rep"), "n_shingles", "bands")
    keyed = bands.select(F.explode("bands").alias("bucket"), "rep", F.col("n_shingles").alias("size"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = ws.table(keyed.join(shared, "bucket"))
    out = flat.select("key", *same).join(classes, same, "left")
    if members.limit(1).count():
        labels = _links(ws, docs, members, bands.select("rep", "bands"), k, percent, key)
        if labels is not None:
            out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            return out.select("key", "n_shingles", F.coalesce("component", "rep", "key").alias("component"))
    return out.select("key", "n_shingles", F.coalesce("rep", "key").alias("component"))


def near_duplicates(ws: Workspace, docs: DataFrame, k: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept: one row per row."""
    docs = docs.select("doc_id", "text")
    if not doubtful_ids(docs):
        found = linked(ws, docs.withColumnRenamed("doc_id", "key"), k, percent)
        return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))
    rows = numbered(ws, docs, "key")
    found = linked(ws, rows.select("key", "text"), k, percent)
    ids = rows.select("key", "doc_id")
    # rows without an id have the last keys, so the least key has the least id
    named = ids.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("key") == F.col("component"))
    return found.join(ids, "key").join(named, "component").select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _links(ws: Workspace, docs: DataFrame, members: DataFrame, bands: DataFrame, k: int, percent: int, key: tuple[int, int]) -> DataFrame | None:
    """node, component of the classes that are linked; None if there is no link. members: bucket, rep, size, n."""
    nodes = members.select(F.col("rep").alias("key")).distinct()
    sets = ws.table(full_sets(docs.join(nodes, "key", "left_semi"), k, key))
    central = members.groupBy("rep").agg(F.sum("n").alias("company"))
    first = members.join(central, "rep").groupBy("bucket").agg(F.max(F.struct("company", "rep", "size")).alias("p"))
    first = ws.table(first.select("bucket", F.col("p.rep").alias("p"), F.col("p.size").alias("p_size")))
    pairs = members.join(first, "bucket").where(f"rep <> p and least(size, p_size) * 100 >= greatest(size, p_size) * {percent}")
    scored = _compare(ws, pairs, sets, percent)
    edges = scored.where("linked").select("a", "b")
    labels = components(ws, edges) if edges.limit(1).count() else None
    old, members = members, _open(ws, members.select("bucket", "rep", "size"), labels)
    ws.drop(old)
    if members.limit(1).count():
        old, all_sets = members, sets
        members, sets = _bounded(ws, members, first, scored, sets, bands, percent, labels)
        ws.drop(old, all_sets)
    ws.drop(first)
    pivots = PIVOTS
    while members.limit(1).count():
        most = members.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "comp"))["comp"].alias("major"))
        minor = members.join(most, "bucket").where("comp <> major").select("bucket", *[F.col(c).alias(f"p_{c}") for c in members.columns if c != "bucket"])
        minor = minor.withColumn("_r", F.row_number().over(Window.partitionBy("bucket").orderBy("p_rep"))).where(F.col("_r") <= pivots).drop("_r")
        minor = ws.table(minor)
        m = "least(shared, p_shared, least(inside, p_inside) + least(outside, p_outside))"
        near = f"comp <> p_comp and 100 * {m} >= {percent} * (size + p_size - {m})"
        # a pair that meets in several buckets is made in the first of them
        once = "get(array_intersect(bands, p_bands), 0) = bucket"
        pairs = members.join(minor, "bucket").where(f"{near} and {once}").select(F.col("p_rep").alias("p"), "rep")
        scored = _compare(ws, pairs, sets, percent)
        found = scored.where("linked").select("a", "b")
        if found.limit(1).count():
            edges = edges.union(found)
            was, labels = labels, components(ws, edges)
            if was is not None:
                ws.drop(was)
        rest = members.join(minor.select("bucket", F.col("p_rep").alias("rep")), ["bucket", "rep"], "left_anti")
        old, members = members, _open(ws, rest.drop("comp"), labels)
        ws.drop(old, minor)
        pivots *= 2
    ws.drop(members, sets)
    return labels


def _bounded(ws: Workspace, members: DataFrame, first: DataFrame, scored: DataFrame, sets: DataFrame, bands: DataFrame, percent: int, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Members with what bounds their common tokens with others, without those that no other can reach, and their sets."""
    # the central members of open buckets are among them, so what is common with these counts as shared
    kept = ws.table(sets.join(members.select("rep").distinct(), "rep", "left_semi"))
    members = members.drop("comp").join(_shared_tokens(kept), "rep", "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))
    members = members.join(first, "bucket").withColumns({"a": F.least("p", "rep"), "b": F.greatest("p", "rep")})
    members = members.join(scored.select("a", "b", "common"), ["a", "b"], "left")
    # not compared for their sizes: nothing is known about the central member
    own = F.col("rep") == F.col("p")
    inside = F.when(own, F.col("shared")).otherwise(F.coalesce("common", "shared"))
    outside = F.when(own, F.lit(0).cast("long")).otherwise(F.coalesce(F.col("shared") - F.col("common"), F.col("shared")))
    members = members.select("bucket", "rep", "size", "shared", inside.alias("inside"), outside.alias("outside"))
    least = members.groupBy("bucket").agg(F.min("size").alias("least"))
    # even against the smallest partner that could hold all shared tokens
    reach = f"shared * 100 >= {percent} * (size + greatest(least, shared) - shared)"
    return _open(ws, members.join(least, "bucket").where(reach).drop("least").join(bands, "rep"), labels), kept


def _compare(ws: Workspace, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, common, linked of the pairs (p, rep), each compared once on full sets."""
    once = pairs.select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b")).distinct()
    left, right = (sets.select(F.col("rep").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
    return ws.table(compared(once.join(left, "a").join(right, "b"), percent))


def _open(ws: Workspace, members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their component, of the buckets that hold more than one component."""
    if labels is None:
        named = members.withColumn("comp", F.col("rep"))
    else:
        named = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    several = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    return ws.table(named.join(several, "bucket"))


def _shared_tokens(sets: DataFrame) -> DataFrame:
    """rep, shared: how many of a class's tokens some other class of these has too."""
    kind = dict(sets.dtypes)["rep"]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(np.concatenate(tokens))], ["rep", "token"])

    rows = arrow_map(sets.select("rep", "tokens"), run, f"rep {kind}, token long")
    alike = rows.groupBy("token").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("token")
    return rows.join(alike, "token").groupBy("rep").agg(F.count("*").alias("shared"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(Workspace(spark, "neardup"), docs, k=4)


QUERIES = {"op4_near_duplicates": op4_near_duplicates}
ORACLES = {
    "op4_near_duplicates": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION SELECT y, x FROM l
), r AS (
  SELECT x AS a, y AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x
), m AS (
  SELECT a, min(b) AS b FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.a
"""
}
