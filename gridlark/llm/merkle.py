"""Merkle manifest of a dataset: an external-memory node store and proofs by merge-scans.

Every row is a leaf: the SHA-256 of its columns, each as ``-`` (null) or byte count, ``:`` and value. Rows of one tree (a
language) stand in ascending order of id; two consecutive nodes make their parent's digest, a last one without a
partner is hashed alone, until one is left, the tree's subroot. Subroots, ordered by tree, make the root in the same way.

Node store: leaves are sorted into runs once and written with their coordinates (tree, level, place). Each level is a
folder of Parquet files written by reading the one below in file order: neighbours meet in the stream of a task, and only
nodes at the seams of files and runs, a few for each file, are paired by an aggregation. So a level costs one sequential read
and no shuffle of its nodes, and no task holds more than a batch.

Proofs come from the top down. A tier of TIER levels is dealt into blocks, each a subtree of at most 2^TIER nodes at its lowest
level together with what lies above the block, sorted by coordinate and scanned once; what a block hands down is what
lies above each of its lowest nodes. The lowest tier's nodes are the leaves. A tree's size only adds tiers, so a tree that
holds a third of all rows spans many blocks.

Null ids come first in their tree, rows of one id in the order of their digests; rows alike in all columns are leaves
of their own with equal digests. A null tree is a tree, the first. An empty table has no root and gives no rows. Only the
named columns are read, so extra ones don't matter.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import Workspace, arrow_map, ordered_prefix, prepare

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels in one merge-scan; a block has at most 2^TIER nodes at its lowest level.
TIER = 9


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tree_key(column: Column) -> Column:
    """A key without nulls whose byte order is that of the column, null first."""
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), column.cast("string")))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- the node store

def placed(ws: Workspace, leaves: DataFrame, order: list[Column]) -> DataFrame:
    """leaves (tree, node, more) -> and place, width (leaves of the tree), as runs sorted by tree and place."""
    rows = ws.table(leaves.withColumn("_one", F.lit(1).cast("long")))
    width = rows.groupBy("tree").agg(F.count("*").alias("width"))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    rows = ordered_prefix(ws, rows, [*order, F.col("node"), F.col("_tie")], ["tree"], {"place": "_one"})
    return ws.table(rows.drop("_one", "_tie").join(width, "tree").sortWithinPartitions("tree", "place"))


def _paired(batches):
    """Nodes in the order of their files -> parents (half null), and nodes whose partner didn't follow (half 0: left, 1: right)."""
    held = None

    def half(row):
        tree, place, width, node = row
        if place % 2 == 0 and place == width - 1:
            return tree, place >> 1, (width + 1) >> 1, None, _sha(node)
        return tree, place >> 1, (width + 1) >> 1, place & 1, node

    for batch in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            tree, place, width, node = row
            if held is not None and place % 2 and held[0] == tree and held[1] == place - 1:
                out.append((tree, place >> 1, (width + 1) >> 1, None, _sha(held[3] + node)))
                held = None
                continue
            if held is not None:
                out.append(half(held))
                held = None
            if place % 2:
                out.append(half(row))
            else:
                held = row
        if out:
            yield _batch(out)
    if held is not None:
        yield _batch([half(held)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["tree", "place", "width", "half", "node"])


def node_levels(ws: Workspace, leaves: DataFrame) -> list[DataFrame]:
    """The levels (tree, place, width, node) of all trees over placed leaves; a tree ends at the level where its width is 1."""
    levels = [leaves]
    most = leaves.agg(F.max("width")).first()[0] or 0
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        below = levels[-1].select("tree", "place", "width", "node").where("width > 1")
        read = ws.table(arrow_map(below, _paired, "tree string, place long, width long, half int, node string"))
        side = [F.max(F.when(F.col("half") == h, F.col("node"))) for h in (0, 1)]
        seams = read.where("half is not null").groupBy("tree", "place", "width").agg(F.sha2(F.concat(*side), 256).alias("node"))
        levels.append(read.where("half is null").select("tree", "place", "width", "node").unionByName(ws.table(seams)))
    return levels


def subroots(levels: list[DataFrame]) -> DataFrame:
    """tree, node: the last node of each tree."""
    found = levels[0].where("width = 1").select("tree", "node")
    for level in levels[1:]:
        found = found.unionByName(level.where("width = 1").select("tree", "node"))
    return found


# ---------------------------------------------------------------- proofs

def _scanned(low: int, payload: int):
    """Merge-scan of blocks, each sorted from the top level down: for each node of level ``low`` what a proof has from there to the root."""

    def run(batches):
        block: dict = {"key": None}

        def results():
            steps, rows = block["nodes"], block["low"]
            if not rows:
                yield block["tree"], block["key"][1], None, block["subroot"], block["tail"], ()
            for place, width, node, more in rows:
                proof, at, wide, level = [], place, width, low
                while level < low + TIER and wide > 1:
                    other = at ^ 1
                    proof.append("-" if other >= wide else ("<" if other < at else ">") + steps[level, other])
                    at, wide, level = at >> 1, (wide + 1) >> 1, level + 1
                yield block["tree"], place, node, block["subroot"], proof + block["tail"], more

        for batch in batches:
            out = []
            for tree, number, level, place, width, node, subroot, tail, *more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block["key"] != (tree, number):
                    if block["key"] is not None:
                        out += results()
                    block = {"key": (tree, number), "tree": tree, "nodes": {}, "low": [], "tail": [], "subroot": None}
                if tail is not None:
                    block |= {"tail": tail, "subroot": subroot}
                    continue
                block["nodes"][level, place] = node
                if level == low:
                    block["low"].append((place, width, node, more))
            if out:
                yield made(out, batch.schema)
        if block["key"] is not None:
            yield made(list(results()), batch.schema)

    def made(rows, schema):
        cols = list(zip(*rows, strict=True))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
        arrays = [pa.array(c, k) for c, k in zip(cols[:5], kinds, strict=True)]
        rest = [pa.array([m[i] if m else None for m in cols[5]], schema.field(8 + i).type) for i in range(payload)]
        return pa.RecordBatch.from_arrays([*arrays, *rest], ["tree", "place", "node", "subroot", "proof", *[schema.field(8 + i).name for i in range(payload)]])

    return run


def proofs(ws: Workspace, levels: list[DataFrame], tops: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """tree, place, node, subroot, proof and the carried columns of each leaf.

    A proof lists, from the leaf up, ``<`` and the sibling on the left, ``>`` and the one on the right, or ``-`` where a
    node is hashed alone. tops: tree, subroot, proof (from the subroot up to the root).
    """
    carried = carried or []
    parts = max(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tails = tops.select("tree", F.lit(0).cast("long").alias("place"), "subroot", "proof")
    for low in range((max(len(levels) - 1, 0) // TIER) * TIER, -1, -TIER):
        more = carried if low == 0 else []
        kinds = dict(levels[0].dtypes)
        none = [F.lit(None).cast(kinds[c]).alias(c) for c in more]
        rows = tails.select("tree", F.col("place").alias("block"), F.lit(low + TIER).alias("level"), F.col("place"), F.lit(1).cast("long").alias("width"), F.lit(None).cast("string").alias("node"), "subroot", F.col("proof").alias("tail"), *none)
        for level in range(low, min(low + TIER, len(levels))):
            own = [F.col(c) for c in more] if level == 0 else none
            nothing = [F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("array<string>").alias("tail")]
            block = F.shiftright(F.col("place"), low + TIER - level).alias("block")
            rows = rows.unionByName(levels[level].select("tree", block, F.lit(level).alias("level"), "place", "width", "node", *nothing, *own))
        rows = rows.repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", F.col("level").desc(), "place")
        schema = "tree string, place long, node string, subroot string, proof array<string>" + "".join(f", `{c}` {kinds[c]}" for c in more)
        tails = arrow_map(rows, _scanned(low, len(more)), schema)
        if low:
            tails = ws.table(tails)
    # a tree without leaves in the lowest tier can't be: every tree has leaves
    return tails


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the siblings of a proof, from the leaf up."""
    return F.sha2(F.array_join(F.transform(F.filter(proof, lambda s: s != "-"), lambda s: F.substring(s, 2, 64)), ""), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    other = lambda s: F.substring(s, 2, 64)
    step = lambda acc, s: F.when(s == "-", F.sha2(acc, 256)).when(s.startswith("<"), F.sha2(F.concat(other(s), acc), 256)).otherwise(F.sha2(F.concat(acc, other(s)), 256))
    return F.aggregate(proof, start, step)


class Manifest:
    """The node store of a table of leaves (tree, node, more), ordered by ``order`` within each tree."""

    def __init__(self, ws: Workspace, leaves: DataFrame, order: list[Column]):
        taken = {c.lower() for c in leaves.columns} & {"place", "width", "half", "level", "block", "subroot", "tail", "proof", "_one", "_tie", "_part"}
        if taken:
            raise ValueError(f"columns of leaves named like the manifest's own: {sorted(taken)}")
        self.ws = ws
        self.levels = node_levels(ws, placed(ws, leaves, order))
        self.subroots = ws.table(subroots(self.levels))
        one = self.subroots.select(F.lit("").alias("tree"), "node", F.col("tree").alias("own"))
        self.top = node_levels(ws, placed(ws, one, [F.col("own")]))
        found = subroots(self.top).first()
        self.root = found["node"] if found else None

    def proofs(self, carried: list[str] | None = None) -> DataFrame:
        start = self.ws.spark.createDataFrame([("", self.root, [])] if self.root else [], "tree string, subroot string, proof array<string>")
        tops = proofs(self.ws, self.top, start, ["own"]).select(F.col("own").alias("tree"), F.col("node").alias("subroot"), "proof")
        return proofs(self.ws, self.levels, self.ws.table(tops), carried)

    def store(self) -> DataFrame:
        """All nodes by coordinate: tree, level, place, node."""
        rows = [d.select("tree", F.lit(n).alias("level"), "place", "node") for n, d in enumerate(self.levels)]
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = [F.col(c) for c in COLUMNS]
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", tree_key(F.col("lang")).alias("tree"), leaf(own).alias("node"), F.when(hit, leaf(changed)).alias("changed"))
    manifest = Manifest(Workspace(spark, "merkle"), leaves, [F.col("doc_id").asc_nulls_first()])
    out = manifest.proofs(["doc_id", "changed"])
    root = F.lit(manifest.root).cast("string")
    fold = folded(F.coalesce("changed", "node"), F.col("proof"))
    out = out.select("doc_id", F.col("node").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES = {
    "op11_merkle_manifest": r"""
WITH RECURSIVE c AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END)) AS crcs
), f AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, n_chars,
         coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS head,
         coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail
  FROM documents
), l AS (
  SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY tree) AS width,
         sha256(head || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || tail) AS node,
         sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-') || tail) AS changed
  FROM f
), t AS (
  SELECT tree, 0 AS level, place, width, node FROM l
  UNION ALL
  SELECT tree, level + 1, place // 2, any_value((width + 1) // 2), sha256(string_agg(node, '' ORDER BY place)) FROM t WHERE width > 1 GROUP BY tree, level, place // 2
), s AS (
  SELECT tree, level, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS width FROM t WHERE width = 1
), u AS (
  SELECT 0 AS level, place, width, node FROM s
  UNION ALL
  SELECT level + 1, place // 2, any_value((width + 1) // 2), sha256(string_agg(node, '' ORDER BY place)) FROM u WHERE width > 1 GROUP BY level, place // 2
), p AS (
  -- coordinates on the way up: first in the own tree, then in the tree of subroots
  SELECT l.doc_id, 0 AS part, t.level, (l.place >> t.level) AS at, t.width, o.node AS other
  FROM l JOIN (SELECT DISTINCT tree, level, width FROM t WHERE width > 1) t ON t.tree = l.tree
  LEFT JOIN t o ON o.tree = l.tree AND o.level = t.level AND o.place = xor(l.place >> t.level, 1)
  UNION ALL
  SELECT l.doc_id, 1, u.level, (s.place >> u.level), u.width, o.node
  FROM l JOIN s ON s.tree = l.tree JOIN (SELECT DISTINCT level, width FROM u WHERE width > 1) u ON true
  LEFT JOIN u o ON o.level = u.level AND o.place = xor(s.place >> u.level, 1)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, level) AS step FROM p
), g AS (
  SELECT doc_id, 0 AS step, CASE WHEN crc % 7 = 0 THEN coalesce(changed, node) ELSE node END AS acc
  FROM (SELECT l.*, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(c.crcs[(xor(a, b) & 255) + 1], a >> 8))) AS crc FROM l, c)
  UNION ALL
  SELECT g.doc_id, g.step + 1, sha256(CASE WHEN n.other IS NULL THEN g.acc WHEN n.at % 2 = 1 THEN n.other || g.acc ELSE g.acc || n.other END)
  FROM g JOIN n ON n.doc_id = g.doc_id AND n.step = g.step + 1
), r AS (
  SELECT node AS root FROM u WHERE width = 1
)
SELECT l.doc_id, l.node AS leaf, s.node AS subroot, r.root, sha256(coalesce(q.joined, '')) AS proof_sha256, e.acc AS folded_root, e.acc = r.root AS verified
FROM l JOIN s ON s.tree = l.tree CROSS JOIN r
LEFT JOIN (SELECT doc_id, string_agg(other, '' ORDER BY step) FILTER (WHERE other IS NOT NULL) AS joined FROM n GROUP BY doc_id) q ON q.doc_id = l.doc_id
JOIN (SELECT doc_id, max_by(acc, step) AS acc FROM g GROUP BY doc_id) e ON e.doc_id = l.doc_id
"""
}
