"""Chat formatting of reply trees.

A tree's nodes point to their parents. Root-to-leaf paths come from iterative self-joins that double their reach:
each round joins every node's jump of 2^k steps with its target's, adding up scores, so a thread of n turns takes
log2(n) joins. Leaves are ranked in their tree by the mean or total score of their path, and the chosen leaves' jumps,
applied in turn, list the nodes of their paths.

Each path becomes one conversation. A turn is ``<s>role\\ntext</s>``; a backslash goes before every backslash of a text
and inside every control string (after its first character), so no control string is left in a text and removing
one level of backslashes gives it back. The loss mask is the spans, in code points, of the assistants' texts.

Null texts and roles are empty. Nodes whose parent is missing are roots; nodes on a cycle belong to no path. Rows
of one turn stand in the order of role and text. A null tree id is a tree of its own; empty tables give no rows.
A conversation is one output row, so its whole text has to fit a task, and no more than that does.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.common import Workspace, arrow_map, prepare

#: Control strings of the template and of common ones like it.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
_FIND = re.compile("|".join([r"\\", *[re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)]]))
_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n((?:[^\\]|\\.)*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _FIND.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistants' texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>{escape(role).replace(chr(10), chr(92) + chr(10))}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}</s>")
        at += len(out[-1])
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


# ---------------------------------------------------------------- trees

def branches(ws: Workspace, nodes: DataFrame, top: int = 1, by_mean: bool = False) -> DataFrame:
    """nodes (tree, node, parent, score), ids not null -> tree, leaf, rank, node, back (steps from the leaf)."""
    known = nodes.select("tree", F.col("node").alias("parent"))
    valid = nodes.join(known, ["tree", "parent"], "left_semi").select("tree", "node", "parent", "score")
    roots = nodes.join(known, ["tree", "parent"], "left_anti").select("tree", "node", F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("parent"), "score")
    start = ws.table(valid.unionByName(roots).select("tree", "node", F.col("parent").alias("to"), F.col("score").cast("double").alias("total"), F.lit(1).cast("long").alias("steps")))
    whole, jumps = start.where("`to` is null"), []
    active = start.where("`to` is not null")
    largest = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(math.ceil(math.log2(largest)) if largest > 1 else 0):
        jumps.append(active)
        # nodes that have reached their root are looked up, but jump no more
        target = whole.unionByName(active).select("tree", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("total").alias("_total"), F.col("steps").alias("_steps"))
        far = active.join(target, ["tree", "to"])
        far = ws.table(far.select("tree", "node", F.col("_to").alias("to"), (F.col("total") + F.col("_total")).alias("total"), (F.col("steps") + F.col("_steps")).alias("steps")))
        whole = whole.unionByName(far.where("`to` is null"))
        active = far.where("`to` is not null")
        if not active.limit(1).count():
            break
    # what still jumps runs in a cycle
    leaves = whole.join(start.select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti")
    score = F.col("total") / F.col("steps") if by_mean else F.col("total")
    best = Window.partitionBy("tree").orderBy(score.desc_nulls_last(), F.col("steps").desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    paths = ws.table(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("back")))
    for k, jump in enumerate(jumps):
        further = paths.join(jump.select("tree", "node", "to"), ["tree", "node"])
        paths = ws.table(paths.unionByName(further.select("tree", "leaf", "rank", F.col("to").alias("node"), (F.col("back") + (1 << k)).alias("back"))))
    return paths


def threads(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> tree, node, parent, score, role, text: each turn replies to the one before."""
    tree = F.concat(F.when(F.col("conv_id").isNull(), "-").otherwise("="), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    out = rows.select(tree.alias("tree"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("node", F.row_number().over(order).cast("long"))
    return out.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def formatted(ws: Workspace, nodes: DataFrame, top: int = 1, id_column: str = "conv_id") -> DataFrame:
    """conv_id, rank, formatted, loss (spans in code points): a conversation for each chosen path."""
    nodes = ws.table(nodes)
    paths = branches(ws, nodes.select("tree", "node", "parent", "score"), top)
    turns = paths.join(nodes.select("tree", "node", id_column, "role", "text"), ["tree", "node"])
    whole = turns.groupBy("tree", "leaf").agg(F.first(id_column).alias(id_column), F.first("rank").alias("rank"), F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))).alias("turns"))
    kind = dict(nodes.dtypes)[id_column]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text, loss = [], []
                for turns in part.column(2).to_pylist():
                    t, spans = format_turns([(x["role"], x["text"]) for x in turns])
                    text.append(t)
                    loss.append([{"start": a, "end": b} for a, b in spans])
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(loss, kinds)], [id_column, "rank", "formatted", "loss"])

    return arrow_map(whole.select(id_column, "rank", "turns"), run, f"{id_column} {kind}, rank int, formatted string, loss array<struct<start:long,end:long>>")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id and digests, parsed from the formatted text and its loss spans."""
    kind = dict(chats.dtypes)["conv_id"]

    def run(batches):
        for batch in batches:
            out = []
            for text, loss in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                turns = parse_turns(text)
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in loss.as_py())
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names)

    return arrow_map(chats.select("conv_id", "formatted", "loss"), run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(more.select(*[F.col(c).cast(kinds[c]) for c in rows.columns]))
    return read_back(formatted(Workspace(spark, "chat"), threads(rows)))


QUERIES = {"op5_chat_format": op5_chat_format}
ORACLES = {
    "op5_chat_format": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'),
    '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<s>', '<\s>'), '</s>', '<\/s>') AS esc
  FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(esc) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
}
