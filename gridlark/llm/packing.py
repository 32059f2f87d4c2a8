"""Harmonic packing of token sequences.

Lengths fall into classes by reciprocals of the capacity C: a piece of length floor(C / j) belongs to class j, of which j fill a
sequence, whatever documents they are from. Documents may be cut, so each is cut to class lengths: whole sequences
first, then the largest class length that fits, and so on; what is left shrinks about as its square, so that is five
pieces besides whole sequences at most times. A class's sequence then holds a fixed number of pieces and wastes C mod floor(C / j)
tokens, below sqrt(C).

Filling needs no order between workers: a task fills sequences of each class from the documents it reads and holds back
what its last, open sequence of each class has. Only these rests are ranked, by class over all tasks, and fill sequences
in the same way. What then is left, below C tokens a class whatever the size of the table, is laid end to end and cut
into whole sequences and, at last, powers of two.

A document: the ids of its whole text and the end id. Null and empty texts have the end id alone. Repeated rows and ids are
documents of their own. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import Workspace, arrow_map, ordered_prefix, prepare
from gridlark.llm.tokens import Chunks, WordIds, at_spaces, cut, default_path, runs_of_texts

CAPACITY = 4096
END = 2
#: Sequence ids tell where a sequence was filled: in a task (task and number), from rests (class and number), from the last tokens.
BY_TASK, BY_CLASS, LAST = 1 << 40, 1 << 62, 1 << 61
_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def class_lengths(capacity: int) -> list[int]:
    """floor(capacity / j) for all j, without repeats, in descending order."""
    return sorted({capacity // j for j in range(1, capacity + 1)}, reverse=True)


def cuts(length: int, capacity: int, lengths: np.ndarray) -> list[int]:
    """Lengths of the pieces of a document, in its order. lengths: the class lengths in ascending order."""
    out = [capacity] * (length // capacity)
    length %= capacity
    while length:
        out.append(int(lengths[np.searchsorted(lengths, length, "right") - 1]))
        length -= out[-1]
    return out


def powers_of_two(length: int) -> list[int]:
    """Descending powers of two that add up to length."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _row(doc, start: int, ids: bytes, total: int) -> list:
    return [doc, start, len(ids) // 4, zlib.crc32(ids), total, None, None, ids]


def _batches(rows: list[list], kind: pa.DataType, keep: bool):
    cols = list(zip(*rows, strict=True))
    if not keep:
        cols[7] = tuple(None if r[5] is not None else r[7] for r in rows)
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, k) for c, (_, k) in zip(cols[1:], _FIELDS, strict=True)]], ["doc_id", *[n for n, _ in _FIELDS]])


def filled(docs: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text), with sequences as far as a task fills them; others have none yet, and carry their ids."""
    lengths = np.array(class_lengths(capacity)[::-1])

    def run(batches):
        made = WordIds(tokenizer)
        chunks = Chunks(at_spaces, lambda new: {"ids": made(new)})
        held: dict[int, list] = defaultdict(list)
        number, kind = BY_TASK * TaskContext.get().partitionId(), pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for first, texts in runs_of_texts(batch.column(1)):
                ids, count = chunks.row("ids", *chunks.look(texts))
                ids, at, out = ids.astype("<u4"), cut(count), []
                for i in range(len(texts)):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end)).astype("<u4").tobytes()
                    doc, start = batch.column(0)[first + i].as_py(), 0
                    for length in cuts(len(own) // 4, capacity, lengths):
                        held[length].append(_row(doc, start, own[4 * start : 4 * (start + length)], len(own) // 4))
                        start += length
                        if len(held[length]) == capacity // length:
                            for k, row in enumerate(rows := held.pop(length)):
                                row[5:7] = number, k * length
                            out += rows
                            number += 1
                if out:
                    yield from _batches(out, kind, keep_ids)
        # held: below one sequence a class
        if rest := [row for rows in held.values() for row in rows]:
            yield from _batches(rest, kind, keep_ids)

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, {_SCHEMA}")


def pack(ws: Workspace, docs: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian 32 bits): a row per piece.

    ids are null unless keep_ids.
    """
    pieces = ws.table(filled(docs, tokenizer, end, capacity, keep_ids))
    columns = pieces.columns
    rest = pieces.where("sequence_id is null").withColumns({"_tie": F.monotonically_increasing_id(), "_one": F.lit(1).cast("long")})
    order = [F.col("doc_id").asc_nulls_first(), F.col("start"), F.col("ids_crc32"), F.col("_tie")]
    ranked = ordered_prefix(ws, rest, order, ["length"], {"_rank": "_one"})
    # a row per class, of which there are fewer than 2 * sqrt(capacity)
    total = rest.groupBy(F.col("length").alias("_class")).agg(F.count("*").alias("_n"))
    ranked = ranked.join(F.broadcast(total), F.col("length") == F.col("_class"))
    fit = F.expr(f"{capacity}L div length")
    number, whole = F.expr(f"_rank div ({capacity}L div length)"), F.col("_n") - F.col("_n") % fit
    ranked = ranked.withColumn("_full", F.col("_rank") < whole)
    ranked = ranked.withColumn("sequence_id", F.when(F.col("_full"), F.lit(BY_CLASS) + F.col("length") * BY_TASK + number))
    ranked = ws.table(ranked.withColumn("offset", F.when(F.col("_full"), F.col("_rank") % fit * F.col("length"))))
    own = lambda df: df.select(*columns[:-1], (F.col("ids") if keep_ids else F.lit(None).cast("binary")).alias("ids"))
    last = _laid_out(ws, ranked.where("sequence_id is null").select(*columns, F.col("_tie"), F.lit(0).alias("_all")), order, capacity)
    return pieces.where("sequence_id is not null").unionByName(own(ranked.where("sequence_id is not null"))).unionByName(own(last))


def _laid_out(ws: Workspace, rest: DataFrame, order: list, capacity: int) -> DataFrame:
    """Pieces (below one sequence a class) end to end, cut into whole sequences and powers of two."""
    total = rest.agg(F.sum("length")).first()[0] or 0
    sizes = [capacity] * (total // capacity) + powers_of_two(total % capacity)
    bounds = cut(np.array(sizes, np.int64))
    rows = ordered_prefix(ws, rest, [F.col("length").desc(), *order], ["_all"], {"_at": "length"})
    columns = ["doc_id", *[n for n, _ in _FIELDS]]

    def run(batches):
        for batch in batches:
            out = []
            for doc, start, length, _, tokens, _, _, ids, at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                inner = bounds[(bounds > at) & (bounds < at + length)]
                edges = [at, *inner.tolist(), at + length]
                for a, b in zip(edges, edges[1:], strict=False):
                    k = int(np.searchsorted(bounds, a, "right")) - 1
                    row = _row(doc, start + a - at, ids[4 * (a - at) : 4 * (b - at)], tokens)
                    row[5:7] = LAST + k, a - int(bounds[k])
                    out.append(row)
            if out:
                yield from _batches(out, batch.column(0).type, True)

    return arrow_map(rows.select(*columns, "_at"), run, f"doc_id {dict(rest.dtypes)['doc_id']}, {_SCHEMA}")


def padded(length: int, capacity: int = CAPACITY) -> int:
    """Tokens of a sequence with its padding: powers of two stay, all others are filled up to the capacity."""
    return length if length & (length - 1) == 0 else capacity


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (array) of pieces with ids: at most ``capacity`` ids a sequence."""
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return arrow_map(whole, run, "sequence_id long, ids array<int>")


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(Workspace(spark, "packing"), docs, default_path("word_bpe_49k.json")).drop("ids")


QUERIES = {"op12_harmonic_packing": op12_harmonic_packing}
ORACLES: dict[str, str] = {}
