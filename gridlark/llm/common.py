"""What the corpus operators share: tables on the shared folder, global order, and vectorised text work.

The numpy helpers work on one Arrow batch at a time, in slices of a few MB, so a task's memory is bounded
by the slice and by the longest single document.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlark.tables import fresh, shared_dir

SLICE_BYTES = 1 << 19
BATCH_BYTES = 4 << 20


# ---------------------------------------------------------------- tables on the shared folder

def prepare(spark: SparkSession) -> None:
    """Settings of the session that the queries and pipeline stages make: Arrow batches of at most BATCH_BYTES, so that
    rows of long texts can't fill a task's memory, and workers that find this package where the driver did."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), home]))


def arrow_map(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """df.mapInArrow in workers that give memory back after each task."""

    def bounded(batches):
        yield from run(batches)
        # workers stay for later tasks; what this one freed goes back to the system
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return df.mapInArrow(bounded, schema)


def with_fields(df: DataFrame, more: str) -> StructType:
    """The schema of df, whatever its names, and further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


class Workspace:
    """Written tables of one operator call: each cuts the lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made here that nothing will read again."""
        for df in tables:
            path = next(iter(df.inputFiles()), "").rpartition("/")[0]
            if path and self.path.rpartition("/")[2] in path:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


# ---------------------------------------------------------------- rows

def doubtful_ids(docs: DataFrame) -> bool:
    """Whether some doc_id is null or there more than once."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").limit(1).count() > 0


def numbered(ws: Workspace, docs: DataFrame, key: str) -> DataFrame:
    """docs with a number of each row in the column ``key``, a name that docs don't have: by id, null last, rows of one id by their contents.

    Rows are dealt by range, so rows of one id, or without, span many tasks. Rows alike in all columns are
    interchangeable.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    told = docs.select(F.struct(*own).alias("row"), F.xxhash64(*own).alias("like"), F.monotonically_increasing_id().alias("n"), F.lit(1).cast("long").alias("one"))
    order = [F.col("row")["doc_id"].asc_nulls_last(), F.col("like"), F.col("n")]
    placed = ordered_prefix(ws, told, order, [], {"key": "one"})
    return ws.table(placed.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("key").alias(key)))


def packed_up(docs: DataFrame, needed: list[str]) -> tuple[DataFrame, str]:
    """docs with the needed columns and all others in one struct, so that no name made later can meet one of theirs."""
    rest, = fresh(docs.columns, "_rest")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, (F.struct(*others) if others else F.lit(None).cast("int")).alias(rest)), rest


def unpacked(rows: DataFrame, docs: DataFrame, needed: list[str], rest: str) -> DataFrame:
    """The columns of docs, in their order, of rows that were packed up."""
    return rows.select(*[F.col(c) if c in needed else F.col(rest)[c].alias(c) for c in docs.columns])


# ---------------------------------------------------------------- global order without one task

def ordered_prefix(ws: Workspace, df: DataFrame, order: list[Column], group: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, per group, the sum of the rows before each row in a global order: {new column: summed column}.

    Rows are dealt by range of (group, order), so that a group of a third of all rows spans many tasks. Each
    part's sums (a row per part and group) give the offsets; only rows of one part are ever ordered together.
    ``order`` has to tell all rows apart; the parts are written once, so they can't change on a retry.
    """
    spark = ws.spark
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    number, = fresh([*df.columns, *sums], "_part")
    quoted = lambda c, of="": F.col(f"{of}`{c}`")
    dealt = df.repartitionByRange(parts, *[quoted(c) for c in group], *order).withColumn(number, F.spark_partition_id())
    dealt = ws.table(dealt)
    keys = [*group, number]
    part = dealt.groupBy(*[quoted(c) for c in keys]).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    before = Window.partitionBy(*[quoted(c) for c in group]).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*[quoted(c) for c in keys], *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"off_{k}") for k in sums])
    inside = Window.partitionBy(*[quoted(c) for c in keys]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    taken = fresh(dealt.columns, *[f"in_{k}" for k in sums])
    run = dealt.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(c) for c, v in zip(taken, sums.values(), strict=True)])
    same = [quoted(c, "a.").eqNullSafe(quoted(c, "b.")) for c in keys]
    joined = run.alias("a").join(part.alias("b"), same, "left")
    own = [quoted(c, "a.") for c in dealt.columns if c != number]
    return joined.select(*own, *[(F.col(f"b.off_{k}") + quoted(c, "a.")).alias(k) for c, k in zip(taken, sums, strict=True)])


# ---------------------------------------------------------------- text in numpy

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_values(seed: int = 1) -> np.ndarray:
    """A random 64-bit value for each byte, equal in all tasks."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95) + _U(seed * 0x632BE59BD9B4E019 % 2**64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


class Spans:
    """Hashes of any spans of one byte array, from prefix sums of value * base^position."""

    def __init__(self, data: np.ndarray, table: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def rolling(self, k: int) -> np.ndarray:
        """Hashes of all spans of k bytes, one to one with their polynomial values."""
        n = len(self.sums) - k
        x = (self.sums[k:] - self.sums[:n]) * self.down[:n]
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(32)
        return x

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407))


LONG_WORD = 64


def pieces_of_8(data: np.ndarray) -> np.ndarray:
    """At each place the 8 bytes from there on as one number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte runs: their 8-byte pieces are mixed in one after another; BLAKE2b for runs of over LONG_WORD bytes.

    Unlike a polynomial modulo 2^64 this has no family of texts with one value, but as all of it is known, single runs of one
    value can be made: what is found by it has to be compared byte by byte.
    """
    size = end - start
    h = mix(size.astype(np.uint64) + _U(seed * 0x632BE59BD9B4E019 % 2**64))
    at = pieces_of_8(data)
    live = np.flatnonzero(size <= LONG_WORD)
    for j in range(0, LONG_WORD, 8):
        live = live[size[live] > j]
        if not len(live):
            break
        piece = at[start[live] + j] & _FIRST[np.minimum(size[live] - j, 8)]
        h[live] = mix((h[live] ^ piece) * _U(0x9FB21C651E98DF25) + _U(0xD1342543DE82EF95))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=str(seed).encode()).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def secret() -> tuple[int, int]:
    """A key of 128 bits for keyed_hashes, drawn anew for each run, so that no table can be made to fit it."""
    raw = os.urandom(16)
    return int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")


def keyed_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """64-bit hashes of byte runs under a secret key: two lanes of 64 bits, each begun from the key, take in every 8-byte
    piece, and a lane's step depends on the other; keyed BLAKE2b for runs of over LONG_WORD bytes.

    A step can only be undone by who knows the key, so unlike runs of one value can't be written down before the run.
    """
    size = end - start
    n = size.astype(np.uint64)
    a, b = mix(n + _U(key[0])), mix(n * _U(0xA24BAED4963EE407) ^ _U(key[1]))
    at = pieces_of_8(data)
    live = np.flatnonzero(size <= LONG_WORD)
    for j in range(0, LONG_WORD, 8):
        live = live[size[live] > j]
        if not len(live):
            break
        piece = at[start[live] + j] & _FIRST[np.minimum(size[live] - j, 8)]
        one, two = a[live], b[live]
        a[live] = mix((one ^ piece) * _U(0x9FB21C651E98DF25) + two)
        b[live] = mix((two + piece) * _U(0xD6E8FEB86659FD93) ^ one)
    h = mix(a + (b << _U(1) | b >> _U(63)))
    long_key = key[0].to_bytes(8, "little") + key[1].to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=long_key).digest(), "little")
    return h


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size[i] bytes of a from a_start[i] equal those of b from b_start[i]."""
    same = np.ones(len(size), bool)
    x, y = pieces_of_8(a), pieces_of_8(b)
    live, j = np.flatnonzero(size > 0), 0
    while len(live):
        unlike = (x[a_start[live] + j] ^ y[b_start[live] + j]) & _FIRST[np.minimum(size[live] - j, 8)]
        same[live[unlike != 0]] = False
        j += 8
        live = live[(unlike == 0) & (size[live] > j)]
    return same


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    raw = filled.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES, rows: int = 4000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes; one row at least."""
    data, at = buffers(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, "right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


#: ASCII white space; the words of sizes and shingles are the runs of anything else.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the maximal runs of bytes that are no breaks; runs end with their row."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    out = breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = out[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = out[1:]
    start = np.flatnonzero(~out & (before | edge[:-1]))
    end = np.flatnonzero(~out & (after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def shingles(word: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of k words inside a row; a row of fewer, but some, words gives its whole sequence."""
    n = len(word)
    count = np.bincount(row, minlength=rows)
    if n >= k:
        acc = word[: n - k + 1].copy()
        for j in range(1, k):
            acc = mix(acc + _U(0x9FB21C651E98DF25)) + word[j : n - k + 1 + j]
        full = row[: n - k + 1] == row[k - 1 :]
        out_row, out = row[: n - k + 1][full], mix(acc[full] + _U(k))
    else:
        out_row, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        acc = word[first[short]].copy()
        for j in range(1, k - 1):
            more = count[short] > j
            acc[more] = mix(acc[more] + _U(0x9FB21C651E98DF25)) + word[first[short[more]] + j]
        out_row = np.concatenate([out_row, short])
        out = np.concatenate([out, mix(acc + count[short].astype(np.uint64))])
    return out_row, out


HASH_BITS = 52


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, top 52 bits of value), sorted by both; rows are below 4096."""
    key = np.sort((row.astype(np.uint64) << _U(HASH_BITS)) | (value >> _U(64 - HASH_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> _U(HASH_BITS)).astype(np.int64), key & _U((1 << HASH_BITS) - 1)
