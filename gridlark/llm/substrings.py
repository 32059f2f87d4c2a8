"""Removal of repeated substrings, exact to the byte, by suffix arrays of candidate strings.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Every window of that length
has an anchor: of its k-byte strings, the one with the least hash (leftmost on ties), so equal windows have equal
anchors at equal places. Neighbouring windows with one anchor form a run, and a run's string is its bytes.

1. Runs whose anchor occurs once in all documents hold no repeated window.
2. Of the others, a run string that occurs twice is repeated as a whole.
3. The remaining strings are compared within their anchor's group by a suffix array (linear grouping, see suffix.py):
   windows that are neighbours in it and equal are repeated. Strings, or halves of their windows, whose larger shared part
   no other string has are left out before. Groups of more than GROUP strings are split by
   the place of the anchor in the window, with longer anchors for narrower places: equal pieces collapse, and at
   the last level an anchor is a whole window, so a passage in a third of all documents ends in counts. Each level is
   an aggregation by hash, so no group is held in one task.
4. Repeated windows go back to their documents, are merged, and cut out.

Anchors are grouped by a rolling hash, which needn't tell strings apart: it only says what to compare. Equal strings
are told by 64 bits of BLAKE2b within their anchor's group, and neighbours in a suffix array by their common prefix.
Documents are read in pieces of PIECE windows, so memory doesn't grow with the longest text but where a text is
finally cut. Null and short texts lose nothing. Repeated doc_ids and null doc_ids are allowed: then the text's
digest is part of the key. Repeated rows are copies, so all of their windows repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import Spans, Workspace, arrow_map, buffers, byte_values, mix, prepare, same_bytes
from gridlark.llm.suffix import suffix_arrays

LENGTH = 200
ANCHOR = 50
GROUP = 32
PIECE = 1 << 20
LANE_BYTES = 1 << 20
_U = np.uint64


def digest(raw: bytes | memoryview, place: int) -> int:
    """64 bits of BLAKE2b of a string and the place of its anchor, as a signed number."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=place.to_bytes(8, "little")).digest(), "little", signed=True)


def anchors(data: np.ndarray, at: np.ndarray, length: int, k: int):
    """Runs in the rows of one slice: row, first and last window, place and hash of the anchor."""
    n, width = len(data), length - k + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    spans = Spans(data, byte_values(5))
    bits = _U(max(int(n).bit_length(), 1))
    h = spans.rolling(k)
    least, size = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    many = np.maximum(np.diff(at) - length + 1, 0)
    row = np.repeat(np.arange(len(at) - 1), many)
    window = np.arange(len(row)) + np.repeat(at[:-1] - (np.cumsum(many) - many), many)
    anchor = (least[window] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(window)) - 1 if len(s) else s
    first, last = window[s], window[e]
    return row[s], first, last, anchor[s], h[anchor[s]]


def pieces(column: pa.Array, length: int, piece: int):
    """(rows, offsets of the rows' parts in their rows, bytes, offsets) of about ``piece`` windows; parts of a long
    row overlap by length - 1 bytes, so that each window is in one of them."""
    data, at = buffers(column)
    rows, skip, parts, total = [], [], [], 0
    for r in range(len(at) - 1):
        size = at[r + 1] - at[r]
        for s in range(0, max(size - length + 1, 0), piece):
            part = data[at[r] + s : min(at[r] + s + piece + length - 1, at[r + 1])]
            rows.append(r)
            skip.append(s)
            parts.append(part)
            total += len(part)
            if total >= piece:
                yield np.array(rows), np.array(skip), np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                rows, skip, parts, total = [], [], [], 0
    if parts:
        yield np.array(rows), np.array(skip), np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def runs(docs: DataFrame, length: int, k: int, only_anchors: bool = False, piece: int = PIECE) -> DataFrame:
    """anchor, string (hashes), key, at (first window), spread (windows less one), offset (of the anchor in the first)."""
    kind = dict(docs.dtypes)["key"]

    def run(batches):
        for batch in batches:
            for rows, skip, data, at in pieces(batch.column(1), length, piece):
                row, first, last, anchor, h = anchors(data, at, length, k)
                if only_anchors:
                    yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64))], ["anchor"])
                    continue
                begin = first - at[row] + skip[row]
                keys = batch.column(0).take(pa.array(rows[row]))
                raw, offset = memoryview(data), anchor - first
                string = [digest(raw[f : e + length], o) for f, e, o in zip(first.tolist(), last.tolist(), offset.tolist(), strict=True)]
                columns = [pa.array(h.astype(np.int64)), pa.array(string, pa.int64()), keys, pa.array(begin), pa.array((last - first).astype(np.int32)), pa.array(offset.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "string", "key", "at", "spread", "offset"])

    fields = "anchor long" if only_anchors else f"anchor long, string long, key {kind}, at long, spread int, offset int"
    return arrow_map(docs.select("key", "text"), run, fields)


def packed(docs: DataFrame) -> DataFrame:
    """key, z: compressed texts, for the shuffle."""
    kind = dict(docs.dtypes)["key"]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, at = buffers(batch.column(1))
            for s in range(0, batch.num_rows, 512):
                e = min(s + 512, batch.num_rows)
                z = [pack.compress(data[at[i] : at[i + 1]].tobytes()) for i in range(s, e)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(z, pa.binary())], ["key", "z"])

    return arrow_map(docs.select("key", "text"), run, f"key {kind}, z binary")


def strings(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted (anchor, string, key, at, spread, offset, n, d)."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "string", "at", "spread", "offset", "n", "d")).alias("w"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                raw = unpack.decompress(batch.column(0)[i].as_py())
                w = batch.column(1)[i].values.flatten()
                at, spread = np.asarray(w[2]), np.asarray(w[3])
                text = [raw[a : a + s + length] for a, s in zip(at.tolist(), spread.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([w[0], w[1], w[4], w[5], w[6], pa.array(text, pa.binary())], ["anchor", "string", "offset", "n", "d", "bytes"])

    return arrow_map(packed(docs).join(lists, "key").select("z", "w"), run, "anchor long, string long, offset int, n long, d long, bytes binary").dropDuplicates(["anchor", "string"])


def promising(groups: list[list[tuple[bytes, int]]], length: int, k: int) -> list[list[tuple[int, int]]]:
    """For each string (bytes, the anchor's place in them) of each group: the windows, first and last, that can occur
    twice in it; (0, -1) for none.

    The windows with the anchor in their right half share more bytes left of it, the others right of it; a half whose
    shared bytes no other string of the group has holds no repeated window.
    """
    flat = [s for g in groups for s in g]
    if not flat:
        return [[] for _ in groups]
    raw = np.frombuffer(b"".join(s for s, _ in flat), np.uint8)
    size = np.array([len(s) for s, _ in flat])
    begin, place = np.cumsum(size) - size, np.array([o for _, o in flat])
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups]).astype(np.uint64)
    spans, last, middle = Spans(raw, byte_values(8)), place - (size - length), (length - k) // 2
    low, high = np.full(len(flat), np.iinfo(np.int64).max), np.full(len(flat), -1)
    for a, b in ((0, middle), (middle + 1, length - k)):  # of the anchor's place in a window
        there = np.flatnonzero((place >= a) & (last <= b))
        q = begin[there] + place[there]
        h = mix(spans.hash(q - a, q - b + length) + mix(group[there]))
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        there = there[count[back] > 1]
        low[there] = np.minimum(low[there], place[there] - np.minimum(place[there], b))
        high[there] = np.maximum(high[there], place[there] - np.maximum(last[there], a))
    low[high < 0] = 0
    pairs = list(zip(low.tolist(), high.tolist(), strict=True))
    ends = np.cumsum([len(g) for g in groups]).tolist()
    return [pairs[e - len(g) : e] for g, e in zip(groups, ends, strict=True)]


def repeated_windows(groups: list[list[bytes]], length: int) -> list[np.ndarray]:
    """For each string of each group, one after another: which of its windows occur twice in the group."""
    flat = [s for g in groups for s in g]
    sizes = np.array([sum(len(s) + 1 for s in g) + 1 for g in groups])
    out: list[np.ndarray] = [np.zeros(max(len(s) - length + 1, 0), bool) for s in flat]
    first = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    # texts of like size take their steps together
    order, i = np.argsort(sizes, kind="stable"), 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[order[i:]]), LANE_BYTES, "right")) + i)
        some = order[i:j]
        i = j
        # symbols: bytes from 2, 1 after each string, 0 at the end of each text
        raw = b"".join(b"".join(s + b"\0" for s in groups[g]) + b"\0" for g in some)
        start = np.concatenate([[0], np.cumsum(sizes[some])])
        ids = np.concatenate([np.arange(first[g], first[g + 1]) for g in some])
        text = np.frombuffer(raw, np.uint8).astype(np.int32) + 2
        lengths = np.array([len(flat[s]) for s in ids])
        per = np.array([len(groups[g]) for g in some])
        begin = np.cumsum(lengths + 1) - lengths - 1 + np.repeat(np.arange(len(some)), per)
        text[begin + lengths] = 1
        text[start[1:] - 1] = 0
        sa = suffix_arrays(text, start)
        # windows: suffixes with enough of their string left; owner is the string's number
        owner = np.full(len(text), -1, np.int64)
        left = np.zeros(len(text), np.int64)
        where = np.repeat(begin, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        owner[where] = np.repeat(ids, lengths)
        left[where] = np.repeat(begin + lengths, lengths) - where
        whole = left >= length
        lane = np.repeat(np.arange(len(some)), sizes[some])
        beside = np.flatnonzero(whole[sa[1:]] & whole[sa[:-1]] & (lane[sa[1:]] == lane[sa[:-1]]))
        one, other = sa[beside], sa[beside + 1]
        same = same_bytes(flat_bytes := np.frombuffer(raw, np.uint8), one, flat_bytes, other, np.full(len(beside), length))
        twice = np.zeros(len(text), bool)
        twice[one[same]] = True
        twice[other[same]] = True
        at = np.flatnonzero(twice)
        base = dict(zip(ids.tolist(), begin.tolist(), strict=True))
        # the strings lie one after another, so a string's hits are one run
        mine = owner[at]
        new = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(at) else at
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=False):
            o = int(mine[a])
            out[o][at[a:b] - base[o]] = True
    return out


def _mask_runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def searched(groups: DataFrame, length: int, k: int) -> DataFrame:
    """From rows with an array g of (anchor, string, base, offset, n, bytes): anchor, string, from, to (windows)."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                rows = batch.column(0).slice(s, 4096).to_pylist()
                hopes = promising([[(x["bytes"], x["offset"]) for x in g] for g in rows], length, k)
                kept = [[(x, f, e) for x, (f, e) in zip(g, h, strict=True) if e >= f] for g, h in zip(rows, hopes, strict=True)]
                kept = [g for g in kept if len(g) > 1]
                masks = repeated_windows([[x["bytes"][f : e + length] for x, f, e in g] for g in kept], length)
                a, t, lo, hi = [], [], [], []
                for (x, first, _), mask in zip([x for g in kept for x in g], masks, strict=True):
                    if x["n"] == 1 and mask.any():
                        for f, e in zip(*_mask_runs(mask), strict=True):
                            a.append(x["anchor"])
                            t.append(x["string"])
                            lo.append(x["base"] + first + f)
                            hi.append(x["base"] + first + e)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(t, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["anchor", "string", "from", "to"])

    return arrow_map(groups.select("g"), run, "anchor long, string long, from int, to int")


def split(items: DataFrame, low: int, high: int, step: int, length: int) -> DataFrame:
    """Pieces of strings (anchor, string, base, offset, n, bytes) with the anchor's place in [low, high) by steps.

    A piece's windows have the anchor at most step places apart, so they share length - step + 1 bytes, the new key.
    base is the first window's number in the whole string, offset the anchor's place in that window.
    """

    def run(batches):
        for batch in batches:
            cols = {n: [] for n in ("key", "piece", "anchor", "string", "base", "offset", "n", "bytes")}
            for x in batch.to_pylist():
                raw = x["bytes"]
                last = x["offset"] - (len(raw) - length)  # the anchor's place in the last window
                for a in range(low, high, step):
                    b = min(a + step, high) - 1
                    big, small = min(x["offset"], b), max(last, a)
                    if big < small:
                        continue
                    f, e = x["offset"] - big, x["offset"] - small  # windows
                    cols["key"].append(digest(raw[x["offset"] - a : x["offset"] - b + length], a))
                    cols["piece"].append(digest(raw[f : e + length], big))
                    cols["anchor"].append(x["anchor"])
                    cols["string"].append(x["string"])
                    cols["base"].append(x["base"] + f)
                    cols["offset"].append(big)
                    cols["n"].append(x["n"])
                    cols["bytes"].append(raw[f : e + length])
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)], list(cols))

    return arrow_map(items, run, "key long, piece long, anchor long, string long, base int, offset int, n long, bytes binary")


def repeats(ws: Workspace, docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, group: int = GROUP, piece: int = PIECE) -> DataFrame:
    """docs (key, text) -> key, start, end: byte ranges that repeated windows cover, not yet merged."""
    shared = runs(docs, length, k, True, piece).groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    rows = ws.table(runs(docs, length, k, False, piece).join(shared, "anchor"))
    once = F.min(F.struct("key", "at", "spread", "offset")).alias("x")
    known = ws.table(rows.groupBy("anchor", "string").agg(F.count("*").alias("n"), once).select("anchor", "string", "n", "x.*"))
    groups = known.groupBy("anchor").agg(F.count("*").alias("d"), F.min("n").alias("m")).where("d > 1 and m = 1").select("anchor", "d")
    text = ws.table(strings(docs, known.join(groups, "anchor"), length)).withColumn("base", F.lit(0))
    item = F.struct("anchor", "string", "base", "offset", "n", "bytes")
    verdicts = [known.where("n > 1").select("anchor", "string", F.lit(0).alias("from"), F.col("spread").alias("to"))]
    lanes = text.where(F.col("d") <= group).groupBy("anchor").agg(F.collect_list(item).alias("g"))
    verdicts.append(searched(lanes, length, k))
    hot, high = text.where(F.col("d") > group), length - k + 1
    step = -(-high // 4)
    while hot.limit(1).count():
        items = ws.table(split(hot.select("anchor", "string", "base", "offset", "n", "bytes"), 0, high, step, length))
        unlike = ws.table(items.groupBy("key", "piece").agg(F.sum("n").alias("n"), F.first(F.struct("anchor", "string", "base", "offset", "bytes")).alias("x")).select("key", "piece", "n", "x.*"))
        both = items.join(unlike.where("n > 1").select("key", "piece"), ["key", "piece"], "left_semi")
        verdicts.append(both.select("anchor", "string", F.col("base").alias("from"), (F.col("base") + F.octet_length("bytes") - length).alias("to")))
        sizes = unlike.groupBy("key").agg(F.count("*").alias("d"), F.min("n").alias("m")).where("d > 1 and m = 1").select("key", "d")
        open_ = unlike.join(sizes, "key")
        verdicts.append(searched(open_.where(F.col("d") <= group).groupBy("key").agg(F.collect_list(item).alias("g")), length, k))
        hot = open_.where(F.col("d") > group)
        if step == 1:
            break  # a piece is a window now, and its group holds nothing else
        step = -(-step // 4)
    found = verdicts[0]
    for v in verdicts[1:]:
        found = found.unionByName(v)
    found = ws.table(found)
    joined = rows.select("anchor", "string", "key", "at").join(found, ["anchor", "string"])
    return joined.select("key", (F.col("at") + F.col("from")).alias("start"), (F.col("at") + F.col("to") + length).alias("end"))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of the union; ranges that touch are one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1] if len(at) else end


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs (key, doc_id, text), and whether the key is the doc_id: it is if all are there and differ, otherwise a digest of the text goes with it."""
    doubt = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").limit(1).count() > 0
    own = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-"))
    key = F.concat_ws(":", own, F.md5(F.coalesce("text", F.lit("")))) if doubt else F.col("doc_id")
    return docs.select(key.alias("key"), "doc_id", "text"), not doubt


def without_repeats(ws: Workspace, docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, group: int = GROUP, piece: int = PIECE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, spans (removed byte ranges), kept (the other bytes)."""
    docs, plain = keyed(docs.select("doc_id", "text"))
    spans = repeats(ws, docs, length, k, group, piece).groupBy("key").agg(F.collect_list("start").alias("s"), F.collect_list("end").alias("e"))
    kind = dict(docs.dtypes)["doc_id"]
    whole = packed(docs).join(spans, "key", "left")
    # copies of a row are one key; each gives its row again
    whole = whole.withColumnRenamed("key", "doc_id") if plain else whole.join(docs.select("key", "doc_id").distinct(), "key").drop("key")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                size, cut, kept = [], [], []
                for z, b, e in zip(part.column(1), part.column(2), part.column(3), strict=True):
                    raw = unpack.decompress(z.as_py())
                    b, e = merged(np.array(b.as_py() or [], np.int64), np.array(e.as_py() or [], np.int64))
                    edge = [0, *np.column_stack([b, e]).ravel().tolist(), len(raw)]
                    size.append(len(raw))
                    cut.append([{"start": x, "end": y} for x, y in zip(b.tolist(), e.tolist(), strict=True)])
                    kept.append(b"".join(raw[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True)))
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(cut, kinds), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return arrow_map(whole.select("doc_id", "z", "s", "e"), run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = without_repeats(Workspace(spark, "substrings"), docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_repeated_substrings": op3_repeated_substrings}
ORACLES: dict[str, str] = {}
