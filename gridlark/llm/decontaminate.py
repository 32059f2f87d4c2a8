"""Benchmark decontamination with an FM-index per training shard.

The benchmark's windows (10 consecutive words; a shorter item is one window) are the patterns. A shard is a run of
documents of a few MB inside a task. Its words become symbols of the benchmark's vocabulary; stretches that no
window can touch (no pair of neighbouring words of a window, no one-word window) are left out, the rest is
joined with separators, suffix-sorted, and kept as a wavelet matrix over the Burrows-Wheeler transform. All
windows are searched backwards at once by wavelet ranks; each occurrence's row is walked to a sampled suffix
position; the windows found mark words, and runs of marked words are merged into removal spans. Words are looked up
by hashes that differ for all words of the vocabulary, and the words of every occurrence are compared byte by byte.

The documents are never shuffled, and a passage in a third of all documents costs as many located rows as it has
occurrences. The benchmark is broadcast in blocks, one at a time on the driver: items of over PIECE_BYTES are cut
into pieces that share WINDOW - 1 words, and pieces are dealt by the running sum of their sizes, so that a block has
at most BLOCK_BYTES and one piece more (a piece is larger only if ten words are). Each further block is a further
pass over the documents.

Null or wordless texts have no words and no hits; null or wordless items have no windows. Rows with one item_id
are one item; a null item_id is written as an empty string. Extra columns of the documents are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import LOWER, NOT_ALNUM, Workspace, arrow_map, ordered_prefix, prepare, same_bytes, slices, word_hashes, words, with_fields
from gridlark.tables import fresh

WINDOW = 10
BLOCK_BYTES = 1 << 20
PIECE_BYTES = 1 << 16
SAMPLE = 8
_U = np.uint64


class Patterns:
    """The distinct windows of some items, as symbols of their own vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        text = pa.array([t for _, t in items], pa.string())
        names = sorted({k for k, _ in items})
        number = {k: i for i, k in enumerate(names)}
        self.names = names
        found: dict[tuple, set[int]] = {}
        parts = [(i, LOWER[data], at) for i, _, data, at in slices(text)]
        self.bytes = np.concatenate([np.zeros(0, np.uint8), *[low for _, low, _ in parts]])
        base = np.cumsum([0, *[len(low) for _, low, _ in parts]])
        where = [words(low, at, NOT_ALNUM) for _, low, at in parts]
        none = np.zeros(0, np.int64)
        start = np.concatenate([none, *[s + o for (s, _, _), o in zip(where, base, strict=False)]])
        end = np.concatenate([none, *[e + o for (_, e, _), o in zip(where, base, strict=False)]])
        owner = np.concatenate([none, *[r + i for (_, _, r), (i, _, _) in zip(where, parts, strict=True)]])
        self.seed = 2
        while True:  # until no two words have one hash
            h = word_hashes(self.bytes, start, end, self.seed)
            self.vocabulary, first, back = np.unique(h, return_index=True, return_inverse=True)
            self.start, self.size = start[first], (end - start)[first]
            if np.all((end - start == self.size[back]) & same_bytes(self.bytes, start, self.bytes, self.start[back], np.minimum(end - start, self.size[back]))):
                break
            self.seed += 1
        cut = np.searchsorted(owner, np.arange(len(items) + 1))
        lists = [(number[items[r][0]], h[cut[r] : cut[r + 1]]) for r in range(len(items)) if cut[r + 1] > cut[r]]
        for k, h in lists:
            # symbols from 2: 0 ends the shard, 1 separates stretches
            symbols = np.searchsorted(self.vocabulary, h) + 2
            for j in range(max(len(h) - window + 1, 1)):
                found.setdefault(tuple(symbols[j : j + window].tolist()), set()).add(k)
        keys = sorted(found)
        self.length = np.array([len(k) for k in keys], np.int64)
        self.symbols = np.zeros((len(keys), window), np.int64)
        for i, k in enumerate(keys):
            self.symbols[i, : len(k)] = k
        self.item_start = np.concatenate([[0], np.cumsum([len(found[k]) for k in keys])]).astype(np.int64)
        self.item = np.array([x for k in keys for x in sorted(found[k])], np.int64)
        self.single = np.unique(self.symbols[self.length == 1, 0]) if len(keys) else np.zeros(0, np.int64)
        left, right = self.symbols[:, :-1].ravel(), self.symbols[:, 1:].ravel()
        real = right > 0
        self.pairs = np.unique(left[real] * self.width + right[real]) if len(keys) else np.zeros(0, np.int64)
        longer = self.length[self.length > 1]
        self.shortest = int(longer.min()) if len(longer) else 0

    @property
    def width(self) -> int:
        return len(self.vocabulary) + 2


def member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each value stands in a sorted table, whether it is there)."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def suffix_array(t: np.ndarray) -> np.ndarray:
    """By prefix doubling; t ends with a symbol that is nowhere else and least."""
    _, rank = np.unique(t, return_inverse=True)
    n, k = len(t), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank.astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class WaveletMatrix:
    """Access and rank of symbols; every call works on whole arrays of positions."""

    def __init__(self, sequence: np.ndarray, width: int):
        self.bits = max(int(width - 1).bit_length(), 1)
        self.ones, self.zeros = [], []
        current = sequence
        for b in range(self.bits - 1, -1, -1):
            bit = (current >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros(len(position), np.int64), position
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zero = self.ones[level], self.zeros[level]
            bit = (symbol >> b) & 1 == 1
            l1, h1 = ones[low], ones[high]
            low, high = np.where(bit, zero + l1, low - l1), np.where(bit, zero + h1, high - h1)
        return high - low

    def access_rank(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before it."""
        symbol, low, at = np.zeros(len(position), np.int64), np.zeros(len(position), np.int64), position
        for level in range(self.bits):
            ones, zero = self.ones[level], self.zeros[level]
            bit = ones[at + 1] > ones[at]
            symbol = (symbol << 1) | bit
            l1, a1 = ones[low], ones[at]
            low, at = np.where(bit, zero + l1, low - l1), np.where(bit, zero + a1, at - a1)
        return symbol, at - low


class FMIndex:
    def __init__(self, t: np.ndarray, width: int, sample: int = SAMPLE):
        order = suffix_array(t)
        self.n = len(t)
        self.wavelet = WaveletMatrix(t[order - 1], width)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=width))])
        marked = order % sample == 0
        self.marked = marked
        self.mark_rank = np.concatenate([[0], np.cumsum(marked)])
        self.sampled = order[marked]

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns, one backward step for all of them at a time."""
        low, high = np.zeros(len(length), np.int64), np.full(len(length), self.n, np.int64)
        for step in range(int(length.max()) if len(length) else 0):
            live = np.flatnonzero((length > step) & (low < high))
            c = symbols[live, length[live] - 1 - step]
            low[live] = self.first[c] + self.wavelet.rank(c, low[live])
            high[live] = self.first[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled suffix, counting the steps."""
        out, steps, at = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        live = np.arange(len(rows))
        while len(live):
            here = self.marked[at[live]]
            done = live[here]
            out[done] = self.sampled[self.mark_rank[at[done]]] + steps[done]
            live = live[~here]
            c, before = self.wavelet.access_rank(at[live])
            at[live] = self.first[c] + before
            steps[live] += 1
        return out


def occurrences(symbol: np.ndarray, row: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(word index, pattern) of every occurrence of every pattern in words of given symbols (0: not in the vocabulary)."""
    n = len(symbol)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not n or not len(p.length):
        return none
    keep = np.zeros(n, bool)
    live = np.zeros(n, bool)  # the pair of this word and the next
    known = (symbol[:-1] > 0) & (symbol[1:] > 0) & (row[:-1] == row[1:])
    at = np.flatnonzero(known)
    live[at] = member(symbol[at] * p.width + symbol[at + 1], p.pairs)[1]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], live.view(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]  # words first .. last, both included, form a run
    long = last - first + 1 >= p.shortest
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, first[long], 1)
    np.add.at(delta, last[long] + 1, -1)
    keep = np.cumsum(delta[:-1]) > 0
    if len(p.single):
        keep |= member(symbol, p.single)[1]
    kept = np.flatnonzero(keep)
    if not len(kept):
        return none
    # a separator before each stretch: where words aren't neighbours, change row, or aren't a live pair
    gap = np.ones(len(kept), bool)
    gap[1:] = (kept[1:] != kept[:-1] + 1) | (row[kept[1:]] != row[kept[:-1]])
    place = np.arange(len(kept)) + np.cumsum(gap)
    t = np.ones(place[-1] + 2, np.int64)
    t[place] = symbol[kept]
    t[-1] = 0
    word = np.full(len(t), -1, np.int64)
    word[place] = kept
    index = FMIndex(t, p.width)
    low, high = index.search(p.symbols, p.length)
    count = high - low
    pattern = np.repeat(np.arange(len(count)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return word[index.locate(rows)], pattern


def confirmed(word: np.ndarray, pattern: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, symbol: np.ndarray, p: Patterns) -> np.ndarray:
    """Which occurrences consist of the very words of their patterns."""
    delta = np.zeros(len(symbol) + 1, np.int64)
    np.add.at(delta, word, 1)
    np.add.at(delta, word + p.length[pattern], -1)
    covered = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
    own, size = symbol[covered] - 2, end[covered] - start[covered]
    same = (size == p.size[own]) & same_bytes(low, start[covered], p.bytes, p.start[own], np.minimum(size, p.size[own]))
    bad = np.zeros(len(symbol) + 1, np.int64)
    bad[covered[~same] + 1] = 1
    bad = np.cumsum(bad)
    return bad[word + p.length[pattern]] == bad[word]


def _search(data: np.ndarray, at: np.ndarray, p: Patterns):
    """Per row of one shard: words, hit words, item numbers, and byte spans of runs of hit words."""
    n = len(at) - 1
    low = LOWER[data]
    start, end, row = words(low, at, NOT_ALNUM)
    h = word_hashes(low, start, end, p.seed)
    place, there = member(h, p.vocabulary)
    symbol = np.where(there, place + 2, 0)
    word, pattern = occurrences(symbol, row, p)
    if len(word):
        sure = confirmed(word, pattern, low, start, end, symbol, p)
        word, pattern = word[sure], pattern[sure]
    delta = np.zeros(len(h) + 1, np.int64)
    np.add.at(delta, word, 1)
    np.add.at(delta, word + p.length[pattern], -1)
    hit = np.cumsum(delta[:-1]) > 0
    both = np.unique(row[word] * max(len(p.length), 1) + pattern) if len(word) else np.zeros(0, np.int64)
    doc, pat = both // max(len(p.length), 1), both % max(len(p.length), 1)
    count = p.item_start[pat + 1] - p.item_start[pat]
    item = p.item[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(p.item_start[pat], count)]
    items: list[set[int]] = [set() for _ in range(n)]
    for d, i in zip(np.repeat(doc, count).tolist(), item.tolist(), strict=True):
        items[d].add(i)
    at_hit = np.flatnonzero(hit)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if len(at_hit):
        new = np.ones(len(at_hit), bool)
        new[1:] = (at_hit[1:] != at_hit[:-1] + 1) | (row[at_hit[1:]] != row[at_hit[:-1]])
        first = at_hit[new]
        last = at_hit[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at_hit) - 1]])]
        for f, e in zip(first.tolist(), last.tolist(), strict=True):
            spans[row[f]].append((int(start[f] - at[row[f]]), int(end[e] - at[row[f]])))
    return np.bincount(row, minlength=n), np.bincount(row[hit], minlength=n), items, spans, start, end, row


def cut_items(items: DataFrame, window: int, most: int) -> DataFrame:
    """item_id, n, text: the pieces of about ``most`` bytes of each item, which share window - 1 words with the next."""

    def run(batches):
        for batch in batches:
            name, number, text = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (t or "").encode()
                start, end, _ = words(LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), NOT_ALNUM)
                first = 0
                while first < len(start):
                    last = max(int(np.searchsorted(end, start[first] + most, "right")), first + window)
                    last = min(last, len(start))
                    name.append(k)
                    number.append(first)
                    text.append(raw[start[first] : end[last - 1]].decode())
                    first = last - window + 1 if last < len(start) else last
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(number, pa.int64()), pa.array(text, pa.string())], ["item_id", "n", "text"])

    return arrow_map(items.select("item_id", "text"), run, "item_id string, n long, text string")


def blocks(bench: DataFrame, window: int, most: int, piece: int = PIECE_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """Lists of (item_id, text) of about ``most`` bytes, one after another; a benchmark that fits is one block."""
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    take = lambda df: [(r["item_id"], r["text"]) for r in df.select("item_id", "text").toLocalIterator()]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.octet_length("item_id")
    if (rows.agg(F.sum(size).alias("n")).first()["n"] or 0) <= most:
        yield take(rows)
        return
    ws = Workspace(bench.sparkSession, "benchmark")
    parts = cut_items(rows, window, piece).withColumns({"_size": size, "_tie": F.monotonically_increasing_id()})
    order = [F.xxhash64("item_id", "n"), F.col("_tie")]
    parts = ws.table(ordered_prefix(ws, parts, order, [], {"_before": "_size"}).withColumn("_block", F.expr(f"_before div {most}")))
    for r in parts.select("_block").distinct().orderBy("_block").toLocalIterator():
        yield take(parts.where(F.col("_block") == r["_block"]))


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, finish=None, schema: str | None = None) -> DataFrame:
    """docs with _n_words, _items (sorted ids whose windows occur) and _spans (byte ranges of runs of hit words), with more
    underscores where docs have such columns.

    Further blocks of a large benchmark add to the spans and items of those before. ``finish`` turns the last
    block's batches into those of ``schema`` in the same Python workers.
    """
    spark = docs.sparkSession
    span = "array<struct<start:long,end:long>>"
    out = docs
    names, new = docs.columns, fresh(docs.columns, "_n_words", "_items", "_spans")
    ahead = blocks(bench, window, block_bytes)
    items, number = next(ahead, []), 0
    while items is not None:
        following = next(ahead, None)
        sent = spark.sparkContext.broadcast(Patterns(items, window))
        text_at = names.index("text")

        def run(batches, sent=sent, first=number == 0, text_at=text_at, width=len(names)):
            p = sent.value
            for batch in batches:
                for i, j, data, at in slices(batch.column(text_at)):
                    part = batch.slice(i, j - i)
                    n_words, _, items, spans, _, _, _ = _search(data, at, p)
                    ids = [[p.names[x] for x in s] for s in items]
                    if not first:
                        ids = [sorted({*a, *b}) for a, b in zip(ids, part.column(width + 1).to_pylist(), strict=True)]
                        spans = [merged([(x["start"], x["end"]) for x in a] + b) for a, b in zip(part.column(width + 2).to_pylist(), spans, strict=True)]
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    rows = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(n_words, pa.int64()), pa.array([sorted(x) for x in ids], pa.list_(pa.string())), rows], [*names, *new])

        fields = with_fields(docs, ", ".join(f"{c} {t}" for c, t in zip(new, ("long", "array<string>", span), strict=True)))
        if finish is not None and following is None:
            out = arrow_map(out, lambda batches, run=run: finish(run(batches)), schema)
        else:
            out = arrow_map(out, run, fields)
        items, number = following, number + 1
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of byte spans; spans that only stand beside each other stay apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digests(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of docs (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def finish(batches):
        for batch in batches:
            n_hit, n_items, sha = [], [], []
            for i, j, data, at in slices(batch.column(1)):
                start, _, row = words(data, at, NOT_ALNUM)
                cut = np.searchsorted(row, np.arange(len(at)))
                for r in range(j - i):
                    items, spans = batch.column(3)[i + r].as_py(), batch.column(4)[i + r].as_py()
                    own = start[cut[r] : cut[r + 1]] - at[r]
                    n_hit.append(sum(int(np.searchsorted(own, s["end"]) - np.searchsorted(own, s["start"])) for s in spans))
                    n_items.append(len(items))
                    sha.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    rows = contamination(docs.select("doc_id", "text"), bench, finish=finish, schema=f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string", **options)
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def cleaned(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents with their removal spans cut out of the text; documents left without words by that go."""
    columns = docs.columns
    at = columns.index("text")

    def finish(batches):
        for batch in batches:
            text, keep = [], []
            for t, spans in zip(batch.column(at), batch.column(len(columns) + 2), strict=True):
                t, spans = t.as_py(), spans.as_py()
                if spans:
                    raw, last, parts = t.encode(), 0, []
                    for s in spans:
                        parts.append(raw[last : s["start"]])
                        last = s["end"]
                    t = b"".join([*parts, raw[last:]]).decode()
                    left, _, _ = words(*_one(t), NOT_ALNUM)
                    keep.append(len(left) > 0)
                else:
                    keep.append(True)
                text.append(t)
            arrays = [pa.array(text, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(keep, pa.bool_()))

    return contamination(docs, bench, finish=finish, schema=docs.schema, **options)


def _one(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES = {
    "op6_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), hw AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""
}
