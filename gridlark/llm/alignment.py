"""Alignment of two tokenizers by byte-owner arrays.

space+text is tokenised by A (byte-level) and text by B (pieces, which adds the space). With both tokens' byte lengths, np.repeat
gives each byte its owner in A and in B. Where the pair of owners changes, a new overlap of an A and a B token begins;
where both change at once, both end, and that offset is a cut. Tokens between two cuts are a group; the A and the B
token that end at a cut are linked, so a group has one link.

Both tokenizers split before a space after a non-white character, whatever else is around it, so every chunk ends in a cut and
the owner arrays are made once for a task's distinct chunks. Counts of linked id pairs are added up in the tasks, then by
pair. Linked tokens end together, so the bytes of one end those of the other: there are at most as many pairs as the
two vocabularies' tokens have ends, whatever the corpus, and the table of pairs may go to every task for the second pass.

Null and empty texts, and those that B doesn't give back byte by byte (U+2581 in them), have no tokens. Repeated rows
count as often as they are there. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.common import Workspace, arrow_map, prepare
from gridlark.llm.tokens import Chunks, Merges, before_spaces, byte_letters, byte_tokenizer, cut, default_path, flattened, runs_of_texts, spread, sums

_BIT = np.int64(32)


# How byte-level vocabularies of this kind split, and the same within Latin-1.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+| ?[^\sA-Za-z0-9ªµºÀ-ÖØ-öø-ÿ²³¹¼½¾]+|\s+(?!\S)|\s+")
_SIMPLE = re.compile("[!-~¡-¬®-ÿ]+")


class ByteIds:
    """Ids of chunks (with their space) by a byte-level tokenizer, special tokens' strings as plain text.

    Chunks of Latin-1 without white space inside are split here and merged many at a time, all others by the library.
    """

    def __init__(self, path: str):
        self.library = byte_tokenizer(path, special=False)
        made = json.loads(Path(path).read_text(encoding="utf-8"))
        kind = made["pre_tokenizer"] or {}
        plain = made["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
        merges = Merges(path)
        lead = lambda new: (np.fromiter((w[0] == " " for w in new), np.int64, len(new)), np.ones(len(new), np.int64))
        self.parts = Chunks(None, lambda new: {"ids": merges.ids([w.encode() for w in new]), "lead": lead(new)}) if plain else None

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + chunk of all chunks in one row, and how many each has."""
        simple = np.zeros(len(chunks), bool)
        if self.parts is not None:
            all_simple = "" not in chunks and _SIMPLE.fullmatch("".join(chunks))
            simple = ~simple if all_simple else np.fromiter((_SIMPLE.fullmatch(c) is not None for c in chunks), bool, len(chunks))
        plain = chunks if simple.all() else [chunks[i] for i in np.flatnonzero(simple).tolist()]
        other = [f" {chunks[i]}" for i in np.flatnonzero(~simple).tolist()]
        ids, count = flattened([e.ids for e in self.library.encode_batch_fast(other, add_special_tokens=False)] if other else [])
        if not plain:
            return ids, count
        # a chunk's first part alone begins with a space: no simple chunk has one inside
        found = self.parts.numbered(_PARTS.findall(f" {' '.join(plain)}"))
        first = np.flatnonzero(self.parts.flat["lead"][found])
        own, own_count = self.parts.row("ids", found, np.diff(np.concatenate([first, [len(found)]])))
        order = np.argsort(np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)]), kind="stable")
        count = np.concatenate([own_count, count])[order]
        return np.concatenate([own, ids])[spread(np.concatenate([cut(own_count)[:-1], len(own) + cut(count[~simple])[:-1]])[order], count)], count


class Pair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = ByteIds(a_path)
        letters = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = self.a.library.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")

    def encoded(self, chunks: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Ids of " " + chunk by A and of chunk by B in rows with counts, and whether both give the bytes back. A chunk without them has no ids."""
        a, n_a = self.a(chunks)
        lists = self.b.encode(chunks, num_threads=1)
        for i in [i for i, c in enumerate(chunks) if not c]:
            lists[i] = [self.space]
        b, n_b = flattened(lists)
        raw = [f" {c}".encode() for c in chunks]
        whole = b"".join(raw)
        both = [b"".join(map(of.__getitem__, ids.tolist())) for of, ids in ((self.a_bytes, a), (self.b_bytes, b))]
        good = np.ones(len(chunks), bool)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sizes = [np.array_equal(sums(s[ids], n), size) for s, ids, n in ((self.a_size, a, n_a), (self.b_size, b, n_b))]
        if both != [whole, whole] or not all(sizes):
            for (ids, n), of in (((a, n_a), self.a_bytes), ((b, n_b), self.b_bytes)):
                ends = cut(n).tolist()
                for i, r in enumerate(raw):
                    good[i] &= b"".join(map(of.__getitem__, ids[ends[i] : ends[i + 1]].tolist())) == r
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        return (a, n_a), (b, n_b), good


def owners(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two rows of tokens over the same bytes: overlaps (A token, B token), and the byte offsets where both end."""
    a, b = np.repeat(np.arange(len(a_size)), a_size), np.repeat(np.arange(len(b_size)), b_size)
    if not len(a):
        none = np.zeros(0, np.int64)
        return none, none, none
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    begins = np.concatenate([[0], np.flatnonzero(new_a | new_b) + 1])
    return a[begins], b[begins], np.concatenate([np.flatnonzero(new_a & new_b) + 1, [len(a)]])


class Aligned(Chunks):
    """Chunks with the ids of A and B, cuts in bytes, overlaps, links as a << 32 | b, and the groups' names if asked for."""

    def __init__(self, pair: Pair, fields: tuple[str, ...], forget=None, named: bool = False):
        self.pair, self.fields, self.named = pair, fields, named
        super().__init__(before_spaces, self._encode, forget)

    def _empty(self) -> None:
        super()._empty()
        self.groups: list[str] = []

    def _encode(self, new: list[str]) -> dict:
        (a, n_a), (b, n_b), good = self.pair.encoded(new)
        a_size, b_size = self.pair.a_size[a], self.pair.b_size[b]
        over_a, over_b, cuts = owners(a_size, b_size)
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        last_a, last_b = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
        size = sums(a_size, n_a)
        place = lambda at, ends: np.searchsorted(ends, at, "right") - 1
        chunk_of_cut = np.searchsorted(np.cumsum(size), cuts)
        per = lambda chunk: np.bincount(chunk, minlength=len(new)).astype(np.int64)
        if self.named:
            self._name_groups(a, b, last_a, last_b, per(chunk_of_cut))
        made = {
            "a": lambda: (a, n_a), "b": lambda: (b, n_b), "bytes": lambda: (size, np.ones(len(new), np.int64)),
            "cuts": lambda: (cuts - cut(size)[:-1][chunk_of_cut], per(chunk_of_cut)),
            "links": lambda: (a[last_a] << _BIT | b[last_b], per(chunk_of_cut)),
            "counts": lambda: (np.column_stack([n_a, n_b]).ravel(), np.full(len(new), 2)),
            "over_a": lambda: (over_a - cut(n_a)[:-1][place(over_a, cut(n_a)[:-1])], per(place(over_a, cut(n_a)[:-1]))),
            "over_b": lambda: (over_b - cut(n_b)[:-1][place(over_b, cut(n_b)[:-1])], per(place(over_b, cut(n_b)[:-1]))),
        }
        return {"bad": ((~good).astype(np.int64), np.ones(len(new), np.int64))} | {f: made[f]() for f in self.fields}

    def _name_groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, cuts_per_chunk: np.ndarray) -> None:
        """The groups of each chunk as ``a1,a2|b1;a3|b2``."""
        first_a, first_b = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], last_b[:-1] + 1])
        # a group of one and one token is written once for all its occurrences
        single = (first_a == last_a) & (first_b == last_b)
        pairs, back = np.unique(a[last_a[single]] << _BIT | b[last_b[single]], return_inverse=True)
        texts = np.array([f"{p >> 32}|{p & 0xFFFFFFFF}" for p in pairs.tolist()], object)
        named = np.empty(len(last_a), object)
        named[single] = texts[back]
        where = np.flatnonzero(~single)
        row_a, row_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        for g, i, x, j, y in zip(*(v.tolist() for v in (where, first_a[where], last_a[where] + 1, first_b[where], last_b[where] + 1)), strict=True):
            named[g] = f"{','.join(row_a[i:x])}|{','.join(row_b[j:y])}"
        named, ends = named.tolist(), cut(cuts_per_chunk).tolist()
        self.groups += [";".join(named[s:e]) for s, e in zip(ends, ends[1:], strict=False)]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks in one row, how many each text has (0 for texts that B doesn't give back), and the numbers of all chunks' texts."""
        chunks, per_text = self.look(texts)
        bad = sums(self.flat["bad"][chunks], per_text) > 0 if len(chunks) else np.zeros(len(texts), bool)
        if bad.any():
            chunks, per_text = chunks[~np.repeat(bad, per_text)], np.where(bad, 0, per_text)
        return chunks, per_text, np.repeat(np.arange(len(texts)), per_text)


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, a, b (ids), cuts (byte offsets in space+text), overlaps (numbers of A and B tokens)."""
    pairs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        made = Aligned(Pair(a_path, b_path), ("a", "b", "bytes", "cuts", "over_a", "over_b"))
        for batch in batches:
            for first, texts in runs_of_texts(batch.column(1)):
                chunks, per_text, _ = made.texts(texts)
                n = len(texts)
                if not len(chunks):
                    got = {k: (np.zeros(0, np.int64), np.zeros(n, np.int64)) for k in ("a", "b", "cuts", "over_a", "over_b")}
                else:
                    got = {k: made.row(k, chunks, per_text) for k in ("a", "b", "cuts", "over_a", "over_b")}
                    # places inside a chunk become places inside the text
                    first_of = cut(per_text)[:-1]
                    for k, by in (("cuts", made.flat["bytes"][made.start["bytes"][chunks]]), ("over_a", made.count["a"][chunks]), ("over_b", made.count["b"][chunks])):
                        before = cut(by)[:-1]
                        begin = np.repeat(np.concatenate([before, [0]])[np.minimum(first_of, len(before))], per_text)
                        got[k] = got[k][0] + np.repeat(before - begin, made.count[k][chunks]), got[k][1]
                lists = [pa.ListArray.from_arrays(pa.array(cut(got[k][1]), pa.int32()), pa.array(got[k][0], t)) for k, t in (("a", pa.int32()), ("b", pa.int32()), ("cuts", pa.int64()))]
                both = pa.StructArray.from_arrays([pa.array(got["over_a"][0]), pa.array(got["over_b"][0])], ["a", "b"])
                over = pa.ListArray.from_arrays(pa.array(cut(got["over_a"][1]), pa.int32()), both).cast(pairs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *lists, over], ["doc_id", "a", "b", "cuts", "overlaps"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, a array<int>, b array<int>, cuts array<long>, overlaps array<struct<a:long,b:long>>")


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """link (a << 32 | b), b, n: how many links of all texts hold an id pair; a task adds up its own first."""

    def run(batches):
        out: list[pa.RecordBatch] = []
        times = np.zeros(0, np.int64)

        def flush():
            nonlocal times
            if "links" in made.flat and len(times):
                chunk = np.repeat(np.arange(len(made.count["links"])), made.count["links"])
                link, back = np.unique(made.flat["links"], return_inverse=True)
                n = np.zeros(len(link), np.int64)
                np.add.at(n, back, np.concatenate([times, np.zeros(max(0, len(made.number) - len(times)), np.int64)])[chunk])
                out.append(pa.RecordBatch.from_arrays([pa.array(link[n > 0]), pa.array(n[n > 0])], ["link", "n"]))
            times = np.zeros(0, np.int64)

        made = Aligned(Pair(a_path, b_path), ("links",), flush)
        for batch in batches:
            for _, texts in runs_of_texts(batch.column(1)):
                chunks, _, _ = made.texts(texts)
                more = np.bincount(chunks, minlength=len(made.number)).astype(np.int64)
                more[: len(times)] += times
                times = more
                while out:
                    yield out.pop()
        flush()
        while out:
            yield out.pop()

    counted = arrow_map(docs.select("doc_id", "text"), run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    return counted.withColumn("b", F.col("link").bitwiseAND((1 << 32) - 1))


def digests(ws: Workspace, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text."""
    pairs = ws.table(link_counts(docs, a_path, b_path))
    top = F.max("n").over(Window.partitionBy("b"))
    # at most one row for each end of a token of either vocabulary
    table = pairs.select("link", "n", (F.col("n") == top).alias("best")).toPandas().sort_values("link")
    shared = ws.spark.sparkContext.broadcast((table["link"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(np.int64)))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches):
        link, n, best = shared.value
        made = Aligned(Pair(a_path, b_path), ("counts", "links"), named=True)
        for batch in batches:
            for first, texts in runs_of_texts(batch.column(1)):
                chunks, per_text, _ = made.texts(texts)
                ends = cut(per_text).tolist()
                values = [np.zeros(len(texts), np.int64)] * 6
                if len(chunks):
                    # sums of the distinct chunks first, then of the texts
                    used, back = np.unique(chunks, return_inverse=True)
                    links, count = made.flat["links"], made.count["links"][used]
                    at = np.searchsorted(link, links[spread(made.start["links"][used], count)])
                    n_a, n_b = made.flat["counts"].reshape(-1, 2)[used].T
                    of_chunk = [n_a, n_b, count, count, sums(best[at], count), sums(n[at], count)]
                    values = [sums(v[back], per_text) for v in of_chunk]
                chunks = chunks.tolist()
                named = [hashlib.sha256(";".join(map(made.groups.__getitem__, chunks[s:e])).encode()).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *map(pa.array, values), pa.array(named, pa.string())], ["doc_id", *names, "groups_sha256"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + "".join(f"{c} long, " for c in names) + "groups_sha256 string")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(Workspace(spark, "alignment"), docs, default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict[str, str] = {}
