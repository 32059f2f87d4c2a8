"""Token ids of whole texts from those of their chunks.

A tokenizer's pre-splitting never joins what stands on the two sides of certain spaces, so the ids of a text are those
of its chunks one after another, exactly. Words repeat, so a task encodes each distinct chunk once and keeps
what it made in flat arrays; a text is then a row of chunk numbers. The store is emptied once it holds MOST chunks or
MOST_BYTES of text, so a task's memory is bounded and nothing is left out.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa

MOST = 600_000
MOST_BYTES = 32 << 20
#: Bytes of text that are looked at together.
LOOK = 1 << 20


def default_path(name: str) -> str:
    """The place of an installed vocabulary file; callers with files of their own pass a path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_tokenizer(path: str, special: bool):
    """A tokenizer of the JSON form; special: whether special tokens' strings in a text are those tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = not special
    return found


def byte_letters() -> list[str]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable ones as they are, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0x100
    for b in range(256):
        out.append(chr(b if b in shown else more))
        more += b not in shown
    return out


_SPARE = np.iinfo(np.int32).max
_U = np.uint64


class Merges:
    """The merges of a byte-level BPE file, for many words at once: in each round every word merges its pair of least rank.

    A pair can only be merged after its parts have been made, so equal pairs of a word may be merged in one round, from the
    left. Pairs are looked up in an open hash table of arrays.
    """

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.first = np.array([vocabulary[c] for c in letters], np.int64)
        self.last = np.array([vocabulary[c + end] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocabulary[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.width = len(vocabulary)
        self.bits = max(len(pairs).bit_length() + 3, 10)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, _SPARE, np.int32)
        todo, self.probes = np.arange(len(pairs)), 0
        key = left * self.width + right
        while len(todo):
            at = self._place(key[todo], self.probes)
            free, first = np.flatnonzero(self.keys[at] < 0), None
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.rank[at[won]] = key[todo[won]], todo[won]
            todo = np.delete(todo, won)
            self.probes += 1

    def _place(self, key: np.ndarray, probe: int) -> np.ndarray:
        h = (key.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)
        return (h.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        out = np.full(len(key), _SPARE, np.int32)
        open_ = np.arange(len(key))
        for probe in range(self.probes):
            at = self._place(key[open_], probe)
            there = self.keys[at]
            hit = there == key[open_]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit & (there >= 0)]
            if not len(open_):
                break
        return out

    def ids(self, words: list[bytes], together: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in one row, and how many each has."""
        parts = [self._ids(words[i : i + together]) for i in range(0, len(words), together)]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *[p[k] for p in parts]]) for k in (0, 1))

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        token = self.first[raw]
        ends = np.cumsum(size)[size > 0]
        token[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), size)
        rank = self._between(token, word)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, start)
            run = np.concatenate([start[1:], [len(token)]]) - start
            if np.count_nonzero(least == _SPARE) * 4 >= len(start):
                live = np.repeat(least != _SPARE, run)
                done.append((word[~live], token[~live]))
                token, word, rank = token[live], word[live], rank[live]
                continue
            hit = (rank == np.repeat(least, run)) & (rank != _SPARE)
            at = np.flatnonzero(hit)
            # of pairs that overlap, every other one, from the left
            fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
            begun = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begun) % 2 == 0]
            token[at] = self.made[rank[at]]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            token, word, rank = token[keep], word[keep], rank[keep]
            near = np.concatenate([new, new[new > 0] - 1])
            near = near[near < len(token) - 1]
            rank[new] = _SPARE
            same = near[word[near] == word[near + 1]]
            rank[same] = self._ranks(token[same], token[same + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, token = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return token[order], np.bincount(word, minlength=len(words)).astype(np.int64)

    def _between(self, token: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The rank of each token's pair with the next one of its word."""
        rank = np.full(len(token), _SPARE, np.int32)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = self._ranks(token[same], token[same + 1])
        return rank


def at_spaces(text: str) -> list[str]:
    """Chunks between single spaces, the spaces left out: for tokenizers that drop white space."""
    return text.split(" ")


_AFTER_WHITE = re.compile(r"\s ")
_BOUNDARY = re.compile(r"(?<=\S)(?= )")


def before_spaces(text: str) -> list[str]:
    """Chunks of space+text that begin with a space after a character that isn't white, this space left out.

    White space that a space follows stays in one chunk with it, as tokenizers take such runs together.
    """
    if text[:1] == " " or _AFTER_WHITE.search(text):
        return [c[1:] for c in _BOUNDARY.split(f" {text}")]
    return text.split(" ")


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i] .. start[i] + count[i] - 1 for each i, in one row."""
    if not len(count):
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def cut(count: np.ndarray) -> np.ndarray:
    """Offsets of runs of these lengths."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])


_SIMPLE = re.compile("[\t-\r!-~¡-¬®-ÿ]*")
_MARK = "\x01"
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|\x01|[^\s\x01a-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")
# How a vocabulary file says that it lower-cases, drops white space and splits so.
_LOWER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Numbers(dict):
    """A number for each string, in the order in which they come."""

    def __missing__(self, text: str) -> int:
        self[text] = number = len(self)
        return number


class Chunks:
    """Numbers of chunks, and flat arrays with a run of values for each chunk.

    encode: distinct new chunks -> {name: (values of all, count of each)}.
    """

    def __init__(self, split: Callable[[str], list[str]] | None, encode: Callable[[list[str]], dict[str, tuple[np.ndarray, np.ndarray]]], forget: Callable[[], None] | None = None):
        self.split, self.encode, self.forget = split, encode, forget
        self._empty()

    def _empty(self) -> None:
        self.number = Numbers()
        self.size = 0
        self.flat: dict[str, np.ndarray] = {}
        self.start: dict[str, np.ndarray] = {}
        self.count: dict[str, np.ndarray] = {}

    def look(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of the texts in one row, and how many each text has. Null and empty texts have none."""
        parts = [self.split(t) if t else [] for t in texts]
        return self.numbered([c for p in parts for c in p]), np.fromiter(map(len, parts), np.int64, len(parts))

    def numbered(self, flat: list[str]) -> np.ndarray:
        if len(self.number) > MOST or self.size > MOST_BYTES:
            if self.forget:
                self.forget()
            self._empty()
        known = len(self.number)
        found = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        if len(self.number) > known:
            self._add(list(islice(self.number, known, None)))
        return found

    def _add(self, new: list[str]) -> None:
        self.size += sum(map(len, new))
        for name, (values, count) in self.encode(new).items():
            was = self.flat.get(name, values[:0])
            self.start[name] = np.concatenate([self.start.get(name, np.zeros(0, np.int64)), len(was) + np.cumsum(count) - count])
            self.count[name] = np.concatenate([self.count.get(name, np.zeros(0, np.int64)), count])
            self.flat[name] = np.concatenate([was, values])

    def row(self, name: str, chunks: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the texts in one row, and how many each text has."""
        count = self.count[name][chunks] if len(chunks) else np.zeros(0, np.int64)
        values = self.flat[name][spread(self.start[name][chunks], count)] if len(chunks) else np.zeros(0, np.int64)
        return values, sums(count, per_text)


class WordIds:
    """Ids of chunks without spaces by a lower-casing tokenizer with word ends.

    Chunks of Latin-1 letters, where lower case, normal form and classes are plain, are split here and merged many at a time;
    the library encodes all others, those with a special token's string, and all of a file that splits in another way.
    """

    def __init__(self, path: str):
        self.library = byte_tokenizer(path, special=True)
        made = json.loads(Path(path).read_text(encoding="utf-8"))
        kinds = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        split = [p.get("pattern", {}).get("Regex") for p in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.special = [t["content"] for t in made["added_tokens"]]
        self.parts = None
        if kinds == _LOWER and split[:1] == [_SPLIT]:
            merges = Merges(path)
            # the mark between chunks has no ids
            self.parts = Chunks(None, lambda new: {"ids": merges.ids([b"" if w == _MARK else w.encode() for w in new])})

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        simple = np.zeros(len(chunks), bool)
        if self.parts is not None:
            strange = lambda text: not _SIMPLE.fullmatch(text) or any(s in text for s in self.special)
            simple = ~np.fromiter(map(strange, chunks), bool, len(chunks)) if strange("\n".join(chunks)) else ~simple
        plain = chunks if simple.all() else [chunks[i] for i in np.flatnonzero(simple).tolist()]
        other = [chunks[i] for i in np.flatnonzero(~simple).tolist()]
        ids, count = flattened([e.ids for e in self.library.encode_batch_fast(other, add_special_tokens=False)] if other else [])
        if not plain:
            return ids, count
        found = self.parts.numbered(_PARTS.findall(_MARK.join(plain).lower()))
        mark = self.parts.number.get(_MARK, -1)
        marks = np.flatnonzero(found == mark)
        own, own_count = self.parts.row("ids", found, np.diff(np.concatenate([[0], marks, [len(found)]])))
        order = np.argsort(np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)]), kind="stable")
        start = np.concatenate([cut(own_count)[:-1], len(own) + cut(count)[:-1]])[order]
        return np.concatenate([own, ids])[spread(start, np.concatenate([own_count, count])[order])], np.concatenate([own_count, count])[order]


def sums(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Sums of values over runs of these lengths, which may be 0."""
    total = cut(values)
    ends = cut(runs)
    return total[ends[1:]] - total[ends[:-1]]


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int64, int(count.sum())), count


def runs_of_texts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows of about LOOK bytes; one row at least."""
    size = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, i = cut(size.astype(np.int64)), 0
    while i < len(column):
        j = max(int(np.searchsorted(ends, ends[i] + LOOK, "right")) - 1, i + 1)
        yield i, column.slice(i, j - i).to_pylist()
        i = j
