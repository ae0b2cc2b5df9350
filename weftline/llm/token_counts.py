"""Byte-level BPE token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch lie in one flat numpy array of symbols with sequence bounds.  In every round each
sequence finds its lowest-rank adjacent pair, and all its occurrences (left to right, not overlapping) merge at once;
sequences without a pair are done, and what is left of them is their token count.  Sequences of over ``LONG`` bytes merge
one by one in the same way, with an index from rank to places, so a round looks only at what it merges.

Nulls and edge cases: a null or empty text has 0 tokens; texts are never cut; a special token's string inside a text
counts as that one token (the longest, where several begin), as the library does by default; repeated rows are counted
each; other columns are ignored, whatever their names.  Tokenizers of other kinds are refused with a ValueError.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import plain, slices

#: Fixed value: the published split pattern of byte-level BPE; \s means Unicode's White_Space there.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
CACHE = 400_000
#: Longer pre-tokens merge one by one.
LONG = 256
_NONE = np.int64(1) << 40


@dataclass
class Merges:
    """Merge table as arrays: sorted pair keys with ranks and results; ids of the 256 bytes; special strings."""

    keys: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    bytes_: np.ndarray
    special: list[str]

    def __post_init__(self) -> None:
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the table, or -1."""
        keys = (left.astype(np.int64) << 20) | right
        out = np.full(len(keys), -1, np.int64)
        maybe = np.flatnonzero(self.bits[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        sure = self.keys[at] == keys[maybe]
        out[maybe[sure]] = at[sure]
        return out


def _byte_letters() -> list[str]:
    """The published mapping of bytes to printable letters: printable Latin-1 stays, the rest follow from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def load(path: str) -> Merges:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    own = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not own or spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        raise ValueError("only byte-level BPE with the published split pattern is supported")
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that look at their neighbours are not supported")
    vocab = spec["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
    results = np.array([vocab[a + b] for a, b in pairs], np.int64)
    by = np.argsort(keys)
    return Merges(keys[by], by.astype(np.int64), results[by], np.array([vocab[c] for c in _byte_letters()], np.int64), sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True))


def _merge_long(token: bytes, m: Merges) -> int:
    """Tokens that remain of one long byte string."""
    n = len(token)
    symbol = np.append(m.bytes_[np.frombuffer(token, np.uint8)], 0)
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # of the symbol at each place; n: none
    merge = np.append(m.find(symbol[:-2], symbol[1:-1]), [-1, -1])  # of the pair that begins at each place
    places: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def note(at: np.ndarray) -> None:
        """The pairs at these places wait under their ranks."""
        at = at[merge[at] >= 0]
        rank = m.ranks[merge[at]]
        by = np.argsort(rank, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(rank[by])) + 1):
            if len(part):
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(at[part])

    note(np.arange(n - 1))
    left = n
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[merge[at] >= 0]
        at = at[m.ranks[merge[at]] == r]  # the others have become part of something else
        if not len(at):
            continue
        new_run = np.append(True, after[at[:-1]] != at[1:])
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        symbol[at] = m.results[merge[at]]
        gone = after[at]
        merge[gone] = -1
        after[at] = after[gone]
        before[np.minimum(after[at], n)] = at
        left -= len(at)
        head = before[at]
        touched = np.unique(np.concatenate([at, head[head >= 0]]))
        inner = after[touched] < n
        merge[touched[~inner]] = -1
        touched = touched[inner]
        merge[touched] = m.find(symbol[touched], symbol[after[touched]])
        note(touched)
    return left


def merge_counts(tokens: list[bytes], m: Merges) -> np.ndarray:
    """Tokens that remain of each non-empty byte string."""
    if long := {k: _merge_long(t, m) for k, t in enumerate(tokens) if len(t) > LONG}:
        counts = np.zeros(len(tokens), np.int64)
        counts[list(long)] = list(long.values())
        short = [k for k in range(len(tokens)) if k not in long]
        counts[short] = merge_counts([tokens[k] for k in short], m) if short else 0
        return counts
    sizes = np.array([len(t) for t in tokens], np.int64)
    counts = sizes.copy()
    symbols = m.bytes_[np.frombuffer(b"".join(tokens), np.uint8)]
    owner = np.arange(len(tokens))
    while len(symbols):
        first = np.cumsum(sizes) - sizes
        at = m.find(symbols, np.append(symbols[1:], 0))
        at[first + sizes - 1] = -1
        rank = np.where(at >= 0, m.ranks[at], _NONE)
        least = np.minimum.reduceat(rank, first)
        alive = least < _NONE
        chosen = (rank == np.repeat(least, sizes)) & (rank < _NONE)
        place = np.flatnonzero(chosen)
        # neighbours in a run overlap (a pair of equal symbols): every second one merges, from the left
        new_run = np.ones(len(place), bool)
        new_run[1:] = np.diff(place) != 1
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(place)), 0))
        place = place[(np.arange(len(place)) - run_start) % 2 == 0]
        symbols[place] = m.results[at[place]]
        gone = np.zeros(len(symbols), bool)
        gone[place + 1] = True
        sizes = sizes - np.add.reduceat(gone, first, dtype=np.int64)
        counts[owner] = sizes
        keep = ~gone & np.repeat(alive, np.diff(np.append(first, len(symbols))))
        symbols, sizes, owner = symbols[keep], sizes[alive], owner[alive]
    return counts


class Counter:
    """Token counts of texts, with a bounded cache of pre-token counts."""

    def __init__(self, m: Merges, cache: int = CACHE):
        self.m, self.most, self.known = m, cache, {}
        self.pieces = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in m.special)) if m.special else None

    def __call__(self, texts: list[str]) -> list[int]:
        found, extra = [], [0] * len(texts)
        for k, text in enumerate(texts):
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                extra[k] = len(parts) - 1
                found.append([p for part in parts for p in self.pieces(part)])
            else:
                found.append(self.pieces(text))
        new = set().union(*found).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known = {p: self.known[p] for p in set().union(*found) if p in self.known}
        if new := list(new):
            self.known.update(zip(new, merge_counts([p.encode() for p in new], self.m).tolist(), strict=True))
        get = self.known.__getitem__
        return [x + sum(map(get, pieces)) for x, pieces in zip(extra, found, strict=True)]


_COUNTERS: dict[int, Counter] = {}


def _counter(m: Merges) -> Counter:
    """The worker process's counter, which keeps what it has counted from task to task."""
    if id(m) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[id(m)] = Counter(m)
    return _COUNTERS[id(m)]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit). path: a byte-level BPE tokenizer's JSON file, read by the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(load(path))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent.value)
        for batch in batches:
            texts = plain(batch.column("text"))
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([len(t.encode()) for t in part], pa.int64()), pa.array(counter(part), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
