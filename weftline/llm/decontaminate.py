"""Benchmark decontamination by a prefix-filtered set join.

An item window is ``window`` consecutive item words (a shorter item is one window).  Each window is a set of short
shingles; as a hit needs all of them, one shingle is a sufficient prefix, and the window's rarest one over the whole
corpus gives the fewest candidates.  Documents probe with their shingles; a candidate start must leave the window
inside the document (length and position bound), and then all its words are compared.

The benchmark is the stated query set: it is read in blocks of at most ``BLOCK_BYTES`` of text, and every block meets
every document.  A block is a few flat arrays, about ten times its text; the driver holds one at a time, and each Python
worker holds one, in a chain of as many workers a task as there are blocks.

Nulls and edge cases: a null or wordless text has no words and no hits; a null item id counts as the empty string; a
repeated item id is reported once; repeated document rows are each judged; an empty benchmark hits nothing; ``contamination``
ignores other columns, ``clean`` keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import mapped, plain, slices
from weftline.llm.words import ALNUM, cover, mix, ngrams, split, whole

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8 << 20
_BITS = 20


class Block:
    """Windows of some items as arrays: the items' words, places and sizes of the distinct windows, their owners, and (after ``order``) a prefix shingle with its offset."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, shingle: int = SHINGLE):
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        w = split(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)
        self.data, self.starts, self.ends, self.hashes = w.data, w.starts.astype(np.int32), w.ends.astype(np.int32), w.hashes
        n = np.diff(w.rows)
        size = np.minimum(window, n)
        times = np.where(n > 0, n - size + 1, 0)
        item = np.repeat(np.arange(len(n)), times)
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + w.rows[:-1][item]
        owner = np.array([number[i] for i, _ in items], np.int64)[item] if len(items) else item
        sizes = size[item]
        one, two = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
        for k in np.unique(sizes).tolist():
            of = sizes == k
            one[of], two[of] = ngrams(w.hashes, k)[place[of]], ngrams(mix(w.hashes), k)[place[of]]
        by = np.lexsort((owner, two, one, sizes))
        new = np.append(True, (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1]) | (sizes[by][1:] != sizes[by][:-1]))[: len(by)]
        own = new | np.append(True, owner[by][1:] != owner[by][:-1])[: len(by)]
        #: Of each distinct window: where it stands first among the items' words, its size, and its items (``owners[at:next at]``).
        self.places, self.sizes = place[by][new].astype(np.int32), sizes[by][new].astype(np.int16)
        self.owners = owner[by][own].astype(np.int32)
        self.owner_at = np.append(np.flatnonzero(new[own]), len(self.owners)).astype(np.int32)
        self.width = np.minimum(self.sizes, shingle)
        #: For each shingle width: the distinct shingle hashes, ascending.
        self.keys = {}
        for k in np.unique(self.width).tolist():
            of = self.width == k
            inside = cover(self.places[of], self.sizes[of] - k + 1, len(w.hashes))[: max(len(w.hashes) - k + 1, 0)]
            self.keys[k] = np.unique(ngrams(w.hashes, k)[inside])

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle as its prefix. counts: by width, of ``keys``."""
        self.prefix = {}
        for n, keys in self.keys.items():
            of = np.flatnonzero(self.width == n)
            grams = ngrams(self.hashes, n)
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            times = np.where(keys[at] == grams, counts[n][at], np.iinfo(np.int64).max)
            places, last = self.places[of], self.sizes[of] - n
            best, offset = times[places], np.zeros(len(of), np.int64)
            for j in range(1, int(last.max(initial=0)) + 1):
                here = np.where(j <= last, times[np.minimum(places + j, len(times) - 1)], np.iinfo(np.int64).max)
                less = here < best
                best[less], offset[less] = here[less], j
            first = grams[places + offset]
            by = np.argsort(first, kind="stable")
            distinct, start = np.unique(first[by], return_index=True)
            self.prefix[n] = (distinct, bitmap(distinct), np.append(start, len(by)).astype(np.int32), of[by].astype(np.int32), offset[by].astype(np.int16))
        self.keys = dict.fromkeys(self.keys)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def bitmap(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _BITS, bool)
    out[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return out


def found(grams: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``grams`` that are among ``keys``, and which key."""
    maybe = np.flatnonzero(bits[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
    which = np.minimum(np.searchsorted(keys, grams[maybe]), len(keys) - 1)
    sure = keys[which] == grams[maybe]
    return maybe[sure], which[sure]


def _counter(block, column: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        totals = {n: np.zeros(len(k), np.int64) for n, k in b.keys.items()}
        bits = {n: bitmap(k) for n, k in b.keys.items()}
        for batch in batches:
            texts = plain(batch.column(column))
            for lo, hi in slices(texts):
                w = split(texts.slice(lo, hi - lo), ALNUM, lower=True)
                for n, keys in b.keys.items():
                    at, which = found(ngrams(w.hashes, n), keys, bits[n])
                    ok = whole(w.rows, n)[at]
                    totals[n] += np.bincount(which[ok], minlength=len(keys))
        for n, t in totals.items():
            k = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n), pa.int32()), pa.array(k, pa.int64()), pa.array(t[k], pa.int64())], ["width", "key", "n"])

    return count


def probe(w, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(start word, window) of every occurrence of the block's windows in the words ``w``."""
    starts, windows = [], []
    row_of = w.row_of()
    for n, (keys, bits, at, of, offset) in b.prefix.items():
        place, which = found(ngrams(w.hashes, n), keys, bits)
        times = at[which + 1] - at[which]
        place = np.repeat(place, times)
        k = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(at[which], times)
        window, start = of[k], place - offset[k]
        ok = start >= w.rows[row_of[place]]
        start, window, place = start[ok], window[ok], place[ok]
        ok = start + b.sizes[window] <= w.rows[row_of[place] + 1]
        start, window = start[ok], window[ok]
        if not len(start):
            continue
        within = np.arange(int(b.sizes[window].max()))[None, :]
        same = w.hashes[np.minimum(start[:, None] + within, len(w.hashes) - 1)] == b.hashes[np.minimum(b.places[window][:, None] + within, len(b.hashes) - 1)]
        ok = (same | (within >= b.sizes[window][:, None])).all(1)
        starts.append(start[ok])
        windows.append(window[ok])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, window = np.concatenate(starts), np.concatenate(windows)
    exact = np.array([all(w.text(s + j) == b.text(p + j) for j in range(n)) for s, p, n in zip(start.tolist(), b.places[window].tolist(), b.sizes[window].tolist(), strict=True)], bool)
    return start[exact], window[exact]


def _marker(block, column: str):
    """Adds the block's hits to the columns ``hits`` (start, length pairs) and ``items``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            texts = plain(batch.column(column))
            hits, items, n_words = batch.column("hits").to_pylist(), batch.column("items").to_pylist(), np.zeros(len(texts), np.int64)
            for lo, hi in slices(texts):
                w = split(texts.slice(lo, hi - lo), ALNUM, lower=True)
                n_words[lo:hi] = np.diff(w.rows)
                start, window = probe(w, b)
                row = np.searchsorted(w.rows, start, "right") - 1
                for r in np.unique(row).tolist():
                    of = row == r
                    hits[lo + r] = (hits[lo + r] or []) + np.stack([start[of] - w.rows[r], b.sizes[window[of]]], 1).ravel().tolist()
                    own = np.unique(np.concatenate([b.owners[b.owner_at[k] : b.owner_at[k + 1]] for k in np.unique(window[of]).tolist()]))
                    items[lo + r] = (items[lo + r] or []) + [b.ids[k] for k in own.tolist()]
            columns = {n: batch.column(n) for n in batch.schema.names}  # the names are this module's own
            columns |= {"hits": pa.array(hits, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(n_words)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return mark


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words = batch.column("n_words").to_pylist()
        n_hit, n_items, digest = [], [], []
        for n, hits, items in zip(n_words, batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
            pairs = np.array(hits or [], np.int64).reshape(-1, 2)
            n_hit.append(int(cover(pairs[:, 0], pairs[:, 1], n).sum()) if len(pairs) else 0)
            own = sorted(set(items or []))
            n_items.append(len(own))
            digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
        keep = {n: batch.column(n) for n in batch.schema.names if n not in ("hits", "items", "n_words")}
        out = keep | {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array(n_items, pa.int64()), "items_sha256": pa.array(digest, pa.string())}
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    held, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text")).where(F.col("text").isNotNull()).toLocalIterator():
        if held and size + len(row[1]) > most:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield held


def _ordered(texts: DataFrame, benchmark: DataFrame, most: int) -> Iterator:
    """The benchmark's blocks as broadcasts, each with its prefixes chosen by counts over all texts; one empty block if there is none."""
    context = texts.sparkSession.sparkContext
    empty = True
    for items in blocks(benchmark, most):
        empty = False
        yield _counted(context, texts, Block(items))
    if empty:
        yield _counted(context, texts, Block([]))


def _counted(context, texts: DataFrame, block: Block):
    counts = {n: np.zeros(len(k), np.int64) for n, k in block.keys.items()}
    if counts:
        sent = context.broadcast(block)
        for width, key, n in texts.mapInArrow(_counter(sent, "text"), "width int, key bigint, n bigint").groupBy("width", "key").agg(F.sum("n").alias("n")).collect():
            counts[width][key] = n
        sent.destroy()
    block.order(counts)
    return context.broadcast(block)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BLOCK_BYTES, keep_hits: bool = False) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    keep_hits: instead return id, n_words, ``hits`` (flat start, length pairs in words) and ``items``.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    out = source.select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("hits"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("n_words"))
    schema = f"doc_id {id_type}, text string, hits array<bigint>, items array<string>, n_words bigint"
    for block in _ordered(source.select("text"), benchmark, most):
        out = out.mapInArrow(_marker(block, "text"), schema)
    if keep_hits:
        return out.select("doc_id", "n_words", "hits", "items")
    return out.drop("text").mapInArrow(_finish, f"doc_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string").withColumn("contaminated", F.col("n_hit") > 0)


def _filter(block, at: int, names: list[str]):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(at))
            clean_ = np.ones(len(texts), bool)
            for lo, hi in slices(texts):
                w = split(texts.slice(lo, hi - lo), ALNUM, lower=True)
                start, _ = probe(w, block.value)
                clean_[lo + np.searchsorted(w.rows, start, "right") - 1] = False
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(clean_)) for c in batch.columns], names)

    return keep


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item window occurs."""
    out = docs
    for block in _ordered(docs.select(F.col(text_col).cast("string").alias("text")), benchmark, most):
        out = mapped(out, _filter(block, out.columns.index(text_col), out.columns), docs.schema)
    return out
