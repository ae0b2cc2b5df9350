"""Ranked lexical search as a blocked sparse matrix product.

The items are a sparse matrix of term multiplicities (items x terms), the documents one of 64-bit integer impacts
(terms x documents); a score is a cell of their product.  The texts are read once per block of items: every slice of
documents becomes a block of postings of the items' terms (terms in order, their documents and occurrences), written to
the shared folder together with its counts.  From those come the number of documents, their length and each term's
document frequency.  Then every block of postings gets its impacts, and the rows of the product are built by Gustavson's
rule: an item's row is the sum of its terms' posting rows, each times the term's multiplicity, merged in numpy.  A task
keeps the best rows of each item over all its blocks; tasks' best rows meet in groups, then by item.

The items are the stated query set: a block of them has at most ``BLOCK_WORDS`` words, so what is sent out is bounded;
blocks follow each other, and each is released before the next.  Terms are compared by 64-bit hashes.

Nulls and edge cases: a null or wordless text has no terms (it isn't counted as a document, and as an item it finds
nothing); equal scores are ordered by ascending document id, null ids last; repeated item rows are ranked each; repeated
document rows each take a rank; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import freed, integral, plain, slices, staged
from weftline.llm.words import ALNUM, split

TOP = 20
#: Words of the items of one block.
BLOCK_WORDS = 2_000_000
#: Tasks whose best rows meet first.
GROUP = 64
_BITS = 20


@dataclass
class Items:
    """Rows of a sparse matrix: of item ``ids[i]``, terms ``terms[at[i]:at[i+1]]`` with their multiplicities; ``keys`` are the terms' hashes, ascending."""

    ids: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    times: np.ndarray
    keys: np.ndarray

    def __post_init__(self) -> None:
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    @classmethod
    def of(cls, rows: list[tuple[int, np.ndarray]]) -> Items:
        """rows: (item, hashes of its words)."""
        sizes = np.array([len(h) for _, h in rows], np.int64)
        hashes = np.concatenate([h for _, h in rows])
        keys, which = np.unique(hashes, return_inverse=True)
        cells, times = np.unique(np.repeat(np.arange(len(rows)), sizes) * len(keys) + which, return_counts=True)
        return cls(np.array([k for k, _ in rows], np.int64), np.searchsorted(cells // len(keys), np.arange(len(rows) + 1)), (cells % len(keys)).astype(np.int32), times.astype(np.int64), keys)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of ``hashes`` that are terms, which term)."""
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        sure = self.keys[which] == hashes[maybe]
        return maybe[sure], which[sure]


def _item_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, items = plain(batch.column("text")), batch.column("item")
        for lo, hi in slices(texts):
            w = split(texts.slice(lo, hi - lo), ALNUM, lower=True)
            data = [w.hashes[a:b].tobytes() for a, b in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([items.slice(lo, hi - lo), pa.array(data, pa.binary())], ["item", "words"])


def _blocks(items: DataFrame, most: int) -> Iterator[Items]:
    held, size = [], 0
    for item, words in items.mapInArrow(_item_words, "item bigint, words binary").toLocalIterator():
        hashes = np.frombuffer(words, np.uint64)
        if held and size + len(hashes) > most:
            yield Items.of(held)
            held, size = [], 0
        if len(hashes):
            held.append((item, hashes))
            size += len(hashes)
    if held:
        yield Items.of(held)


_POSTINGS = "n_docs bigint, n_words bigint, ids binary, known binary, sizes binary, terms binary, at binary, docs binary, times binary"


def _poster(sent):
    """Blocks of postings: for each term that occurs its documents, ascending, and its occurrences in each."""

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = plain(batch.column("text")), batch.column("doc_id")
            for lo, hi in slices(texts):
                w = split(texts.slice(lo, hi - lo), ALNUM, lower=True)
                sizes = np.diff(w.rows)
                place, term = sent.value.find(w.hashes)
                cells, times = np.unique(term * (hi - lo) + np.searchsorted(w.rows, place, "right") - 1, return_counts=True)
                terms, at = np.unique(cells // (hi - lo), return_index=True)
                part = ids.slice(lo, hi - lo)
                known = part.is_valid().to_numpy(zero_copy_only=False)
                arrays = [part.fill_null(0).to_numpy().astype(np.int64), known, sizes.astype(np.int64), terms.astype(np.int32), np.append(at, len(cells)).astype(np.int32), (cells % (hi - lo)).astype(np.int32), times.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], [c.split()[0] for c in _POSTINGS.split(", ")])

    return post


def _frequencies(n_terms: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, at in zip(batch.column("terms"), batch.column("at"), strict=True):
                total[np.frombuffer(terms.as_buffer(), np.int32)] += np.diff(np.frombuffer(at.as_buffer(), np.int32))
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(total[terms], pa.int64())], ["term", "df"])

    return count


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))) of each document frequency, in doubles."""
    known, which = np.unique(df, return_inverse=True)
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in known.tolist()], np.int64)[which]


def impacts(weight: np.ndarray, times: np.ndarray, sizes: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """weight * ((10^9 tf) div (1000 tf + 12 m)) of each posting; m = 75 + (25 n N) div L of its document's size n."""
    if 25 * int(sizes.max(initial=0)) * n_docs < 1 << 62:
        m = 75 + (25 * sizes * n_docs) // n_words
    else:
        m = np.array([75 + 25 * s * n_docs // n_words for s in sizes.tolist()], np.int64)
    return weight * ((1_000_000_000 * times) // (1000 * times + 12 * m))


class Best:
    """The best documents of each item so far."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.rows = [(np.empty(0, np.int64),) * 2 + (np.empty(0, bool),) for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)  # a document below it can't enter

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        at = np.flatnonzero(score >= self.least[item])
        if not len(at):
            return
        if len(at) > 4 * self.top:
            bound = np.partition(score[at], len(at) - self.top)[len(at) - self.top]
            at = at[score[at] >= bound]
        s, d, k = (np.concatenate(x) for x in zip(self.rows[item], (score[at], ids[at], known[at]), strict=True))
        by = np.lexsort((d, ~k, -s))[: self.top]
        self.rows[item] = s[by], d[by], k[by]
        if len(by) == self.top:
            self.least[item] = s[by[-1]]


def product(items: Items, terms: np.ndarray, at: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """(item, its scores over the block's documents) of each item with a term in the block."""
    where = np.full(len(items.keys), -1, np.int64)
    where[terms] = np.arange(len(terms))
    rows = where[items.terms]
    starts, ends = at.tolist(), at[1:].tolist()
    for i in range(len(items.ids)):
        lo, hi = items.at[i], items.at[i + 1]
        here = rows[lo:hi]
        held = here >= 0
        if not held.any():
            continue
        score = np.zeros(n_docs, np.int64)
        for r, times in zip(here[held].tolist(), items.times[lo:hi][held].tolist(), strict=True):
            a, b = starts[r], ends[r]
            score[docs[a:b]] += impact[a:b] * times  # a document is once in a posting row
        yield i, score


def _searcher(sent, n_docs: int, n_words: int, top: int):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value
        best = Best(len(items.ids), top)
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)  # noqa: B023, E731
                terms, at, docs, times, sizes = get("terms", np.int32), get("at", np.int32), get("docs", np.int32), get("times", np.int32), get("sizes", np.int64)
                if not len(terms):
                    continue
                impact = impacts(np.repeat(weight[terms], np.diff(at)), times.astype(np.int64), sizes[docs], n_docs, n_words)
                ids, known = get("ids", np.int64), get("known", bool)
                for i, score in product(items, terms, at, docs, impact, len(ids)):
                    best.add(i, score, ids, known)
        sizes = [len(s) for s, _, _ in best.rows]
        score, ids, known = (np.concatenate([np.empty(0, kind), *[r[c] for r in best.rows]]) for c, kind in enumerate((np.int64, np.int64, bool)))
        group = TaskContext.get().partitionId() // GROUP
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(items.ids, sizes)), pa.array(np.full(len(ids), group, np.int32)), pa.array(ids, pa.int64(), mask=~known), pa.array(score, pa.int64())], ["item", "part", "doc_id", "score"])

    return search


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per item its ``top`` highest-scoring documents with a score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    integral(docs, id_col)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = staged(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text")), "items")
    found = []
    for block in _blocks(asked.select("item", "text"), block_words):
        sent = spark.sparkContext.broadcast(block)
        postings = staged(source.mapInArrow(_poster(sent), _POSTINGS), "postings")
        sent.destroy()
        n_docs, n_words = postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
        counted = postings.select("terms", "at").mapInArrow(_frequencies(len(block.keys)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(block.keys), np.int64)  # at most BLOCK_WORDS terms
        df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        sent = spark.sparkContext.broadcast((block, weights(df, n_docs)))
        rows = postings.drop("n_docs", "n_words").mapInArrow(_searcher(sent, n_docs, n_words, top), "item bigint, part int, doc_id bigint, score bigint")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        found.append(staged(best.select("item", "rank", "doc_id", "score"), "best"))
        sent.destroy()
        freed(postings)
    if not found:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    ranked = found[0]
    for more in found[1:]:
        ranked = ranked.union(more)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
