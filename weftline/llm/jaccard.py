"""N-gram Jaccard join with several global token orders, and its connected components.

A document's set is its distinct ``SHINGLE``-word shingles (64-bit hashes).  Two documents link when their Jaccard
similarity is at least ``PERCENT`` / 100, in integers.  Steps:

1. Equal sets form a class; its smallest id stands for it from here on.
2. A fixed-size sketch of shingle counts over all documents ranks shingles in levels, from rare to frequent.  A global
   order sorts by level, then by a hash of its own, so there are several orders and frequent passages come last in each.
3. Under an order, linked sets share a token of their prefixes.  Postings of the first order's prefixes meet by token;
   size and position bounds apply to each meeting.
4. The further orders' filters are intersected with it before any text is fetched: each document in question has its
   prefixes under them (32-bit hashes) and a parity sketch of its set (512 bits; where two sketches differ in d bits the
   sets differ in d shingles at least), and a pair passes only if it shares prefix tokens under every order and its
   sketches are close enough.  Then the whole sets of what passed are compared.
5. Of a token's documents, each is first paired with the first one only (a star).  Verified links give components; only
   documents of different components that share a prefix token are paired further (a chain, then all that is left, with
   sketches compared inside the join), so a group of copies, however large, costs a row per copy and no pair of different
   texts is lost.

Hot tokens: equal sets are reduced to one before they leave a task; leads and spans of tokens are partial aggregates
written to a table, so that AQE can split the joins with them.  Links, components and classes stay distributed
(alternating large and small stars over written tables).

The operator yields components: pairs inside a component that is already known are not verified.

Nulls and edge cases: a null text, or one without words, has no shingles and no links; one of fewer than SHINGLE words
has its whole sequence as one shingle; ids are integers (others raise TypeError); a null id counts as smaller than all
others; rows that share an id count as one document in links (their texts' links unite); an empty table gives no rows;
texts are never cut; only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import SLICE_BYTES, freed, integral, plain, slices, staged
from weftline.llm.words import SPACED, Words, by_row, mix, ngrams, split, whole

SHINGLE = 5
PERCENT = 75
ORDERS = 3
#: Partners of a document that one task compares with it.
PART = 64
#: 64-bit words of a parity sketch.
SKETCH = 8
_FIRST_ID = -(1 << 63)
#: Bounds of the sketch's number of counters, and text bytes per counter between them.
SLOTS = (1 << 14, 1 << 23)
BYTES_PER_SLOT = 512
_BLOCK = 1 << 14


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of each distinct shingle, by row and hash."""
    sizes = np.diff(w.rows)
    ok = whole(w.rows, n)
    grams = [ngrams(w.hashes, n)[ok]]
    rows = [w.row_of()[: len(ok)][ok]]
    for k in range(1, n):
        short = np.flatnonzero(sizes == k)
        if len(short):
            grams.append(ngrams(w.hashes, k)[w.rows[short]])
            rows.append(short)
    grams, rows = np.concatenate(grams), np.concatenate(rows)
    by = by_row(rows, grams, len(sizes))
    grams, rows = grams[by], rows[by]
    new = np.append(True, (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1]))[: len(grams)]
    return rows[new], grams[new]


def words_of(texts: pa.Array) -> Words:
    return split(texts, SPACED, lower=True)


def _set_hash(grams: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of hash of each row's set, whatever its order; grams by row, n: sizes."""
    total = np.append(np.uint64(0), np.cumsum(mix(grams ^ np.uint64(salt)), dtype=np.uint64))
    ends = np.cumsum(n)
    return (total[ends] - total[ends - n]).view(np.int64)


_SALTS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: id, set size, 128 bits of set hash."""
    for batch in batches:
        texts = plain(batch.column("text"))
        for lo, hi in slices(texts):
            rows, grams = shingles(words_of(texts.slice(lo, hi - lo)))
            n = np.bincount(rows, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("o").slice(lo, hi - lo), pa.array(n, pa.int64()), *[pa.array(_set_hash(grams, n, x)) for x in _SALTS]], ["o", "n", "k1", "k2"])


def _sketcher(slots: int):
    shift = np.uint64(64 - slots.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(slots, np.uint32)
        for batch in batches:
            texts = plain(batch.column("text"))
            for lo, hi in slices(texts):
                _, grams = shingles(words_of(texts.slice(lo, hi - lo)))
                at, n = np.unique((grams >> shift).astype(np.int64), return_counts=True)
                totals[at] += n.astype(np.uint32)
        blocks = totals.reshape(-1, min(_BLOCK, slots))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                counts = np.frombuffer(zlib.decompress(data.as_py()), np.uint32)
                sums[block] = sums[block] + counts if block in sums else counts.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "counts"])

    return count, add


class Order:
    """Levels of the sketch's slots (uint8) and the hashes that break ties."""

    def __init__(self, counts: np.ndarray):
        self.shift = 64 - len(counts).bit_length() + 1
        mean = float(counts.mean()) if len(counts) else 0.0
        excess = np.maximum(counts - mean, 0) / (4 * mean**0.5 + 1)
        self.levels = np.minimum(np.floor(4 * np.log2(1 + excess)), 255).astype(np.uint8)

    def keys(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Sort keys of shingles in order k: 8 bits of level, 56 of hash."""
        level = self.levels[(grams >> np.uint64(self.shift)).astype(np.int64)].astype(np.uint64)
        return (level << np.uint64(56)) | (mix(grams ^ np.uint64(((k + 1) * 0x9E3779B97F4A7C15) % (1 << 64))) >> np.uint64(8))


def prefix_len(n, percent: int = PERCENT):
    """Tokens of a set of n that a partner at least as similar must share one of."""
    return n - (n * percent + 99) // 100 + 1


def _poster(order, percent: int):
    """(token, id, set hash, size << 32 | position) of the first order's prefixes; of equal sets in a slice the smallest id's."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = plain(batch.column("text")), np.asarray(batch.column("o"))
            for lo, hi in slices(texts):
                rows, grams = shingles(words_of(texts.slice(lo, hi - lo)))
                n = np.bincount(rows, minlength=hi - lo)
                k = _set_hash(grams, n, _SALTS[0])
                by = np.lexsort((ids[lo:hi], n, k))
                only = np.zeros(hi - lo, bool)
                only[by] = np.append(True, (k[by][1:] != k[by][:-1]) | (n[by][1:] != n[by][:-1]))
                rows, grams = rows[only[rows]], grams[only[rows]]
                position, by = _positions(rows, order.value.keys(grams, 0), hi - lo)
                keep = position < prefix_len(n, percent)[rows]
                r = rows[keep]
                yield pa.RecordBatch.from_arrays([pa.array(grams[by][keep].view(np.int64)), pa.array(ids[lo + r]), pa.array(k[r]), pa.array((n[r] << 32) | position[keep], pa.int64())], ["t", "o", "k", "np"])

    return post


def _positions(rows: np.ndarray, keys: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens sorted by row and key: the position of each in its row, and the sorting."""
    by = by_row(rows, keys, n_rows)
    n = np.bincount(rows, minlength=n_rows)
    return np.arange(len(rows)) - (np.cumsum(n) - n)[rows], by


def _unpacked(packed: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of packed texts, in runs of at most about ``SLICE_BYTES`` of unpacked text (a longer one stands alone)."""
    first, held, size = 0, [], 0
    for k, z in enumerate(packed):
        text = zlib.decompress(z.as_buffer())
        if held and size + len(text) > SLICE_BYTES:
            yield first, pa.array(held, pa.string())
            first, held, size = k, [], 0
        held.append(text.decode())
        size += len(text)
    if held:
        yield first, pa.array(held, pa.string())


def _marker(order, percent: int):
    """Of each packed text: id, set size, parity sketch, and 32-bit hashes of its prefixes under the further orders."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("o"))
            for lo, texts in _unpacked(batch.column("z")):
                m = len(texts)
                hi = lo + m
                rows, grams = shingles(words_of(texts))
                n = np.bincount(rows, minlength=m)
                bit = grams >> np.uint64(64 - (64 * SKETCH).bit_length() + 1)
                odd = np.bincount(rows * 64 * SKETCH + bit.astype(np.int64), minlength=m * 64 * SKETCH) & 1
                sketch = np.packbits(odd.astype(bool).reshape(m, -1), axis=1).view(np.int64)
                heads = []
                for k in range(1, ORDERS):
                    keys = order.value.keys(grams, k)
                    position, by = _positions(rows, keys, m)
                    keep = position < prefix_len(n, percent)[rows]
                    ends = np.append(0, np.cumsum(np.bincount(rows[keep], minlength=m)))
                    heads.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[by][keep].astype(np.uint32).view(np.int32))))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(n, pa.int64()), *[pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(SKETCH)], *heads], _MARKS)

    return mark


_MARKS = ["o", "n", *[f"m{j}" for j in range(SKETCH)], *[f"h{k}" for k in range(1, ORDERS)]]
_MARKS_SCHEMA = ", ".join(["o bigint", "n bigint", *[f"m{j} bigint" for j in range(SKETCH)], *[f"h{k} array<int>" for k in range(1, ORDERS)]])


def close(a: str, b: str, percent: int = PERCENT) -> Column:
    """Whether the parity sketches of rows a and b let their sets be similar enough: sets that differ in d shingles differ in d bits at most."""
    bits = sum((F.bit_count(F.col(f"{a}.m{j}").bitwiseXOR(F.col(f"{b}.m{j}"))) for j in range(SKETCH)), F.lit(0))
    return bits * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def share_prefixes(a: str, b: str) -> Column:
    """Whether rows a and b share a prefix token under every further order."""
    out = F.lit(True)
    for k in range(1, ORDERS):
        out &= F.arrays_overlap(f"{a}.h{k}", f"{b}.h{k}")
    return out


def may_link(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Size and position bounds of two postings (``np`` columns) that meet at a token."""
    na, nb = F.shiftright(a, 32), F.shiftright(b, 32)
    pa_, pb = a.bitwiseAND(F.lit(0xFFFFFFFF)), b.bitwiseAND(F.lit(0xFFFFFFFF))
    least = F.least(na, nb)
    # overlap >= percent / (100 + percent) * (na + nb)
    return (least * 100 >= F.greatest(na, nb) * percent) & (F.least(na - pa_, nb - pb) * (100 + percent) >= (na + nb) * percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test of two shingle sets."""
    if not len(a) or not len(b):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("o"), pa.array([zlib.compress((t or "").encode(), 1) for t in batch.column("text").to_pylist()], pa.binary())], ["o", "z"])


def _verifier(percent: int):
    """Rows sorted by the pair's head, (a, b, z); the head's own texts stand before its partners'."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(packed: pa.Array) -> Iterator[np.ndarray]:
            for _, texts in _unpacked(packed):
                rows, grams = shingles(words_of(texts))
                yield from np.split(grams, np.searchsorted(rows, np.arange(1, len(texts))))

        head, heads, opening = None, [], False
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = []
            for x, y, s in zip(a, b, sets(batch.column("z")), strict=True):
                if x == y:
                    heads = [*heads, s] if opening and x == head else [s]
                    head, opening = x, True
                else:
                    opening = False
                    if any(linked(h, s, percent) for h in heads):
                        found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    return verify


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(v, root) of every vertex that has links; root: the smallest vertex it reaches. Alternates large and small stars."""
    edges = staged(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct(), name)
    last = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            return edges.select("v", F.col("u").alias("root"))
        last = mark
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v > u")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).where("v > u").distinct()
        edges = staged(small, name)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    spark = docs.sparkSession
    id_type = integral(docs, id_col)
    source = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_FIRST_ID).cast("bigint")).alias("o"), F.col(text_col).cast("string").alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = SLOTS[0]
    while slots < SLOTS[1] and slots * BYTES_PER_SLOT < total:
        slots *= 2
    count, add = _sketcher(slots)
    blocks = source.select("text").mapInArrow(count, "block int, counts binary").repartition(max(1, min(64, slots // _BLOCK)), "block").mapInArrow(add, "block int, counts binary").collect()
    counts = np.zeros(slots, np.uint64)
    for block, data in blocks:
        part = np.frombuffer(data, np.uint64)
        counts[block * len(part) : (block + 1) * len(part)] = part
    order = spark.sparkContext.broadcast(Order(counts))

    sets = staged(source.mapInArrow(_sets, "o bigint, n bigint, k1 bigint, k2 bigint"), "sets")
    filled = sets.where("n > 0")
    classes = staged(filled.groupBy("k1", "k2", "n").agg(F.min("o").alias("rep"), F.max("o").alias("last")).where("last > rep").drop("last"), "classes")
    copies = staged(sets.join(classes, ["k1", "k2", "n"]).where("o > rep").select("o", F.col("k1").alias("k")).distinct(), "copies")
    # the classes of an id that has several texts are linked by it
    twins = filled.groupBy("o").agg(F.min(F.struct("k1", "k2", "n")).alias("a"), F.max(F.struct("k1", "k2", "n")).alias("b")).where("a != b").select("o")
    of_twins = filled.join(staged(twins, "twins"), "o", "left_semi").join(classes, ["k1", "k2", "n"], "left").select("o", F.coalesce("rep", "o").alias("rep"))
    same_id = of_twins.select(F.col("o").alias("a"), F.col("rep").alias("b")).where("a != b")

    posted = staged(source.mapInArrow(_poster(order, percent), "t bigint, o bigint, k bigint, np bigint"), "posted")
    # most tokens are of one set; only those of several are worth more than two hashes in a shuffle
    recurring = staged(posted.groupBy("t").agg(F.min("k").alias("k"), F.max("k").alias("k_last")).where("k != k_last").select("t"), "recurring")
    shared = staged(posted.join(recurring, "t").join(copies, ["o", "k"], "left_anti").select("t", "o", "np"), "shared")
    freed(posted, recurring, copies)
    leads = staged(shared.groupBy("t").agg(F.min("o").alias("lo"), F.min_by("np", "o").alias("lnp")), "leads")
    postings = staged(shared.join(leads, "t").select("t", "o", "np", "lo", "lnp"), "postings")
    freed(shared, leads)
    active = postings.select("o").distinct()
    packed = staged(source.mapInArrow(_pack, "o bigint, z binary").join(active, "o", "left_semi"), "texts")
    marks = staged(packed.mapInArrow(_marker(order, percent), _MARKS_SCHEMA), "marks")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among (a, b) pairs. What passes every order's filter goes to the heads' partners in parts of about PART, each with its own copy of the head's text before theirs."""
        both = pairs.alias("p").join(marks.alias("x"), F.col("p.a") == F.col("x.o")).join(marks.alias("y"), F.col("p.b") == F.col("y.o"))
        passed = staged(both.where(close("x", "y", percent) & share_prefixes("x", "y")).select("a", "b"), "pairs")
        parts = passed.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("m"))
        dealt = passed.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("m")).alias("s"), "b")
        heads = dealt.select("a", "s").distinct().select("a", "s", F.col("a").alias("b"))
        rows = heads.union(dealt).join(packed.withColumnRenamed("o", "b"), "b")
        return rows.repartition("a", "s").sortWithinPartitions("a", "s", F.col("a") != F.col("b")).select("a", "b", "z").mapInArrow(_verifier(percent), "a bigint, b bigint")

    def ordered(x: Column, y: Column) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    stars = staged(postings.where((F.col("o") != F.col("lo")) & may_link(F.col("lnp"), F.col("np"), percent)).select(*ordered(F.col("lo"), F.col("o"))).distinct(), "stars")
    links = staged(verified(stars).union(same_id), "links")
    roots = components(links)

    def apart(roots: DataFrame) -> DataFrame:
        """Postings of tokens that still meet in more than one component, with the component of each."""
        marked = postings.select("t", "o", "np").join(roots.withColumnRenamed("v", "o"), "o", "left").withColumn("c", F.coalesce("root", "o")).drop("root")
        spans = staged(marked.groupBy("t").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("t"), "spans")
        return marked.join(spans, "t", "left_semi")

    far = staged(apart(roots), "apart")
    before = Window.partitionBy("t").orderBy(F.shiftright("np", 32), F.xxhash64("o"))
    chain = far.withColumn("p", F.lag(F.struct("o", "np", "c")).over(before)).where((F.col("p.c") != F.col("c")) & may_link(F.col("p.np"), F.col("np"), percent)).select(*ordered(F.col("p.o"), F.col("o"))).distinct()
    chain = staged(chain.join(stars, ["a", "b"], "left_anti"), "chain")
    more = staged(verified(chain), "links")
    rest = far
    if not more.isEmpty():
        links = roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(more)
        roots = components(links)
        rest = staged(apart(roots), "apart")

    sketched = rest.join(marks.select("o", "n", *[f"m{j}" for j in range(SKETCH)]), "o")
    x, y = sketched.alias("x"), sketched.alias("y")
    meet = (F.col("x.t") == F.col("y.t")) & (F.col("x.o") < F.col("y.o")) & (F.col("x.c") != F.col("y.c")) & may_link(F.col("x.np"), F.col("y.np"), percent) & close("x", "y", percent)
    pairs = x.join(y, meet).select(F.col("x.o").alias("a"), F.col("y.o").alias("b")).distinct()
    pairs = pairs.join(stars.union(chain), ["a", "b"], "left_anti")
    more = staged(verified(pairs), "links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(more))
    freed(postings, packed, marks, stars, chain, far)

    named = sets.join(classes, ["k1", "k2", "n"], "left").select("o", "n", F.coalesce("rep", "o").alias("rep")).join(roots.withColumnRenamed("v", "rep"), "rep", "left")
    value = lambda c: F.when(c != _FIRST_ID, c).cast(id_type)
    return named.select(value(F.col("o")).alias("doc_id"), F.col("n").alias("n_shingles"), value(F.coalesce("root", "rep")).alias("component_id"))
