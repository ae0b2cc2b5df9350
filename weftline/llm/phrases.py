"""Substring dedup by repeated-phrase automata.

A word goes when it lies in a window of ``WINDOW`` words whose sequence also starts earlier (smaller id, or earlier in
the same document).  Steps, each linear in the text:

1. Exact copies of a text but the first are known from 128 bits of hash; all their windows start earlier, so they need
   no search.
2. Anchors.  Of the ``ANCHOR``-word phrases in a window the one with the least hash is its anchor (about one place in
   six).  Equal windows have equal anchors, so only anchors matter that recur in another text or in the same one.
3. Documents are dealt out to buckets of about ``BUCKET_BYTES``, and each bucket gets the recurring anchors of its own
   documents, each as one place where its words stand: the dictionary is sharded with the text, so no document meets a
   phrase that it can't hold.
4. Each bucket takes the phrases' words from those places, compiles them into an Aho-Corasick automaton (pyahocorasick;
   each word is three letters) and streams its documents through, which locates every occurrence.
5. Windows whose anchor was located and that start earlier in the bucket go at once.  The others are confirmed over all
   documents: windows with the same anchor place make a group of up to 11; equal groups are settled first, as most
   repeats are whole, and then the windows of anchors that stand in several different groups.

Windows count as equal when their 64-bit hashes and their anchors (64 bits within a group, 32 between windows) agree:
96 bits for windows of different anchors, and 64 among those that share one.

Hot phrases: a phrase is reduced to one row a bucket before its rows meet, a repeated group or window to one row a
bucket, firsts are partial aggregates written to a table, and what is joined with them comes straight from a shuffle, so
that AQE can split large keys.  Nothing is collected to the driver.

Nulls and edge cases: a null text has no words; a null id counts as smaller than all others; ids are integers (others
raise TypeError); rows that share an id are ordered by a hash of their text, and equal ones (same id and text) are the
same place, so neither goes; a text of fewer than WINDOW words is kept whole; other columns, of any name, can be carried
along (``carry``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.common import freed, integral, plain, quoted, slices, staged
from weftline.llm.words import Words, cover, mix, ngrams, split, whole

WINDOW = 20
ANCHOR = 10
#: Text bytes of a bucket on average, of the block that one automaton is compiled for at most, and of a task on average.
BUCKET_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
TASK_BYTES = 64 << 20
_FIRST_ID = -(1 << 63)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Runs of windows are packed as start * 2^20 + number.
_RUN = 1 << 20


def _least(grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of ``n`` grams from each place on, and its (leftmost) offset."""
    m = len(grams) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    best, at = grams[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, n):
        less = grams[j : j + m] < best
        best[less] = grams[j : j + m][less]
        at[less] = j
    return best, at


def anchors(w: Words, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """Word places of the anchors of all windows."""
    _, at = _least(ngrams(w.hashes, anchor), window - anchor + 1)
    at = (at + np.arange(len(at)))[whole(w.rows, window)]
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each text: hash, bucket and hash of the text, first place in it, and whether the text has it twice."""
    for batch in batches:
        texts, bucket, key = plain(batch.column("text")), np.asarray(batch.column("bucket")), np.asarray(batch.column("k"))
        for lo, hi in slices(texts):
            w = split(texts.slice(lo, hi - lo))
            at = anchors(w)
            row = np.searchsorted(w.rows, at, "right") - 1
            h = ngrams(w.hashes, ANCHOR)[at]
            by = np.lexsort((h, row))  # stable: a text's equal anchors stay in order
            h, row, at = h[by].view(np.int64), row[by], at[by]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])))[: len(h)]
            n = np.diff(np.append(first, len(h)))
            r = row[first]
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(bucket[lo + r], pa.int32()), pa.array(key[lo + r]), pa.array(at[first] - w.rows[r], pa.int32()), pa.array(n > 1)], ["h", "bucket", "k", "place", "twice"])


def words_at(w: Words, places: np.ndarray, anchor: int = ANCHOR) -> np.ndarray:
    """Word hashes of the phrases that start at some word places, one row each."""
    return w.hashes[places[:, None] + np.arange(anchor)]


def locate(w: Words, phrases: np.ndarray) -> np.ndarray:
    """Mask of the word places where one of the phrases (rows of word hashes) starts, found by an automaton of the phrases."""
    out = np.zeros(len(w.hashes), bool)
    anchor = phrases.shape[1]
    vocabulary, ids = np.unique(w.hashes, return_inverse=True)
    if not len(vocabulary) or not len(phrases):
        return out
    at = np.minimum(np.searchsorted(vocabulary, phrases), len(vocabulary) - 1)
    at = at[(vocabulary[at] == phrases).all(1)]  # a phrase with a word that these texts don't have can't occur
    if not len(at):
        return out
    # three letters a word, each place with letters of its own, so matches begin at words; a parting letter after each row
    n = np.arange(len(vocabulary))
    letters = np.stack([0x0100 + (n >> 16), 0x0200 + ((n >> 8) & 255), 0x0300 + (n & 255)], 1).astype(np.uint16)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, row in enumerate(letters[at].reshape(len(at), -1)):
        automaton.add_word(row.tobytes().decode("utf-16-le"), k)
    automaton.make_automaton()
    shift = w.row_of() + 3 * np.arange(len(ids))
    text = np.full(3 * len(ids) + len(w.rows), 0x0400, np.uint16)
    for j in range(3):
        text[shift + j] = letters[ids, j]
    ends = np.fromiter((e for e, _ in automaton.iter(text.tobytes().decode("utf-16-le"))), np.int64)
    out[np.searchsorted(shift, ends - 2) - (anchor - 1)] = True
    return out


def candidates(w: Words, located: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Start words of the windows whose anchor was located, and the word places of those anchors."""
    grams = ngrams(w.hashes, anchor)
    least, at = _least(grams, window - anchor + 1)
    there, _ = _least(np.where(located[: len(grams)], grams, _TOP), window - anchor + 1)
    start = np.flatnonzero((least == there) & whole(w.rows, window))
    return start, start + at[start]


def starts_earlier(one: np.ndarray, h: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Mask of the windows (hash, anchor hash, place) that have an equal one at a lower place among those given."""
    out = np.zeros(len(one), bool)
    by = np.argsort(one, kind="stable")
    first = np.flatnonzero(np.append(True, one[by][1:] != one[by][:-1]))[: len(by)]
    if not len(first):
        return out
    n = np.diff(np.append(first, len(by)))
    alike = np.minimum.reduceat(h[by], first) == np.maximum.reduceat(h[by], first)  # else the next step decides
    out[by] = (where[by] > np.repeat(np.minimum.reduceat(where[by], first), n)) & np.repeat(alike, n)
    return out


def groups(one: np.ndarray, start: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (hash, start, anchor place) in runs of one anchor place: first index, number, and 64 bits of hash of the windows."""
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))[: len(start)]
    n = np.diff(np.append(first, len(start)))
    turn = (np.arange(len(start)) - np.repeat(first, n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    g = np.add.reduceat(mix(one + turn), first) if len(first) else np.empty(0, np.uint64)
    return first, n, g


def runs(start: np.ndarray, row: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending window starts as runs: row of each run, and its start in the row with the number of windows, packed."""
    own = start - base[row]
    first = np.flatnonzero(np.append(True, (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1]) | (own[1:] % (_RUN - 1) == 0)))[: len(start)]
    return row[first], own[first] * _RUN + np.diff(np.append(first, len(start)))


def kept(w: Words, row: int, gone: np.ndarray | None = None) -> bytes:
    a, b = int(w.rows[row]), int(w.rows[row + 1])
    data = w.data
    return b" ".join([data[s:e].tobytes() for k, (s, e) in enumerate(zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)) if gone is None or not gone[k]])


def _bucket_stream(schema: list[tuple[str, pa.DataType]], block_bytes: int):
    """Rows sorted by bucket, kind (0 place of a phrase, in th; 1 later copy; 2 document) and text hash to groups of windows (kind 0), settled rows (1), open rows (2) and runs of windows that go (3)."""

    def block(docs: list[pa.RecordBatch], new: tuple[np.ndarray, np.ndarray], known: np.ndarray, copies: set) -> Iterator:
        ids, hashes, keys = (np.concatenate([np.asarray(d.column(c)) for d in docs]) for c in ("o", "th", "k"))
        texts = pa.concat_arrays([plain(d.column("text")) for d in docs])
        carried = pa.concat_arrays([d.column("rest") for d in docs])
        null = pa.concat_arrays([d.column("text").is_null() for d in docs])
        w = split(texts)
        known = np.concatenate([known, words_at(w, w.rows[np.searchsorted(keys, new[0])] + new[1])])
        sizes = np.diff(w.rows)
        copy = np.array([k in copies for k in zip(ids.tolist(), hashes.tolist(), strict=True)], bool) & (sizes >= WINDOW)
        start, place = candidates(w, locate(w, known))
        fresh = ~copy[np.searchsorted(w.rows, start, "right") - 1]
        start, place = start[fresh], place[fresh]
        row = np.searchsorted(w.rows, start, "right") - 1
        by = np.lexsort((hashes, ids))  # rows with the same id and text are the same place
        rank = np.empty(len(ids), np.int64)
        rank[by] = np.cumsum(np.append(False, (ids[by][1:] != ids[by][:-1]) | (hashes[by][1:] != hashes[by][:-1])))
        one, h = ngrams(w.hashes, WINDOW)[start] if len(start) else np.empty(0, np.uint64), ngrams(w.hashes, ANCHOR)[place]
        late = starts_earlier(one, h, (rank[row] << 32) + start - w.rows[row])

        of, packed = runs(start[late], row[late], w.rows)
        at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))[: len(of)]
        ends = pa.array(np.append(at, len(of)), pa.int32())
        yield build({"kind": np.full(len(at), 3, np.int32), "o": ids[of[at]], "th": hashes[of[at]], "ws": pa.ListArray.from_arrays(ends, pa.array(packed, pa.int64()))}, len(at))

        first, n, g = groups(one[~late], start[~late], place[~late])
        begin, of = start[~late][first], row[~late][first]
        ends = pa.array(np.append(first, int((~late).sum())), pa.int32())
        yield build({"kind": np.zeros(len(n), np.int32), "o": ids[of], "th": hashes[of], "h": h[~late][first].view(np.int64), "g": g.view(np.int64), "start": begin - w.rows[of], "ws": pa.ListArray.from_arrays(ends, pa.array(one[~late].view(np.int64)))}, len(n))

        open_ = np.zeros(len(ids), bool)
        open_[row] = True
        at = np.flatnonzero(~open_)
        digest = [hashlib.sha256(b"" if copy[r] else kept(w, r)).hexdigest() for r in at.tolist()]
        take = pa.array(at)
        yield build({"kind": np.ones(len(at), np.int32), "o": ids[at], "th": hashes[at], "n_words": sizes[at], "n_removed": np.where(copy, sizes, 0)[at], "kept_sha256": pa.array(digest, pa.string()), "text": pa.compute.if_else(null.take(take), None, pa.compute.if_else(pa.array(copy[at]), "", texts.take(take))), "rest": carried.take(take)}, len(at))
        at = np.flatnonzero(open_)
        take = pa.array(at)
        yield build({"kind": np.full(len(at), 2, np.int32), "o": ids[at], "th": hashes[at], "text": texts.take(take), "rest": carried.take(take)}, len(at))
        return known

    def build(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], k)) if c in columns else pa.nulls(n, k) for c, k in schema], [c for c, _ in schema])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, copies, docs, size = None, [], set(), [], 0
        known = np.empty((0, ANCHOR), np.uint64)

        def ready() -> Iterator:
            """The documents held, with the phrases whose place is among them; texts ascend by hash, so the others' places are past or still to come."""
            nonlocal places, docs, size, known
            if places:
                keys, at = (np.concatenate([p[j] for p in places]) for j in (0, 1))
                here = keys <= docs[-1].column("k")[-1].as_py()
                new, places = (keys[here], at[here]), [(keys[~here], at[~here])] if not here.all() else []
            else:
                new = (np.empty(0, np.int64), np.empty(0, np.int64))
            known = yield from block(docs, new, known, copies)
            docs, size = [], 0

        for batch in batches:
            bucket, kind = np.asarray(batch.column("bucket")), np.asarray(batch.column("kind"))
            cuts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])))
            for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(bucket)).tolist(), strict=True):
                if bucket[lo] != now:
                    if docs:
                        yield from ready()
                    now, places, copies, docs, size = bucket[lo], [], set(), [], 0
                    known = np.empty((0, ANCHOR), np.uint64)
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    places.append((np.array(part.column("k")), np.array(part.column("th"), np.int64)))
                elif kind[lo] == 1:
                    copies.update(zip(part.column("o").to_pylist(), part.column("th").to_pylist(), strict=True))
                else:
                    for a, b in slices(plain(part.column("text")), block_bytes):
                        if docs and size + part.column("text").slice(a, b - a).nbytes > block_bytes:
                            yield from ready()
                        docs.append(part.slice(a, b - a))
                        size += part.column("text").slice(a, b - a).nbytes
        if docs:
            yield from ready()

    return stream


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open rows with what goes of them (``runs``: first start and number of windows, packed) to settled rows."""
    for batch in batches:
        texts = plain(batch.column("text"))
        gone_runs = batch.column("runs")
        for lo, hi in slices(texts):
            w = split(texts.slice(lo, hi - lo))
            n_words, n_removed, digest, text = np.diff(w.rows), [], [], []
            for r in range(hi - lo):
                begin = gone_runs[lo + r].as_py()
                spans = np.array(begin or [], np.int64)
                gone = cover(spans // _RUN, spans % _RUN + WINDOW - 1, int(n_words[r])) if begin else None
                n_removed.append(int(gone.sum()) if begin else 0)
                left = kept(w, r, gone)
                digest.append(hashlib.sha256(left).hexdigest())
                text.append(left.decode() if begin else texts[lo + r].as_py())
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column("o"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.string()), part.column("rest")], ["o", "n_words", "n_removed", "kept_sha256", "text", "rest"])


def repeated_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), bucket_bytes: int = BUCKET_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, text (the kept words joined by one space; as it was if none go), and the ``carry`` columns as fields of ``carried`` (null without any)."""
    spark, id_type = docs.sparkSession, integral(docs, id_col)
    rest = F.struct(*[F.col(quoted(c)) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    text = F.col(text_col).cast("string")
    key = F.coalesce(F.hash(text), F.lit(0))  # tells apart rows that share an id
    order = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_FIRST_ID).cast("bigint"))
    source = docs.select(order.alias("o"), key.alias("th"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("k"), text.alias("text"), rest.alias("rest"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64("o", "th"), F.lit(buckets)).cast("int")
    long_enough = F.octet_length("text") >= 2 * WINDOW - 1

    searched = source.where(long_enough)
    alike = searched.select(bucket.alias("bucket"), "o", "th", "k", F.xxhash64(F.lit(1), "text").alias("k2"))
    several = staged(alike.groupBy("k", "k2").agg(F.min("o").alias("first"), F.max("o").alias("last")).where("last > first").drop("last"), "copies")
    copies = alike.join(several, ["k", "k2"]).where("o > first").select("bucket", F.lit(1).alias("kind"), "k", "o", "th")

    placed = searched.select(bucket.alias("bucket"), "text", "k").mapInArrow(_place, "h bigint, bucket int, k bigint, place int, twice boolean")
    placed = placed.groupBy("h", "bucket").agg(F.min("k").alias("k"), F.max("k").alias("k_last"), F.min_by("place", "k").alias("place"), F.bool_or("twice").alias("twice"))
    same = Window.partitionBy("h")
    placed = placed.withColumn("shared", F.min("k").over(same) != F.max("k_last").over(same))
    # a phrase of several texts goes to each of their buckets; one that a text repeats, to that text's
    phrases = staged(placed.where("twice or shared").select("bucket", F.lit(0).alias("kind"), "k", F.lit(None).cast("bigint").alias("o"), F.col("place").alias("th")), "recurring")

    rest_type = source.schema["rest"].dataType
    nothing = [F.lit(None).cast("string").alias("text"), F.lit(None).cast(rest_type).alias("rest")]
    # texts too short for a window need no company, so many empty ones don't crowd a bucket
    anywhere = F.when(long_enough, bucket).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    rows = phrases.union(copies).select("bucket", "kind", "k", "o", "th", *nothing).union(source.select(anywhere.alias("bucket"), F.lit(2), "k", "o", "th", "text", "rest"))
    # a task takes its buckets one after the other, so its memory depends on the bucket alone
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    dealt = rows.repartition(max(1, min(parts, buckets)), "bucket").sortWithinPartitions("bucket", "kind", "k")
    out = T.StructType([T.StructField(n, t) for n, t in (("kind", T.IntegerType()), ("o", T.LongType()), ("th", T.IntegerType()), ("h", T.LongType()), ("g", T.LongType()), ("start", T.IntegerType()), ("ws", T.ArrayType(T.LongType())), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("text", T.StringType()), ("rest", rest_type))])
    from pyspark.sql.pandas.types import to_arrow_type

    schema = [(f.name, to_arrow_type(f.dataType)) for f in out.fields]
    seen = staged(dealt.mapInArrow(_bucket_stream(schema, block_bytes), out), "phrases")
    freed(phrases, several)

    place = F.struct("o", "th", "start")
    blocks = seen.where("kind = 0").select("h", "g", "o", "th", "start", "ws")
    firsts = staged(blocks.groupBy("h", "g").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").drop("c"), "groups")
    run = lambda start, n: F.array(start.cast("bigint") * _RUN + n).alias("runs")
    whole_groups = blocks.join(firsts, ["h", "g"]).where(place > F.col("f")).select("o", "th", run(F.col("start"), F.size("ws")))
    own = blocks.join(firsts, ["h", "g"], "left").where(F.col("f").isNull() | (place == F.col("f")))
    # equal windows of different groups have the same anchor
    several = staged(own.groupBy("h").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a != b").select("h"), "anchors")
    windows = own.join(several, "h", "left_semi").select("o", "th", "start", F.hash("h").alias("hh"), F.posexplode("ws").alias("i", "w")).select("w", "hh", "o", "th", (F.col("start") + F.col("i")).alias("start"))
    first_windows = staged(windows.groupBy("w", "hh").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").drop("c"), "windows")
    late = windows.join(first_windows, ["w", "hh"]).where(place > F.col("f")).select("o", "th", run(F.col("start"), F.lit(1)))
    late = late.union(whole_groups).union(seen.where("kind = 3").select("o", "th", F.col("ws").alias("runs")))
    later = staged(late.groupBy("o", "th").agg(F.flatten(F.collect_set("runs")).alias("runs")), "later")
    freed(firsts, several, first_windows)
    opened = seen.where("kind = 2").select("o", "th", "text", "rest").join(later, ["o", "th"], "left")
    result = T.StructType([out[n] for n in ("o", "n_words", "n_removed", "kept_sha256", "text", "rest")])
    settled = seen.where("kind = 1").select(*result.fieldNames()).union(opened.mapInArrow(_settle, result))
    return settled.select(F.when(F.col("o") != _FIRST_ID, F.col("o")).cast(id_type).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "text", (F.col("rest") if carry else F.lit(None).cast(rest_type)).alias("carried"))
