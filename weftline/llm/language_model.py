"""LM scoring by a hashed maximum-entropy model.

Tokens are lower-cased words and one end per text.  The model factors a token into its class and the token given its
class.  A token's code has ``LEVELS`` digits of ``FAN`` values: the first two are its class, from a hash of its last
bytes (the end has its own), the others a hash of the whole word.  Each digit given those before it is a softmax over
sums of hashed feature rows: the words one, two and three places back (skips), the two before together (n-gram), and a
bias row of the digits before.  So the context decides among classes and among the words of a class; words that share
a whole code (few, unless the vocabulary is huge) are told apart by their counts.

A class keeps Good-Turing mass for one outcome, "a token of this class that training has not seen"; what is left goes to
the digits after the class and, within a code, to the training words by their counts.  The probabilities of a token's
outcomes so add up to 1 at most, and score is the log10 probability of the text with unseen tokens read as that outcome
(as the base score also counts all unseen tokens as one).

Training covers every training document: counts by pre-aggregated sums, and gradient updates in ``ROUNDS`` rounds over
disjoint parts of the documents.  In a round each task runs sparse Adagrad steps on numpy batches from the shared
weights and sends its weight changes (half precision); a row's next value is their mean, weighted by how often each
task's tokens had that row's feature, so a feature that one task saw isn't diluted by those that didn't.

Counts of the ``HEAD`` most frequent words travel to all tasks (a fixed bound); rarer words of each document meet their
counts in a join, so no vocabulary has to fit anywhere and frequent words don't crowd one task.

Nulls and edge cases: a null text counts as empty (one token, the end); a null id counts as the empty text for the fold;
without training documents all counts are 0 and scores stay finite; repeated rows are scored each; texts are never cut;
the result's columns are those named below, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import plain, slices, staged
from weftline.llm.words import SPACED, mix, split

LEVELS, FAN = 4, 8
CLASSES = FAN * FAN
CODES = FAN**LEVELS
#: Feature rows of a level; its first ones are the bias rows.
SLOTS = 1 << 16
BIAS = CODES // FAN
HEAD = 1 << 16
#: Context words that are features themselves; others count as their class.
CONTEXT = 1 << 13
ROUNDS = 2
BATCH = 1 << 14
RATE = 0.2
N_FEATURES = 5
END = np.uint64(0)
_BLOCK = 1 << 11


@dataclass
class Tokens:
    """Tokens of some texts in order: hash, code, text of each; ends are at ``last``."""

    hashes: np.ndarray
    codes: np.ndarray
    rows: np.ndarray
    last: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    w = split(texts, SPACED, lower=True)
    n = np.diff(w.rows) + 1
    last = np.cumsum(n) - 1
    hashes = np.zeros(int(n.sum()), np.uint64)
    word = np.ones(len(hashes), bool)
    word[last] = False
    hashes[word] = np.where(w.hashes == END, np.uint64(1), w.hashes)
    codes = np.zeros(len(hashes), np.int64)
    if len(w.starts):
        tail = np.zeros(len(w.starts), np.uint64)
        for back in (1, 2, 3):
            at = w.ends - back
            tail = (tail << np.uint64(8)) | np.where(at >= w.starts, w.data[np.maximum(at, 0)], 0).astype(np.uint64)
        rest = CODES // CLASSES
        codes[word] = (1 + (mix(tail) % np.uint64(CLASSES - 1)).astype(np.int64)) * rest + (mix(w.hashes) % np.uint64(rest)).astype(np.int64)
    return Tokens(hashes, codes, np.repeat(np.arange(len(n)), n), last)


@dataclass
class Head:
    """The most frequent words: sorted hashes, counts, and whether each is a context word."""

    hashes: np.ndarray
    counts: np.ndarray
    context: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def contexts(t: Tokens, known: np.ndarray, head: Head) -> np.ndarray:
    """Hashes of each token's context features, shape (n, N_FEATURES - 1)."""
    n = len(t.hashes)
    own = np.where((known >= 0) & (len(head.hashes) > 0) & np.append(head.context, False)[known], t.hashes, (t.codes // (CODES // CLASSES)).astype(np.uint64) + np.uint64(2))
    own = mix(own + np.uint64(0x2545F4914F6CDD1D))
    back = []
    for k in (1, 2, 3):
        b = np.zeros(n, np.uint64)
        b[k:] = np.where(t.rows[k:] == t.rows[:-k], own[:-k], 0)
        back.append(b)
    out = np.empty((n, N_FEATURES - 1), np.uint64)
    for j, h in enumerate((back[0], back[1], back[2], back[0] * np.uint64(3) + back[1] * np.uint64(0x9E3779B97F4A7C15))):
        out[:, j] = mix(h + np.uint64(j + 1))
    return out


def slots(context: np.ndarray, codes: np.ndarray, level: int) -> np.ndarray:
    """Rows of the features in a level's table: the bias of the digits before, and a hash of them and each context feature."""
    before = codes // FAN ** (LEVELS - level)
    out = np.empty((len(codes), N_FEATURES), np.uint16)
    out[:, 0] = before
    hashed = ((context + before.astype(np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    hashed[hashed < BIAS] += np.uint64(BIAS)
    out[:, 1:] = hashed
    return out


def _sums(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.take(weights, at[:, 0], axis=0)
    for j in range(1, N_FEATURES):
        out += np.take(weights, at[:, j], axis=0)
    return out


def code_logs(weights: np.ndarray, context: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probabilities of each token's class, and of the rest of its code given the class."""
    out = np.zeros((2, len(codes)))
    for lo in range(0, len(codes), BATCH):
        part = codes[lo : lo + BATCH]
        for level in range(LEVELS):
            s = _sums(weights[level], slots(context[lo : lo + BATCH], part, level))
            s -= s.max(1, keepdims=True)
            out[int(level > 1), lo : lo + BATCH] += s[np.arange(len(s)), part // FAN ** (LEVELS - 1 - level) % FAN] - np.log(np.exp(s).sum(1))
    return out[0], out[1]


def train_batch(weights: np.ndarray, squares: np.ndarray, touched: np.ndarray, at: np.ndarray, digit: np.ndarray) -> None:
    """One sparse Adagrad step of a level's rows."""
    s = _sums(weights, at)
    s -= s.max(1, keepdims=True)
    p = np.exp(s, out=s)
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(p)), digit] -= 1
    flat = at.ravel()
    by = np.argsort(flat, kind="stable")  # 16-bit keys sort by radix
    ordered = flat[by]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    rows = ordered[first]
    g = np.add.reduceat(np.take(p, by // N_FEATURES, axis=0), first)
    touched[rows] += np.diff(np.append(first, len(by))).astype(np.float32)
    now = np.take(squares, rows, axis=0)
    now += g * g
    squares[rows] = now
    now += 1
    g *= np.float32(RATE)
    g /= np.sqrt(now, out=now)
    weights[rows] -= g


def first_weights(counts: np.ndarray) -> np.ndarray:
    """Tables of all levels: bias rows from the counts of the codes, the rest 0."""
    weights = np.zeros((LEVELS, SLOTS, FAN), np.float32)
    for level in range(LEVELS):
        by_digit = counts.reshape(FAN**level, FAN, -1).sum(2)
        weights[level, : len(by_digit)] = np.log(by_digit + 0.5)
    return weights


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = plain(batch.column("text"))
        for lo, hi in slices(texts):
            t = tokens(texts.slice(lo, hi - lo))
            h, at, n = np.unique(t.hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.codes[at], pa.int32()), pa.array(n, pa.int64())], ["w", "k", "n"])


def _trainer(weights, head):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = weights.value
        now, squares, touched = start.copy(), np.zeros_like(start), np.zeros(start.shape[:2], np.float32)
        for batch in batches:
            texts = plain(batch.column("text"))
            for lo, hi in slices(texts):
                t = tokens(texts.slice(lo, hi - lo))
                context = contexts(t, head.value.find(t.hashes), head.value)
                for at in range(0, len(context), BATCH):
                    codes = t.codes[at : at + BATCH]
                    for level in range(LEVELS):
                        train_batch(now[level], squares[level], touched[level], slots(context[at : at + BATCH], codes, level), codes // FAN ** (LEVELS - 1 - level) % FAN)
        seen = touched.reshape(-1, _BLOCK)
        some = np.flatnonzero(seen.any(1))
        change = (now - start).astype(np.float16).reshape(-1, _BLOCK, FAN)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([seen[k].tobytes() for k in some], pa.binary()), pa.array([change[k].tobytes() for k in some], pa.binary())], ["block", "seen", "change"])

    return train


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, seen, data in zip(batch.column("block").to_pylist(), batch.column("seen"), batch.column("change"), strict=True):
            n = np.frombuffer(seen.as_py(), np.float32).astype(np.float64)
            part = np.frombuffer(data.as_py(), np.float16).reshape(_BLOCK, FAN) * n[:, None]
            sums[block] = sums[block] + part if block in sums else part
            total[block] = total[block] + n if block in total else n
    yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([(s / np.maximum(total[b], 1)[:, None]).astype(np.float32).tobytes() for b, s in sums.items()], pa.binary())], ["block", "change"])


def _scorer(weights, head, n_train: int, vocabulary: int, logs_of: np.ndarray):
    """kind 0: a text's sums; kind 1: a rarer word of a text. logs_of: per code log10 of (its class's seen mass / its count) and of its class's unseen mass."""
    floor = np.log10(n_train + 0.5 * (vocabulary + 1))
    names = ["kind", "uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "w", "k", "n", "rest"]
    kinds = [pa.int32(), pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = head.value
        for batch in batches:
            texts = plain(batch.column("text"))
            uid = np.asarray(batch.column("uid"))
            for lo, hi in slices(texts):
                t = tokens(texts.slice(lo, hi - lo))
                known = h.find(t.hashes)
                logs, rest = (x / np.log(10) for x in code_logs(weights.value, contexts(t, known, h), t.codes))
                c = h.counts[known] if len(h.counts) else np.zeros(len(known))
                top = known >= 0
                logs[top] += rest[top] + np.log10(c[top]) + logs_of[0][t.codes[top]]
                base = np.where(top, np.log10(np.where(top, c, 0) + 0.5) - floor, 0)
                m = hi - lo
                add = lambda v: np.bincount(t.rows, v, m)
                doc = batch.column("doc_id").slice(lo, m)
                own = [np.zeros(m, np.int32), uid[lo:hi], doc, batch.column("held_out").slice(lo, m), np.bincount(t.rows, minlength=m), add(top).astype(np.int64), add(base), add(logs), None, None, None, None]
                rare = np.flatnonzero(~top)
                by = rare[np.lexsort((t.hashes[rare], t.rows[rare]))]
                first = np.flatnonzero(np.append(True, (t.hashes[by][1:] != t.hashes[by][:-1]) | (t.rows[by][1:] != t.rows[by][:-1])))[: len(by)]
                at, n = by[first], np.diff(np.append(first, len(by)))
                words = [np.ones(len(at), np.int32), uid[lo + t.rows[at]], None, None, None, None, None, None, t.hashes[at].view(np.int64), t.codes[at], n, np.add.reduceat(rest[by], first) if len(by) else rest[by]]
                for columns, size in ((own, m), (words, len(at))):
                    yield pa.RecordBatch.from_arrays([pa.nulls(size, k or doc.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return score


def scored(docs: DataFrame, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from rows whose crc32(doc_id as text) mod 5 is not ``fold``."""
    context = docs.sparkSession.sparkContext
    hashed = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (hashed % 5 == fold).alias("held_out"), (F.floor(hashed / 5) % rounds).alias("part"))
    train = source.where(~F.col("held_out"))

    counts = staged(train.select("text").mapInArrow(_count, "w bigint, k int, n bigint").groupBy("w", "k").agg(F.sum("n").alias("c")), "counts")
    by_code = np.zeros((3, CODES))
    for k, *row in counts.groupBy("k").agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("bigint"))).collect():
        by_code[:, k] = row
    n_train, vocabulary = int(by_code[0].sum()), int(by_code[1].sum())
    tokens_of, _, once = by_code.reshape(3, CLASSES, -1).sum(2)
    unseen = np.clip((once + 0.5) / (tokens_of + 1), 1e-9, 0.5)
    unseen[tokens_of == 0] = 1.0
    if tokens_of[0]:
        unseen[0] = 1e-9  # the end is never new
    of_class = lambda x: np.log10(np.maximum(np.repeat(x, CODES // CLASSES), 1e-9))
    logs = np.stack([of_class(1 - unseen) - np.log10(np.maximum(by_code[0], 1)), of_class(unseen)])
    top = counts.orderBy(F.desc("c"), "w").limit(HEAD).select("w", "c").toArrow()
    w, c = np.asarray(top.column("w")).view(np.uint64), np.asarray(top.column("c")).astype(np.float64)
    by = np.argsort(w)
    head = context.broadcast(Head(w[by], c[by], by < CONTEXT))

    weights = first_weights(by_code[0])
    blocks = LEVELS * SLOTS // _BLOCK
    for part in range(rounds):
        step = train.where(F.col("part") == part).select("text").mapInArrow(_trainer(context.broadcast(weights), head), "block int, seen binary, change binary").repartition(blocks, "block").mapInArrow(_average, "block int, change binary").collect()
        weights = weights.copy()
        flat = weights.reshape(blocks, _BLOCK, FAN)
        for block, data in step:
            flat[block] += np.frombuffer(data, np.float32).reshape(_BLOCK, FAN)

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = source.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(
        _scorer(context.broadcast(weights), head, n_train, vocabulary, logs),
        f"kind int, uid bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, w bigint, k int, n bigint, rest double",
    )
    rows = staged(rows, "scores")
    c = F.coalesce(F.col("c"), F.lit(0))
    base = F.log10(c + 0.5) - float(np.log10(n_train + 0.5 * (vocabulary + 1)))
    of_code = F.broadcast(docs.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(logs.T)], "k int, seen double, unseen double"))  # CODES rows
    inner = F.when(c > 0, F.col("n") * (F.log10(c) + F.col("seen")) + F.col("rest")).otherwise(F.col("n") * F.col("unseen"))
    rare = rows.where("kind = 1").select("uid", "w", "k", "n", "rest").join(counts.select("w", "c"), "w", "left").join(of_code, "k").groupBy("uid").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("k2"), F.sum(F.col("n") * base).alias("b2"), F.sum(inner).alias("s2"))
    own = rows.where("kind = 0").select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score").join(rare, "uid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return own.select("doc_id", "held_out", "n_tokens", plus("n_known", "k2").alias("n_known"), F.lit(n_train).cast("bigint").alias("train_tokens"), plus("base_score", "b2").alias("base_score"), plus("score", "s2").alias("score"))
