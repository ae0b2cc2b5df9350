"""Evaluation: chat messages, prompt sets, ROUGE, accuracy, leaderboards, label masks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as X
from weftline.functions.stemming import stem
from weftline.operators.scans import numbered


def messages(user: Column, system: Column | None = None, assistant: Column | None = None) -> Column:
    """Array of (role, content): system if there is one, user, assistant (stripped) if there is one."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.cast("string").alias("content"))
    parts = [message("system", system)] * (system is not None) + [message("user", user)]
    if assistant is not None:
        parts.append(message("assistant", X.strip(assistant)))
    return F.filter(F.array(*parts), lambda m: m["content"].isNotNull())


def prompt_part(rendered: Column, header: str) -> Column:
    """What stands before the assistant's header."""
    return F.substring_index(rendered, header, 1)


def assistant_label(msgs: Column) -> Column:
    return F.try_element_at(F.filter(msgs, lambda m: m["role"] == "assistant"), F.lit(1))["content"]


def prompt_grid(prompts: DataFrame, samples: DataFrame) -> DataFrame:
    """Each prompt with each sample, with and without its system message. prompts: a short list of templates."""
    variants = prompts.withColumn("with_system", F.explode(F.array(F.lit(True), F.lit(False))))
    return samples.crossJoin(variants)


def zip_by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str, position: str = "position") -> DataFrame:
    """Rows of both sides that stand at the same place of their own order, with that place from 1 on; what is over on one side is left out."""
    a, b = numbered(left, [], [left_order], position), numbered(right, [], [right_order], position)
    return a.join(b, position)


def _grams(codes: np.ndarray, rows: np.ndarray, n: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codes of the one or two (n) tokens from each place on that lie in one row."""
    if n == 1:
        return rows, codes
    here = rows[:-1] == rows[1:]
    return rows[:-1][here], (codes[:-1] * vocabulary + codes[1:])[here]


def _shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], m: int) -> np.ndarray:
    """Per row, how many grams both sides have, counted with repeats."""
    rows, grams = (np.concatenate(x) for x in zip(a, b, strict=True))
    right = np.arange(len(rows)) >= len(a[0])
    by = np.lexsort((grams, rows))
    rows, grams, right = rows[by], grams[by], right[by]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])))[: len(rows)]
    if not len(first):
        return np.zeros(m)
    both = np.add.reduceat(right.astype(np.int64), first)
    n = np.diff(np.append(first, len(rows)))
    return np.bincount(rows[first], np.minimum(both, n - both), m)


def _lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a word of ``a`` at a time on a bit for each word of ``b``."""
    at, seen = {}, set(a)
    for k, w in enumerate(b):
        if w in seen:
            at[w] = at.get(w, 0) | 1 << k
    every = (1 << len(b)) - 1
    rest = every
    for w in a:
        if hit := rest & at.get(w, 0):
            rest = ((rest + hit) | (rest - hit)) & every
    return len(b) - rest.bit_count()


#: The worker process's stems of words met lately.
_stem = lru_cache(1 << 16)(stem)


def _stemmed(words: list[str], codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Codes of the words' stems (words of up to three letters stay), and how many there are."""
    stems: dict[str, int] = {}
    of = np.array([stems.setdefault(_stem(w) if len(w) > 3 else w, len(stems)) for w in words], np.int64)
    return of[codes] if len(words) else codes, len(stems)


#: Words of both sides that are scored together; longer rows stand alone.
_WORDS = 1 << 18


def _spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum up to ``most``, or of one longer row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def _rouge(batches: Iterator[pa.RecordBatch], stems: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = sum(np.asarray(pc.list_value_length(s)).astype(np.int64) for s in batch.columns[-2:])
        for lo, hi in _spans(words, _WORDS):
            piece = batch.slice(lo, hi - lo)
            scores = [pa.array(x) for x in _scores(piece.columns[-2:], hi - lo, stems)]
            yield pa.RecordBatch.from_arrays([*piece.columns[:-2], *scores], [*batch.schema.names[:-2], "rouge1", "rouge2", "rougeL"])


def _scores(sides: list[pa.ListArray], m: int, stems: bool) -> list[np.ndarray]:
    """The three scores of m rows."""
    flat = pa.concat_arrays([s.flatten().cast(pa.string()) for s in sides]).dictionary_encode()
    codes, vocabulary = np.asarray(flat.indices).astype(np.int64), len(flat.dictionary)
    if stems:
        codes, vocabulary = _stemmed(flat.dictionary.to_pylist(), codes)
    sizes = [np.asarray(pc.list_value_length(s)).astype(np.int64) for s in sides]
    parts = np.split(codes, [int(sizes[0].sum())])
    rows = [np.repeat(np.arange(m), s) for s in sizes]
    f1 = lambda shared, total: np.where(total > 0, 2 * shared / np.maximum(total, 1), 0.0)
    out = []
    for n in (1, 2):
        grams = [_grams(p, r, n, vocabulary) for p, r in zip(parts, rows, strict=True)]
        out.append(f1(_shared(*grams, m), sum(np.bincount(g[0], minlength=m) for g in grams)))
    a, b = (np.split(p, np.cumsum(s)[:-1]) for p, s in zip(parts, sizes, strict=True))
    out.append(f1(np.array([_lcs(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], float), sizes[0] + sizes[1]))
    return out


def rouge(df: DataFrame, prediction: str, reference: str, stems: bool = False) -> DataFrame:
    """``df`` with ``rouge1``, ``rouge2`` and ``rougeL`` (F1) of whole texts, over lower-cased letters and digits; ``stems``: of words of over three letters the stems are compared."""
    tokens = lambda c: F.filter(F.split(F.lower(X.text(F.col(c))), "[^a-z0-9]+"), lambda w: w != "")
    out = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("rouge1", "rouge2", "rougeL")]])
    return df.select("*", tokens(prediction).alias("_a"), tokens(reference).alias("_b")).mapInArrow(partial(_rouge, stems=stems), out)


def leaderboard(scores: DataFrame, prompt: str, score: str) -> DataFrame:
    """Mean score and rows of each prompt."""
    return scores.groupBy(prompt).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n"))


def best_prompt(scores: DataFrame, prompt: str, order: str, score: str) -> DataFrame:
    """One row: mean of the prompts' means, and the best prompt (ties: the first in order)."""
    per = scores.groupBy(prompt).agg(F.avg(score).alias("m"), F.min(order).alias("o"))
    return per.agg(F.avg("m").alias("overall_mean"), F.max_by(prompt, F.struct("m", -F.col("o"))).alias("best_prompt"), F.max("m").alias("best_mean"))


def accuracy(df: DataFrame, match: Column, limit: int | None = None, order: str | None = None) -> DataFrame:
    """One row: correct, n, accuracy (over the first ``limit`` rows in order, if given)."""
    rows = df.orderBy(order).limit(limit) if limit else df
    return rows.agg(F.count(F.when(match, 1)).alias("correct"), F.count("*").alias("n"), F.avg(match.cast("double")).alias("accuracy"))


def masked_labels(ids: Column, start: Column, end: Column, ignore: int = -100) -> Column:
    """Token ids inside [start, end) as labels, the others ``ignore``."""
    return F.transform(ids, lambda x, i: F.when((i >= start) & (i < end), x).otherwise(F.lit(ignore)))


def padded(df: DataFrame, batch: str, ids: str, pad: int = 0, ignore: int | None = None) -> DataFrame:
    """Adds ``input_ids`` and ``attention_mask`` padded to the longest of each batch (and ``labels``, padded with ``ignore``, if there is such a column)."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_n"))
    rows = df.join(longest, batch)
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("_n") - F.size(c)))
    rows = rows.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("_n") - F.size(ids)))).withColumn("input_ids", fill(F.col(ids), pad))
    if ignore is not None and "labels" in df.columns:
        rows = rows.withColumn("labels", fill(F.col("labels"), ignore))
    return rows.drop("_n")
