"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage of the whole text is encoded from its bytes and
words (character classes, word lengths, repeats, hashed words), and a small network (numpy, Adam) learns from document
labels alone: an encoder h = tanh(Wx + b), gated attention weights softmax(w . (tanh(Vh) * sigmoid(Uh))) over the bag,
and a logistic score of the weighted passage representation.

Fitting uses a bounded sample of labelled documents: those with the least hash of their id, at most ``SAMPLE`` of them;
in that order each is taken whole, with every passage, if it fits into what is left of ``SAMPLE_BYTES`` (one that doesn't
is passed over, and the next may fit; if none fits, a warning says so and the model stays untrained).  Scoring uses every
passage of every document and nothing but the text.

Nulls and edge cases: a null text counts as empty, which is one passage of zeros; null labels or ids teach nothing; of
several labels of one id the lowest counts, of several texts the least; without any label every score is 0.5; repeated
rows are scored each; ``scored`` replaces columns named score and predicted, ``accepted`` keeps all columns as they are.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import freed, mapped, plain, slices, staged
from weftline.llm.words import mix, split

PASSAGE = 64
SAMPLE = 6000
SAMPLE_BYTES = 48 << 20
HIDDEN, GATE = 24, 12
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.01, 1e-4
HASHED = 128
#: Columns of plain features, before the hashed words.
PLAIN = 16
N_FEATURES = PLAIN + HASHED


def _classes() -> np.ndarray:
    """Byte classes: 1 upper, 2 lower, 3 digit, 4 sentence mark, 5 other mark, 6 beyond ASCII."""
    out = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        c = chr(b)
        out[b] = 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 4 if c in ".,;:'\"()-?" else 5
    out[0x80:] = 6
    return out


_CLASS = _classes()


def passages(texts: pa.Array, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(row of each passage, features); a row without words has one passage of zeros."""
    w = split(texts)
    n_words = np.diff(w.rows)
    n_pass = np.maximum(-(-n_words // size), 1)
    row = np.repeat(np.arange(len(n_words)), n_pass)
    first = np.cumsum(n_pass) - n_pass
    x = np.zeros((len(row), N_FEATURES), np.float32)
    total = len(w.starts)
    if not total:
        return row, x
    within = np.arange(total) - np.repeat(w.rows[:-1], n_words)
    of = np.repeat(first, n_words) + within // size  # passage of each word
    kind = _CLASS[w.data]
    length = (w.ends - w.starts).astype(np.float32)

    def per_word(k: int) -> np.ndarray:
        sums = np.append(0, np.cumsum(kind == k, dtype=np.int32))
        return (sums[w.ends] - sums[w.starts]).astype(np.float32)

    add = lambda v: np.bincount(of, v, len(row)).astype(np.float32)
    n = np.maximum(add(np.ones(total)), 1)
    chars = np.maximum(add(length), 1)
    by_kind = {k: per_word(k) for k in range(1, 7)}
    for j, k in enumerate((1, 3, 4, 5, 6)):
        x[:, j] = add(by_kind[k]) / chars
    letters = by_kind[1] + by_kind[2] + by_kind[6]
    same = np.zeros(total, np.float32)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (within[1:] > 0)
    x[:, 5] = add(same) / n
    x[:, 6] = add(by_kind[5] > 0) / n
    x[:, 7] = add((by_kind[1] >= 2) & (by_kind[2] == 0)) / n
    x[:, 8] = add(letters == 0) / n
    x[:, 9] = chars / n / 10
    x[:, 10] = np.sqrt(np.maximum(add(length**2) / n - (chars / n) ** 2, 0)) / 10
    order = np.lexsort((w.hashes, of))
    new = np.append(True, (w.hashes[order][1:] != w.hashes[order][:-1]) | (of[order][1:] != of[order][:-1]))
    x[:, 11] = np.bincount(of[order][new], minlength=len(row)) / n
    x[:, 12] = np.log1p(n) / 5
    x[:, 13] = np.log1p(n_words[row]) / 10
    x[:, 14] = add(by_kind[4] > 0) / n
    gap = np.zeros(total, np.float32)
    gap[1:] = np.minimum(w.starts[1:] - w.ends[:-1] - 1, 3) * (within[1:] > 0)
    x[:, 15] = add(gap) / n
    h = mix(w.hashes)
    bucket = (h >> np.uint64(32)).astype(np.int64) % HASHED
    sign = np.where((h & np.uint64(1)).astype(bool), 1.0, -1.0)
    bag = np.bincount(of * HASHED + bucket, sign, len(row) * HASHED).reshape(-1, HASHED)
    x[:, PLAIN:] = bag / np.sqrt(n)[:, None]
    x[n_words[row] == 0] = 0  # as for a text alone, whatever else is in the batch
    return row, x


class Model:
    """Gated-attention network; ``params`` are plain arrays."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.params = {"W": g(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "w": g(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict]:
        """Document scores; ``starts``: first passage of each document."""
        p = self.params
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = np.exp((v * u) @ p["w"])  # |e| is bounded by the weights, so no shift is needed
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        return y, {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag}

    def gradient(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        y, k = self.forward(x, starts)
        p, h, v, u, a, bag = self.params, k["h"], k["v"], k["u"], k["a"], k["bag"]
        dy = (y - label) / len(label)
        dz = dy[:, None] * p["c"]
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(1)
        ds = a * (da - np.add.reduceat(a * da, starts)[bag])
        dg = ds[:, None] * p["w"]
        dv, du = dg * u * (1 - v**2), dg * v * u * (1 - u)
        dh += dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - h**2)
        return {"W": k["x"].T @ dx, "b": dx.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "c": k["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, seed: int = 0) -> None:
        """x: passages of all documents (half precision), starts: first passage of each document."""
        n = len(x)
        total, square = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for at in range(0, n, 65536):
            part = x[at : at + 65536].astype(np.float64)
            total += part.sum(0)
            square += (part * part).sum(0)
        self.mean = total / n
        self.scale = np.sqrt(np.maximum(square / n - self.mean**2, 0)) + 1e-3
        rate = np.clip(labels.mean(), 0.01, 0.99)
        self.params["d"][:] = np.log(rate / (1 - rate))
        ends = np.append(starts[1:], n)
        r = np.random.default_rng(seed)
        m, s, step = {k: np.zeros_like(v) for k, v in self.params.items()}, {k: np.zeros_like(v) for k, v in self.params.items()}, 0
        for epoch in range(EPOCHS):
            by = r.permutation(len(starts))
            for at in range(0, len(by), BATCH):
                part = by[at : at + BATCH]
                size = ends[part] - starts[part]
                first = np.cumsum(size) - size
                take = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(starts[part], size)
                grads = self.gradient(x[take].astype(np.float32), first, labels[part])
                step += 1
                for k, g in grads.items():
                    g = g + DECAY * self.params[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.params[k] -= RATE * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, hi in slices(texts):
            row, x = passages(texts.slice(lo, hi - lo))
            out[lo:hi] = self.forward(x, np.searchsorted(row, np.arange(hi - lo)))[0]
        return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = plain(batch.column("text"))
        for lo, hi in slices(texts):
            row, x = passages(texts.slice(lo, hi - lo))
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            data = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                data.append(x[a:b].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array(data, pa.binary())], ["doc_id", "label", "bag"])


def trained(docs: DataFrame, labels: DataFrame, fold: int = 0, label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from labelled documents whose crc32(doc_id as text) mod 5 is not ``fold``: at most ``sample`` of them, with at most ``sample_bytes`` of text."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != fold))
    known = known.groupBy("doc_id").agg(F.min(F.col(label_col).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    texts = staged(texts.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")), "labelled")
    left, fits = sample_bytes, []
    for doc_id, size in texts.select("doc_id", F.octet_length("text"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").drop("h").collect():  # at most ``sample`` ids
        if size <= left:
            left -= size
            fits.append((doc_id,))
    if left == sample_bytes and not fits and not texts.isEmpty():
        warnings.warn(f"no labelled text fits into {sample_bytes} bytes; the classifier is untrained", stacklevel=2)
    within = docs.sparkSession.createDataFrame(fits, texts.select("doc_id").schema)
    rows = texts.join(F.broadcast(within), "doc_id").mapInArrow(_bags, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, label int, bag binary").toArrow()
    freed(texts)
    model = Model()
    if rows.num_rows:
        rows = rows.sort_by("doc_id")
        x = np.frombuffer(b"".join(b.as_py() for b in rows.column("bag")), np.float16).reshape(-1, N_FEATURES)
        size = pc.binary_length(rows.column("bag")).to_numpy().astype(np.int64) // (2 * N_FEATURES)
        model.fit(x, np.cumsum(size) - size, rows.column("label").to_numpy().astype(np.float64))
    return model


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.score(plain(batch.column(at))) >= threshold))

    return mapped(docs, run, docs.schema)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with score and predicted (1 if score >= threshold), which replace columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.drop("score", "predicted")
    names = source.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = sent.value.score(plain(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y), pa.array((y >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return mapped(source, run, T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, fold: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), trained(docs, labels, fold), threshold)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == fold, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")
