"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph cells.

A text's cells are its lines, parted further after sentence ends, each as a 64-bit digest (a repeated cell's digest
depends on which repeat it is, so a text is a set).  A sketch of m cells adds every digest to three of them: count, XOR
of digests, XOR of check hashes; the fingerprint is the sketch with the number of digests.  Two fingerprints subtract;
cells that hold one digest peel off until nothing is left, which recovers the digests that differ.  If peeling stalls,
both sketches are built anew at twice the size and subtracted, again and again.

A cell is a sentence of a paragraph rather than the whole paragraph, since many texts here are one paragraph, and an
edit of one would then make two versions wholly unlike.

likeness = shared / united digests (Jaccard): 1 for equal cells, both texts empty included, 0 for none in common.

The next document in ascending id is found without one global window: ids give range bounds, each range is one
sorted stream, and the first document of a range is also sent to the range before it.

Nulls and edge cases: a null text counts as empty; null ids come first in the order; rows that share an id follow each
other by text; a lone document is its own next; texts are never cut; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import integral, plain
from weftline.llm.words import mix

CELLS = 24
_HASHES = 3
_CUT = re.compile(r"\n+|(?<=[.!?])[ \t]+")
_BATCH_CHARS = 2_000_000


def digests(text: str) -> np.ndarray:
    pieces = [p for p in _CUT.split(text) if p]
    if len(set(pieces)) == len(pieces):
        return np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], np.uint64)
    seen: Counter[str] = Counter()
    out = []
    for p in pieces:
        out.append(xxhash.xxh3_64_intdigest(p, seen[p]))
        seen[p] += 1
    return np.unique(np.array(out, np.uint64))


def _places(keys: np.ndarray, m: int) -> np.ndarray:
    """Three different cells for each digest, one in each third of the sketch."""
    third = m // _HASHES
    seeds = [np.uint64(((j + 1) * 0xA0761D6478BD642F + m) % (1 << 64)) for j in range(_HASHES)]
    return np.stack([(mix(keys + seed) % np.uint64(third)).astype(np.int64) + j * third for j, seed in enumerate(seeds)])


def sketches(keys: np.ndarray, owner: np.ndarray, n: int, m: int, sign: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest XORs and check XORs, each of shape (n, m)."""
    count, key, check = np.zeros(n * m, np.int64), np.zeros(n * m, np.uint64), np.zeros(n * m, np.uint64)
    checks = mix(keys ^ np.uint64(0x5851F42D4C957F2D))
    for at in _places(keys, m):
        at = owner * m + at
        np.add.at(count, at, 1 if sign is None else sign)
        np.bitwise_xor.at(key, at, keys)
        np.bitwise_xor.at(check, at, checks)
    return count.reshape(n, m), key.reshape(n, m), check.reshape(n, m)


_CELL = np.dtype([("n", "<i4"), ("k", "<u8"), ("c", "<u4")])
_CHECK = np.uint64(0xFFFFFFFF)


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: success; and the (owner, digest) pairs recovered, of the rows that succeeded. check: 32 bits."""
    n, m = count.shape
    count, key, check = count.astype(np.int64).ravel(), key.ravel().copy(), check.astype(np.uint64).ravel()
    owners, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    look = np.arange(n * m)
    for _ in range(n * m):
        pure = look[np.abs(count[look]) == 1]
        pure = pure[(mix(key[pure] ^ np.uint64(0x5851F42D4C957F2D)) & _CHECK) == check[pure]]
        if not len(pure):
            break
        row = pure // m
        by = np.lexsort((key[pure], row))
        pure, row = pure[by], row[by]
        new = np.append(True, (row[1:] != row[:-1]) | (key[pure][1:] != key[pure][:-1]))
        pure, row = pure[new], row[new]
        k, s = key[pure], count[pure]
        owners.append(row)
        keys.append(k)
        checks, touched = mix(k ^ np.uint64(0x5851F42D4C957F2D)) & _CHECK, []
        for at in _places(k, m):
            at = row * m + at
            np.subtract.at(count, at, s)
            np.bitwise_xor.at(key, at, k)
            np.bitwise_xor.at(check, at, checks)
            touched.append(at)
        look = np.unique(np.concatenate(touched))
    ok = ((count.reshape(n, m) == 0) & (key.reshape(n, m) == 0) & (check.reshape(n, m) == 0)).all(1)
    owner, found = np.concatenate(owners), np.concatenate(keys)
    return ok, owner[ok[owner]], found[ok[owner]]


def packed(sets: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """The sketch of each digest set: rows of cells (4 bytes of count, 8 of digest XOR, 4 of check XOR)."""
    keys = np.concatenate([np.empty(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    count, key, check = sketches(keys, owner, len(sets), cells)
    out = np.zeros((len(sets), cells), _CELL)
    out["n"], out["k"], out["c"] = count, key, check & _CHECK
    return out


def subtract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest XORs and check XORs of the difference of packed sketches, row by row."""
    return a["n"] - b["n"], a["k"] ^ b["k"], a["c"] ^ b["c"]


def differing(a: list[np.ndarray], b: list[np.ndarray], first: tuple[np.ndarray, np.ndarray] | None = None, cells: int = CELLS) -> np.ndarray:
    """How many digests differ in each pair of digest sets: their sketches (``first``, if at hand) subtracted and peeled, and built at twice the size after a failure."""
    out = np.zeros(len(a), np.int64)
    left, m = np.arange(len(a)), cells
    x, y = first or (packed(a, m), packed(b, m))
    while len(left):
        ok, of, _ = peel(*subtract(x, y))
        out[left[ok]] = np.bincount(of, minlength=len(left))[ok]
        left, m = left[~ok], 2 * m
        x, y = packed([a[k] for k in left], m), packed([b[k] for k in left], m)
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], first: tuple[np.ndarray, np.ndarray] | None = None, cells: int = CELLS) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    delta = differing(a, b, first, cells).astype(np.float64)
    return np.where(total > 0, (total - delta) / np.maximum(total + delta, 1), 1.0)


def written(sketch: np.ndarray, sets: list[np.ndarray]) -> list[str]:
    """Fingerprints as text: the number of digests (8 bytes) and the cells of the sketch."""
    return [base64.b64encode(len(s).to_bytes(8, "little") + r.tobytes()).decode() for r, s in zip(sketch, sets, strict=True)]


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    """The number of digests and the sketch of a fingerprint."""
    data = base64.b64decode(fingerprint)
    return int.from_bytes(data[:8], "little"), np.frombuffer(data[8:], _CELL)


def _stream(cells: int):
    """Pairs each document with the next of its range; expects rows sorted by range, extra, id, text."""

    def compare(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        ids, texts, nexts = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
        own, other = [digests(t) for t in texts], [digests(t) for t in edited]
        follow = [*own[1:], digests(nexts[-1])]
        follow = [f if k + 1 == len(rows) or nexts[k] == texts[k + 1] else digests(nexts[k]) for k, f in enumerate(follow)]
        x, y, z = packed(own, cells), packed(other, cells), packed(follow, cells)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(written(x, own)), pa.array(written(y, other)), pa.array(likeness(own, other, (x, y), cells)), pa.array(likeness(own, follow, (x, z), cells)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row: range, extra, id, text
        ready, size, kind = [], 0, None
        for batch in batches:
            kind = batch.column("doc_id").type
            for row in zip(*[batch.column(c).to_pylist() for c in ("range", "extra", "doc_id")], plain(batch.column("text")).to_pylist(), strict=True):
                if held and held[0] == row[0] and not held[1]:
                    ready.append((held[2], held[3], row[3]))
                    size += len(held[3])
                    if size >= _BATCH_CHARS:
                        yield compare(ready, kind)
                        ready, size = [], 0
                held = row
        if ready:
            yield compare(ready, kind)

    return stream


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, ranges: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    least = -(1 << 63)
    integral(docs, id_col)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.unique(np.array(source.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges), np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def range_of(ids):
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right").astype(np.int32))

    order = F.coalesce(F.col("doc_id"), F.lit(least).cast("bigint"))
    firsts = source.select(order.alias("o")).groupBy(range_of("o").alias("range")).agg(F.min("o").alias("first")).orderBy("range").collect()
    # the first id of each range also goes to the range before it; that of the first range to the last
    also = {r["first"]: firsts[k - 1]["range"] for k, r in enumerate(firsts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o = np.array([least if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            own = pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, o, "right"), pa.int32()), pa.array(np.zeros(len(o), np.int32)), *batch.columns], ["range", "extra", "doc_id", "text"])
            yield own
            at = np.flatnonzero(np.isin(o, list(also)))
            if len(at):
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([also[i] for i in o[at].tolist()], pa.int32()), pa.array(np.ones(len(at), np.int32)), *part.columns], ["range", "extra", "doc_id", "text"])

    dealt = source.mapInArrow(deal, "range int, extra int, doc_id bigint, text string").repartition(ranges, "range").sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_stream(cells), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
