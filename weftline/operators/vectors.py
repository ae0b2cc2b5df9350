"""Array kernels: quantisation, packing, low-rank factors, grouped heads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def _each(x: Column, value: Column, f) -> Column:
    """f(element, value) over the array; ``value`` is computed once, where inside a lambda it would be for every element."""
    return F.zip_with(x, F.array_repeat(value, F.size(x)), f)


def _clamp(x: Column, lo: int, hi: int) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def symmetric_scale(x: Column, bits: int = 8) -> Column:
    """Largest magnitude by the largest level, at least 1e-8."""
    return F.greatest(F.coalesce(F.array_max(F.transform(_doubles(x), F.abs)), F.lit(0.0)) / ((1 << (bits - 1)) - 1), F.lit(1e-8))


def quantize_symmetric(x: Column, scale: Column, bits: int = 8) -> Column:
    """Levels by rounding half to even, clamped."""
    top = (1 << (bits - 1)) - 1
    return _each(_doubles(x), scale, lambda v, s: _clamp(F.rint(v / s), -top - 1, top).cast("smallint"))


def quantize_asymmetric(x: Column, bits: int = 8) -> Column:
    """Struct (q, scale, zero_point) over 0 .. 2^bits - 1. Levels are small ints, so none wraps."""
    d, top = _doubles(x), (1 << bits) - 1
    lo, hi = F.array_min(d), F.array_max(d)
    scale = F.greatest((hi - lo) / top, F.lit(1e-8))
    zero = _clamp(F.rint(-lo / scale), 0, top)
    both = F.struct(scale.alias("s"), zero.alias("z"))
    return F.struct(_each(d, both, lambda v, b: _clamp(F.rint(v / b["s"] + b["z"]), 0, top).cast("smallint")).alias("q"), scale.alias("scale"), zero.alias("zero_point"))


def dequantize(q: Column, scale: Column, zero_point: Column | None = None) -> Column:
    both = F.struct(scale.alias("s"), (F.lit(0.0) if zero_point is None else zero_point).alias("z"))
    return _each(q, both, lambda v, b: (v - b["z"]) * b["s"])


def channel_scales(df: DataFrame, vector: str, bits: int = 8) -> DataFrame:
    """(channel, scale) over all rows."""
    top = (1 << (bits - 1)) - 1
    parts = df.select(F.posexplode(vector).alias("channel", "x"))
    return parts.groupBy("channel").agg(F.greatest(F.max(F.abs(F.col("x").cast("double"))) / top, F.lit(1e-8)).alias("scale"))


def quantize_channels(df: DataFrame, key: str, vector: str, bits: int = 8) -> DataFrame:
    """(key, q) with one scale per channel; the scales, as many as a vector is long, travel as one array."""
    scales = channel_scales(df, vector, bits).agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "scale"))), lambda s: s["scale"]).alias("_s"))
    top = (1 << (bits - 1)) - 1
    return df.crossJoin(F.broadcast(scales)).select(key, F.zip_with(vector, "_s", lambda v, s: _clamp(F.rint(v.cast("double") / s), -top - 1, top).cast("smallint")).alias("q"))


def error_stats(df: DataFrame, original: str, restored: str, group: str | None = None) -> DataFrame:
    """mse, mae, max_error, psnr of all values."""
    d = df.select(*([group] if group else []), F.explode(F.arrays_zip(F.col(original).alias("a"), F.col(restored).alias("b"))).alias("z")).withColumn("e", F.col("z.a").cast("double") - F.col("z.b"))
    mse = F.avg(F.col("e") * F.col("e"))
    grouped = d.groupBy(group) if group else d.groupBy()
    return grouped.agg(mse.alias("mse"), F.avg(F.abs("e")).alias("mae"), F.max(F.abs("e")).alias("max_error"), (20 * F.log10(F.max(F.abs(F.col("z.a").cast("double"))) / F.sqrt(mse + 1e-10))).alias("psnr"))


def pack_int4(q: Column) -> Column:
    """Two 4-bit values to a byte, the first in the low half; an odd last one alone."""
    places = F.when(F.size(q) > 0, F.sequence(F.lit(1), F.size(q), F.lit(2))).otherwise(F.array().cast("array<int>"))
    nibble = lambda v: F.coalesce(v, F.lit(0)).cast("int").bitwiseAND(F.lit(15))
    return F.transform(places, lambda i: nibble(F.element_at(q, i)).bitwiseOR(F.shiftleft(nibble(F.when(i < F.size(q), F.try_element_at(q, i + 1))), 4)))


def unpack_int4(packed: Column, n: Column) -> Column:
    """The first n signed 4-bit values."""
    signed = lambda v: F.when(v > 7, v - 16).otherwise(v)
    both = F.flatten(F.transform(packed, lambda b: F.array(signed(b.bitwiseAND(F.lit(15))), signed(F.shiftright(b, 4).bitwiseAND(F.lit(15))))))
    return F.slice(both, F.lit(1), n)


def grouped_int4(x: Column, group: int = 128) -> Column:
    """Array of (scale, packed) for each run of ``group`` values, quantised to -8 .. 7 by its own scale."""
    starts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), F.lit(group))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.slice(x, i, F.lit(group)))
    return F.transform(runs, lambda r: F.struct(symmetric_scale(r, 4).alias("scale"), pack_int4(quantize_symmetric(r, symmetric_scale(r, 4), 4)).alias("packed")))


def compare_widths(df: DataFrame, vector: str, widths: tuple[int, ...] = (8, 4)) -> DataFrame:
    """A row for 16 bits and each width: bytes, ratio, and errors of per-row symmetric quantisation."""
    n = F.sum(F.size(vector)).cast("bigint")
    base = df.agg(n.alias("n"), F.count("*").alias("rows"))
    out = base.select(F.lit(16).alias("bits"), (F.col("n") * 2).cast("double").alias("bytes"), F.lit(1.0).alias("ratio"), F.lit(0.0).alias("mse"), F.lit(0.0).alias("mae"), F.lit(0.0).alias("max_error"))
    for bits in widths:
        scale = symmetric_scale(F.col(vector), bits)
        restored = df.select(vector, dequantize(quantize_symmetric(F.col(vector), scale, bits), scale).alias("_r"))
        size = F.col("n") * bits / 8 + 2 * F.col("rows")
        out = out.union(base.crossJoin(error_stats(restored, vector, "_r")).select(F.lit(bits), size, F.col("n") * 2 / size, "mse", "mae", "max_error"))
    return out


def cache_stats(df: DataFrame, bits: str, n: str, scales: str) -> DataFrame:
    """One row: values, quantised bytes, 16-bit bytes, ratio (0 if empty)."""
    from weftline.functions.scores import quantized_bytes

    q = F.sum(quantized_bytes(F.col(n), F.col(bits), F.col(scales)))
    return df.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_values"), F.coalesce(q, F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col(n) * 2), F.lit(0)).alias("fp16_bytes"), F.coalesce(F.sum(F.col(n) * 2) / F.nullif(q, F.lit(0)), F.lit(0.0)).alias("ratio"))


def cache_append(q: Column, scale: Column, new: Column, bits: int = 8) -> Column:
    """Struct (q, scale): the cache restored, extended and quantised again."""
    joined = F.concat(dequantize(q, scale), _doubles(new))
    s = symmetric_scale(joined, bits)
    return F.struct(quantize_symmetric(joined, s, bits).alias("q"), s.alias("scale"))


def energy_rank(df: DataFrame, group: str, order: str, value: str, share: float = 0.95, most: int | None = None) -> DataFrame:
    """Per group: how many singular values (descending) it takes to pass ``share`` of the energy, at most ``most``."""
    w = Window.partitionBy(group)
    e = F.col(value) * F.col(value)
    cumulated = F.sum(e).over(w.orderBy(F.desc(value), order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(e).over(w)
    rank = F.sum(F.when(F.col("_c") < share, 1).otherwise(0)) + 1
    out = df.withColumn("_c", cumulated).groupBy(group).agg(rank.alias("rank"), F.count("*").alias("_n")).withColumn("rank", F.least("rank", "_n")).drop("_n")
    return out.withColumn("rank", F.least(F.col("rank"), F.lit(most))) if most else out


def _rows(column: pa.Array, n: int) -> np.ndarray:
    """Vectors as rows of n values at least; a shorter vector ends in zeros, nulls are zeros."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(n, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    return out


def _stacked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The triangular factor of two blocks of rows, one below the other."""
    n = max(a.shape[1], b.shape[1])
    wide = [np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (a, b)]
    return np.linalg.qr(np.concatenate(wide), mode="r")


def _triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The triangular factor of a task's vectors, a slice of rows at a time."""
    r = np.zeros((0, 0))
    for batch in batches:
        column = batch.column(0)
        step = max(64, (1 << 20) // max(1, int(pc.max(pc.list_value_length(column)).as_py() or 1)))
        for at in range(0, len(column), step):
            r = _stacked(r, _rows(column[at : at + step], r.shape[1]))
    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary()), pa.array([r.shape[1]], pa.int32())], ["r", "n"])


def triangular(df: DataFrame, vector: str) -> np.ndarray:
    """R of the QR factorisation of the matrix whose rows are the vectors (a tree of factors of factors; its signs are not fixed).

    A factor is as large as a vector is long, squared, whatever the number of rows, and about 32 of them meet in the
    driver.  Unlike the Gram matrix it keeps small singular values to full precision."""
    factors = df.select(F.col(vector).cast("array<double>")).mapInArrow(_triangle, "r binary, n int").rdd.map(lambda row: np.frombuffer(row[0]).reshape(-1, row[1]) if row[1] else np.zeros((0, 0)))
    many = factors.getNumPartitions()
    return factors.treeReduce(_stacked, depth=max(2, int(np.ceil(np.log(many) / np.log(16))))) if many else np.zeros((0, 0))


def _times(df: DataFrame, key: str, vector: str, matrix: np.ndarray, name: str) -> DataFrame:
    """(key, name): each vector times the matrix; null vectors give null."""
    sent = df.sparkSession.sparkContext.broadcast(matrix)
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            out = _rows(batch.column(1), len(m))[:, : len(m)] @ m
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * m.shape[1], pa.int32()), pa.array(out.ravel()), mask=pc.is_null(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["k", "p"])

    return rows.mapInArrow(product, f"k {rows.schema['k'].dataType.simpleString()}, p array<double>").toDF(key, name)


def low_rank(df: DataFrame, key: str, vector: str, share: float = 0.95, most: int | None = None) -> tuple[DataFrame, list[float], list[list[float]]]:
    """(rows with factor ``u`` * s, kept singular values, right vectors) of the matrix whose rows are the vectors."""
    r = triangular(df, vector)
    if not r.size:
        return df.select(key, F.array().cast("array<double>").alias("u")), [], []
    _, s, v = np.linalg.svd(r, full_matrices=False)
    rank = int((np.cumsum(s**2) / max((s**2).sum(), 1e-300) < share).sum()) + 1
    rank = min(rank, len(s), most or len(s))
    return _times(df, key, vector, np.ascontiguousarray(v[:rank].T), "u"), s[:rank].tolist(), v[:rank].tolist()


def rebuild(factors: DataFrame, key: str, right: list[list[float]]) -> DataFrame:
    """(key, restored): factor rows (u * s) times the right vectors."""
    if not right:
        return factors.select(key, F.array().cast("array<double>").alias("restored"))
    return _times(factors, key, "u", np.array(right), "restored")


def compress(df: DataFrame, key: str, vector: str, bits: int = 8, share: float = 0.95, most: int | None = None) -> tuple[DataFrame, list[list[float]]]:
    """Low rank, then quantised: rows (key, q, scale) of the left factors; the right vectors (singular values stay in float)."""
    factors, _, right = low_rank(df, key, vector, share, most)
    scale = symmetric_scale(F.col("u"), bits)
    return factors.select(key, quantize_symmetric(F.col("u"), scale, bits).alias("q"), scale.alias("scale")), right


def expand_heads(df: DataFrame, head: str, groups: int, kv_heads: int, heads: int) -> DataFrame:
    """Each of the kv heads ``groups`` times, as query heads head * groups + g."""
    if kv_heads * groups != heads:
        raise ValueError("heads must be a multiple of kv heads")
    return df.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("query_head", F.col(head) * groups + F.col("_g")).drop("_g")


def grouped_memory(layers: int, heads: int, kv_heads: int, head_dim: int, seq_len: int, batch: int = 1, width: int = 2) -> dict[str, float]:
    full = 2 * layers * heads * head_dim * seq_len * batch * width
    own = 2 * layers * kv_heads * head_dim * seq_len * batch * width
    return {"bytes": own, "full_bytes": full, "ratio": full / own if own else 0.0}
