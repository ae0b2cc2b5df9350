"""Benchmark runs and cache profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scores as S
from weftline.operators.metrics import with_percentiles

MB = float(1 << 20)


def run_summary(runs: DataFrame, method: str = "method") -> DataFrame:
    """Per method: runs, mean and population std of speed, means of what isn't null, exact latency percentiles."""
    whole = runs.groupBy(method).agg(
        F.count("*").alias("num_runs"), F.avg("tokens_per_second").alias("avg_tokens_per_second"), F.stddev_pop("tokens_per_second").alias("std_tokens_per_second"),
        F.avg("acceptance_rate").alias("avg_acceptance_rate"), F.avg("speedup_vs_baseline").alias("avg_speedup"), F.avg("memory_used_mb").alias("avg_memory_mb"),
    )
    return with_percentiles(whole, runs, "total_time_ms", {"p50_latency_ms": 0.5, "p90_latency_ms": 0.9, "p99_latency_ms": 0.99}, method)


def decoder_summary(runs: DataFrame, group: str) -> DataFrame:
    """Per group: ratios of sums and the number of runs; the runs themselves stay the table they are."""
    total = {c: F.sum(c) for c in ("accepted", "drafted", "tokens", "ms")}
    return runs.groupBy(group).agg(S.acceptance(total["accepted"], total["drafted"]).alias("acceptance_rate"), S.tokens_per_second(total["tokens"], total["ms"]).alias("tokens_per_second"), F.count("*").alias("n"))


def paired_speedup(runs: DataFrame, baseline: str = "autoregressive") -> DataFrame:
    """Adds speedup_vs_baseline: a run's speed by that of the baseline run of its prompt and number; null if that is missing or not positive."""
    base = runs.where(F.col("method") == baseline).select("prompt", "run", F.col("tokens_per_second").alias("_base"))
    return runs.join(base, ["prompt", "run"], "left").withColumn("speedup_vs_baseline", F.when(F.col("_base") > 0, F.col("tokens_per_second") / F.col("_base"))).drop("_base")


def cache_grid(configs: DataFrame, lengths: list[int], widths: dict[str, float]) -> DataFrame:
    """Models (model, layers, heads, head_dim) x lengths x widths with cache sizes."""
    grid = configs.withColumn("seq_len", F.explode(F.array(*[F.lit(n).cast("bigint") for n in lengths])))
    grid = grid.withColumn("w", F.explode(F.array(*[F.struct(F.lit(k).alias("dtype"), F.lit(float(v)).alias("width")) for k, v in widths.items()]))).select("*", "w.dtype", "w.width")
    size = S.kv_cache_bytes(F.col("layers"), F.col("heads"), F.col("head_dim"), F.col("seq_len"), 1, F.col("width"))
    grid = grid.withColumn("bytes", size)
    return grid.select("model", "seq_len", "dtype", "bytes", (F.col("bytes") / MB).alias("mb"), (F.col("bytes") / MB / 1024).alias("gb"), (F.col("bytes") / F.col("layers")).alias("bytes_per_layer"), (F.col("bytes") / F.col("seq_len")).alias("bytes_per_token"))


def profile(sequences: DataFrame, techniques: list[str], layers: int, heads: int, head_dim: int) -> DataFrame:
    """Sequences (sequence_length and more) x techniques with the cache size of each."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(x).alias("technique")) for k, x in enumerate(techniques)]))
    grid = sequences.withColumn("_t", each).select("*", "_t.ord", "_t.technique").drop("_t")
    kept = S.technique_length(F.col("technique"), F.col("sequence_length"))
    size = S.kv_cache_bytes(F.lit(layers), F.lit(heads), F.lit(head_dim), kept, 1, S.technique_bytes(F.col("technique")))
    return grid.withColumn("kv_cache_mb", size / MB)


def profile_rollup(snapshots: DataFrame) -> DataFrame:
    """Per technique: peak and final size."""
    return snapshots.groupBy("technique").agg(F.min("ord").alias("ord"), F.max("kv_cache_mb").alias("peak_mb"), F.max_by("kv_cache_mb", "sequence_length").alias("final_mb"))


def compare_techniques(rollup: DataFrame, baseline: str = "fp16") -> DataFrame:
    """Adds savings_pct against the baseline's final size (0 without one) and is_best: the smallest, ties to the first. The rollup has a row per technique."""
    base = rollup.where(F.col("technique") == baseline).agg(F.max("final_mb").alias("_base"))
    best = rollup.agg(F.min_by("technique", F.struct("final_mb", "ord")).alias("_best"))
    rows = rollup.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(best))
    return rows.withColumn("savings_pct", F.coalesce((1 - F.col("final_mb") / F.nullif(F.col("_base"), F.lit(0.0))) * 100, F.lit(0.0))).withColumn("is_best", F.col("technique") == F.col("_best")).drop("_base", "_best")
