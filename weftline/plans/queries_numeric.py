"""Queries of benchmark aggregates, cache profiles, array kernels, eviction and tries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import scores as S
from weftline.operators import benchmarks, cache, trie, vectors
from weftline.plans.support import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql
R = 6
LENGTHS = [4096, 8192, 16384, 32768]
WIDTHS = {"fp16": 2.0, "int8": 1.0, "int4": 0.5}
TECHNIQUES = ["fp16", "int8", "int4", "sliding_window"]


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as benchmark runs: type as method, value as latency; a metric is missing for some."""
    e = table(spark, d, "events")
    rate = F.when(F.col("event_id") % 4 != 0, F.col("value") / 100)
    return e.select(F.col("event_type").alias("method"), (F.col("user_id") % 50).cast("string").alias("prompt"), F.col("event_id").alias("run"), F.col("value").alias("total_time_ms"), S.tokens_per_second(F.lit(64), F.col("value")).alias("tokens_per_second"), rate.alias("acceptance_rate"), F.when(F.col("event_type") == "none", 1.0).alias("speedup_vs_baseline"), (F.col("value") * 2).alias("memory_used_mb"))


_RUNS = "runs AS (SELECT event_type AS method, user_id % 50 AS prompt, event_id AS run, value AS ms, coalesce(64000 / nullif(value, 0), 0) AS tps, CASE WHEN event_id % 4 <> 0 THEN value / 100 END AS rate FROM events)"


@query(f"WITH {_RUNS} SELECT method, count(*) AS num_runs, round(avg(tps), {R}) AS avg_tokens_per_second, round(stddev_pop(tps), {R}) AS std_tokens_per_second, round(avg(rate), {R}) AS avg_acceptance_rate, CAST(NULL AS DOUBLE) AS avg_speedup, round(avg(ms * 2), {R}) AS avg_memory_mb, round(quantile_cont(ms, 0.5), {R}) AS p50_latency_ms, round(quantile_cont(ms, 0.9), {R}) AS p90_latency_ms, round(quantile_cont(ms, 0.99), {R}) AS p99_latency_ms FROM runs GROUP BY 1")
def a13_bench_agg(spark: SparkSession, d: str) -> DataFrame:
    out = benchmarks.run_summary(_runs(spark, d))
    return out.select("method", "num_runs", *[F.round(c, R).alias(c) for c in out.columns[2:]])


@query(f"WITH {_RUNS} SELECT method, round(sum(floor(ms / 3)) / sum(floor(ms)), {R}) AS acceptance_rate, round(count(*) * 64000 / sum(ms), {R}) AS tokens_per_second, count(*) AS n FROM runs GROUP BY 1")
def a14_ratio_of_sums(spark: SparkSession, d: str) -> DataFrame:
    rows = _runs(spark, d).select("method", "prompt", F.floor(F.col("total_time_ms") / 3).alias("accepted"), F.floor("total_time_ms").alias("drafted"), F.lit(64).alias("tokens"), F.col("total_time_ms").alias("ms"))
    out = benchmarks.decoder_summary(rows, "method")
    return out.select("method", F.round("acceptance_rate", R).alias("acceptance_rate"), F.round("tokens_per_second", R).alias("tokens_per_second"), "n")


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS tps FROM lineitem) SELECT a.l_orderkey AS prompt, a.l_linenumber AS run, round(a.tps / CASE WHEN b.tps > 0 THEN b.tps END, {R}) AS speedup_vs_baseline
FROM o a LEFT JOIN o b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = 1""")
def j6_baseline_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as runs: the first is the baseline."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("prompt"), F.lit(0).alias("run"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") == 1, "autoregressive").otherwise("other").alias("method"), F.col("l_extendedprice").alias("tokens_per_second"))
    return benchmarks.paired_speedup(rows).select("prompt", F.col("line").alias("run"), F.round("speedup_vs_baseline", R).alias("speedup_vs_baseline"))


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce(l_linenumber / nullif(l_quantity, 0), 0), {R}) AS acceptance_rate, round(coalesce(l_quantity * 1000 / nullif(l_extendedprice, 0), 0), {R}) AS tokens_per_second, round(CASE WHEN l_linenumber > 0 THEN coalesce(l_linenumber / nullif(l_quantity, 0), 0) * 5 + 1 ELSE 1 END, {R}) AS speedup FROM lineitem")
def f38_decoding_ratios(spark: SparkSession, d: str) -> DataFrame:
    n, q, p = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.acceptance(n, q), R).alias("acceptance_rate"), F.round(S.tokens_per_second(q, p), R).alias("tokens_per_second"), F.round(S.estimated_speedup(n, q), R).alias("speedup"))


@query(f"SELECT l_orderkey, l_linenumber, round(least(1, l_discount / (l_tax + 1e-10)), {R}) AS p FROM lineitem")
def f39_accept_probability(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.accept_probability(F.col("l_discount"), F.col("l_tax")), R).alias("p"))


_POS = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))"


@query(f"WITH a AS (SELECT vec_id, {_POS} AS t, list_reverse({_POS}) AS q FROM embeddings), r AS (SELECT vec_id, t, list_transform(range(1, 65), lambda i: greatest(0, t[i] - q[i])) AS l FROM a) SELECT vec_id, list_transform(l, lambda x: round(x / (list_sum(l) + 1e-10), {R})) AS residual FROM r")
def f40_residual(spark: SparkSession, d: str) -> DataFrame:
    t = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.transform(S.residual(t, F.reverse(t)), lambda x: F.round(x, R)).alias("residual"))


_GRID = f"""WITH n(seq_len) AS (VALUES {", ".join(f"({x})" for x in LENGTHS)}), w(dtype, width) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in WIDTHS.items())}), c AS (SELECT p_partkey AS model, p_size AS layers, p_partkey % 8 * 8 + 8 AS heads, 128 AS head_dim FROM part),
g AS (SELECT *, CAST(2::BIGINT * layers * heads * seq_len * head_dim * width AS DOUBLE) AS bytes FROM c, n, w)"""


@query(f"{_GRID} SELECT model, CAST(seq_len AS BIGINT) AS seq_len, dtype, bytes, bytes / 1048576 AS mb, bytes / 1048576 / 1024 AS gb, bytes / layers AS bytes_per_layer, bytes / seq_len AS bytes_per_token FROM g")
def f41_kv_grid(spark: SparkSession, d: str) -> DataFrame:
    """Parts as models: size as layers, heads by number."""
    p = table(spark, d, "part")
    models = p.select(F.col("p_partkey").alias("model"), F.col("p_size").alias("layers"), (F.col("p_partkey") % 8 * 8 + 8).alias("heads"), F.lit(128).alias("head_dim"))
    return benchmarks.cache_grid(models, LENGTHS, WIDTHS)


_PROF = """s AS (SELECT doc_id, k AS ord, t AS technique, n_chars AS n, CASE WHEN t = 'sliding_window' THEN least(n_chars, 2048) ELSE n_chars END AS kept, CASE t WHEN 'int8' THEN 1.0 WHEN 'int4' THEN 0.5 ELSE 2.0 END AS w FROM documents, (VALUES (0, 'fp16'), (1, 'int8'), (2, 'int4'), (3, 'sliding_window')) v(k, t)),
p AS (SELECT doc_id, ord, technique, n AS sequence_length, CAST(2::BIGINT * 32 * 32 * kept * 128 * w / 1048576 AS DOUBLE) AS kv_cache_mb FROM s)"""


@query(f"WITH {_PROF} SELECT * FROM p")
def f42_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sequences of their characters."""
    sequences = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("bigint").alias("sequence_length"))
    return benchmarks.profile(sequences, TECHNIQUES, 32, 32, 128)


@query(f"WITH {_PROF}, r AS (SELECT technique, CAST(min(ord) AS INT) AS ord, max(kv_cache_mb) AS peak_mb, arg_max(kv_cache_mb, sequence_length) AS final_mb FROM p GROUP BY 1) SELECT *, (1 - final_mb / (SELECT final_mb FROM r WHERE technique = 'fp16')) * 100 AS savings_pct, technique = (SELECT arg_min(technique, (final_mb, ord)) FROM r) AS is_best FROM r")
def a17_a18_profile(spark: SparkSession, d: str) -> DataFrame:
    return benchmarks.compare_techniques(benchmarks.profile_rollup(f42_profile(spark, d)))


_RATIO = "CAST(CAST(n_chars AS BIGINT) * 128 * 8 AS DOUBLE) / (CAST(n_chars AS BIGINT) * 16 + 16 + 16 * 128)"


@query(f"SELECT doc_id, round({_RATIO}, {R}) AS low_rank, round(4 * {_RATIO}, {R}) AS combined, CAST(n_chars // 2 + 32 AS BIGINT) AS bytes FROM documents")
def f43_compression(spark: SparkSession, d: str) -> DataFrame:
    """Documents as matrices of a row per character, at rank 16."""
    n = F.col("n_chars").cast("bigint")
    ratio = S.low_rank_ratio(n, F.lit(128), F.lit(16), 8)
    return table(spark, d, "documents").select("doc_id", F.round(ratio, R).alias("low_rank"), F.round(S.combined_ratio(F.lit(4), ratio), R).alias("combined"), S.quantized_bytes(n, F.lit(4), F.lit(16)).cast("bigint").alias("bytes"))


_E = "CAST(embedding AS DOUBLE[])"
_SCALE = f"greatest(list_max(list_transform({_E}, lambda x: abs(x))) / 127, 1e-8)"


@query(f"SELECT vec_id, round({_SCALE}, 9) AS scale, list_transform({_E}, lambda x: CAST(greatest(-128, least(127, round_even(x / {_SCALE}, 0))) AS SMALLINT)) AS q FROM embeddings")
def n1_quantize(spark: SparkSession, d: str) -> DataFrame:
    scale = vectors.symmetric_scale(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(scale, 9).alias("scale"), vectors.quantize_symmetric(F.col("embedding"), scale).alias("q"))


@query(f"WITH p AS (SELECT vec_id, unnest({_E}) AS x, unnest(range(64)) AS i FROM embeddings), s AS (SELECT i, greatest(max(abs(x)) / 127, 1e-8) AS s FROM p GROUP BY 1) SELECT vec_id, list(CAST(greatest(-128, least(127, round_even(x / s, 0))) AS SMALLINT) ORDER BY i) AS q FROM p JOIN s USING (i) GROUP BY 1")
def n2_quantize_channels(spark: SparkSession, d: str) -> DataFrame:
    return vectors.quantize_channels(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"WITH a AS (SELECT vec_id, {_E} AS e, list_min({_E}) AS lo, greatest((list_max({_E}) - list_min({_E})) / 255, 1e-8) AS s FROM embeddings), z AS (SELECT *, greatest(0, least(255, round_even(-lo / s, 0))) AS z FROM a) SELECT vec_id, round(s, 9) AS scale, CAST(z AS DOUBLE) AS zero_point, list_transform(e, lambda x: CAST(greatest(0, least(255, round_even(x / s + z, 0))) AS SMALLINT)) AS q FROM z")
def n3_quantize_asymmetric(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "embeddings").select("vec_id", vectors.quantize_asymmetric(F.col("embedding")).alias("a"))
    return a.select("vec_id", F.round("a.scale", 9).alias("scale"), F.col("a.zero_point").cast("double").alias("zero_point"), "a.q")


@query(f"WITH q AS (SELECT {_E} AS e, {_SCALE} AS s FROM embeddings), d AS (SELECT unnest(e) AS a, unnest(list_transform(e, lambda x: greatest(-128, least(127, round_even(x / s, 0))) * s)) AS b FROM q) SELECT round(avg((a - b) * (a - b)), 9) AS mse, round(avg(abs(a - b)), 9) AS mae, round(max(abs(a - b)), 9) AS max_error, round(20 * log10(max(abs(a)) / sqrt(avg((a - b) * (a - b)) + 1e-10)), 4) AS psnr FROM d")
def a22_quantization_error(spark: SparkSession, d: str) -> DataFrame:
    scale = vectors.symmetric_scale(F.col("embedding"))
    rows = table(spark, d, "embeddings").select("embedding", vectors.dequantize(vectors.quantize_symmetric(F.col("embedding"), scale), scale).alias("restored"))
    e = vectors.error_stats(rows, "embedding", "restored")
    return e.select(*[F.round(c, 9).alias(c) for c in ("mse", "mae", "max_error")], F.round("psnr", 4).alias("psnr"))


@query("SELECT l_orderkey, list(((l_linenumber % 16) + 16 * ((l_linenumber + 1) % 16)) ORDER BY l_linenumber) AS packed, list(CASE WHEN l_linenumber % 16 > 7 THEN l_linenumber % 16 - 16 ELSE l_linenumber % 16 END ORDER BY l_linenumber) AS firsts FROM lineitem GROUP BY 1")
def n5_int4_pack(spark: SparkSession, d: str) -> DataFrame:
    """Each line number with the next as two 4-bit values."""
    two = lambda n: F.array(n, n + 1)
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"))
    packed = F.flatten(F.transform("n", lambda n: vectors.pack_int4(two(n))))
    return rows.select("l_orderkey", packed.alias("packed"), F.transform(packed, lambda b: vectors.unpack_int4(F.array(b), F.lit(1))[0]).alias("firsts"))


_WIDTH = "SELECT CAST({bits} AS INT) AS bits, t.n * {bits} / 8 + 2 * t.rows AS bytes, round(t.n * 2 / (t.n * {bits} / 8 + 2 * t.rows), {r}) AS ratio, round(avg((a - b) * (a - b)), {r}) AS mse, round(avg(abs(a - b)), {r}) AS mae, round(max(abs(a - b)), {r}) AS max_error FROM (SELECT unnest(e) AS a, unnest(list_transform(e, lambda x: greatest(-{low}, least({low} - 1, round_even(x / s, 0))) * s)) AS b FROM (SELECT e, greatest(list_max(list_transform(e, lambda x: abs(x))) / ({low} - 1), 1e-8) AS s FROM v)), t GROUP BY t.n, t.rows"


@query(f"""WITH v AS (SELECT {_E} AS e FROM embeddings), t AS (SELECT sum(len(e)) AS n, count(*) AS rows FROM v)
SELECT 16 AS bits, CAST(n * 2 AS DOUBLE) AS bytes, 1.0::DOUBLE AS ratio, 0.0::DOUBLE AS mse, 0.0::DOUBLE AS mae, 0.0::DOUBLE AS max_error FROM t UNION ALL {_WIDTH.format(bits=8, low=128, r=R)} UNION ALL {_WIDTH.format(bits=4, low=8, r=R)}""")
def n6_compare_widths(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.compare_widths(table(spark, d, "embeddings"), "embedding")
    return out.select("bits", *[F.round(c, R).alias(c) for c in out.columns[1:]])


@query()
def n7_low_rank(spark: SparkSession, d: str) -> DataFrame:
    factors, _, _ = vectors.low_rank(table(spark, d, "embeddings"), "vec_id", "embedding", 0.9)
    return factors.select("vec_id", F.size("u").alias("rank"))


@query("WITH s AS (SELECT l_orderkey, l_quantity AS v, sum(l_quantity * l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber ROWS UNBOUNDED PRECEDING) / sum(l_quantity * l_quantity) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) SELECT l_orderkey, least(count(*) FILTER (c < 0.95) + 1, count(*), 5) AS rank FROM s GROUP BY 1")
def n7_energy_rank(spark: SparkSession, d: str) -> DataFrame:
    return vectors.energy_rank(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", 0.95, 5).select("l_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT vec_id, CAST(label * 2 + g AS INT) AS query_head FROM embeddings, (VALUES (0), (1)) t(g)")
def n9_expand_heads(spark: SparkSession, d: str) -> DataFrame:
    return vectors.expand_heads(table(spark, d, "embeddings"), "label", 2, 10, 20).select("vec_id", "query_head")


@query()
def n10_combined_compressor(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = vectors.compress(table(spark, d, "embeddings"), "vec_id", "embedding", share=0.9)
    return rows.select("vec_id", F.size("q").alias("rank"), F.round("scale", 9).alias("scale"))


@query(f"""WITH a AS (SELECT vec_id, {_E} AS e, {_SCALE} AS s FROM embeddings), j AS (SELECT vec_id, list_concat(list_transform(e, lambda x: greatest(-128, least(127, round_even(x / s, 0))) * s), e[1:4]) AS x FROM a), z AS (SELECT vec_id, x, greatest(list_max(list_transform(x, lambda v: abs(v))) / 127, 1e-8) AS s FROM j)
SELECT vec_id, list_transform(x, lambda v: CAST(greatest(-128, least(127, round_even(v / s, 0))) AS SMALLINT)) AS q, round(s, 9) AS scale FROM z""")
def n11_cache_append(spark: SparkSession, d: str) -> DataFrame:
    scale = vectors.symmetric_scale(F.col("embedding"))
    rows = table(spark, d, "embeddings").select("vec_id", vectors.cache_append(vectors.quantize_symmetric(F.col("embedding"), scale), scale, F.slice("embedding", 1, 4)).alias("c"))
    return rows.select("vec_id", "c.q", F.round("c.scale", 9).alias("scale"))


@query(f"SELECT CAST(sum(l_linenumber * 128) AS BIGINT) AS n_values, CAST(sum(l_linenumber * 64 + 2 * l_linenumber) AS BIGINT) AS bytes, CAST(sum(l_linenumber * 256) AS BIGINT) AS fp16_bytes, round(sum(l_linenumber * 256) / sum(l_linenumber * 66), {R}) AS ratio FROM lineitem")
def a23_cache_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.lit(4).alias("bits"), (F.col("l_linenumber") * 128).alias("n"), F.col("l_linenumber").alias("scales"))
    return vectors.cache_stats(rows, "bits", "n", "scales").withColumn("ratio", F.round("ratio", R))


def _updates(spark: SparkSession, d: str) -> DataFrame:
    """Events as attention updates: user as token, type as layer."""
    return table(spark, d, "events").select(F.col("event_type").alias("layer"), (F.col("user_id") % 300).cast("int").alias("token_idx"), F.col("event_id").alias("step"), F.col("value").alias("weight"))


_UPD = "u AS (SELECT event_type AS layer, CAST(user_id % 300 AS INT) AS token_idx, event_id AS step, value AS weight FROM events)"
_DECAY = f"{_UPD}, d AS (SELECT layer, token_idx, sum(weight * pow(0.99, k)) AS score, count(*) AS updates FROM (SELECT *, count(*) OVER (PARTITION BY layer, token_idx) - row_number() OVER (PARTITION BY layer, token_idx ORDER BY step) AS k FROM u) GROUP BY 1, 2)"
_MEAN = f"{_UPD}, m AS (SELECT layer, token_idx, sum(weight) AS total, count(*) AS updates, avg(weight) AS mean FROM u GROUP BY 1, 2), hh AS (SELECT layer, token_idx FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY mean DESC, token_idx) AS r, greatest(1, floor(count(*) OVER (PARTITION BY layer) * 0.2)) AS n FROM m) WHERE r <= n)"


@query(f"WITH {_DECAY} SELECT layer, token_idx, round(score, {R}) AS score, updates FROM d")
def a21_decayed_scores(spark: SparkSession, d: str) -> DataFrame:
    return cache.decayed_scores(_updates(spark, d)).withColumn("score", F.round("score", R))


@query(f"WITH {_MEAN} SELECT * FROM hh")
def a20_heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    return cache.heavy_hitters(cache.mean_attention(_updates(spark, d))).select("layer", "token_idx")


@query(f"WITH {_DECAY} SELECT layer, token_idx FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY score, token_idx) AS r FROM d WHERE token_idx >= 64) WHERE r <= 16")
def t9_evict_attention(spark: SparkSession, d: str) -> DataFrame:
    return cache.evict(cache.decayed_scores(_updates(spark, d)), "attention", n=16).select("layer", "token_idx")


@query(f"WITH {_MEAN} SELECT layer, token_idx FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY token_idx) AS r FROM m WHERE token_idx >= 64 AND (layer, token_idx) NOT IN (SELECT (layer, token_idx) FROM hh)) WHERE r <= 16")
def t10_evict_heavy_hitter(spark: SparkSession, d: str) -> DataFrame:
    return cache.evict(cache.mean_attention(_updates(spark, d)), "heavy_hitter", n=16).select("layer", "token_idx")


@query(f"WITH {_UPD}, a AS (SELECT layer, token_idx, max(step) AS last_access FROM u GROUP BY 1, 2) SELECT layer, token_idx, last_access FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY last_access, token_idx) AS r FROM a WHERE token_idx >= 64) WHERE r <= 16")
def t11_w9_evict_lru(spark: SparkSession, d: str) -> DataFrame:
    return cache.evict(_updates(spark, d), "lru", n=16)


@query(f"WITH {_UPD} SELECT layer, step FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY step DESC) AS r FROM u) WHERE r <= 100")
def w8_sliding_window(spark: SparkSession, d: str) -> DataFrame:
    return cache.sliding_window(_updates(spark, d), 100).select("layer", "step")


@query(f"WITH {_UPD} SELECT layer, count(*) AS size, count(*) > 290 AS needs_eviction FROM (SELECT DISTINCT layer, token_idx FROM u) GROUP BY 1")
def a24_layer_stats(spark: SparkSession, d: str) -> DataFrame:
    return cache.layer_stats(_updates(spark, d).select("layer", "token_idx").distinct(), 290)


@query(f"WITH {_MEAN} SELECT layer, token_idx FROM m WHERE (layer, token_idx) NOT IN (SELECT (layer, token_idx) FROM hh)")
def x7_remaining(spark: SparkSession, d: str) -> DataFrame:
    means = cache.mean_attention(_updates(spark, d))
    return cache.remaining(means, cache.heavy_hitters(means)).select("layer", "token_idx")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Orders' part numbers (mod 7) as token candidates, tax as probability."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 7).cast("int").alias("t"), "l_tax"))).alias("a"))
    return rows.select(F.col("l_orderkey").alias("cand_ord"), F.transform("a", lambda s: s["t"]).alias("tokens"), F.transform("a", lambda s: s["l_tax"]).alias("probs"))


_CAND = "c AS (SELECT l_orderkey AS o, list(CAST(l_partkey % 7 AS INT) ORDER BY l_linenumber, l_partkey % 7, l_tax) AS tokens, list(l_tax ORDER BY l_linenumber, l_partkey % 7, l_tax) AS probs FROM lineitem GROUP BY 1), nodes AS (SELECT path, arg_min(p, o) AS prob, count(*) AS n FROM (SELECT o, tokens[1:i] AS path, probs[i] AS p FROM c, unnest(range(1, len(tokens) + 1)) AS t(i)) GROUP BY 1)"


@query(f"WITH {_CAND} SELECT path, CAST(len(path) - 1 AS INT) AS depth, path[-1] AS token, prob, n FROM nodes")
def d7_trie(spark: SparkSession, d: str) -> DataFrame:
    return trie.trie(_candidates(spark, d))


@query(f"WITH {_CAND} SELECT path, CAST(len(path) AS INT) AS length FROM nodes WHERE path NOT IN (SELECT path[:-2] FROM nodes WHERE len(path) > 1)")
def d8_leaves(spark: SparkSession, d: str) -> DataFrame:
    return trie.leaves(trie.trie(_candidates(spark, d)))


@query(f"WITH {_CAND} SELECT array_to_string(path, '.') AS path, count(*) AS n FROM (SELECT path, unnest(range(1, len(path) + 1)) AS k FROM nodes) GROUP BY 1")
def j11_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return trie.ancestors(trie.trie(_candidates(spark, d))).groupBy(F.array_join(F.col("path").cast("array<string>"), ".").alias("path")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_linenumber - 1 AS p, CAST(l_suppkey % 40 AS INT) AS token, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), t AS (SELECT p, token, row_number() OVER (PARTITION BY p ORDER BY n DESC, token) - 1 AS r FROM c)
SELECT [x.token, y.token, z.token] AS tokens FROM t x, t y, t z WHERE x.p = 0 AND y.p = 1 AND z.p = 2 ORDER BY x.r, y.r, z.r LIMIT 64""")
def j10_candidate_product(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers (mod 40) as tokens, line numbers as positions, ranked by how often they occur there."""
    counts = table(spark, d, "lineitem").where("l_linenumber <= 3").groupBy((F.col("l_linenumber") - 1).alias("position"), (F.col("l_suppkey") % 40).cast("int").alias("token")).agg(F.count("*").alias("n"))
    # a row per position and token
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("position").orderBy(F.desc("n"), "token")) - 1)
    return trie.candidate_product(top, 3).select("tokens")


@query(f"WITH {_CAND}, a AS (SELECT o, o // 8 AS g, coalesce(list_position(list_transform(range(1, len(tokens) + 1), lambda i: coalesce(tokens[i] = (3 * i + o) % 7, false)), false) - 1, len(tokens)) AS accepted FROM c) SELECT g, arg_max(o, (accepted, -o)) AS cand_ord, CAST(max(accepted) AS INT) AS accepted FROM a GROUP BY 1")
def j12_prefix_verification(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).withColumn("prediction", F.transform("tokens", lambda x, i: ((i + 1) * 3 + F.col("cand_ord")) % 7)).withColumn("g", F.floor(F.col("cand_ord") / 8))
    return trie.best_candidate(trie.accepted_prefix(rows), "g")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 2")
def w5_top_k(spark: SparkSession, d: str) -> DataFrame:
    return trie.top_k(table(spark, d, "lineitem"), 2, "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, sum(l_tax) OVER (PARTITION BY l_orderkey ORDER BY l_tax DESC, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lineitem) WHERE coalesce(b, 0) <= 0.075")
def w6_nucleus(spark: SparkSession, d: str) -> DataFrame:
    return trie.nucleus(table(spark, d, "lineitem"), 0.075, "l_orderkey", "l_linenumber", "l_tax").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, lead(l_partkey, 1) OVER w AS label_0, lead(l_partkey, 2) OVER w AS label_1 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)")
def w7_shifted_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey"))
    return trie.shifted_labels(rows, 2, "l_orderkey", "place", "l_partkey").select("l_orderkey", "l_linenumber", "label_0", "label_1")
