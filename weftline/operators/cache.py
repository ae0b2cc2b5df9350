"""Cache eviction over explicit logs of attention and access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def decayed_scores(updates: DataFrame, decay: float = 0.99, keys: tuple[str, ...] = ("layer", "token_idx"), order: str = "step", value: str = "weight") -> DataFrame:
    """score: s <- s * decay + x over each token's own updates, in closed form."""
    w = Window.partitionBy(*keys)
    left = F.count("*").over(w) - F.row_number().over(w.orderBy(order))
    return updates.withColumn("_left", left).groupBy(*keys).agg(F.sum(F.col(value) * F.pow(F.lit(decay), F.col("_left"))).alias("score"), F.count("*").alias("updates"))


def mean_attention(updates: DataFrame, keys: tuple[str, ...] = ("layer", "token_idx"), value: str = "weight") -> DataFrame:
    return updates.groupBy(*keys).agg(F.sum(value).alias("total"), F.count("*").alias("updates"), F.avg(value).alias("mean"))


def heavy_hitters(scores: DataFrame, share: float = 0.2, group: str = "layer", token: str = "token_idx", score: str = "mean") -> DataFrame:
    """The top max(1, floor(n * share)) tokens of each group; ties by token."""
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(F.desc(score), token))
    return scores.withColumn("_r", rank).withColumn("_n", F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share))).where("_r <= _n").drop("_r", "_n")


def evict_lowest(scores: DataFrame, n: int = 128, protected: int = 64, group: str = "layer", token: str = "token_idx", score: str = "score") -> DataFrame:
    """The n lowest scores of each group among tokens beyond the first ``protected``; ties by token."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(score, token))
    return scores.where(F.col(token) >= protected).withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def evict_light(scores: DataFrame, n: int = 128, protected: int = 64, share: float = 0.2, group: str = "layer", token: str = "token_idx", score: str = "mean") -> DataFrame:
    """The first n positions of each group that are neither heavy hitters nor protected."""
    heavy = heavy_hitters(scores, share, group, token, score).select(group, token)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(token))
    return scores.where(F.col(token) >= protected).join(heavy, [group, token], "left_anti").withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def last_access(log: DataFrame, group: str = "layer", token: str = "token_idx", order: str = "step") -> DataFrame:
    return log.groupBy(group, token).agg(F.max(order).alias("last_access"))


def evict_oldest(log: DataFrame, n: int = 128, protected: int = 64, group: str = "layer", token: str = "token_idx", order: str = "step") -> DataFrame:
    """The n least recently used unprotected tokens of each group; ties by token."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy("last_access", token))
    return last_access(log, group, token, order).where(F.col(token) >= protected).withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def evict(tokens: DataFrame, policy: str, **options) -> DataFrame:
    """Candidates by policy: attention, heavy_hitter or lru."""
    return {"attention": evict_lowest, "heavy_hitter": evict_light, "lru": evict_oldest}[policy](tokens, **options)


def remaining(tokens: DataFrame, evicted: DataFrame, keys: tuple[str, ...] = ("layer", "token_idx")) -> DataFrame:
    return tokens.join(evicted.select(*keys), list(keys), "left_anti")


def layer_stats(tokens: DataFrame, most: int, group: str = "layer") -> DataFrame:
    """Per layer: size and needs_eviction (size above ``most``)."""
    return tokens.groupBy(group).agg(F.count("*").alias("size")).withColumn("needs_eviction", F.col("size") > most)


def any_needs_eviction(stats: DataFrame) -> DataFrame:
    return stats.agg(F.coalesce(F.bool_or("needs_eviction"), F.lit(False)).alias("needs_eviction"))


def sliding_window(tokens: DataFrame, n: int, group: str = "layer", order: str = "step") -> DataFrame:
    """The most recent n of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return tokens.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def window_bytes(layers: int, heads: int, head_dim: int, window: int, batch: int = 1, width: int = 2) -> int:
    """What a sliding window allocates, however full it is."""
    return 2 * layers * batch * heads * window * head_dim * width
