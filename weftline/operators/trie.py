"""Token tries and decoding choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trie(candidates: DataFrame, order: str = "cand_ord", tokens: str = "tokens", probs: str = "probs") -> DataFrame:
    """Nodes (path, depth, token, prob, n): distinct prefixes; the first candidate's probability stays."""
    nodes = candidates.where(F.size(tokens) > 0).select(order, tokens, probs, F.explode(F.sequence(F.lit(1), F.size(tokens))).alias("d"))
    nodes = nodes.select(order, F.slice(F.col(tokens), F.lit(1), F.col("d")).alias("path"), F.element_at(F.col(probs), F.col("d")).alias("p"))
    return nodes.groupBy("path").agg(F.min_by("p", order).alias("prob"), F.count("*").alias("n")).select("path", (F.size("path") - 1).alias("depth"), F.element_at("path", -1).alias("token"), "prob", "n")


def leaves(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths, in depth-first order of their tokens."""
    inner = nodes.where(F.size("path") > 1).select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct()
    return nodes.join(inner, "path", "left_anti").select("path", (F.size("path")).alias("length")).orderBy("path")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(path, ancestor): what each node attends to, itself included."""
    return nodes.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("ancestor"))


def candidate_product(top: DataFrame, positions: int, width: int = 64) -> DataFrame:
    """The first ``width`` combinations, in order of ranks, of (position, rank, token): one token from each position.

    Each position adds its ranks to at most ``width`` combinations, as later ones can't come first again."""

    def extend(done: DataFrame, k: int) -> DataFrame:
        own = top.where(F.col("position") == k).select(F.col("rank").alias("_r"), F.col("token").alias("_t"))
        return done.crossJoin(F.broadcast(own.orderBy("_r").limit(width))).select(F.concat("ranks", F.array("_r")).alias("ranks"), F.concat("tokens", F.array("_t")).alias("tokens")).orderBy("ranks").limit(width)

    start = top.where("position = 0").select(F.array("rank").alias("ranks"), F.array("token").alias("tokens")).orderBy("ranks").limit(width)
    return reduce(extend, range(1, positions), start)


def accepted_prefix(candidates: DataFrame, prediction: str = "prediction", tokens: str = "tokens") -> DataFrame:
    """Adds accepted: how many leading tokens agree with the prediction."""
    same = F.zip_with(tokens, prediction, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return candidates.withColumn("accepted", F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int"))


def best_candidate(candidates: DataFrame, group: str, order: str = "cand_ord") -> DataFrame:
    """The candidate of each group with most accepted tokens; ties to the first."""
    return candidates.groupBy(group).agg(F.max_by(order, F.struct("accepted", -F.col(order))).alias(order), F.max("accepted").alias("accepted"))


def top_k(logits: DataFrame, k: int, group: str, logit: str = "logit") -> DataFrame:
    """Values at least as large as the k-th largest of each group (ties stay)."""
    return logits.withColumn("_r", F.rank().over(Window.partitionBy(group).orderBy(F.desc(logit)))).where(F.col("_r") <= k).drop("_r")


def nucleus(probs: DataFrame, p: float, group: str, token: str = "token", prob: str = "prob") -> DataFrame:
    """Values, largest first, while those before don't add up to more than p; the first always stays."""
    before = F.sum(prob).over(Window.partitionBy(group).orderBy(F.desc(prob), token).rowsBetween(Window.unboundedPreceding, -1))
    return probs.withColumn("_b", F.coalesce(before, F.lit(0.0))).where(F.col("_b") <= p).drop("_b")


def shifted_labels(tokens: DataFrame, heads: int, group: str, order: str, token: str = "token") -> DataFrame:
    """Adds label_0 .. : head i is to predict the token i + 1 places on."""
    w = Window.partitionBy(group).orderBy(order)
    return tokens.select("*", *[F.lead(token, i + 1).over(w).alias(f"label_{i}") for i in range(heads)])
