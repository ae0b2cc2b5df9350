"""Instruction-data curation: pair, evaluate, filter, sample, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import dedup, filters, metrics, sampling


#: Turns that a conversation may have.
TURNS = 1 << 20


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(id, instruction, response): user turns with the assistant turn right after; the id is conv_id * TURNS + turn."""
    ask = conversations.where("role = 'user'").select("conv_id", F.col("turn").alias("turn"), F.col("text").alias("instruction"))
    answer = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    turn = F.when(F.col("turn").between(0, TURNS - 1), F.col("turn")).otherwise(F.raise_error(F.lit(f"a turn beyond {TURNS}")).cast("bigint"))
    return ask.join(answer, ["conv_id", "turn"]).select((F.col("conv_id").cast("bigint") * TURNS + turn).alias("id"), "instruction", "response")


def curate(samples: DataFrame, config: filters.FilterConfig | None = None, safety: bool = True, diversity: bool = True, threshold: float = 0.85, patterns: list[str] | None = None, strict: bool = False, ascii: bool = False) -> DataFrame:
    """Adds heuristics, stage (quality, safety, diversity or null) and rejection_reason to (id, instruction, response).

    Each stage sees only what the one before passes.  strict: what the evaluation rejects fails the quality stage too.
    ascii: words and digits of the safety patterns by ASCII, as in SQL."""
    config = config or filters.FilterConfig()
    i, r = F.col("instruction"), F.col("response")
    rows = samples.withColumn("heuristics", filters.heuristics(i, r))
    quality = filters.rejection_reason(config)
    if strict:
        quality = F.coalesce(quality, filters.evaluation(F.col("heuristics"), r)["rejection_reason"])
    unsafe = filters.unsafe_pattern(filters.sample_text(i, r), patterns, ascii) if safety else F.lit(None).cast("string")
    rows = rows.withColumn("_q", quality).withColumn("_s", F.when(F.col("_q").isNull(), unsafe))
    if diversity:
        left = rows.where("_q is null and _s is null")
        keep = dedup.greedy_ngram_dedup(left, "id", "response", threshold)
        rows = rows.join(keep, "id", "left").withColumn("_d", F.when(~F.col("keep"), F.lit("duplicate"))).drop("keep")
    else:
        rows = rows.withColumn("_d", F.lit(None).cast("string"))
    stage = F.when(F.col("_q").isNotNull(), "quality").when(F.col("_s").isNotNull(), "safety").when(F.col("_d").isNotNull(), "diversity")
    return rows.withColumn("stage", stage).withColumn("rejection_reason", F.coalesce("_q", "_s", "_d")).drop("_q", "_s", "_d")


def run(samples: DataFrame, size: int | None = None, strategy: str = "random", **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept and sampled, all tagged, one-row diversity metrics)."""
    tagged = curate(samples, **options)
    kept = tagged.where("stage is null").withColumn("topic", sampling.topic(F.col("instruction")))
    if size:
        kept = sampling.diversity_sample(kept, size, strategy, "id", "id", topic="topic", strata="topic")
    return kept, tagged, metrics.diversity(kept, "topic", "response")
