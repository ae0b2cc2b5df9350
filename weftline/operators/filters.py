"""Rule filters with rejection reasons, safety patterns, heuristics and staged filtering."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X

#: Phrases that mark a refusal.
BLOCKED_PHRASES = ["as an ai", "i cannot", "i'm sorry", "i apologize"]
#: Patterns of unsafe text, in the order in which they are reported.
UNSAFE_PATTERNS = [
    r"\b(kill|murder|attack|bomb|weapon)\b",
    r"\b(hack|exploit|vulnerability|crack)\b",
    r"\b(drug|narcotic|cocaine|heroin)\b",
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"\b\d{3}[-]?\d{2}[-]?\d{4}\b",
]


@dataclass(frozen=True)
class FilterConfig:
    min_quality: float = 0.5
    max_repetition: float = 0.5
    instruction_length: tuple[int, int] = (10, 500)
    response_length: tuple[int, int] = (50, 2000)
    blocked_phrases: list[str] = field(default_factory=lambda: list(BLOCKED_PHRASES))

    def stricter(self, **changes) -> FilterConfig:
        return replace(self, **changes)


def rejection_reason(config: FilterConfig = FilterConfig(), instruction: Column | None = None, response: Column | None = None, reward: Column | None = None, overall: Column | None = None) -> Column:  # noqa: B008
    """The first check that fails, or null; bounds pass. reward: whether reward scores exist; overall: their total (null: 1)."""
    i, r = X.text(F.col("instruction") if instruction is None else instruction), X.text(F.col("response") if response is None else response)
    (i_min, i_max), (r_min, r_max) = config.instruction_length, config.response_length
    out = F.when(F.length(i) < i_min, "instruction_too_short").when(F.length(i) > i_max, "instruction_too_long")
    out = out.when(F.length(r) < r_min, "response_too_short").when(F.length(r) > r_max, "response_too_long")
    if overall is not None:
        out = out.when((F.lit(True) if reward is None else reward) & (F.coalesce(overall, F.lit(1.0)) < config.min_quality), "low_quality_score")
    out = out.when(X.contains_any(r, config.blocked_phrases), "blocked_phrase")
    out = out.when(X.repetition_ratio(X.words(r, lower=True)) > config.max_repetition, "too_repetitive")
    return out.when((X.strip(i) == "") | (X.strip(r) == ""), "empty_content")


def unsafe_pattern(c: Column, patterns: list[str] | None = None, ascii: bool = False) -> Column:
    """The first pattern that is found, as its text, or null. No or an empty list: the default patterns. ascii: words and digits by ASCII."""
    return X.first_pattern(c, patterns or UNSAFE_PATTERNS, ascii)


def sample_text(instruction: Column, response: Column) -> Column:
    return F.concat(X.text(instruction), F.lit(" "), X.text(response))


def heuristics(instruction: Column, response: Column) -> Column:
    """Struct: repetition_ratio, instruction_overlap, sentence_count, avg_sentence_length, word_count."""
    asked, said = F.array_distinct(X.words(instruction, lower=True)), X.words(response, lower=True)
    sentences = X.count_chars(X.text(response), ".!?")
    overlap = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, said)) / F.size(asked)).otherwise(F.lit(0.0))
    return F.struct(X.repetition_ratio(said).alias("repetition_ratio"), overlap.alias("instruction_overlap"), sentences.alias("sentence_count"), (F.size(said) / F.greatest(sentences, F.lit(1))).alias("avg_sentence_length"), F.size(said).alias("word_count"))


#: An evaluator's reasons.
NOT_ADDRESSED, REPEATED, SHORT, LONG, LOW, BELOW = "Response doesn't address instruction", "Too much repetition", "Response too short", "Response too long", "Low quality score", "Below minimum score threshold"


def evaluation(h: Column, response: Column, overall: Column | None = None, response_length: tuple[int, int] = (50, 2000)) -> Column:
    """Struct passed, rejection_reason, length_valid, scored: of several failures the last counts; a score is looked at only if all else passes."""
    n = F.length(X.text(response))
    short, long_ = n < response_length[0], n > response_length[1]
    rule = F.coalesce(F.when(h["instruction_overlap"] < 0.1, F.lit(NOT_ADDRESSED)), F.when(h["repetition_ratio"] > 0.5, F.lit(REPEATED)), F.when(short, F.lit(SHORT)), F.when(long_, F.lit(LONG)))
    scored = rule.isNull() & overall.isNotNull() if overall is not None else F.lit(False)
    reason = F.coalesce(rule, F.when(scored & (overall < 0.3), F.lit(LOW))) if overall is not None else rule
    return F.struct(reason.isNull().alias("passed"), reason.alias("rejection_reason"), (~(short | long_)).alias("length_valid"), scored.alias("scored"))


def threshold_reason(passed: Column, overall: Column | None, least: float) -> Column:
    """Null if evaluated as passed and, where there is an overall score, that is at least ``least``."""
    below = F.lit(False) if overall is None else F.coalesce(overall < least, F.lit(False))
    return F.when(~passed | below, F.lit(BELOW))


def split_outputs(df: DataFrame, reason: str = "rejection_reason") -> tuple[DataFrame, DataFrame]:
    """(passed, rejected): two views of one tagged frame."""
    return df.where(F.col(reason).isNull()), df.where(F.col(reason).isNotNull())


def reason_counts(df: DataFrame, reason: str = "rejection_reason") -> DataFrame:
    """Rows by "passed" or "rejected_<reason>"."""
    return df.groupBy(F.coalesce(F.concat(F.lit("rejected_"), F.col(reason)), F.lit("passed")).alias("outcome")).agg(F.count("*").alias("n"))


def stage_summary(df: DataFrame, stage: str = "stage") -> DataFrame:
    """One row: rejected per stage, their total, and passed."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    s = F.col(stage)
    return df.agg(n(s == "quality").alias("quality_rejected"), n(s == "safety").alias("safety_rejected"), n(s == "diversity").alias("diversity_rejected"), n(s.isNotNull()).alias("total_rejected"), n(s.isNull()).alias("passed"))
