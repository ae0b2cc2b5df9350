"""Score expressions: judge scores, answers, decoding ratios, cache sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import strip, text

#: Judge criteria with their weights in the overall score.
WEIGHTS = {"helpfulness": 0.3, "correctness": 0.3, "coherence": 0.2, "complexity": 0.1, "verbosity": 0.1}


def parse_scores(judge: Column) -> Column:
    """Struct of the five criteria from a judge's text: first "name: digit" as (digit - 1) / 4, else 0.5."""
    one = lambda name: F.coalesce((F.nullif(F.regexp_extract(text(judge), rf"(?i){name}:\s*(\d)", 1), F.lit("")).cast("double") - 1) / 4, F.lit(0.5))
    return F.struct(*[one(name).alias(name) for name in WEIGHTS])


def overall(scores: Column) -> Column:
    out = F.lit(0.0)
    for k, (name, weight) in enumerate(WEIGHTS.items()):
        out = scores[name] * weight if not k else out + scores[name] * weight
    return out


_NUMBER = r"[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|[+-]?(?i:nan|inf|infinity)"


def to_number(c: Column) -> Column:
    """A float as Python reads it (underscores between digits; no type suffix), without commas and per cent signs; null if it isn't one."""
    bare = strip(F.translate(text(c), ",%", ""))
    return F.when(bare.rlike(rf"\A({_NUMBER})\z"), F.translate(bare, "_", "").try_cast("double"))


def relaxed_match(output: Column, expected: Column, tolerance: float = 0.05) -> Column:
    """Equal but for case and outer space, or numerically within the tolerance of the expected value (0: exact)."""
    same = F.lower(strip(text(output))) == F.lower(strip(text(expected)))
    a, b = to_number(output), to_number(expected)
    near = F.when(b == 0, a == 0).otherwise(F.abs(a - b) / F.abs(b) <= tolerance)
    return same | F.coalesce(F.when(F.isnan(a) | F.isnan(b), F.lit(False)).otherwise(near), F.lit(False))


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is 0 or null."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(otherwise).cast("double"))


def acceptance(accepted: Column, total: Column) -> Column:
    return ratio(accepted, total)


def tokens_per_second(tokens: Column, ms: Column) -> Column:
    return ratio(tokens * 1000, ms)


def estimated_speedup(accepted: Column, total: Column, factor: int = 5) -> Column:
    """rate * factor + 1, or 1 if none was accepted."""
    return F.when(accepted > 0, acceptance(accepted, total) * factor + 1).otherwise(F.lit(1.0))


def accept_probability(p_target: Column, p_draft: Column) -> Column:
    return F.least(F.lit(1.0), p_target / (p_draft + 1e-10))


def residual(target: Column, draft: Column) -> Column:
    """Positive part of target - draft, renormalised; the target where that is (nearly) nothing."""
    left = F.zip_with(target, draft, lambda a, b: F.greatest(F.lit(0.0), a - b))
    total = F.aggregate(left, F.lit(0.0), lambda s, x: s + x)
    return F.when(total < 1e-6, target).otherwise(F.zip_with(left, F.array_repeat(total, F.size(left)), lambda x, t: x / (t + 1e-10)))


def kv_cache_bytes(layers: Column, heads: Column, head_dim: Column, seq_len: Column, batch: Column | int = 1, width: Column | float = 2) -> Column:
    """2 (keys and values) * layers * batch * heads * length * dim * bytes, in long arithmetic."""
    big = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("bigint")
    w = width if isinstance(width, Column) else F.lit(width)
    return F.lit(2).cast("bigint") * big(layers) * big(batch) * big(heads) * big(seq_len) * big(head_dim) * w


def technique_bytes(technique: Column) -> Column:
    """Bytes per value of a cache technique."""
    return F.when(technique == "int8", 1.0).when(technique == "int4", 0.5).otherwise(2.0)


def technique_length(technique: Column, seq_len: Column, window: int = 2048) -> Column:
    """Positions that a technique keeps."""
    return F.when(technique == "sliding_window", F.least(seq_len, F.lit(window).cast("bigint"))).otherwise(seq_len)


def low_rank_ratio(rows: Column, dim: Column, rank: Column, groups: Column | int = 1) -> Column:
    """Values before by values after a rank-r factorisation; ``groups`` (batch * heads) scales only the former."""
    g = groups if isinstance(groups, Column) else F.lit(groups)
    return (rows * dim * g).cast("double") / (rows * rank + rank + rank * dim)


def combined_ratio(bits: Column, low_rank: Column) -> Column:
    """Quantisation ratio from 16 bits, times the low-rank ratio."""
    return (F.lit(16.0) / bits) * low_rank


def quantized_bytes(n: Column, bits: Column, scales: Column, zero_points: Column | int = 0) -> Column:
    """n values at 8 bits, or two to a byte at 4, plus 2 bytes for each scale and zero point."""
    z = zero_points if isinstance(zero_points, Column) else F.lit(zero_points)
    return F.when(bits == 4, F.floor(n / 2)).otherwise(n).cast("bigint") + 2 * (scales + z)


def backoff_seconds(attempt: Column, base: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def loose_int(c: Column) -> Column:
    """A count as written in a sheet: a number, digits, or the last part of "label: digits"; else 0."""
    last = F.trim(F.element_at(F.split(c.cast("string"), ":"), -1))
    return F.coalesce(F.when(F.trim(c.cast("string")).rlike(r"\A-?\d+(\.\d*)?\z"), F.trim(c.cast("string")).try_cast("double").cast("bigint")), F.when(c.cast("string").contains(":"), last.try_cast("bigint")), F.lit(0).cast("bigint"))
