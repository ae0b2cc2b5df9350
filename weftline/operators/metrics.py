"""Corpus metrics and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as X
from weftline.operators.dedup import durable


def entropy(df: DataFrame, column: str, name: str = "entropy") -> DataFrame:
    """One row: base-2 entropy of the column's values (0 for no rows)."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_t"))
    p = F.col("_n") / F.col("_t")
    return counts.crossJoin(F.broadcast(totals)).agg(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias(name))


def diversity(df: DataFrame, topic_col: str, response_col: str) -> DataFrame:
    """One row: topic_entropy, topic_distribution, length_std (population), vocab_size, avg_length."""
    topics = df.groupBy(topic_col).agg(F.count("*").alias("_n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(topic_col, "_n")))).alias("topic_distribution"))
    n = F.length(X.text(F.col(response_col)))
    lengths = df.agg(F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("length_std"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_length"))
    vocabulary = df.select(F.explode(X.words(F.col(response_col), lower=True)).alias("w")).agg(F.count_distinct("w").alias("vocab_size"))
    # each side is one row
    return entropy(df, topic_col, "topic_entropy").crossJoin(F.broadcast(topics)).crossJoin(F.broadcast(lengths)).crossJoin(F.broadcast(vocabulary))


#: A percentile's neighbourhood is found by a sketch of so many steps.
ACCURACY = 10_000
#: Up to so many groups, of a few numbers each, are sent to all tasks.
FEW = 100_000


def percentiles(df: DataFrame, column: str, shares: dict[str, float], group: str | None = None) -> DataFrame:
    """A row per group (one row without) with exact percentiles, linearly interpolated between neighbours; nulls don't count.

    shares: output name -> share in 0 .. 1.  A mergeable sketch gives two values that enclose the rank; then values
    below and above are only counted (with the nearest of each), and those between are counted one by one.  So no task
    holds a group: what meets in one is the values between, about 4 / ``ACCURACY`` of the group's distinct ones.  A rank
    that the sketch should have missed raises an error, it never gives another value."""
    names = list(shares)
    rows = df.select((F.col(group) if group else F.lit(0)).alias("g"), F.col(column).cast("double").alias("x")).where("x is not null")
    margin = 2 / ACCURACY
    points = [min(1.0, max(0.0, q + side * margin)) for q in shares.values() for side in (-1, 1)]
    sketch = durable(rows.groupBy("g").agg(F.percentile_approx("x", points, ACCURACY).alias("b")).withColumnRenamed("g", "g_"))
    bounded = rows.join(F.broadcast(sketch) if sketch.count() <= FEW else sketch, F.col("g").eqNullSafe(F.col("g_")))
    lo, hi = F.col("b")[F.col("i") * 2], F.col("b")[F.col("i") * 2 + 1]
    side = F.when(F.col("x") < lo, -1).when(F.col("x") > hi, 1).otherwise(0)
    each = bounded.select("g", "x", "b", F.explode(F.array(*[F.lit(k) for k in range(len(names))])).alias("i")).select("g", "i", "x", side.alias("side"))
    cells = each.groupBy("g", "i", "side", F.when(F.col("side") == 0, F.col("x")).alias("v")).agg(F.count("*").alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
    by = Window.partitionBy("g", "i")
    ranked = cells.withColumn("upto", F.sum("c").over(by.orderBy("side", "v"))).withColumn("n", F.sum("c").over(by))
    place = F.element_at(F.array(*[F.lit(float(q)) for q in shares.values()]), F.col("i") + 1) * (F.col("n") - 1)
    ranked = ranked.withColumn("place", place)

    def at(rank: Column) -> Column:
        missed = F.raise_error(F.lit("the sketch's bounds don't enclose a percentile")).cast("double")
        below = F.when(rank == F.col("upto") - 1, F.col("most")).otherwise(missed)
        above = F.when(rank == F.col("upto") - F.col("c"), F.col("least")).otherwise(missed)
        value = F.when(F.col("side") == 0, F.col("v")).when(F.col("side") < 0, below).otherwise(above)
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c")), value))

    found = ranked.groupBy("g", "i").agg(F.first("place").alias("place"), at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"))
    between = (F.ceil("place") - F.col("place")) * F.col("a") + (F.col("place") - F.floor("place")) * F.col("b")
    found = found.withColumn("value", F.when((F.floor("place") == F.ceil("place")) | (F.col("a") == F.col("b")), F.col("a")).otherwise(between))
    out = found.groupBy("g") if group else found.groupBy()
    wide = out.agg(*[F.max(F.when(F.col("i") == k, F.col("value"))).alias(name) for k, name in enumerate(names)])
    return wide.withColumnRenamed("g", group) if group else wide


def with_percentiles(grouped: DataFrame, df: DataFrame, column: str, shares: dict[str, float], group: str | None = None) -> DataFrame:
    """``grouped`` (a row per group of ``df``, or one row) with the percentiles of ``column`` by group."""
    own = percentiles(df, column, shares, group)
    if not group:
        return grouped.crossJoin(F.broadcast(own))  # one row each
    own = own.withColumnRenamed(group, "g_")
    return grouped.join(own, F.col(group).eqNullSafe(F.col("g_")), "left").drop("g_")


def summary(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """n, mean, median (exact), std (population), min, max."""
    c = F.col(column).cast("double")
    grouped = df.groupBy(group) if group else df.groupBy()
    whole = grouped.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    return with_percentiles(whole, df, column, {"median": 0.5}, group).select(*([group] if group else []), "n", "mean", "median", "std", "min", "max")


def box_stats(df: DataFrame, column: str, group: str) -> DataFrame:
    """Quartiles by group, linearly interpolated."""
    whole = df.groupBy(group).agg(F.count(F.col(column).cast("double")).alias("n"))
    return with_percentiles(whole, df, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, group)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin 0.., low, n): equal widths over [min, max]; the last bin is closed; empty bins are left out."""
    c = F.col(column).cast("double")
    ends = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    at = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(F.floor((c - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int"))
    rows = df.where(c.isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", at)
    return rows.groupBy("bin").agg((F.first("_lo") + F.col("bin") * (F.first("_hi") - F.first("_lo")) / bins).alias("low"), F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)
