"""Running values and dense numbers over one long sequence, without a window over the whole of it.

A sequence (a log file, a month's entries) is cut into parts.  Windows run inside a part; each part is summed up in one
row, the rows are combined in order, and what a part takes over from those before it is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.dedup import durable

#: Range of the ordering number that makes a part; numbers are distinct in a sequence, so a part has as many rows at most.
SPAN = 100_000


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null; the right side's key columns go."""
    named = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    meet = F.lit(True)
    for i, k in enumerate(keys):
        meet &= F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return left.join(named, meet, "left").drop(*[f"_r{i}" for i in range(len(keys))])


def _part(order: str, span: int) -> Column:
    return F.expr(f"`{order}` div {span}")


def filled(df: DataFrame, value: Column, name: str, keys: list[str], order: str, span: int = SPAN) -> DataFrame:
    """Adds ``name``: the last value so far that isn't null, in each sequence by ``keys`` in order of the integer ``order``."""
    marked = df.withColumn("_part", _part(order, span)).withColumn("_value", value)
    local = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = marked.groupBy(*keys, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_part", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    rows = _joined(marked.withColumn("_local", F.last("_value", ignorenulls=True).over(local)), carried, [*keys, "_part"])
    return rows.withColumn(name, F.coalesce("_local", "_before")).drop("_part", "_value", "_local", "_before")


def islands(df: DataFrame, opens: Column, flag: Column, keys: list[str], order: str, span: int = SPAN) -> DataFrame:
    """The rows that open an island, with ``flag``: whether it holds on any row from there to the next opening row of the sequence."""
    marked = df.withColumn("_part", _part(order, span)).withColumn("_opens", F.coalesce(opens, F.lit(False))).withColumn("_flag", F.coalesce(flag, F.lit(False)))
    by = [*keys, "_part"]
    number = F.sum(F.col("_opens").cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_island", number)
    # a part's rows before its first opening row belong to the last island of the parts before
    parts = marked.groupBy(*by).agg(F.max("_island").alias("_n"), F.max(F.when(F.col("_island") == 0, F.col("_flag"))).alias("_head"))
    group = F.sum((F.col("_n") > 0).cast("int")).over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("_group", group)
    late = parts.groupBy(*keys, F.when(F.col("_n") > 0, F.col("_group") - 1).otherwise(F.col("_group")).alias("_group")).agg(F.max("_head").alias("_late"))
    closing = _joined(parts.where("_n > 0").select(*by, "_n", "_group"), late, [*keys, "_group"]).drop("_group")
    inside = F.max("_flag").over(Window.partitionBy(*by, "_island"))
    opening = marked.withColumn("_any", inside).where("_opens")
    rows = _joined(opening, closing, by)
    found = F.col("_any") | ((F.col("_island") == F.col("_n")) & F.coalesce("_late", F.lit(False)))
    return rows.withColumn("flag", found).drop("_part", "_opens", "_flag", "_island", "_any", "_n", "_late")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, 3 .. in each sequence by ``keys`` in ``order``.

    Rows are dealt into ranges of keys and order; a range numbers its own rows, and counts of earlier ranges are added."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written down, as another run of the same plan may draw other bounds
    dealt = durable(df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    by = [*keys, "_range"]
    counts = dealt.groupBy(*by).agg(F.count("*").alias("_c"))
    before = counts.select(*by, F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    local = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return _joined(local, before, by).withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_nth")).cast("bigint")).drop("_range", "_nth", "_before")
