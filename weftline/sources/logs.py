"""Application logs: file choice, sessions, errors, merge, idempotent append, monthly report."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.functions import text as X
from weftline.operators.dedup import durable
from weftline.operators.scans import filled, islands, numbered

#: What the log's lines look like.
SESSION = r"session_[a-z0-9]+_\d+"
QUERY = r"(?d)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d{2,3}.*?💬\s*(.+)$"
ERROR_MARKS = ["⛔", "질문에 대한 답변을 생성하지 못했습니다"]
LINES = T.StructType([T.StructField("file", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())])
WEEKS = [0, 1, 2, 3, 4]
#: Up to so many splits, of three numbers and a name each, are sent to all tasks.
FEW_SPLITS = 100_000


def choose_files(names: list[str], today: dt.date, sample: str = r"sample_.*\.log", current: str = "chatbot.log", archive: str = "chatbot_{:%Y%m}.log") -> list[str]:
    """Samples if there are any; else the current log, and on the first of a month last month's archive too."""
    samples = sorted(n for n in names if re.fullmatch(sample, n))
    if samples:
        return samples
    out = [current] if current in names else []
    last = archive.format(today.replace(day=1) - dt.timedelta(days=1))
    return out + [last] if today.day == 1 and last in names else out


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line_no, line) of text files, numbered from 0; no file gives no rows.

    One row per file, split inside the task: for files that a task holds. ``read_large`` gives the same of files of any size."""
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], LINES)
    whole = spark.read.text(found, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"(\r\n|\r|\n)\z", "").alias("v"))
    return whole.select("file", F.posexplode(F.split("v", "\r\n|\r|\n")).alias("line_no", "line")).select("file", F.col("line_no").cast("bigint"), "line")


def read_large(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As ``read_lines``, but splits of a file are read in parallel.

    A line's number is its place in its split plus the lines of the file's splits before, which are counted first (a row
    a split)."""
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], LINES)
    rows = spark.read.text(found).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("line"))
    splits = durable(rows.groupBy(F.col("file").alias("f"), F.col("start").alias("s")).agg(F.min("k").alias("first"), F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("f", "s", (before - F.col("first")).alias("offset"))
    offsets = F.broadcast(offsets) if splits.count() <= FEW_SPLITS else offsets
    return rows.join(offsets, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s"))).select("file", (F.col("k") + F.col("offset")).alias("line_no"), "line")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found) and len(found) > 0


def session_id(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, SESSION, 0), F.lit(""))


def is_error(line: Column) -> Column:
    out = F.lit(False)
    for mark in ERROR_MARKS:
        out = out | line.contains(mark)
    return out


def entries(lines: DataFrame) -> DataFrame:
    """(file, line_no, datetime_str, search_query, session_id, has_error) from (file, line_no, line).

    A session holds until the next one in the file; queries before any session are dropped.  An error marks the latest
    query of its session, on its own line or before."""
    query = F.regexp_extract("line", QUERY, 1)
    said = X.strip(F.regexp_extract("line", QUERY, 2))
    held = filled(lines.select("file", "line_no", "line"), session_id(F.col("line")), "session_id", ["file"], "line_no").where("session_id is not null")
    parsed = held.select("file", "line_no", "session_id", query.alias("datetime_str"), said.alias("search_query"), is_error(F.col("line")).alias("error"))
    marked = islands(parsed, F.col("datetime_str") != "", F.col("error"), ["file", "session_id"], "line_no")
    return marked.select("file", "line_no", "datetime_str", "search_query", "session_id", F.col("flag").alias("has_error"))


def derived(df: DataFrame, datetime_col: str = "datetime_str") -> DataFrame:
    """Adds ts, year_month, day, week_idx, unique_key."""
    ts = F.to_timestamp_ntz(F.col(datetime_col), F.lit("yyyy-MM-dd HH:mm:ss"))
    return df.withColumn("ts", ts).withColumn("year_month", F.date_format(ts, "yyyy-MM")).withColumn("day", F.dayofmonth(ts)).withColumn("week_idx", week_index(F.col("day"))).withColumn("unique_key", F.concat_ws("|", datetime_col, "search_query"))


def week_index(day: Column) -> Column:
    """0 to 4 for days 1-7, 8-14, 15-21, 22-28, 29-31; else 0."""
    return F.when(day.between(1, 31), F.least(F.floor((day - 1) / 7), F.lit(4))).otherwise(F.lit(0)).cast("int")


def is_month_title(title: Column) -> Column:
    return (F.length(title) == 7) & (F.substring(title, 5, 1) == "-")


def merged(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per (datetime_str, search_query): the first one's session, whether any has an error, and the first place (``first_seen``)."""
    place = F.struct(*order)
    return df.groupBy("datetime_str", "search_query").agg(F.min_by("session_id", place).alias("session_id"), F.bool_or("has_error").alias("has_error"), F.min(place).alias("first_seen"))


def new_entries(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows whose key isn't in the month's table yet; existing rows never change."""
    return incoming.join(existing.select("year_month", "datetime_str", "search_query").distinct(), ["year_month", "datetime_str", "search_query"], "left_anti")


def placed(new: DataFrame, existing: DataFrame, header_rows: int = 3) -> DataFrame:
    """Adds row_no: the next free rows of each month and week, below the header."""
    used = existing.groupBy("year_month", "week_idx").agg(F.count("*").alias("_used"))
    nth = numbered(new, ["year_month", "week_idx"], ["datetime_str", "search_query"], "_place")
    return nth.join(used, ["year_month", "week_idx"], "left").withColumn("row_no", F.coalesce("_used", F.lit(0)) + F.col("_place") + header_rows).drop("_used", "_place")


def append(new: DataFrame, path: str) -> None:
    new.write.mode("append").partitionBy("year_month").parquet(path)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, created empty on a miss."""
    if not _exists(spark, path):
        spark.createDataFrame([], schema).write.partitionBy("year_month").parquet(path)
    return spark.read.schema(schema).parquet(path)


def week_counts(df: DataFrame) -> DataFrame:
    """Rows with a datetime by month and week."""
    return df.where(X.is_set(F.col("datetime_str"))).groupBy("year_month", "week_idx").agg(F.count("*").alias("n"))


def monthly_summary(df: DataFrame) -> DataFrame:
    """month, w1 .. w5, total: counts by week, zero where there are none."""
    wide = df.where(X.is_set(F.col("datetime_str"))).groupBy(F.col("year_month").alias("month")).pivot("week_idx", WEEKS).count().na.fill(0)
    wide = wide.select("month", *[F.col(str(k)).alias(f"w{k + 1}") for k in WEEKS])
    return wide.withColumn("total", sum((F.col(f"w{k + 1}") for k in WEEKS), F.lit(0)).cast("bigint")).orderBy("month")
