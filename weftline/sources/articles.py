"""Articles: JSON files, validation, search text and metadata, upload ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as X

#: Fields of an article.
FIELDS = ["nid", "art_id", "title", "content", "author", "category", "service_daytime", "pcUrl", "subTitle", "keyword"]
ITEM = T.StructType([T.StructField("item", T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])), T.StructField("_corrupt_record", T.StringType())])
LEDGER = T.StructType([T.StructField("file", T.StringType()), T.StructField("status", T.StringType()), T.StructField("updated_at", T.TimestampType())])


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the files that ``read_articles`` leaves out."""
    whole = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    # the reader itself can't be asked for the corrupt records alone
    parsed = F.from_json("value", ITEM, {"mode": "PERMISSIVE"})
    return whole.where(parsed["_corrupt_record"].isNotNull()).select("file", F.col("value").alias("content"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """One article per JSON file of a folder, missing fields empty, with its file; broken files are left out."""
    raw = spark.read.schema(ITEM).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    rows = raw.select("item", "_corrupt_record", F.col("_metadata.file_name").alias("file"))
    return rows.where("_corrupt_record is null").select("file", *[F.coalesce(f"item.{f}", F.lit("")).alias(f) for f in FIELDS])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names of the folder's JSON files in order, broken ones too."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file")).orderBy("file")


def file_count(spark: SparkSession, path: str) -> int:
    return list_files(spark, path).count()


def is_valid() -> Column:
    return X.is_set(F.col("title")) & X.is_set(F.col("content")) & X.is_set(F.col("art_id"))


def date_of(service_daytime: Column) -> Column:
    return F.substring_index(service_daytime, " ", 1)


def year_month_of(service_daytime: Column) -> Column:
    return F.when(F.length(service_daytime) >= 7, F.substring(service_daytime, 1, 7)).otherwise(F.lit(""))


def search_text() -> Column:
    """Front matter and content, in the fixed layout that the search index expects."""
    head = [("제목", "title"), ("저자", "author"), ("카테고리", "category"), ("날짜", "service_daytime"), ("URL", "pcUrl"), ("기사ID", "art_id")]
    parts = [F.lit("---\n")]
    for label, c in head:
        parts += [F.lit(f"{label}: "), F.coalesce(c, F.lit("")), F.lit("\n")]
    return F.concat(*parts, F.lit("---\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))


def metadata() -> Column:
    """Map of author, category, year_month and art_id without empty values."""
    pairs = [F.lit("author"), F.col("author"), F.lit("category"), F.col("category"), F.lit("year_month"), year_month_of(F.col("service_daytime")), F.lit("art_id"), F.col("art_id")]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != ""))


def search(df: DataFrame, author: str | None = None, category: str | None = None, year_month: str | None = None) -> DataFrame:
    """Rows equal in every term given; an empty term counts as absent."""
    for column, value in (("author", author), ("category", category), ("year_month", year_month)):
        if value:
            df = df.where(F.col(column) == value)
    return df


def pending(files: DataFrame, ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Files in neither state of the ledger, in order; failed ones aren't tried again; a limit of 0 is none."""
    left = files.join(ledger.select("file").distinct(), "file", "left_anti").orderBy("file")
    return left.limit(limit) if limit else left


def processed(uploaded: DataFrame, failed: DataFrame) -> DataFrame:
    return uploaded.select("file").union(failed.select("file")).distinct()


def upload_status(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: total, uploaded, failed, remaining."""
    done = ledger.agg(F.count_distinct(F.when(F.col("status") == "uploaded", F.col("file"))).alias("uploaded"), F.count_distinct(F.when(F.col("status") == "failed", F.col("file"))).alias("failed"))
    return files.agg(F.count("*").alias("total")).crossJoin(F.broadcast(done)).withColumn("remaining", F.col("total") - F.col("uploaded") - F.col("failed"))


def record(ledger_path: str, rows: DataFrame) -> None:
    """Appends (file, status) with the time to the ledger."""
    rows.select("file", "status", F.current_timestamp().alias("updated_at")).write.mode("append").parquet(ledger_path)


def create_store(spark: SparkSession, name: str, schema: str) -> None:
    """A table to upload to, if it isn't there yet; ``spark.catalog`` lists and drops stores."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING parquet")
