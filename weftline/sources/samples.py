"""Seeds, samples, stage tables and evaluation files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as X
from weftline.operators.dedup import durable

SAMPLE = T.StructType([T.StructField("ord", T.LongType()), T.StructField("instruction", T.StringType()), T.StructField("response", T.StringType()), T.StructField("seed_instruction", T.StringType()), T.StructField("evolution_history", T.ArrayType(T.StringType())), T.StructField("metadata", T.StructType([T.StructField("evolved", T.BooleanType()), T.StructField("generation_idx", T.IntegerType())]))])


def _flat(value) -> list[str]:
    """Strings of a list, or of lists by topic."""
    if isinstance(value, dict):
        return [s for v in value.values() for s in _flat(v)]
    return [str(v) for v in value or []]


def load_seeds(spark: SparkSession, path: str, yaml: bool = True) -> DataFrame:
    """(ord, seed) from a seed list: .txt lines that aren't blank, .json or (yaml) .yaml: a list, or instructions, seeds or seed_instructions by topic.

    Seed files are small by nature: one file, read whole by one task's reader."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "txt":
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("ord", "seed")).select(F.col("ord").cast("bigint"), X.strip(F.col("seed")).alias("seed"))
        return rows.where("seed <> ''")
    if kind not in ("json", *(("yaml", "yml") if yaml else ())):
        raise ValueError(f"unknown seed format: {kind}")
    whole = spark.read.text(path, wholetext=True).first()
    data = whole[0] if whole else "[]"
    if kind == "json":
        value = json.loads(data)
    else:
        import yaml as reader

        value = reader.safe_load(data)
    if isinstance(value, dict):
        value = value.get("instructions") or value.get("seeds") or value.get("seed_instructions") or []
    return spark.createDataFrame(list(enumerate(_flat(value))), "ord bigint, seed string")


def save(df: DataFrame, path: str, kind: str = "jsonl", most: int = 10_000_000) -> None:
    """Samples as JSON lines, or as one JSON array in one file; a single task has to write that, line by line, so more than ``most`` rows are refused."""
    if kind == "jsonl":
        df.write.mode("overwrite").json(path)
    elif kind == "json":
        spark = df.sparkSession
        rows = durable(df.select(F.to_json(F.struct("*")).alias("value"), F.monotonically_increasing_id().alias("k")))
        n, first = rows.agg(F.count("*"), F.min("k")).first()
        if n > most:
            raise ValueError(f"{n} rows are too many for one array; write JSON lines")
        placed = rows.select("k", F.concat(F.when(F.col("k") == F.lit(first), "  ").otherwise(", "), "value").alias("value"))
        ends = spark.createDataFrame([(-1, "["), ((1 << 63) - 1, "]")], "k bigint, value string")
        placed.union(ends).repartition(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format: {kind}")


def save_stage(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """A stage's table, written and read again."""
    df.write.mode("overwrite").parquet(f"{folder}/{stage}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{stage}")


def save_final(df: DataFrame, folder: str, stats: DataFrame) -> None:
    """Instruction and response only, and the statistics."""
    df.select("instruction", "response").write.mode("overwrite").json(f"{folder}/samples")
    stats.write.mode("overwrite").json(f"{folder}/stats")


def load_splits(spark: SparkSession, folder: str, names: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Named splits of a dataset as one frame with ``split``."""
    frames = [spark.read.parquet(f"{folder}/{n}").withColumn("split", F.lit(n)) for n in names]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def load_eval_list(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, output) from a JSON list of {input: {prompt}, output}."""
    schema = T.StructType([T.StructField("input", T.StructType([T.StructField("prompt", T.StringType())])), T.StructField("output", T.StringType())])
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("input.prompt").alias("prompt"), "output")


def eval_report(metadata: DataFrame, summary: DataFrame, samples: DataFrame, path: str) -> None:
    """Metadata and summary as one JSON row, per-sample outputs beside it."""
    m, s = (F.struct(*df.columns).alias(n) for df, n in ((metadata, "metadata"), (summary, "summary")))
    metadata.select(m).crossJoin(F.broadcast(summary.select(s))).write.mode("overwrite").json(f"{path}/report")
    samples.write.mode("overwrite").json(f"{path}/samples")


def nested_snapshots(snapshots: DataFrame, technique: str = "technique") -> DataFrame:
    """One row per technique with its snapshots as a list in order of length."""
    return snapshots.groupBy(technique).agg(F.array_sort(F.collect_list(F.struct("sequence_length", "kv_cache_mb"))).alias("snapshots"))


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
