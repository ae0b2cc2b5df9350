"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text bytes that one numpy pass holds at a time; longer single rows form their own slice.
SLICE_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and Spark is local (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        where = context.getCheckpointDir()
        if where is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
            where = context.getCheckpointDir()
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts lineage and outlives any executor.

    The shuffle files behind the write are of no more use then, and Spark removes them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def freed(*frames: DataFrame) -> None:
    """Empties staged tables that nothing will read again."""
    for df in frames:
        if files := df.inputFiles():
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def spare(taken: Iterable[str], *wanted: str) -> list[str]:
    """The ``wanted`` names, with underscores added where a column of that name (in any case) is already there."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def mapped(df: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` with columns by place, so that their names may hold any character."""
    safe = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(batches, safe).toDF(*schema.names)


def integral(docs: DataFrame, id_col: str) -> T.DataType:
    """The type of the id column, which has to be an integer type."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")
    return kind


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null counts as the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``column`` with at most ``most`` bytes of text each (a longer row stands alone)."""
    import numpy as np

    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end
