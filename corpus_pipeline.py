"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
folder and rereads it for the next.  All stages but the last return the columns of ``documents``.

Nulls and edge cases: documents with a null or empty text, or a null id, pass the filters unless the classifier rejects
the empty text; repeated rows are alike to every stage (of equal rows, which no rule can tell apart, near-duplicate
removal keeps one); further columns are kept as they are, whatever their names (the last stage's own columns get an
underscore where a name is taken).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import quoted, spare, staged, table


#: Bytes of a batch between Spark and its Python workers, which both hold it; by default 64 MB or 10,000 rows.
BATCH_BYTES = 4_000_000


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with the session's Arrow batches bounded from then on: its result is computed after it returns."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (score below 0.3)."""
    from weftline.llm.quality import accepted, trained

    return accepted(docs, trained(docs, table(spark, sf_dir, "labels")))


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of 5-word shingle Jaccard 0.75 or more."""
    from weftline.llm.jaccard import similar_groups

    # one row per id: rows that share an id share a component
    ids = similar_groups(docs).groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    keep = staged(ids.where("doc_id is null or doc_id = c").select("doc_id", (F.col("n") > 1).alias("several")), "kept-ids")
    here = docs.columns
    flag, copy = spare(here, "several", "copy")
    kept = docs.join(keep.select(F.col("doc_id").alias(id_ := spare(here, "kept_id")[0]), F.col("several").alias(flag)), F.col("doc_id").eqNullSafe(F.col(id_)))
    if keep.where("several").isEmpty():
        return kept.select(*map(quoted, here))
    # rows that share an id: equal texts are one document, others stay
    order = Window.partitionBy("doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).orderBy(F.length("text"))
    again = kept.where(F.col(flag)).withColumn(copy, F.row_number().over(order)).where(F.col(copy) == 1)
    return kept.where(~F.col(flag)).select(*map(quoted, here)).union(again.select(*map(quoted, here)))


@in_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of windows of 20 that also start earlier in the corpus; a document that loses all its words goes."""
    from weftline.llm.phrases import repeated_phrases

    out = repeated_phrases(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))).where("n_words = 0 or n_removed < n_words")
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[(own[c] if c in own else F.col(f"carried.{quoted(c)}")).alias(c) for c in docs.columns])


@in_small_batches
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    from weftline.llm.decontaminate import clean

    return clean(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds SentencePiece ids, their number and digest, and whether decoding gives the text back."""
    from weftline.llm.queries import tokenizer_path
    from weftline.llm.sentencepieces import encoded

    return encoded(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("benchmark decontamination", benchmark_leaks), ("SentencePiece encoding and decoding", encoding)]

#: No SQL: the classifier and the encoder can't be expressed; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
