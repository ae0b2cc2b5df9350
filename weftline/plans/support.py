"""Shared by the query modules: tables and registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Collects queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


#: DuckDB: user turns with the assistant turn right after.
PAIRS = """pairs AS (SELECT CAST(u.conv_id AS BIGINT) * 1048576 + u.turn AS id, u.text AS instruction, a.text AS response FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"


def grams_sql(w: str, n: int = 3) -> str:
    return f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


def repetition_sql(w: str) -> str:
    g = grams_sql(w)
    return f"CASE WHEN len({w}) < 3 THEN 0.0 ELSE 1 - CAST(len(list_distinct({g})) AS DOUBLE) / len({g}) END"
