"""Incremental forms: nightly append, texts seen before, attention state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions import text as X
from weftline.operators.dedup import durable
from weftline.sources import logs


def nightly_append(spark: SparkSession, entries: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Streams log entries (datetime_str, search_query, session_id, has_error) into the month table; what is there already is skipped, so a rerun adds nothing."""
    schema = "year_month string, week_idx int, row_no bigint, datetime_str string, search_query string, session_id string, has_error boolean"
    from pyspark.sql.types import _parse_datatype_string

    wanted = _parse_datatype_string(schema)

    def write(batch: DataFrame, _: int) -> None:
        existing = logs.ensure_table(spark, table, wanted)
        rows = logs.derived(logs.merged(batch, ["datetime_str", "search_query", "session_id"]))
        new = logs.placed(logs.new_entries(rows, existing), existing)
        # the batch is settled before the table that it reads is written to
        logs.append(durable(new.select(*wanted.fieldNames())), table)

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen_texts(stream: DataFrame, text_col: str, event_time: str | None = None, within: str | None = None) -> DataFrame:
    """The first row of each text of a stream, by hash; with a time column and a bound, state is kept only that long."""
    hashed = stream.withColumn("text_hash", F.md5(X.text(F.col(text_col))))
    if event_time and within:
        return hashed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["text_hash"])
    return hashed.dropDuplicates(["text_hash"])


def attention_state(stream: DataFrame, decay: float = 0.99) -> DataFrame:
    """(layer, token_idx, score, total, updates) after each batch: decayed and plain attention per token, kept as state. stream: layer, step, token_idx, weight."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, total, n = state.get if state.exists else (0.0, 0.0, 0)
        w = pd.concat(list(frames)).sort_values("step")["weight"].to_numpy(float)
        score = score * decay ** len(w) + float(w @ decay ** np.arange(len(w) - 1, -1, -1.0))
        total, n = total + float(w.sum()), n + len(w)
        state.update((float(score), float(total), int(n)))
        yield pd.DataFrame({"layer": [key[0]], "token_idx": [key[1]], "score": [score], "total": [total], "updates": [n]})

    return stream.groupBy("layer", "token_idx").applyInPandasWithState(update, "layer int, token_idx int, score double, total double, updates bigint", "score double, total double, updates bigint", "update", GroupStateTimeout.NoTimeout)
