"""Normalisation of a stream: decisions are stateless, so the batch operators' rules apply to each micro-batch against static resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lurus.operators.normalize import Parts, normalize


def normalize_stream(stream: DataFrame, id_col: str, text_col: str, words: DataFrame, rules: DataFrame, path: str, checkpoint: str, parts: Parts = Parts(), **trigger) -> StreamingQuery:
    """Start a query that writes (id, normalized) of each micro-batch to its own folder of `path`; a replayed batch overwrites what it wrote."""
    words, rules = words.cache(), rules.cache()

    def write(batch: DataFrame, number: int) -> None:
        normalize(batch, id_col, text_col, words, rules, parts).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
