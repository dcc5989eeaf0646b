"""Matching of source concepts as they arrive, against a fixed index of the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ontospark.operators.annotations import idf_select


def match_new_sources(stream: DataFrame, targets: DataFrame, keys: int, out_path: str, pool: int = 10) -> DataStreamWriter:
    """A writer that appends each micro-batch's idf candidates to ``out_path`` as Parquet, one folder per batch.

    A batch that runs again overwrites its own folder, so results come once.
    ``stream`` and ``targets`` are ``(iri, literal)``; all literals of a source
    have to come in one batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        idf_select(batch, targets, keys, pool).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return stream.writeStream.foreachBatch(run)
