"""Structured Streaming into a store: each micro-batch is one atomic commit, fenced by its id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.store import Store


def ingest(store: Store, mutations: DataFrame, name: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Commit a stream of (ordinal, key, kind, value); without an interval, what is there now and then end.

    The manifest records the last batch id of each stream in the same swap that publishes its rows, so a batch replayed
    after a crash is skipped.
    """
    def commit(rows: DataFrame, batch_id: int) -> None:
        store.write_frame(rows.select(F.col("ordinal").cast("long").alias("ordinal"), "key", "kind", "value"), (name, batch_id))

    out = mutations.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()
