"""The batch operators on streams: lookup of a stream of queries, and bucket counts of a stream of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lookup import Store, build_store, lookup_batch


def stream_lookup(queries: DataFrame, drugs: DataFrame | Store, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Answers each micro-batch of queries (a column query) with the batch cascade and appends them to path.

    A batch is a folder of its own and is overwritten if it is run again, so a restart repeats nothing.
    """
    store = drugs if isinstance(drugs, Store) else build_store(drugs)  # once, not for each batch

    def answer(batch: DataFrame, number: int) -> None:
        lookup_batch(batch, store).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each key in tumbling windows; rows later than `late` are dropped and closed windows leave the state."""
    counts = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), key, "n")
