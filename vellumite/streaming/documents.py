"""Documents that arrive as files: the batch plan on every micro-batch.

Row numbers and ordered aggregates are no stream operators, but documents are independent, so each
micro-batch is a corpus of its own and runs the batch plan inside foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_on_arrival(spark: SparkSession, path: str, schema: str, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Reads Parquet files of `schema` as they arrive below `path`, applies `plan` and writes each batch to `out`/batch=<n>, which a replay overwrites."""

    def each(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) per time window; a stream or a table."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
