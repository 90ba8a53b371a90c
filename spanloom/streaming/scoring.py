"""Incremental scoring: run rows arrive as files and are scored as they come, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.score import document_scores, micro_average
from ..schema import PREDICTED, SPAN

RUN_ROW = f"benchmark string, doc_id string, system string, ok boolean, gold array<{SPAN}>, spans array<{PREDICTED}>"


def score_stream(spark: SparkSession, source: str, target: str, checkpoint: str, mode: str = "type", **trigger) -> StreamingQuery:
    """Scores of each arriving batch, under a folder named by the batch: a batch that is run again replaces its own output."""

    def batch(rows: DataFrame, number: int) -> None:
        document_scores(rows, mode).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(RUN_ROW).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def scored_so_far(spark: SparkSession, target: str, by: tuple[str, ...] = ("system", "benchmark")) -> DataFrame:
    return micro_average(spark.read.parquet(target), by)


def event_windows(events: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by event type and tumbling window of a stream or table of events; rows later than the watermark are dropped from streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
