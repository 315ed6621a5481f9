"""Counts kept up to date from a stream of events with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def increments(events: DataFrame, gene: str, cell: str, n: str | None = None) -> DataFrame:
    """``gene, cell, n`` running sums (update or complete mode)."""
    value = F.sum(n) if n else F.count(F.lit(1))
    return events.groupBy(F.col(gene).alias("gene"), F.col(cell).alias("cell")).agg(value.alias("n"))


def windowed(events: DataFrame, time: str, gene: str, cell: str, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """``window_start, gene, cell, n`` of closed windows (append mode): late rows beyond the watermark are dropped."""
    w = F.window(time, length)
    rows = events.withWatermark(time, late).groupBy(w, F.col(gene).alias("gene"), F.col(cell).alias("cell"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "gene", "cell", "n")


def keep(events: DataFrame, gene: str, cell: str, path: str, checkpoint: str, n: str | None = None) -> None:
    """Takes what has arrived and keeps its counts as one folder a micro-batch, ``path/batch=<id>``.

    A batch that is run again after a failure overwrites its own folder, so every event counts once.
    No state is kept between batches and nothing is gathered on the driver. ``current`` adds them up.
    """

    def write(batch: DataFrame, number: int) -> None:
        increments(batch, gene, cell, n).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, path: str) -> DataFrame:
    """``gene, cell, n``: the sums of all batches kept so far."""
    return spark.read.parquet(path).groupBy("gene", "cell").agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Writes the current sums to another folder as one batch, before all later ones."""
    current(spark, path).write.mode("overwrite").parquet(f"{into}/batch=-1")


def run_to_table(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Drains a bounded stream into a table in memory and returns it; for tests and small results."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)
