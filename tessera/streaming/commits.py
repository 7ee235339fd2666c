"""Commits as a stream: files of commit rows that arrive in a folder are upserted, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.warehouse import Warehouse

SCHEMA = "project string, hash string, author string, email string, date_raw string, message string, files_changed array<string>"


def stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder).withColumn("date_ts", F.to_timestamp("date_raw"))


def upsert_available(house: Warehouse, folder: str, checkpoint: str) -> None:
    """Takes what has arrived since the checkpoint. A batch that is repeated after a failure changes nothing, as rows are merged by (project, hash)."""

    def merge(batch: DataFrame, _: int) -> None:
        for row in batch.select("project").distinct().collect():  # the batch's projects
            house.upsert("commit", row.project, batch.where(F.col("project") == row.project), "date_raw")

    stream(house.spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def activity(commits: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Commits by author and window, for streams: a window is emitted when nothing later than ``late`` can change it."""
    timed = commits.withWatermark("date_ts", late)
    return timed.groupBy(F.window("date_ts", window).alias("w"), "author").agg(F.count(F.lit(1)).alias("commits")).select("w.start", "author", "commits")
