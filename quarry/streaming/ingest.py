"""Structured Streaming ingestion of feature rows and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarry.sources.steps import shared_path


def feature_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Counts and sums per window and type; state older than the watermark is dropped."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, length).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def drained(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """What an aggregating stream says once all that is there was read: the last state of each key.

    Changed rows of every batch go to a folder of the batch's own in the shared folder, which a batch that is run again
    replaces; the offsets lie beside them, so that a restart goes on where it stopped.
    """
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/{number}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).option("recursiveFileLookup", True).parquet(f"{path}/rows")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in values])
