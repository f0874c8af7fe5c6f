"""Event files as a stream: calendar-month and sliding windows, dedup within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    """The files of a folder as a stream; ts becomes a timestamp with time zone, as watermarks ask."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, keys: list[str], value: str, size: str = "7 days", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """start, keys, n and total of each window; in append mode a window appears when the watermark has passed it."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def first_seen(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once, as far as repeats come within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there is now, appended to Parquet, exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
