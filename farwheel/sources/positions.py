"""Device fixes with their compass headings, as a stream over a folder of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIX = "trip_key string, at timestamp, lat double, lon double, accuracy double, speed double, heading double"


def usable(fixes: DataFrame) -> DataFrame:
    """Fixes that have a key, a time and a place on earth; headings over 0 to 360, null where there is none."""
    there = F.col("trip_key").isNotNull() & F.col("at").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    heading = F.when(F.col("heading") >= 0, F.pmod("heading", F.lit(360.0)))
    return fixes.where(there).withColumn("heading", heading)


def position_stream(spark: SparkSession, path: str, files: int = 1000, late: str = "1 minute") -> DataFrame:
    """Fixes as they arrive, at most `files` files a batch; repeats of a key and time within the watermark come once."""
    raw = spark.readStream.schema(FIX).option("maxFilesPerTrigger", files).json(path)
    return usable(raw).withWatermark("at", late).dropDuplicatesWithinWatermark(["trip_key", "at"])
