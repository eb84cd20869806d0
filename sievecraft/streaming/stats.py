"""Per-class feature statistics kept by Structured Streaming over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stats(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, s, ss): additive statistics, so batches of a stream add up to those of the table."""
    return stream.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))


def windowed_stats(stream: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """The same per window of event time; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))


def run_once(spark: SparkSession, path: str, out: str, key: str = "event_type", value: str = "value") -> DataFrame:
    """Read all files that are there as a stream, write each batch's statistics, and return their sums.

    ``path``: a parquet file or a folder of them. Statistics are additive, so partial sums of batches are enough.
    """
    table = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    options = {} if any(f.rstrip("/") != path.rstrip("/") and f"/{name}/" in f for f in table.inputFiles()) else {"pathGlobFilter": name}
    stream = spark.readStream.schema(table.schema).options(**options).parquet(path if not options else folder)

    def write(batch: DataFrame, number: int) -> None:
        stats(batch, key, value).write.mode("append").parquet(f"{out}/parts")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/parts").groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
