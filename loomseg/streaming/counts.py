"""Bins kept by a stream: counts per window with a watermark, and sessions of one axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import table


def windowed_counts(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """(chrom, bin start, n) of a stream of (chrom, ts): tumbling windows that close when the watermark passes."""
    w = F.window("ts", f"{seconds} seconds")
    return events.withWatermark("ts", late).groupBy("chrom", w.alias("w")).agg(F.count("*").alias("n")).select("chrom", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Regions of a stream: successive events no further apart than the gap."""
    return events.withWatermark("ts", late).groupBy("chrom", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("chrom", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_counts(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    """Runs the windows over the events table as a stream to its end and returns (chrom, bin, n)."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ts = F.col("ts").cast("timestamp")
    counted = windowed_counts(stream.select(F.col("event_type").alias("chrom"), ts.alias("ts")), seconds)
    name = f"bins_{abs(hash((sf_dir, seconds))) % 10**9}"
    q = counted.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    begin = 1_704_067_200
    return spark.table(name).select("chrom", F.floor((F.unix_timestamp("start") - begin) / seconds).cast("long").alias("bin"), "n")


def stream_sessions(spark: SparkSession, sf_dir: str, gap: str) -> DataFrame:
    """Runs the sessions over the events table as a stream to its end; times in microseconds."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    found = sessions(stream.select(F.col("event_type").alias("chrom"), F.col("ts").cast("timestamp").alias("ts")), gap)
    name = f"sessions_{abs(hash((sf_dir, gap))) % 10**9}"
    q = found.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("chrom", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")
