"""Live coverage: test events as a stream. An extension of the batch parsers, which read a report to its end.

Events are text lines that arrive as files in a folder. A test's state is its last terminal event; state is kept per
package and test by built-in aggregates, and dropped when the watermark has passed its window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.sources.reports import EVENT


def event_stream(spark: SparkSession, folder: str, late: str = "10 minutes") -> DataFrame:
    """Events of NDJSON files in ``folder`` as they arrive, with a watermark on their time."""
    lines = spark.readStream.schema("value string").format("text").load(folder)
    e = lines.filter(F.col("value").startswith("{")).select(F.from_json("value", EVENT).alias("e")).filter("e.Test IS NOT NULL")
    rows = e.select(F.to_timestamp("e.Time").alias("time"), F.col("e.Action").alias("action"), F.col("e.Package").alias("package"), F.col("e.Test").alias("test"), F.col("e.Elapsed").alias("elapsed"))
    return rows.withWatermark("time", late)


def test_states(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Per window, package and test the last terminal event."""
    ends = events.filter(F.col("action").isin("pass", "fail", "skip"))
    last = F.max(F.struct("time", "action", "elapsed")).alias("last")
    return ends.groupBy(F.window("time", window), "package", "test").agg(last).select("window", "package", "test", F.col("last.action").alias("status"), F.col("last.elapsed").alias("elapsed"))


def outcome_counts(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Per window and package how many events ended in each way."""
    n = lambda a: F.count(F.when(F.col("action") == a, 1)).alias(a)
    return events.groupBy(F.window("time", window), "package").agg(n("pass"), n("fail"), n("skip"))
