"""Timelines from a stream of commits: fixed windows with a watermark, and calendar buckets, as the batch reports give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.functions.buckets import bucket

#: Start of a week-long window, as windows count from a Thursday and weeks begin on Monday.
WEEK_START = "4 days"


def commit_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Timeline rows from files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def dated(rows: DataFrame) -> DataFrame:
    """Rows with both timestamps and one parent, with author_date."""
    kept = rows.filter("n_parents = 1 AND `author.timestamp` IS NOT NULL AND `committer.timestamp` IS NOT NULL")
    return kept.withColumn("author_date", F.timestamp_seconds("`author.timestamp`"))


def weekly_counts(rows: DataFrame, lateness: str = "30 days") -> DataFrame:
    """(week, n_commits, p_count): commits by week, labelled by its Sunday; later ones than ``lateness`` are dropped in a stream."""
    w = F.window("author_date", "7 days", startTime=WEEK_START)
    sums = dated(rows).withWatermark("author_date", lateness).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n_commits"), F.coalesce(F.sum("`+:count`"), F.lit(0)).alias("p_count"))
    return sums.select(F.date_sub(F.to_date("w.end"), 1).alias("week"), "n_commits", "p_count")


def bucket_counts(rows: DataFrame, rule: str) -> DataFrame:
    """(bucket, n_commits) by any calendar rule; in a stream all buckets are kept, so it runs in complete or update mode."""
    return dated(rows).groupBy(bucket(F.col("author_date"), rule).alias("bucket")).agg(F.count(F.lit(1)).alias("n_commits"))


def run_to_memory(rows: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None):
    """Start a query into the in-memory table ``name``."""
    writer = rows.writeStream.outputMode(mode).format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
