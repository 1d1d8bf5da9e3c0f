"""The feedback feed: one row per arrival of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows over the cores before heavy text work; a scan of many files stays as it is and is
    not shuffled. The number of partitions alone does not tell: a file is cut by size but read by
    row group, so most cuts of a file with one large group have no rows. Rows are dealt into as many
    parts as there are cuts, two a core at least, so that a part does not grow with the table."""
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    cuts = df.rdd.getNumPartitions()
    many = len(df.inputFiles()) >= parts and cuts >= parts
    return df if many else df.repartition(max(parts, cuts), key)


def hour_index(ts: Column) -> Column:
    """Whole hours since the epoch."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600)


def hour_start(h: Column) -> Column:
    return F.timestamp_seconds(h * 3600)


def arrivals(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Events with the id of the document that arrived and the hour index."""
    n = documents.agg(F.count(F.lit(1))).scalar()
    return events.withColumns(
        {"doc_id": F.col("event_id") % n, "ts": F.col("ts").cast("timestamp"), "h": hour_index(F.col("ts"))}
    )


def arrivals_by_hour(arrived: DataFrame) -> DataFrame:
    """Arrivals per document and hour (doc_id, h, arrivals). Counted before any join: a document
    that holds a third of all arrivals brings one row per hour to its join task."""
    return arrived.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("arrivals"))


def hourly_feed(events: DataFrame, documents: DataFrame, scored: DataFrame) -> DataFrame:
    """The feed for hourly aggregates: one row per document and hour with its number of arrivals."""
    return arrivals_by_hour(arrivals(events, documents)).join(scored, "doc_id")


def feed(events: DataFrame, documents: DataFrame, scored: DataFrame) -> DataFrame:
    """Arrivals joined with documents that were analysed once each: texts are never shuffled,
    only the narrow analysed rows are."""
    return arrivals(events, documents).join(scored, "doc_id")
