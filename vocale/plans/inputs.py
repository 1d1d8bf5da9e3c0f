"""Shared inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocale.functions.analysis import NEGATIVE
from vocale.functions.text import normalize_text
from vocale.operators.entities import extract_entities
from vocale.operators.hourly import dense, document_mentions, entity_hourly, hour_span, hourly_counts
from vocale.operators.sentiment import score_sentiment
from vocale.session import shared_dir
from vocale.sources.feed import (
    arrivals, arrivals_by_hour, feed, hour_index, hour_start, hourly_feed, spread, table,
)


def documents(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "source", "lang", "text")
    return spread(docs, "doc_id")


def normalized(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the whole normalised text."""
    return documents(spark, root).withColumn("norm", normalize_text(F.col("text"), None)).drop("text")


def scored(spark: SparkSession, root: str) -> DataFrame:
    """Narrow analysed documents: no text column. The lexicon looks at letter runs only, which
    are the same before and after whitespace is collapsed."""
    return score_sentiment(documents(spark, root), "text").drop("text")


def described(spark: SparkSession, root: str) -> DataFrame:
    """Documents without text and score, for queries that need neither."""
    return table(spark, root, "documents").select("doc_id", "source", "lang")


def feedback(spark: SparkSession, root: str, scores: bool = True) -> DataFrame:
    """The feed of arrivals, analysed unless ``scores`` is off: then no text is read."""
    rows = scored(spark, root) if scores else described(spark, root)
    return feed(table(spark, root, "events"), table(spark, root, "documents"), rows)


def hourly_feedback(spark: SparkSession, root: str, scores: bool = True) -> DataFrame:
    """The feed counted by document and hour, for hourly aggregates."""
    rows = scored(spark, root) if scores else described(spark, root)
    return hourly_feed(table(spark, root, "events"), table(spark, root, "documents"), rows)


def negative_documents(spark: SparkSession, root: str, offsets: bool = True) -> DataFrame:
    """Negative documents with their entities; only these are searched for entities."""
    negative = score_sentiment(documents(spark, root), "text").filter(F.col("sentiment_label") == NEGATIVE)
    cleaned = negative.withColumn("norm", normalize_text(F.col("text"), None)).drop("text")
    return extract_entities(cleaned, offsets=offsets)


def mentions_by_hour(spark: SparkSession, root: str) -> DataFrame:
    mentions = document_mentions(negative_documents(spark, root, offsets=False))
    arrived = arrivals(table(spark, root, "events"), table(spark, root, "documents"))
    return entity_hourly(arrivals_by_hour(arrived), mentions)


def show_hour(df: DataFrame) -> DataFrame:
    """Replace the hour index by the hour's start."""
    hour = hour_start(F.col("h")).cast("timestamp_ntz").alias("hour")
    return df.select(hour, *[c for c in df.columns if c != "h"])


def as_double(df: DataFrame, *names: str) -> DataFrame:
    """Whole numbers that may be NULL, in the one type every client shows alike."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Averages and rates to six digits, with no negative zero."""
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


def span(spark: SparkSession, root: str) -> DataFrame:
    events = table(spark, root, "events")
    return hour_span(events.select(hour_index(F.col("ts")).alias("h")))


def dense_counts(spark: SparkSession, root: str) -> DataFrame:
    """Hourly parts of the whole feed, every hour present."""
    return dense(hourly_counts(hourly_feedback(spark, root)), span=span(spark, root))


def work(spark: SparkSession, root: str, scores: bool = True) -> DataFrame:
    """The feed as processed messages: error events are failed runs, value gives the time taken."""
    failed = F.col("event_type") == "error"
    return feedback(spark, root, scores).withColumns(
        {
            "status": F.when(failed, "failed").otherwise("done"),
            "error": F.when(failed, "inference error: timeout"),
            "processing_ms": F.floor(F.col("value") * 1000),
            "week": F.floor(F.col("h") / 168),
        }
    )


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, so that its source is read once."""
    path = f"{shared_dir(spark, name)}/rows"
    df.write.parquet(path)
    return spark.read.parquet(path)
