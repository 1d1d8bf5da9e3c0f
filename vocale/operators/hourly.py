"""Hourly aggregates of the feed.

Every aggregate combines map-side before it shuffles, so a source, language or entity that holds
most of the rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vocale.functions.analysis import NEGATIVE
from vocale.operators.joins import join_equal

COUNTS = ("total", "negatives", "neg_score_sum")


def is_negative() -> Column:
    return F.col("sentiment_label") == NEGATIVE


def _weight(feed: DataFrame) -> Column:
    """Arrivals of a row: its ``arrivals`` column in a feed counted by hour, else one."""
    return F.col("arrivals") if "arrivals" in feed.columns else F.lit(1).cast("bigint")


def hourly_counts(feed: DataFrame, *keys: str) -> DataFrame:
    """Additive parts per hour (and key): total, negatives, neg_score_sum."""
    n = _weight(feed)
    score = F.when(is_negative(), F.col("sentiment_score") * n)
    return feed.groupBy(*keys, "h").agg(
        F.sum(n).alias("total"),
        F.coalesce(F.sum(F.when(is_negative(), n)), F.lit(0)).alias("negatives"),
        F.coalesce(F.sum(score), F.lit(0.0)).alias("neg_score_sum"),
    )


def roll_up(counts: DataFrame, *keys: str) -> DataFrame:
    """The parts of fewer keys."""
    return counts.groupBy(*keys, "h").agg(*[F.sum(c).alias(c) for c in COUNTS])


def merge_hourly(stored: DataFrame, batch: DataFrame, *keys: str) -> DataFrame:
    """Stored parts updated by the parts of one more batch."""
    return roll_up(stored.unionByName(batch), *keys)


def hour_span(arrivals: DataFrame) -> DataFrame:
    """First and last hour of an arrival log, from its one time column."""
    return arrivals.agg(F.min("h").alias("_first"), F.max("h").alias("_last"))


def dense(counts: DataFrame, *keys: str, span: DataFrame | None = None) -> DataFrame:
    """One row per hour between the first (of the key) and the last of all, 0 where nothing came.

    Without a ``span`` the range is read from the counts, which are then worked out once more;
    give one where the counts are not a stored table.
    """
    if keys:
        last = counts.agg(F.max("h")).scalar()
        spans = counts.groupBy(*keys).agg(F.min("h").alias("_first")).withColumn("_last", last)
    else:
        spans = span if span is not None else hour_span(counts)
        spans = spans.filter("_first is not null")
    spine = spans.select(*keys, F.explode(F.sequence("_first", "_last")).alias("h"))
    values = [c for c in counts.columns if c not in (*keys, "h")]
    joined = join_equal(spine, counts, (*keys, "h"), "left") if keys else spine.join(counts, "h", "left")
    return joined.na.fill(0, values)


def with_averages(stats: DataFrame) -> DataFrame:
    return stats.withColumn("avg_neg_score", F.try_divide(F.col("neg_score_sum"), F.col("negatives")))


def hourly_stats(feed: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """feedback_hourly_stats: h, total, negatives, neg_score_sum, avg_neg_score, every hour present."""
    return with_averages(dense(hourly_counts(feed), span=span))


def rate_by_source(feed: DataFrame) -> DataFrame:
    counts = hourly_counts(feed, "source")
    return counts.withColumn(
        "negative_rate", F.try_divide(F.col("negatives").cast("double"), F.col("total"))
    )


def language_mix(feed: DataFrame) -> DataFrame:
    """Share of each language in its hour; the window runs over one row per language and hour."""
    counts = feed.groupBy("h", "lang").agg(F.sum(_weight(feed)).alias("total"))
    whole = F.sum("total").over(W.partitionBy("h"))
    return counts.withColumn("share", F.try_divide(F.col("total").cast("double"), whole))


def document_mentions(negative_docs: DataFrame) -> DataFrame:
    """Mentions of each entity in each document; repeated mentions shrink before any join."""
    entity = negative_docs.select("doc_id", F.explode_outer("entities").alias("e")).filter("e is not null")
    return entity.groupBy("doc_id", F.col("e.text").alias("entity"), F.col("e.label").alias("label")).agg(
        F.count(F.lit(1)).alias("per_doc")
    )


def entity_hourly(arrivals: DataFrame, mentions: DataFrame) -> DataFrame:
    """Negative mentions per entity and hour, from arrivals counted by document and hour."""
    joined = arrivals.join(mentions, "doc_id")
    return joined.groupBy("entity", "label", "h").agg(
        F.sum(F.col("per_doc") * F.col("arrivals")).alias("mentions")
    )


def urgency_mix(feed: DataFrame) -> DataFrame:
    """Arrivals per hour and urgency."""
    known = feed.filter(F.col("urgency").isNotNull())
    return known.groupBy("h", "urgency").agg(F.sum(_weight(feed)).alias("total"))
