"""Sentiment stand-in: lexicon polarity as JVM-side columns, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocale.functions.analysis import public_label, signed_score
from vocale.functions.lexicon import NEGATIVE_TERMS, POSITIVE_TERMS, flat, literal_array, words
from vocale.functions.once import compute_once

MODEL_NAME = "lexicon"


def raw_polarity(df: DataFrame, text: str = "norm") -> DataFrame:
    """Add n_pos, n_neg (different terms found), raw_label and raw_score in [0, 1)."""
    counted = compute_once(
        df.withColumn("_words", words(F.coalesce(F.col(text), F.lit("")))),
        {
            "n_pos": F.size(F.array_intersect("_words", literal_array(flat(POSITIVE_TERMS)))),
            "n_neg": F.size(F.array_intersect("_words", literal_array(flat(NEGATIVE_TERMS)))),
        },
    ).drop("_words")
    d: Column = F.col("n_pos") - F.col("n_neg")
    return counted.select(
        "*",
        F.when(d < 0, "negative").when(d > 0, "positive").otherwise("neutral").alias("raw_label"),
        (F.abs(d) / (F.abs(d) + 1)).alias("raw_score"),
    )


def to_public(df: DataFrame) -> DataFrame:
    """Replace raw_label and raw_score with the public label and signed score."""
    return df.withColumns(
        {
            "sentiment_label": public_label(F.col("raw_label")),
            "sentiment_score": signed_score(F.col("raw_label"), F.col("raw_score")),
        }
    )


def score_sentiment(df: DataFrame, text: str = "norm") -> DataFrame:
    """Add n_pos, n_neg, sentiment_label, sentiment_score."""
    return to_public(raw_polarity(df, text)).drop("raw_label", "raw_score")
