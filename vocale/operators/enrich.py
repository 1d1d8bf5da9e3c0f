"""The enrichment job: messages in, analysed documents out, one narrow pass without a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocale.functions.analysis import (
    PROMPT_VERSION, merge_errors, prompt_hash, stage_error,
)
from vocale.functions.text import is_blank, is_empty_text, normalize_text
from vocale.operators.entities import extract_entities
from vocale.operators.sentiment import score_sentiment
from vocale.operators.summarize import summarize_negative

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Scorers:
    """The three stages. Each takes and returns a DataFrame, so a stage may be columns or a
    mapInPandas job; a stage may add sentiment_error, entities_error or summary_error."""

    sentiment: Stage = score_sentiment
    entities: Stage = extract_entities
    summary: Stage = summarize_negative


@dataclass(frozen=True)
class Model:
    task: str
    name: str
    version: str = "unknown"
    revision: str | None = None
    tokenizer: str | None = None
    provider: str = "builtin"


# The stand-ins say what they are.
DEFAULT_MODELS = (
    Model("sentiment", "lexicon", "1", provider="builtin", tokenizer="letters"),
    Model("ner", "patterns", "1", provider="builtin"),
    Model("summary", "extractive", "1", provider="builtin"),
)


def validate_input(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Add reason: why a row cannot be analysed, NULL for a good row. One bad row does not
    hold back the others."""
    reason = F.when(is_blank(F.col(id_col).cast("string")), "blank_id").when(
        is_empty_text(F.col(text)), "blank_text"
    )
    return df.withColumn("reason", reason)


def enrich(
    df: DataFrame,
    scorers: Scorers = Scorers(),
    strict_errors: bool = False,
    max_chars: int | None = None,
) -> DataFrame:
    """Analyse the valid messages.

    Analysis reads whole texts; ``max_chars`` sets the cap a length-limited model needs.
    ``strict_errors`` fails a document on any stage error and drops its output; otherwise the
    good stages are kept and only a missing sentiment fails it.
    """
    valid = validate_input(df).filter(F.col("reason").isNull()).drop("reason")
    base = valid.withColumn("norm", normalize_text(F.col("text"), max_chars))
    scored = scorers.summary(scorers.entities(scorers.sentiment(base)))

    def stage(name: str, column: str) -> Column:
        return stage_error(name, F.col(column)) if column in scored.columns else F.lit(None).cast("string")

    error = merge_errors(
        stage("sentiment", "sentiment_error"), stage("ner", "entities_error"), stage("summary", "summary_error")
    )
    failed = F.col("error").isNotNull() if strict_errors else F.col("sentiment_label").isNull()
    keep = F.lit(True) if not strict_errors else ~failed
    out = scored.withColumn("error", error)
    return out.select(
        *df.columns,
        "norm",
        F.when(keep, F.col("sentiment_label")).alias("sentiment_label"),
        F.when(keep, F.col("sentiment_score")).alias("sentiment_score"),
        F.when(keep, F.col("entities")).alias("entities"),
        F.when(keep, F.col("summary")).alias("summary"),
        "error",
        F.when(failed, "failed").otherwise("done").alias("status"),
    )


def stamp_versions(df: DataFrame, models=DEFAULT_MODELS, git_sha: str = "unknown") -> DataFrame:
    """Add one struct per task plus prompt_version, prompt_hash and service_git_sha."""
    columns = {}
    for m in models:
        columns[f"{m.task}_model"] = F.struct(
            F.lit(m.name).alias("name"),
            F.lit(m.version).alias("version"),
            F.lit(m.revision).cast("string").alias("revision"),
            F.lit(m.tokenizer).cast("string").alias("tokenizer"),
            F.lit(m.provider).alias("provider"),
        )
    columns["prompt_version"] = F.lit(PROMPT_VERSION)
    columns["prompt_hash"] = prompt_hash()
    columns["service_git_sha"] = F.lit(git_sha)
    return df.withColumns(columns)
