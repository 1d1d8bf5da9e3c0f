"""Upserts as versioned rows plus a latest-wins view, deduplication, registry, replay set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocale.functions.ids import run_uuid, source_uuid, uuid5
from vocale.functions.text import blank_to_null, collapse_space, source_name, trim_space


def latest(df: DataFrame, keys, order: str, first_cols=(), columns=None) -> DataFrame:
    """The last version of each key; ``first_cols`` keep the value of the first version.

    max_by and min_by combine map-side, so a key with very many versions is no hot task.
    """
    columns = list(columns or [c for c in df.columns if c not in keys and c not in first_cols])
    aggs = [F.max_by(F.struct(*columns), F.col(order)).alias("_last")]
    aggs += [F.min_by(F.col(c), F.col(order)).alias(c) for c in first_cols]
    return df.groupBy(*keys).agg(*aggs).select(*keys, "_last.*", *first_cols)


def upsert_sources(messages: DataFrame, order: str) -> DataFrame:
    """source_metadata rows of a batch of messages, reduced to one row per raw source first."""
    used = messages.groupBy("source").agg(F.max(order).alias(order))
    versions = used.select(
        source_uuid(F.col("source")).alias("id"),
        source_name(F.col("source")).alias("name"),
        F.lit("mock").alias("platform_type"),
        F.lit(None).cast("string").alias("url"),
        F.lit("unknown").alias("default_language"),
        order,
    )
    return latest(versions, ["id"], order).drop(order)


def register_models(models: DataFrame, order: str) -> DataFrame:
    """model_version rows: one per (name, version, revision, task, provider), NULL revision equal
    to NULL; the tokenizer of the last registration wins."""

    def or_unknown(c: str) -> Column:
        trimmed = trim_space(F.coalesce(F.col(c), F.lit("")))
        return F.when(trimmed == "", "unknown").otherwise(trimmed)

    key = ["model_name", "version", "revision", "task_type", "provider"]
    versions = models.select(
        or_unknown("name").alias("model_name"),
        or_unknown("version").alias("version"),
        blank_to_null(F.col("revision")).alias("revision"),
        "task_type",
        "provider",
        blank_to_null(F.col("tokenizer")).alias("tokenizer_name"),
        order,
    )
    kept = latest(versions, key, order).drop(order)
    return kept.select(
        model_uuid(*[F.col(c) for c in key]).alias("id"), "*", F.col("model_name").alias("artifact_uri")
    )


def model_uuid(name: Column, version: Column, revision: Column, task: Column, provider: Column) -> Column:
    """Id of a registry row from its key, so every job that registers a model agrees on it."""
    mark = F.coalesce(F.concat(F.lit("="), revision), F.lit("-"))
    return uuid5(F.concat_ws("|", F.lit("model"), name, version, mark, task, provider))


def content_hash(text: Column) -> Column:
    """SHA-256 of the whole normalised text."""
    return F.sha2(collapse_space(text), 256)


def dedup_by_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    """hash, doc_id of its first document, and number of copies; NULL text has no hash.

    Only hashes and ids are shuffled, and they combine map-side whatever the number of copies.
    """
    present = docs.filter(F.col(text).isNotNull())
    hashes = present.select(content_hash(F.col(text)).alias("hash"), "doc_id")
    return hashes.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def unique_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents themselves, the first of each hash; documents without text are all kept."""
    firsts = dedup_by_hash(docs, text).select("doc_id")
    return docs.join(firsts, "doc_id", "left_semi").unionByName(docs.filter(F.col(text).isNull()))


def with_run_id(df: DataFrame, epoch: Column, model_key: Column) -> DataFrame:
    return df.withColumn("run_id", run_uuid(F.col("doc_id"), epoch, model_key))


def replay_set(runs: DataFrame, order: str) -> DataFrame:
    """Documents whose latest run is not done, with that run."""
    last = latest(runs, ["doc_id"], order, columns=["run_id", "status", order])
    return last.filter(F.col("status") != "done")
