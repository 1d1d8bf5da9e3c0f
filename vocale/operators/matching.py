"""Match results back to documents by id, and quarantine rules.

Groups are reduced with min_by, which combines map-side: an id with any number of copies costs
one row per task, and nothing is sorted or collected per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocale.functions.text import trim_space

OUTPUTS = ("sentiment_label", "sentiment_score")


def first_results(results: DataFrame, columns=OUTPUTS, pos: str = "pos") -> DataFrame:
    """The result with the lowest position of each doc_id."""
    row = F.struct(*columns, "error")
    first = results.groupBy("doc_id").agg(F.min_by(row, F.col(pos)).alias("r"), F.count(F.lit(1)).alias("copies"))
    return first.select("doc_id", "r.*", "copies")


def match_results(docs: DataFrame, results: DataFrame, strict_errors: bool = True, columns=OUTPUTS) -> DataFrame:
    """Documents with the output, status and error of their first result.

    No result fails a document; with ``strict_errors`` any error does, and drops the output.
    """
    first = first_results(results, columns).withColumn("_seen", F.lit(True))
    joined = docs.join(first, "doc_id", "left")
    seen = F.coalesce(F.col("_seen"), F.lit(False))
    has_error = F.coalesce(F.col("error"), F.lit("")) != ""
    failed = ~seen | has_error if strict_errors else ~seen
    return joined.select(
        *docs.columns,
        *[F.when(~failed, F.col(c)).alias(c) for c in columns],
        F.when(failed, "failed").otherwise("done").alias("status"),
        F.when(~seen, F.concat(F.lit("missing result for doc_id="), F.col("doc_id").cast("string")))
        .when(has_error, F.concat(F.lit("inference error: "), F.col("error")))
        .alias("error"),
    )


def match_audit(docs: DataFrame, results: DataFrame) -> DataFrame:
    """One row per anomaly: unknown and duplicate results, missing documents, with row counts."""
    counts = results.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    ids = docs.select("doc_id").withColumn("_known", F.lit(True))
    both = counts.join(ids, "doc_id", "full")
    known = F.col("_known").isNotNull()
    anomaly = (
        F.when(~known, "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    )
    extra = F.when(~known, F.col("n")).otherwise(F.coalesce(F.col("n") - 1, F.lit(0)))
    return both.select("doc_id", anomaly.alias("anomaly"), extra.cast("bigint").alias("rows")).filter(
        "anomaly is not null"
    )


def rule_ids(spark: SparkSession, listed: str) -> DataFrame:
    """doc_id rows of a comma-separated list; outer blanks and empty entries are dropped."""
    entry = F.explode(F.split(F.lit(listed), ",")).alias("raw")
    ids = spark.range(1).select(entry).select(trim_space(F.col("raw")).alias("doc_id"))
    return ids.filter("doc_id <> ''").distinct()


def apply_rules(
    df: DataFrame, ids: DataFrame | None = None, contains: str | None = None,
    outputs=("sentiment_label", "sentiment_score"),
) -> DataFrame:
    """Quarantine rules: a row whose id is listed, or else whose text contains the phrase in any
    case, is failed with the reason and its outputs are cleared."""
    matched = df
    by_id: Column = F.lit(False)
    if ids is not None:
        listed = ids.select("doc_id").distinct().withColumn("_listed", F.lit(True))
        matched = df.join(listed, "doc_id", "left")
        by_id = F.coalesce(F.col("_listed"), F.lit(False))
    by_text: Column = F.lit(False)
    if contains:
        by_text = F.coalesce(F.lower("text").contains(contains.lower()), F.lit(False))
    reason = F.when(by_id, "id is listed").when(by_text, f'text contains "{contains}"')
    hit = F.col("rule").isNotNull()
    cleared = {c: F.when(~hit, F.col(c)) for c in outputs}
    status = F.col("status") if "status" in df.columns else F.lit("done")
    return (
        matched.withColumn("rule", reason)
        .withColumns(cleared)
        .withColumn("status", F.when(hit, "failed").otherwise(status))
        .select(*dict.fromkeys([*df.columns, "status", "rule"]))
    )
