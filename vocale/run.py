"""Jobs to submit: ``spark-submit --py-files vocale.zip submit.py enrich|stream|replay|delete|compact|forecast ...``.

enrich    read messages once and store one epoch
stream    follow a folder of message files and store an epoch per micro-batch
replay    run failed documents again, up to a number of tries
delete    delete the runs that a parquet table (run_id) names, with their results
compact   fold the marked epochs up to one into a base copy of each table
forecast  score the new hours of the stored history with the stored model (fitted by the first run)
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocale.operators import forecast as fc
from vocale.operators import scoring
from vocale.operators.rolling import entity_delta, top_rising
from vocale.schemas import MESSAGE
from vocale.sources.messages import read_messages, stream_messages
from vocale.streaming import epochs
from vocale.streaming.jobs import FLUSH, enrich_stream, replay, to_store


def as_documents(messages: DataFrame) -> DataFrame:
    """Messages under the names the enrichment uses."""
    return messages.select(
        F.col("ID").alias("doc_id"), F.col("SourceID").alias("source"), F.col("Lang").alias("lang"),
        F.col("Text").alias("text"),
    )


def run_enrich(
    spark: SparkSession, path: str, root: str, epoch_id: int | None = None, multiline: bool = True,
    strict_errors: bool = False,
) -> None:
    """Store the messages of ``path`` as one epoch: the next free one, or ``epoch_id`` to run the same
    messages again."""
    number = epochs.next_epoch(spark, root) if epoch_id is None else epoch_id
    if not 0 <= number < epochs.STREAM_BASE:
        raise ValueError(f"the epoch of a batch must be 0..{epochs.STREAM_BASE - 1}")
    messages = as_documents(read_messages(spark, path, multiline))
    to_store(messages, number, root, path, strict_errors=strict_errors)


def run_stream(
    spark: SparkSession, path: str, root: str, checkpoint: str, max_files: int | None = None, follow: bool = True,
    strict_errors: bool = False,
) -> None:
    messages = stream_messages(spark, path, MESSAGE, max_files, fmt="json")
    flush = FLUSH if follow else None
    query = enrich_stream(spark, as_documents(messages), root, checkpoint, flush=flush, strict_errors=strict_errors)
    query.awaitTermination()


def most_frequent(counts: DataFrame, column: str, limit: int = 50) -> list[str]:
    """The ``limit`` values with most feedback; the forecast puts all others into one column."""
    totals = counts.filter(F.col(column).isNotNull()).groupBy(column).agg(F.sum("total").alias("n"))
    return sorted(r[0] for r in totals.orderBy(F.desc("n"), column).limit(limit).collect())


def run_forecast(
    spark: SparkSession, root: str, out: str, sources: list[str] | None = None, languages: list[str] | None = None,
    cut: float = 0.5, hold: int = 120, refit: bool = False,
) -> bool:
    """Score the hours of the stored history that no run has scored yet, and store their alerts below
    ``out``; False when there is no model, as the history holds no spike to learn from.

    The first run, and one with ``refit``, fits a model on the hours before the last ``hold`` ones and
    stores it; later runs use the stored model with its features and cut. Hours that a model was
    fitted on are never scored by it. The newest hour is still filling and waits. The hours come
    from the table that the epochs keep, so neither runs nor texts are read. It and the training
    table are written below ``out`` and read back: the model passes over one row per hour. Sources
    and languages with columns of their own are the most frequent ones of the history unless given.
    """
    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    counts = stored(epochs.hourly_table(spark, root), "feedback_hourly_stats")
    mentions = stored(epochs.hourly_table(spark, root, "mention_part"), "entity_hourly")
    newest = counts.agg(F.max("h")).first()[0]
    if newest is None:
        return False
    fit = None if refit else scoring.latest_fit(spark, out)
    if fit is not None:
        sources, languages = fit["sources"], fit["languages"]
    sources = most_frequent(counts, "source") if sources is None else sources
    languages = most_frequent(counts, "lang") if languages is None else languages
    table = stored(fc.training_table(counts, mentions, sources, languages), "training_table")
    if fit is None:
        fit = scoring.fit_and_store(spark, out, table, newest - hold, sources, languages, cut)
    if fit is None:
        return False
    scoring.score_new(spark, out, fit, table, top_rising(entity_delta(mentions)), newest - 1)
    return True


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("enrich")
    one.add_argument("path")
    one.add_argument("root")
    one.add_argument("--epoch", type=int, help="the number of an epoch to run again; the next free one if left out")
    one.add_argument("--lines", action="store_true", help="JSON lines instead of arrays")
    follow = jobs.add_parser("stream")
    for name in ("path", "root", "checkpoint"):
        follow.add_argument(name)
    follow.add_argument("--max-files", type=int)
    fold = jobs.add_parser("compact")
    fold.add_argument("root")
    fold.add_argument("upto", type=int)
    again = jobs.add_parser("replay")
    again.add_argument("root")
    again.add_argument("--tries", type=int, default=3)
    gone = jobs.add_parser("delete")
    gone.add_argument("root")
    gone.add_argument("runs", help="a parquet table with run_id")
    ahead = jobs.add_parser("forecast")
    ahead.add_argument("root")
    ahead.add_argument("out")
    ahead.add_argument("--sources", help="comma-separated; the 50 most frequent ones of the history if left out")
    ahead.add_argument("--languages", help="the same for languages")
    ahead.add_argument("--cut", type=float, default=0.5)
    ahead.add_argument("--hold", type=int, default=120, help="newest hours that a fit leaves out, to be scored")
    ahead.add_argument("--refit", action="store_true", help="fit a new model in place of using the stored one")
    for job in (one, follow, again):
        job.add_argument("--strict-errors", action="store_true", help="any stage error fails the document")
    a = parser.parse_args()

    spark = SparkSession.builder.appName(f"vocale-{a.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.job == "enrich":
        run_enrich(spark, a.path, a.root, a.epoch, not a.lines, a.strict_errors)
    elif a.job == "compact":
        epochs.compact(spark, a.root, a.upto)
    elif a.job == "replay":
        replay(spark, a.root, max_tries=a.tries, strict_errors=a.strict_errors)
    elif a.job == "delete":
        epochs.delete_runs(spark, a.root, spark.read.parquet(a.runs))
    elif a.job == "stream":
        run_stream(spark, a.path, a.root, a.checkpoint, a.max_files, strict_errors=a.strict_errors)
    elif not run_forecast(
        spark, a.root, a.out, a.sources and a.sources.split(","), a.languages and a.languages.split(","), a.cut,
        a.hold, a.refit,
    ):
        print("no spike in the history: no model, no alerts")


if __name__ == "__main__":
    main()
