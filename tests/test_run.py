"""The submitted jobs, end to end on the generator's messages."""

import datetime as dt
import json

from pyspark.sql import functions as F

from vocale import run
from vocale.operators import scoring
from vocale.operators.enrich import enrich
from vocale.operators.hourly import hourly_stats
from vocale.sources.generator import generate_feedback
from vocale.sources.history import history
from vocale.streaming import epochs


def _messages(spark, n):
    return [r.asDict() for r in generate_feedback(spark.range(n), "id").drop("row_id").collect()]


def test_enrich_job(spark, tmp_path):
    path, root = tmp_path / "messages.json", str(tmp_path / "store")
    path.write_text(json.dumps(_messages(spark, 60), ensure_ascii=False))
    run.run_enrich(spark, str(path), root)
    run.run_enrich(spark, str(path), root, 0)
    assert epochs.epochs(spark, root).first()["runs_done"] == 60
    names = {r["name"] for r in epochs.current(spark, root, "source_metadata").collect()}
    assert names == {"source-source-web", "source-source-app", "source-source-email"}
    summaries = epochs.current(spark, root, "analysis_result").filter("summary is not null")
    assert summaries.count() == summaries.filter("sentiment_label = 'Negative'").count() > 0


def test_stream_job_and_restart(spark, tmp_path):
    folder, root, cp = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    folder.mkdir()
    rows = _messages(spark, 40)
    for n in (0, 1):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows[n * 20:n * 20 + 20]))
        run.run_stream(spark, str(folder), root, cp, follow=False)
    assert [r["runs_total"] for r in epochs.epochs(spark, root).orderBy("epoch_id").collect()] == [20, 20]
    assert epochs.current(spark, root, "document").count() == 40


def test_forecast_job_reads_the_stored_history(spark, tmp_path):
    root, out = str(tmp_path / "store"), str(tmp_path / "out")
    start = dt.datetime(2024, 1, 1)
    # Four days of quiet hours, then a burst of complaints, and again.
    hours = spark.range(400).select(F.col("id").alias("hour"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n"))
    burst = (F.col("hour") % 96 >= 90) | (F.col("n") == 0)
    docs = hours.select(
        F.concat_ws("-", "hour", "n").alias("doc_id"), F.lit("app").alias("source"), F.lit("it").alias("lang"),
        F.when(burst, "Acme Corp: servizio pessimo").otherwise("Ottimo").alias("text"),
        (F.col("hour") * 10 + F.col("n")).alias("seq"),
        (F.lit(start) + F.make_dt_interval(hours=F.col("hour").cast("int"))).alias("received_at"),
    )
    early = docs.filter("seq < 3200")
    epochs.write_epoch(enrich(early).drop("norm"), 0, root)
    feed = history({t: epochs.current(spark, root, t) for t in epochs.KEYS})
    stats = hourly_stats(feed)
    assert stats.count() == 320
    assert stats.agg(F.sum("total")).first()[0] == 1920
    assert run.run_forecast(spark, root, out, hold=40)
    assert spark.read.parquet(f"{out}/feedback_hourly_stats").count() == 320
    first = scoring.latest_fit(spark, out)
    newest = stats.agg(F.max("h")).first()[0]
    assert (first["fitted_before"], scoring.scored_upto(spark, out)) == (newest - 40, newest - 1)

    # The same history again: nothing is scored twice. Then new hours, with the stored model.
    assert run.run_forecast(spark, root, out, hold=40)
    assert spark.read.parquet(f"{out}/scored").count() == 1
    epochs.write_epoch(enrich(docs.filter("seq >= 3200")).drop("norm"), 1, root)
    assert run.run_forecast(spark, root, out, hold=40)
    assert scoring.latest_fit(spark, out)["model"] == first["model"]
    runs = [(r["first"], r["upto"]) for r in spark.read.parquet(f"{out}/scored").orderBy("first").collect()]
    assert runs == [(newest - 40, newest - 1), (newest, newest + 79)]
    alerts = scoring.stored_alerts(spark, out).collect()
    assert alerts and min(r["h"] for r in alerts) >= first["fitted_before"]
    assert len({r["h"] for r in alerts}) == len(alerts)
    assert all(r["reason"] in (None, "Acme Corp") for r in alerts)

    # Alerts without the row of their run are not read.
    lost = spark.createDataFrame([(1, 0.9, "x")], "h bigint, probability double, reason string")
    lost.write.parquet(f"{out}/alerts/run=unfinished")
    assert scoring.stored_alerts(spark, out).count() == len(alerts)
    assert run.run_forecast(spark, root, out, hold=40, refit=True)
    assert scoring.latest_fit(spark, out)["fitted_before"] == newest + 80 - 40


def test_forecast_without_spikes_stores_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    quiet = spark.range(100).select(F.col("id").alias("h"), F.lit(1).alias("future_negatives"), F.lit(0.5).alias("f"))
    assert scoring.fit_and_store(spark, out, quiet, 80, [], []) is None
    assert scoring.latest_fit(spark, out) is None and scoring.scored_upto(spark, out) is None
    assert scoring.stored_alerts(spark, out).count() == 0
