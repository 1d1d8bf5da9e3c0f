"""The store's hourly parts, replays and deletes."""

import datetime as dt

from pyspark.sql import functions as F

from vocale.operators.enrich import Scorers
from vocale.operators.sentiment import score_sentiment
from vocale.streaming import epochs, jobs

DOCS = "doc_id string, source string, lang string, text string, seq bigint, received_at timestamp"
HOUR = dt.datetime(2024, 1, 1, 5)


def _messages(spark, rows):
    return spark.createDataFrame([(*r, HOUR + dt.timedelta(hours=r[-1] or 0)) for r in rows], DOCS)


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def _same_as_recount(spark, root):
    again = epochs.recount(spark, root)
    for name in epochs.PARTS:
        assert _rows(epochs.hourly_table(spark, root, name)) == _rows(again[name]), name


def test_parts_follow_replays_deletes_and_folding(spark, tmp_path):
    root = str(tmp_path)
    first = _messages(spark, [
        ("a", "s", "it", "pessimo servizio Acme Corp", 1), ("b", None, None, "ottimo", 2),
        ("a", "s", "it", "pessimo Acme Corp", 3), ("c", "s", "en", "bad broken Acme Corp", None), ("d", "s", "en", " ", 4),
    ])
    second = _messages(spark, [("e", "s", "it", "pessimo", 1), ("b", None, None, "pessimo", 2)])
    jobs.to_store(first, 0, root, "one")
    _same_as_recount(spark, root)
    # Two deliveries of a document are one run: the last message counts, at the time of the first.
    counted = {(r["source"], r["lang"], r["h"] % 24): (r["total"], r["negatives"]) for r in epochs.hourly_table(spark, root).collect()}
    assert counted == {("source-s", "it", 6): (1, 1), ("source-unknown", None, 7): (1, 0), ("source-s", "en", 5): (1, 1)}
    before = _rows(epochs.hourly_table(spark, root))
    jobs.to_store(first, 0, root, "one")
    assert _rows(epochs.hourly_table(spark, root)) == before
    jobs.to_store(second, 1, root, "two")
    _same_as_recount(spark, root)

    runs = epochs.current(spark, root, "analysis_run").select(F.col("id").alias("run_id"), "created_at")
    assert runs.count() == 5
    gone = runs.filter(F.hour("created_at") == 6).select("run_id")
    epochs.delete_runs(spark, root, gone.union(gone).union(spark.createDataFrame([("not there",)], "run_id string")))
    _same_as_recount(spark, root)
    assert epochs.current(spark, root, "analysis_result").count() == 3
    after = _rows(epochs.hourly_table(spark, root))
    epochs.delete_runs(spark, root, gone)  # once more: nothing is taken away twice
    assert _rows(epochs.hourly_table(spark, root)) == after
    epochs.compact(spark, root, 3)
    assert _rows(epochs.hourly_table(spark, root)) == after
    folded = spark.read.parquet(f"{root}/bases/upto=3/analysis_run")
    assert folded.count() == 3 and epochs.current(spark, root, "analysis_run").count() == 3
    jobs.to_store(first, 0, root, "one")  # a replay of a folded epoch brings no deleted run back
    assert epochs.current(spark, root, "analysis_run").count() == 3
    hashes = {r["hash"] for r in epochs.current(spark, root, "document").collect()}
    assert None not in hashes and all(len(x) == 64 for x in hashes)
    assert not list((tmp_path / "staging").rglob("*.parquet"))


def test_replays_end(spark, tmp_path):
    root = str(tmp_path)

    def never(df):
        bad = F.col("doc_id") == "lost"
        scored = score_sentiment(df)
        return scored.withColumns({"sentiment_label": F.when(~bad, F.col("sentiment_label")),
                                   "sentiment_error": F.when(bad, F.lit("no answer"))})

    jobs.to_store(_messages(spark, [("lost", "s", "it", "pessimo", 1), ("fine", "s", "it", "ottimo", 2)]), 0, root, "one", Scorers(sentiment=never))
    assert [tuple(r) for r in epochs.attempts(spark, root, 2).collect()] == [("lost", 1, "sentiment_failed: no answer", "waiting")]
    assert jobs.replay(spark, root, Scorers(sentiment=never), max_tries=2) == 1
    assert epochs.attempts(spark, root, 2).first()["outcome"] == "given_up"
    assert jobs.replay(spark, root, Scorers(sentiment=never), max_tries=2) == 0
    assert jobs.replay(spark, root, max_tries=3) == 1  # with stages that answer
    assert epochs.attempts(spark, root, 3).first()["outcome"] == "done" and epochs.waiting(spark, root).count() == 0
    table = epochs.hourly_table(spark, root).collect()
    assert sorted((r["h"] % 24, r["total"]) for r in table) == [(6, 1), (7, 1)]


def test_no_text_is_sorted_or_shuffled_on_the_way_to_the_store(spark, tmp_path):
    staged = _messages(spark, [("a", "s", "it", "x", 1), ("a", "s", "it", "y", 2), ("b", "s", "it", "z", 3)]).withColumn(
        "row", F.monotonically_increasing_id())
    staged.write.parquet(str(tmp_path / "rows"))
    once = epochs._once_each(spark.read.parquet(str(tmp_path / "rows")), str(tmp_path / "again"))
    assert sorted(r["text"] for r in once.collect()) == ["y", "z"]
    plan = once._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Sort " not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
