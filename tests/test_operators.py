"""Golden cases, edge rows and invariants of the operators."""

import datetime as dt
import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vocale.functions.analysis import NEGATIVE
from vocale.functions.lexicon import lexicon_table
from vocale.operators import batches, forecast, hourly, inference, matching, rolling, upserts
from vocale.operators.calls import bounded_calls
from vocale.operators.classifier import classify, train_classifier
from vocale.operators.enrich import Scorers, enrich, validate_input
from vocale.operators.entities import extract_entities, raw_entities
from vocale.operators.sentiment import score_sentiment, to_public
from vocale.operators.summarize import summarize_negative
from vocale.sources.feed import arrivals, arrivals_by_hour, feed, hourly_feed
from vocale.sources.generator import POOLS, generate_feedback
from vocale.sources.messages import read_messages

DOCS = "doc_id string, source string, lang string, text string"


def test_match_results_golden(spark):
    docs = spark.createDataFrame([("doc-1",), ("doc-2",), ("doc-3",)], "doc_id string")
    results = spark.createDataFrame(
        [(0, "doc-1", "Positive", 0.9, None), (1, "doc-1", "Negative", -0.1, None), (2, "doc-99", "Neutral", 0.0, None)],
        "pos int, doc_id string, sentiment_label string, sentiment_score double, error string",
    )
    got = {r["doc_id"]: r for r in matching.match_results(docs, results).collect()}
    assert [got[f"doc-{i}"]["status"] for i in (1, 2, 3)] == ["done", "failed", "failed"]
    assert (got["doc-1"]["sentiment_label"], got["doc-1"]["sentiment_score"]) == ("Positive", 0.9)
    assert got["doc-2"]["error"] == "missing result for doc_id=doc-2"
    audit = {(r["doc_id"], r["anomaly"], r["rows"]) for r in matching.match_audit(docs, results).collect()}
    assert audit == {
        ("doc-1", "duplicate", 1), ("doc-99", "unknown", 1), ("doc-2", "missing", 0), ("doc-3", "missing", 0),
    }


def test_match_results_error_modes(spark):
    docs = spark.createDataFrame([("a",)], "doc_id string")
    results = spark.createDataFrame(
        [(0, "a", "Negative", -0.5, "summary_failed: x")],
        "pos int, doc_id string, sentiment_label string, sentiment_score double, error string",
    )
    strict = matching.match_results(docs, results).first()
    assert (strict["status"], strict["sentiment_label"]) == ("failed", None)
    assert strict["error"] == "inference error: summary_failed: x"
    kept = matching.match_results(docs, results, strict_errors=False).first()
    assert (kept["status"], kept["sentiment_label"]) == ("done", "Negative")


def test_quarantine_id_wins_over_text(spark):
    docs = spark.createDataFrame(
        [("a", "an ERROR here"), ("b", "an ERROR here"), ("c", "fine")], "doc_id string, text string"
    ).withColumns({"sentiment_label": F.lit("Positive"), "sentiment_score": F.lit(0.5)})
    ids = matching.rule_ids(spark, " a,,a , ")
    got = {r["doc_id"]: (r["status"], r["rule"], r["sentiment_label"]) for r in matching.apply_rules(docs, ids, "error").collect()}
    assert got == {
        "a": ("failed", "id is listed", None),
        "b": ("failed", 'text contains "error"', None),
        "c": ("done", None, "Positive"),
    }


def test_validate_input(spark):
    rows = [("1", "s", "it", "ok"), (" ", "s", "it", "ok"), ("3", "s", "it", None), ("4", "s", "it", "  \x1c"), (None, "s", "it", "")]
    got = [r["reason"] for r in validate_input(spark.createDataFrame(rows, DOCS)).collect()]
    assert got == [None, "blank_id", "blank_text", "blank_text", "blank_id"]


def test_entity_offsets_are_code_points_of_the_normalised_text(spark):
    text = "😀 scrivi a mario.rossi@example.com o +39 (055) 123-4567 da 10.0.0.1, Acme Corp a Roma. Acme Corp"
    docs = spark.createDataFrame([(text,)], "norm string")
    found = extract_entities(docs).first()["entities"]
    assert [(e["label"], e["text"]) for e in found] == [
        ("EMAIL", "mario.rossi@example.com"), ("PHONE", "+39 (055) 123-4567"), ("IP", "10.0.0.1"),
        ("ORG", "Acme Corp"), ("LOC", "Roma"), ("ORG", "Acme Corp"),
    ]
    assert all(text[e["start"]:e["end"]] == e["text"] for e in found)
    assert raw_entities(spark.createDataFrame([("",)], "norm string")).first()["raw_entities"] == []
    fast = extract_entities(docs, offsets=False).first()["entities"]
    assert [e["text"] for e in fast] == [e["text"] for e in found]


def test_lexicon_scores_the_sample_pools(spark):
    rows = [(tone, text) for (_, tone), pool in POOLS.items() for text in pool]
    docs = spark.createDataFrame(rows, "tone string, norm string")
    got = score_sentiment(docs).collect()
    wrong = [r["norm"] for r in got if r["sentiment_label"] == ("Positive" if r["tone"] == "negative" else "Negative")]
    assert len(wrong) <= 1
    assert lexicon_table(spark).filter("polarity < 0").count() > 10


def test_enrich_keeps_good_stages_and_strict_drops_them(spark):
    docs = spark.createDataFrame(
        [("1", "s", "en", "You idiot. This  is\tfine."), ("2", "s", "en", "Great, thanks"), ("3", "s", "en", " ")], DOCS
    )
    disabled = Scorers(summary=lambda df: summarize_negative(df, enabled=False))
    kept = {r["doc_id"]: r for r in enrich(docs, disabled).collect()}
    assert set(kept) == {"1", "2"}
    assert (kept["1"]["status"], kept["1"]["sentiment_label"]) == ("done", NEGATIVE)
    assert kept["1"]["error"] == "summary_failed: summarizer_disabled"
    assert kept["2"]["error"] is None
    strict = {r["doc_id"]: r for r in enrich(docs, disabled, strict_errors=True).collect()}
    assert (strict["1"]["status"], strict["1"]["sentiment_label"]) == ("failed", None)
    summary = json.loads({r["doc_id"]: r for r in enrich(docs).collect()}["1"]["summary"])
    assert summary == {"summary": "You idiot.", "urgency": "media", "suggested_action": "Rispondere al cliente entro due giorni"}


def test_summary_generator_sees_only_negative_rows(spark):
    docs = score_sentiment(
        spark.createDataFrame([("1", "what an idiot"), ("2", "great"), ("3", "trash"), ("4", "scum")], "doc_id string, norm string")
    ).withColumn("entities", F.array(F.struct(F.lit("A").alias("text"), F.lit("ORG").alias("label"))))

    def generator(frames):
        for f in frames:
            assert f["prompt"].str.contains("A (ORG)", regex=False).all()
            raw = {"1": '{"summary":"s","urgency":"alta","suggested_action":"a"}', "3": "nope", "4": None}
            yield f.assign(
                raw_summary=f["doc_id"].map(raw), raw_error=f["doc_id"].map({"4": "summary_timeout"}).astype(object)
            )

    got = {r["doc_id"]: (r["summary"], r["summary_error"]) for r in summarize_negative(docs, generator).collect()}
    assert got == {
        "1": ('{"summary": "s", "urgency": "alta", "suggested_action": "a"}', None), "2": (None, None),
        "3": (None, "invalid_summary_json"), "4": (None, "summary_timeout"),
    }


def test_packs_keep_the_budget_and_all_rows(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 700).cast("int")).alias("norm")
    ).repartition(3, "doc_id")
    rows = inference.pack(docs)
    assert rows.count() == 3000 and rows.select("doc_id").distinct().count() == 3000
    packs = rows.groupBy("pack_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.first("pack_rows").alias("r"))
    for p in packs.collect():
        assert p["n"] == p["r"] <= 32 and (p["t"] <= 6000 or p["n"] == 1)
    big = inference.pack(docs, max_tokens=100).filter("n_tokens > 100").select("pack_rows").distinct().collect()
    assert [r["pack_rows"] for r in big] == [1]


def test_failing_pack_is_retried_per_document(spark):
    docs = spark.createDataFrame([(i, "bad" if i % 7 == 0 else "good text") for i in range(100)], "doc_id int, norm string")

    def make():
        def run(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("cannot read")
            return [{"label": "positive", "score": 0.9} for _ in texts]

        return run

    got = inference.score(docs, make).collect()
    assert {r["doc_id"] for r in got if r["error"] == "cannot read"} == set(range(0, 100, 7))
    assert all(r["raw_label"] == "positive" for r in got if r["error"] is None)
    public = to_public(inference.score(docs, make)).filter("doc_id = 1").first()
    assert (public["sentiment_label"], public["sentiment_score"]) == ("Positive", 0.9)
    m = inference.stage_metrics(inference.score(docs, make), "sentiment").first()
    assert (m["texts"], m["failed"]) == (100, 15) and m["seconds"] > 0


def test_python_extractor_job(spark):
    docs = spark.createDataFrame([(1, "Acme"), (2, "bad")], "doc_id int, norm string")

    def make():
        def run(texts):
            if "bad" in texts:
                raise ValueError("x")
            return [[{"text": t, "label": "ORG", "start": 0, "end": len(t), "score": 0.9}] for t in texts]

        return run

    got = {r["doc_id"]: r for r in inference.extract(docs, make).collect()}
    assert got[1]["raw_entities"][0]["text"] == "Acme" and got[1]["error"] is None
    assert got[2]["raw_entities"] == [] and got[2]["error"] == "x"


def test_batches_number_a_hot_source_like_a_plain_count(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=37 * (i % 500)), "hot" if i % 3 else f"s{i % 5}") for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, source string")
    got = {r["event_id"]: r["batch_no"] for r in batches.assign_batches(df).collect()}
    expected, seen = {}, {}
    for event_id, ts, source in sorted(rows, key=lambda r: (r[1], r[0])):
        n = seen[source] = seen.get(source, 0) + 1
        expected[event_id] = (n - 1) // 32 + 1
    assert got == expected
    with pytest.raises(ValueError):
        batches.assign_batches(df, 257)


def test_batches_keep_messages_without_source_or_time(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 3 == 0 else base + dt.timedelta(seconds=i), None if i % 4 == 0 else "s") for i in range(9000, 19000, 7)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, source string")
    got = {r["event_id"]: r["batch_no"] for r in batches.assign_batches(df).collect()}
    expected, seen = {}, {}
    for event_id, ts, source in sorted(rows, key=lambda r: (r[1] is not None, r[1] or base, r[0])):
        n = seen[source] = seen.get(source, 0) + 1
        expected[event_id] = (n - 1) // 32 + 1
    assert got == expected


def test_reconcile_counts_batches_without_a_key(spark):
    rows = spark.createDataFrame([(None, "done"), (None, "done"), ("b", "failed")], "batch_id string, status string")
    got = {r["batch_id"]: (r["runs_total"], r["ok"]) for r in batches.reconcile(rows, rows, rows.filter("status = 'done'")).collect()}
    assert got == {None: (2, True), "b": (1, True)}


def test_hours_of_an_unknown_language_are_counted(spark):
    counts = spark.createDataFrame([(None, 1, 5), (None, 3, 2), ("it", 2, 1)], "lang string, h long, total long")
    got = {(r["lang"], r["h"]): r["total"] for r in hourly.dense(counts, "lang").collect()}
    assert got == {(None, 1): 5, (None, 2): 0, (None, 3): 2, ("it", 2): 1, ("it", 3): 0}


def test_offsets_of_many_matches(spark):
    text = "di Mario Rossi e " * 10_000
    start = time.perf_counter()
    found = raw_entities(spark.createDataFrame([(text,), ("Mario e Rossi",), ("",)], "norm string")).collect()
    assert time.perf_counter() - start < 60
    assert [(e["start"], e["end"]) for e in found[0]["raw_entities"]] == [(17 * i + 3, 17 * i + 14) for i in range(10_000)]
    assert [e["start"] for e in found[1]["raw_entities"]] == [0, 8] and found[2]["raw_entities"] == []


def test_long_addresses_are_whole(spark):
    local = "a" * 80 + ".b"
    docs = spark.createDataFrame([(f"scrivi a {local}@example.com o {'x' * 50000}",)], "norm string")
    found = extract_entities(docs).first()["entities"]
    assert [e["text"] for e in found] == [f"{local}@example.com"]
    assert (found[0]["start"], found[0]["end"]) == (9, 9 + len(local) + 12)


def test_long_texts_count_whole_and_sentences_are_not_cut(spark):
    docs = spark.createDataFrame([(i, "w " * 20_000) for i in range(11)], "doc_id int, norm string").coalesce(1)
    assert {r["pack_rows"] for r in inference.pack(docs).collect()} == {1}
    short = inference.pack(docs, max_length=512).collect()
    assert {(r["n_tokens"], r["pack_rows"]) for r in short} == {(512, 11)}
    long = "pessimo " + "molto " * 60 + "davvero."
    rows = [(1, f"{long} Servizio pessimo."), (2, long)]
    out = summarize_negative(score_sentiment(spark.createDataFrame(rows, "doc_id int, norm string"))).collect()
    got = {r["doc_id"]: (r["summary"], r["summary_error"]) for r in out}
    assert '"summary": "Servizio pessimo."' in got[1][0] and got[2] == (None, "invalid_summary_schema")


def test_reconcile_golden_and_unfinished(spark):
    runs = spark.createDataFrame([("b", "done"), ("b", "failed")], "batch_id string, status string")
    results = runs.filter("status = 'done'")
    row = batches.reconcile(runs, runs, results).first()
    assert (row["runs_total"], row["runs_done"], row["runs_failed"], row["results_total"], row["ok"]) == (2, 1, 1, 1, True)
    assert not batches.reconcile(runs, results, results).first()["ok"]
    stuck = runs.withColumn("status", F.lit("processing"))
    assert not batches.reconcile(stuck, stuck, results.limit(0)).first()["ok"]


def test_latest_keeps_the_first_received_at(spark):
    rows = [("k", 1, "a", 10), ("k", 2, "b", 20), ("k", 3, None, 30), ("j", 1, "x", 5)]
    df = spark.createDataFrame(rows, "id string, seq int, v string, received_at int")
    got = {r["id"]: (r["v"], r["received_at"]) for r in upserts.latest(df, ["id"], "seq", ("received_at",)).collect()}
    assert got == {"k": (None, 10), "j": ("x", 5)}


def test_model_with_null_revision_is_one_row(spark):
    rows = [(1, "m", None, None, "t1", "summary", "p"), (2, " m ", "", " ", "t2", "summary", "p"), (3, "", "1", "r", "", "ner", "p")]
    df = spark.createDataFrame(
        rows, "seq int, name string, version string, revision string, tokenizer string, task_type string, provider string"
    )
    got = {r["model_name"]: r for r in upserts.register_models(df, "seq").collect()}
    assert set(got) == {"m", "unknown"}
    assert (got["m"]["version"], got["m"]["revision"], got["m"]["tokenizer_name"]) == ("unknown", None, "t2")
    assert got["unknown"]["tokenizer_name"] is None


def test_dedup_reads_whole_texts(spark):
    long = "x" * 5000
    rows = [(3, "a  b"), (1, " a b "), (2, long + "1"), (4, long + "2"), (5, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    groups = {r["doc_id"]: r["copies"] for r in upserts.dedup_by_hash(docs).collect()}
    assert groups == {1: 2, 2: 1, 4: 1}
    assert {r["doc_id"] for r in upserts.unique_documents(docs).collect()} == {1, 2, 4, 5, 6}


def _counts(spark, values):
    rows = [(h, t, n, float(-n)) for h, t, n in values]
    return spark.createDataFrame(rows, "h bigint, total bigint, negatives bigint, neg_score_sum double")


def test_dense_fills_gaps_and_merge_adds(spark):
    counts = _counts(spark, [(10, 2, 1), (13, 1, 0)])
    got = [tuple(r) for r in hourly.dense(counts).orderBy("h").collect()]
    assert got == [(10, 2, 1, -1.0), (11, 0, 0, 0.0), (12, 0, 0, 0.0), (13, 1, 0, 0.0)]
    merged = hourly.merge_hourly(counts, _counts(spark, [(13, 4, 2)])).orderBy("h").collect()
    assert [tuple(r) for r in merged] == [(10, 2, 1, -1.0), (13, 5, 2, -2.0)]


def test_blocks_equal_a_plain_loop(spark):
    import random

    rnd = random.Random(3)
    values = [(h, rnd.randint(0, 4), 0) for h in range(480_000, 482_500)]
    values = [(h, t, rnd.randint(0, t)) for h, t, _ in values]
    neg = {h: n for h, _, n in values}
    tot = {h: t for h, t, _ in values}
    stats = _counts(spark, values)
    rows = rolling.rolling(stats, (6, 168), change=True).collect()
    assert len(rows) == len(values)

    def rate(h, x):
        hours = [k for k in range(h - x + 1, h + 1) if k in tot]
        t = sum(tot[k] for k in hours)
        return sum(neg[k] for k in hours) / t if t else None

    for r in rows:
        h = r["h"]
        assert r["negative_volume_168h"] == sum(neg.get(k, 0) for k in range(h - 167, h + 1))
        now, before = rate(h, 6), rate(h - 6, 6)
        expected = None if now is None or before is None else now - before
        assert r["negative_rate_change_6h"] == (None if expected is None else pytest.approx(expected))
    future = {r["h"]: r["future_negatives"] for r in rolling.future_negatives(stats).collect()}
    last = max(neg)
    for h in neg:
        assert future[h] == (sum(neg[k] for k in range(h + 1, h + 25)) if h + 24 <= last else None)


def test_entity_delta_of_every_hour_equals_a_plain_loop(spark):
    import random

    rnd = random.Random(5)
    mentions = {(e, rnd.randint(0, 900) + 5000): rnd.randint(1, 9) for e in "abc" for _ in range(12)}
    mentions[("d", 5000)] = 4
    rows = [(e, "ORG", h, n) for (e, h), n in mentions.items()]
    table = spark.createDataFrame(rows, "entity string, label string, h bigint, mentions bigint")
    expected = {}
    for h in range(5000, 6200):
        for e in "abcd":
            old = {k: n for (x, k), n in mentions.items() if x == e and h - 192 < k <= h}
            if old:
                delta = sum(n for k, n in old.items() if k > h - 24) - sum(n for k, n in old.items() if k <= h - 24) / 7
                expected[h] = max(delta, expected.get(h, -1e9))
    got = {r["h"]: r["delta"] for r in rolling.peak_delta(table).collect()}
    assert got.keys() == expected.keys()
    assert all(got[h] == pytest.approx(expected[h]) for h in got)
    assert min(expected.values()) < 0
    assert rolling.peak_delta(table.limit(0)).count() == 0


def test_trained_sentiment_on_labels_it_was_not_fitted_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", F.col("text").alias("norm"))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = train_classifier(docs, labels.filter("doc_id % 2 = 0"))
    out = classify(model, docs).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    told = out.groupBy("toxic", "sentiment_label").count().collect()
    n = {(r["toxic"], r["sentiment_label"]): r["count"] for r in told}
    assert {label for _, label in n} <= {"Negative", "Neutral"}
    caught = n.get((1, "Negative"), 0) / max(1, sum(v for (t, _), v in n.items() if t == 1))
    wrong = n.get((0, "Negative"), 0) / max(1, sum(v for (t, _), v in n.items() if t == 0))
    assert caught >= 0.7 and wrong <= 0.02
    scores = out.groupBy("sentiment_label").agg(F.min("sentiment_score").alias("low"), F.max("sentiment_score").alias("high"))
    for r in scores.collect():
        assert -1 <= r["low"] <= r["high"] < 0 if r["sentiment_label"] == "Negative" else r["low"] == r["high"] == 0


def test_calls_keep_their_window_order_and_deadline(spark):
    import asyncio

    open_calls = {"now": 0, "most": 0}

    def make_client():
        async def call(key, prompt):
            open_calls["now"] += 1
            open_calls["most"] = max(open_calls["most"], open_calls["now"])
            try:
                await asyncio.sleep(60 if key % 10 == 3 else 0.001)
                if key % 10 == 7:
                    raise ValueError("refused")
                if key % 10 == 8:
                    raise KeyError
                return f"{key}:{prompt}"
            finally:
                open_calls["now"] -= 1

        return call

    frame = pd.DataFrame({"doc_id": range(40), "prompt": [f"p{k}" for k in range(40)]}, index=range(100, 140))
    (got,) = bounded_calls(make_client, in_flight=4, deadline=0.2)(iter([frame]))
    assert got["doc_id"].tolist() == list(range(40)) and open_calls["most"] == 4 and open_calls["now"] == 0
    for k, answer, error in zip(got["doc_id"], got["raw_summary"], got["raw_error"]):
        expected = {3: "summary_timeout", 7: "refused", 8: "KeyError"}.get(k % 10)
        assert (answer, error) == ((None, expected) if expected else (f"{k}:p{k}", None))
    empty = list(bounded_calls(make_client)(iter([frame.head(0)])))
    assert len(empty[0]) == 0 and {"raw_summary", "raw_error"} <= set(empty[0].columns)
    with pytest.raises(ValueError):
        bounded_calls(make_client, in_flight=0)


def test_folds_do_not_leak(spark):
    table = spark.range(0, 1000).select(
        F.col("id").alias("h"), (F.col("id") % 50).alias("future_negatives"), F.lit(1).alias("negative_volume_24h")
    )
    rows = forecast.with_target(forecast.folds(table, period=100, first=3, purge=24))
    per_fold = rows.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("h"))).alias("last"),
        F.min(F.when(F.col("role") == "test", F.col("h"))).alias("first"),
        F.count_if(F.col("role") == "test").alias("n"),
        F.first("threshold").alias("threshold"),
    )
    for r in per_fold.collect():
        assert r["first"] == r["fold"] * 100 and r["last"] == r["first"] - 25 and r["n"] == 100
        train = [h % 50 for h in range(r["last"] + 1)]
        mean = sum(train) / len(train)
        sd = (sum((x - mean) ** 2 for x in train) / (len(train) - 1)) ** 0.5
        assert r["threshold"] == pytest.approx(mean + 2 * sd)


def test_one_class_folds_have_no_model_and_others_do(spark):
    table = spark.range(0, 600).select(
        F.col("id").alias("h"),
        F.when((F.col("id") % 97 < 4) & (F.col("id") > 200), 50).otherwise(1).alias("future_negatives"),
        (F.col("id") % 97).cast("double").alias("f1"),
    )
    rows = forecast.with_target(forecast.folds(table, period=150, first=1))
    out = forecast.train_forecast(rows).groupBy("fold").agg(
        F.count_if(F.col("probability").isNull()).alias("none"), F.count("*").alias("n")
    )
    got = {r["fold"]: (r["none"], r["n"]) for r in out.collect()}
    assert got[1] == (150, 150)
    assert got[3][0] == 0
    m = forecast.metrics(forecast.train_forecast(rows)).filter("fold = 3").first()
    assert m["recall"] == 1.0


def test_alert_reasons(spark):
    scored = spark.createDataFrame([(1, 0.9), (2, 0.2), (3, 0.8)], "h bigint, probability double")
    rising = spark.createDataFrame([(1, "B", 2), (1, "A", 1)], "h bigint, entity string, rank int")
    got = {r["h"]: r["reason"] for r in forecast.alerts(scored, rising).collect()}
    assert got == {1: "A, B", 3: None}


def test_generator_is_repeatable_and_near_the_ratio(spark):
    rows = generate_feedback(spark.range(4000), "id", negative_ratio=0.4)
    again = generate_feedback(spark.range(4000).repartition(5), "id", negative_ratio=0.4)
    assert rows.exceptAll(again).count() == 0
    negatives = [t for (_, tone), pool in POOLS.items() if tone == "negative" for t in pool]
    share = rows.filter(F.col("Text").isin(negatives)).count() / 4000
    assert 0.36 < share < 0.44
    assert rows.filter(F.col("Text").isNull()).count() == 0 and rows.select("ID").distinct().count() == 4000


def test_json_messages(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps([{"ID": "1", "Text": "ciao", "other": 3}, {"ID": "2", "SourceID": "s", "Lang": "it"}]))
    got = [tuple(r) for r in read_messages(spark, str(path)).orderBy("ID").collect()]
    assert got == [("1", "", "", "ciao"), ("2", "s", "it", "")]


def test_one_document_with_a_third_of_all_arrivals(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(0 if i % 3 == 0 else i, base + dt.timedelta(minutes=i % 600)) for i in range(6000)]
    events = spark.createDataFrame([(i, ts) for i, ts in rows], "event_id bigint, ts timestamp")
    docs = spark.range(100).select(F.col("id").alias("doc_id"))
    scored_docs = docs.select(
        "doc_id", F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")).alias("source"),
        F.when(F.col("doc_id") % 4 == 0, NEGATIVE).otherwise("Neutral").alias("sentiment_label"),
        F.when(F.col("doc_id") % 4 == 0, -0.5).otherwise(0.0).alias("sentiment_score"),
    )
    counted = hourly_feed(events, docs, scored_docs)
    assert counted.filter("doc_id = 0").count() == 10
    got = {(r["source"], r["h"]): (r["total"], r["negatives"], r["neg_score_sum"])
           for r in hourly.hourly_counts(counted, "source").collect()}
    expected = {}
    for event_id, ts in rows:
        doc, h = event_id % 100, int(ts.timestamp() // 3600) if ts.tzinfo else int((ts - dt.datetime(1970, 1, 1)).total_seconds() // 3600)
        t, n, s = expected.get((f"s{doc % 2}", h), (0, 0, 0.0))
        neg = doc % 4 == 0
        expected[(f"s{doc % 2}", h)] = (t + 1, n + neg, s - 0.5 * neg)
    assert got == expected
    row_level = {(r["source"], r["h"]): (r["total"], r["negatives"], r["neg_score_sum"])
                 for r in hourly.hourly_counts(feed(events, docs, scored_docs), "source").collect()}
    assert row_level == expected
    mentions = spark.createDataFrame([(0, "A", "ORG", 2), (4, "A", "ORG", 1)], "doc_id bigint, entity string, label string, per_doc int")
    total = hourly.entity_hourly(arrivals_by_hour(arrivals(events, docs)), mentions).agg(F.sum("mentions")).first()[0]
    assert total == sum(2 if e % 100 == 0 else 1 if e % 100 == 4 else 0 for e, _ in rows)


def test_results_of_one_id_with_a_third_of_all_rows(spark):
    rows = [(i, "hot" if i % 3 else f"d{i}", "Positive" if i == 1 else "Negative", 0.1, None) for i in range(3000)]
    results = spark.createDataFrame(
        rows, "pos int, doc_id string, sentiment_label string, sentiment_score double, error string"
    ).repartition(6)
    docs = results.select("doc_id").distinct()
    got = {r["doc_id"]: r["sentiment_label"] for r in matching.match_results(docs, results).collect()}
    assert got["hot"] == "Positive" and len(got) == 1001
