"""Queries on small tables of their own: rows that the given tables have only at larger sizes."""

import datetime as dt

import pytest

from oracle_check import connect, differences
from vocale.operators import inference
from vocale.plans import ORACLES, QUERIES

HOUR = dt.datetime(2024, 1, 1, 5, 30)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Documents with long sentences, and two arrivals of each."""
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = [
        "terrible " + "and so on " * 30, "awful, broken, useless " + "and so on " * 30 + ".", "The worst. Rude.", "great", None, "  ",
    ]
    docs = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    events = [(i, HOUR + dt.timedelta(minutes=25 * i), 1, "view", 0.5, None) for i in range(2 * len(texts))]
    for name, rows, ddl in (
        ("documents", docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("events", events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
    ):
        spark.createDataFrame(rows, ddl).toPandas().to_parquet(f"{folder}/{name}.parquet", coerce_timestamps="us")
    return folder


def test_urgency_counts_negative_documents_without_a_short_sentence(spark, root):
    ours = QUERIES["urgency_mix"](spark, root).toPandas()
    assert differences(ours, connect(root).execute(ORACLES["urgency_mix"]).df()) == []
    assert dict(ours.groupby("urgency")["total"].sum()) == {"media": 2, "alta": 2, "critica": 2}


def test_texts_without_an_address_are_not_searched_for_one(monkeypatch):
    import regex

    tried = []
    compiled = regex.compile

    class Watched:
        def __init__(self, pattern):
            self.pattern, self.inner = pattern, compiled(pattern)

        def finditer(self, text):
            tried.append(("@" in self.pattern, text))
            return self.inner.finditer(text)

    monkeypatch.setattr(regex, "compile", Watched)
    texts = ["x Acme Corp +1 (555) 123-4567 10.0.0.1 Rossi", "to a.b@c.org Acme", "\u00c9cole 1.2.3.4.5 +39 (1) x"]
    out = inference.pattern_extractor()(texts)
    assert tried == [("@" in t, t) for t in texts]
    assert [[e["text"] for e in row] for row in out] == [
        ["Acme Corp", "+1 (555) 123-4567", "10.0.0.1", "Rossi"], ["a.b@c.org", "Acme"], ["\u00c9cole", "1.2.3.4"]]


def test_one_large_row_group_is_dealt_over_the_cores(spark, tmp_path):
    from pyspark.sql import functions as F

    from vocale.sources.feed import spread

    spark.range(50_000).coalesce(1).write.parquet(str(tmp_path / "rows"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        df = spark.read.parquet(str(tmp_path / "rows"))
        cores = spark.sparkContext.defaultParallelism
        assert df.rdd.getNumPartitions() >= cores
        assert spread(df, "id").select(F.spark_partition_id().alias("p")).distinct().count() >= cores
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_lineage_deals_no_runs_by_source(spark):
    """Runs have very many rows of few sources: the plan shuffles them by document and run only, and
    what is the same for all runs is not grouped with them."""
    from vocale.operators import lineage as ln
    from vocale.operators.tables import to_tables

    batch = spark.createDataFrame(
        [("1", "web", "en", None, "done", None, "Positive", 0.5, [], None, 1, HOUR, HOUR, 5, 7),
         ("1", "web", "en", None, "failed", "x", None, None, None, None, 2, HOUR, HOUR, 5, 7),
         ("2", "web", "en", None, "done", None, "Positive", 0.5, [], None, 3, HOUR, HOUR, 5, 7)],
        "doc_id string, source string, lang string, text string, status string, error string, sentiment_label string, "
        "sentiment_score double, entities array<struct<text:string,label:string,start:int,end:int>>, summary string, seq long, "
        "received_at timestamp, started_at timestamp, processing_ms long, epoch_id long")
    out = ln.lineage(to_tables(batch))
    logical = out._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in logical.splitlines() if "Aggregate [run_id" in line]
    assert grouped and not any("git" in line or "prompt" in line or "unknown" in line for line in grouped)
    joined = [line for line in logical.splitlines() if "Join Inner" in line]
    assert len(joined) > 1 and "document_id" in joined[0] and "source_id" in joined[1]
    rows = {r["run_status"]: r for r in out.collect()}
    assert len(rows) == 2 and rows["failed"]["sentiment_label"] is None and rows["done"]["service_git_sha"] == "unknown"
    assert rows["done"]["sentiment_model"] == "lexicon" and rows["done"]["source_name"] == "source-web" and rows["done"]["prompt_hash"]


def test_parts_of_a_spread_table_do_not_grow_with_it(spark, tmp_path):
    from vocale.sources.feed import spread

    spark.range(400_000).coalesce(1).write.parquet(str(tmp_path / "rows"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        df = spark.read.parquet(str(tmp_path / "rows"))
        cuts = df.rdd.getNumPartitions()
        assert cuts > 2 * spark.sparkContext.defaultParallelism
        assert spread(df, "id").rdd.getNumPartitions() == cuts
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
