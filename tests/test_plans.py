"""What the plans must look like: one pass over texts, pruned scans, no single-task windows."""

import pathlib
import re

import pytest

from __spark_entry__ import queries

DATA = "/root/testdata/sf0.001"


def plan_of(spark, name):
    df = queries()[name](spark, DATA)
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def scans(plan, table):
    return [line for line in plan.splitlines() if "FileScan" in line and f"/{table}.parquet" in line]


@pytest.mark.parametrize(
    "name", ["feedback_hourly_stats", "rolling_volume", "rolling_rate", "rate_change", "negative_rate_by_source"]
)
def test_texts_are_read_once_and_never_shuffled_after_scoring(spark, name):
    plan = plan_of(spark, name)
    with_text = [s for s in scans(plan, "documents") if "text:string" in s]
    assert len(with_text) == 1
    assert "n_chars" not in plan and "MapInPandas" not in plan and "PythonUDF" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["enrich", "conditional_summary", "extract_entities", "decode_response"])
def test_enrichment_has_no_shuffle_but_the_split_of_a_small_scan(spark, name):
    plan = plan_of(spark, name)
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1
    assert plan.count("regexp_replace") == 1


@pytest.mark.parametrize(
    "name", ["rolling_volume", "rate_change", "spike_target", "language_shift", "entity_frequency_delta", "assign_batches"]
)
def test_every_window_is_partitioned(spark, name):
    plan = plan_of(spark, name)
    windows = re.findall(r"windowspecdefinition\(([^,)]+)", plan)
    assert windows and all("ASC" not in w and "DESC" not in w for w in windows)


@pytest.mark.parametrize("name", ["language_distribution", "upsert_sources", "run_ids", "replay_set", "upsert_runs", "resolve_models"])
def test_no_text_is_read_where_no_score_is_used(spark, name):
    assert not any("text:string" in s for s in scans(plan_of(spark, name), "documents"))


def test_nothing_uses_a_machine_local_folder():
    package = pathlib.Path(__file__).resolve().parent.parent / "vocale"
    assert not [p for p in package.rglob("*.py") if re.search(r"tempfile|mkdtemp|gettempdir", p.read_text())]


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "cascade_delete")
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,signup))" in plan
    assert not any("props" in s for s in scans(plan, "events"))
