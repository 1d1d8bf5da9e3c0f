"""Scalar columns against plain Python."""

import hashlib
import json
import uuid

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vocale.functions import analysis as a
from vocale.functions import text as t
from vocale.functions.ids import run_uuid, stable_uuid

BMP = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]


def one(spark, value, column, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(column.alias("r")).first()["r"]


def column_of(spark, values, column, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r["r"] for r in df.select("i", column.alias("r")).orderBy("i").collect()]


def test_whitespace_is_that_of_split(spark):
    values = [f"a{c}b" for c in BMP]
    ours = column_of(spark, values, t.collapse_space(F.col("v")))
    assert ours == [" ".join(v.split()) for v in values]


def test_trim_and_blank_on_the_whole_plane(spark):
    kept = {chr(c) for c in range(0x1C, 0x20)}
    space = {c for c in BMP if c.isspace()} - kept
    got = column_of(spark, BMP, F.struct(t.is_blank(F.col("v")).alias("b"), t.trim_space(F.col("v")).alias("t")))
    assert {c for c, r in zip(BMP, got) if r["b"]} == space
    assert {c for c, r in zip(BMP, got) if r["t"] == ""} == space
    empty = column_of(spark, BMP, t.is_empty_text(F.col("v")))
    assert {c for c, e in zip(BMP, empty) if e} == space | kept


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \t  \x1c😀"), max_size=30), min_size=1, max_size=40))
def test_normalize_text(spark_values):
    from pyspark.sql import SparkSession

    ours = column_of(SparkSession.getActiveSession(), spark_values, t.normalize_text(F.col("v"), 7))
    assert ours == [" ".join(v.split())[:7] for v in spark_values]


def test_cap_counts_code_points(spark):
    assert one(spark, "😀" * 4001 + " x", F.length(t.normalize_text(F.col("v")))) == 4000
    assert one(spark, "😀" * 4001 + " x", F.length(t.normalize_text(F.col("v"), None))) == 4003
    assert one(spark, None, t.normalize_text(F.col("v"))) == ""


def test_blank_to_null_keeps_the_untrimmed_value(spark):
    assert column_of(spark, [None, "", " \t", " x "], t.blank_to_null(F.col("v"))) == [None, None, None, " x "]


def test_label_slug(spark):
    values = [None, "  ", "web shop", "x" * 60]
    assert column_of(spark, values, t.source_name(F.col("v"))) == [
        "source-unknown", "source-unknown", "source-web-shop", "source-" + "x" * 48,
    ]


def test_stable_uuid_is_uuid5_or_the_parsed_id(spark):
    known = str(uuid.UUID(int=0x1234567890ABCDEF1234567890ABCDEF))
    spellings = [known, known.upper(), "{%s}" % known, "urn:uuid:" + known, known.replace("-", ""), f" {known} "]
    assert column_of(spark, spellings, stable_uuid(F.col("v"))) == [known] * len(spellings)
    names = ["doc-1", "è 😀", "{%s" % known, known + "0", "source/1"]
    assert column_of(spark, names, stable_uuid(F.col("v"))) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert one(spark, " ", stable_uuid(F.col("v"), F.lit("source: "))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "source: "))
    lost = column_of(spark, ["", ""], stable_uuid(F.col("v"), F.lit(" ")))
    assert lost[0] != lost[1] and all(uuid.UUID(x) for x in lost)


def test_run_uuid_depends_on_document_epoch_and_model_only(spark):
    got = column_of(spark, ["d", "d", "e"], run_uuid(F.col("v"), F.lit(3), F.lit("m")))
    assert got[0] == got[1] != got[2]


def test_labels_and_scores(spark):
    raw = ["LABEL_NEG", "positive", "posneg", "neutral", None, ""]
    label = column_of(spark, raw, a.public_label(F.col("v")))
    assert label == ["Negative", "Positive", "Negative", "Neutral", "Neutral", "Neutral"]
    score = column_of(spark, raw, a.signed_score(F.col("v"), F.lit(0.7)))
    assert score == [-0.7, 0.7, -0.7, 0.0, 0.0, 0.0]


def test_status_names(spark):
    got = column_of(spark, [0, 1, 2, 3, 4, None], a.status_name(F.col("v")), "int")
    assert got == ["pending", "processing", "done", "failed", "unknown", "unknown"]


def test_merge_errors(spark):
    df = spark.createDataFrame([(None, None), ("", "b"), ("a", ""), ("a", "b")], "a string, b string")
    got = [r["r"] for r in df.select(a.merge_errors(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [None, "b", "a", "a; b"]


def test_run_interval_clamps(spark):
    values = [-5, 0, 120, 2**40]
    assert column_of(spark, values, a.clamp_ms(F.col("v")), "bigint") == [0, 0, 120, 2**31 - 1]
    end = one(spark, "2024-01-01 00:00:00", a.run_end(F.to_timestamp("v"), F.lit(1500)).cast("string"))
    assert end == "2024-01-01 00:00:01.5"
    assert one(spark, None, a.run_end(F.to_timestamp("v"), F.lit(1500))) is None


def test_entities_json(spark):
    got = column_of(
        spark, [None, "null", "[]", '[{"text":"A","label":"ORG","start":1,"end":2,"score":0.9}]'],
        F.size(a.entities_from_json(F.col("v"))),
    )
    assert got == [0, 0, 0, 1]
    assert one(spark, "null", a.entities_to_json(a.entities_from_json(F.col("v")))) == "[]"


def test_entity_threshold_is_inclusive_and_fills_defaults(spark):
    row = [[(None, None, None, None, 0.8), ("x", "ORG", 0, 1, 0.79), ("y", "LOC", 1, 2, None)]]
    df = spark.createDataFrame([row], "e array<struct<text:string,label:string,start:int,end:int,score:double>>")
    kept = df.select(a.keep_entities(F.col("e")).alias("k")).first()["k"]
    assert [tuple(k)[:4] for k in kept] == [("", "", 0, 0)]


def test_prompt(spark):
    ents = F.array(*[
        F.struct(F.lit(f"E{i}").alias("text"), F.lit("ORG").alias("label")) for i in range(30)
    ])
    prompt = one(spark, " Ciao   mondo {text} ", a.render_prompt(F.col("v"), ents))
    expected = a.USER_PROMPT.format(
        text="Ciao mondo {text}", entities=", ".join(f"E{i} (ORG)" for i in range(25))
    )
    assert prompt == expected
    none = one(spark, "x", a.render_prompt(F.col("v"), F.slice(ents, 1, 0)))
    assert "Entità rilevate nel testo: nessuna\n" in none
    digest = hashlib.sha256((a.SYSTEM_PROMPT + a.USER_PROMPT).encode()).hexdigest()
    assert one(spark, "x", a.prompt_hash()) == digest


def _summary(**changes):
    base = {"summary": "Così \"rotto\"", "urgency": "alta", "suggested_action": "Agire"}
    return json.dumps({**base, **changes}, ensure_ascii=False)


@pytest.mark.parametrize(
    "raw, error",
    [
        (_summary(), None),
        ("  " + _summary() + " ", None),
        (_summary(summary="x" * 200), None),
        (None, "empty_summary_response"),
        ("  ", "empty_summary_response"),
        ("nope", "invalid_summary_json"),
        ("{", "invalid_summary_json"),
        ("[1]", "invalid_summary_schema"),
        ("5", "invalid_summary_schema"),
        ('{"summary": "a", "urgency": "alta"}', "invalid_summary_schema"),
        (_summary(extra=1), "invalid_summary_schema"),
        (_summary(urgency="bassa"), "invalid_summary_schema"),
        (_summary(summary="x" * 201), "invalid_summary_schema"),
        (_summary(summary=""), "invalid_summary_schema"),
        (_summary(summary=5), "invalid_summary_schema"),
        (_summary(summary=None), "invalid_summary_schema"),
    ],
)
def test_validate_summary(spark, raw, error):
    row = a.validate_summary(spark.createDataFrame([(raw,)], "raw_summary string")).first()
    assert row["summary_error"] == error
    if error is None:
        assert row["summary"] == json.dumps(json.loads(raw), ensure_ascii=False)
    else:
        assert row["summary"] is None and row["urgency"] is None
