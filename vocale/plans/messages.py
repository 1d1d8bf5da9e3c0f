"""Scans, scalar functions and the enrichment stages."""

from __future__ import annotations

import asyncio
import json

from pyspark.sql import functions as F

from vocale.functions import analysis as a
from vocale.functions import text as t
from vocale.functions.ids import stable_uuid
from vocale.operators import inference
from vocale.operators.batches import assign_batches, batch_report
from vocale.operators.calls import bounded_calls
from vocale.operators.classifier import classify, train_classifier
from vocale.operators.enrich import DEFAULT_MODELS, enrich, stamp_versions, validate_input
from vocale.operators.entities import extract_entities, raw_entities
from vocale.operators.lineage import has_entity
from vocale.operators.matching import apply_rules
from vocale.operators.sentiment import score_sentiment
from vocale.operators.summarize import ACTIONS, summarize_negative
from vocale.plans import oracle as o
from vocale.plans.inputs import normalized, rounded, scored, stored, work
from vocale.plans.registry import query
from vocale.sources.feed import spread, table
from vocale.sources.generator import POOLS, SOURCES, generate_feedback
from vocale.sources.messages import decode_response, documents_as_messages


def documents(spark, root):
    return table(spark, root, "documents")


@query(
    "scan_messages",
    """SELECT coalesce(doc_id::VARCHAR, '') AS "ID", coalesce(source, '') AS "SourceID",
       coalesce(lang, '') AS "Lang", coalesce(text, '') AS "Text" FROM documents""",
)
def scan_messages(spark, root):
    return documents_as_messages(documents(spark, root))


# --- text and id columns -------------------------------------------------------------------


@query(
    "normalize_text",
    f"SELECT doc_id, substr({o.collapse('text')}, 1, 4000) AS text, length({o.collapse('text')}) AS whole_chars FROM documents",
)
def normalize_text(spark, root):
    """The capped text, and the length of the whole one."""
    docs = spread(documents(spark, root).select("doc_id", "text"), "doc_id")
    return docs.withColumn("_norm", t.normalize_text(F.col("text"), None)).select(
        "doc_id",
        F.substring("_norm", 1, t.MAX_TEXT_CHARS).alias("text"),
        F.length("_norm").cast("bigint").alias("whole_chars"),
    )


_BLANKS = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('  ', {tab}) WHEN 2 THEN concat('  ', lang, ' ') END"


@query(
    "blank_to_null",
    f"""SELECT doc_id, CASE WHEN {o.trim_space('raw')} <> '' THEN raw END AS value
FROM (SELECT doc_id, {_BLANKS.format(tab='chr(9)')} AS raw FROM documents)""",
)
def blank_to_null(spark, root):
    raw = documents(spark, root).select("doc_id", F.expr(_BLANKS.format(tab="char(9)")).alias("raw"))
    return raw.select("doc_id", t.blank_to_null(F.col("raw")).alias("value"))


_DASHES = "concat_ws('-', substr({x}, 1, 8), substr({x}, 9, 4), substr({x}, 13, 4), substr({x}, 17, 4), substr({x}, 21, 12))"
_HEX = "md5(concat('id', CAST(doc_id AS {s})))"
_RAW_ID = """CASE doc_id % 7
  WHEN 0 THEN {dashed} WHEN 1 THEN upper({dashed}) WHEN 2 THEN concat('{{', {dashed}, '}}')
  WHEN 3 THEN concat('urn:uuid:', {dashed}) WHEN 4 THEN {hex} WHEN 5 THEN '  '
  ELSE concat(' ', source, '/', CAST(doc_id AS {s})) END"""


def _raw_id(string: str) -> str:
    hex_id = _HEX.format(s=string)
    return _RAW_ID.format(dashed=_DASHES.format(x=hex_id), hex=hex_id, s=string)


@query(
    "stable_uuid",
    f"""WITH raw AS (SELECT doc_id, {_raw_id('VARCHAR')} AS raw, concat('document:', source) AS seed FROM documents),
clean AS (
  SELECT *, {o.trim_space('raw')} AS name,
         lower(regexp_replace({o.trim_space('raw')}, '(?i)^urn:uuid:|[{{}}-]', '', 'g')) AS digits FROM raw)
SELECT doc_id, CASE WHEN name = '' THEN {o.uuid5('seed')}
    WHEN regexp_full_match(digits, '[0-9a-f]{{32}}') THEN {_DASHES.format(x='digits')}
    ELSE {o.uuid5('name')} END AS id
FROM clean""",
)
def stable_ids(spark, root):
    raw = documents(spark, root).select("doc_id", "source", F.expr(_raw_id("STRING")).alias("raw"))
    return raw.select("doc_id", stable_uuid(F.col("raw"), F.concat(F.lit("document:"), "source")).alias("id"))


@query(
    "source_label",
    f"""SELECT doc_id, 'source-' || CASE WHEN {o.trim_space('raw')} = '' THEN 'unknown'
  ELSE substr(replace({o.trim_space('raw')}, ' ', '-'), 1, 48) END AS name
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE concat(' ', source, ' ', text) END AS raw FROM documents)""",
)
def source_label(spark, root):
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "source", F.lit(" "), "text"))
    return documents(spark, root).select("doc_id", t.source_name(raw).alias("name"))


@query(
    "status_name",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done'
  WHEN 3 THEN 'failed' ELSE 'unknown' END AS status FROM events""",
)
def status_name(spark, root):
    return table(spark, root, "events").select("event_id", a.status_name(F.col("event_id") % 6).alias("status"))


@query(
    "validate_input",
    f"""SELECT message, CASE WHEN message % 9 = 2 THEN 'blank_id' WHEN {o.collapse('text')} = '' THEN 'blank_text' END AS reason
FROM (SELECT doc_id AS message, CASE WHEN doc_id % 9 = 0 THEN concat(' ', chr(9), chr(160)) WHEN doc_id % 9 = 1 THEN NULL ELSE text END AS text
      FROM documents)""",
)
def validated(spark, root):
    blank = F.concat(F.lit(" "), F.lit("\t"), F.lit(" "))
    text = F.when(F.col("doc_id") % 9 == 0, blank).when(F.col("doc_id") % 9 != 1, F.col("text"))
    blank_id = F.when(F.col("doc_id") % 18 == 2, F.lit(" ")).when(F.col("doc_id") % 9 != 2, F.col("doc_id").cast("string"))
    rows = documents(spark, root).select(F.col("doc_id").alias("message"), blank_id.alias("doc_id"), text.alias("text"))
    return validate_input(rows).select("message", "reason")


# --- labels, errors, times -----------------------------------------------------------------

_RAW_LABEL = """CASE event_type WHEN 'view' THEN 'LABEL_NEGATIVE' WHEN 'click' THEN 'Positive' WHEN 'error' THEN 'posneg'
  WHEN 'signup' THEN 'LABEL_1' END"""


@query(
    "score_to_label",
    f"""SELECT event_id, CASE WHEN contains(raw, 'neg') THEN 'Negative' WHEN contains(raw, 'pos') THEN 'Positive'
    ELSE 'Neutral' END AS sentiment_label,
  round(CASE WHEN contains(raw, 'neg') THEN -p WHEN contains(raw, 'pos') THEN p ELSE 0.0 END, 6) AS sentiment_score
FROM (SELECT event_id, lower(coalesce({_RAW_LABEL}, '')) AS raw, value / (value + 1) AS p FROM events)""",
)
def score_to_label(spark, root):
    raw, p = F.expr(_RAW_LABEL), F.col("value") / (F.col("value") + 1)
    return rounded(
        table(spark, root, "events").select(
            "event_id", a.public_label(raw).alias("sentiment_label"), a.signed_score(raw, p).alias("sentiment_score")
        ),
        "sentiment_score",
    )


_STAGE_ERRORS = (
    ("sentiment", "CASE WHEN event_type = 'error' THEN 'timeout' END"),
    ("ner", "CASE WHEN value > 100 THEN concat('too long for ', event_type) ELSE '' END"),
    ("summary", "CASE WHEN user_id % 3 = 0 THEN 'summarizer_disabled' END"),
)


@query(
    "merge_errors",
    "SELECT event_id, nullif(concat_ws('; ', "
    + ", ".join(f"CASE WHEN ({e}) <> '' THEN '{s}_failed: ' || ({e}) END" for s, e in _STAGE_ERRORS)
    + "), '') AS error FROM events",
)
def merge_errors(spark, root):
    errors = [a.stage_error(stage, F.expr(e)) for stage, e in _STAGE_ERRORS]
    return table(spark, root, "events").select("event_id", a.merge_errors(*errors).alias("error"))


@query(
    "run_interval",
    """SELECT event_id, ms AS processing_ms, started_at, started_at + to_milliseconds(ms) AS completed_at
FROM (SELECT event_id, least(greatest(floor((value - 1) * 1e7)::BIGINT, 0), 2147483647)::INTEGER AS ms,
             CASE WHEN event_type <> 'signup' THEN ts END AS started_at FROM events)""",
)
def run_interval(spark, root):
    ms = a.clamp_ms(F.floor((F.col("value") - 1) * 1e7))
    rows = table(spark, root, "events").select(
        "event_id", ms.alias("processing_ms"), F.when(F.col("event_type") != "signup", F.col("ts")).alias("started_at")
    )
    return rows.withColumn("completed_at", a.run_end(F.col("started_at"), F.col("processing_ms")))


# --- sentiment and entities ----------------------------------------------------------------


@query(
    "score_sentiment",
    f"""WITH {o.SCORED} SELECT doc_id, n_pos, n_neg, sentiment_label, round(sentiment_score, 6) AS sentiment_score
FROM scored""",
)
def sentiment(spark, root):
    docs = scored(spark, root).drop("source", "lang")
    docs = docs.withColumns({c: F.col(c).cast("bigint") for c in ("n_pos", "n_neg")})
    return rounded(docs, "sentiment_score")


_ENTITY_ROWS = f"""WITH {o.FOUND} SELECT doc_id, entity, label, start_at, end_at, score FROM found"""


def _entity_rows(df):
    entity = df.select("doc_id", F.explode_outer("entities").alias("e")).filter("e is not null")
    return entity.select(
        "doc_id",
        F.col("e.text").alias("entity"),
        F.col("e.label").alias("label"),
        F.col("e.start").alias("start_at"),
        F.col("e.end").alias("end_at"),
        F.round(F.col("e.score").cast("double"), 2).alias("score"),
    )


@query("extract_entities", _ENTITY_ROWS)
def entities(spark, root):
    return _entity_rows(extract_entities(normalized(spark, root)))


@query("entity_threshold", _ENTITY_ROWS)
def entity_threshold(spark, root):
    found = raw_entities(normalized(spark, root))
    return _entity_rows(found.select("doc_id", a.keep_entities(F.col("raw_entities")).alias("entities")))


@query(
    "entities_json_roundtrip",
    f"""WITH {o.FOUND}
SELECT d.doc_id, count(f.entity)::INTEGER AS n_entities, coalesce(string_agg(f.label, ',' ORDER BY f.pos), '') AS labels
FROM docs d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id""",
)
def entities_json_roundtrip(spark, root):
    """Entities written as JSON, with ``null`` for none, and read back."""
    docs = extract_entities(normalized(spark, root))
    stored = docs.select(
        "doc_id", F.when(F.size("entities") == 0, "null").otherwise(a.entities_to_json(F.col("entities"))).alias("json")
    )
    back = stored.select("doc_id", a.entities_from_json(F.col("json")).alias("e"))
    return back.select("doc_id", F.size("e").alias("n_entities"), F.array_join("e.label", ",").alias("labels"))


@query(
    "entity_lookup",
    f"""WITH {o.FOUND}
SELECT doc_id, sentiment_label, count(*) FILTER (label = 'EMAIL')::INTEGER AS emails
FROM found GROUP BY ALL HAVING count(*) FILTER (label = 'EMAIL') > 0""",
)
def entity_lookup(spark, root):
    docs = extract_entities(score_sentiment(normalized(spark, root)), offsets=False)
    emails = F.size(F.filter("entities", lambda e: e["label"] == "EMAIL"))
    rows = docs.select(
        "doc_id", "sentiment_label", F.inline_outer(F.array(F.struct(F.col("entities").alias("entities"))))
    )
    return has_entity(rows, "EMAIL").select("doc_id", "sentiment_label", emails.alias("emails"))


@query(
    "quarantine_rules",
    f"""WITH {o.SCORED},
ruled AS (
  SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'id is listed'
                 WHEN contains(lower(text), 'trash') THEN 'text contains "Trash"' END AS rule
  FROM scored)
SELECT doc_id, CASE WHEN rule IS NULL THEN sentiment_label END AS sentiment_label,
       CASE WHEN rule IS NULL THEN round(sentiment_score, 6) END AS sentiment_score,
       CASE WHEN rule IS NULL THEN 'done' ELSE 'failed' END AS status, rule FROM ruled""",
)
def quarantine_rules(spark, root):
    docs = spread(documents(spark, root).select("doc_id", "text"), "doc_id")
    docs = score_sentiment(docs.withColumn("norm", t.normalize_text(F.col("text"), None)))
    listed = table(spark, root, "labels").filter(F.col("toxic") == 1)
    out = apply_rules(docs, listed, contains="Trash")
    return rounded(out.select("doc_id", "sentiment_label", "sentiment_score", "status", "rule"), "sentiment_score")


# --- prompts and summaries -----------------------------------------------------------------

_HEAD, _REST = a.USER_PROMPT.replace("{{", "{").replace("}}", "}").split("{text}")
_MIDDLE, _TAIL = _REST.split("{entities}")


@query(
    "render_prompt",
    f"""WITH {o.FOUND},
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM found),
named AS (
  SELECT doc_id, string_agg(entity || ' (' || label || ')', ', ' ORDER BY pos) AS names
  FROM numbered WHERE n <= 25 GROUP BY doc_id),
prompts AS (
  SELECT doc_id, {o.text(_HEAD)} || substr(norm, 1, 4000) || {o.text(_MIDDLE)} || coalesce(names, 'nessuna')
         || {o.text(_TAIL)} AS prompt
  FROM docs LEFT JOIN named USING (doc_id))
SELECT doc_id, sha256(prompt) AS prompt_sha256, length(prompt)::INTEGER AS prompt_chars FROM prompts""",
)
def render_prompt(spark, root):
    docs = extract_entities(normalized(spark, root))
    prompts = docs.select("doc_id", a.render_prompt(F.col("norm"), F.col("entities")).alias("prompt"))
    return prompts.select("doc_id", F.sha2("prompt", 256).alias("prompt_sha256"), F.length("prompt").alias("prompt_chars"))


_PROMPT_HASH = f"sha256({o.text(a.SYSTEM_PROMPT + a.USER_PROMPT)})"


@query("prompt_hash", f"SELECT doc_id, 'v1' AS prompt_version, {_PROMPT_HASH} AS prompt_hash FROM documents")
def prompt_hash(spark, root):
    return stamp_versions(documents(spark, root).select("doc_id")).select("doc_id", "prompt_version", "prompt_hash")


_GOOD = '{"summary": "Problema da %s", "urgency": "%s", "suggested_action": "Rispondere"%s}'


def _variant(urgency: str, extra: str = "") -> str:
    before, after = (_GOOD % ("\0", urgency, extra)).split("\0")
    return f"concat('{before}', source, '{after}')"


_RAW_SUMMARY = f"""CASE doc_id % 8 WHEN 0 THEN {_variant('alta')} WHEN 1 THEN ' ' WHEN 2 THEN concat('nope ', source)
  WHEN 3 THEN concat('{{"summary": "', source, '", "urgency": "alta"}}')
  WHEN 4 THEN {_variant('media', ', "extra": 1')} WHEN 5 THEN {_variant('bassa')}
  WHEN 6 THEN '{{"summary": 5, "urgency": "alta", "suggested_action": "x"}}'"""


@query(
    "validate_summary",
    f"""WITH {o.DOCS},
raw AS (
  SELECT doc_id, {_RAW_SUMMARY} ELSE '{{"summary": ' || to_json(norm)::VARCHAR || ', "urgency": "critica", "suggested_action": "x"}}'
  END AS raw FROM docs),
parsed AS (SELECT doc_id, trim(raw) AS raw, CASE WHEN json_valid(trim(raw)) THEN trim(raw)::JSON END AS j FROM raw),
checked AS (
  SELECT *, CASE WHEN raw = '' THEN 'empty_summary_response' WHEN j IS NULL THEN 'invalid_summary_json'
    WHEN json_type(j) = 'OBJECT' AND list_sort(json_keys(j)) = ['suggested_action', 'summary', 'urgency']
     AND json_type(j, '$.summary') = 'VARCHAR' AND json_type(j, '$.urgency') = 'VARCHAR'
     AND json_type(j, '$.suggested_action') = 'VARCHAR'
     AND length(j->>'$.summary') BETWEEN 1 AND 200 AND length(j->>'$.suggested_action') BETWEEN 1 AND 200
     AND (j->>'$.urgency') IN ('critica', 'alta', 'media') THEN NULL ELSE 'invalid_summary_schema' END AS summary_error
  FROM parsed)
SELECT doc_id, summary_error, CASE WHEN summary_error IS NULL THEN j->>'$.summary' END AS summary_text,
  CASE WHEN summary_error IS NULL THEN j->>'$.urgency' END AS urgency,
  CASE WHEN summary_error IS NULL THEN '{{"summary": ' || (j->'$.summary')::VARCHAR || ', "urgency": ' || (j->'$.urgency')::VARCHAR
    || ', "suggested_action": ' || (j->'$.suggested_action')::VARCHAR || '}}' END AS summary
FROM checked""",
)
def validate_summary(spark, root):
    whole = F.to_json(
        F.struct(F.col("norm").alias("summary"), F.lit("critica").alias("urgency"), F.lit("x").alias("suggested_action"))
    )
    raw = F.coalesce(F.expr(_RAW_SUMMARY + " END"), whole)
    docs = normalized(spark, root).withColumn("raw_summary", raw)
    return a.validate_summary(docs).select("doc_id", "summary_error", "summary_text", "urgency", "summary")


SUMMARIES = rf"""{o.FOUND},
sentences AS (
  SELECT doc_id, sentiment_label, n_neg,
         list_transform(list_filter(regexp_extract_all(norm, '[^.!?]+[.!?]*'),
              lambda s: list_has_any({o.words('s')}, {o.items(o.flat(o.NEGATIVE_TERMS))})), lambda s: trim(s)) AS hits,
         coalesce(list_filter(hits, lambda s: length(s) <= 200)[1], hits[1]) AS sentence,
         CASE WHEN n_neg >= 3 THEN 'critica' WHEN n_neg = 2 THEN 'alta' ELSE 'media' END AS urgency
  FROM scored),
summaries AS (
  SELECT doc_id, CASE WHEN sentiment_label = 'Negative' AND length(sentence) > 200 THEN 'invalid_summary_schema' END
           AS summary_error,
         CASE WHEN sentiment_label = 'Negative' AND length(sentence) <= 200 THEN
    '{{"summary": ' || to_json(sentence)::VARCHAR || ', "urgency": "' || urgency || '", "suggested_action": "'
    || CASE urgency WHEN 'critica' THEN {o.text(ACTIONS['critica'])} WHEN 'alta' THEN {o.text(ACTIONS['alta'])}
       ELSE {o.text(ACTIONS['media'])} END || '"}}' END AS summary
  FROM sentences)"""


@query(
    "conditional_summary",
    f"WITH {SUMMARIES} SELECT doc_id, sentiment_label, summary, summary_error FROM scored JOIN summaries USING (doc_id)",
)
def conditional_summary(spark, root):
    docs = summarize_negative(score_sentiment(normalized(spark, root)))
    return docs.select("doc_id", "sentiment_label", "summary", "summary_error")


def _service():
    """An outside service that never answers some documents, refuses some, and answers some with what
    is no JSON."""
    async def call(key, prompt):
        if key % 50 == 3:
            await asyncio.Event().wait()
        if key % 20 == 7:
            raise ValueError("refused")
        if key % 30 == 11:
            return "Non lo so"
        return json.dumps({"summary": f"Documento {key}", "urgency": "media", "suggested_action": "Rispondere"})

    return call


@query(
    "summary_calls",
    f"""WITH {o.SCORED},
answered AS (
  SELECT doc_id, sentiment_label, CASE WHEN sentiment_label = 'Negative' THEN
    CASE WHEN doc_id % 50 = 3 THEN 'summary_timeout' WHEN doc_id % 20 = 7 THEN 'refused'
         WHEN doc_id % 30 = 11 THEN 'invalid_summary_json' END END AS summary_error
  FROM scored)
SELECT doc_id, sentiment_label, summary_error, CASE WHEN sentiment_label = 'Negative' AND summary_error IS NULL THEN
  '{{"summary": "Documento ' || doc_id || '", "urgency": "media", "suggested_action": "Rispondere"}}' END AS summary
FROM answered""",
)
def summary_calls(spark, root):
    """Summaries of negative documents from a service: few calls in flight, each with a deadline."""
    docs = extract_entities(score_sentiment(normalized(spark, root)))
    out = summarize_negative(docs, bounded_calls(_service, in_flight=64, deadline=2.0))
    return out.select("doc_id", "sentiment_label", "summary", "summary_error")


@query(
    "enrich",
    f"""WITH {SUMMARIES},
counts AS (SELECT doc_id, count(*)::INTEGER AS n_entities FROM found GROUP BY doc_id)
SELECT doc_id, sentiment_label, round(sentiment_score, 6) AS sentiment_score, coalesce(n_entities, 0)::INTEGER AS n_entities,
       summary, 'summary_failed: ' || summary_error AS error, 'done' AS status
FROM scored JOIN summaries USING (doc_id) LEFT JOIN counts USING (doc_id) WHERE norm <> ''""",
)
def enriched(spark, root):
    docs = spread(documents(spark, root).select("doc_id", "source", "lang", "text"), "doc_id")
    out = enrich(docs).select(
        "doc_id", "sentiment_label", "sentiment_score", F.size("entities").alias("n_entities"), "summary", "error", "status"
    )
    return rounded(out, "sentiment_score")


@query(
    "stamp_versions",
    f"""SELECT doc_id, 'lexicon' AS sentiment_name, 'patterns' AS ner_name, 'extractive' AS summary_name, '1' AS sentiment_version,
       'v1' AS prompt_version, {_PROMPT_HASH} AS prompt_hash, 'unknown' AS service_git_sha FROM documents""",
)
def stamped(spark, root):
    out = stamp_versions(documents(spark, root).select("doc_id"))
    names = [F.col(f"{m.task}_model.name").alias(f"{m.task}_name") for m in DEFAULT_MODELS]
    version = F.col("sentiment_model.version").alias("sentiment_version")
    return out.select("doc_id", *names, version, "prompt_version", "prompt_hash", "service_git_sha")


@query(
    "decode_response",
    f"""WITH {o.FOUND},
counts AS (SELECT doc_id, count(*)::INTEGER AS n_entities FROM found GROUP BY doc_id),
rows AS (
  SELECT doc_id::VARCHAR AS doc_id, 0 AS pos, sentiment_label, round(sentiment_score, 6) AS sentiment_score,
         coalesce(n_entities, 0)::DOUBLE AS n_entities, NULL::VARCHAR AS error
  FROM scored LEFT JOIN counts USING (doc_id)
  UNION ALL SELECT 'unknown-' || doc_id::VARCHAR, 1, NULL, NULL, NULL, 'timeout' FROM docs)
SELECT *, 'lexicon' AS sentiment_model, 'patterns' AS ner_model, 'v1' AS prompt_version FROM rows""",
)
def decoded(spark, root):
    """One response per document: its own result and an unknown one with an error."""
    docs = stamp_versions(extract_entities(score_sentiment(normalized(spark, root))))
    own = F.struct(
        F.col("doc_id").cast("string").alias("doc_id"), "sentiment_score", "sentiment_label", "entities",
        F.lit(None).cast("string").alias("error"),
    )
    other = F.struct(
        F.concat(F.lit("unknown-"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.lit(None).cast("double").alias("sentiment_score"), F.lit(None).cast("string").alias("sentiment_label"),
        F.when(F.lit(False), F.col("entities")).alias("entities"), F.lit("timeout").alias("error"),
    )
    versions = F.struct(
        F.col("sentiment_model").alias("sentiment"), F.col("ner_model").alias("ner"), F.col("summary_model").alias("summary"),
        "prompt_version", "prompt_hash", "service_git_sha",
    )
    value = F.to_json(F.struct(F.array(own, other).alias("results"), versions.alias("model_versions")))
    out = decode_response(docs.select(value.alias("value")))
    return out.select(
        "doc_id", "pos", "sentiment_label", F.round(F.col("sentiment_score").cast("double"), 6).alias("sentiment_score"),
        F.when(F.col("entities").isNotNull(), F.size("entities")).cast("double").alias("n_entities"), "error",
        "sentiment_model", "ner_model", "prompt_version",
    )


# --- Python inference jobs -----------------------------------------------------------------


@query(
    "pack_batches",
    f"""WITH {o.DOCS}
SELECT doc_id, (len(string_split(norm, ' ')) + 2)::INTEGER AS n_tokens, true AS within_budget FROM docs""",
)
def pack_batches(spark, root):
    """Which rows share a pack depends on the partitions; the budget must hold for each."""
    packs = inference.pack(normalized(spark, root).select("doc_id", "norm"))
    fits = (F.col("pack_rows") <= inference.MAX_ROWS) & (
        (F.col("pack_tokens") <= inference.MAX_TOKENS) | (F.col("pack_rows") == 1)
    )
    return packs.select("doc_id", "n_tokens", fits.alias("within_budget"))


@query(
    "score_with_fallback",
    rf"""WITH {o.SCORED}
SELECT doc_id, CASE WHEN words THEN CASE sentiment_label WHEN 'Negative' THEN 'negative' WHEN 'Positive' THEN 'positive'
         ELSE 'neutral' END END AS raw_label,
       CASE WHEN words THEN round(abs(sentiment_score), 6) END AS raw_score,
       CASE WHEN NOT words THEN 'no words' END AS error
FROM (SELECT *, regexp_matches(norm, '\p{{L}}') AS words FROM scored)""",
)
def score_with_fallback(spark, root):
    out = inference.score(normalized(spark, root).select("doc_id", "norm"), inference.lexicon_scorer)
    return rounded(out.select("doc_id", "raw_label", "raw_score", "error"), "raw_score")


@query("extract_with_fallback", _ENTITY_ROWS)
def extract_with_fallback(spark, root):
    """The packed extraction job, with the patterns as its model."""
    out = inference.extract(normalized(spark, root).select("doc_id", "norm"), inference.pattern_extractor)
    return _entity_rows(out.select("doc_id", a.keep_entities(F.col("raw_entities")).alias("entities")))


@query(
    "stage_metrics",
    rf"""WITH {o.DOCS}
SELECT stage, count(*) AS texts,
       count(*) FILTER (stage = 'sentiment' AND NOT regexp_matches(norm, '\p{{L}}')) AS failed, true AS timed
FROM docs, (SELECT unnest(['sentiment', 'ner']) AS stage) GROUP BY stage""",
)
def stage_metrics(spark, root):
    """Both Python stages; their times differ from run to run and are only checked to be there."""
    docs = normalized(spark, root).select("doc_id", "norm")
    stages = {"sentiment": inference.score(docs, inference.lexicon_scorer), "ner": inference.extract(docs, inference.pattern_extractor)}
    made = [inference.stage_metrics(out, name) for name, out in stages.items()]
    timed = (F.col("seconds") > 0) & (F.col("texts_per_second") > 0)
    return made[0].unionByName(made[1]).select("stage", "texts", "failed", timed.alias("timed"))


@query("score_sentiment_ml")
def score_sentiment_ml(spark, root):
    """A trained model's labels and scores are not SQL's to tell; a test holds them against labels
    that it was not fitted on."""
    docs = normalized(spark, root).select("doc_id", "norm")
    out = classify(train_classifier(docs, table(spark, root, "labels")), docs)
    return out.select("doc_id", "sentiment_label", "sentiment_score")


# --- generator and report ------------------------------------------------------------------


def _sql_draw(what: str) -> str:
    return f"('0x' || substr(md5('42|' || event_id || '|{what}'), 1, 8))::BIGINT"


@query(
    "generate_feedback",
    f"""WITH drawn AS (
  SELECT event_id AS row_id, {o.uuid5("'feedback|42|' || event_id")} AS "ID",
         {o.items(SOURCES)}[{_sql_draw('source')} % 3 + 1] AS "SourceID", ['it', 'en'][{_sql_draw('lang')} % 2 + 1] AS "Lang",
         CASE WHEN {_sql_draw('tone')} < {int(0.4 * 2**32)} THEN 'negative' ELSE 'positive' END AS tone,
         {_sql_draw('text')} % 6 + 1 AS choice
  FROM events)
SELECT row_id, "ID", "SourceID", CASE """
    + " ".join(f"WHEN \"Lang\" = '{lang}' AND tone = '{tone}' THEN {o.items(pool)}[choice]" for (lang, tone), pool in POOLS.items())
    + """ END AS "Text", "Lang" FROM drawn""",
)
def generated(spark, root):
    return generate_feedback(table(spark, root, "events"), "event_id")


@query(
    "batch_report",
    f"""WITH {o.WORK}
SELECT source, batch_id, 0 AS line, printf('=== %s %s: %d documents, %d done, %d failed ===', source, batch_id, count(*),
         count(*) FILTER (status = 'done'), count(*) FILTER (status = 'failed')) AS report
FROM work GROUP BY source, batch_id
UNION ALL
SELECT source, batch_id, row_number() OVER (PARTITION BY source, batch_id ORDER BY ts, event_id)::INTEGER,
       printf('[%s] %s %s %s (%.2f) %d ms', doc_id::VARCHAR, lang, status, sentiment_label, sentiment_score, processing_ms)
FROM work""",
)
def report(spark, root):
    return batch_report(assign_batches(stored(spark, work(spark, root), "work")))
