"""Matching, lineage, upserts, batches and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocale.functions.analysis import PROMPT_VERSION, SYSTEM_PROMPT, USER_PROMPT
from vocale.functions.ids import document_uuid, run_uuid, source_uuid, uuid5
from vocale.functions.text import blank_to_null
from vocale.operators import batches, lineage as ln, matching, tables as tb, upserts
from vocale.operators.enrich import DEFAULT_MODELS, enrich, stamp_versions
from vocale.plans import oracle as o
from vocale.plans.inputs import feedback, rounded, stored, work
from vocale.plans.messages import SUMMARIES
from vocale.plans.registry import query
from vocale.sources.feed import arrivals, spread, table

# --- result matching -----------------------------------------------------------------------


def _results(spark, root):
    """Inference results in arrival order; ids repeat, some are unknown, some documents have none."""
    return table(spark, root, "events").select(
        F.col("event_id").alias("pos"),
        F.floor(F.col("value") * 10).alias("doc_id"),
        F.when(F.col("event_type") == "view", "Negative").otherwise("Positive").alias("sentiment_label"),
        F.round(F.col("value") / (F.col("value") + 1), 6).alias("sentiment_score"),
        F.when(F.col("event_type") == "error", "timeout").alias("error"),
    )


_RESULTS = """results AS (
  SELECT event_id AS pos, floor(value * 10)::BIGINT AS doc_id,
         CASE WHEN event_type = 'view' THEN 'Negative' ELSE 'Positive' END AS sentiment_label,
         round(value / (value + 1), 6) AS sentiment_score,
         CASE WHEN event_type = 'error' THEN 'timeout' END AS error
  FROM events)"""


@query(
    "match_results",
    f"""WITH {_RESULTS},
firsts AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1)
SELECT d.doc_id, CASE WHEN f.error IS NULL THEN f.sentiment_label END AS sentiment_label,
       CASE WHEN f.error IS NULL THEN f.sentiment_score END AS sentiment_score,
       CASE WHEN f.pos IS NULL OR f.error IS NOT NULL THEN 'failed' ELSE 'done' END AS status,
       CASE WHEN f.pos IS NULL THEN 'missing result for doc_id=' || d.doc_id
            WHEN f.error IS NOT NULL THEN 'inference error: ' || f.error END AS error
FROM documents d LEFT JOIN firsts f USING (doc_id)""",
)
def match_results(spark, root):
    return matching.match_results(table(spark, root, "documents").select("doc_id"), _results(spark, root))


@query(
    "match_audit",
    f"""WITH {_RESULTS}, counts AS (SELECT doc_id, count(*) AS n FROM results GROUP BY doc_id)
SELECT doc_id, 'unknown' AS anomaly, n AS rows FROM counts WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'duplicate', n - 1 FROM counts WHERE n > 1 AND doc_id IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'missing', 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM counts)""",
)
def match_audit(spark, root):
    return matching.match_audit(table(spark, root, "documents"), _results(spark, root))


# --- upserts -------------------------------------------------------------------------------


@query(
    "upsert_sources",
    f"""SELECT DISTINCT {o.uuid5('source')} AS id, 'source-' || source AS name, 'mock' AS platform_type,
       NULL::VARCHAR AS url, 'unknown' AS default_language FROM documents""",
)
def upsert_sources(spark, root):
    return upserts.upsert_sources(feedback(spark, root, scores=False), "event_id")


_LANGUAGE = "CASE WHEN event_type = 'signup' THEN ' ' WHEN event_type = 'view' THEN {upper} ELSE lang END"


@query(
    "upsert_documents",
    f"""WITH {o.DOCS}, {o.ARRIVALS},
versions AS (
  SELECT a.event_id, a.ts, d.doc_id, d.source, d.text, {_LANGUAGE.format(upper='upper(lang)')} AS language,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status,
         row_number() OVER (PARTITION BY d.doc_id ORDER BY event_id DESC) AS from_last,
         first_value(ts) OVER (PARTITION BY d.doc_id ORDER BY event_id) AS received_at
  FROM arrivals a JOIN docs d USING (doc_id))
SELECT {o.uuid5('doc_id::VARCHAR')} AS id, {o.uuid5('source')} AS source_id, text AS original_text, NULL::VARCHAR AS hash,
       CASE WHEN trim(language) <> '' THEN language END AS language, status, received_at
FROM versions WHERE from_last = 1""",
)
def upsert_documents(spark, root):
    """Each arrival is a version of its document: the last one wins, received_at stays the first."""
    arrived = arrivals(table(spark, root, "events"), table(spark, root, "documents"))
    versions = arrived.select("event_id", "doc_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("received_at"))
    # Versions are reduced first, so that a text is joined and moved once per document.
    last = upserts.latest(versions, ["doc_id"], "event_id", ("received_at",), ["event_type"])
    docs = table(spark, root, "documents").select("doc_id", "source", "lang", "text")
    return last.join(docs, "doc_id").select(
        document_uuid(F.col("doc_id")).alias("id"),
        source_uuid(F.col("source")).alias("source_id"),
        F.col("text").alias("original_text"),
        F.lit(None).cast("string").alias("hash"),
        blank_to_null(F.expr(_LANGUAGE.format(upper="upper(lang)"))).alias("language"),
        F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"),
        "received_at",
    )


_MODEL = {
    "name": "CASE WHEN event_type = 'signup' THEN ' ' ELSE event_type END",
    "version": "CASE WHEN user_id % 2 = 0 THEN '1' ELSE '' END",
    "revision": "CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'r1' END",
    "tokenizer": "CASE WHEN user_id % 5 = 0 THEN '' ELSE props END",
}
_CLEAN_MODEL = f"""models AS (
  SELECT event_id, task_type, coalesce(nullif(trim({_MODEL['name']}), ''), 'unknown') AS model_name,
         coalesce(nullif(trim({_MODEL['version']}), ''), 'unknown') AS version,
         nullif(trim({_MODEL['revision']}), '') AS revision, nullif({_MODEL['tokenizer']}, '') AS tokenizer_name
  FROM events, (SELECT unnest(['sentiment', 'ner', 'summary']) AS task_type)),
registry AS (
  SELECT *, {o.uuid5("'model|' || model_name || '|' || version || '|' || coalesce('=' || revision, '-') || '|' || task_type || '|builtin'")} AS id
  FROM models QUALIFY row_number() OVER (PARTITION BY task_type, model_name, version, revision ORDER BY event_id DESC) = 1)"""


def _registry(spark, root):
    columns = [F.expr(e).alias(c) for c, e in _MODEL.items()]
    tasks = F.explode(F.array(*[F.lit(t) for t in ln.TASKS])).alias("task_type")
    used = table(spark, root, "events").select("event_id", *columns, F.lit("builtin").alias("provider"), tasks)
    return upserts.register_models(used, "event_id")


@query(
    "register_models",
    f"""WITH {_CLEAN_MODEL}
SELECT id, model_name, version, revision, task_type, 'builtin' AS provider, tokenizer_name, model_name AS artifact_uri
FROM registry""",
)
def register_models(spark, root):
    return _registry(spark, root)


@query(
    "resolve_models",
    f"""WITH {_CLEAN_MODEL}
SELECT m.event_id, max(r.id) FILTER (m.task_type = 'sentiment') AS sentiment_model_id,
       max(r.id) FILTER (m.task_type = 'ner') AS ner_model_id, max(r.id) FILTER (m.task_type = 'summary') AS summary_model_id
FROM models m LEFT JOIN registry r ON m.model_name = r.model_name AND m.version = r.version
     AND m.revision IS NOT DISTINCT FROM r.revision AND m.task_type = r.task_type
GROUP BY m.event_id""",
)
def resolve_models(spark, root):
    named = F.struct(
        F.expr(f"coalesce(nullif(trim({_MODEL['name']}), ''), 'unknown')").alias("name"),
        F.expr(f"coalesce(nullif(trim({_MODEL['version']}), ''), 'unknown')").alias("version"),
        F.expr(f"nullif(trim({_MODEL['revision']}), '')").alias("revision"),
        F.lit("builtin").alias("provider"),
    )
    runs = table(spark, root, "events").select("event_id", *[named.alias(f"{t}_model") for t in ln.TASKS])
    out = ln.resolve_models(runs, _registry(spark, root))
    return out.select("event_id", *[f"{t}_model_id" for t in ln.TASKS])


def _runs(spark, root, scores=False):
    """Run versions: all arrivals of a document in one week are tries of the same run."""
    rows = work(spark, root, scores)
    run = run_uuid(F.col("doc_id"), F.col("week"), F.lit("lexicon"))
    return rows.withColumn("run_id", run).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_RUN_ID = o.uuid5("'run|' || doc_id || '|' || week || '|lexicon'")
_RUNS = f"""{o.WORK},
runs AS (
  SELECT *, {_RUN_ID} AS run_id FROM work
  QUALIFY row_number() OVER (PARTITION BY doc_id, week ORDER BY event_id DESC) = 1)"""


def _model_ids(runs):
    """Ids and versions of the built-in models, which follow from their keys."""
    rows = stamp_versions(runs)
    for m in DEFAULT_MODELS:
        rows = tb.with_model_id(rows, m.task)
    return rows


_MODEL_IDS = ", ".join(
    o.uuid5(f"'model|{m.name}|{m.version}|-|{m.task}|{m.provider}'") + f" AS {m.task}_model_id" for m in DEFAULT_MODELS
)
_STAMPS = f"""{_MODEL_IDS}, 'batch_pipeline' AS trigger_type, '{PROMPT_VERSION}' AS prompt_version,
       sha256({o.text(SYSTEM_PROMPT + USER_PROMPT)}) AS prompt_hash, 'unknown' AS service_git_sha"""


@query(
    "upsert_runs",
    f"""WITH {_RUNS}
SELECT run_id AS id, {o.uuid5('doc_id::VARCHAR')} AS document_id, status AS run_status, {_STAMPS},
       ts AS started_at, ts + to_milliseconds(processing_ms) AS completed_at, ts AS created_at, error AS error_message FROM runs""",
)
def upsert_runs(spark, root):
    """Every column of the run table."""
    last = upserts.latest(
        _runs(spark, root), ["run_id"], "event_id", columns=["doc_id", "status", "ts", "processing_ms", "error"]
    )
    return _model_ids(last).select(
        F.col("run_id").alias("id"),
        document_uuid(F.col("doc_id")).alias("document_id"),
        *[f"{m.task}_model_id" for m in DEFAULT_MODELS],
        F.col("status").alias("run_status"),
        F.lit("batch_pipeline").alias("trigger_type"),
        "prompt_version", "prompt_hash", "service_git_sha",
        F.col("ts").alias("started_at"),
        tb.run_end(F.col("ts"), F.col("processing_ms")).alias("completed_at"),
        F.col("ts").alias("created_at"),
        F.col("error").alias("error_message"),
    )


def _answers(spark, root):
    """What the stages say of each document, without its text; written, as it is joined by id."""
    docs = spread(table(spark, root, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    told = enrich(docs).select(
        "doc_id", "sentiment_label", "sentiment_score", "entities", "summary", F.col("error").alias("stage_error"),
        upserts.content_hash(F.col("text")).alias("hash"))
    return stored(spark, told, "answers")


def _entity_string(entities):
    return F.array_join(F.transform(entities, lambda e: F.concat(
        e["text"], F.lit("/"), e["label"], F.lit("@"), e["start"].cast("string"), F.lit("-"), e["end"].cast("string"))), " ")


# work, with what the stages say of each document: entities in one string, summary, its error
_ANSWERED = f"""{SUMMARIES}{o.WORK.removeprefix(o.SCORED)},
listed AS (
  SELECT doc_id, string_agg(entity || '/' || label || '@' || start_at || '-' || end_at, ' ' ORDER BY pos) AS entities
  FROM found GROUP BY doc_id),
answered AS (
  SELECT w.*, coalesce(l.entities, '') AS entities, s.summary, 'summary_failed: ' || s.summary_error AS stage_error,
         d.lang AS doc_lang, sha256(d.norm) AS hash
  FROM work w JOIN docs d ON d.doc_id = w.doc_id AND d.norm <> '' JOIN summaries s ON s.doc_id = w.doc_id
  LEFT JOIN listed l ON l.doc_id = w.doc_id)"""


@query(
    "upsert_results",
    f"""WITH {_ANSWERED},
last AS (
  SELECT *, {_RUN_ID} AS run FROM answered WHERE status = 'done'
  QUALIFY row_number() OVER (PARTITION BY doc_id, week ORDER BY event_id DESC) = 1)
SELECT {o.uuid5("'result|' || run")} AS id, run AS analysis_run_id, sentiment_label, round(sentiment_score, 6) AS sentiment_score,
       entities, summary, processing_ms::INTEGER AS processing_ms, ts AS created_at FROM last""",
)
def upsert_results(spark, root):
    """Every column of the result table. The winning version is found from narrow rows; entities and
    summary are joined to the winners, so they are neither sorted nor grouped."""
    done = _runs(spark, root).filter(F.col("status") == "done")
    last = upserts.latest(done, ["run_id"], "event_id", columns=["doc_id", "processing_ms", "ts"])
    out = last.join(_answers(spark, root), "doc_id").select(
        uuid5(F.concat_ws("|", F.lit("result"), "run_id")).alias("id"),
        F.col("run_id").alias("analysis_run_id"),
        "sentiment_label", "sentiment_score",
        _entity_string(F.col("entities")).alias("entities"),
        "summary",
        tb.clamp_ms(F.col("processing_ms")).alias("processing_ms"),
        F.col("ts").alias("created_at"),
    )
    return rounded(out, "sentiment_score")


@query("run_ids", f"WITH {o.WORK} SELECT event_id, doc_id, {_RUN_ID} AS run_id FROM work")
def run_ids(spark, root):
    rows = upserts.with_run_id(work(spark, root, scores=False), F.col("week"), F.lit("lexicon"))
    return rows.select("event_id", "doc_id", "run_id")


@query(
    "replay_set",
    f"""WITH {_RUNS}
SELECT doc_id, run_id, status, event_id FROM runs
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY event_id DESC) = 1 AND status <> 'done'""",
)
def replay_set(spark, root):
    return upserts.replay_set(_runs(spark, root), "event_id")


@query(
    "dedup_by_hash",
    f"WITH {o.DOCS} SELECT sha256(norm) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM docs WHERE text IS NOT NULL GROUP BY ALL",
)
def dedup_by_hash(spark, root):
    return upserts.dedup_by_hash(spread(table(spark, root, "documents").select("doc_id", "text"), "doc_id"))


# --- batches -------------------------------------------------------------------------------


def _batched(spark, root, scores=False):
    return batches.assign_batches(stored(spark, work(spark, root, scores), "work"))


@query("assign_batches", f"WITH {o.WORK} SELECT event_id, source, batch_no::BIGINT AS batch_no, batch_id FROM work")
def assign_batches(spark, root):
    return _batched(spark, root).select("event_id", "source", "batch_no", "batch_id")


@query(
    "batch_status",
    f"""WITH {o.WORK}
SELECT source, batch_id, count(*) AS total, count(*) FILTER (status = 'done') AS done,
       count(*) FILTER (status = 'failed') AS failed,
       coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (status = 'failed'), '') AS failed_ids,
       bool_and(status IN ('done', 'failed')) AS all_terminal
FROM work GROUP BY ALL""",
)
def batch_status(spark, root):
    out = batches.batch_status(_batched(spark, root))
    return out.withColumn("failed_ids", F.array_join(F.col("failed_ids").cast("array<string>"), ","))


@query(
    "label_tally",
    f"""WITH {o.WORK}
SELECT source, batch_id, count(*) FILTER (sentiment_label = 'Positive') AS positives,
       count(*) FILTER (sentiment_label = 'Negative') AS negatives, count(*) FILTER (sentiment_label = 'Neutral') AS neutral
FROM work GROUP BY ALL""",
)
def label_tally(spark, root):
    return batches.label_tally(_batched(spark, root, scores=True))


@query(
    "reconcile",
    f"""WITH {o.WORK},
counts AS (
  SELECT source, batch_id, count(*) AS expected_total, count(*) FILTER (status = 'done') AS expected_done,
         count(*) FILTER (status = 'failed') AS expected_failed,
         count(*) FILTER (value >= 0.5) AS runs_total, count(*) FILTER (value >= 0.5 AND status = 'done') AS runs_done,
         count(*) FILTER (value >= 0.5 AND status = 'failed') AS runs_failed,
         count(*) FILTER (value >= 0.25 AND status = 'done') AS results_total
  FROM work GROUP BY ALL)
SELECT *, runs_total = expected_total AND runs_done = expected_done AND runs_failed = expected_failed
       AND results_total = expected_done AS ok FROM counts""",
)
def reconcile(spark, root):
    """Some landed runs and results are missing, by value."""
    rows = stored(spark, _batched(spark, root), "batched")
    landed = rows.filter(F.col("value") >= 0.5)
    results = rows.filter((F.col("value") >= 0.25) & (F.col("status") == "done"))
    return batches.reconcile(rows, landed, results, ("source", "batch_id"))


# --- lineage -------------------------------------------------------------------------------


def _analysed(spark, root):
    """The last version of each run as an analysed batch, with what the stages say of its document.
    Texts stay out: lineage shows their hash."""
    last = upserts.latest(
        work(spark, root, scores=False), ["doc_id", "week"], "event_id",
        columns=["event_id", "source", "lang", "status", "error", "processing_ms", "ts"])
    answers = _answers(spark, root)
    return last.join(answers, "doc_id").select(
        "doc_id", "source", "lang", "status", F.coalesce("error", "stage_error").alias("error"),
        "sentiment_label", "sentiment_score", "processing_ms", F.lit(None).cast("string").alias("text"), "hash",
        "entities", "summary", F.col("event_id").alias("seq"), F.col("ts").alias("received_at"),
        F.col("ts").alias("started_at"), F.col("week").alias("epoch_id"),
    )


_LINEAGE_RUN = o.uuid5("'run|' || doc_id || '|' || week || '|lexicon+patterns+extractive'")


@query(
    "lineage",
    f"""WITH {_ANSWERED},
runs AS (
  SELECT *, status = 'done' AS done FROM answered
  QUALIFY row_number() OVER (PARTITION BY doc_id, week ORDER BY event_id DESC) = 1)
SELECT {_LINEAGE_RUN} AS run_id, {o.uuid5('doc_id::VARCHAR')} AS document_id, doc_lang AS language, hash,
       {o.uuid5('source')} AS source_id, 'source-' || source AS source_name, {_STAMPS},
       'lexicon' AS sentiment_model, 'patterns' AS ner_model, 'extractive' AS summary_model, status AS run_status,
       CASE WHEN done THEN sentiment_label END AS sentiment_label,
       CASE WHEN done THEN round(sentiment_score, 4) END AS sentiment_score,
       CASE WHEN done THEN entities END AS entities, CASE WHEN done THEN summary END AS summary,
       CASE WHEN done THEN processing_ms END::DOUBLE AS processing_ms,
       coalesce(error, stage_error) AS error_message, ts AS started_at, ts + to_milliseconds(processing_ms) AS completed_at
FROM runs""",
)
def lineage(spark, root):
    out = ln.lineage(tb.to_tables(stored(spark, _analysed(spark, root), "analysed")))
    return out.select(
        "run_id", "document_id", "language", "hash", "source_id", "source_name", *[f"{t}_model_id" for t in ln.TASKS],
        "trigger_type", "prompt_version", "prompt_hash", "service_git_sha", *[f"{t}_model" for t in ln.TASKS], "run_status",
        "sentiment_label", F.round(F.col("sentiment_score").cast("double"), 4).alias("sentiment_score"),
        _entity_string(F.col("entities")).alias("entities"), "summary", F.col("processing_ms").cast("double").alias("processing_ms"),
        "error_message", F.col("started_at").cast("timestamp_ntz").alias("started_at"),
        F.col("completed_at").cast("timestamp_ntz").alias("completed_at"),
    )


def _stored(spark, root):
    """Tables with some parents missing: sources of toxic documents only, runs of results by value."""
    docs = table(spark, root, "documents").select("doc_id", "source")
    toxic = table(spark, root, "labels").filter(F.col("toxic") == 1)
    known = docs.join(toxic, "doc_id", "left_semi").select(F.col("source").alias("id")).distinct()
    events = table(spark, root, "events")
    return {
        "source_metadata": known,
        "document": docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id")),
        "analysis_run": events.filter(F.col("event_type") != "signup").select(
            F.col("event_id").alias("id"), F.floor(F.col("value") * 10).alias("document_id")
        ),
        "analysis_result": events.select(
            F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), F.col("event_id").alias("analysis_run_id")
        ),
    }


@query(
    "orphan_check",
    """SELECT 'document.source_id' AS rule, doc_id::VARCHAR AS id FROM documents WHERE source NOT IN (
  SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
UNION ALL
SELECT 'analysis_run.document_id', event_id::VARCHAR FROM events
WHERE event_type <> 'signup' AND floor(value * 10)::BIGINT NOT IN (SELECT doc_id FROM documents)
UNION ALL
SELECT 'analysis_result.analysis_run_id', 'r' || event_id FROM events WHERE event_type = 'signup'""",
)
def orphan_check(spark, root):
    return ln.orphans(_stored(spark, root))


@query(
    "cascade_delete",
    """SELECT 'analysis_run' AS stored, event_id::VARCHAR AS id FROM events WHERE event_type NOT IN ('signup', 'error')
UNION ALL SELECT 'analysis_result', 'r' || event_id FROM events WHERE event_type <> 'error'""",
)
def cascade_delete(spark, root):
    """Runs of error events are deleted and take their results with them."""
    gone = table(spark, root, "events").filter(F.col("event_type") == "error").select(F.col("event_id").alias("run_id"))
    left = ln.cascade_delete(_stored(spark, root), gone)
    parts = [
        left[name].select(F.lit(name).alias("stored"), F.col("id").cast("string").alias("id"))
        for name in ("analysis_run", "analysis_result")
    ]
    return parts[0].unionByName(parts[1])
