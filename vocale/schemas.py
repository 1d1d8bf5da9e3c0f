"""Declared schemas: messages, inference response, the five lineage tables, and the store's own tables:
rejected and failed messages, deleted runs, hourly parts."""

from __future__ import annotations

MESSAGE_FIELDS = ("ID", "SourceID", "Lang", "Text")
MESSAGE = ", ".join(f"{name} string" for name in MESSAGE_FIELDS)

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)

ENTITY_DDL = "struct<text:string,label:string,start:int,end:int,score:float>"
ENTITIES_DDL = f"array<{ENTITY_DDL}>"

_MODEL_DDL = "struct<name:string,version:string,revision:string,tokenizer:string,provider:string>"

RESPONSE_DDL = (
    "struct<results:array<struct<doc_id:string,sentiment_score:float,sentiment_label:string,"
    f"entities:{ENTITIES_DDL},summary:string,error:string>>,"
    f"model_versions:struct<sentiment:{_MODEL_DDL},ner:{_MODEL_DDL},summary:{_MODEL_DDL},"
    "prompt_version:string,prompt_hash:string,service_git_sha:string>>"
)

# One DDL string per stored table.
TABLES = {
    "source_metadata": (
        "id string, name string, platform_type string, url string, default_language string, "
        "created_at timestamp"
    ),
    "document": (
        "id string, source_id string, original_text string, hash string, language string, "
        "status string, received_at timestamp, created_at timestamp"
    ),
    "model_version": (
        "id string, model_name string, version string, revision string, tokenizer_name string, "
        "task_type string, provider string, artifact_uri string, metadata map<string,string>, "
        "registered_at timestamp"
    ),
    "analysis_run": (
        "id string, document_id string, sentiment_model_id string, ner_model_id string, "
        "summary_model_id string, run_status string, trigger_type string, prompt_version string, "
        "prompt_hash string, service_git_sha string, started_at timestamp, completed_at timestamp, "
        "created_at timestamp, error_message string"
    ),
    "analysis_result": (
        "id string, analysis_run_id string, sentiment_score float, sentiment_label string, "
        f"entities {ENTITIES_DDL}, summary string, processing_ms int, created_at timestamp"
    ),
    "rejected_message": (
        "doc_id string, source string, lang string, text string, reason string, received_at timestamp"
    ),
    "failed_message": (
        "doc_id string, source string, lang string, text string, reason string, tries int, received_at timestamp"
    ),
    "deleted_run": "run_id string",
    "hourly_part": (
        "source string, lang string, h bigint, total bigint, negatives bigint, neg_score_sum double"
    ),
    "mention_part": "entity string, label string, h bigint, mentions bigint",
}
