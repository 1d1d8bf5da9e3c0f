"""Columns on inference output: labels, statuses, errors, entities, prompts, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocale.functions.once import compute_once
from vocale.functions.text import MAX_TEXT_CHARS, normalize_text
from vocale.schemas import ENTITIES_DDL

# Public labels, statuses by code, urgency levels, limits.
NEGATIVE, POSITIVE, NEUTRAL = "Negative", "Positive", "Neutral"
STATUSES = ("pending", "processing", "done", "failed")
URGENCIES = ("critica", "alta", "media")
ENTITY_THRESHOLD = 0.80
PROMPT_ENTITIES = 25
SUMMARY_LIMIT = 200
MAX_INT = 2147483647

# Prompt version and texts; their fingerprint is stored with every run.
PROMPT_VERSION = "v1"
SYSTEM_PROMPT = (
    "Sei un assistente specializzato nell'analisi di feedback negativi dei clienti. "
    "Analizza internamente il testo e restituisci SOLO il JSON finale richiesto, "
    "senza spiegazioni aggiuntive."
)
USER_PROMPT = """Hai ricevuto il seguente feedback negativo di un cliente:

<testo>
{text}
</testo>

Entità rilevate nel testo: {entities}

Obiettivo:
- sintetizza il problema principale;
- stima l'urgenza: critica, alta oppure media;
- suggerisci un'azione immediata per il team di supporto.

Restituisci ESCLUSIVAMENTE un oggetto JSON con questa struttura:
{{
  "summary": "<riassunto del problema in max 20 parole>",
  "urgency": "<critica|alta|media>",
  "suggested_action": "<azione specifica in max 20 parole>"
}}
"""


def public_label(raw_label: Column) -> Column:
    """Model label to public label; 'neg' wins over 'pos', anything else is neutral."""
    label = F.lower(F.coalesce(raw_label, F.lit("")))
    return (
        F.when(label.contains("neg"), NEGATIVE).when(label.contains("pos"), POSITIVE).otherwise(NEUTRAL)
    )


def signed_score(raw_label: Column, probability: Column) -> Column:
    label = public_label(raw_label)
    p = probability.cast("double")
    return F.when(label == NEGATIVE, -p).when(label == POSITIVE, p).otherwise(F.lit(0.0))


def status_name(code: Column) -> Column:
    names = F.lit(None).cast("string")
    for value, name in enumerate(STATUSES):
        names = F.when(code == value, name).otherwise(names)
    return F.coalesce(names, F.lit("unknown"))


def merge_errors(*errors: Column) -> Column:
    """Join the errors that are there with '; '; NULL when none is."""
    joined = F.concat_ws("; ", *[F.nullif(e, F.lit("")) for e in errors])
    return F.nullif(joined, F.lit(""))


def stage_error(stage: str, error: Column) -> Column:
    return F.when(F.nullif(error, F.lit("")).isNotNull(), F.concat(F.lit(f"{stage}_failed: "), error))


def clamp_ms(ms: Column) -> Column:
    return F.least(F.greatest(ms, F.lit(0)), F.lit(MAX_INT)).cast("int")


def run_end(started: Column, ms: Column) -> Column:
    """End of a run; NULL when it never started."""
    return started + F.make_dt_interval(secs=(ms / F.lit(1000)).cast("decimal(18,6)"))


def keep_entities(entities: Column, threshold: float = ENTITY_THRESHOLD) -> Column:
    """Entities at or above the threshold, stored types, '' and 0 for what is missing."""
    def stored(e: Column) -> Column:
        return F.struct(
            F.coalesce(e["text"], F.lit("")).alias("text"),
            F.coalesce(e["label"], F.lit("")).alias("label"),
            F.coalesce(e["start"], F.lit(0)).cast("int").alias("start"),
            F.coalesce(e["end"], F.lit(0)).cast("int").alias("end"),
            e["score"].cast("float").alias("score"),
        )

    kept = F.filter(entities, lambda e: F.coalesce(e["score"], F.lit(0.0)) >= threshold)
    return F.transform(F.coalesce(kept, F.array().cast(ENTITIES_DDL)), stored)


def entities_to_json(entities: Column) -> Column:
    return F.to_json(F.coalesce(entities, F.array().cast(ENTITIES_DDL)))


def entities_from_json(raw: Column) -> Column:
    """Entity array of a JSON column; NULL and JSON ``null`` read as no entities."""
    return F.coalesce(F.from_json(raw, ENTITIES_DDL), F.array().cast(ENTITIES_DDL))


def entity_list(entities: Column, limit: int = PROMPT_ENTITIES) -> Column:
    named = F.transform(
        F.slice(entities, 1, limit), lambda e: F.concat(e["text"], F.lit(" ("), e["label"], F.lit(")"))
    )
    return F.coalesce(F.nullif(F.array_join(named, ", "), F.lit("")), F.lit("nessuna"))


def render_prompt(text: Column, entities: Column, max_chars: int | None = MAX_TEXT_CHARS) -> Column:
    """The user prompt for one document; the text cap is the prompt's own limit."""
    head, rest = USER_PROMPT.replace("{{", "{").replace("}}", "}").split("{text}")
    middle, tail = rest.split("{entities}")
    return F.concat(
        F.lit(head), normalize_text(text, max_chars), F.lit(middle), entity_list(entities), F.lit(tail)
    )


def prompt_hash() -> Column:
    return F.sha2(F.lit(SYSTEM_PROMPT + USER_PROMPT), 256)


def _json_string(text: Column) -> Column:
    """A JSON string literal, cut out of a one-field object."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def summary_json(summary: Column, urgency: Column, action: Column) -> Column:
    """The stored form of a summary, with a blank after each colon and comma."""
    return F.concat(
        F.lit('{"summary": '), _json_string(summary),
        F.lit(', "urgency": '), _json_string(urgency),
        F.lit(', "suggested_action": '), _json_string(action), F.lit("}"),
    )


def validate_summary(df: DataFrame, raw: str = "raw_summary") -> DataFrame:
    """Add summary_text, urgency, suggested_action, summary (the stored JSON) and summary_error.

    Strict: an object with exactly the three keys, all strings, lengths 1..200, a known urgency.
    Every step is a column of its own, so the JSON is parsed once per row.
    """
    names = ("summary", "urgency", "suggested_action")
    parsed = df.withColumn("_raw", F.trim(F.coalesce(F.col(raw), F.lit("")))).withColumns(
        {"_doc": F.try_parse_json("_raw"), "_keys": F.array_sort(F.json_object_keys("_raw"))}
    )

    def text_field(name: str) -> Column:
        value = F.try_variant_get("_doc", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get("_doc", f"$.{name}", "string"))

    fields = compute_once(parsed, {f"_{name}": text_field(name) for name in names})
    good = (
        (F.col("_keys") == F.array(*[F.lit(n) for n in sorted(names)]))
        & F.length("_summary").between(1, SUMMARY_LIMIT)
        & F.col("_urgency").isin(*URGENCIES)
        & F.length("_suggested_action").between(1, SUMMARY_LIMIT)
    )
    checked = fields.withColumn(
        "summary_error",
        F.when(F.col("_raw") == "", "empty_summary_response")
        .when(F.col("_doc").isNull(), "invalid_summary_json")
        .when(~F.coalesce(good, F.lit(False)), "invalid_summary_schema"),
    )
    ok = F.col("summary_error").isNull()
    payload = summary_json(*[F.col(f"_{name}") for name in names])
    return checked.select(
        *df.columns,
        F.when(ok, F.col("_summary")).alias("summary_text"),
        F.when(ok, F.col("_urgency")).alias("urgency"),
        F.when(ok, F.col("_suggested_action")).alias("suggested_action"),
        F.when(ok, payload).alias("summary"),
        "summary_error",
    )
