"""DuckDB SQL parts shared by the oracle statements."""

from __future__ import annotations

from vocale.functions.ids import NAMESPACE_URL
from vocale.functions.lexicon import NEGATIVE_TERMS, ORGANISATIONS, PLACES, POSITIVE_TERMS, flat
from vocale.operators.entities import ANY as _ANY
from vocale.operators.entities import RUN_START

# RE2 never backtracks, so it needs neither the possessive mark nor the start of the run.
ANY = _ANY.replace(RUN_START, "").replace("++@", "+@")

_WIDE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = r"[\t-\r\x1c-\x20" + _WIDE + "]"
TRIM_SPACE = r"[\t-\r\x20" + _WIDE + "]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def trim_space(x: str) -> str:
    return f"regexp_replace({x}, '^{TRIM_SPACE}+|{TRIM_SPACE}+$', '', 'g')"


def uuid5(name: str) -> str:
    d = f"sha1(unhex('{NAMESPACE_URL}') || encode({name}))"
    variant = f"translate(substr({d}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return (
        f"(substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || "
        f"{variant} || substr({d}, 18, 3) || '-' || substr({d}, 21, 12))"
    )


def words(x: str) -> str:
    return rf"regexp_split_to_array(lower({x}), '[^\p{{L}}]+')"


# docs: doc_id, source, lang, text, norm
DOCS = f"docs AS (SELECT doc_id, source, lang, text, {collapse('text')} AS norm FROM documents)"

# scored: docs plus n_pos, n_neg, sentiment_label, sentiment_score
SCORED = f"""{DOCS},
counted AS (
  SELECT *, len(list_intersect(list_distinct({words('norm')}), {items(flat(POSITIVE_TERMS))})) AS n_pos,
         len(list_intersect(list_distinct({words('norm')}), {items(flat(NEGATIVE_TERMS))})) AS n_neg
  FROM docs),
scored AS (
  SELECT *, CASE WHEN n_pos < n_neg THEN 'Negative' WHEN n_pos > n_neg THEN 'Positive' ELSE 'Neutral' END
           AS sentiment_label,
         CASE WHEN n_pos = n_neg THEN 0.0::DOUBLE
              ELSE (n_pos - n_neg)::DOUBLE / (abs(n_pos - n_neg) + 1) END AS sentiment_score
  FROM counted)"""

# arrivals: events plus doc_id and the hour they came in
ARRIVALS = """arrivals AS (
  SELECT *, event_id % (SELECT count(*) FROM documents) AS doc_id, date_trunc('hour', ts) AS hour
  FROM events)"""

FEED = f"""{SCORED},
{ARRIVALS},
feed AS (
  SELECT a.*, s.source, s.lang, s.n_neg, s.sentiment_label, s.sentiment_score
  FROM arrivals a JOIN scored s USING (doc_id))"""

# hourly: one row per hour of the range
HOURLY = f"""{FEED},
spine AS (
  SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM feed),
hourly AS (
  SELECT s.hour, count(f.event_id) AS total,
         count(*) FILTER (f.sentiment_label = 'Negative') AS negatives,
         coalesce(sum(f.sentiment_score) FILTER (f.sentiment_label = 'Negative'), 0.0) AS neg_score_sum
  FROM spine s LEFT JOIN feed f USING (hour) GROUP BY s.hour)"""

# found: one row per entity at or above the threshold; pos counts all matches
FOUND = rf"""{SCORED},
matched AS (
  SELECT doc_id, sentiment_label, regexp_extract_all(norm, '{ANY}') AS m,
         regexp_split_to_array(norm, '{ANY}') AS gaps
  FROM scored),
each AS (
  SELECT doc_id, sentiment_label, m, gaps, unnest(range(1, len(m) + 1)) AS pos FROM matched),
placed AS (
  SELECT doc_id, sentiment_label, pos, m[pos] AS entity,
         (list_sum(list_transform(gaps[1:pos], lambda g: length(g)))
          + coalesce(list_sum(list_transform(m[1:pos - 1], lambda g: length(g))), 0))::INTEGER AS start_at
  FROM each),
labelled AS (
  SELECT *, start_at + length(entity)::INTEGER AS end_at,
         CASE WHEN contains(entity, '@') THEN 'EMAIL'
              WHEN starts_with(entity, '+') THEN 'PHONE'
              WHEN regexp_matches(entity, '^[0-9]') THEN 'IP'
              WHEN list_has_any(string_split(entity, ' '), {items(ORGANISATIONS)}) THEN 'ORG'
              WHEN list_has_any(string_split(entity, ' '), {items(PLACES)}) THEN 'LOC'
              ELSE 'MISC' END AS label
  FROM placed),
found AS (
  SELECT *, CASE label WHEN 'EMAIL' THEN 0.99 WHEN 'PHONE' THEN 0.95 WHEN 'IP' THEN 0.9
                 WHEN 'ORG' THEN 0.95 WHEN 'LOC' THEN 0.92 ELSE 0.85 END::DOUBLE AS score
  FROM labelled WHERE label <> 'MISC' OR contains(entity, ' '))"""

# mentions: negative mentions per entity and hour
MENTIONS = f"""{FOUND},
{ARRIVALS},
mentions AS (
  SELECT f.entity, f.label, a.hour, count(*) AS mentions
  FROM arrivals a JOIN found f USING (doc_id)
  WHERE f.sentiment_label = 'Negative' GROUP BY ALL)"""

# work: the feed as processed messages: status, error, processing_ms, week, batch_no, batch_id
WORK = f"""{FEED},
work AS (
  SELECT *, printf('batch-%05d', batch_no) AS batch_id FROM (
    SELECT *, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status,
           CASE WHEN event_type = 'error' THEN 'inference error: timeout' END AS error,
           floor(value * 1000)::BIGINT AS processing_ms, (epoch(hour)::BIGINT // 3600) // 168 AS week,
           (row_number() OVER (PARTITION BY source ORDER BY ts, event_id) - 1) // 32 + 1 AS batch_no
    FROM feed))"""
