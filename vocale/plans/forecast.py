"""Spike forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocale.operators import forecast as fc
from vocale.operators import scoring
from vocale.operators.hourly import hourly_counts
from vocale.operators.rolling import WINDOWS, entity_delta, threshold, top_rising
from vocale.plans import oracle as o
from vocale.plans.features import DELTA, SHIFT, _FUTURE, _over, _sql_rate
from vocale.plans.inputs import as_double, dense_counts, hourly_feedback, mentions_by_hour, rounded, show_hour, stored
from vocale.plans.registry import query
from vocale.session import shared_dir

# The sources and languages the model has features for; others share one column.
SOURCES = tuple(f"src{i}" for i in range(20))
LANGUAGES = ("de", "en", "es", "fr")


def _table(spark, root):
    base = stored(spark, hourly_counts(hourly_feedback(spark, root), "source", "lang"), "hours")
    mentions = stored(spark, mentions_by_hour(spark, root), "mentions")
    return fc.training_table(base, mentions, SOURCES, LANGUAGES)


def _rolled_sql() -> str:
    parts = []
    for x in WINDOWS:
        parts += [
            f"(sum(negatives) {_over(x)})::BIGINT AS negative_volume_{x}h",
            f"{_sql_rate(x)} AS negative_rate_{x}h",
            f"sum(neg_score_sum) {_over(x)} / nullif(sum(negatives) {_over(x)}, 0)::DOUBLE AS avg_sentiment_score_{x}h",
            f"{_sql_rate(x)} - {_sql_rate(x, x)} AS negative_rate_change_{x}h",
        ]
    return ",\n         ".join(parts)


def _share_sql(column: str, names, prefix: str, value: str) -> str:
    cases = [f"max({value}) FILTER ({column} = '{n}') AS {prefix}_{n}" for n in (*names, fc.OTHER)]
    return ", ".join(cases)


_DAY = "OVER (PARTITION BY {key} ORDER BY hour RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)"


def _grid_sql(name: str, key: str, known) -> str:
    listed = ", ".join(f"'{k}'" for k in known)
    return f"""{name}_feed AS (
  SELECT hour, event_id, sentiment_label, CASE WHEN {key} IN ({listed}) THEN {key} ELSE 'other' END AS k FROM feed),
{name}_spine AS (
  SELECT k, unnest(generate_series(min(hour), (SELECT max(hour) FROM feed), INTERVAL 1 HOUR)) AS hour
  FROM {name}_feed GROUP BY k),
{name}_hours AS (
  SELECT s.k, s.hour, count(f.event_id) AS n, count(*) FILTER (f.sentiment_label = 'Negative') AS neg
  FROM {name}_spine s LEFT JOIN {name}_feed f ON s.k = f.k AND s.hour = f.hour GROUP BY s.k, s.hour),
{name}_day AS (
  SELECT k, hour, sum(n) {_DAY.format(key='k')} AS n, sum(neg) {_DAY.format(key='k')} AS neg FROM {name}_hours)"""


_TRAINING = f"""{_FUTURE},
rolled AS (SELECT hour, total, negatives, neg_score_sum,
         {_rolled_sql()}
  FROM hourly),
{_grid_sql('source', 'source', SOURCES)},
{_grid_sql('lang', 'lang', LANGUAGES)},
source_rates AS (
  SELECT hour, {_share_sql('k', SOURCES, 'negative_rate', 'neg / nullif(n, 0)::DOUBLE')} FROM source_day GROUP BY hour),
lang_total AS (SELECT hour, sum(n) AS whole FROM lang_day GROUP BY hour),
lang_shares AS (
  SELECT hour, {", ".join(f"coalesce(max(n) FILTER (k = '{x}'), 0) / nullif(max(whole), 0)::DOUBLE AS share_{x}" for x in (*LANGUAGES, 'other'))}
  FROM lang_day JOIN lang_total USING (hour) GROUP BY hour),
training AS (
  SELECT r.*, f.future_negatives, s.* EXCLUDE (hour), l.* EXCLUDE (hour)
  FROM rolled r JOIN future f USING (hour) LEFT JOIN source_rates s USING (hour) LEFT JOIN lang_shares l USING (hour))"""

_DOUBLES = (
    ["neg_score_sum", "future_negatives", "threshold", "y", "language_shift", "entity_frequency_delta"]
    + [f"{p}_{x}h" for x in WINDOWS for p in ("negative_rate", "avg_sentiment_score", "negative_rate_change")]
    + [f"negative_rate_{s}" for s in (*SOURCES, fc.OTHER)]
    + [f"share_{x}" for x in (*LANGUAGES, fc.OTHER)]
)
_WHOLE = ["total", "negatives", "new_entities_in_negatives"] + [f"negative_volume_{x}h" for x in WINDOWS]


_FEATURES = f"""{_TRAINING},
grid AS (
  SELECT DISTINCT entity, label, unnest(generate_series(hour, hour + INTERVAL 191 HOUR, INTERVAL 1 HOUR)) AS hour FROM mentions),
moved AS (
  SELECT hour, sum(coalesce(mentions, 0)) OVER (PARTITION BY entity, label ORDER BY hour
           RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)
         - coalesce(sum(coalesce(mentions, 0)) OVER (PARTITION BY entity, label ORDER BY hour
           RANGE BETWEEN INTERVAL 191 HOUR PRECEDING AND INTERVAL 24 HOUR PRECEDING), 0)::DOUBLE / 7 AS delta
  FROM grid LEFT JOIN mentions USING (entity, label, hour)),
peaks AS (SELECT hour, max(delta) AS entity_frequency_delta FROM moved GROUP BY hour),
firsts AS (SELECT hour, count(*) AS new_entities_in_negatives FROM (
  SELECT entity, label, min(hour) AS hour FROM mentions GROUP BY entity, label) GROUP BY hour),
{SHIFT},
features AS (
  SELECT t.*, x.shift AS language_shift, coalesce(p.entity_frequency_delta, 0) AS entity_frequency_delta,
         coalesce(n.new_entities_in_negatives, 0) AS new_entities_in_negatives, threshold,
         (future_negatives > threshold)::INTEGER AS y
  FROM training t LEFT JOIN shifts x USING (hour) LEFT JOIN peaks p USING (hour) LEFT JOIN firsts n USING (hour), level)"""


@query(
    "training_table",
    f"""WITH {o.MENTIONS}{_FEATURES.removeprefix(o.SCORED).replace(o.ARRIVALS + ",", "", 1)}
SELECT hour, {", ".join(_WHOLE)}, {", ".join(f"round({d}::DOUBLE, 6) + 0.0 AS {d}" for d in _DOUBLES)} FROM features""",
)
def training_table(spark, root):
    """All features of every hour and the target: y by the level over the whole history."""
    table = stored(spark, _table(spark, root), "training")
    out = show_hour(fc.with_history_target(table)).select("hour", *_WHOLE, *_DOUBLES)
    return rounded(as_double(out, "future_negatives", "y"), *_DOUBLES)


_CUT = "(SELECT min(hour) + INTERVAL 480 HOUR FROM hourly)"


@query(
    "spike_threshold",
    f"""WITH {_FUTURE}
SELECT round(avg(future_negatives), 6) AS mean, round(stddev_samp(future_negatives), 6) AS deviation,
       round(avg(future_negatives) + 2 * stddev_samp(future_negatives), 6) AS threshold
FROM future WHERE hour < {_CUT} - INTERVAL 24 HOUR""",
)
def spike_threshold(spark, root):
    """Level of the first twenty days, without the day whose target looks past them."""
    table = _future(spark, root)
    cutoff = table.agg(F.min("h")).scalar() + F.lit(480 - 24)
    return rounded(threshold(table, cutoff=cutoff), "mean", "deviation", "threshold")


def _future(spark, root):
    hours = fc.future_negatives(fc.rolling(dense_counts(spark, root), (24,)))
    return stored(spark, hours, "hours")


def _fold_rows(spark, root):
    return fc.with_target(stored(spark, fc.folds(_future(spark, root)), "folds"))


_FOLDS = f"""{_FUTURE},
day AS (SELECT hour, (sum(negatives) {_over(24)})::BIGINT AS negative_volume_24h FROM hourly),
numbered AS (
  SELECT hour, future_negatives, negative_volume_24h,
         (epoch(hour)::BIGINT - (SELECT min(epoch(hour)::BIGINT) FROM hourly)) // 3600 AS nth
  FROM future JOIN day USING (hour)),
fold_ids AS (SELECT unnest(generate_series(2, (SELECT max(nth) // 120 FROM numbered))) AS fold),
fold_rows AS (
  SELECT fold, hour, future_negatives, negative_volume_24h, CASE WHEN nth >= fold * 120 THEN 'test' ELSE 'train' END AS role
  FROM fold_ids, numbered
  WHERE (nth >= fold * 120 AND nth < (fold + 1) * 120) OR nth < fold * 120 - 24),
limits AS (
  SELECT fold, avg(future_negatives) + 2 * stddev_samp(future_negatives) AS threshold
  FROM fold_rows WHERE role = 'train' GROUP BY fold),
targets AS (
  SELECT *, (future_negatives > threshold)::INTEGER AS y FROM fold_rows JOIN limits USING (fold))"""


@query("walk_forward_folds", f"WITH {_FOLDS} SELECT fold::BIGINT AS fold, hour, role, future_negatives::DOUBLE AS future_negatives, y::DOUBLE AS y FROM targets")
def walk_forward_folds(spark, root):
    out = show_hour(_fold_rows(spark, root)).select("fold", "hour", "role", "future_negatives", "y")
    return as_double(out, "future_negatives", "y")


@query(
    "class_weights",
    f"""WITH {_FOLDS}
SELECT fold::BIGINT AS fold, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives_rows,
       round(count(*) FILTER (y = 0)::DOUBLE / nullif(count(*) FILTER (y = 1), 0), 6) AS weight
FROM targets WHERE role = 'train' AND y IS NOT NULL GROUP BY fold""",
)
def class_weights(spark, root):
    return rounded(fc.class_weights(_fold_rows(spark, root)), "weight")


@query(
    "forecast_metrics",
    f"""WITH {_FOLDS},
counts AS (
  SELECT fold::BIGINT AS fold, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
         count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn
  FROM (SELECT *, (negative_volume_24h > threshold)::INTEGER AS p FROM targets WHERE role = 'test')
  WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY fold)
SELECT *, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision FROM counts""",
)
def forecast_metrics(spark, root):
    return rounded(fc.metrics(fc.rule_prediction(_fold_rows(spark, root))), "recall", "precision")


@query("train_forecast")
def train_forecast(spark, root):
    """Test hours of every fold with the probability of a spike and the prediction; NULL where the
    training part has one class only."""
    rows = fc.with_target(fc.folds(stored(spark, _table(spark, root), "training")))
    out = show_hour(fc.train_forecast(stored(spark, rows, "folds")))
    return as_double(out.select("fold", "hour", "y", "probability", "prediction"), "y", "prediction")


def _final_model(spark, root):
    table = stored(spark, _table(spark, root), "training")
    return table, fc.feature_names(table), fc.fit_history(table)


@query("feature_importance")
def feature_importance(spark, root):
    _, names, model = _final_model(spark, root)
    if model is None:
        return spark.createDataFrame([], "feature string, importance double")
    return fc.importance(spark, model, names)


# Hours that the model learns from; it scores those after them.
_LEARNED = 480


@query("alerts")
def alerts(spark, root):
    """Alerts of the hours after the first twenty days, by a model that was fitted on those days, stored
    and loaded again. The newest hour waits."""
    folder = shared_dir(spark, "forecast")
    table = stored(spark, _table(spark, root), "training")
    first, newest = table.agg(F.min("h"), F.max("h")).first()
    if first is not None:
        fit = scoring.fit_and_store(spark, folder, table, first + _LEARNED, SOURCES, LANGUAGES)
        if fit is not None:
            rising = top_rising(entity_delta(mentions_by_hour(spark, root)), k=3)
            scoring.score_new(spark, folder, fit, table, rising, newest - 1)
    return show_hour(scoring.stored_alerts(spark, folder))


@query(
    "alerts_by_rule",
    f"""WITH {o.MENTIONS}{_FUTURE.removeprefix(o.SCORED).replace(o.ARRIVALS + ",", "", 1)},
{DELTA.removeprefix(o.MENTIONS + ",")},
limits AS (
  SELECT avg(future_negatives) + 2 * stddev_samp(future_negatives) AS limit_value FROM future WHERE hour < {_CUT} - INTERVAL 24 HOUR),
days AS (SELECT hour, sum(negatives) {_over(24)} AS n FROM hourly),
ranked AS (SELECT hour, entity, row_number() OVER (PARTITION BY hour ORDER BY delta DESC, entity, label) AS rank FROM delta),
reasons AS (SELECT hour, string_agg(entity, ', ' ORDER BY rank) AS reason FROM ranked WHERE rank <= 3 GROUP BY hour)
SELECT hour, 1.0::DOUBLE AS probability, reason FROM days LEFT JOIN reasons USING (hour), limits
WHERE hour >= {_CUT} AND n > limit_value""",
)
def alerts_by_rule(spark, root):
    """Alerts of the same hours by a rule in place of the model: the last day was a spike by the
    level of the first twenty days."""
    hours = _future(spark, root)
    cut = hours.agg(F.min("h")).scalar() + F.lit(_LEARNED)
    level = threshold(hours, cutoff=cut - 24).select("threshold").scalar()
    scored = hours.filter(F.col("h") >= cut).withColumn(
        "probability", (F.col("negative_volume_24h") > level).cast("double"))
    rising = top_rising(rounded(entity_delta(mentions_by_hour(spark, root)), "delta"), k=3)
    return show_hour(fc.alerts(scored, rising))
