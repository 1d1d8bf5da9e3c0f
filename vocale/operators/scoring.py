"""A stored forecast model, and the alerts of hours that it was not fitted on.

Below a folder: ``models`` (one Spark ML pipeline per fit), ``fits`` (one row per fit, written after its
model), ``alerts`` (one folder per scoring run) and ``scored`` (one row per scoring run, written after
its alerts, with the last hour scored). A run that fails before its row is there is not read, and the
next one scores its hours again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vocale.operators import forecast as fc

FIT_DDL = (
    "fitted_before bigint, model string, features array<string>, sources array<string>, languages array<string>, "
    "cut double, made_at timestamp"
)
SCORED_DDL = "run string, fitted_before bigint, first bigint, upto bigint"
ALERT_DDL = "h bigint, probability double, reason string, run string"


def _rows(spark: SparkSession, schema: str, path: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def latest_fit(spark: SparkSession, folder: str) -> Row | None:
    """The stored fit that was made last; None where there is none."""
    return _rows(spark, FIT_DDL, f"{folder}/fits").orderBy(F.desc("made_at")).first()


def fit_and_store(
    spark: SparkSession, folder: str, table: DataFrame, before: int, sources, languages, cut: float = 0.5,
    purge: int = 24,
) -> Row | None:
    """Fit on the hours before ``before``, without the last ``purge``, whose target looks past it, and
    store the model with its feature list and cut. None, and nothing stored, where these hours have
    one class only."""
    model = fc.fit_history(table.filter(F.col("h") < before - purge))
    if model is None:
        return None
    path = f"{folder}/models/{uuid.uuid4().hex}"
    model.write().save(path)
    fit = (int(before), path, fc.feature_names(table), list(sources), list(languages), float(cut))
    row = spark.createDataFrame([fit], FIT_DDL.rsplit(", ", 1)[0]).withColumn("made_at", F.current_timestamp())
    row.write.mode("append").parquet(f"{folder}/fits")
    return latest_fit(spark, folder)


def scored_upto(spark: SparkSession, folder: str) -> int | None:
    """The last hour that has been scored."""
    return _rows(spark, SCORED_DDL, f"{folder}/scored").agg(F.max("upto")).first()[0]


def score_new(spark: SparkSession, folder: str, fit: Row, table: DataFrame, rising: DataFrame, upto: int) -> bool:
    """Alerts of the hours up to ``upto`` that no run has scored and the model was not fitted on;
    False where there are none. An hour is scored once: messages that come later for it do not
    change its alert."""
    done = scored_upto(spark, folder)
    first = fit["fitted_before"] if done is None else max(fit["fitted_before"], done + 1)
    if first > upto:
        return False
    run = uuid.uuid4().hex
    new = table.filter(F.col("h").between(first, upto))
    probable = fc.predict(PipelineModel.load(fit["model"]), new, fit["features"])
    fc.alerts(probable, rising, fit["cut"]).write.parquet(f"{folder}/alerts/run={run}")
    mark = spark.createDataFrame([(run, fit["fitted_before"], first, upto)], SCORED_DDL)
    mark.write.mode("append").parquet(f"{folder}/scored")
    return True


def stored_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """h, probability and reason of all finished scoring runs."""
    alerts = _rows(spark, ALERT_DDL, f"{folder}/alerts")
    done = _rows(spark, SCORED_DDL, f"{folder}/scored").select("run")
    return alerts.join(done, "run", "left_semi").select("h", "probability", "reason")
