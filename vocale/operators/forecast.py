"""Spike forecast: training table, walk-forward folds, boosted trees, metrics, alerts.

The tables here have one row per hour (or per hour and fold), whatever the number of messages.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocale.operators.hourly import dense, roll_up
from vocale.operators.rolling import (
    WINDOWS, future_negatives, in_blocks, language_shift, frame, new_entities, own_rows, peak_delta, rolling,
    threshold as spike_level,
)

OTHER = "other"


def _column(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name)


def source_rates(counts: DataFrame, sources: Sequence[str], hours: int = 24) -> DataFrame:
    """h and one negative rate per listed source over the last hours; all other sources together
    are one more column, so the feature list stays the same whatever sources appear."""
    named = counts.withColumn("source", F.when(F.col("source").isin(*sources), F.col("source")).otherwise(OTHER))
    rolled = rolling(dense(roll_up(named, "source"), "source"), (hours,), ("source",))
    return rolled.groupBy("h").agg(
        *[
            F.max(F.when(F.col("source") == s, F.col(f"negative_rate_{hours}h"))).alias(f"negative_rate_{_column(s)}")
            for s in (*sources, OTHER)
        ]
    )


def language_shares(counts: DataFrame, languages: Sequence[str], hours: int = 24) -> DataFrame:
    """h and the share of each listed language in the last hours."""
    named = counts.withColumn("lang", F.when(F.col("lang").isin(*languages), F.col("lang")).otherwise(OTHER))
    by_hour = named.groupBy("h").agg(
        F.sum("total").alias("total"),
        *[
            F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("total"))), F.lit(0)).alias(f"lang_{_column(x)}")
            for x in (*languages, OTHER)
        ],
    )
    over = frame(1 - hours, 0)
    shares = {
        f"share_{_column(x)}": F.try_divide(
            F.sum(f"lang_{_column(x)}").over(over).cast("double"), F.sum("total").over(over)
        )
        for x in (*languages, OTHER)
    }
    names = list(shares)
    return own_rows(in_blocks(dense(by_hour), hours).withColumns(shares)).select("h", *names)


def entity_features(entity_hourly: DataFrame) -> DataFrame:
    """h, the largest entity_frequency_delta of the hour, whether the entity is mentioned in it or
    before, and the number of new entities of the hour."""
    delta = peak_delta(entity_hourly).withColumnRenamed("delta", "entity_frequency_delta")
    new = new_entities(entity_hourly).groupBy("h").agg(F.count(F.lit(1)).alias("new_entities_in_negatives"))
    return delta.join(new, "h", "full").na.fill(0)


def training_table(
    counts: DataFrame, entity_hourly: DataFrame, sources: Sequence[str], languages: Sequence[str], horizon: int = 24
) -> DataFrame:
    """One row per hour: all features and future_negatives, the volume the target is cut from.

    ``counts`` are the hourly parts by source and language; everything is rolled up from them, so
    the messages themselves are read once.
    """
    base = future_negatives(rolling(dense(roll_up(counts)), WINDOWS, change=True), horizon)
    shift = language_shift(roll_up(counts, "lang")).withColumnRenamed("shift", "language_shift")
    return (
        base.join(source_rates(counts, sources), "h", "left")
        .join(language_shares(counts, languages), "h", "left")
        .join(shift, "h", "left")
        .join(entity_features(entity_hourly), "h", "left")
        .na.fill(0, ["entity_frequency_delta", "new_entities_in_negatives"])
    )


def feature_names(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in ("h", "future_negatives", "fold", "role", "threshold", "y", "weight")]


def folds(table: DataFrame, period: int = 120, first: int = 2, purge: int = 24) -> DataFrame:
    """Rows of each walk-forward fold: fold k trains on the first k periods and tests on the next.

    The last ``purge`` hours before a cut are left out of training, as their target looks past it.
    Each hour is copied once per fold that uses it; nothing is joined by range.
    """
    start = table.agg(F.min("h")).scalar()
    last = F.floor((table.agg(F.max("h")).scalar() - F.lit(0) - start) / period)
    number = F.floor((F.col("h") - start) / period)
    placed = table.withColumns({"_n": number, "_start": start, "_last": last})
    uses = placed.filter(F.greatest("_n", F.lit(first)) <= F.col("_last")).withColumn(
        "fold", F.explode(F.sequence(F.greatest("_n", F.lit(first)), F.col("_last")))
    )
    cut = F.col("_start") + F.col("fold") * period
    role = F.when(F.col("h") >= cut, "test").when(F.col("h") < cut - purge, "train")
    return uses.withColumn("role", role).filter("role is not null").drop("_n", "_start", "_last")


def with_target(rows: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Add threshold (mean + sigma deviations of the fold's training part only) and y."""
    train = F.when(F.col("role") == "train", F.col("future_negatives"))
    limits = rows.groupBy("fold").agg((F.avg(train) + F.lit(sigma) * F.stddev_samp(train)).alias("threshold"))
    return rows.join(limits, "fold").withColumn("y", (F.col("future_negatives") > F.col("threshold")).cast("int"))


def with_history_target(table: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Add threshold (mean + sigma deviations of all hours whose target is known) and y."""
    limit = spike_level(table, sigma).select("threshold").scalar()
    return table.withColumn("threshold", limit).withColumn(
        "y", (F.col("future_negatives") > F.col("threshold")).cast("int"))


def class_weights(rows: DataFrame) -> DataFrame:
    """Per fold: training rows by class and the weight of a positive, NULL without positives."""
    train = rows.filter((F.col("role") == "train") & F.col("y").isNotNull())
    counts = train.groupBy("fold").agg(
        F.count_if(F.col("y") == 1).alias("positives"), F.count_if(F.col("y") == 0).alias("negatives_rows")
    )
    return counts.withColumn("weight", F.try_divide(F.col("negatives_rows").cast("double"), F.col("positives")))


def fit(train: DataFrame, names: list[str], weight: float, seed: int = 7, iterations: int = 10) -> PipelineModel:
    """Boosted trees on rows with y; positives weigh ``weight``. NULL features count as 0."""
    ready = train.select(
        *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names],
        F.col("y").cast("double").alias("label"),
        F.when(F.col("y") == 1, weight).otherwise(1.0).alias("w"),
    )
    stages = [
        VectorAssembler(inputCols=names, outputCol="features"),
        GBTClassifier(weightCol="w", maxIter=iterations, maxDepth=3, seed=seed),
    ]
    return Pipeline(stages=stages).fit(ready)


def predict(model: PipelineModel, rows: DataFrame, names: list[str]) -> DataFrame:
    """Add probability of a spike."""
    filled = rows.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names})
    scored = model.transform(filled).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(*rows.columns, "probability")


def train_forecast(rows: DataFrame, cut: float = 0.5, parallelism: int = 4) -> DataFrame:
    """Test rows (fold, h, y, probability, prediction) of every fold.

    A fold whose training part has only one class gets no model: probability and prediction are
    NULL. One model is fitted per fold, some at a time; there are as many folds as periods.
    """
    names = feature_names(rows)

    def run(r) -> DataFrame:
        part = rows.filter(F.col("fold") == r["fold"])
        test = part.filter(F.col("role") == "test").drop("role")
        if r["positives"] and r["negatives_rows"]:
            train = part.filter((F.col("role") == "train") & F.col("y").isNotNull())
            scored = predict(fit(train, names, r["weight"]), test, names)
        else:
            scored = test.withColumn("probability", F.lit(None).cast("double"))
        return scored.select(
            "fold", "h", "y", "probability", (F.col("probability") > cut).cast("int").alias("prediction")
        )

    weights = class_weights(rows).orderBy("fold").collect()
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(inheritable_thread_target(rows.sparkSession)(run), weights)))


def fit_history(table: DataFrame, sigma: float = 2.0) -> PipelineModel | None:
    """A model on all hours with a known target; None when they are of one class."""
    rows = with_history_target(table, sigma)
    counts = class_weights(rows.withColumns({"fold": F.lit(0), "role": F.lit("train")})).first()
    if counts is None or not counts["positives"] or not counts["negatives_rows"]:
        return None
    return fit(rows.filter(F.col("y").isNotNull()), feature_names(table), counts["weight"])


def rule_prediction(rows: DataFrame) -> DataFrame:
    """Test rows of a rule in place of a model: a spike follows when the last day was one."""
    return rows.filter(F.col("role") == "test").withColumn(
        "prediction", (F.col("negative_volume_24h") > F.col("threshold")).cast("int")
    )


def metrics(predictions: DataFrame) -> DataFrame:
    """Per fold: confusion counts, recall (NULL without positives), precision (NULL without alarms)."""
    known = predictions.filter(F.col("y").isNotNull() & F.col("prediction").isNotNull())

    def both(y: int, p: int) -> Column:
        return F.count_if((F.col("y") == y) & (F.col("prediction") == p))

    counts = known.groupBy("fold").agg(
        both(1, 1).alias("tp"), both(0, 1).alias("fp"), both(1, 0).alias("fn"), both(0, 0).alias("tn")
    )
    tp = F.col("tp").cast("double")
    return counts.withColumns(
        {
            "recall": F.try_divide(tp, F.col("tp") + F.col("fn")),
            "precision": F.try_divide(tp, F.col("tp") + F.col("fp")),
        }
    )


def importance(spark: SparkSession, model: PipelineModel, names: list[str]) -> DataFrame:
    """Rows (feature, importance); one per feature."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")


def alerts(scored: DataFrame, rising: DataFrame, cut: float = 0.5) -> DataFrame:
    """Hours whose probability is above the cut, with the top rising entities as the reason.

    ``rising`` has the k best entities per hour, so the reason list is short.
    """
    reasons = rising.groupBy("h").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda r: r["entity"]), ", "
        ).alias("reason")
    )
    return scored.filter(F.col("probability") > cut).select("h", "probability").join(reasons, "h", "left")
