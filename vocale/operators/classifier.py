"""Trained stand-in: a Spark ML text classifier on labelled documents."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocale.operators.sentiment import to_public


def train_classifier(docs: DataFrame, labels: DataFrame, text: str = "norm", features: int = 1 << 16) -> PipelineModel:
    """Fit on the labelled documents; a toxic document counts as negative. Both classes have the same
    weight, as few documents are toxic; the fit keeps few terms, as a long document has many more
    words that say nothing than words that do.

    Texts become sets of terms where they are read; these are joined with the labels and kept for
    the passes over them.
    """
    words = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features, binary=True),
    ]).fit(docs)
    counted = words.transform(docs).select("doc_id", "_tf")
    training = counted.join(labels.select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id").persist()
    sizes = training.agg(F.count_if(F.col("label") == 1).alias("positives"), F.count("label").alias("rows")).first()
    share = min(max(sizes["positives"] / sizes["rows"], 1e-6), 1 - 1e-6) if sizes["rows"] else 0.5
    weighed = training.withColumn("_weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    model = Pipeline(stages=[
        LogisticRegression(
            featuresCol="_tf", labelCol="label", weightCol="_weight", maxIter=50, regParam=0.01, elasticNetParam=1.0),
    ]).fit(weighed)
    training.unpersist()
    return PipelineModel(stages=[*words.stages, *model.stages])


def classify(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """Add sentiment_label and sentiment_score of a trained classifier."""
    scored = model.transform(docs).withColumn("_p", vector_to_array("probability")[1])
    raw = scored.select(
        *docs.columns,
        F.when(F.col("prediction") == 1.0, "negative").otherwise("neutral").alias("raw_label"),
        F.greatest(F.col("_p"), 1 - F.col("_p")).alias("raw_score"),
    )
    return to_public(raw).drop("raw_label", "raw_score")
