"""A corpus made ready for training: the stages, in order, from raw documents to packed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocale.llm.common import row_keys, saved, table
from vocale.llm.jaccard_join import similar_documents
from vocale.llm.line_runs import dedup_lines
from vocale.llm.packing import pack_tokens
from vocale.llm.quality import fit_quality, score_quality
from vocale.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, does not reject.

    Rows with a null or repeated id, null and empty texts are scored like others; rows without a
    known term get the base rate, so they stay. An empty table gives an empty one. Other columns
    are dropped, whatever their names."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, [*COLUMNS]).filter("predicted = 0").select(*COLUMNS)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, trained on the labelled ones among them, accepts.

    A null text is scored as an empty one. Rows with null or repeated ids are scored one by one.
    Without labels of both kinds the base rate decides for all. An empty table gives an empty
    one. Other columns are dropped, whatever their names."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, [*COLUMNS]).filter("predicted = 1").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them share; n_chars is counted again.

    A null text comes out empty, as does one that loses all its lines; both stay. Rows that share
    an id count as one document and are each cleaned; rows without an id count as none. An empty
    table gives an empty one. Other columns are dropped, whatever their names."""
    kept = dedup_lines(docs, keep=["lang", "source"])
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of similar ones.

    Documents are told apart by id and text: of equal rows one stays, and different texts under
    one id are documents of their own, which come after those whose id is theirs alone. Rows
    without an id are in no group and stay, as do texts without words. An empty table gives an
    empty one. Other columns are dropped, whatever their names."""
    keyed = row_keys(docs.select(*COLUMNS), "row")
    numbers = saved(keyed.filter("row IS NOT NULL").groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "equal-rows")
    similar = similar_documents(keyed.select("row", "text"), "row").filter("row != component_id").select("row").distinct()
    kept = keyed.join(similar, "row", "left_anti")
    if numbers.count():
        equal = kept.join(numbers.select("row"), "row", "left_semi").dropDuplicates(["row"])
        kept = kept.join(numbers.select("row"), "row", "left_anti").unionByName(equal)
    return kept.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in its place in a batch, by the tokens of a vocabulary.

    A null or empty text is one piece of no tokens. Rows with null or repeated ids are packed one
    by one. An empty table gives an empty one. Other columns are dropped, whatever their names."""
    return pack_tokens(docs)


STAGES = [
    ("toxicity", without_toxic), ("quality", of_quality), ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each), ("packing", packed),
]
#: The models are trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
