"""Helpers that the operators share: saved tables, text batches, linked components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocale.session import shared_dir

#: What a text function returns: a list or an array for each new column.
Outputs = dict[str, list]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows neither repeats the work
    nor depends on the executors that did it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark, name)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def vocabulary_path(name: str) -> str:
    """The place of a tokenizer file: a path as it is, a plain name among the installed ones."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, value: int) -> Column:
    """True for the rows that training must not see; a null id is held out."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(True))


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def parts(texts: list, chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``chars`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > chars and i > start:
            yield start, i
            start, size = i, len(text or "")
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    docs: DataFrame, keys: list[str], make: Callable[[], Callable[[list], Outputs]],
    schema: T.StructType, text: str = "text", chars: int = 400_000,
) -> DataFrame:
    """One result row per row of ``docs``: its key columns and what a function gives for its text.

    ``make()`` runs once per task and returns the function, which gets a list of texts (None where
    null) and returns one list or array per column of ``schema``. Rows come in Arrow batches and
    are cut further into ranges of about ``chars`` characters, so memory follows the longest text,
    not the number of rows.
    """
    inputs = docs.select(*keys, F.col(text).cast("string").alias("__text"))
    out = T.StructType([*[inputs.schema[k] for k in keys], *schema.fields])
    kinds = [(f.name, arrow_type(f.dataType)) for f in schema.fields]
    arrow_out = pa.schema([(f.name, arrow_type(f.dataType)) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            for a, b in parts(texts, chars):
                made = work(texts[a:b])
                columns = [batch.column(i).slice(a, b - a).cast(arrow_out.types[i]) for i in range(len(keys))]
                columns += [
                    made[name] if isinstance(made[name], pa.Array) else pa.array(made[name], type=kind)
                    for name, kind in kinds
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_out)

    return inputs.mapInArrow(run, out)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, doc_id: str, modulus: int, value: int, bound: int,
    text: str = "text",
) -> DataFrame:
    """(doc_id, text, label) of documents that training may see: labelled, and not held out.

    ``bound`` is the sample's size: with more labelled documents, about that many are taken by a
    hash of the id, before any text is read. So the sampled labels have a proven size and are
    broadcast, and texts are not shuffled. Of several labels of a document the largest counts.
    """
    known = labels.select(F.col(doc_id).alias("__key"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isNotNull() & F.col("__key").isNotNull() & ~held_out(F.col("__key"), modulus, value)
    ).groupBy("__key").agg(F.max("label").alias("label"))
    n = known.count()
    parts = 1 << 20
    if n > bound:
        known = known.filter(F.pmod(F.xxhash64(F.lit(label), "__key"), F.lit(parts)) < int(parts * bound / n))
    rows = docs.select(F.col(doc_id).alias("__key"), F.col(text).alias("text"))
    return rows.join(F.broadcast(known), "__key").select(F.col("__key").alias("doc_id"), "text", "label")


def broadcast_if(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` with a broadcast hint if there are ``limit`` at most; else Spark shuffles."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def row_keys(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1_000_000) -> DataFrame:
    """``docs`` with a number ``key`` that equal rows (id and text) share and others do not: the id
    itself where all its rows are one, else a number above all ids, in the order of id and text
    hash. Null for a null id. Only ids and hashes are grouped; ids that rows share are broadcast
    if there are ``limit`` at most, and joined by shuffle beyond."""
    from vocale.llm.merkle import ranked

    marks = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__mark"))
    several = marks.groupBy("__id").agg(F.min("__mark").alias("low"), F.max("__mark").alias("high"))
    several = saved(several.filter("low != high").select("__id"), "shared-ids")
    if not several.count():
        return docs.withColumn(key, F.col(doc_id).cast("long"))
    top = marks.agg(F.max("__id")).first()[0]
    rows = saved(marks.join(broadcast_if(several, limit), "__id", "left_semi").distinct().withColumn("grp", F.lit("")), "shared-rows")
    names = saved(ranked(rows, ["__id", "__mark"]).select("__id", "__mark", (F.col("idx") + 1 + top).alias(key)), "row-keys")
    named = docs.join(
        broadcast_if(names, limit), (F.col(doc_id) == F.col("__id")) & (F.xxhash64(text) == F.col("__mark")), "left")
    return named.withColumn(key, F.coalesce(key, F.col(doc_id).cast("long"))).drop("__id", "__mark")


def fit_in_task(rows: DataFrame, fit: Callable[[list], bytes]) -> bytes | None:
    """Run ``fit`` on all ``rows`` in one task; the caller bounds their number. The function gets
    the columns as lists, rows in the order of the first columns, and returns the model."""
    ordered = rows.repartition(1).sortWithinPartitions(*rows.columns[:2])

    def run(batches):
        columns: list[list] = [[] for _ in rows_columns]
        for batch in batches:
            for i in range(len(rows_columns)):
                columns[i].append(batch.column(i))
        if columns[0]:
            yield pa.RecordBatch.from_pydict({"model": [fit([pa.chunked_array(c) for c in columns])]})

    rows_columns = rows.columns
    made = ordered.mapInArrow(run, "model binary").first()
    return bytes(made["model"]) if made else None


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, name: str = "links", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): the smallest node it is linked with.

    Large-star and small-star rounds: each node hands its neighbours over to the smallest of
    them, until nothing changes; the number of rounds grows with the logarithm of the longest
    chain. A round is a minimum per node (combined before the shuffle, so a hub is one row per
    task) and a join, whose skewed partitions Spark splits, as the minima are saved first. The
    edges of a round are written to the shared folder; only their count and hash reach the driver.
    """
    edges = saved(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        name,
    )
    before = _signature(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        # Large star: neighbours above a node go to the smallest node around it.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below a node, and the node, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter("u != v").distinct()
        edges = saved(small, name)
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no stable components after {rounds} rounds")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
