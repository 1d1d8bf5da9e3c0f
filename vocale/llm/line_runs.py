"""Repeated lines: levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocale.llm.common import broadcast_if, saved
from vocale.session import shared_dir

BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def text_mark(text: Column) -> Column:
    """Tells rows with the same id and different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, mark, pos, h1, h2) of every line whose key has ``min_chars`` characters."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_mark(F.col(text)).alias("mark"),
                       F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    keyed = rows.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= min_chars).select(
        "doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


class LineRuns:
    """Line hashes seen so far, as sorted runs (h1, h2, n_docs, keeper) in levels.

    ``add`` takes the next batch of hashed lines. Batches come with falling ids, so the document
    that keeps a line is the largest id of the first batch that has it: the batch's keys are
    merge-anti-joined with every run, and only those that no run holds name a keeper; the others
    add to the count. The batch becomes a run of level 0. When a level has ``fanout`` runs they
    are merged into one of the next level, so n batches leave about fanout * log(n) runs.

    Runs are tables in the shared folder, bucketed and sorted by the hash: a join or merge reads
    them bucket by bucket without a shuffle. Line hashes have 128 bits.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.lowest: int | None = None

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY).write
            .bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
            .option("path", shared_dir(self.spark, name)).saveAsTable(name))
        return name

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``line_hashes``; its ids must lie below those of all batches before.
        Rows without an id belong to no document and are not counted."""
        lines = lines.filter(F.col("doc_id").isNotNull())
        low, high = lines.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is None:
            return
        if self.lowest is not None and high >= self.lowest:
            raise ValueError(f"batch ends at id {high}, an earlier one begins at {self.lowest}")
        self.lowest = low
        batch = lines.groupBy(*KEY).agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        for run in self.runs():
            held = run.select(*KEY, F.lit(True).alias("held"))
            batch = batch.join(held, KEY, "left").select(
                *KEY, "n_docs", F.when(F.col("held").isNull(), F.col("keeper")).alias("keeper"))
        self.put(0, self.write(batch))

    def put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged = self.write(self.merged([self.spark.table(n) for n in self.levels[level]]))
            for old in self.levels[level]:
                self.spark.sql(f"DROP TABLE {old}")
            self.levels[level] = []
            self.put(level + 1, merged)

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs merged in pairs by a full join on the hash, which their order serves."""
        while len(runs) > 1:
            runs = [self.both(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return runs[0]

    @staticmethod
    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.select(*KEY, F.col("n_docs").alias("more"), F.col("keeper").alias("also"))
        return a.join(other, KEY, "full").select(
            *KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"),
            F.greatest("keeper", "also").alias("keeper"))

    def crowded(self, min_docs: int) -> DataFrame | None:
        """(h1, h2, keeper) of keys found in at least ``min_docs`` documents."""
        runs = self.runs()
        return self.merged(runs).filter(F.col("n_docs") >= min_docs).select(*KEY, "keeper") if runs else None


def cuts(docs: DataFrame, doc_id: str, batches: int) -> list[int]:
    """Ids that split the documents into about equal batches."""
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx(doc_id, shares, 10_000)).first()[0] if shares else None
    return sorted(set(found or []))


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
    min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, keys_limit: int = 1_000_000,
) -> DataFrame:
    """(doc_id, *keep, text, n_lines, n_dropped): every text without its crowded lines.

    A line's key is ``line_key``. A key of at least ``min_chars`` code points found in at least
    ``min_docs`` documents loses all its lines except in the largest id that holds it. Lines are
    hashed once and saved; the documents go into ``LineRuns`` in batches of falling ids; lines of
    crowded keys are looked up, and only the positions to drop meet the texts. A frequent line is
    counted by document first and then by key, so it is no task of its own. Crowded keys are
    broadcast if there are ``keys_limit`` at most, and joined by shuffle beyond.

    A null or empty text is one empty line. Rows that share an id count as one document and are
    each cleaned; rows without an id count as none and lose crowded lines. A text that loses all
    lines becomes empty and stays. An empty table gives an empty one. Columns not named are
    ignored. Long texts: time is linear in the number of lines.
    """
    spark = docs.sparkSession
    keep = keep or []
    lines = saved(line_hashes(docs, doc_id, text, min_chars), "lines")
    runs = LineRuns(spark, fanout)
    bounds = cuts(docs, doc_id, batches)
    for low, high in zip([*reversed(bounds), None], [None, *reversed(bounds)]):
        batch = lines
        if low is not None:
            batch = batch.filter(F.col("doc_id") >= low)
        if high is not None:
            batch = batch.filter(F.col("doc_id") < high)
        runs.add(batch)
    crowded = runs.crowded(min_docs)
    rows = docs.select(F.col(doc_id).alias("__id"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)],
                       F.col(text).alias("__text"), text_mark(F.col(text)).alias("__mark"))
    if crowded is None:
        kind = docs.schema[doc_id].dataType.simpleString()
        drops = spark.createDataFrame([], f"doc_id {kind}, mark long, drop array<int>")
    else:
        drops = (
            lines.join(broadcast_if(saved(crowded, "crowded"), keys_limit), KEY).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("drop"))
        )
    both = rows.join(drops, rows["__id"].eqNullSafe(drops["doc_id"]) & (rows["__mark"] == drops["mark"]), "left")
    lines_now = lines_of(F.col("__text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_now) - 1), F.col("drop"))
    cleaned = F.array_join(F.transform(stay, lambda i: F.get(lines_now, i)), "\n")
    return both.select(
        F.col("__id").alias(doc_id), *[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)],
        F.when(F.col("drop").isNull(), F.coalesce("__text", F.lit(""))).otherwise(cleaned).alias(text),
        F.size(lines_now).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
