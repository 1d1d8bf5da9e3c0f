"""What each of five filters removes, in every order of the five."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocale.llm.common import saved

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
#: The bit of the last filter, the only one that looks at other documents.
COPY = 1 << FILTERS.index("E")
COMBINATIONS = range(1 << len(FILTERS))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Whether a text fails A (under 50 words), B (under 65 % of its words are distinct), C (over
    5 % of its characters are A-Z) and D (holds a symbol). Words differ by case."""
    n_words = F.size(words).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {
        "A": n_words < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n_words,
        "C": 100 * capitals > 5 * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def bits_of(failures: dict[str, Column]) -> Column:
    """The failures as one number, a bit per filter."""
    return sum((F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in failures.items()), F.lit(0)).cast("int")


def copies(rows: DataFrame, hashes: DataFrame, hot_keys: int = 50_000, keys_limit: int = 1_000_000) -> DataFrame:
    """Rows of ``rows`` (doc_id, part, hash, text) whose exact text some smaller doc_id has.

    ``hashes`` has doc_id and hash of the same rows, narrow and saved. A left-semi join on hash,
    exact text and smaller doc_id; the side that is looked up has one row a text, the smallest id
    that holds it. While at most ``keys_limit`` hashes belong to several ids, they are broadcast
    and no other text is shuffled. A text held by more than one ``hot_keys``-th of all rows is
    spread: its rows are dealt over shares, and its one row is given to each share. There are
    ``hot_keys`` such texts at most, so they are broadcast.
    """
    shared = saved(
        hashes.groupBy("hash").agg(
            F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
        ).filter("least < most").select("hash", "n"), "shared-hashes")
    limit = max(1000, hashes.count() // hot_keys)
    hot = F.broadcast(shared.filter(F.col("n") > limit).select(
        F.col("hash").alias("hot"), F.ceil(F.col("n") / limit).cast("int").alias("shares")))
    some = rows.filter("doc_id IS NOT NULL")
    if shared.count() <= keys_limit:
        some = some.join(F.broadcast(shared.select("hash")), "hash", "left_semi")
    spread = some.join(hot, F.col("hash") == F.col("hot"), "left").drop("hot").withColumn(
        "shares", F.coalesce("shares", F.lit(1)))
    firsts = spread.groupBy("hash", "text", "shares").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select(
        F.col("hash").alias("__hash"), F.col("text").alias("__text"), "least",
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("__share"))
    dealt = spread.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int"))
    return dealt.join(
        firsts,
        (F.col("hash") == F.col("__hash")) & (F.col("share") == F.col("__share"))
        & (F.col("text") == F.col("__text")) & (F.col("least") < F.col("doc_id")), "left_semi")


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, bits, n): documents by id, part and the filters that they fail, a bit each.

    The rows of the copies are united with the rows of the other failures, and the bits are
    combined by document. Rows that share an id are told apart by a hash of their text, so each
    counts as a document; a row without an id is a copy of none.
    """
    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = named.withColumn("hash", F.xxhash64("text"))
    scanned = saved(rows.withColumn("words", words_of(F.col("text"))).select(
        "doc_id", "part", "hash", bits_of(text_failures(F.col("text"), F.col("words"))).alias("bits"),
        F.lit(1).cast("long").alias("n")), "text-failures")
    again = copies(rows, scanned.select("doc_id", "hash").filter("doc_id IS NOT NULL")).select(
        "doc_id", "part", "hash", F.lit(COPY).alias("bits"), F.lit(0).cast("long").alias("n"))
    by_text = scanned.unionByName(saved(again, "copies")).groupBy("doc_id", "part", "hash").agg(
        F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    return by_text.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))


def audit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source",
) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley, for all 120 orders of the five filters.

    Documents are counted by the combination of filters that they fail, 32 numbers a part; what
    an order removes at a step follows from these: the combinations with the step's filter and
    none of those before it. A document that fails k filters is removed by each of them in 120 / k
    orders, which is what ``shapley`` adds up. A document is good (toxic) if a row of ``labels``
    with its id has quality (toxic) 1.

    A null text is an empty one: no words, so it fails A; it is a copy of empty texts with
    smaller ids. A null part is the part ''. Rows with a null id are counted, and are copies of
    none. Repeated rows count one by one. A part is in the result as long as it has a row; an
    empty table gives an empty result. Other columns are ignored, whatever their names. Texts are
    read where they lie but for those of copies, which are shuffled.
    """
    found = saved(failures(docs, doc_id, text, part), "failures")
    marks = labels.select(
        F.col(doc_id).alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad")
    ).filter("doc_id IS NOT NULL AND (good OR bad)").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("good").cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce(F.col("bad").cast("int"), F.lit(0))).alias("bad"))
    zero = F.lit(0).cast("long")
    counted = found.select("part", "bits", "n", zero.alias("good"), zero.alias("bad"))
    labelled = found.join(marks, "doc_id").select(
        "part", "bits", zero.alias("n"), (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("bad")).alias("bad"))
    sums = [
        F.sum(F.when(F.col("bits") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
        for c in ("n", "good", "bad") for k in COMBINATIONS
    ]
    united = counted.union(labelled).groupBy("part", "bits").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
    by_part = united.groupBy("part").agg(*sums).select(
        "part", *[F.array(*[F.col(f"{c}{k}") for k in COMBINATIONS]).alias(c) for c in ("n", "good", "bad")])

    steps = [
        ("".join(order), i + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(g) for g in order[:i]))
        for order in itertools.permutations(FILTERS) for i, f in enumerate(order)
    ]
    listed = F.explode(F.lit([f"{o},{s},{f},{b}" for o, s, f, b in steps]))
    made = F.from_csv("at", "filter_order string, step int, filter int, before int")
    each = by_part.withColumn("at", listed).select("part", "n", "good", "bad", made.alias("at")).select(
        "part", "n", "good", "bad", "at.*")

    def total(counts: str, keep) -> Column:
        """The sum of the counts of the combinations that ``keep`` takes."""
        return F.aggregate(F.transform(counts, lambda x, k: F.when(keep(k), x).otherwise(0)), zero, lambda a, x: a + x)

    def fails(k):
        return k.bitwiseAND(F.col("filter")) != 0

    def early(k):
        return k.bitwiseAND(F.col("before")) != 0

    orders = len(steps) // len(FILTERS)
    first_in = F.lit([orders // max(1, k.bit_count()) for k in COMBINATIONS])
    weighed = F.transform("n", lambda x, k: F.when(fails(k), x * F.get(first_in, k)).otherwise(0))
    return each.select(
        "part", "filter_order", "step",
        total("n", lambda k: ~fails(k) & ~early(k)).alias("kept"),
        total("n", lambda k: fails(k) & ~early(k)).alias("removed"),
        total("n", lambda k: fails(k) & early(k)).alias("redundant"),
        total("n", lambda k: k == F.col("filter")).alias("unique_fails"),
        total("good", lambda k: fails(k) & ~early(k)).alias("good_lost"),
        total("bad", lambda k: fails(k) & ~early(k)).alias("toxic_lost"),
        F.aggregate(weighed, zero, lambda a, x: a + x).alias("shapley"),
    )
