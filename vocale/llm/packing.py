"""Length buckets that minimise padding, and batches under a token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocale.llm.byte_pairs import counter, special_strings
from vocale.llm.common import broadcast_if, map_texts, saved
from vocale.llm.token_counts import SCHEMA, VOCABULARY

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def best_buckets(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` length ranges with the least padding in all.

    Dynamic programming: f(k, j), the least padding of the shortest j lengths in k ranges, is the
    minimum over i of f(k-1, i) plus the padding of lengths i+1..j up to length j. Of equal
    choices the smaller i. ``lengths`` rise; the last one is always an end.
    """
    m = len(lengths)
    if not m:
        return []
    size = np.asarray(lengths, dtype=np.float64)
    rows = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    tokens = np.concatenate([[0.0], np.cumsum(size * np.asarray(counts, dtype=np.float64))])
    buckets = min(buckets, m)
    cost = np.full(m + 1, np.inf)
    cost[0] = 0.0
    choices = []
    for _ in range(buckets):
        now, choice = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        for j in range(1, m + 1):
            total = cost[:j] + size[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            choice[j] = i = int(np.argmin(total))
            now[j] = total[i]
        cost = now
        choices.append(choice)
    ends, j = [], m
    for choice in reversed(choices):
        ends.append(int(lengths[j - 1]))
        j = int(choice[j])
    return ends[::-1]


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens: Column | None = None,
    max_tokens: int = 2048, buckets: int = 8, budget: int = 65_536,
) -> DataFrame:
    """Training batches: (doc_id, piece, first_token, n_tokens, bucket, batch, slot, padding).

    A token is what the column ``tokens`` counts; without it a white-space word, which no model
    reads (``pack_tokens`` counts those of a vocabulary).

    A document of more than ``max_tokens`` tokens is cut into pieces of ``max_tokens`` and a rest, so every token is in one piece and the histogram of
    piece lengths has ``max_tokens`` entries at most; it alone reaches the driver, where
    ``best_buckets`` chooses ``buckets`` lengths. A piece is padded to its bucket's length, and a
    batch takes floor(budget / length) pieces of one bucket; only a bucket's last batch is not full.

    Batches are numbered without gathering a bucket in one task: pieces are dealt by hash over
    shards of about 65,536 pieces, however many there are, numbered in their shard, and moved on by
    the sizes of the shards before it. Only narrow rows are shuffled.

    A null or empty text, or a null token count, is one piece of 0 tokens in a slot of at least
    one token. Rows with null or repeated ids are packed like others; an empty table gives an
    empty one. Other columns are ignored.
    """
    if budget < max_tokens:
        raise ValueError("the budget must hold the longest piece")
    n = word_count(F.col(text)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    whole = docs.select(
        F.col(doc_id).alias("doc_id"), n.alias("n"), F.xxhash64(doc_id, text).alias("mark"))
    last = F.greatest(F.ceil(F.col("n") / max_tokens), F.lit(1)).cast("long") - 1
    pieces = saved(whole.select("doc_id", "mark", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id", "mark", "piece", (F.col("piece") * max_tokens).alias("first_token"),
        F.least(F.col("n") - F.col("piece") * max_tokens, F.lit(max_tokens)).alias("n_tokens"),
    ), "pieces")

    width = F.greatest("n_tokens", F.lit(1))
    histogram = pieces.groupBy(width.alias("length")).agg(F.count(F.lit(1)).alias("rows")).collect()
    histogram.sort()
    ends = best_buckets([r["length"] for r in histogram], [r["rows"] for r in histogram], buckets)
    shards = max(1, -(-sum(r["rows"] for r in histogram) // 65_536))

    bucket = F.element_at(F.filter(F.array(*[F.lit(e) for e in ends or [1]]), lambda e: e >= width), 1)
    placed = pieces.withColumns({
        "bucket": bucket.cast("long"), "shard": F.pmod(F.xxhash64("mark", "piece"), F.lit(shards))})
    sizes = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("rows"))
    ahead = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens", "mark")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1).join(
        broadcast_if(saved(offsets, "offsets"), 1_000_000), ["bucket", "shard"])
    place, per_batch = F.col("ahead") + F.col("at"), F.floor(F.lit(budget) / F.col("bucket"))
    return numbered.select(
        F.col("doc_id").alias(doc_id), "piece", "first_token", "n_tokens", "bucket",
        F.floor(place / per_batch).alias("batch"), (place % per_batch).alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )


def token_numbers(vocabulary: str):
    count = counter(vocabulary, special_strings(vocabulary))
    return lambda texts: {"n_tokens": count(texts)}


def pack_tokens(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, **limits: int,
) -> DataFrame:
    """``pack`` by the tokens of ``vocabulary``, the ones ``token_counts`` gives; ``limits`` are
    ``max_tokens``, ``buckets`` and ``budget``.

    The model that ``byte_pairs`` serialises merges the words; special strings count as one token
    each, as there. Tokens are counted beside each text where it is read, without a join; what is packed has the
    id, a hash in place of the text, and the count. Null and empty texts, ids and other columns
    are treated as in ``pack``.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    numbers = T.StructType([f for f in SCHEMA.fields if f.name == "n_tokens"])
    counted = map_texts(texts, ["doc_id", "mark"], lambda: token_numbers(vocabulary), numbers)
    packed = pack(counted, text="mark", tokens=F.col("n_tokens"), **limits)
    return packed.withColumnRenamed("doc_id", doc_id)
