"""Rolling features over hours.

Frames are ranges over the hour index, so gaps cannot shift them. No window runs over the whole
history in one task: hours are cut into blocks, the rows a neighbouring block needs to look back
on (or ahead to) are copied into it, and only rows of their own block are kept afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vocale.operators.hourly import dense

# Window lengths in hours.
WINDOWS = (1, 6, 24, 168)


def in_blocks(df: DataFrame, back: int, ahead: int = 0) -> DataFrame:
    size = 4 * max(back, ahead, 24)
    home = F.floor(F.col("h") / size)
    at = F.col("h") - home * size
    blocks = F.array_compact(
        F.array(home, F.when(at >= size - back, home + 1), F.when(at < ahead, home - 1))
    )
    return df.withColumn("_home", home).withColumn("_block", F.explode(blocks))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_block = _home").drop("_block", "_home")


def frame(first: int, last: int, *keys: str):
    """Hours from h+first to h+last of the same key."""
    return W.partitionBy("_block", *keys).orderBy("h").rangeBetween(first, last)


def _rate(hours: int, shift: int = 0, *keys: str) -> Column:
    over = frame(1 - hours - shift, -shift, *keys)
    return F.try_divide(F.sum("negatives").over(over).cast("double"), F.sum("total").over(over))


def rolling(stats: DataFrame, hours=WINDOWS, keys: tuple[str, ...] = (), change: bool = False) -> DataFrame:
    """Add per window X: negative_volume_Xh, negative_rate_Xh (NULL without feedback) and
    avg_sentiment_score_Xh over negatives; with ``change`` also negative_rate_change_Xh, the rate
    minus that of the window just before."""
    columns: dict[str, Column] = {}
    for x in hours:
        over = frame(1 - x, 0, *keys)
        columns[f"negative_volume_{x}h"] = F.sum("negatives").over(over)
        columns[f"negative_rate_{x}h"] = _rate(x, 0, *keys)
        columns[f"avg_sentiment_score_{x}h"] = F.try_divide(
            F.sum("neg_score_sum").over(over), F.sum("negatives").over(over)
        )
        if change:
            columns[f"negative_rate_change_{x}h"] = _rate(x, 0, *keys) - _rate(x, x, *keys)
    back = max(hours) * (2 if change else 1)
    return own_rows(in_blocks(stats, back).withColumns(columns))


def rate_change(stats: DataFrame, hours=WINDOWS) -> DataFrame:
    """h and negative_rate_change_Xh per window; NULL when either window has no feedback."""
    columns = {f"negative_rate_change_{x}h": _rate(x) - _rate(x, x) for x in hours}
    blocks = in_blocks(stats.select("h", "total", "negatives"), 2 * max(hours))
    return own_rows(blocks.withColumns(columns)).drop("total", "negatives")


def language_shift(counts: DataFrame, recent: int = 24, base: int = 168) -> DataFrame:
    """Total-variation distance of the last ``recent`` hours' language mix from that of the
    ``base`` hours before; NULL when either window is empty. ``counts`` has lang, h, total."""
    counts = dense(counts.select("lang", "h", "total"), "lang")
    sums = own_rows(
        in_blocks(counts, recent + base).withColumns(
            {
                "p": F.sum("total").over(frame(1 - recent, 0, "lang")),
                "q": F.coalesce(F.sum("total").over(frame(1 - recent - base, -recent, "lang")), F.lit(0)),
            }
        )
    )
    hour = W.partitionBy("h")
    parts = sums.select(
        "h",
        F.try_divide(F.col("p").cast("double"), F.sum("p").over(hour)).alias("p"),
        F.try_divide(F.col("q").cast("double"), F.sum("q").over(hour)).alias("q"),
    )
    return parts.groupBy("h").agg((F.lit(0.5) * F.sum(F.abs(F.col("p") - F.col("q")))).alias("shift"))


def entity_delta(entity_hourly: DataFrame, recent: int = 24, days: int = 7) -> DataFrame:
    """Mentions in the last day minus the daily average of the ``days`` before, at each hour in
    which the entity was mentioned."""
    base = 24 * days
    now = F.sum("mentions").over(frame(1 - recent, 0, "entity", "label"))
    before = F.sum("mentions").over(frame(1 - recent - base, -recent, "entity", "label"))
    delta = now - F.coalesce(before, F.lit(0)) / F.lit(days)
    return own_rows(in_blocks(entity_hourly, recent + base).withColumn("delta", delta.cast("double")))


def delta_spans(entity_hourly: DataFrame, recent: int = 24, days: int = 7) -> DataFrame:
    """entity_frequency_delta at every hour, as spans (entity, label, first, until, delta) in which it
    stays the same, ``until`` being the hour after the last.

    The delta of an entity changes at three hours a mention only: when the mention comes, leaves the
    last day, and leaves the days before it. The sums run over these hours in whole numbers, so an
    entity costs rows by its mentions, not by the hours of the history. Spans in which nothing of
    the last ``days`` + 1 days is left have no row.
    """
    m = F.col("mentions")
    changes = entity_hourly.select("entity", "label", F.inline(F.array(
        F.struct(F.col("h").alias("first"), (days * m).alias("_delta"), m.alias("_left")),
        F.struct((F.col("h") + recent).alias("first"), (-(days + 1) * m).alias("_delta"), F.lit(0).cast("bigint").alias("_left")),
        F.struct((F.col("h") + recent + 24 * days).alias("first"), m.alias("_delta"), (-m).alias("_left")),
    )))
    steps = changes.groupBy("entity", "label", "first").agg(F.sum("_delta").alias("_delta"), F.sum("_left").alias("_left"))
    order = W.partitionBy("entity", "label").orderBy("first")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = steps.select(
        "entity", "label", "first", F.lead("first").over(order).alias("until"),
        (F.sum("_delta").over(so_far) / F.lit(days)).alias("delta"), F.sum("_left").over(so_far).alias("_left"))
    return spans.filter("_left > 0").drop("_left")


def peak_delta(entity_hourly: DataFrame, recent: int = 24, days: int = 7) -> DataFrame:
    """h and the largest entity_frequency_delta of the hour, over all entities that were mentioned in
    its last ``days`` + 1 days, whether in this very hour or before.

    The hours of a span are two overlapping runs whose length is a power of two; the maximum per
    length and start combines map-side, and what is left is a few rows per hour to spread out.
    """
    spans = delta_spans(entity_hourly, recent, days)
    size = F.pow(F.lit(2), F.floor(F.log2(F.col("until") - F.col("first")))).cast("bigint")
    runs = spans.withColumn("_size", size).select(
        "_size", "delta", F.explode(F.array_distinct(F.array(F.col("first"), F.col("until") - F.col("_size")))).alias("_at"))
    tops = runs.groupBy("_size", "_at").agg(F.max("delta").alias("delta"))
    hours = tops.select(F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_size") - 1)).alias("h"), "delta")
    return hours.groupBy("h").agg(F.max("delta").alias("delta"))


def new_entities(entity_hourly: DataFrame) -> DataFrame:
    """Entities by the hour of their first negative mention."""
    return entity_hourly.groupBy("entity", "label").agg(F.min("h").alias("h"))


def top_rising(delta: DataFrame, k: int = 3) -> DataFrame:
    """The k entities with the largest delta of each hour; ties by name."""
    order = W.partitionBy("h").orderBy(F.desc("delta"), "entity", "label")
    return delta.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def future_negatives(stats: DataFrame, horizon: int = 24) -> DataFrame:
    """Add future_negatives: negatives of the next ``horizon`` hours, NULL when they are not complete."""
    over = frame(1, horizon)
    value = F.when(F.count("negatives").over(over) == horizon, F.sum("negatives").over(over))
    return own_rows(in_blocks(stats, 0, horizon).withColumn("future_negatives", value))


def threshold(table: DataFrame, sigma: float = 2.0, cutoff: Column | None = None) -> DataFrame:
    """One row with mean, deviation and threshold of future_negatives before the cutoff."""
    history = table if cutoff is None else table.filter(F.col("h") < cutoff)
    return history.agg(
        F.avg("future_negatives").alias("mean"), F.stddev_samp("future_negatives").alias("deviation")
    ).withColumn("threshold", F.col("mean") + F.lit(sigma) * F.col("deviation"))


def spike_target(stats: DataFrame, horizon: int = 24, sigma: float = 2.0) -> DataFrame:
    """Add future_negatives, threshold over the history and y (1 for a spike; NULL when unknown)."""
    future = future_negatives(stats, horizon)
    limit = threshold(future, sigma).select("threshold").scalar()
    return future.withColumn("threshold", limit).withColumn(
        "y", (F.col("future_negatives") > F.col("threshold")).cast("int")
    )
