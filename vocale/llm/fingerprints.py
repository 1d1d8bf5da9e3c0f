"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocale.llm.common import arrow_type, map_texts, parts

SLOTS = 64
#: Levels of phrases whose names go into a fingerprint, and the highest level that is built.
FIRST_LEVEL, LAST_LEVEL = 3, 6
U = np.uint64
ODD = tuple(U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * ODD[1]
    x = (x ^ (x >> U(27))) * ODD[2]
    return x ^ (x >> U(31))


def tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of deterministic coin tossing: twice the lowest bit in which a symbol differs from
    the one before it, plus that bit. Neighbours that differ keep different labels (below 128)."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = ~names[first]
    one = names.dtype.type(1)
    before ^= names
    low = np.bitwise_count((before - one) & ~before)
    return (low << np.uint8(1)) | ((names >> low.astype(names.dtype)) & one).astype(np.uint8)


@functools.cache
def small_toss() -> np.ndarray:
    """The same for labels below 128, as a table by 128 * the label before + the label."""
    before, label = np.divmod(np.arange(128 * 128, dtype=np.uint16), np.uint16(128))
    low = np.bitwise_count(((before ^ label) - np.uint16(1)) & ~(before ^ label))
    return (2 * low + ((label >> low) & 1)).astype(np.uint8)


def runs_joined(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol become one symbol, named after the symbol and the run's length."""
    head = np.ones(len(names), dtype=bool)
    head[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(head)
    length = np.diff(starts, append=len(names)).astype(np.uint64)
    joined = names[starts]
    long = length > 1
    joined[long] = mixed(joined[long] * ODD[0] + length[long])
    return joined, owner[starts]


def phrase_starts(names: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where phrases begin: at each text's first symbol, and where the label, after four rounds of
    coin tossing (at most six labels are left), is larger than both neighbours' labels. Phrases
    have 2 to about 11 symbols, and whether one begins depends on few symbols around it."""
    first = np.ones(len(names), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    label = tossed(names, first)
    pair = np.empty(len(label), dtype=np.uint16)
    for _ in range(3):
        pair[0] = 0
        pair[1:] = label[:-1]
        pair[first] = label[first] ^ 1
        label = small_toss()[(pair << np.uint16(7)) | label]
    top = np.zeros(len(names), dtype=bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    near_first = first.copy()
    near_first[1:] |= first[:-1]
    near_first[:-1] |= first[1:]  # a text's second and last symbols begin nothing
    return np.flatnonzero(first | (top & ~near_first))


@functools.cache
def place_factors() -> np.ndarray:
    """An odd factor for each place in a phrase; phrases are shorter than this by far."""
    return mixed(ODD[0] * np.arange(1, 65, dtype=np.uint64)) | U(1)


@functools.cache
def letter_names() -> np.ndarray:
    return mixed(np.arange(0x110000, dtype=np.uint64) + ODD[0])


def named(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The names of phrases: a hash of their symbols in order."""
    place = np.arange(len(names)) - np.repeat(starts, np.diff(starts, append=len(names)))
    return mixed(np.add.reduceat(names * place_factors()[place & 63], starts))


def parse(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, name) of the phrases of levels ``FIRST_LEVEL`` to ``LAST_LEVEL`` of every text. A
    text that is one phrase below the first level gives that one name. Empty texts give none."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    names, owner = letter_names()[codes], np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    owners, found = [], []
    for level in range(LAST_LEVEL + 1):
        if not len(names):
            break
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        alone = np.zeros(len(texts), dtype=bool)
        alone[owner[first]] = np.diff(first, append=len(owner)) == 1
        done = alone[owner]
        if level >= FIRST_LEVEL:
            owners.append(owner)
            found.append(names)
        elif done.any():
            owners.append(owner[done])
            found.append(names[done])
        names, owner = names[~done], owner[~done]
        if level == LAST_LEVEL or not len(names):
            break
        names, owner = runs_joined(names, owner)
        starts = phrase_starts(names, owner)
        names, owner = named(names, starts), owner[starts]
    if not owners:
        return np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
    return np.concatenate(owners), np.concatenate(found)


def sketches(texts: list[str]) -> np.ndarray:
    """One row of ``SLOTS`` 16-bit numbers per text: the phrase names are dealt over the slots and
    each slot keeps its smallest; an empty slot takes the next full one's, changed by the distance.
    A text without a phrase has 0 everywhere; no other has a 0."""
    owner, names = parse(texts)
    n, none = len(texts), ~U(0)
    least = np.full(n * SLOTS, none, dtype=np.uint64)
    hashed = mixed(names ^ ODD[1])
    at = owner.astype(np.int64) * SLOTS + (hashed % U(SLOTS)).astype(np.int64)
    order = np.lexsort((hashed, at))
    at, hashed = at[order], hashed[order]
    heads = np.flatnonzero(np.diff(at, prepend=-1)) if len(at) else np.array([], dtype=int)
    least[at[heads]] = hashed[heads] >> U(6)
    least = least.reshape(n, SLOTS)
    filled = least.copy()
    for step in range(1, SLOTS):
        empty = filled == none
        if not empty.any():
            break
        other = np.roll(least, -step, axis=1)
        filled = np.where(empty & (other != none), mixed(other + ODD[0] * np.full(1, step, dtype=np.uint64)), filled)
    short = (filled % U(65_535) + U(1)).astype(np.uint16)
    short[(least == none).all(axis=1)] = 0
    return short


def written(sketch: np.ndarray) -> list[str]:
    """Fingerprints as text: 4 hex digits a slot."""
    return [row.astype(">u2").tobytes().hex() for row in sketch]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal slots of fingerprints, which estimates the share of common phrases."""
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """(keys, fingerprint) of every whole text.

    A text is parsed level by level: runs of one symbol are joined, deterministic coin tossing
    marks where phrases begin by looking at a few symbols around, and a phrase is named by a hash
    of its symbols, so a substring gets the same names inside wherever it stands. Texts are
    compared by the names of levels 3 to 6 (about 35 to 1000 characters).

    Equal texts have equal fingerprints. Null and empty texts have the fingerprint of zeros.
    Repeated rows and null keys give one row each; an empty table gives an empty one; other
    columns are ignored. Memory follows the longest text. No row is shuffled.
    """
    schema = T.StructType([T.StructField("fingerprint", T.StringType())])
    return map_texts(docs, keys or ["doc_id"],
                     lambda: lambda texts: {"fingerprint": written(sketches([t or "" for t in texts]))}, schema, text)


def in_bands(docs: DataFrame, doc_id: str, text: str, bands: int, band_rows: int) -> tuple[DataFrame, int]:
    """(doc_id, text, band, head) and the number of bands: the rows dealt over bands of falling ids.

    ``bands`` ranges with about as many rows each, cut evenly by id into pieces of about
    ``band_rows`` rows (1024 pieces at most). The first row of a band is also the next one of the
    last row of the band before; that band gets it again, as ``head``.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shares = [i / bands for i in range(1, bands)]
    found = rows.agg(F.percentile_approx("doc_id", shares or [0.5], 10_000), F.min("doc_id"), F.max("doc_id"),
                     F.count(F.lit(1))).first()
    least, most = found[1] or 0, found[2] or 0
    bounds = sorted(set(found[0] or []) - {least}) if shares else []
    pieces = min(1024, max(1, -(-found[3] // (band_rows * (len(bounds) + 1)))))
    ends = F.array(*[F.lit(float(b)) for b in (least, *bounds, most + 1)])
    at = F.size(F.filter(F.array(*[F.lit(b) for b in (least, *bounds)]), lambda b: b <= F.col("doc_id")))
    low, high = F.get(ends, at - 1), F.get(ends, at)
    piece = F.least(F.floor((F.col("doc_id") - low) / (high - low) * pieces), F.lit(pieces - 1))
    # 0 has the largest ids; rows without an id come last.
    whole = (len(bounds) + 1) * pieces
    place = F.when(F.col("doc_id").isNull(), F.lit(whole)).otherwise(whole - 1 - ((at - 1) * pieces + piece)).cast("int")
    rows = rows.withColumn("band", place)
    tops = rows.groupBy("band").agg(F.max("doc_id").alias("top"))  # as many rows as bands
    order = Window.orderBy("band")
    to = F.coalesce(F.lag("band").over(order), F.max("band").over(Window.partitionBy()))
    heads = tops.select(F.col("band").alias("__band"), F.col("top").alias("__top"), to.alias("to"))
    joined = rows.join(F.broadcast(heads), (rows["band"] == heads["__band"]) & rows["doc_id"].eqNullSafe(heads["__top"]), "left")
    copies = F.when(F.col("to").isNull(), F.array(F.struct("band", F.lit(False).alias("head")))).otherwise(
        F.array(F.struct("band", F.lit(False).alias("head")), F.struct(F.col("to").alias("band"), F.lit(True).alias("head"))))
    dealt = joined.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.band", "c.head")
    return dealt, whole


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
])


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = 64, band_rows: int = 4096) -> DataFrame:
    """Fingerprints of every text, of the text with its second half replaced, and of the next one.

    In order of falling ids (equal ids by text; rows without an id last, by text), the last
    floor(n_chars / 2) code points of a text are replaced by the first as many of the next text,
    or all of it; the last text is followed by the first. Rows are dealt over ranges of ids, as
    many as the table needs, and sorted in them, so each text is shuffled once and a task reads
    rows in order, holding one batch and one text. Only the first text of a band goes to two.

    A null text is an empty one. A single row is its own next one. An empty table gives an empty
    one. Other columns are ignored.
    """
    rows, number = in_bands(docs, doc_id, text, bands, band_rows)
    dealt = rows.repartition(number, "band").sortWithinPartitions(
        F.col("band"), F.col("head"), F.col("doc_id").desc_nulls_last(), F.col("text"))
    arrow_out = pa.schema([(f.name, arrow_type(f.dataType)) for f in RESULT.fields])

    def compared(ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, after)]
        own, new = sketches([*texts, after[-1]]), sketches(edited)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array(written(own[:-1])), pa.array(written(new)),
            pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:])),
        ], schema=arrow_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (band, id, text) of the row whose next one is still to come
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for a, b in parts(columns[1], 300_000):
                ids, texts, after = [], [], []
                for row_id, t, band, head in zip(*(c[a:b] for c in columns)):
                    if last is not None and last[0] == band:
                        ids.append(last[1])
                        texts.append(last[2])
                        after.append(t)
                    last = None if head else (band, row_id, t)
                if ids:
                    yield compared(ids, texts, after)

    return dealt.mapInArrow(run, RESULT)
