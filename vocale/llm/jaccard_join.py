"""Similar documents by their word shingles: size-banded tiles, bitmap signatures, exact intersections."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocale.llm.common import broadcast_if, connected_components, parts, saved

WORDS = 5
#: A pair links when NEED[0] * intersection >= NEED[1] * union.
NEED = (100, 75)
BITS = 1024
U = np.uint64
ODD = tuple(U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * ODD[1]
    x = (x ^ (x >> U(27))) * ODD[2]
    return x ^ (x >> U(31))


@functools.cache
def factors() -> np.ndarray:
    return mixed(ODD[0] * np.arange(1, 4097, dtype=np.uint64)) | U(1)


@functools.cache
def byte_names() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * ODD[2])


def shingle_sets(texts: list) -> list[np.ndarray]:
    """The sorted 63-bit hashes of each text's distinct 5-word shingles; a text of fewer words has
    its whole sequence as one, a text without words none. Words are ``[^\\x20\\x09-\\x0D]+`` with
    A-Z in lower case."""
    joined = "".join((t or "") + "\n" for t in texts).encode("utf-8", "surrogatepass").lower()
    data = np.frombuffer(joined, dtype=np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [np.array([], dtype=np.int64) for _ in texts]
    letters = data[inside]
    lengths = ends - starts
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(heads, lengths)
    names = mixed(np.add.reduceat(byte_names()[letters] * factors()[place & 4095], heads) + lengths.astype(np.uint64))
    ahead = np.cumsum([0, *[len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts]])
    first = np.searchsorted(starts, ahead)  # number of each text's first word
    if len(names) >= WORDS:
        windows = sum(names[i : len(names) - WORDS + 1 + i] * factors()[i] for i in range(WORDS))
        windows = (mixed(windows) >> U(1)).astype(np.int64)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= WORDS:
            out.append(np.unique(windows[a : b - WORDS + 1]))
        elif b > a:
            short = (names[a:b] * factors()[: b - a]).sum(keepdims=True) + factors()[b - a + 100 : b - a + 101]
            out.append((mixed(short) >> U(1)).astype(np.int64))
        else:
            out.append(np.array([], dtype=np.int64))
    return out


def set_name(shingles: np.ndarray) -> int:
    """A 64-bit name of a set of shingles."""
    if not len(shingles):
        return 0
    total = mixed(shingles.astype(np.uint64) + ODD[0]).sum(keepdims=True)
    return int(mixed(total + np.array([len(shingles)], dtype=np.uint64) * ODD[1]).astype(np.int64)[0])


def prefix_size(n):
    """Two sets of which one has n shingles and which link share one of any ``prefix_size(n)``
    shingles of it, as at least 3/4 of it are common."""
    return n - (NEED[1] * n + NEED[0] - 1) // NEED[0] + 1


def signatures(sets: list[np.ndarray]) -> list[bytes]:
    """A bitmap per set as in ``bitmaps``, with a bit per shingle or up to two (a power of two, 128
    at least), so that sets of any size can be told apart. A longer bitmap folds to a shorter one:
    its halves, one over the other."""
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets])
    bits = np.array([max(128, 1 << (int(n) - 1).bit_length()) if n else 0 for n in sizes], dtype=np.int64)
    ends = np.cumsum(bits)
    place = (mixed(np.concatenate(sets).astype(np.uint64)) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place + np.repeat(ends - bits, sizes), minlength=int(ends[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[(e - b) // 8 : e // 8] for b, e in zip(bits, ends)]


SET = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("m", T.LongType()),
    T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("sign", T.BinaryType()),
])


def describe(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, n, sid, m, tokens, sign) per row: the set's size and name, its lowest shingles, all
    ``m`` below ``limit`` and more if the prefix needs them, and its signature. A task gives the
    shingles and the signature of a set once (it remembers the last 100,000 sets), so copies do not
    repeat them."""
    key = docs.schema["doc_id"]
    names = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("m", pa.int64()),
                       ("tokens", pa.list_(pa.int64())), ("sign", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in parts(texts, 400_000):
                sizes, sids, below, chosen, whole = [], [], [], [], []
                for row_id, s in zip(ids[a:b], shingle_sets(texts[a:b])):
                    sid, m = set_name(s), int(np.searchsorted(s, limit))
                    sizes.append(len(s))
                    sids.append(sid)
                    below.append(m)
                    new = len(s) and row_id is not None and sid not in seen
                    chosen.append(s[: max(m, prefix_size(len(s)))] if new else s[:0])
                    whole.append(s if new else s[:0])
                    if new:
                        if len(seen) >= 100_000:
                            seen.clear()
                        seen.add(sid)
                ends = np.cumsum([0, *map(len, chosen)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(chosen)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()),
                     pa.array(below, pa.int64()), lists, pa.array(signatures(whole), pa.binary())], schema=names)

    return docs.mapInArrow(run, T.StructType([key, *SET.fields]))


def frequent(sets: DataFrame, share: float) -> np.ndarray:
    """Shingles in more than about ``share`` of the sets, of which there are few: whatever has that
    share of all sets has it in some batch. A batch passes on the shingles with half of that
    share (32 at least) and Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            token, count = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_counts=True)
            many = count >= max(32, share / 2 * len(lists))
            yield pa.RecordBatch.from_pydict({"token": pa.array(token[many], pa.int64()), "n": pa.array(count[many], pa.int64())})

    total = sets.count()
    counts = sets.select("tokens").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= max(64, share / 2 * total)).select("token").collect()
    return np.array(sorted(r["token"] for r in rows), dtype=np.int64)


def shared_tokens(sets: DataFrame, hot: np.ndarray, cap: int) -> DataFrame:
    """(sid, token, df) of the shingles found in several sets, with the number of sets (``cap`` at
    most). Shingles are shuffled to be sorted and a task reads them in order, holding ``cap`` rows
    at most. The frequent ones in ``hot`` are not shuffled: their number is ``cap``."""

    def is_hot(tokens: np.ndarray) -> np.ndarray:
        return hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens if len(hot) else np.zeros(len(tokens), bool)

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, lists = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1)
            sids = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({"sid": sids, "token": tokens, "hot": is_hot(tokens)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(sids, tokens, df):
            return pa.RecordBatch.from_pydict({"sid": pa.array(sids, pa.int64()), "token": pa.array(tokens, pa.int64()), "df": pa.array(df, pa.int64())})

        held_s, held_t = np.array([], dtype=np.int64), np.array([], dtype=np.int64)
        over = None  # a shingle with more than ``cap`` sets, all of whose rows are passed on
        for batch in batches:
            sids = np.concatenate([held_s, batch.column(0).to_numpy()])
            tokens = np.concatenate([held_t, batch.column(1).to_numpy()])
            new = np.ones(len(sids), dtype=bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (sids[1:] != sids[:-1])
            sids, tokens = sids[new], tokens[new]
            if over is not None:
                n = int(np.searchsorted(tokens, over, side="right"))
                if n:
                    yield out(sids[:n], tokens[:n], np.full(n, cap))
                    sids, tokens = sids[n:], tokens[n:]
                if len(tokens):
                    over = None
            if not len(tokens):
                held_s, held_t = sids, tokens
                continue
            whole = int(np.searchsorted(tokens, tokens[-1]))  # the last shingle may go on
            heads = np.flatnonzero(np.diff(tokens[:whole], prepend=-1))
            sizes = np.diff(heads, append=whole)
            df = np.repeat(sizes, sizes)
            many = df > 1
            if many.any():
                yield out(sids[:whole][many], tokens[:whole][many], np.minimum(df[many], cap))
            held_s, held_t = sids[whole:], tokens[whole:]
            if len(held_s) > cap:
                over = int(held_t[0])
                yield out(held_s, held_t, np.full(len(held_s), cap))
                # The last row stays to tell a repeated row from a new one; it comes out again.
                held_s, held_t = held_s[-1:], held_t[-1:]
        if over is None and len(held_s) > 1:
            yield out(held_s, held_t, np.full(len(held_s), len(held_s)))

    each = sets.select("sid", "tokens").mapInArrow(divide, "sid long, token long, hot boolean")
    cold = each.filter("NOT hot").select("sid", "token").repartition("token").sortWithinPartitions("token", "sid")
    warm = each.filter("hot").select("sid", "token", F.lit(cap).cast("long").alias("df"))
    return cold.mapInArrow(count, "sid long, token long, df long").union(warm)


def prefixes(sets: DataFrame, shared: DataFrame, limit: int) -> DataFrame:
    """(sid, token): the shared shingles among the ``prefix_size(n)`` rarest of each set. The order
    is the same for all sets: shingles below ``limit`` by their number of sets, then the others.
    Those below it that no other set has come first; a set with enough of them is out."""
    sizes = sets.groupBy("sid").agg(F.first("n").alias("n"), F.first("m").alias("m"))
    low = F.filter("found", lambda x: x["token"] < limit)
    high = F.filter("found", lambda x: x["token"] >= limit)
    listed = shared.groupBy("sid").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("found"))
    need = F.col("n") - F.ceil(F.col("n") * NEED[1] / NEED[0]) + 1
    room = F.greatest(need - (F.col("m") - F.size("low")), F.lit(0)).cast("int")
    chosen = listed.join(sizes, "sid").select("sid", "n", "m", low.alias("low"), high.alias("high")).select(
        "sid", F.explode(F.concat(F.slice("low", F.lit(1), room), "high")).alias("x"))
    return chosen.select("sid", F.col("x.token").alias("token"))


#: What a set adds to the weight of a tile beside its shingles, so that a tile of short sets is bounded too.
SET_WEIGHT = 500


GROUP = ["kind", "group"]


def heavy(members: DataFrame, weight: int, rows_limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows of groups that weigh up to ``weight``, rows of larger ones with the group's ``total``).
    Larger groups are few, as each has that weight: they are broadcast up to ``rows_limit``."""
    totals = members.groupBy(*GROUP).agg(F.sum(F.col("n") + SET_WEIGHT).alias("total")).filter(F.col("total") > weight)
    totals = broadcast_if(saved(totals, "large-groups"), rows_limit)
    marked = members.join(totals, GROUP, "left")
    return marked.filter("total IS NULL").drop("total"), marked.filter("total IS NOT NULL")


def loosened(members: DataFrame, rare: DataFrame, weight: int, rows_limit: int) -> DataFrame:
    """``members`` (kind, group, n, sid), with large groups that are chains rather than copies taken
    apart: linked sets have a rare shingle of both in common, so each such shingle is a group
    (kind 1) of the sets that have it. That is done where it makes fewer copies of the sets than
    blocks would, which grow with the square of the group."""
    small, large = heavy(members, weight, rows_limit)
    large = saved(large, "large-members")
    if not large.count():
        return members
    posts = saved(large.join(rare, "sid"), "postings")
    lists = posts.groupBy(*GROUP, "token").agg(F.sum(F.col("n") + SET_WEIGHT).alias("w"), F.count(F.lit(1)).alias("k"))
    lists = saved(lists.filter("k > 1"), "posting-lists")
    cost = lists.groupBy(*GROUP).agg(F.sum(F.col("w") * F.ceil(F.col("w") / weight)).alias("cost"))
    totals = large.select(*GROUP, "total").distinct()
    chains = totals.join(cost, GROUP, "left").filter(F.coalesce("cost", F.lit(0)) < F.col("total") * F.ceil(F.col("total") / weight))
    chains = broadcast_if(saved(chains.select(*GROUP), "chains"), rows_limit)
    apart = posts.join(chains, GROUP, "left_semi").join(lists.select(*GROUP, "token"), [*GROUP, "token"], "left_semi")
    whole = large.join(chains, GROUP, "left_anti").drop("total")
    return small.select(*GROUP, "n", "sid").unionByName(whole.select(*GROUP, "n", "sid")).unionByName(
        apart.select(F.lit(1).alias("kind"), F.col("token").alias("group"), "n", "sid"))


def tiles(members: DataFrame, weight: int, rows_limit: int) -> DataFrame:
    """(cell, two, side, sid): the sets of groups (kind, group, n, sid), dealt to tiles.

    A set weighs its shingles and ``SET_WEIGHT`` more. A group of up to ``weight`` is one tile. A
    larger one is cut into bands of sizes, each 4/3 times the one before, and bands into blocks of
    about ``weight``, which is 4,000 sets at most for 2,000,000; a tile is a
    pair of blocks of the same or of neighbouring bands, as sets that link differ in size by no
    more than that. Members of a tile know their block, so that a pair is looked at in one tile.
    Only ids and sizes are dealt; shingles join their cells afterwards.
    """
    small, large = heavy(members, weight, rows_limit)
    alone = small.select(
        F.struct(*GROUP, F.lit(0).cast("long").alias("b"), F.lit(0).alias("i"), F.lit(0).alias("up"), F.lit(0).alias("j")).alias("cell"),
        F.lit(0).alias("side"), "sid")
    large = large.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(4.0 / 3)) + 1e-9))
    band = [*GROUP, "band"]
    blocks = saved(large.groupBy(*band).agg(F.ceil(F.sum(F.col("n") + SET_WEIGHT) / weight).cast("int").alias("k")), "blocks")
    above = blocks.select(*GROUP, (F.col("band") - 1).alias("band"), F.col("k").alias("k_up"))
    below = blocks.select(*GROUP, (F.col("band") + 1).alias("band"), F.col("k").alias("k_down"))
    counted = blocks.join(above, band, "left").join(below, band, "left")
    placed = large.join(broadcast_if(counted, rows_limit), band).withColumn("i", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int"))

    def upto(k):
        return F.sequence(F.lit(0), F.greatest(F.coalesce(F.col(k), F.lit(0)), F.lit(1)) - 1)

    def cell(b, i, up, j):
        return F.struct(*GROUP, b.alias("b"), i.alias("i"), F.lit(up).alias("up"), j.alias("j")).alias("cell")

    own = F.transform(upto("k"), lambda j: F.struct(
        cell(F.col("band"), F.least("i", j), 0, F.greatest("i", j)), F.when(F.col("i") <= j, 0).otherwise(1).alias("side")))
    up = F.when(F.col("k_up") > 0, F.transform(upto("k_up"), lambda j: F.struct(
        cell(F.col("band"), F.col("i"), 1, j), F.lit(0).alias("side")))).otherwise(F.array())
    down = F.when(F.col("k_down") > 0, F.transform(upto("k_down"), lambda j: F.struct(
        cell(F.col("band") - 1, j, 1, F.col("i")), F.lit(1).alias("side")))).otherwise(F.array())
    dealt = placed.select("sid", F.explode(F.concat(own, up, down)).alias("x")).select("x.cell", "x.side", "sid")
    return alone.union(dealt).select(
        F.xxhash64("cell.kind", "cell.group", "cell.b", "cell.i", "cell.up", "cell.j").alias("cell"),
        ((F.col("cell.up") == 1) | (F.col("cell.i") != F.col("cell.j"))).alias("two"), "side", "sid")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """``BITS`` bits per set: the parity of the number of shingles hashed to each. A shingle that
    one of two sets has and the other has not flips one bit, so the number of different bits is at
    most the number of such shingles."""
    out = np.zeros((len(sets), BITS // 64), dtype=np.uint64)
    for a in range(0, len(sets), 512):
        some = sets[a : a + 512]
        owner = np.repeat(np.arange(len(some)), [len(s) for s in some])
        place = (mixed(np.concatenate(some).astype(np.uint64)) % U(BITS)).astype(np.int64)
        odd = np.bincount(owner * BITS + place, minlength=len(some) * BITS).reshape(len(some), BITS) & 1
        out[a : a + 512] = np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)
    return out


def linked(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``, which rise in size; with ``side``, only of
    links between the two sides. Pairs that are connected already are not looked at; bit counts
    rule out most others, and the rest are intersected exactly."""
    c = len(sets)
    sizes = np.array([len(s) for s in sets])
    maps = bitmaps(sets)
    root = np.arange(c)
    found = []
    last = np.searchsorted(sizes, sizes * NEED[0] // NEED[1], side="right")
    for i in range(c):
        j = np.arange(i + 1, last[i])
        j = j[root[j] != root[i]]
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        differ = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
        # 100 * common >= 75 * (all - common), where common <= (all - differ) / 2
        both = sizes[j] + sizes[i]
        j = j[(NEED[0] + NEED[1]) * (both - differ) >= 2 * NEED[1] * both]
        if not len(j):
            continue
        own = sets[i]
        rest = np.concatenate([sets[k] for k in j])
        hit = own[np.minimum(np.searchsorted(own, rest), len(own) - 1)] == rest
        heads = np.concatenate([[0], np.cumsum(sizes[j])[:-1]])
        common = np.add.reduceat(hit.astype(np.int64), heads)
        for k in j[NEED[0] * common >= NEED[1] * (sizes[j] + sizes[i] - common)]:
            if root[k] != root[i]:
                found.append((i, int(k)))
                root[root == root[k]] = root[i]
    return found


def alike(signs: list[bytes], sizes: list[int], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """As ``linked``, of the pairs that may be links by the bit counts of their signatures: whatever
    is linked is connected here too. Sets that link differ in size by a third at most, so their
    bitmaps are equally long or one is twice the other."""
    sizes = np.array(sizes)
    words = np.array([len(s) // 8 for s in signs])
    own, half = {}, {}
    starts = {int(w): int(np.searchsorted(words, w)) for w in np.unique(words)}
    for w in starts:
        own[w] = np.frombuffer(b"".join(s for s in signs if len(s) == 8 * w), dtype=np.uint64).reshape(-1, w)
        half[w // 2] = own[w][:, : w // 2] ^ own[w][:, w // 2 :]
    root = np.arange(len(signs))
    found = []
    last = np.searchsorted(sizes, sizes * NEED[0] // NEED[1], side="right")
    for i in range(len(signs)):
        j = np.arange(i + 1, last[i])
        j = j[root[j] != root[i]]
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        w = int(words[i])
        mine = own[w][i - starts[w]]
        same = j[words[j] == w]
        rows = [own[w][same - starts[w]]]
        if len(same) < len(j):
            rows.append(half[w][j[len(same) :] - starts[2 * w]])
        differ = np.concatenate([np.bitwise_count(r ^ mine).sum(axis=1, dtype=np.int64) for r in rows])
        both = sizes[j] + sizes[i]
        for k in j[(NEED[0] + NEED[1]) * (both - differ) >= 2 * NEED[1] * both]:
            if root[k] != root[i]:
                found.append((i, int(k)))
                root[root == root[k]] = root[i]
    return found


def tile_links(cells: DataFrame, signed: bool = False) -> DataFrame:
    """(u, v): links that connect, tile by tile, all that the tile's links connect; with ``signed``,
    pairs that may be links, from the signatures that ``cells`` then has in place of the shingles."""
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "n", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, two, side, sids, sizes, sets = None, False, [], [], [], []

        def flush():
            if len(sids) < 2:
                return None
            sides = np.array(side) if two else None
            pairs = alike(sets, sizes, sides) if signed else linked(sets, sides)
            return pa.RecordBatch.from_pydict({"u": pa.array([sids[i] for i, _ in pairs], pa.int64()),
                                               "v": pa.array([sids[k] for _, k in pairs], pa.int64())})

        for batch in batches:
            keys, twos, sides, ns, names = (batch.column(i).to_pylist() for i in range(5))
            lists = batch.column(5)
            if signed:
                given = lists.to_pylist()
            else:
                values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
            for r, key in enumerate(keys):
                if key != cell:
                    if (made := flush()) is not None and made.num_rows:
                        yield made
                    cell, two, side, sids, sizes, sets = key, twos[r], [], [], [], []
                if sids and sids[-1] == names[r]:
                    continue
                side.append(sides[r])
                sids.append(names[r])
                sizes.append(ns[r])
                sets.append(given[r] if signed else values[ends[r] : ends[r + 1]].copy())
        if (made := flush()) is not None and made.num_rows:
            yield made

    return dealt.mapInArrow(run, "u long, v long")


def alike_groups(listed: DataFrame, members: DataFrame, cells: DataFrame, rows_limit: int) -> DataFrame:
    """(node, component) of the sets in ``cells`` that may link with another by their signatures. A
    signature is about a fiftieth of its set, so a set may go to many cells."""
    wanted = broadcast_if(members.select("sid"), rows_limit)
    signs = listed.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("sign").alias("sign"))
    signed = cells.join(signs, "sid").select("cell", "two", "side", "n", "sid", "sign")
    return connected_components(tile_links(signed, signed=True), "alike")


def full_sets(docs: DataFrame, members: DataFrame, cells: DataFrame, rows_limit: int) -> DataFrame:
    """(cell, two, side, n, sid, shingles) of the candidate sets, read again from one document of
    each. The cells of a set go to its document, by broadcast if there are ``rows_limit`` at most,
    so shingles are shuffled once, to their cells."""
    places = cells.groupBy("sid").agg(F.collect_list(F.struct("cell", "two", "side")).alias("places"))
    places = saved(members.select("doc_id", F.col("sid").alias("wanted")).join(places, F.col("wanted") == F.col("sid")).drop("sid"), "places")
    texts = docs.join(F.broadcast(places) if cells.count() <= rows_limit else places, "doc_id").select("text", "wanted", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in parts(texts, 400_000):
                sets = shingle_sets(texts[a:b])
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_name(s) for s in sets], pa.int64()), lists, *(batch.column(i).slice(a, b - a) for i in (1, 2))],
                    names=["sid", "shingles", "wanted", "places"])

    found = texts.mapInArrow(
        run, "sid long, shingles array<long>, wanted long, places array<struct<cell:long,two:boolean,side:int>>")
    # Another text under the same id is not the one that was meant.
    return found.filter("sid = wanted").select("sid", "shingles", F.explode("places").alias("x")).select(
        "x.cell", "x.two", "x.side", F.size("shingles").alias("n"), "sid", "shingles")


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", low_share: float = 0.35,
    frequent_share: float = 0.002, cap: int = 65_536, weight: int = 2_000_000, rows_limit: int = 1_000_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id): the class of every document under links of similarity
    0.75 or more, and the size of its set of 5-word shingles.

    1. Texts become sets; equal sets are one from here on. Each set gives its lowest hashes: all
       in the lowest ``low_share`` of the hash range.
    2. Shingles are counted over all sets. By the prefix filter, linked sets share one of the
       rarest quarter of their shingles; sets whose quarter is their own alone are done.
    3. Sets that share a rare shingle form candidate groups (connected components).
    4. Groups are dealt to size-banded tiles of about ``weight`` shingles; a large group that is a
       chain is taken apart by shared rare shingle first. In a tile the signatures of the sets, a
       bit or two per shingle, bound the overlap from above; sets that may link form new groups, and
       those that may link with no other are done. So passages that many texts quote, which chain
       most of a large corpus into one group, cost signatures and not sets.
    5. The new groups are dealt to tiles in the same way. Their sets are read again from the text,
       in full; bit counts rule out most pairs and the others are intersected exactly. Each tile
       gives a spanning forest.
    6. Components of these links are the classes; their smallest ids name them.

    The result is exact but for collisions of 63-bit hashes. Frequent shingles (in more than
    about ``frequent_share`` of the sets) are recognised first and never sorted in one task.
    Ids of candidates are broadcast up to ``rows_limit``; beyond that texts are joined by shuffle.

    Null and empty texts, and texts without words, have 0 shingles and are their own class. Rows
    without an id have no class (null) and link with nothing; rows that share an id are one node
    but each has its own row. An empty table gives an empty one. Other columns are ignored.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    limit = int(low_share * 2**63)
    sets = saved(describe(plain, limit), "sets")
    named_sets = sets.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    listed = sets.filter(F.size("tokens") > 0)
    shared = shared_tokens(listed, frequent(listed, frequent_share), cap)
    rare = saved(prefixes(listed.select("sid", "n", "m"), shared, limit), "prefixes")
    leaders = rare.groupBy("token").agg(F.min("sid").alias("leader"))
    groups = connected_components(rare.join(leaders, "token").select(
        F.col("sid").alias("u"), F.col("leader").alias("v")).filter("u != v").distinct(), "groups")
    first = named_sets.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    members = saved(first.join(groups.withColumnRenamed("node", "sid"), "sid").withColumnRenamed("component", "group"), "members")

    def dealt(some: DataFrame) -> DataFrame:
        grouped = some.select(F.lit(0).alias("kind"), "group", "n", "sid")
        return saved(tiles(loosened(grouped, rare, weight, rows_limit), weight, rows_limit), "cells")

    closer = alike_groups(listed, members, dealt(members), rows_limit)
    members = saved(members.drop("group").join(closer.withColumnRenamed("node", "sid"), "sid").withColumnRenamed("component", "group"), "members")
    links = tile_links(full_sets(plain, members, dealt(members), rows_limit))
    same_id = named_sets.groupBy("doc_id").agg(F.min("sid").alias("v"), F.count_distinct("sid").alias("k")).filter("k > 1")
    same_id = named_sets.join(same_id, "doc_id").filter("sid != v").select(F.col("sid").alias("u"), "v")
    classes = connected_components(links.union(same_id), "links")
    named = sets.select("doc_id", "n", "sid").join(classes.withColumnRenamed("node", "sid"), "sid", "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "sid")).alias("class"))
    # Saved, so that a class with very many documents is joined from plain rows, which Spark splits.
    tops = saved(named.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("component_id")), "tops")
    return named.join(tops, "class", "left").select(
        F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
