"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocale.llm.common import connected_components, fit_in_task, saved

LEADING = 6
KEY = ["label", "h1", "h2"]


def principal_axes(vectors: DataFrame, column: str, bound: int) -> dict[int, np.ndarray]:
    """For each vector length the leading principal axes (columns), fitted in one task on about
    ``bound`` vectors chosen by hash. They decide on order and speed, never on results."""
    n = vectors.count()
    share = 1 << 20
    some = vectors.select("h1", "h2", column)
    if n > bound:
        some = some.filter(F.pmod("h2", F.lit(share)) < int(share * bound / n))

    def fit(columns: list) -> bytes:
        by_length: dict[int, list] = {}
        for v in columns[2].to_pylist():
            by_length.setdefault(len(v), []).append(v)
        out = io.BytesIO()
        axes = {}
        for length, rows in by_length.items():
            x = np.array(rows, dtype=np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            x -= x.mean(axis=0)
            values, basis = np.linalg.eigh(x.T @ x)
            axes[str(length)] = basis[:, np.argsort(-values)[:LEADING]]
        np.savez(out, **axes)
        return out.getvalue()

    made = fit_in_task(some, fit)
    loaded = np.load(io.BytesIO(made)) if made else {}
    return {int(k): loaded[k] for k in loaded}


def box_gap(low_a, high_a, low_b, high_b) -> float:
    """The squared distance between two boxes."""
    gap = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
    return float((gap * gap).sum())


def interval_links(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, same: bool, least: float, reach: float):
    """Pairs (i, j) with a cosine of at least ``least`` between two sequences of unit vectors in
    grid order, in arrays. Intervals whose boxes of leading coordinates lie further apart than
    ``reach`` are skipped; others are halved until they are short enough for a product."""
    found_i, found_j = [], []

    def join(a0: int, a1: int, b0: int, b1: int) -> None:
        if same and b1 <= a0:
            return
        if box_gap(pa_[a0:a1].min(0), pa_[a0:a1].max(0), pb[b0:b1].min(0), pb[b0:b1].max(0)) > reach * reach:
            return
        if max(a1 - a0, b1 - b0) <= 128:
            i, j = np.nonzero(a[a0:a1] @ b[b0:b1].T >= least)
            i, j = i + a0, j + b0
            if same:
                i, j = i[i < j], j[i < j]
            found_i.append(i)
            found_j.append(j)
        elif a1 - a0 >= b1 - b0:
            middle = (a0 + a1) // 2
            join(a0, middle, b0, b1)
            join(middle, a1, b0, b1)
        else:
            middle = (b0 + b1) // 2
            join(a0, a1, b0, middle)
            join(a0, a1, middle, b1)

    join(0, len(a), 0, len(b))
    none = np.array([], dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (i, j) connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


BLOCK = "block long, label int, size int, low array<double>, high array<double>, ids array<long>, copies array<long>, data binary"


def blocks_of(vectors: DataFrame, axes: dict[int, np.ndarray], width: float, rows: int) -> DataFrame:
    """Rows in epsilon grid order (label, length, cells of the leading coordinates), cut into
    blocks of at most ``rows`` with the box that holds them. Spark sorts by range, so a label
    with many vectors spans many tasks."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3).to_pylist()
            unit, cells = [], []
            for v in lists:
                x = np.array(v, dtype=np.float64)
                x /= np.sqrt(x @ x)
                basis = axes.get(len(x))
                p = x @ basis if basis is not None else x[:LEADING]
                p = np.concatenate([p, np.zeros(LEADING - len(p))])
                unit.append(x.tobytes())
                cells.append([len(x), *np.floor(p / width).astype(int).tolist(), *p.tolist()])
            c = np.array(cells)
            out = {"label": batch.column(0), "id": batch.column(1), "copies": batch.column(2), "data": pa.array(unit, pa.binary())}
            out |= {f"c{k}": pa.array(c[:, k].astype(np.int64)) for k in range(LEADING + 1)}
            out["p"] = pa.array(c[:, LEADING + 1 :].tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(out)

    order = ["label", *[f"c{k}" for k in range(LEADING + 1)], "id"]
    schema = "label int, id long, copies long, data binary, " + ", ".join(f"c{k} long" for k in range(LEADING + 1)) + ", p array<double>"
    sequence = vectors.select("label", "id", "copies", "v").mapInArrow(project, schema)
    sequence = saved(sequence, "vectors").repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def block():
            p = np.array([r[4] for r in held])
            return pa.RecordBatch.from_pydict({
                "block": pa.array([held[0][1]], pa.int64()), "label": pa.array([held[0][0]], pa.int32()),
                "size": pa.array([key[1]], pa.int32()), "low": [p.min(0).tolist()], "high": [p.max(0).tolist()],
                "ids": pa.array([[r[1] for r in held]], pa.list_(pa.int64())),
                "copies": pa.array([[r[2] for r in held]], pa.list_(pa.int64())),
                "data": pa.array([b"".join([np.array([r[4] for r in held]).tobytes(), *[r[3] for r in held]])], pa.binary()),
            })

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4 + LEADING + 1, 4)]
            for row in zip(*columns):
                if held and ((row[0], row[5]) != key or len(held) >= rows):
                    yield block()
                    held = []
                key = (row[0], row[5])
                held.append(row)
        if held:
            yield block()

    return sequence.mapInArrow(cut, BLOCK)


def block_pairs(boxes: DataFrame, width: float) -> DataFrame:
    """(a, b), a <= b, of blocks of one label and length whose boxes are at most ``width`` apart:
    blocks meet in the cells of the first coordinate that they touch, one cell wider on one side."""
    cell = lambda c, more=0: F.floor(F.get(c, F.lit(0)) / width).cast("long") + more
    left = boxes.select("label", "size", F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"),
                        F.explode(F.sequence(cell("low", -1), cell("high", 1))).alias("cell"))
    right = boxes.select("label", "size", F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"),
                         F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    gap = F.lit(0.0)
    for k in range(LEADING):
        one = F.greatest(F.lit(0.0), F.get("low_a", F.lit(k)) - F.get("high_b", F.lit(k)), F.get("low_b", F.lit(k)) - F.get("high_a", F.lit(k)))
        gap = gap + one * one
    near = left.join(right, ["label", "size", "cell"]).filter(F.col("a") <= F.col("b")).filter(gap <= width * width + 1e-9)
    return near.select("a", "b").distinct()


def near_duplicates(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    least: float = 0.98, rows: int = 1024, sample: int = 10_000,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of one label with a cosine of ``least`` or more
    are linked; n_links counts the others linked directly, component_id is the smallest vec_id
    reachable, kept tells whether that is the vector itself.

    Equal vectors of a label become one with a number of copies. Unit vectors are put in epsilon
    grid order: by label, then by the cells of their leading principal coordinates, whose width is
    the distance that ``least`` allows. Blocks of that sequence are joined when their boxes are
    near enough; inside a pair of blocks intervals are halved and skipped when provably distant,
    and what is left is compared in double precision. A pair of blocks gives the number of links
    of each vector and a spanning forest, never the links themselves.

    Vectors that are null, empty, zero or hold null or non-finite components, rows with a null
    label and rows without an id link with nothing: 0 links, their own component. Vectors of
    different lengths are not compared. Rows that share an id are vectors of
    their own; their components are joined only by links. An empty table gives an empty one. Other columns are ignored.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows_in = table.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("int").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    marked = rows_in.withColumn("good", F.coalesce(good, F.lit(False)))
    # Adding zero turns -0.0 into 0.0, so that equal vectors have equal hashes.
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    keyed = marked.select("id", "label", "good", F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(1), plain).alias("h2"), "v")
    kinds = saved(keyed.filter("good").groupBy(*KEY).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "kinds")

    width = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    axes = principal_axes(kinds, "v", sample)
    blocks = saved(blocks_of(kinds, axes, width, rows), "blocks")
    pairs = block_pairs(blocks.select("block", "label", "size", "low", "high"), width)
    side = lambda x: blocks.select(F.col("block").alias(x), "size", F.struct("ids", "copies", "data").alias(f"rows_{x}"))
    work = pairs.join(side("a"), "a").join(side("b").drop("size"), "b").select(
        "size", (F.col("a") == F.col("b")).alias("same"), "rows_a.ids", "rows_a.copies", "rows_a.data",
        F.col("rows_b.ids").alias("ids_b"), F.col("rows_b.copies").alias("copies_b"), F.col("rows_b.data").alias("data_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(ids, data, size):
            lead = len(ids) * LEADING * 8
            return (np.frombuffer(data[:lead], dtype=np.float64).reshape(len(ids), LEADING),
                    np.frombuffer(data[lead:], dtype=np.float64).reshape(len(ids), size))

        for batch in batches:
            for r in batch.to_pylist():
                ids_a, ids_b = np.array(r["ids"]), np.array(r["ids_b"])
                p_a, x_a = unpack(ids_a, r["data"], r["size"])
                p_b, x_b = unpack(ids_b, r["data_b"], r["size"])
                i, j = interval_links(x_a, p_a, x_b, p_b, r["same"], least, width)
                if not len(i):
                    continue
                shift = 0 if r["same"] else len(ids_a)
                ids = ids_a if r["same"] else np.concatenate([ids_a, ids_b])
                copies = np.array(r["copies"] if r["same"] else r["copies"] + r["copies_b"], dtype=np.float64)
                j = j + shift
                links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                root = forest(len(ids), i, j)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some].astype(np.int64)),
                    "top": pa.array(ids[root[some]], pa.int64())})

    # A task holds one pair of blocks at a time.
    spread = work.repartition(F.xxhash64("ids", "ids_b"))
    made = saved(spread.mapInArrow(compare, "id long, links long, top long"), "compared")
    linked = kinds.select("id", *KEY, "copies").join(made.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
    per_kind = linked.select(*KEY, F.col("id").alias("node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classes = connected_components(made.filter("id != top").select(F.col("id").alias("u"), F.col("top").alias("v")), "links") \
        .withColumnsRenamed({"node": "cnode", "component": "top"})
    good_key = [F.when(F.col("good"), F.col(k)).alias(k) for k in KEY]
    wide = keyed.select("id", *good_key).join(per_kind, KEY, "left").join(classes, F.col("node") == F.col("cnode"), "left")
    component = F.coalesce("top", "node", "id")
    return wide.select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
