"""A Merkle manifest of a table: a digest per row, source and table, and proofs that are folded from
copied hash states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocale.llm.common import arrow_type, broadcast_if, saved

#: Nodes that one digest stands for, hex letters of a digest, and levels that a task builds at a
#: time: a block of 16 ** 3 consecutive nodes.
FANOUT, HEX, LEVELS = 16, 64, 3
BLOCK = FANOUT**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Parents on the way up: the place of the node among the children, and their digests in one string.
PATH = T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("children", T.StringType())]))


def field(value: Column) -> Column:
    """A value with its length in bytes in front, so that no two rows give the same text; null: -."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


class Parent:
    """A node over up to 16 children. It keeps a copy of the hash state before each child, so a
    replaced child costs its own digest and those to its right, not those to its left."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: bytes):
        self.children, self.states, state = children, [], hashlib.sha256()
        for at in range(0, len(children), HEX):
            self.states.append(state.copy())
            state.update(children[at : at + HEX])
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with ``child`` in place of the child at ``slot``."""
        state = self.states[slot].copy()
        state.update(child + self.children[HEX * (slot + 1) :])
        return state.hexdigest().encode()

    def others(self, slot: int) -> bytes:
        return self.children[: HEX * slot] + self.children[HEX * (slot + 1) :]


def parents_of(digests: list[bytes], levels: int) -> list[list[Parent]]:
    """The parents of consecutive nodes, level by level; runs of 16, the last may be shorter."""
    out = []
    for _ in range(levels):
        out.append([Parent(b"".join(digests[i : i + FANOUT])) for i in range(0, len(digests), FANOUT)])
        digests = [p.digest for p in out[-1]]
    return out


def levels_of(n: int) -> int:
    """Levels that a block of a group of ``n`` nodes is lifted by: until one is left, 3 at most."""
    return next((k for k in range(LEVELS) if FANOUT**k >= n), LEVELS)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each block; rows begin with group and block, and come in that order."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if rows and row[:2] != rows[-1][:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def by_block(rows: DataFrame) -> DataFrame:
    """Blocks of at most 4096 nodes, each whole and in order; a large group is many blocks."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")


BLOCK_OF = f"idx div {BLOCK} AS block"


def lifted(nodes: DataFrame) -> DataFrame:
    """(grp, idx, n, digest) of the blocks of ``nodes`` (grp, idx, n, digest): the digest of each
    block, its number in the group, and how many the group has."""
    def run(batches):
        for rows in blocks(batches):
            grp, block, _, n = rows[0][:4]
            digests = [r[4].encode() for r in rows]
            made = parents_of(digests, levels_of(n))
            top = made[-1][0].digest if made else digests[0]
            yield pa.RecordBatch.from_pylist(
                [{"grp": grp, "idx": block, "n": -(-n // BLOCK), "digest": top.decode()}], schema=out)

    out = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
    keyed = nodes.selectExpr("grp", BLOCK_OF, "idx", "n", "digest")
    return by_block(keyed).mapInArrow(run, "grp string, idx long, n long, digest string")


def ranked(rows: DataFrame, order: list[str], per_task: int = 100_000) -> DataFrame:
    """``rows`` with idx, the place in its group ``grp`` by ``order``, and n, the size of the group.

    Rows are sorted by ranges of group and order, so a group with most of the rows is many tasks;
    the place is that in the range plus the rows of the group in the ranges before. Only counts
    per group and range are joined back. ``rows`` must be saved: it is read twice.
    """
    tasks = max(1, -(-rows.count() // per_task))
    placed = saved(
        rows.repartitionByRange(tasks, "grp", *order).sortWithinPartitions("grp", *order)
        .withColumn("at", F.monotonically_increasing_id()), "placed")
    task = F.shiftright("at", 33).alias("task")
    runs = placed.groupBy("grp", task).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(runs.select(
        F.col("grp").alias("__grp"), F.col("task").alias("__task"),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(whole).alias("n")), "offsets")
    both = placed.join(
        broadcast_if(offsets, 1_000_000), (F.col("grp") == F.col("__grp")) & (task == F.col("__task")))
    return both.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "shift", "__grp", "__task")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (grp, idx, n, digest) and the tables above it, each of blocks of the one below,
    until every group is one node. Each is 4096 times smaller where groups are large."""
    tiers = [nodes]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tiers.append(saved(lifted(tiers[-1]), "nodes"))
    return tiers


def with_paths(nodes: DataFrame, paths: DataFrame, extra: list[str]) -> DataFrame:
    """Blocks of ``nodes``, each with its row of ``paths`` (grp, idx, path) in front."""
    null = {c: nodes.select(c).schema[0].dataType for c in extra}
    rows = nodes.selectExpr("grp", BLOCK_OF, "idx", "n", "digest", f"cast(null AS {PATH.simpleString()}) AS path", *extra)
    heads = paths.select(
        "grp", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("long").alias("n"),
        F.lit(None).cast("string").alias("digest"), "path",
        *[F.lit(None).cast(kind).alias(c) for c, kind in null.items()])
    return by_block(heads.union(rows))


def climbing(rows: list[tuple]) -> Iterator[tuple[tuple, list[tuple[Parent, int]]]]:
    """Each node of a block with the parents and places on its way up through the block."""
    nodes = rows[1:]  # none in an empty table
    made = parents_of([r[4].encode() for r in nodes], levels_of(nodes[0][3] if nodes else 0))
    for at, row in enumerate(nodes):
        yield row, [(parents[at // FANOUT ** (k + 1)], at // FANOUT**k % FANOUT) for k, parents in enumerate(made)]


def lowered(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(grp, idx, path) of ``nodes``: the way up through its block, then that of the block."""
    def run(batches):
        for rows in blocks(batches):
            above = rows[0][5]
            yield pa.RecordBatch.from_pylist([
                {"grp": row[0], "idx": row[2], "path":
                    [{"slot": slot, "children": p.children.decode()} for p, slot in way] + above}
                for row, way in climbing(rows)
            ], schema=out)

    out = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("path", arrow_type(PATH))])
    schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("path", PATH)])
    return with_paths(nodes, paths, []).mapInArrow(run, schema)


def descend(tiers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The paths of the blocks that the lowest table consists of, from those of the groups."""
    for nodes in reversed(tiers[1:-1]):
        paths = saved(lowered(nodes, paths), "paths")
    return paths


PROOFS = [
    ("leaf", T.StringType()), ("subroot", T.StringType()), ("root", T.StringType()), ("slots", T.ArrayType(T.IntegerType())),
    ("sizes", T.ArrayType(T.IntegerType())), ("proof", T.StringType()), ("folded_root", T.StringType()), ("verified", T.BooleanType()),
]


def folded(leaves: DataFrame, paths: DataFrame, top_levels: int) -> DataFrame:
    """Every leaf of ``leaves`` (grp, idx, n, digest, doc_id, offered) folded up to the root; the
    last ``top_levels`` steps are those above the subroots."""
    kind = leaves.schema["doc_id"].dataType

    def fold(rows):
        upper = [(Parent(x["children"].encode()), x["slot"]) for x in rows[0][5]]
        upper_others = b"".join(p.others(slot) for p, slot in upper)
        tops: dict[bytes, list[bytes]] = {}
        for row, way in climbing(rows):
            leaf = row[4].encode()
            ends = []
            for value in (leaf, row[7].encode() if row[7] else leaf):
                for parent, slot in way:
                    value = parent.fold(slot, value)
                if value not in tops:
                    tops[value] = [value]
                    for parent, slot in upper:
                        tops[value].append(parent.fold(slot, tops[value][-1]))
                ends.append(tops[value])
            (original, offered), steps = ends, way + upper
            yield (
                row[6], row[4], original[-1 - top_levels].decode(), original[-1].decode(), [slot for _, slot in steps],
                [len(p.states) for p, _ in steps], (b"".join(p.others(slot) for p, slot in way) + upper_others).decode(),
                offered[-1].decode(), offered[-1] == original[-1],
            )

    def run(batches):
        for rows in blocks(batches):
            done = []
            for row in fold(rows):
                done.append(row)
                if len(done) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
                    done = []
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)

    fields = [("doc_id", kind), *PROOFS]
    out = pa.schema([(name, arrow_type(t)) for name, t in fields])
    return with_paths(leaves, paths, ["doc_id", "offered"]).mapInArrow(
        run, T.StructType([T.StructField(name, t) for name, t in fields]))


class Manifest:
    """The tree of a table: a leaf for each row, a subroot for each source, a root.

    Leaves of a source are in the order of their ids; while it has several nodes, 16 consecutive
    ones (the last run may be shorter) become one. Subroots, by source, become the root in the
    same way. ``leaves`` are ranked in their source; ``tiers`` hold the digests of blocks of
    16 ** 3 nodes, up to one a source; ``tops`` the same over the sources. ``offered`` gives
    other values for columns, and ``changed`` the rows that they are offered for: ``proofs``
    tells which of them no longer belong to the tree.

    Texts are hashed where they are read. What is sorted and shuffled are rows of an id and
    digests; a task holds one block of 4096 of them at a time with their parents' hash states, so
    a source with most of the rows is many blocks. Only the root reaches the driver.

    A null value is a ``-``, an empty one ``0:``. A null source is a source of its own, before all
    others; rows with a null id come first. Rows with one id are in the order of their leaves,
    and repeated rows are leaves of their own. An empty table has no root and no proofs. Other
    columns are ignored, whatever their names. A row alone in its source is the subroot, a
    source alone in the table the root, and its proof is then empty.
    """

    def __init__(
        self, docs: DataFrame, columns: tuple[str, ...] = COLUMNS, doc_id: str = "doc_id", source: str = "source",
        offered: dict[str, Column] | None = None, changed: Column | None = None,
    ):
        self.doc_id, self.source = doc_id, source
        values = [F.col(c) for c in columns]
        instead = leaf_of([(offered or {}).get(c, F.col(c)) for c in columns])
        # A null source comes before all others, also before an empty one.
        rows = saved(docs.select(
            F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0")).alias("grp"),
            F.col(doc_id).alias("doc_id"), leaf_of(values).alias("digest"),
            F.when(F.lit(False) if changed is None else changed, instead).alias("offered")), "leaves")
        self.leaves = saved(ranked(rows, ["doc_id", "digest"]), "ranked")
        self.tiers = climb(self.leaves)
        sources = saved(self.tiers[-1].select(
            F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "subroots")
        self.sources = saved(ranked(sources, ["name"]), "sources")
        self.tops = climb(self.sources)
        self.top_levels = 0
        while FANOUT**self.top_levels < (self.sources.agg(F.max("n")).first()[0] or 0):
            self.top_levels += 1
        root = self.tops[-1].select("digest").first()
        self.root = root["digest"] if root else None

    def subroots(self) -> DataFrame:
        """(source, n_docs, subroot, root), a row per source."""
        sizes = self.leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n_docs"))
        return self.sources.drop("grp", "n").join(sizes, F.col("name") == F.col("grp")).select(
            F.when(F.col("name") != "0", F.substring("name", 2, 1 << 30)).alias(self.source), "n_docs",
            F.col("digest").alias("subroot"), F.lit(self.root).alias("root"))

    def proofs(self) -> DataFrame:
        """Every row's leaf, subroot, root, its proof (the digests of the siblings on the way to
        the root in one string, with its place and the number of nodes in each run), the root
        that the offered row folds to, and whether that is the root."""
        spark = self.leaves.sparkSession
        schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("path", PATH)])
        top = descend(self.tops, spark.createDataFrame([("", 0, [])], schema))
        by_place = saved(lowered(self.sources, top), "paths")
        paths = by_place.join(self.sources.select(F.col("name"), F.col("idx").alias("place")), F.col("idx") == F.col("place"))
        paths = saved(paths.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"), "path"), "paths")
        found = folded(self.leaves, descend(self.tiers, paths), self.top_levels)
        return found.withColumnRenamed("doc_id", self.doc_id)
