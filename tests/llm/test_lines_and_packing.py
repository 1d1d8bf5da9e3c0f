import hashlib
from itertools import combinations

import numpy as np
import pytest
from helpers import EDGE, LONG_LINE, WORD, edge, empty, frame
from pyspark.sql import functions as F

from vocale.llm.line_runs import LineRuns, dedup_lines, line_hashes
from vocale.llm.packing import best_buckets, pack, pack_tokens
from vocale.llm.queries import QUERIES
from vocale.llm.token_counts import token_counts

BLANK = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars=40, min_docs=5):
    holders = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders.setdefault(key(line), set()).add(i)
    keep = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def made(df, **how):
    rows = dedup_lines(df, **how).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("s")).collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in rows)


def crowd():
    rng = np.random.default_rng(4)
    pool = [LONG_LINE, f"  {LONG_LINE.upper()}\t", "ÀÉ" + LONG_LINE, "àé" + LONG_LINE, "short", "", "\r", "z" * 40, "y" * 39]
    return [(int(i), "\n".join(rng.choice(pool, rng.integers(1, 6))), "en", "s") for i in rng.integers(0, 40, 60)]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_lines(spark, batches, fanout):
    rows = crowd() + EDGE + [(None, LONG_LINE, None, None)]
    assert made(frame(spark, rows), batches=batches, fanout=fanout) == brute(rows)


def test_line_edges(spark):
    assert made(edge(spark)) == brute(EDGE)
    assert made(empty(spark)) == []
    alike = [(i, LONG_LINE, "en", "s") for i in range(7)]
    assert made(frame(spark, alike)) == brute(alike)
    kept = dedup_lines(frame(spark, alike), keep=["lang", "source"]).collect()
    assert sorted(r["text"] for r in kept) == [""] * 6 + [LONG_LINE]


def test_runs_are_compacted(spark):
    lines = line_hashes(frame(spark, [(i, f"{LONG_LINE} {i % 9}", "en", "s") for i in range(80)]), "doc_id", "text", 40)
    runs = LineRuns(spark, fanout=2)
    for low in (60, 40, 20, 0):
        runs.add(lines.filter(f"doc_id >= {low} AND doc_id < {low + 20}"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    rows = runs.runs()[0].collect()
    assert len(rows) == 9 and sum(r["n_docs"] for r in rows) == 80
    assert sorted(r["keeper"] for r in rows) == list(range(71, 80))
    with pytest.raises(ValueError):
        runs.add(lines)


def test_lines_need_no_python(spark):
    plan = dedup_lines(edge(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def padding(ends, lengths, counts):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts))


def test_buckets_are_the_best():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = sorted(rng.choice(60, rng.integers(1, 9), replace=False) + 1)
        counts = rng.integers(1, 50, len(lengths)).tolist()
        for k in (1, 2, 3, 20):
            ends = best_buckets([int(x) for x in lengths], counts, k)
            best = min(padding([*c, lengths[-1]], lengths, counts) for n in range(k) for c in combinations(lengths[:-1], min(n, len(lengths) - 1)))
            assert len(ends) <= k and ends[-1] == lengths[-1]
            assert padding(ends, lengths, counts) == best
    assert best_buckets([], [], 4) == []


def test_packing(spark):
    rows = pack(edge(spark), max_tokens=64, buckets=4, budget=256).collect()
    words = sum(len(WORD.findall(t or "")) for _, t, *_ in EDGE)
    assert sum(r["n_tokens"] for r in rows) == words
    assert all(r["padding"] == r["bucket"] - r["n_tokens"] >= 0 for r in rows)
    assert {r["first_token"] for r in rows if r["doc_id"] == 7} == set(range(0, 8000, 64))
    by_bucket = {}
    for r in rows:
        by_bucket.setdefault(r["bucket"], []).append((r["batch"], r["slot"]))
    for bucket, places in by_bucket.items():
        room = 256 // bucket
        assert sorted(places) == [(k // room, k % room) for k in range(len(places))]
    assert pack(empty(spark)).count() == 0


def test_packing_over_shards(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"))
    rows = pack(docs, buckets=3, budget=2048).groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert sum(r["n"] for r in rows) == 20_000
    assert all(r["last"] == r["n"] - 1 for r in rows)
    room = {b: 2048 // b for b in {r["bucket"] for r in rows}}
    assert sum(r["n"] < room[r["bucket"]] for r in rows) <= 3


def pieces(n, size):
    return [(a, min(size, n - a)) for a in range(0, max(n, 1), size)]


def check_pieces(counts, rows, size):
    """``counts``: (doc_id, n_tokens) of each row. All tokens are in one piece, in whole pieces."""
    want = [(i, k, a, n) for i, total in counts for k, (a, n) in enumerate(pieces(total, size))]
    assert sorted(((r["doc_id"], r["piece"], r["first_token"], r["n_tokens"]) for r in rows), key=repr) == sorted(want, key=repr)


def test_packing_counts_tokens(spark):
    """A text without spaces is cut too, and no batch holds more tokens than the budget."""
    docs = frame(spark, EDGE + [(11, "QUJD" * 500 + "日本語" * 300, "ja", "c")])
    counts = [(r["doc_id"], r["n_tokens"]) for r in token_counts(docs).collect()]
    rows = pack_tokens(docs, max_tokens=64, buckets=4, budget=256).collect()
    check_pieces(counts, rows, 64)
    assert len([r for r in rows if r["doc_id"] == 11]) > 10
    held = {}
    for r in rows:
        assert r["padding"] == r["bucket"] - r["n_tokens"] >= 0
        held[r["bucket"], r["batch"]] = held.get((r["bucket"], r["batch"]), 0) + r["bucket"]
    assert max(held.values()) <= 256
    assert pack_tokens(empty(spark)).count() == 0
    renamed = docs.drop("n").withColumnsRenamed({"doc_id": "n", "text": "mark"})
    assert pack_tokens(renamed, "n", "mark", max_tokens=64).columns[0] == "n"


def test_query_packs_tokens(spark):
    data = "/root/testdata/sf0.001"
    counts = [(r["doc_id"], r["n_tokens"]) for r in token_counts(spark.read.parquet(f"{data}/documents.parquet")).collect()]
    check_pieces(counts, QUERIES["op4_packing"](spark, data).collect(), 2048)
