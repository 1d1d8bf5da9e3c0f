"""Near-duplicate documents and vectors against brute force."""

import numpy as np
import pytest
from helpers import EDGE, WORD, edge, empty, frame

from vocale.llm.common import connected_components
from vocale.llm.grid_join import near_duplicates
from vocale.llm import jaccard_join
from vocale.llm.jaccard_join import (
    alike, bitmaps, linked, loosened, shared_tokens, shingle_sets, signatures, similar_documents, tiles,
)


def union(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    ids = {i for i, _ in sets if i is not None}
    links = []
    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                links.append((i, j))
    tops = union(ids, links)
    return sorted((-1 if i is None else i, len(s), -1 if i is None else tops[i]) for i, s in sets)


def made(df, **how):
    return sorted(tuple(-1 if x is None else x for x in r) for r in similar_documents(df, **how).collect())


def copies(seed, families=12, most=14):
    """Families of edited copies around the threshold, passages in many texts, and loners."""
    rng = np.random.default_rng(seed)
    pool = [f"w{k}" for k in range(3000)]
    passage = list(rng.choice(pool, 60))
    rows = []
    for _ in range(families):
        base = list(rng.choice(pool, int(rng.integers(3, 200))))
        if rng.random() < 0.6:
            at = int(rng.integers(0, len(base)))
            base[at:at] = passage
        for _ in range(int(rng.integers(1, most))):
            text = list(base)
            for _ in range(int(rng.integers(0, 1 + len(text) // 30))):
                text[int(rng.integers(0, len(text)))] = str(rng.choice(pool))
            if rng.random() < 0.3:
                text = text[: int(len(text) * rng.uniform(0.7, 1))]
            rows.append(" ".join(text))
    rows += [" ".join(passage[: int(rng.integers(20, 60))]) for _ in range(20)] + rows[:3]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k], "en", "s") for i, k in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("how", [{}, {"weight": 400, "cap": 4, "frequent_share": 0.02, "rows_limit": 0}])
def test_documents(spark, seed, how):
    rows = copies(seed)
    assert made(frame(spark, rows), **how) == brute(rows)

def test_chain_is_taken_apart(spark):
    """Sets that hang together by rare shingles only: each is dealt to a few small tiles, however
    long the chain; copies in blocks would grow with its length."""
    chain = [(k, 10, k) for k in range(3000)]
    members = spark.createDataFrame([(0, 1, n, s) for s, n, _ in chain], "kind int, group long, n long, sid long")
    rare = spark.createDataFrame([(s, t) for s, _, t in chain] + [(s + 1, t) for s, _, t in chain[:-1]], "sid long, token long")
    weight = 100 * 510
    for limit in (0, 1_000_000):
        apart = loosened(members, rare, weight, limit)
        cells = tiles(apart, weight, limit).collect()
        assert len(cells) == 2 * 2999 and not any(r["two"] for r in cells)
        by = {}
        for r in cells:
            by.setdefault(r["cell"], set()).add(r["sid"])
        assert {(min(x), max(x)) for x in by.values()} == {(k, k + 1) for k in range(2999)}
        # One shingle that all share: blocks, and every pair of sets meets in one tile.
        hub = rare.selectExpr("sid", "7L as token").distinct()
        whole = tiles(loosened(members, hub, weight, limit), weight, limit).collect()
        by = {}
        for r in whole:
            by.setdefault(r["cell"], []).append(r["side"])
        pairs = sum(x.count(0) * x.count(1) if 1 in x else len(x) * (len(x) - 1) // 2 for x in by.values())
        assert pairs == 3000 * 2999 // 2 and max(map(len, by.values())) < 400


def test_documents_in_a_chain(spark):
    """Documents that overlap the next one by a half, with a copy here and there."""
    rows, words_of = [], [f"w{k}" for k in range(4000)]
    for k in range(90):
        text = words_of[k * 40 : k * 40 + 80]
        rows.append((2 * k, " ".join(text), "en", "s"))
        if k % 3 == 0:
            rows.append((2 * k + 1, " ".join([*text[:-2], "x", "y"]), "en", "s"))
    assert made(frame(spark, rows), weight=4000) == brute(rows)


def test_signatures_miss_no_link():
    """Sets around powers of two, whose signatures differ in length, edited by up to a fourth."""
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 2, 5, 120, 130, 250, 260, 500, 530, 1100):
        base = rng.choice(1 << 62, n, replace=False)
        for _ in range(8):
            drop = int(n * rng.uniform(0, 0.2))
            new = rng.choice(1 << 62, int(n * rng.uniform(0, 0.12)), replace=False)
            sets.append(np.unique(np.concatenate([rng.permutation(base)[drop:], new])))
    sets = sorted(sets, key=len)
    signs, sizes = signatures(sets), [len(s) for s in sets]
    assert signatures([s[:0] for s in sets[:2]]) == [b"", b""] and signatures([]) == []
    assert {len(s) for s in signs} == {16, 32, 64, 128, 256}
    for side in (None, rng.integers(0, 2, len(sets))):
        maybe, sure = (union(range(len(sets)), x) for x in (alike(signs, sizes, side), linked(sets, side)))
        assert all(maybe[i] == maybe[k] for i, k in sure.items())
        assert len(set(maybe.values())) >= (10 if side is None else 8)


def test_quoted_passages_ship_no_sets(spark, monkeypatch):
    """Texts chained by passages that they quote, none alike: their shingles go to no tile."""
    dealt = []
    inner = jaccard_join.full_sets
    monkeypatch.setattr(jaccard_join, "full_sets", lambda docs, members, cells, limit: dealt.append(cells.count()) or inner(docs, members, cells, limit))
    rng = np.random.default_rng(6)
    passages = [" ".join(f"p{k}x{i}" for i in range(12)) for k in range(6)]
    rows = [(d, " ".join([*(passages[int(k)] for k in rng.choice(6, 2, replace=False)), *(f"d{d}x{i}" for i in range(60))]), "en", "s")
            for d in range(150)]
    rows += [(150, rows[3][1] + " end", "en", "s")]
    assert made(frame(spark, rows), weight=4000) == brute(rows)
    assert dealt == [2]


def test_document_edges(spark):
    assert made(edge(spark)) == brute(EDGE)
    assert made(empty(spark)) == []
    twice = [(1, "a b c d e f g", None, None), (1, "q r s t u v w", None, None), (2, "q r s t u v w", None, None), (3, "A\tb c D e f g", None, None)]
    assert made(frame(spark, twice)) == brute(twice) == [(1, 3, 1)] * 2 + [(2, 3, 1), (3, 3, 1)]


def test_threshold_is_exact():
    base = list(range(300))
    exact = np.array(sorted(hash(("a", k)) >> 2 for k in base))
    common = exact[:300]
    three, four = np.sort(common[:225]), np.sort(common[:224])
    assert linked([three, common]) == [(0, 1)]
    assert linked([four, common]) == []


def test_bit_counts_never_miss():
    rng = np.random.default_rng(0)
    for n in (1, 10, 300, 4000):
        a = np.unique(rng.integers(0, 2**62, n))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**62, n - n // 2)]))
        x = bitmaps([a, b])
        apart = len(np.setxor1d(a, b))
        assert np.bitwise_count(x[0] ^ x[1]).sum() <= apart


def test_shingles_of_batches():
    texts = ["a b c d e f", None, "", "a b", " \t ", "A  B\nc d e f", "x" * 5000, "é É"]
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[0] == sets[5]).all()
    assert all((shingle_sets([t])[0] == s).all() for t, s in zip(texts, sets))


def test_counts_over_batches(spark):
    """Groups that span Arrow batches are counted as one."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(1)
        rows = [(int(s), sorted(set(rng.integers(0, 30, 6).tolist()))) for s in range(50)] + [(3, [1, 2])]
        sets = spark.createDataFrame(rows, "sid long, tokens array<long>")
        for cap in (4, 1000):
            found = {(r["sid"], r["token"]): r["df"] for r in shared_tokens(sets, np.array([2], dtype=np.int64), cap).collect()}
            by = {}
            for s, tokens in rows:
                for t in tokens:
                    by.setdefault(t, set()).add(s)
            for t, s in by.items():
                want = cap if t == 2 else min(len(s), cap)
                assert {found.get((x, t)) for x in s} == ({want} if len(s) > 1 else {None})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(k, k + 1) for k in range(100, 160)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {x for u, v in links if u != v for x in (u, v)}
    assert got == union(nodes, [x for x in links if x[0] != x[1]])
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_vectors(rows, least=0.98):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, count = [], [0] * n
    for a in range(n):
        for b in range(n):
            (i, v, k), (j, w, m) = rows[a], rows[b]
            if a != b and None not in (i, j, k, m) and k == m and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v, dtype=float), np.array(w, dtype=float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links.append((i, j))
                    count[a] += 1
    tops = union({i for i, *_ in rows if i is not None}, links)
    return sorted((-1 if i is None else i, c, -1 if i is None else tops[i], i is not None and tops[i] == i) for (i, *_), c in zip(rows, count))


def made_vectors(spark, table, **how):
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as block", "'x' as id", "2 as copies")
    return sorted(tuple(-1 if x is None else x for x in r) for r in near_duplicates(df, **how).collect())


def test_vectors(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(60):
        base = rng.normal(size=8 if k % 5 else 3)
        for _ in range(int(rng.integers(1, 8))):
            v = base + rng.normal(size=len(base)) * rng.choice([0, 0.02, 0.12])
            rows.append([float(np.float32(x)) for x in v])
    rows = [(int(i), v, int(i) % 2) for i, v in enumerate(rows)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] * 8, 1), (904, [None, 1.0], 1),
             (905, rows[0][1], None), (None, rows[0][1], 0), (906, [0.0, -0.0, 1.0], 0), (907, [-0.0, 0.0, 2.0], 0)]
    for how in ({}, {"rows": 8, "sample": 40}):
        assert made_vectors(spark, rows, **how) == brute_vectors(rows)
    assert made_vectors(spark, rows[:0]) == []
