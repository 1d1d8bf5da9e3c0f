"""The manifest against a plain tree in memory."""

import hashlib
import random

from helpers import EDGE, edge, empty, frame, remainder
from pyspark.sql import functions as F

from vocale.llm.merkle import Manifest, Parent, levels_of


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc_id, text, lang, source, n_chars):
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def walk(levels, at, value):
    """The root that ``value`` at leaf ``at`` folds to, and the siblings on the way."""
    others = []
    for nodes in levels[:-1]:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        others += run[: at % 16] + run[at % 16 + 1 :]
        value = h(*run[: at % 16], value, *run[at % 16 + 1 :])
        at //= 16
    return value, others


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append((leaf(*r), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        by_source[name].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees.append(climb([d for d, _ in by_source[name]]))
    top = climb([t[-1][0] for t in trees])
    root = top[-1][0]
    out = []
    for k, name in enumerate(names):
        for at, (digest, r) in enumerate(by_source[name]):
            change = r[0] is not None and remainder(r[0], 5) == 0
            value = leaf(r[0], lower(r[1]), *r[2:]) if change else digest
            sub, others = walk(trees[k], at, value)
            end, more = walk(top, k, sub)
            out.append((r[0], digest, trees[k][-1][0], root, h(*others, *more), end, end == root))
    return sorted(out, key=repr)


def proofs(docs):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tree = Manifest(docs, offered={"text": lowered}, changed=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return tree, tree.proofs().withColumn("proof_sha256", F.sha2("proof", 256))


def check(docs, rows):
    tree, found = proofs(docs)
    got = found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    return tree


def test_awkward_rows(spark):
    check(edge(spark), EDGE)


def test_one_row_is_the_root(spark):
    rows = [(5, "Only One", None, "a")]
    check(frame(spark, rows), rows)


def test_several_blocks_and_many_sources(spark):
    """A source of two blocks with a last run of one, 17 and more levels of sources, a null and an
    empty source, and ids in no order."""
    rows = [(i, f"Text {i % 7}", "en", "big") for i in range(4096 + 16 * 3 + 1)]
    rows += [(10_000 + i, None if i % 5 == 0 else f"T{i}", None, f"s{i % 290}é") for i in range(600)]
    rows += [(20_000, "X", "en", None), (20_005, "X", "en", ""), (20_010, "Y", "en", None)]
    random.Random(3).shuffle(rows)
    tree = check(frame(spark, rows), rows)
    sizes = {r["source"]: r["n_docs"] for r in tree.subroots().collect()}
    assert sizes["big"] == 4096 + 49 and sizes[None] == 2 and sizes[""] == 1 and len(sizes) == 293


def test_a_proof_can_be_followed_without_the_table(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}") for i in range(100)]
    tree, found = proofs(frame(spark, rows))
    for r in found.collect():
        value, at = r["leaf"], 0
        for slot, size in zip(r["slots"], r["sizes"]):
            others = [r["proof"][at + 64 * k : at + 64 * (k + 1)] for k in range(size - 1)]
            value = h(*others[:slot], value, *others[slot:])
            at += 64 * (size - 1)
        assert value == r["root"] == tree.root and at == len(r["proof"])


def test_tampering_is_seen(spark):
    _, found = proofs(frame(spark, [(i, f"Text {i}" if i % 2 else f"text {i}", "en", "a") for i in range(200)]))
    for r in found.collect():
        assert r["verified"] == (remainder(r["doc_id"], 5) != 0 or r["doc_id"] % 2 == 0)


def test_empty_table(spark):
    tree, found = proofs(empty(spark))
    assert tree.root is None and found.count() == 0 and tree.subroots().count() == 0


def test_states_before_each_child():
    children = [h(str(i)).encode() for i in range(5)]
    parent = Parent(b"".join(children))
    assert parent.digest == h(*map(bytes.decode, children)).encode() and len(parent.states) == 5
    for slot in range(5):
        assert parent.states[slot].hexdigest() == h(*map(bytes.decode, children[:slot]))
        assert parent.fold(slot, children[slot]) == parent.digest != parent.fold(slot, b"0" * 64)
    assert [levels_of(n) for n in (1, 2, 16, 17, 256, 257, 4096, 4097, 10**9)] == [0, 1, 1, 2, 2, 3, 3, 3, 3]
