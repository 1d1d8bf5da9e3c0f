import hashlib

import numpy as np
from helpers import EDGE, edge, empty, frame

from vocale.llm.fingerprints import compare_edited, fingerprints, likeness, parse, sketches, written


def texts_of(n, seed=1):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400)]
    return [" ".join(rng.choice(words, rng.integers(5, 400))) for _ in range(n)]


def next_in_order(rows):
    """The rows by falling id, then text, each with the text that follows."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t, *_) in enumerate(order)]


def test_same_substring_same_interior_names():
    inner = texts_of(1, 3)[0] * 3
    around = [inner, "something else before " + inner, inner + " and after", "z" * 37 + inner + "q"]
    names = [set(parse([t])[1].tolist()) for t in around]
    for other in names[1:]:
        assert len(names[0] & other) >= 0.75 * len(names[0])


def test_batches_do_not_matter():
    texts = ["", "a", "aaaa", "ab", *texts_of(20)]
    together = sketches(texts)
    assert all((sketches([t])[0] == s).all() for t, s in zip(texts, together))


def test_likeness_follows_overlap():
    a, b = texts_of(2, 5)
    a, b = a * 20, b * 20
    half = a[: len(a) // 2] + b[: len(a) // 2]
    s = sketches([a, a, half, b])
    assert likeness(s[:1], s[1:2])[0] == 1
    assert 0.1 < likeness(s[:1], s[2:3])[0] < 0.9
    assert likeness(s[:1], s[3:4])[0] < 0.1


def check(spark, rows, bands, band_rows=4096):
    got = sorted(tuple(r) for r in [
        (-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"],
         r["near_edited"], r["near_next"]) for r in compare_edited(frame(spark, rows), bands=bands, band_rows=band_rows).collect()])
    want = []
    for i, t, after in next_in_order(rows):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        s = sketches([t, edited, after])
        want.append((-1 if i is None else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(s[:1])[0], written(s[1:2])[0],
                     float(likeness(s[:1], s[1:2])[0]), float(likeness(s[:1], s[2:])[0])))
    assert got == sorted(want)


def test_edited_texts(spark):
    check(spark, EDGE, 4)
    check(spark, [(k * 7, t, "en", "s") for k, t in enumerate(texts_of(60))], 8)
    check(spark, [(k * k - 50, t, "en", "s") for k, t in enumerate(texts_of(60))], 3, 4)
    check(spark, [(3, "only one", "en", "s")], 4)
    check(spark, [(3, "only one", "en", "s")] * 3, 1)


def test_edges(spark):
    assert compare_edited(empty(spark)).count() == 0
    rows = fingerprints(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 8)}) == 1
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (2, 3)} == {"0" * 256}
