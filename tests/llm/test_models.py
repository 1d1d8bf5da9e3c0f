"""Toxicity, quality and languages: held-out accuracy, edge rows, no leaks."""

import numpy as np
import pytest
from helpers import EDGE, edge, empty, frame, remainder

from vocale.llm import quality, toxicity
from vocale.llm.languages import Profiler, fit_languages, predict_languages
from vocale.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def rates(rows, truth):
    p, y = np.array([r["predicted"] for r in rows]), np.array([truth[r["doc_id"]] for r in rows])
    return (p == y).mean(), p[y == 1].mean(), p[y == 0].mean()


def test_toxicity_held_out(spark, labels):
    rows = QUERIES["op2_toxicity"](spark, DATA).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    right, _, wrong = rates([r for r in rows if r["held_out"] and r["doc_id"] in labels], {k: v["toxic"] for k, v in labels.items()})
    assert right > 0.9 and wrong < 0.03


def test_toxicity_caught_held_out(spark):
    """With enough labels to learn from."""
    big = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = QUERIES["op2_toxicity"](spark, big).filter("held_out").collect()
    right, caught, wrong = rates([r for r in rows if r["doc_id"] in truth], truth)
    assert right > 0.97 and caught >= 0.9 and wrong < 0.02


def test_quality_held_out(spark, labels):
    rows = QUERIES["op9_quality"](spark, DATA).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) for r in rows)
    right, kept, let_in = rates([r for r in rows if r["held_out"] and r["doc_id"] in labels], {k: v["quality"] for k, v in labels.items()})
    assert right > 0.93 and kept > 0.95 and let_in < 0.2


def test_languages_held_out(spark):
    rows = QUERIES["op3_languages"](spark, DATA).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_bundles_are_sums_of_bound_letters():
    p = Profiler(256)
    made, has = p.vectors(["ab", "", "Ab, ab!", "12"])
    gap, a, b = p.letter(0), p.letter(ord("a")), p.letter(ord("b"))
    first = gap.astype(int) * np.roll(a, 1) * np.roll(b, 2) + a.astype(int) * np.roll(b, 1) * np.roll(gap, 2)
    assert (made[0] == first).all()
    assert has.tolist() == [True, False, True, False]
    assert (made[2] == 2 * first + b.astype(int) * np.roll(gap, 1) * np.roll(a, 2)).all()


def test_language_edges(spark):
    learned = fit_languages(frame(spark, [(1, "the cat sat on the mat", "en", None), (2, "der hund und die katze", "de", None)]))
    rows = predict_languages(edge(spark), learned).collect()
    assert len(rows) == len(EDGE)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[4]["lang_pred"] == "und" and by[2]["score"] == 0
    assert by[5]["lang_pred"] == "de" and by[1]["lang_pred"] == "en"
    assert predict_languages(empty(spark), learned).count() == 0
    assert fit_languages(empty(spark)) == {}
    assert {r["lang_pred"] for r in predict_languages(edge(spark), {}).collect()} == {"und"}


def test_interactions_are_learned():
    """Two terms are harmless alone and toxic together: only the factors can tell."""
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(3000)]
    y = np.array([float(0 in r and 1 in r) for r in rows])
    model = toxicity.train(rows, y, np.arange(6), epochs=40, rate=0.3, factor_rate=0.1, positive=1.0)
    flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    right = (toxicity.logistic(model.raw(flat, row, len(rows))[0]) > 0.5) == y
    assert right.mean() > 0.97
    again = toxicity.Machine.load(model.dump())
    assert np.allclose(again.raw(flat, row, len(rows))[0], model.raw(flat, row, len(rows))[0])


def test_raw_score_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(5), 0.3, rng.normal(size=5), rng.normal(size=(5, 3)))
    got = m.raw(np.array([0, 2, 4, 1]), np.array([0, 0, 0, 2]), 3)[0]
    pair = sum(m.factors[i] @ m.factors[j] for i, j in ((0, 2), (0, 4), (2, 4)))
    assert np.allclose(got, [0.3 + m.weights[[0, 2, 4]].sum() + pair, 0.3, 0.3 + m.weights[1]])


def test_additive_learns_a_pair():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (0, 1) in model.pairs
    assert (((quality.logistic(model.raw(x)) > 0.5) == y).mean()) > 0.9


def test_model_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    some = spark.createDataFrame(
        [(i, i % 2, i % 2) for i in range(1, 11)] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    for fit, score in ((toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)):
        for labels in (none, some):
            model = fit(edge(spark), labels)
            rows = score(edge(spark), model).collect()
            assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
            assert len({r["score"] for r in rows if r["doc_id"] in (1, 8)}) == 1
            assert score(empty(spark), model).count() == 0
        assert fit(empty(spark), some) is not None


def test_pairs_are_learned_by_the_fit(spark):
    """Two words that alone say nothing: with 0.3 of the texts for each, both, one and none
    come out at 0.42, 0 and 0.18, and each alone at the base rate of 0.126."""
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(4000):
        a, b = map(bool, rng.random(2) < 0.3)
        rate = 0.42 if a and b else 0.18 if not a and not b else 0.0
        words = [f"filler{k}" for k in rng.integers(0, 30, 6)] + ["redword"] * a + ["bluething"] * b
        rows.append((i, " ".join(words), "en", "s"))
        marks.append((i, 1, int(rng.random() < rate)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(frame(spark, rows, extra=False), labels)
    tests = [(1, "redword bluething", "en", "s"), (2, "redword", "en", "s"), (3, "bluething", "en", "s")]
    score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(frame(spark, tests, extra=False), model).collect()}
    assert score[1] > 0.25 and score[2] < 0.1 and score[3] < 0.1


def test_partners_against_plain_counts():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(1500)]
    labels = np.array([float(3 in x and 7 in x and rng.random() < 0.9 or rng.random() < 0.05) for x in rows])
    assert toxicity.partners(rows, labels, 1).tolist() == [3, 7]
    n = sum(3 in x and 7 in x for x in rows)
    k = sum(y for x, y in zip(rows, labels) if 3 in x and 7 in x)
    p = max([labels.mean()] + [np.mean([y for x, y in zip(rows, labels) if t in x]) for t in (3, 7)])
    z = (k - n * p) / np.sqrt(n * p * (1 - p))
    assert toxicity.partners(rows, labels, 5, z=z - 0.01).tolist()[:2] == [3, 7]
    assert 3 not in toxicity.partners(rows, labels, 5, z=z + 0.01) and len(toxicity.partners([np.array([], int)], labels[:1], 5)) == 0


def test_a_step_of_training_by_hand():
    """One row, one epoch, AdaGrad: every step is the rate times the sign of its gradient."""
    made = toxicity.train([np.array([0, 1])], np.array([1.0]), np.array([4, 9]), factors=2, epochs=1, decay=0.0)
    rng = np.random.default_rng(7)
    v = rng.normal(0, 0.02, (2, 2))
    bias = np.log((1 - 1e-3) / 1e-3)
    raw = bias + v[0] @ v[1]
    error = (1 / (1 + np.exp(-raw)) - 1) * 2
    assert made.bias == pytest.approx(bias - 0.2 * error / np.sqrt(1e-8 + error**2))
    assert made.weights == pytest.approx(-0.2 * error / np.sqrt(1e-8 + error**2) * np.ones(2))
    for i in (0, 1):
        g = error * v[1 - i]
        assert made.factors[i] == pytest.approx(v[i] - 0.02 * g / np.sqrt(1e-8 + g**2))
