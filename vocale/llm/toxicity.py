"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import io
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocale.llm.common import fit_in_task, labelled_sample, map_texts, saved

BITS = 22
#: Terms of a word: itself and its beginnings of these lengths, which stand for its stem.
STEMS = (4, 5, 6)
WORDS = re.compile(r"[^\W\d_]+").findall
SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
TERMS = T.StructType([T.StructField("terms", T.ArrayType(T.IntegerType()))])


def hashed(word: str) -> list[int]:
    """The term numbers of a word: itself and its beginnings, hashed to ``BITS`` bits."""
    terms = [word, *[f"{n}:{word[:n]}" for n in STEMS if len(word) >= n]]
    return [zlib.crc32(t.encode()) & ((1 << BITS) - 1) for t in terms]


class Terms(dict):
    """Packed term numbers of a word, worked out on first sight; at most ``limit`` words are kept.
    With ``places``, only terms that have a place there, and their places."""

    def __init__(self, places: dict[int, int] | None = None, limit: int = 150_000):
        super().__init__()
        self.places, self.limit = places, limit

    def __missing__(self, word: str) -> bytes:
        numbers = hashed(word)
        if self.places is not None:
            numbers = [self.places[n] for n in numbers if n in self.places]
        packed = np.array(numbers, dtype=np.int32).tobytes() if numbers else b""
        if len(self) >= self.limit:
            self.clear()
        self[word] = packed
        return packed


def terms_of(text: str | None, known: Terms) -> np.ndarray:
    """The distinct hashed terms of a text, in rising order."""
    packed = b"".join(map(known.__getitem__, set(WORDS((text or "").lower()))))
    return np.unique(np.frombuffer(packed, dtype=np.int32))


@dataclass
class Machine:
    """y(x) = bias + sum of w_i + sum over pairs i < j of <v_i, v_j>, over the terms present."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, flat: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the rows' factor sums. ``flat``: term numbers, ``row``:
        the row of each, rising."""
        sums = np.zeros((rows, self.factors.shape[1]))
        squares = np.zeros(rows)
        if len(flat):
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            v = self.factors[flat]
            sums[row[heads]] = np.add.reduceat(v, heads, axis=0)
            squares = np.bincount(row, weights=(v * v).sum(axis=1), minlength=rows)
        linear = np.bincount(row, weights=self.weights[flat], minlength=rows)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, terms=self.terms, bias=self.bias, weights=self.weights, factors=self.factors)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Machine:
        x = np.load(io.BytesIO(data))
        return Machine(x["terms"], float(x["bias"]), x["weights"], x["factors"])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(
    rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, factors: int = 6, epochs: int = 30,
    rate: float = 0.2, factor_rate: float = 0.02, decay: float = 1e-4, batch: int = 256, seed: int = 7,
    positive: float = 2.0,
) -> Machine:
    """Logistic loss, AdaGrad steps over shuffled batches. ``rows`` hold numbers into ``terms``. A row
    with the label counts ``positive`` times: such rows are few, and one term may have to do."""
    rng = np.random.default_rng(seed)
    base = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model = Machine(terms, float(np.log(base / (1 - base))), np.zeros(len(terms)),
                    rng.normal(0, 0.02, (len(terms), factors)))
    seen_b, seen_w, seen_v = 1e-8, np.full(len(terms), 1e-8), np.full((len(terms), factors), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            flat = np.concatenate([rows[i] for i in some])
            row = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
            raw, sums = model.raw(flat, row, len(some))
            error = (logistic(raw) - labels[some]) * np.where(labels[some] > 0, positive, 1.0) / len(some)
            step = error.sum()
            seen_b += step * step
            model.bias -= rate * step / np.sqrt(seen_b)
            if not len(flat):
                continue
            used, where = np.unique(flat, return_inverse=True)
            gw = np.bincount(where, weights=error[row]) + decay * model.weights[used]
            each = error[row][:, None] * (sums[row] - model.factors[flat])
            gv = np.stack([np.bincount(where, weights=each[:, k]) for k in range(factors)], axis=1)
            gv += decay * model.factors[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            model.weights[used] -= rate * gw / np.sqrt(seen_w[used])
            model.factors[used] -= factor_rate * gv / np.sqrt(seen_v[used])
    return model


def lists(chunk) -> list[np.ndarray]:
    """The lists of an Arrow column without nulls, as pieces of its one array of numbers."""
    ends = chunk.offsets.to_numpy()
    return np.split(chunk.flatten().to_numpy(), ends[1:-1] - ends[0]) if len(chunk) else []


def numbered(terms: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The places of ``ids`` in the sorted ``terms``; ids that are not there are left out."""
    at = np.searchsorted(terms, ids)
    at[at == len(terms)] = 0
    return at[terms[at] == ids] if len(terms) else at[:0]


def partners(rows: list[np.ndarray], labels: np.ndarray, most: int, least_docs: int = 20, z: float = 6.0) -> np.ndarray:
    """Places of the terms of pairs that are more often toxic than either term alone explains.

    ``rows`` hold the places of a document's terms. For all pairs of places the documents with
    both, and those among them with the label, are counted by matrix products over blocks of
    rows. A pair stays if its labels are ``z`` deviations above what the higher of the two terms'
    own rates (and the base rate) gives; of more than ``most`` the strongest.
    """
    width = max((int(x.max()) for x in rows if len(x)), default=-1) + 1
    both, hits = np.zeros((width, width), np.float32), np.zeros((width, width), np.float32)
    for a in range(0, len(rows), 1024):
        some, block = rows[a : a + 1024], np.zeros((len(rows[a : a + 1024]), width), np.float32)
        block[np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some)] = 1
        both += block.T @ block
        toxic = block[labels[a : a + 1024] > 0]
        hits += toxic.T @ toxic
    alone = np.diag(hits) / np.maximum(np.diag(both), 1)
    expected = np.clip(np.maximum(np.maximum(alone[:, None], alone[None, :]), labels.mean()), 1e-6, 1 - 1e-6)
    above = (hits - both * expected) / np.sqrt(np.maximum(both, 1) * expected * (1 - expected))
    above[(both < least_docs) | np.tri(width, dtype=bool)] = 0
    order = np.argsort(-above, axis=None, kind="stable")[:most]
    order = order[above.ravel()[order] >= z]
    return np.unique(np.concatenate(np.unravel_index(order, above.shape)))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    modulus: int = 4, held: int = 2, max_rows: int = 20_000, max_terms: int = 4096, min_docs: int = 5,
    pool: int = 1024, max_pairs: int = 256,
) -> Machine:
    """Train on labelled documents with crc32(id as text) mod ``modulus`` not ``held``.

    ``max_rows`` bounds the sample of labelled rows. Their hashed terms are saved; Spark counts
    each term with and without the label. Two kinds of terms stay: the ``max_terms`` that differ
    most from chance alone (at least 4 standard deviations, in ``min_docs`` documents), and those
    of the ``max_pairs`` pairs that differ most together (``partners``), whatever they do alone.
    Pairs are looked for among the ``pool`` terms in the most documents, of those in at most half
    of them. The machine is fitted in one task on the bounded sample and is a few hundred KB.
    Without rows of both labels it scores the base rate (0 without any row).
    """
    sample = labelled_sample(docs, labels, label, doc_id, modulus, held, max_rows, text)
    rows = saved(map_texts(
        sample, ["label", "doc_id"], term_lists, TERMS), "terms")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0))).first()
    base = positive / n if n else 0.0
    empty = Machine(np.array([], dtype=np.int32), float(np.log(max(base, 1e-9) / max(1 - base, 1e-9))),
                    np.zeros(0), np.zeros((0, 1)))
    if not 0 < positive < n:
        return empty
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
    spread = F.abs(F.col("k") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    chosen = counts.filter(F.col("n") >= min_docs).withColumn("z", spread).filter("z >= 4")
    picked = chosen.orderBy(F.desc("z"), "term").limit(max_terms).select("term").collect()
    often = counts.filter((F.col("n") >= 4 * min_docs) & (2 * F.col("n") <= n)).orderBy(F.desc("n"), "term").limit(pool)
    alone = np.array(sorted(r["term"] for r in picked), dtype=np.int32)
    common = np.array(sorted(r["term"] for r in often.select("term").collect()), dtype=np.int32)
    if not len(alone) and not len(common):
        return empty

    def fit(columns: list) -> bytes:
        y = columns[0].to_numpy().astype(float)
        ids = [x for chunk in columns[2].chunks for x in lists(chunk)]
        paired = common[partners([numbered(common, x) for x in ids], y, max_pairs, 4 * min_docs)] if len(common) else common
        terms = np.union1d(alone, paired)
        if not len(terms):
            return empty.dump()
        return train([numbered(terms, x) for x in ids], y, terms).dump()

    return Machine.load(fit_in_task(rows.select("label", "doc_id", "terms"), fit))


def term_lists():
    known = Terms()
    return lambda texts: {"terms": [terms_of(t, known) for t in texts]}


def scorer(model: Machine, threshold: float):
    words = Terms({int(t): i for i, t in enumerate(model.terms)})

    def work(texts: list) -> dict[str, list]:
        known = [terms_of(t, words) for t in texts]
        flat = np.concatenate(known) if known else np.array([], dtype=int)
        row = np.repeat(np.arange(len(known)), [len(x) for x in known])
        score = logistic(model.raw(flat.astype(int), row, len(known))[0])
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    return work


def score_toxicity(
    docs: DataFrame, model: Machine, keys: list[str] | None = None, text: str = "text", threshold: float = 0.3,
) -> DataFrame:
    """(keys, score, predicted): the machine's probability for every whole text, and whether it
    reaches ``threshold``. Only the text is looked at; equal texts get equal scores.

    A null or empty text, or one without a known term, gets the score of the bias. Rows with null
    or repeated keys give one row each; an empty table gives an empty one. Other columns are
    ignored. No row is shuffled.
    """
    return map_texts(docs, keys or ["doc_id"], lambda: scorer(model, threshold), SCORE, text)
