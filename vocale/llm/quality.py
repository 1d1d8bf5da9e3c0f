"""Text quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

import functools
import io
import unicodedata
import zlib
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocale.llm.common import fit_in_task, labelled_sample, map_texts

FEATURES = (
    "log_chars", "upper_share", "symbol_share", "mark_share", "digit_share", "space_share", "line_share",
    "word_length", "symbol_words", "packed_size", "letter_kinds", "sentence_words",
    "doubled_words",
)
#: Classes of characters.
OTHER, LOWER, UPPER, DIGIT, SPACE, LINE, STOP, MARK, SYMBOL = range(9)
SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
SHAPE = T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))])


@functools.cache
def classes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            table[c] = UPPER if kind in ("Lu", "Lt") else LOWER
        elif kind[0] == "N":
            table[c] = DIGIT
        elif kind[0] == "Z":
            table[c] = SPACE
        elif kind[0] == "P":
            table[c] = MARK
        elif kind[0] == "S":
            table[c] = SYMBOL
    table[[ord(c) for c in "\t\v\f\r "]] = SPACE
    table[10] = LINE
    table[[ord(c) for c in ".?"]] = STOP
    table[[ord(c) for c in "#$%&*|@\\<>{}[]~^_="]] = SYMBOL
    return table


def measure(texts: list) -> np.ndarray:
    """One row of ``FEATURES`` per text; shares of nothing are 0."""
    n = len(texts)
    sizes = np.array([len(t or "") for t in texts])
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind, owner = classes()[codes], np.repeat(np.arange(n), sizes)
    count = np.bincount(owner * 9 + kind, minlength=9 * n).reshape(n, 9).astype(float)
    letter = (kind == LOWER) | (kind == UPPER)
    same = owner[1:] == owner[:-1]
    starts = letter.copy()
    starts[1:] &= ~(letter[:-1] & same)
    words = np.bincount(owner[starts], minlength=n).astype(float)
    # Words that end in a symbol, or in a mark that is followed by another one.
    odd = letter[:-1] & same & (kind[1:] == SYMBOL)
    double = (kind[:-1] == MARK) & same & (codes[1:] == codes[:-1])
    odd = np.bincount(owner[:-1][odd | double], minlength=n).astype(float)
    letters = count[:, LOWER] + count[:, UPPER]
    kinds = np.zeros(n)
    if len(codes):
        seen = np.unique(owner[letter].astype(np.int64) * 0x110000 + codes[letter])
        kinds = np.bincount(seen // 0x110000, minlength=n).astype(float)
    packed = np.array([len(zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1)) for t in texts], dtype=float)

    doubled = np.zeros(n)
    for i, t in enumerate(texts):
        parts = t.split() if t else []
        doubled[i] = sum(map(eq, parts, parts[1:])) / len(parts) if parts else 0.0

    def share(x, y):
        return np.divide(x, y, out=np.zeros(n), where=y > 0)

    chars = sizes.astype(float)
    return np.stack([
        np.log1p(chars), share(count[:, UPPER], letters), share(count[:, SYMBOL], chars), share(count[:, MARK], chars),
        share(count[:, DIGIT], chars), share(count[:, SPACE], chars), share(count[:, LINE], chars),
        share(letters, words), share(odd, words), share(packed, chars), share(kinds, np.sqrt(chars)),
        share(words, count[:, STOP] + count[:, LINE] + 1), doubled,
    ], axis=1)


@dataclass
class Additive:
    """The score is the bias, one table entry per feature, and one per chosen pair of features."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    squares: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables)):
            out += values[np.searchsorted(edges, x[:, k], side="right")]
        near = [np.searchsorted(edges, x[:, k], side="right") for k, edges in enumerate(self.coarse)]
        for (a, b), values in zip(self.pairs, self.squares):
            out += values[near[a], near[b]]
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        lists = {f"{name}{i}": v for name in ("edges", "tables", "coarse", "squares") for i, v in enumerate(getattr(self, name))}
        np.savez(out, bias=self.bias, pairs=np.array(self.pairs, dtype=int).reshape(-1, 2), **lists)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Additive:
        x = np.load(io.BytesIO(data))

        def read(name: str) -> list:
            return [x[f"{name}{i}"] for i in range(sum(f.startswith(name) for f in x.files))]

        return Additive(float(x["bias"]), read("edges"), read("tables"), read("coarse"),
                        [tuple(map(int, p)) for p in x["pairs"]], read("squares"))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def leaf(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    return -g / (h + least)


def gain(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    return g * g / (h + least)


def shallow_tree(g: np.ndarray, h: np.ndarray, least: float, depth: int = 2) -> np.ndarray:
    """The values per bin of the best tree of ``depth`` cuts along the bins."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), leaf(g.sum(), h.sum(), least))
    cg, ch = np.cumsum(g), np.cumsum(h)
    left = gain(cg[:-1], ch[:-1], least) + gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1], least)
    at = int(np.argmax(left))
    if left[at] <= gain(cg[-1], ch[-1], least) + 1e-9:
        return np.full(len(g), leaf(cg[-1], ch[-1], least))
    return np.concatenate([shallow_tree(g[: at + 1], h[: at + 1], least, depth - 1),
                           shallow_tree(g[at + 1 :], h[at + 1 :], least, depth - 1)])


def quadrants(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """The best cut of each of two features: its gain and the values of the four quadrants."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = 0.0
    for part in (
        (cg[:-1, :-1], ch[:-1, :-1]),
        (cg[:-1, -1:] - cg[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1]),
        (cg[-1:, :-1] - cg[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1]),
        (cg[-1, -1] - cg[-1:, :-1] - cg[:-1, -1:] + cg[:-1, :-1], ch[-1, -1] - ch[-1:, :-1] - ch[:-1, -1:] + ch[:-1, :-1]),
    ):
        total = total + gain(*part, least)
    a, b = np.unravel_index(int(np.argmax(total)), total.shape)
    values = np.empty_like(g)
    for rows in (slice(None, a + 1), slice(a + 1, None)):
        for cols in (slice(None, b + 1), slice(b + 1, None)):
            values[rows, cols] = leaf(g[rows, cols].sum(), h[rows, cols].sum(), least)
    return float(total[a, b]), values


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def train(
    x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 12, rounds: int = 150, pair_rounds: int = 60,
    pairs: int = 6, rate: float = 0.1, least: float = 2.0,
) -> Additive:
    """Cyclic boosting: in each round every feature in turn gets a shallow tree on its bins, which
    is added to its table. Then the pairs whose quadrants explain most of what is left are
    boosted in the same way on coarser bins."""
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    width = x.shape[1]
    edges, rough = [cut_points(x[:, k], bins) for k in range(width)], [cut_points(x[:, k], coarse) for k in range(width)]
    model = Additive(float(np.log(base / (1 - base))), edges, [np.zeros(len(e) + 1) for e in edges], rough, [], [])
    fine = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    near = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(rough)]
    raw = np.full(len(y), model.bias)
    for _ in range(rounds):
        for k in range(width):
            p = logistic(raw)
            m = len(model.tables[k])
            step = rate * shallow_tree(np.bincount(fine[k], p - y, m), np.bincount(fine[k], p * (1 - p), m), least)
            model.tables[k] += step
            raw += step[fine[k]]

    def square(a: int, b: int, p: np.ndarray):
        shape = len(rough[a]) + 1, len(rough[b]) + 1
        if min(shape) < 2:
            return None
        at = near[a] * shape[1] + near[b]
        g, h = (np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (p - y, p * (1 - p)))
        return quadrants(g, h, least)

    p = logistic(raw)
    found = [(made[0], a, b) for a, b in combinations(range(width), 2) if (made := square(a, b, p))]
    for _, a, b in sorted(found, reverse=True)[:pairs]:
        model.pairs.append((a, b))
        model.squares.append(np.zeros((len(rough[a]) + 1, len(rough[b]) + 1)))
    for _ in range(pair_rounds):
        for (a, b), values in zip(model.pairs, model.squares):
            step = rate * square(a, b, logistic(raw))[1]
            values += step
            raw += step[near[a], near[b]]
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
    modulus: int = 5, held: int = 0, max_rows: int = 20_000,
) -> Additive:
    """Train on labelled documents with crc32(id as text) mod ``modulus`` not ``held``; at most
    about ``max_rows`` of them, in one task. Without rows of both labels the model scores the base
    rate (0 without any row)."""
    sample = labelled_sample(docs, labels, label, doc_id, modulus, held, max_rows, text)
    rows = map_texts(sample, ["label", "doc_id"], lambda: lambda t: {"features": list(measure(t))}, SHAPE)

    def fit(columns: list) -> bytes:
        x, y = np.array(columns[2].to_pylist()), columns[0].to_numpy().astype(float)
        if 0 < y.sum() < len(y):
            return train(x, y).dump()
        base = np.clip(y.mean(), 1e-9, 1 - 1e-9)
        return Additive(float(np.log(base / (1 - base))), [], [], [], [], []).dump()

    made = fit_in_task(rows.select("label", "doc_id", "features"), fit)
    return Additive.load(made) if made else Additive(-35.0, [], [], [], [], [])


def scorer(model: Additive, threshold: float):
    def work(texts: list) -> dict[str, list]:
        score = logistic(model.raw(measure(texts)))
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    return work


def score_quality(
    docs: DataFrame, model: Additive, keys: list[str] | None = None, text: str = "text", threshold: float = 0.3,
) -> DataFrame:
    """(keys, score, predicted): the model's probability for every whole text by adding up table
    entries, and whether it reaches ``threshold``. Only the text is looked at.

    A null text is scored as an empty one, which has a score like any other. Rows with null or
    repeated keys give one row each; an empty table gives an empty one. Other columns are
    ignored. No row is shuffled.
    """
    return map_texts(docs, keys or ["doc_id"], lambda: scorer(model, threshold), SCORE, text)
