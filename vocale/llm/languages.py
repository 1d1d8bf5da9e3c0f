"""Languages of texts by hyperdimensional profiles."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocale.llm.common import map_texts

UNKNOWN = "und"
DIMENSIONS, GRAM, SEED = 1024, 3, 20_240_607
SCHEMA = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


@functools.cache
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalpha():
            low = letter.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letter_vector(letter: int, dimensions: int) -> np.ndarray:
    """The random vector of +1 and -1 of a letter; 0 stands for what lies between words."""
    return np.random.default_rng([SEED, letter]).choice(np.array([-1, 1], dtype=np.int8), dimensions)


class Profiler:
    """Document vectors: letter vectors are permuted by their place in the n-gram and bound by
    multiplication, the n-gram vectors are bundled by addition."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[code] = letter_vector(code, self.dimensions)
        return self.letters[code]

    def gram_vectors(self, grams: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
        """One vector per row of letter numbers; position i is rotated by i."""
        base = np.stack([self.letter(int(c)) for c in alphabet])
        bound = base[grams[:, 0]]
        for i in range(1, self.gram):
            bound = bound * np.roll(base, i, axis=1)[grams[:, i]]
        return bound.astype(np.float32)

    def vectors(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The bundled vector of each text and whether it has a letter. Words are set off by one
        gap on each side; n-grams do not cross texts."""
        codes = np.frombuffer("".join((t or "") + " " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])
        letters = letter_table()[codes]
        has = np.bincount(owner, weights=letters > 0, minlength=len(texts)) > 0
        # Gaps of any length become one; each text gets a gap in front.
        keep = letters > 0
        keep[1:] |= letters[:-1] > 0
        letters, owner = letters[keep], owner[keep]
        heads = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else np.array([], dtype=int)
        letters, owner = np.insert(letters, heads, 0), np.insert(owner, heads, owner[heads] if len(heads) else 0)
        alphabet, numbers = np.unique(letters, return_inverse=True)
        n, g, m = len(texts), self.gram, len(alphabet)
        out = np.zeros((n, self.dimensions), dtype=np.float32)
        if len(numbers) < g:
            return out, has
        key = np.zeros(len(numbers) - g + 1, dtype=np.int64)
        for i in range(g):
            key = key * m + numbers[i : len(numbers) - g + 1 + i]
        inside = owner[: len(key)] == owner[g - 1 :]
        key, owner = key[inside], owner[: len(key)][inside]
        if not len(key):
            return out, has
        kinds, kind = self.compact(key, m**g)
        grams = np.stack([kinds // m ** (g - 1 - i) % m for i in range(g)], axis=1)
        step = max(1, 2_000_000 // n)  # n-grams at a time, for a table of texts by n-grams
        for a in range(0, len(kinds), step):
            some = slice(None) if step >= len(kinds) else (kind >= a) & (kind < a + step)
            width = min(step, len(kinds) - a)
            counts = np.bincount(owner[some] * width + (kind[some] - a), minlength=n * width)
            out += counts.reshape(n, width).astype(np.float32) @ self.gram_vectors(grams[a : a + step], alphabet)
        return out, has

    @staticmethod
    def compact(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and the number of each: by a table where keys are small, else by sorting."""
        if size > 4_000_000:
            return np.unique(key, return_inverse=True)
        present = np.zeros(size, dtype=bool)
        present[key] = True
        kinds = np.flatnonzero(present)
        numbers = np.zeros(size, dtype=np.int64)
        numbers[kinds] = np.arange(len(kinds))
        return kinds, numbers[key]


def fit_languages(
    rows: DataFrame, lang: str = "lang", text: str = "text", docs_per_lang: int = 3000,
    dimensions: int = DIMENSIONS,
) -> dict[str, np.ndarray]:
    """Prototype vectors of the languages of ``rows``: the sum of their documents' unit vectors.

    ``docs_per_lang`` bounds the sample: a language with more documents gives about that many,
    chosen by a hash of the text; smaller ones give all. Tasks bundle what they read, and Spark
    adds the parts up; one vector per language reaches the driver.
    """
    rows = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_per_lang / n))])
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(SEED), "text"), F.lit(1 << 20)) < shares[F.col("lang")] * (1 << 20))

    def bundle(batches):
        profiler, sums = Profiler(dimensions), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 64):
                made, _ = profiler.vectors(texts[a : a + 64])
                norm = np.linalg.norm(made, axis=1, keepdims=True)
                for name, v in zip(langs[a : a + 64], made / np.where(norm > 0, norm, 1)):
                    sums[name] = sums[name] + v if name in sums else v.astype(np.float64)
        import pyarrow as pa
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [x.tolist() for x in sums.values()]})

    parts = chosen.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    # Summed in a fixed number of digits, so that the order of the parts does not matter.
    whole = parts.groupBy("lang", "i").agg(F.sum(F.col("x").cast("decimal(30,12)")).cast("double").alias("x"))
    out = {k: np.zeros(dimensions) for k in sizes}
    for r in whole.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        out[r["lang"]] = np.array([p["x"] for p in r["v"]])
    return {k: v for k, v in out.items() if v.any()}


def predictor(prototypes: dict[str, np.ndarray], dimensions: int):
    names = sorted(prototypes)
    profiler = Profiler(dimensions)
    units = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else np.zeros((0, dimensions))

    def work(texts: list) -> dict[str, list]:
        if not names:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)}
        langs, scores = [], []
        for a in range(0, len(texts), 64):
            made, has = profiler.vectors(texts[a : a + 64])
            norm = np.linalg.norm(made, axis=1, keepdims=True)
            cosine = (made / np.where(norm > 0, norm, 1)).astype(np.float64) @ units.T
            best = cosine.argmax(axis=1)
            langs += [names[b] if h else UNKNOWN for b, h in zip(best, has)]
            scores += [float(min(1.0, max(0.0, c[b]))) if h else 0.0 for b, h, c in zip(best, has, cosine)]
        return {"lang_pred": langs, "score": scores}

    return work


def predict_languages(
    docs: DataFrame, prototypes: dict[str, np.ndarray], keys: list[str] | None = None,
    text: str = "text", dimensions: int = DIMENSIONS,
) -> DataFrame:
    """(keys, lang_pred, score): the language whose prototype has the highest cosine with the
    whole text's vector (of equal ones the first by name), and that cosine, at least 0.

    A null, empty or letterless text is ``und`` with score 0, and so is every text if no
    language was learned. Equal texts get equal results. Rows with null or repeated keys give one
    row each; an empty table gives an empty one. Other columns are ignored. No row is shuffled.
    """
    return map_texts(docs, keys or ["doc_id"], lambda: predictor(prototypes, dimensions), SCHEMA, text)
