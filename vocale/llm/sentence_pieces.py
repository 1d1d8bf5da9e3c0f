"""Unigram encoding and decoding over a double-array trie of pieces."""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocale.llm.common import map_texts, vocabulary_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Fixed values of the model file: the kinds of a piece, and what an unknown character costs more
#: than the dearest piece.
NORMAL, BYTE, USER_DEFINED, UNKNOWN_PENALTY = 1, 6, 4, 10.0
SCHEMA = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.LongType()),
    T.StructField("log_score", T.DoubleType()), T.StructField("round_trip", T.BooleanType()),
])


class DoubleArray:
    """A trie over byte strings in two arrays.

    The child of state s by byte c is t = base[s] + c + 1, if check[t] == s; the value of a key is
    the base of its end state's child by code 0. States are placed in breadth-first order at the
    first offset where all their children's slots are free.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in zip(keys, values):
            node = 0
            for code in key:
                if code not in children[node]:
                    children[node][code] = len(children)
                    children.append({})
                node = children[node][code]
            ends[node] = value
        size = 2 * len(children) + 1024
        base, check = [0] * size, [-1] * size
        place, queue, free = {0: 0}, [0], 1
        check[0] = 0
        for node in queue:
            codes = sorted([0] * (node in ends) + [c + 1 for c in children[node]])
            if not codes:
                continue
            while check[free] != -1:
                free += 1
            start = max(1, free - codes[0])
            while any(check[start + c] != -1 for c in codes):
                start += 1
            if start + 600 > len(base):
                base += [0] * len(base)
                check += [-1] * len(check)
            state = place[node]
            base[state] = start
            for c in codes:
                check[start + c] = state
            if node in ends:
                base[start] = ends[node]
            for c, child in children[node].items():
                place[child] = start + c + 1
                queue.append(child)
        self.base, self.check = base, check

    def prefixes(self, text: bytes, at: int) -> list[tuple[int, int]]:
        """(end, value) of every key that starts at ``at``, shortest first."""
        base, check, state, found = self.base, self.check, 0, []
        for i in range(at, len(text)):
            child = base[state] + text[i] + 1
            if check[child] != state:
                break
            state = child
            leaf = base[state]
            if check[leaf] == state:
                found.append((i + 1, base[leaf]))
        return found


def rank_scores(pieces: list[tuple[str, float, int]]) -> list[float]:
    """Log scores for a file that stores merge ranks: pieces by rank have Zipf probabilities,
    p(r) = 1 / ((r + 1) H). Rounded to 1/1024, so that sums are exact. The stored score is minus
    the rank; pieces that no merge makes (a score below -10^8) rank last."""
    ranks = [min(-score, 1e6) if kind in (NORMAL, USER_DEFINED) else None for _, score, kind in pieces]
    total = math.log(sum(1 / (r + 1) for r in ranks if r is not None))
    return [0.0 if r is None else round((-math.log(r + 1) - total) * 1024) / 1024 for r in ranks]


class Kept(dict):
    """What ``make`` gives for a word, worked out on first sight. Two generations of ``limit``
    words are held; at the limit the older one is forgotten. Words over 64 characters are not kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Pieces:
    """Encoder and decoder for a list of (piece, score, kind); ``scores`` replaces the scores."""

    def __init__(self, pieces: list[tuple[str, float, int]], scores: list[float], cache: int = 250_000):
        self.pieces, self.scores = pieces, scores
        usable = [i for i, (_, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)]
        self.trie = DoubleArray([pieces[i][0].encode() for i in usable], usable)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = min((scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, x in enumerate(pieces) if x[2] == 2), 0)
        self.surface = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == 3 else
            p.replace(SPACE, " ").encode() for p, _, kind in pieces
        ]
        whole = [pieces[i][0] for i in usable]
        # A marker inside a piece comes after markers only: then words are encoded on their own.
        if any(SPACE in p.lstrip(SPACE) for p in whole):
            raise ValueError("a piece has a white-space marker after another character")
        # A word is cut further between two characters that are neighbours in no piece.
        self.neighbours = {p[i : i + 2] for p in whole for i in range(len(p) - 1)}
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if not any("\n" in p for p in whole)
                                else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.stems = Kept(self.best, cache)
        self.packed = Kept(self.word, cache)
        # What each identifier adds to the score: an unknown character pays at its first byte.
        self.costs = np.array(scores)
        for byte, i in self.byte_ids.items():
            self.costs[i] = 0.0 if 0x80 <= byte < 0xC0 else self.unknown

    def best(self, word: str) -> bytes:
        """Viterbi: the segmentation with the highest sum of log scores; of equal ones the path
        found first. A character that starts no piece of its own length may be unknown, which is
        written as its bytes. Identifiers are packed as 4-byte numbers."""
        text = word.encode()
        n, lowest = len(text), -math.inf
        score, origin, piece = [lowest] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        base, check, scores = self.trie.base, self.trie.check, self.scores
        at = 0
        while at < n:
            lead = text[at]
            after = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, whole, state, end = score[at], False, 0, at
            while end < n:  # along the trie: every piece that starts here
                child = base[state] + text[end] + 1
                if check[child] != state:
                    break
                state = child
                end += 1
                leaf = base[state]
                if check[leaf] == state:
                    s = here + scores[base[leaf]]
                    if s > score[end]:
                        score[end], origin[end], piece[end] = s, at, base[leaf]
                    if end == after:
                        whole = True
            if not whole and here + self.unknown > score[after]:
                score[after], origin[after], piece[after] = here + self.unknown, at, -1
            at = after
        ids: list[int] = []
        end = n
        while end:
            a, i = origin[end], piece[end]
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in reversed(text[a:end]))
            else:
                ids.append(self.unknown_id)
            end = a
        return np.array(ids[::-1], dtype="<i4").tobytes()

    def word(self, word: str) -> bytes:
        near = self.neighbours
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in near]
        if not cuts:
            return self.stems[word]
        return b"".join(self.stems[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)]))

    def encode(self, text: str) -> np.ndarray:
        """Identifiers. Spaces become markers, and a marker is put in front."""
        if not text:
            return np.array([], dtype="<i4")
        words = self.words(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.packed.__getitem__, words)), dtype="<i4")

    def score(self, ids: np.ndarray) -> float:
        """The sum of the log scores."""
        return float(self.costs[ids].sum())

    def decode(self, ids) -> str:
        """The text of identifiers: markers become spaces, the one in front goes, bytes are put
        together; bytes that are not UTF-8 become replacement characters."""
        text = b"".join(map(self.surface.__getitem__, ids))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in proto.pieces]


@functools.cache
def pieces_of(model: str) -> Pieces:
    """One per Python worker; its tasks share the words they have segmented."""
    pieces = read_pieces(vocabulary_path(model))
    return Pieces(pieces, rank_scores(pieces))


def encoder(model: str):
    coder = pieces_of(model)

    def work(texts: list) -> dict[str, list]:
        made = [coder.encode(t or "") for t in texts]
        ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made).astype(np.int32)))
        return {
            "ids": ids.cast(pa.list_(pa.field("element", pa.int32(), nullable=False))),
            "n_pieces": [len(x) for x in made], "log_score": [coder.score(x) for x in made],
            "round_trip": [coder.decode(x.tolist()) == (t or "") for t, x in zip(texts, made)],
        }

    return work


def encode_pieces(docs: DataFrame, keys: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """Pieces of every whole text: keys, ids array<int>, n_pieces, log_score, round_trip.

    Words (runs of markers and what follows up to the next marker) are segmented by Viterbi over
    a double-array trie; no piece crosses a word, so the best path of a text is that of its
    words. Characters without a piece are written as byte pieces. ``round_trip`` tells whether
    decoding gives the text back, which only a text that ends up with invalid bytes fails. The
    model is the piece list of a file; its merge ranks become log scores by ``rank_scores``.

    A null or empty text has no pieces, score 0 and comes back as an empty one. Rows with null
    or repeated keys give one row each; an empty table gives an empty one. Other columns are
    ignored. Memory follows the longest text. No row is shuffled.
    """
    return map_texts(docs, keys or ["doc_id"], lambda: encoder(model), SCHEMA)


def decode_pieces(ids: Column, model: str = MODEL) -> Column:
    """The text of a column of piece identifiers (null for null)."""

    @F.pandas_udf(T.StringType())
    def decode(batch):
        coder = pieces_of(model)
        return batch.map(lambda x: None if x is None else coder.decode(x))

    return decode(ids)
