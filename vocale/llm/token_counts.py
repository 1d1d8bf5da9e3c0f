"""Token counts by byte-pair merging, without building identifiers."""

from __future__ import annotations

import functools
import heapq
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vocale.llm.common import map_texts, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: A fixed value of byte-level vocabularies: how text is split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("over_limit", T.BooleanType()),
])


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: the byte's own Latin-1
    letter if that prints, else the next free one from 256 on."""
    letters, free = [], 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            letters.append(chr(byte))
        else:
            letters.append(chr(free))
            free += 1
    return letters


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges.

    The symbols are a linked list; a heap holds the adjacent pairs that have a rank. The lowest
    rank (the leftmost of equal ones) is popped and merged, and the pairs that this makes are
    pushed. An entry whose pair is gone is skipped. O(n log n) for a word of n bytes.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i], symbols[j] = symbols[i] + symbols[j], None
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


class WordCounts(dict):
    """Tokens of a word, worked out on first sight; holds at most twice ``limit`` words.

    At ``limit`` words the present generation becomes the old one and the one before is
    forgotten, so that frequent words stay. Words over 64 characters are not kept.
    """

    def __init__(self, ranks: dict[tuple[str, str], int], limit: int):
        super().__init__()
        self.ranks, self.limit, self.letters, self.old = ranks, limit, byte_letters(), {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = count_merged([self.letters[b] for b in word.encode()], self.ranks)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n


@functools.cache
def load(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Merge ranks and special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    special = [t["content"] for t in spec.get("added_tokens", [])]
    return {m: i for i, m in enumerate(merges)}, special


@functools.cache
def counted_words(vocabulary: str, cache: int = 300_000) -> WordCounts:
    """One per Python worker: its tasks share what they have counted."""
    return WordCounts(load(vocabulary_path(vocabulary))[0], cache)


def counter(vocabulary: str, limit: int, counts: WordCounts | None = None):
    """A function from texts to the columns of ``SCHEMA``. ``counts``: a cache of the caller's own
    in place of the worker's."""
    special = load(vocabulary_path(vocabulary))[1]
    words = regex.compile(PATTERN).findall
    specials = regex.compile("|".join(map(regex.escape, special))) if special else None
    counts = counted_words(vocabulary) if counts is None else counts

    def count(text: str) -> int:
        pieces = specials.split(text) if specials and specials.search(text) else [text]
        return len(pieces) - 1 + sum(sum(map(counts.__getitem__, words(p))) for p in pieces)

    def work(texts: list) -> dict[str, list]:
        n = [count(t) if t else 0 for t in texts]
        return {
            "n_bytes": [len(t.encode()) if t else 0 for t in texts],
            "n_tokens": n, "over_limit": [x > limit for x in n],
        }

    return work


def token_counts(
    docs: DataFrame, keys: list[str] | None = None, limit: int = 512, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Tokens of every whole text (keys, n_bytes, n_tokens, over_limit: n_tokens > ``limit``).

    A text is split into words by the vocabulary's pattern, each word is merged by
    ``count_merged``, and the count is initial symbols minus merges; no identifiers are made.
    Special strings count as one token each. Words repeat, so each task keeps the counts of
    those it has seen (a bounded cache, words up to 64 characters). No row is shuffled.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows, rows with a null key and very
    long texts give one row each; an empty table gives an empty one. Other columns are ignored,
    whatever their names.
    """
    return map_texts(docs, keys or ["doc_id"], lambda: counter(vocabulary, limit), SCHEMA)
