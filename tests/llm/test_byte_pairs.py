"""Byte-level BPE against the library that reads the same ranks."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import EDGE, edge, empty, sorted_rows
from pyspark.sql import functions as F

from vocale.llm.byte_pairs import RANKS, BytePairs, Counts, byte_pairs, counter, decode_bytes, encode_bytes, read_ranks, serialise, special_strings
from vocale.llm.common import vocabulary_path
from vocale.llm.queries import QUERIES
from vocale.llm.token_counts import PATTERN, VOCABULARY
from vocale.llm.token_counts import counter as heap_counter

TEXTS = [t for _, t, *_ in EDGE] + [
    "<|endoftext|>a<|endoftext|>  b", "<unk> <s>", "don't 'S it's", "  \n\n  x ", "½² _x_", "é​　 ", "▁▁ a▁",
    "\U0001F600" * 50, "ab" * 5000, "\x00\x01\x7f", "abcdefgh" * 2000 + " " * 3000,
]


@pytest.fixture(scope="module")
def library():
    ranks = read_ranks(vocabulary_path(RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern():
    assert PATTERN == public_tokenizers.PATTERN


def test_ids(library):
    coder = byte_pairs(RANKS)
    for text, ids in zip(TEXTS, coder.encode(TEXTS)):
        assert ids.tolist() == library.encode_ordinary(text or "")
        assert coder.decode(ids.tolist()) == (text or "").encode()


def test_every_code_point(library):
    texts = [f"a{chr(c)}b {chr(c)}1  {chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    got = byte_pairs(RANKS).encode(texts)
    assert [x.tolist() for x in got] == library.encode_ordinary_batch(texts, num_threads=1)


def test_every_token_is_itself():
    ranks = read_ranks(vocabulary_path(RANKS))
    coder = BytePairs(ranks, 10)
    letters = {t: t.decode("latin-1").translate(coder.letters) for t in ranks}
    assert coder.model.encode(list(letters.values())) == [[r] for r in ranks.values()]


def test_merges_in_rank_order_and_kept_words():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"aab": 258, b"xyz": 400}
    coder = BytePairs(ranks, 1)
    assert [x.tolist() for x in coder.encode(["abc", "aab", "xyz", "xyzx", None])] == [
        [97, 256], [258], [400], [120, 121, 122, 120], []]
    assert coder.encode(["aab " + "q" * 100])[0].tolist() == [258, 32, *[113] * 100]
    assert "q" * 100 not in coder.known
    with pytest.raises(ValueError):
        serialise({b"a": 0})


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = QUERIES["op13_byte_pairs"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_edges(spark, library):
    rows = encode_bytes(edge(spark), decoded=True)
    got = sorted_rows(rows)
    want = [(i, library.encode_ordinary(t or ""), bytearray((t or "").encode())) for i, t, *_ in EDGE]
    assert got == sorted(want, key=repr)
    back = rows.select("doc_id", F.decode(decode_bytes(F.col("ids")), "UTF-8").alias("text"))
    assert sorted_rows(back) == sorted([(i, t or "") for i, t, *_ in EDGE], key=repr)
    assert encode_bytes(empty(spark)).count() == 0 and encode_bytes(empty(spark), decoded=True).count() == 0


def test_counts_are_those_of_the_heap():
    assert special_strings(VOCABULARY) == ["<|endoftext|>"] and special_strings(RANKS) == []
    heap = heap_counter(VOCABULARY, 512)(TEXTS)["n_tokens"]
    assert counter(VOCABULARY, special_strings(VOCABULARY))(TEXTS) == heap


def test_counts_of_chunks_with_any_white_space():
    """Blanks of all kinds at the ends of chunks, lines and texts, and between them."""
    rng = random.Random(9)
    marks = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " \t", "\r\n", "\xa0", "\u2003", "\x1c", "\x85", "a", "It's", "'s", "don't", "12", "!", "é", "日本", "z" * 80]
    texts = ["".join(rng.choices(marks, k=rng.randrange(12))) for _ in range(4000)] + [None, "", "\n", " ", "a\n", "\na", " a", "a "]
    want = heap_counter(VOCABULARY, 512)(texts)["n_tokens"]
    count = counter(VOCABULARY, special_strings(VOCABULARY))
    assert count(texts) == want == count(texts)
    few = Counts(byte_pairs(VOCABULARY), 5)
    assert [few([t or ""])[0] for t in texts[:500]] == want[:500]
    assert not any(len(k) > 64 for k in few.chunks)
