"""Token counts and pieces against the libraries."""

import numpy as np
import pytest
import sentencepiece
from helpers import EDGE, edge, empty
from sentencepiece import sentencepiece_model_pb2 as model_format
from tokenizers import Tokenizer

from vocale.llm.common import vocabulary_path
from vocale.llm.sentence_pieces import MODEL, DoubleArray, decode_pieces, encode_pieces, pieces_of
from vocale.llm.token_counts import VOCABULARY, count_merged, counter, token_counts

TEXTS = [t for _, t, *_ in EDGE] + [
    "<|endoftext|>a<|endoftext|>  b", "don't 'S it's", "  \n\n  x ", "½² _x_", "é​　 ", "\U0001F600" * 50, "ab" * 5000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path(VOCABULARY))


def test_counts(spark, library):
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    assert counter(VOCABULARY, 512)(TEXTS)["n_tokens"] == want
    rows = token_counts(edge(spark)).collect()
    got = sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows)
    assert got == sorted((len((t or "").encode()), n, n > 512) for (_, t, *_), n in zip(EDGE, want))
    assert token_counts(empty(spark)).count() == 0


def test_every_code_point_splits_alike(library):
    texts = [f"a{chr(c)}b {chr(c)}1  {chr(c)}" for c in range(0x3400) if not 0xD800 <= c < 0xE000]
    assert counter(VOCABULARY, 512)(texts)["n_tokens"] == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in token_counts(docs).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


def test_lowest_rank_first():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}
    assert count_merged(list("abc"), ranks) == 1
    assert count_merged(list("aab"), {("a", "a"): 0, ("a", "b"): 1}) == 2
    assert count_merged([], ranks) == 0


@pytest.fixture(scope="module")
def unigram():
    """The library on the same pieces and scores, as a unigram model."""
    coder = pieces_of(MODEL)
    proto = model_format.ModelProto()
    with open(vocabulary_path(MODEL), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece, score in zip(proto.pieces, coder.scores):
        piece.score = score
    return coder, sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_pieces(spark, unigram):
    coder, library = unigram
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in [*(t or "" for t in TEXTS), *docs]:
        ours, theirs = coder.encode(text), library.encode(text)
        # The library adds up in single precision, so among near ties it may take the lower score.
        assert ours.tolist() == theirs or coder.score(ours) >= coder.score(np.array(theirs))
        assert coder.decode(ours.tolist()) == text


def test_best_path_against_all_paths(unigram):
    coder, _ = unigram
    table = {p: s for (p, _, kind), s in zip(coder.pieces, coder.scores) if kind in (1, 4)}

    def best(word):
        if not word:
            return 0.0
        options = [table[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in table]
        return max(options + ([coder.unknown + best(word[1:])] if word[0] not in table else []))

    for word in ("▁hello", "▁there", "▁▁ab", "▁日x", "unlikely", "ሴ"):
        ids = np.frombuffer(coder.word(word), dtype="<i4")
        assert coder.score(ids) == pytest.approx(best(word))


def test_double_array():
    keys = [b"a", b"ab", b"abc", b"b", b"bcd", "é".encode()]
    trie = DoubleArray(keys, list(range(len(keys))))
    assert trie.prefixes(b"abcd", 0) == [(1, 0), (2, 1), (3, 2)]
    assert trie.prefixes(b"xbcd", 1) == [(2, 3), (4, 4)]
    assert trie.prefixes(b"zz", 0) == [] and trie.prefixes("é".encode(), 0) == [(2, 5)]


def test_piece_edges(spark):
    rows = encode_pieces(edge(spark))
    assert rows.count() == len(EDGE) and rows.filter("NOT round_trip").count() == 0
    assert encode_pieces(empty(spark)).count() == 0
    back = rows.select("doc_id", decode_pieces(rows["ids"]).alias("text")).collect()
    assert sorted((r["text"] for r in back)) == sorted((t or "") for _, t, *_ in EDGE)
