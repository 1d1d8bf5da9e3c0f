"""Byte-level BPE: a sentencepiece model made from a vocabulary of byte ranks, encoding, decoding."""

from __future__ import annotations

import base64
import functools
import itertools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocale.llm.common import map_texts, vocabulary_path
from vocale.llm.token_counts import PATTERN, byte_letters

RANKS = "byte_bpe_50k.tiktoken"
IDS = T.ArrayType(T.IntegerType(), False)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks: a file of ranks, or a tokenizer file, whose ids are the ranks.
    Special tokens of a tokenizer file are left out."""
    with open(path, "rb") as f:
        if not path.endswith(".json"):
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        spec = json.load(f)
    bytes_of = {letter: byte for byte, letter in enumerate(byte_letters())}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(map(bytes_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}


def special_strings(vocabulary: str) -> list[str]:
    """The strings that a tokenizer file takes as one token each; a file of ranks has none."""
    if not vocabulary.endswith(".json"):
        return []
    with open(vocabulary_path(vocabulary), "rb") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", [])]


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the vocabulary, without training.

    A token's piece has one printing letter per byte, its score is minus its rank, so the merge
    with the lowest rank is always the next one. Normalisation is the identity: no marker in
    front, no white space folded. Piece ids follow the ranks; the unknown piece that the format
    asks for is the last, and no text reaches it as all bytes are pieces.
    """
    from sentencepiece import sentencepiece_model_pb2 as model_format

    letters = byte_letters()
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing}")
    model = model_format.ModelProto()
    rules, trained = model.normalizer_spec, model.trainer_spec
    rules.name = "identity"
    rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
    trained.model_type = trained.BPE
    trained.unk_id, trained.bos_id, trained.eos_id, trained.pad_id = len(ranks), -1, -1, -1
    trained.vocab_size = len(ranks) + 1
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        model.pieces.add(piece="".join(map(letters.__getitem__, token)), score=-rank, type=1)
    model.pieces.add(piece="<unk>", score=0, type=2)
    return model.SerializeToString()


class BytePairs:
    """Encoder and decoder of a vocabulary. Words that a batch of texts brings for the first time
    are encoded in one call; their ids are kept, ``limit`` words at most between batches, none of
    more than 64 characters."""

    def __init__(self, ranks: dict[bytes, int], limit: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        in_order = sorted(ranks.items(), key=lambda item: item[1])
        self.ids = np.array([rank for _, rank in in_order], dtype="<i4")
        self.whole = {token: np.array([rank], dtype="<i4").tobytes() for token, rank in in_order}
        self.surface = {rank: token for token, rank in in_order}
        self.letters = {byte: ord(letter) for byte, letter in enumerate(byte_letters())}
        self.words, self.limit = regex.compile(PATTERN).findall, limit
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def closed(self) -> bool:
        """Whether each printable ASCII token without an apostrophe lies in one match of the pattern."""
        plain = [t for raw in self.whole if raw.isascii() and (t := raw.decode()).isprintable() and "'" not in t]
        return all(self.words(t) == [t] for t in plain if t.strip(" "))

    def learn(self, words: list[str]) -> None:
        """Add the packed ids of ``words``. A word that is a token is that token."""
        rest = []
        for word in words:
            raw = word.encode()
            if raw in self.whole:
                self.known[word] = self.whole[raw]
            else:
                rest.append((word, raw.decode("latin-1").translate(self.letters)))
        for (word, _), pieces in zip(rest, self.model.encode([mapped for _, mapped in rest], num_threads=1)):
            self.known[word] = self.ids[pieces].tobytes()

    def packed(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts given as words, as 4-byte numbers."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        new = list(dict.fromkeys(w for words in texts for w in words if w not in known))
        self.learn(new)
        made = [b"".join(map(known.__getitem__, words)) for words in texts]
        for word in new:
            if len(word) > 64:
                del known[word]
        return made

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text; None is an empty text."""
        return [np.frombuffer(ids, dtype="<i4") for ids in self.packed([self.words(t or "") for t in texts])]

    def decode(self, ids) -> bytes:
        """The bytes of ids, by the inverse of the vocabulary; an unknown id is an error."""
        return b"".join(map(self.surface.__getitem__, ids))


@functools.lru_cache(2)
def byte_pairs(vocabulary: str, limit: int = 150_000) -> BytePairs:
    """One per Python worker and vocabulary; its tasks share the words they have met."""
    return BytePairs(read_ranks(vocabulary_path(vocabulary)), limit)


def encoder(vocabulary: str, decoded: bool):
    coder = byte_pairs(vocabulary)

    def work(texts: list) -> dict[str, list]:
        made = coder.encode(texts)
        ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made).astype(np.int32)))
        out = {"ids": ids.cast(pa.list_(pa.field("element", pa.int32(), nullable=False)))}
        return {**out, "decoded": [coder.decode(x.tolist()) for x in made]} if decoded else out

    return work


def encode_bytes(
    docs: DataFrame, keys: list[str] | None = None, vocabulary: str = RANKS, decoded: bool = False,
) -> DataFrame:
    """Byte-level BPE of every whole text: keys, ids array<int>; with ``decoded`` also the bytes
    that the ids give when decoded, in the same pass.

    A text is cut by the vocabulary's pattern, and each match is encoded on its own by the model
    of ``serialise``; special strings are ordinary text. Each task asks the model for words it
    has not met. No row is shuffled.

    A null or empty text has no ids and decodes to no bytes. Repeated rows, rows with a null key
    and very long texts give one row each; an empty table gives an empty one. Other columns are
    ignored, whatever their names. Memory follows the longest text.
    """
    fields = [T.StructField("ids", IDS)] + [T.StructField("decoded", T.BinaryType())] * decoded
    return map_texts(docs, keys or ["doc_id"], lambda: encoder(vocabulary, decoded), T.StructType(fields))


def decode_bytes(ids: Column, vocabulary: str = RANKS) -> Column:
    """The bytes of a column of ids (null for null); ``decode(column, 'UTF-8')`` gives the text."""

    @F.pandas_udf(T.BinaryType())
    def decode(batch):
        coder = byte_pairs(vocabulary)
        return batch.map(lambda x: None if x is None else coder.decode(x.tolist()))

    return decode(ids)


class Counts:
    """Numbers of tokens, by what stands between blanks.

    A chunk with the blank before it is cut like it would be in the text, as long as it neither is
    empty nor begins or ends with white space: no match of the pattern goes on after a character
    that is not white space and before a blank. So a text whose chunks are all of that kind has
    the tokens of its chunks; any other text is cut as a whole. ``limit`` chunks of at most 64
    characters are kept between batches.

    A printable ASCII chunk without an apostrophe is not even cut: if no token of the vocabulary
    goes on over the end of a match, as is checked once, merges do not either.
    """

    UNSAFE = -(1 << 60)

    def __init__(self, coder: BytePairs, limit: int):
        self.coder, self.limit = coder, limit
        self.chunks: dict[str, int] = {}
        self.closed = coder.closed

    def merged(self, mapped: list[str]) -> list[int]:
        """The numbers of tokens of words in the model's letters, merged without cutting them."""
        return list(map(len, self.coder.model.encode(mapped, num_threads=1)))

    def counted(self, texts: list[str]) -> list[int]:
        """The numbers of tokens of texts cut by the pattern; words are encoded in one call."""
        coder = self.coder
        cut = [coder.words(t) for t in texts]
        known = dict.fromkeys(set().union(*cut), 1)
        rest = [w for w in known if w.encode() not in coder.whole]
        known.update(zip(rest, self.merged([w.encode().decode("latin-1").translate(coder.letters) for w in rest])))
        return [sum(map(known.__getitem__, words)) for words in cut]

    def __call__(self, texts: list[str]) -> list[int]:
        chunks = self.chunks
        if len(chunks) > self.limit:
            chunks.clear()
        cut = [t.split(" ") for t in texts]
        first = [keys.pop(0) for keys in cut]
        new = set().union(*cut).difference(chunks)
        # Printable ASCII letters stand for themselves in the model, and chunks have no blank.
        plain = [k for k in new if k.isascii() and k.isprintable() and "'" not in k and k] if self.closed else []
        blank = chr(self.coder.letters[32])
        chunks.update(zip(plain, self.merged([blank + k for k in plain])))
        others = new.difference(plain)
        safe = [k for k in others if k and not k[0].isspace() and not k[-1].isspace()]
        chunks.update(dict.fromkeys(others, self.UNSAFE))
        chunks.update(zip(safe, self.counted([" " + k for k in safe])))
        heads = [n if keys == [] or head and not head[-1].isspace() else self.UNSAFE
                 for head, keys, n in zip(first, cut, self.counted(first))]
        out = [n + sum(map(chunks.__getitem__, keys)) for n, keys in zip(heads, cut)]
        whole = [i for i, n in enumerate(out) if n < 0]
        for i, n in zip(whole, self.counted([texts[i] for i in whole])):
            out[i] = n
        for key in new:
            if len(key) > 64:
                del chunks[key]
        return out


def counter(vocabulary: str, special: list[str], limit: int = 400_000):
    """A function from a list of texts to their numbers of tokens, where each of the strings
    ``special`` is one token. The chunks it keeps go with it: Python workers live on for other
    operators, and keep only the model."""
    counts = Counts(byte_pairs(vocabulary), limit)
    specials = regex.compile("|".join(map(regex.escape, special))) if special else None

    def count(texts: list) -> list[int]:
        parts = [specials.split(t) if specials and t and specials.search(t) else [t or ""] for t in texts]
        each = iter(counts([p for text in parts for p in text]))
        return [sum(itertools.islice(each, len(text))) + len(text) - 1 for text in parts]

    return count
