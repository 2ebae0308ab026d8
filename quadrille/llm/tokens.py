"""Encoding of all texts with a public byte-level BPE vocabulary.

The vocabulary is serialised directly as a sentencepiece BPE model: each byte becomes one character, a piece's score is its negative rank, and
normalisation is the identity, so that the highest score merges first just as the lowest rank does.  Texts are cut into pre-tokens by the
vocabulary's pattern, pre-tokens are encoded by the model, and decoding maps pieces back to bytes.  Strings that look like special tokens are
ordinary text; an empty and a null text give the empty list.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

#: Folder of the public vocabularies, and the vocabulary of p8_ids.
FOLDER, VOCABULARY = os.environ.get("QUADRILLE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: First of the 256 characters that stand for bytes.
BASE = 0x100
CACHE = 200_000


def read_ranks(path: str) -> list[bytes]:
    """Pieces in the order of their ranks; ranks must be 0, 1, 2 ..."""
    with open(path, "rb") as f:
        rows = sorted((int(n), base64.b64decode(p)) for p, n in (line.split() for line in f if line.strip()))
    if [n for n, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks are not consecutive")
    return [p for _, p in rows]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protobuf field: bytes and text are length-delimited, floats 32 bit, other numbers varints."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def to_chars(piece: bytes) -> str:
    return "".join(chr(BASE + b) for b in piece)


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the unknown piece, never used, takes the id after the last rank."""
    body = b"".join(_field(1, _field(1, to_chars(p)) + _field(2, float(-rank)) + _field(3, 1)) for rank, p in enumerate(pieces))
    body += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    minus_one = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(k, minus_one) for k in (41, 42, 43))
    normaliser = _field(1, "identity") + _field(2, b"") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return body + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder over a serialised model."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.map = {b: BASE + b for b in range(256)}
        self.cache: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for p in self.pattern.findall(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.sp.encode(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map))
                if len(cache) < CACHE:
                    cache[p] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        chars = "".join(self.sp.id_to_piece(int(i)) for i in ids)
        return bytes(ord(c) - BASE for c in chars).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def model_of(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> bytes:
    return serialise(read_ranks(os.path.join(folder, vocabulary)))


_codecs: dict[int, Codec] = {}


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row; the model, about a megabyte, is broadcast once."""
    model = docs.sparkSession.sparkContext.broadcast(model_of(folder, vocabulary))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = model.value
        codec = _codecs.get(hash(data)) or _codecs.setdefault(hash(data), Codec(data))
        for b in batches:
            yield pd.DataFrame({key: b[key], "ids": [codec.encode(t) for t in b[text]]})

    return spread(docs.select(key, text)).mapInPandas(run, f"{key} {kind}, ids array<int>")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"))


def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per source and language."""
    docs = table(spark, folder, "documents")
    n = encode_texts(docs).select("doc_id", F.size("ids").alias("n"))
    return docs.select("doc_id", "source", "lang").join(n, "doc_id").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))
