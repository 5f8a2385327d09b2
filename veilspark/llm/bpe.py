"""Byte-level BPE encoding and decoding through a SentencePiece model.

The vocabulary (token bytes with ranks) is serialised straight into a
SentencePiece BPE model: every byte becomes one character, each token a piece
whose score is its negative rank, and normalisation is the identity. Merging
the best-scored pair first is then merging the lowest rank first. A text is cut
into pre-tokens by the vocabulary's pattern, each is encoded apart, and ids are
decoded by the inverse byte mapping.

Defined cases: null and empty texts have no ids and decode to no bytes; equal
texts give equal ids; text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import sha256, slices, small_batches

#: Pre-tokens whose ids a worker remembers before it starts afresh.
MEMORY = 100_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks are not consecutive")
    return [tokens[i] for i in range(len(tokens))]


def _characters() -> list[str]:
    """One printable character per byte, none of them white space or a control character."""
    return [chr(0x2800 + b) for b in range(256)]  # the 256 Braille patterns


def _field(number: int, wire: int, payload: bytes) -> bytes:
    return _varint(number << 3 | wire) + (_varint(len(payload)) if wire == 2 else b"") + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def serialise(tokens: list[bytes]) -> bytes:
    """A SentencePiece ModelProto: pieces by rank, then the unknown piece it requires."""
    import struct

    chars = _characters()
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(rank))) + _field(3, 0, _varint(normal)))
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(unknown)))
    trainer = _field(3, 0, _varint(bpe)) + _field(4, 0, _varint(len(tokens) + 1)) + _field(40, 0, _varint(len(tokens)))
    normaliser = _field(1, 2, b"identity") + _field(3, 0, b"\0") + _field(4, 0, b"\0") + _field(5, 0, b"\0")
    return bytes(out + _field(2, 2, trainer) + _field(3, 2, normaliser))


class Codec:
    """Encoder and decoder for one vocabulary file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.table = str.maketrans({chr(b): c for b, c in enumerate(_characters())})
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.known: dict[str, tuple[int, ...]] = {}

    def pieces(self, words: set[str]) -> None:
        """Look up the ids of pre-tokens not yet known, in one call."""
        if len(self.known) + len(words) > MEMORY:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        raw = [w.encode() for w in new]
        for word, data, ids in zip(new, raw, self.model.encode([r.decode("latin-1").translate(self.table) for r in raw], num_threads=1), strict=True):
            # a pre-token that is itself a token is that token, whatever its merges
            self.known[word] = (self.whole[data],) if data in self.whole else tuple(ids)

    def encode_words(self, text: str) -> list[tuple[int, ...]]:
        words = self.split(text)
        try:
            return [self.known[w] for w in words]
        except KeyError:
            self.pieces(set(words))
            return [self.known[w] for w in words]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_words(text) for i in ids]

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each text as an array column (replacing one of that name)."""
    keep = [f for f in df.schema if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, text):
            made = [own.encode(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(made, pa.list_(pa.int32()))], names=[f.name for f in keep] + [ids])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{ids}` array<int>"]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that each array of ids stands for (null ids: no bytes)."""
    keep = [f for f in df.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            made = [own.decode(x or ()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(made, pa.binary())], names=[f.name for f in keep] + [out])

    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{out}` binary"]))


def digests(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """Encodes each text, decodes its ids, and returns sizes and digests of both beside the other columns.

    With a name in ``ids``, the ids themselves come too.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *([ids] if ids else [])]
    keep = [f for f in df.schema if f.name not in (text, *made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, text):
            n, a, b, c = [], [], [], []
            for t in batch.column(text).to_pylist():
                found = own.encode(t or "")
                n.append(len(found))
                a.append(sha256(" ".join(map(str, found)).encode()))
                b.append(sha256(own.decode(found)))
                if ids:
                    c.append(found)
            columns = [pa.array(n, pa.int64()), pa.array(a), pa.array(b), *([pa.array(c, pa.list_(pa.int32()))] if ids else [])]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + columns, names=[f.name for f in keep] + made)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["n_tokens long, ids_sha256 string, decoded_sha256 string", *([f"`{ids}` array<int>"] if ids else [])]))
