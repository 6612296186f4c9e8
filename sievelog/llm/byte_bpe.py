"""Byte-level BPE by a sentencepiece model that is serialised from the vocabulary itself.

Each byte is mapped to one printable character; each token of the rank file becomes a piece of such characters whose score
is its negative rank, and the normaliser is the identity. A text is split by the vocabulary's pattern; each pre-token that
is itself a token takes that token's id, any other is encoded by the model. Decoding maps ids to pieces, characters and
bytes. The ids are the ranks.

Defined cases: null text is empty and has no ids; repeated rows are encoded each; text of any length is encoded whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean
from .token_counts import load_ranks

__all__ = ["Codec", "decode", "encode", "load_ranks", "serialise"]

#: Ids of pre-tokens that a worker remembers; when full, it forgets all.
REMEMBERED = 150_000


def byte_characters() -> str:
    """A character for each byte: itself where it is printable Latin-1 and no space, else one from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol-buffer field: varint, 32-bit float, or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model: pieces in order of rank, then the unknown piece that the format demands and no text can reach."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks: 0 to their number less one")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks: every byte must be a token")
    characters = byte_characters()
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))
    pieces = [piece("".join(characters[b] for b in token), -float(rank), 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    unknown = len(ranks)
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + piece("<unk>", 0.0, 2) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder in one process."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        characters = byte_characters()
        # the byte map covers Latin-1, so str.translate of latin-1-decoded bytes maps all bytes of a text at once
        self.to_characters = {b: c for b, c in enumerate(characters)}
        to_byte = {c: b for b, c in enumerate(characters)}
        n = self.model.get_piece_size() - 1
        self.bytes_of = [bytes(to_byte[c] for c in self.model.id_to_piece(i)) for i in range(n)]
        self.decimal = [str(i) for i in range(n)]
        self.whole = {token: i for i, token in enumerate(self.bytes_of)}
        self.known: dict[str, list[int]] = {}

    def _learn(self, new: list[str]) -> None:
        """Ids of pre-tokens that aren't known yet."""
        rest = []
        for token in new:
            raw = token.encode()
            i = self.whole.get(raw)
            if i is None:
                rest.append((token, raw.decode("latin-1").translate(self.to_characters)))
            else:
                self.known[token] = [i]
        for (token, _), ids in zip(rest, self.model.encode([x for _, x in rest], out_type=int, num_threads=1), strict=True):
            self.known[token] = ids

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if new := set(tokens).difference(self.known):
            self._learn(list(new))
        ids: list[int] = []
        for part in map(self.known.__getitem__, tokens):
            ids += part
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, model: bytes, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids array<int> of each row: a map over Arrow batches. The model (its size that of the vocabulary) is broadcast."""
    return _mapped(docs, model, pattern, key, text, "ids array<int>", lambda codec, ids: [ids], [pa.list_(pa.int32())])


def decode(rows: DataFrame, model: bytes, pattern: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and bytes binary of each row's ids; null ids decode to no bytes."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(model), rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.decode(x.as_py() or []) for x in part.column(1)], pa.binary())], names=[key, "bytes"])

    return rows.select(key, ids).mapInArrow(lean(run), f"{key} {kind}, bytes binary")


def round_trip(docs: DataFrame, model: bytes, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes).

    Encodes and decodes each text where it is read, so neither ids nor bytes travel.
    """
    import hashlib

    def digests(codec: Codec, ids: list[int]) -> list:
        return [len(ids), hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()]

    return _mapped(docs, model, pattern, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests, [pa.int64(), pa.string(), pa.string()])


def _mapped(docs: DataFrame, model: bytes, pattern: str, key: str, text: str, schema: str, made, kinds: list[pa.DataType]) -> DataFrame:
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[key].dataType.simpleString()
    names = [key, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [made(codec, codec.encode(x.as_py() or "")) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=names)

    return docs.select(key, text).mapInArrow(lean(run), f"{key} {kind}, {schema}")
