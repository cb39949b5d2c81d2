"""Byte-level BPE through a sentencepiece model serialised from a rank vocabulary.

Each vocabulary entry becomes one piece: its bytes are mapped to printable characters, its
score is its negative rank, and the normaliser is the identity, so the model merges pairs in
rank order and a piece's id is its rank. Pre-tokens are encoded one by one; decoding is the
inverse mapping of ids to bytes.

Edge cases: null and empty texts have no ids; lone surrogates cannot occur in Spark strings;
repeated rows come out repeated; an empty table gives an empty result; other columns are not
read. A text is held whole in its task, its ids as packed integers.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from . import common

#: Encoded pre-tokens kept by a Python worker; a full cache is emptied.
CACHE = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's byte strings, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it prints, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece comes last."""
    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)))
    unknown = b"<unk>"
    out += _field(1, _field(1, unknown) + _field(2, 0.0) + _field(3, 2))
    n = len(tokens)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n)  # kind: BPE; size; id of <unk>
    trainer += b"".join(_varint(k << 3) + b"\xff" * 9 + b"\x01" for k in (41, 42, 43))  # no bos, eos, pad: -1
    plain = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, plain))


class ByteBPE:
    """Encoder and decoder over one vocabulary; ids travel as packed little-endian uint32."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.letters = dict(enumerate(byte_letters()))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def pre_tokens(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct matches of the pattern."""
        out, rest = {}, []
        for p in pieces:
            whole = self.rank.get(p.encode())
            if whole is None:
                rest.append(p)
            else:
                out[p] = struct.pack("<I", whole)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            mapped = [p.encode().decode("latin-1").translate(self.letters) for p in part]
            for p, ids in zip(part, self.model.encode(mapped, num_threads=1), strict=True):
                out[p] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that can be encoded apart.

        No match of the pattern holds a white-space character after another kind of character,
        so between such a pair the text can be cut: most parts are one word with the space
        before it. A text in which white space precedes a space is split by the pattern itself.
        """
        if text[0] == " " or re.search(r"\s ", text):
            return self.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of whole texts; parts seen before come from the cache."""
        cache, out = self.cache, []
        for at in range(0, len(texts), 64):
            if len(cache) > CACHE:
                cache.clear()
            parts = [self.chunks(t) if t else [] for t in texts[at : at + 64]]
            new = [c for c in set().union(*parts) if c not in cache]
            # A word with its space is one match: the pattern need not run over it.
            split = {c: [c] if c[1:].isalpha() and c[0] == " " else self.split(c) for c in new}
            ids = self.pre_tokens(list(set().union(*split.values())))
            for c, pieces in split.items():
                cache[c] = ids[c] if len(pieces) == 1 else b"".join(map(ids.__getitem__, pieces))
            out += [b"".join(map(cache.__getitem__, x)) for x in parts]
            for c in new:
                if len(c) > 64:
                    del cache[c]
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def coder(path: str, pattern: str) -> ByteBPE:
    """The coder of a vocabulary, built once in each Python worker."""
    return common.worker_state("bpe", (path, pattern), lambda: ByteBPE(read_ranks(path), pattern))


def _map(docs: DataFrame, path: str, pattern: str, row: Callable, schema: pa.Schema, spark_schema: str) -> DataFrame:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path, pattern)
        texts = batch.column(1)
        rows = []
        for at in range(0, len(texts), 256):
            rows += [row(bpe, packed) for packed in bpe.encode(texts.slice(at, 256).to_pylist())]
        columns = list(zip(*rows, strict=True))
        return pa.record_batch([batch.column(0), *map(pa.array, columns, schema.types[1:])], schema=schema)

    return common.map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), each, spark_schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids: array of int) of each row's whole text."""

    def row(bpe: ByteBPE, packed: bytes) -> tuple:
        return (np.frombuffer(packed, "<u4").astype(np.int32),)

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _map(docs, path, pattern, row, schema, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data: binary) from (doc_id, ids); null ids decode to nothing."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path, pattern)
        data = [bpe.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(1)]
        return pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return common.map_batches(encoded.selectExpr("cast(doc_id as long) doc_id", "ids"), each, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every row; return counts and digests, not the ids themselves."""

    def row(bpe: ByteBPE, packed: bytes) -> tuple:
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(packed)).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _map(docs, path, pattern, row, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
