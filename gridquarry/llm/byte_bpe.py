"""Byte-level BPE encoding and decoding through a sentencepiece model (operator 6).

The model is serialised directly from a rank file, without training: each token's bytes are mapped to printable
characters, its score is its negative rank, normalisation is the identity. Merging the pair with the best score is
then merging the pair with the lowest rank. Pre-tokens are joined by a character that no piece holds, so that no merge
crosses them, and that character's unknown ids are taken out again. Decoding is the inverse mapping of ids to bytes.

Texts are taken whole, in slices of pre-tokens, so memory is bounded by one text and its ids. Null and empty texts have no ids. Ties cannot occur, as ranks are distinct; repeated rows
and extra columns are passed through.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm.common import frugal, kept, sliced
from gridquarry.llm.pretokens import Memory, Splitter

#: Pre-tokens of a generation whose ids a worker keeps.
KNOWN = 200_000


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank; ranks must be 0, 1, 2, ... without gaps."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    out = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in out] != list(range(len(out))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError(f"{path}: ranks have gaps or single bytes are missing")
    return out


def byte_alphabet() -> str:
    """256 distinct printable characters, the one at b standing for byte b."""
    return "".join(chr(b) if 0x21 <= b <= 0x7E else chr(0x100 + b) for b in range(256))


ALPHABET = byte_alphabet()
BREAK = chr(0x250)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    """A protobuf field: int and bool as varint, float as fixed32, bytes as length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(int(value) & (1 << 64) - 1)


def serialised(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    pieces = [_field(1, "".join(ALPHABET[b] for b in t).encode()) + _field(2, -float(rank)) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normal = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normal)


class ByteBPE:
    """Encoder and decoder of one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.tokens = load_ranks(path)
        self.splitter = Splitter(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.tokens))
        self.unknown = len(self.tokens)
        self.digits = [str(i) for i in range(len(self.tokens))]
        self.memory = Memory(self._each, KNOWN)

    def _each(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token, all encoded in one call."""
        ids = np.array(self.model.encode(BREAK.join([codecs.charmap_decode(w.encode(), "strict", ALPHABET)[0] for w in words])), np.int32)
        ends = [*np.flatnonzero(ids == self.unknown).tolist(), len(ids)]
        raw, starts = ids.tobytes(), [0, *(e + 1 for e in ends)]
        return [raw[4 * i : 4 * j] for i, j in zip(starts, ends)]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return np.frombuffer(b"".join(map(self.memory.ids, self.splitter.slices(text))), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def loaded(path: str, pattern: str) -> ByteBPE:
    """The codec of a file, built once in each Python worker as long as its tasks use it."""
    return kept(("byte-level BPE", path, pattern), lambda: ByteBPE(path, pattern))


def _encode(path: str, pattern: str, at: int):
    def run(batches):
        codec = loaded(path, pattern)
        for b in sliced(batches):
            ids = [codec.encode(t or "") for t in b.column(at).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))) if ids else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "ids"])

    return run


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the array column ids of each text's token ids; the path must exist on every executor."""
    keep = [c for c in docs.columns if c.lower() != ids.lower()]
    own = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(keep)))
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", ids array<int>"
    out = own.mapInArrow(frugal(_encode(path, pattern, keep.index(text))), schema)
    return out.toDF(*keep, ids)


def _decode(path: str, pattern: str):
    def run(batches):
        codec = loaded(path, pattern)
        for b in sliced(batches):
            rows = [None if x is None else codec.decode(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *b.columns[1:]], ["bytes", *b.schema.names[1:]])

    return run


def decoded(rows: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and the bytes of each row's ids; null ids give null."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(ids).alias("ids"), F.col(key).alias("key")).mapInArrow(frugal(_decode(path, pattern)), f"bytes binary, key {kind}").select(
        F.col("key").alias(key), "bytes"
    )


def _digest(path: str, pattern: str):
    def run(batches):
        codec = loaded(path, pattern)
        for b in sliced(batches):
            ns, hashes, back = [], [], []
            for t in b.column(1).to_pylist():
                ids = codec.encode(t or "").tolist()
                ns.append(len(ids))
                hashes.append(hashlib.sha256(" ".join(map(codec.digits.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ns, pa.int64()), pa.array(hashes), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return run


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs (doc_id, text), encoded and decoded in one pass."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        frugal(_digest(path, pattern)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
