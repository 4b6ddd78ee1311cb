"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank vocabulary.

Every byte becomes one character, every token of the vocabulary a piece of such characters whose score is its negated
rank; the model normalises nothing and adds no prefix. Texts are cut into pre-tokens by a pattern, each distinct
pre-token is encoded once by the model, and ids are decoded by the inverse mapping of ids to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from .common import by_size, positional, trimmed

#: Bytes stand as the 256 characters from this code point on; none of them is white space or the space mark.
FIRST = 0x100
#: Distinct pre-tokens a worker remembers; beyond them it starts afresh.
REMEMBERED = 200_000
#: White space and the like as one class: the Unicode property, whatever a regex library's own \s holds.
_SPACE = r"\t-\r\x20\x85\xA0  -     　"


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a file of ``base64 rank`` lines."""
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines.splitlines() if x.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is unknown, piece rank + 1 is the token of that rank."""
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must number the tokens from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte is no token")
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, token in enumerate(by_rank):
        pieces.append(_field(1, _field(1, _chars(token).encode()) + _field(2, float(-rank)) + _field(3, 1)))
    # Trainer: model type BPE and the piece count; normaliser: identity, no prefix, white space as it is.
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


_TABLE = {b: FIRST + b for b in range(256)}


def _chars(token: bytes) -> str:
    return token.decode("latin-1").translate(_TABLE)


class Codec:
    """Encodes texts to arrays of ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.cut = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")).findall
        self.tokens: list[bytes] = sorted(ranks, key=ranks.__getitem__)
        self.memory: dict[str, bytes] = {}

    def _learn(self, fresh: list[str]) -> None:
        found = self.model.encode([_chars(x.encode()) for x in fresh], num_threads=1)
        ends = np.cumsum([len(x) for x in found], dtype=np.int64) * 4
        raw = (np.fromiter(chain.from_iterable(found), "<u4", ends[-1] // 4 if len(ends) else 0) - np.uint32(1)).tobytes()
        at = 0
        for x, end in zip(fresh, ends.tolist(), strict=True):
            self.memory[x] = raw[at:end]
            at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cuts = [self.cut(t) for t in texts]
        new = {p for x in cuts for p in x if p not in self.memory}
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
            new = {p for x in cuts for p in x}
        self._learn(list(new))
        get = self.memory.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), "<u4") for x in cuts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(read_ranks(f.read()), pattern)


def _ship(df: DataFrame, path: str) -> str:
    with open(path, "rb") as f:
        serialise(read_ranks(f.read()))  # an unfit vocabulary fails here, not in a task
    df.sparkSession.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def _texts(column: pa.Array):
    """Parts of a column of texts with the place each begins at; nulls are empty."""
    for at, to in by_size(column):
        yield at, [t or "" for t in column.slice(at, to - at).to_pylist()]


def _replaced(df: DataFrame, out_col: str) -> tuple[list[int], list[str]]:
    """Places and names of the columns that stay beside a new one."""
    places = [k for k, c in enumerate(df.columns) if c != out_col]
    return places, [df.columns[k] for k in places] + [out_col]


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """df with the ids of each whole text as an array of long in ``out_col``, which replaces a column of that name.

    Defined cases: a null or empty text has no ids; a text may have any length; repeated rows are each encoded; an
    empty table gives no rows; names of other columns don't matter, whatever they hold and however often they occur.
    """
    name = _ship(df, vocabulary)
    places, names = _replaced(df, out_col)
    text = df.columns.index(text_col)
    cells = positional(df)

    def run(batches):
        codec = _codec(SparkFiles.get(name), pattern)
        for batch in batches:
            for at, texts in _texts(batch.column(text)):
                ids = codec.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
                flat = pa.array(np.concatenate(ids).astype(np.int64))
                # A text of over 2 ** 31 ids would not fit one Arrow batch: it fails here instead of wrapping.
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int64()).cast(pa.int32()), flat)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in places), column], names=[*(f"c{k}" for k in places), "ids"])

    schema = StructType([cells.schema[k] for k in places]).add("ids", ArrayType(LongType()))
    return cells.mapInArrow(trimmed(run), schema).toDF(*names)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes of each row's ids in ``out_col``; null ids decode to no bytes; names of other columns don't matter."""
    name = _ship(df, vocabulary)
    places, names = _replaced(df, out_col)
    ids = df.columns.index(ids_col)
    cells = positional(df)

    def run(batches):
        codec = _codec(SparkFiles.get(name), "")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = [codec.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in places), pa.array(out, pa.binary())], names=[*(f"c{k}" for k in places), "decoded"])

    schema = StructType([cells.schema[k] for k in places]).add("decoded", BinaryType())
    return cells.mapInArrow(trimmed(run), schema).toDF(*names)


def digests(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row's round trip; the cases are those of encode()."""
    name = _ship(df, vocabulary)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(SparkFiles.get(name), pattern)
        for batch in batches:
            for at, texts in _texts(batch.column(1)):
                ids = codec.encode(texts)
                cells = [pa.array([len(x) for x in ids], pa.int64())]
                cells += [pa.array([hashlib.sha256(of(x)).hexdigest() for x in ids], pa.string()) for of in (np.ndarray.tobytes, codec.decode)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *cells], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
