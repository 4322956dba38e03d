"""Byte-level BPE with sentencepiece's merge engine.

A rank file becomes a sentencepiece BPE model: each token's bytes are written with one printable
character a byte, its score is its negative rank, and the normaliser is the identity. The pieces
stand in order of rank, so that piece ids are token ids; the unknown piece, which never occurs,
comes last. Each match of the pattern is encoded by itself; a match that is a token as a whole is
that token.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

_CACHE = 300_000
#: One printable character for each byte, none of which sentencepiece treats in its own way.
ALPHABET = [chr(0x4E00 + b) for b in range(256)]
_LATIN = {b: ALPHABET[b] for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by rank; ranks must run from 0 without gaps."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"ranks in {path} have gaps")
    return [ranks[i] for i in range(len(ranks))]


def build_model(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model of tokens in order of rank."""
    m = model_pb2.ModelProto()
    for rank, token in enumerate(tokens):
        m.pieces.add(piece=token.decode("latin-1").translate(_LATIN), score=-float(rank), type=model_pb2.ModelProto.SentencePiece.NORMAL)
    m.pieces.add(piece="<unk>", score=0.0, type=model_pb2.ModelProto.SentencePiece.UNKNOWN)
    t, n = m.trainer_spec, m.normalizer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id = model_pb2.TrainerSpec.BPE, len(tokens) + 1, len(tokens), -1, -1, -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return m.SerializeToString()


class _Known(dict):
    """Ids of pieces seen before; of the pieces in the older half, those asked for again stay."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.older = learn, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _CACHE:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = self.learn(piece)
        self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.whole = {t: i.to_bytes(4, "little") for i, t in enumerate(self.tokens)}
        self.engine = sentencepiece.SentencePieceProcessor(model_proto=build_model(self.tokens))
        self.split = regex.compile(pattern).findall
        self.known = _Known(self._learn)

    def _learn(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = self.whole.get(raw)
        if ids is None:
            ids = array("I", self.engine.EncodeAsIds(raw.decode("latin-1").translate(_LATIN))).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """A worker's codec, made once."""
    return Codec(path, pattern)


_ROWS = 256


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", digest: str | None = None) -> DataFrame:
    """Add ``out``, the token ids of the whole ``text`` as array<int>.

    With ``digest``, a column of that name has the SHA-256 of the bytes that the ids decode to. Null
    text counts as empty and has no ids. Columns of the new names are replaced.
    """
    new = [T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(digest, T.StringType())] if digest else [])
    kept = df.drop(*(f.name for f in new)).schema.fields
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                ids = [np.frombuffer(c.encode(t.as_py() or ""), np.int32) for t in batch.column(text)]
                offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                more = [pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(ids)))]
                if digest:
                    more.append(pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more], [*names, *(f.name for f in new)])

    return df.drop(*(f.name for f in new)).mapInArrow(run, T.StructType([*kept, *new]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes of the token ids in ``ids``; null ids give null."""
    kept = df.drop(out).schema.fields
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                got = [c.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(ids)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(got, pa.binary())], [*names, out])

    return df.drop(out).mapInArrow(run, T.StructType([*kept, T.StructField(out, T.BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    Each text is encoded, its ids are decoded again, and only the digests leave the task. Null text
    counts as empty; repeated rows give repeated results; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            sizes, first, second = [], [], []
            for t in batch.column(1):
                raw = c.encode(t.as_py() or "")
                ids = np.frombuffer(raw, np.dtype("<u4"))
                sizes.append(len(ids))
                first.append(hashlib.sha256(raw).hexdigest())
                second.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
