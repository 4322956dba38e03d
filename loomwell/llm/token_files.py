"""Token ids in Arrow files: fixed-size-list batches of equal-length sequences and masks.

Documents are dealt out by ranges of doc_id; each task writes one file in Arrow's file format whose
batches have the columns ``ids`` and ``mask``, fixed-size lists of one length. The documents' ids
follow each other without gaps, only a file's last sequence is padded, with mask 0. The list
columns are flat buffers, so a reader maps a file into memory and takes any sequence, or any run of
ids, in place. Next to it stands an index file with each document's place.

Tasks write under names of their own, and only the names that succeeded tasks report are read; so
tasks can be repeated, and a lost executor's half-written file is never seen.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwell.runtime import fresh_path, materialize, partitions, partitions_for

LENGTH = 2048
END = 1
_BATCH = 512
_CACHE = 400_000
_MARKS = frozenset(".,!?;:")


def _plain(part: str) -> bool:
    """Whether a part is a word of Latin-1 letters alone."""
    return part.isalpha() and (part.isascii() or max(part) <= "\xff")


class Encoder:
    """Ids of whole texts by the tokenizers library in its default settings, with the words seen before kept.

    The tokenizer's normaliser and pre-tokeniser never join or change text across a space, tab or
    line end (NFC, white space dropped, lower case), so the ids of a text are those of its parts
    between them in turn. Texts that may hold a special token go to the library whole. Words of
    Latin-1 letters, alone or with one mark behind them, are one piece: NFC leaves them as they are,
    and their lower case has as many letters; no other part is cut or joined with others.
    ``tests/llm`` holds this against the library on whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ending = np.zeros(self.size, bool)
        self.ending[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as unsigned little-endian integers of ``type``."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts; words that none of them had before are learnt at once."""
        split, whole = [], {}
        for i, text in enumerate(texts):
            lower = text.lower()
            if any(t in text or t in lower for t in self.special):
                whole[i] = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
                split.append([])
                continue
            try:  # a text of these characters can be put in lower case beforehand, as the tokenizer would
                text.encode("latin-1")
                text = lower
            except UnicodeEncodeError:
                pass
            split.append(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
        rest = set().union(*split).difference(self.known)
        if rest:
            self._learn(rest, split)
        get = self.known.__getitem__
        return [whole[i] if i in whole else b"".join(map(get, parts)) for i, parts in enumerate(split)]

    def _learn(self, rest: set[str], split: list[list[str]]) -> None:
        """Learn the parts in ``rest``; when there are too many, what ``split`` doesn't use goes.

        A word with one mark behind it is the word's ids and the mark's, as the pre-tokenizer
        parts letters from marks.
        """
        known = self.known
        if len(known) + len(rest) > _CACHE:
            self.older, self.known = known, {}
            known, rest = self.known, set().union(*split)
        marked = [p for p in rest if p[-1:] in _MARKS and _plain(p[:-1])]
        wanted = rest.difference(marked)
        wanted.update(p[:-1] for p in marked)
        wanted.update(p[-1] for p in marked)
        fresh = []
        for p in wanted:
            if p not in known:
                ids = self.older.get(p)
                if ids is None:
                    fresh.append(p)
                else:
                    known[p] = ids
        letters = [p for p in fresh if _plain(p)]
        rest = [p for p in fresh if not _plain(p)]
        if len(letters) > 1:
            # Words of letters alone are one piece each, whose last id alone is that of an ending.
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, self.type)
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) == len(letters) and (not len(ids) or ends[-1] == len(ids)):
                raw, size = ids.tobytes(), self.type.itemsize
                starts = [0, *(ends[:-1] * size).tolist()]
                known.update((p, raw[a:b]) for p, a, b in zip(letters, starts, (ends * size).tolist()))
            else:
                rest += letters
        else:
            rest += letters
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[p] = array(self.code, e.ids).tobytes()
        for p in marked:
            known[p] = known[p[:-1]] + known[p[-1]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's encoder, made once."""
    return Encoder(path)


def _schema(length: int, ids: np.dtype) -> pa.Schema:
    kind = pa.uint16() if ids.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """One file of sequences, filled by runs of ids."""

    def __init__(self, out, length: int, ids: np.dtype):
        self.schema, self.length, self.dtype = _schema(length, ids), length, ids
        self.sink = pa.ipc.new_file(out, self.schema)
        self.held, self.size = [], 0

    def add(self, raw: bytes) -> None:
        self.held.append(raw)
        self.size += len(raw) // self.dtype.itemsize
        if self.size >= self.length * _BATCH:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        step = self.length * _BATCH
        whole = len(ids) // (self.length if last else step) * (self.length if last else step)
        rest = ids[whole:]
        used = np.ones(whole, bool)
        if last and len(rest):
            used = np.concatenate([used, np.ones(len(rest), bool), np.zeros(self.length - len(rest), bool)])
            ids, rest, whole = np.concatenate([ids, np.zeros(self.length - len(rest), self.dtype)]), rest[:0], whole + self.length
        for at in range(0, whole, step):
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[at : min(at + step, whole)]), self.length) for x in (ids, used)]
            self.sink.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self.schema)], schema=self.schema))
        self.held, self.size = [rest.tobytes()], len(rest)

    def close(self) -> None:
        self._flush(last=True)
        self.sink.close()


def open_sequences(files: fs.FileSystem, path: str) -> pa.ipc.RecordBatchFileReader:
    """A file's reader; a local file is mapped into memory, so that its batches are views of it."""
    source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
    return pa.ipc.open_file(source)


def flat_ids(reader: pa.ipc.RecordBatchFileReader, start: int, n: int, length: int) -> np.ndarray:
    """n ids from place ``start`` of a file, without reading other batches."""
    parts, size = [], length * _BATCH
    for k in range(start // size, (start + n - 1) // size + 1 if n else start // size):
        column = reader.get_batch(k).column(0)
        values = column.flatten().to_numpy()  # a view of the file's buffer
        parts.append(values[max(0, start - k * size) : start + n - k * size])
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)



def write(docs: DataFrame, tokenizer: str, folder: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Write ids of all texts to ``folder`` and return the manifest (file, place, first, tokens, documents).

    Ids follow ascending doc_id (null first; ties by a hash of the text, then ascending text), each
    document's with ``end`` after them; ``place`` is a file's place in this order. A null text counts as empty and has the end id alone. ``first``: ids of all files
    before. ``folder`` must be one that driver and executors share. No documents, no files.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions_for(docs, "text"), *order[:2]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, writer, ids, sizes = encoder(tokenizer), None, [], []
        closing = np.array([end], code.type).tobytes()
        for batch in batches:
            if writer is None and batch.num_rows:
                files, base = fs.FileSystem.from_uri(folder)
                files.create_dir(base, recursive=True)
                name = f"part-{uuid.uuid4().hex}.arrow"
                out = files.open_output_stream(f"{base}/{name}")
                writer = _Writer(out, length, code.type)
            ids += batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 256):
                for raw in code.encode_all([t or "" for t in batch.column(1).slice(at, 256).to_pylist()]):
                    sizes.append((len(raw) + len(closing)) // code.type.itemsize)
                    writer.add(raw + closing)
        if writer is not None:
            writer.close()
            out.close()
            places = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            index = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": places, "n_tokens": pa.array(sizes, pa.int64())})
            with files.open_output_stream(f"{base}/{name}.index") as raw_out, pa.ipc.new_file(raw_out, index.schema) as sink:
                sink.write_table(index)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sum(sizes)], pa.int64()), pa.array([len(sizes)], pa.int64())], ["file", "place", "tokens", "documents"])

    manifest = materialize(dealt.mapInArrow(run, "file string, place int, tokens long, documents long"), "token-manifest")
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row a file
    return manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def read(manifest: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = open_sequences(files, f"{base}/{name}")
                index = open_sequences(files, f"{base}/{name}.index").read_all()
                starts, sizes = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                sums = [zlib.crc32(flat_ids(reader, int(s), int(n), length).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                for at in range(0, len(sums), 10_000):
                    part = slice(at, at + 10_000)
                    yield pa.RecordBatch.from_arrays([index.column("doc_id").combine_chunks()[part], pa.array(starts[part] + first), pa.array(sizes[part]), pa.array(sums[part], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("file", "first").repartition(partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents' ids to the shared folder and read every document's back."""
    folder = fresh_path(docs.sparkSession, "token-files")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    return read(write(docs, tokenizer, folder), folder)
