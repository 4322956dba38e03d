"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Words are counted over all texts. Every word's edits are generated as hashes only (its deletions, and
replacements of a letter by a later one: an insertion is the other word's deletion, a replacement by
an earlier letter the other word's replacement), and looked up in blocked Bloom filters of the
vocabulary, sharded by word length and broadcast. Edits that the filters don't know are gone on the
spot; positives are shuffled to the vocabulary and compared letter by letter, so false positives and
equal hashes drop out, and none is missed, as filters know all they were built of.

A broadcast filter has SLICE_BYTES at most. A vocabulary that needs more is looked up slice after
slice of the filters: each slice is broadcast for itself, and all words ask it for the edits in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.llm.text import mix
from loomwell.runtime import materialize, partitions

#: Fixed by the task: letters of a run, how often a run loses a letter, least length and count, and the ratio of a form's count.
LETTERS = "A-Za-zÀ-ÿ"
DELETE_EVERY, LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 31, 7, 2, 10
#: Bits of the filters for each word; words from LONGEST letters on share a shard.
BITS, LONGEST = 16, 64
#: Bytes of filters that are broadcast at once, and blocks (of 256 bits) that are built together.
SLICE_BYTES, PIECE = 32 << 20, 4096
#: Words that a task probes, about.
WORDS_A_TASK = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LENGTH = np.uint64(0x9FB21C651E98DF25)
_LANES = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _without(word: Column, at: Column) -> Column:
    """A word without its letter at a place, from 0."""
    return F.concat(word.substr(F.lit(1), at.cast("int")), word.substr(at.cast("int") + 2, F.length(word)))


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words with their occurrences over all texts.

    Null texts have no words; a null doc_id is written ``null`` where letters are deleted; repeated
    rows count each for itself.
    """
    pattern = F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).alias("_doc"), F.explode(F.regexp_extract_all("text", pattern, F.lit(1))).alias("_run"))
    runs = runs.withColumn("_run", F.when(F.col("_run").rlike("[A-Z]"), F.translate("_run", _UPPER, _LOWER)).otherwise(F.col("_run")))
    h = F.crc32(F.concat("_doc", F.lit(":"), "_run").cast("binary"))
    word = F.when(h % DELETE_EVERY == 0, _without(F.col("_run"), h % F.length("_run"))).otherwise(F.col("_run"))
    found = runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


class Filters:
    """Where words lie in the blocked filters: shards by length one after the other, blocks by hash within."""

    def __init__(self, sizes: dict[int, int]):
        self.blocks = np.zeros(LONGEST + 1, np.uint64)
        for length, n in sizes.items():
            self.blocks[length] = math.ceil(n * BITS / 256)
        self.first = (np.cumsum(self.blocks) - self.blocks).astype(np.int64)
        self.total = int(self.blocks.sum())

    def block(self, codes: np.ndarray, length: int) -> np.ndarray:
        """Blocks of codes of words of one length; -1 where the vocabulary has none of that length."""
        shard = min(length, LONGEST)
        if not self.blocks[shard]:
            return np.full(len(codes), -1, np.int64)
        return (((codes >> np.uint64(32)) * self.blocks[shard]) >> np.uint64(32)).astype(np.int64) + self.first[shard]


def _bits(codes: np.ndarray, lane: int) -> np.ndarray:
    """The bit of each code in one of a block's eight lanes of 32 bits."""
    return np.uint32(1) << ((((codes & np.uint64(0xFFFFFFFF)) * _LANES[lane]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)).astype(np.uint32)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their letters as a matrix) of words; letters have one byte each."""
    texts = column.to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, np.frombuffer("".join(texts[i] for i in rows).encode("latin-1"), np.uint8).reshape(len(rows), length)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base, np.uint64)]))


def _terms(letters: np.ndarray) -> np.ndarray:
    return (letters.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, letters.shape[1])


def _code(total: np.ndarray, length: int) -> np.ndarray:
    return mix(total + np.uint64(length * int(_LENGTH) % (1 << 64)))


def _placed(found: DataFrame, filters: Filters) -> DataFrame:
    """(word, n, code, block) of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, block = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
            for length, rows, letters in _by_length(batch.column(0)):
                code[rows] = _code(_terms(letters).sum(axis=1), length)
                block[rows] = filters.block(code[rows], length)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.view(np.int64)), pa.array(block)], ["word", "n", "code", "block"])

    return found.select("word", "n").mapInArrow(run, "word string, n long, code long, block long")


def _built(blocks: int):
    """The bits of one run of so many blocks."""

    def run(table: pa.Table) -> pa.Table:
        piece, out = table.column("piece")[:1], np.zeros(blocks * 8, np.uint32)
        codes, at = table.column("code").to_numpy().view(np.uint64), (table.column("block").to_numpy() % blocks) * 8
        for lane in range(8):
            np.bitwise_or.at(out, at + lane, _bits(codes, lane))
        return pa.table({"piece": piece, "bits": pa.array([out.tobytes()], pa.binary())})

    return run


def edits(letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, row, place, letter, code) of words' edits, in parts: deletions (letter 0), then replacements by later letters.

    Of a run of one letter, the last is deleted, as all give the same word.
    """
    m, length = letters.shape
    terms, powers = _terms(letters), _powers(_BASE, length)
    total, sums = terms.sum(axis=1), np.cumsum(terms, axis=1)
    last = np.ones((m, length), bool)
    last[:, :-1] = letters[:, 1:] != letters[:, :-1]
    row, at = np.nonzero(last)
    yield length - 1, row, at, np.zeros(len(row), np.uint8), _code(sums[row, at] - terms[row, at] + (total[row] - sums[row, at]) * _BASE_INVERSE, length - 1)
    for letter in alphabet:
        row, at = np.nonzero(letters < letter)
        yield length, row, at, np.full(len(row), letter, np.uint8), _code(total[row] + (np.uint64(letter) - letters[row, at].astype(np.uint64)) * powers[at], length)


def _positives(vocabulary: DataFrame, filters: Filters, alphabet: np.ndarray, first: int, bits) -> DataFrame:
    """(candidate, own, place, letter): edits that one slice of the filters, from block ``first`` on, lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_ = bits.value
        count = len(slice_) // 8
        for batch in batches:
            own = batch.column(1).to_numpy()
            for length, rows, letters in _by_length(batch.column(0)):
                for start in range(0, len(rows), step := max(1, (1 << 18) // length)):
                    part, mine = letters[start : start + step], own[rows[start : start + step]]
                    for size, row, at, letter, code in edits(part, alphabet):
                        block = filters.block(code, size) - first
                        keep = np.flatnonzero((block >= 0) & (block < count))
                        for lane in range(8):
                            bit = _bits(code[keep], lane)
                            keep = keep[slice_[block[keep] * 8 + lane] & bit != 0]
                        if len(keep):
                            yield pa.RecordBatch.from_arrays([pa.array(code[keep].view(np.int64)), pa.array(mine[row[keep]]), pa.array(at[keep].astype(np.int32)), pa.array(letter[keep].astype(np.int32))], ["candidate", "own", "place", "letter"])

    return vocabulary.mapInArrow(run, "candidate long, own long, place int, letter int")


def near_pairs(found: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of words of (word, n) that differ by one letter inserted, deleted or replaced, once."""
    spark = found.sparkSession
    shard = F.least(F.length("word"), F.lit(LONGEST)).cast("int")
    sizes = {r["shard"]: r["n"] for r in found.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}  # LONGEST rows at most
    filters = Filters(sizes)
    vocabulary = materialize(_placed(found, filters), "spelling-vocabulary")
    letters = found.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()  # the letters of LETTERS
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint8)
    pieces = materialize(vocabulary.select("code", "block", F.floor(F.col("block") / PIECE).alias("piece")).groupBy("piece").applyInArrow(_built(PIECE), "piece long, bits binary"), "spelling-filters")
    tasks = max(partitions(spark), math.ceil(sum(sizes.values()) / WORDS_A_TASK))
    dealt = vocabulary.select("word", "code").repartition(tasks, "code")
    at_once = max(1, SLICE_BYTES // (32 * PIECE))
    positives = None
    for start in range(0, max(1, math.ceil(filters.total / PIECE)), at_once):
        bits = np.zeros(min(at_once * PIECE, max(0, filters.total - start * PIECE)) * 8, np.uint32)
        for row in pieces.where(F.col("piece").between(start, start + at_once - 1)).collect():  # SLICE_BYTES at most
            own = np.frombuffer(row["bits"], np.uint32)
            to = (row["piece"] - start) * PIECE * 8
            bits[to : to + len(own)] = own[: len(bits) - to]
        part = _positives(dealt, filters, alphabet, start * PIECE, spark.sparkContext.broadcast(bits))
        positives = part if positives is None else positives.union(part)
    right = vocabulary.select(F.col("code").alias("candidate"), F.col("word").alias("b"), F.col("n").alias("nb"))
    left = vocabulary.select(F.col("code").alias("own"), F.col("word").alias("a"), F.col("n").alias("na"))
    both = positives.join(right, "candidate").join(left, "own")
    a, place = F.col("a"), F.col("place")
    replaced = F.concat(a.substr(F.lit(1), place), F.decode(F.unhex(F.lpad(F.hex("letter"), 2, "0")), "ISO-8859-1"), a.substr(place + 2, F.length(a)))
    return both.where(F.when(F.col("letter") == 0, _without(a, place)).otherwise(replaced) == F.col("b")).select("a", "na", "b", "nb")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last word that forms lead to.

    Every step's distance doubles, and a form occurs FORM_RATIO times as often, so a few rounds do.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        new = materialize(roots.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "spelling-roots")
        roots = new.select("word", "root")
        if not new.where("_moved").limit(1).count():
            return roots


def group(found: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of (word, n).

    ``form`` is the near word of the largest n (ties: the smallest in code-point order) where that is
    FORM_RATIO times the word's or more, else null; ``root`` the end of the chain of forms.
    """
    pairs = near_pairs(found)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("to")).alias("near")), F.struct(F.col("b").alias("word"), F.struct((-F.col("na")).alias("less"), F.col("a").alias("to")).alias("near")))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    form_n = -F.col("near.less")
    has = F.col("near").isNotNull() & (form_n >= FORM_RATIO * F.col("n"))
    told = found.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near.to")).alias("form"), F.when(has, form_n).alias("form_n"))
    told = materialize(told, "spelling-forms")
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """The groups of the words of all whole texts: word, form, root, n, n_near and form_n.

    Null and empty texts have no words; an empty table, or one without words that occur twice, gives
    an empty result. Words of any length take part. Other columns than doc_id and text are ignored.
    """
    return group(materialize(words(docs), "spelling-words"))
