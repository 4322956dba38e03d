"""Language identification with error-correcting output codes.

Each language has a codeword; for each of its bits a binary classifier over hashed byte n-grams
predicts on which side a text is. A classifier weighs an n-gram by the log-odds of its frequency
in the languages whose bit is 1 against those whose bit is 0, and a text's margin is the mean
weight of its n-grams over the classifier's usual margin. Decoding takes the codeword with the
least loss sum(accuracy * exp(-bit * margin)); where the two best losses are close, the text is
flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.llm.text import utf8

DIMENSIONS = 1 << 16
#: Labelled texts for each language that training may use, at most.
SAMPLE = 1500
AMBIGUOUS = 0.05
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SMOOTH = 0.5
#: Weights are whole numbers of this part, so that sums don't depend on their order.
_SCALE = 1 << 20
#: What no letter is counts as a space; bytes beyond ASCII stand for themselves.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 for each of n languages, with distances as great as possible.

    Up to seven languages have the exhaustive code (all splits into two sides); more have columns
    drawn by a fixed seed, 15 bits for each doubling of the number.
    """
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 7:
        cuts = [[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(cuts, np.int8).T
    rng, bits = np.random.default_rng(20), 15 * int(np.ceil(np.log2(n)))
    best = None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(axis=1 - 1)) < n]
        gaps = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(n, dtype=int) * bits
        if best is None or gaps.min() > best[0]:
            best = gaps.min(), code
    return best[1]


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of every lower-cased text, and the offsets of the rows.

    Each text has two spaces behind it, so a trigram starts at each of its bytes and none holds a
    byte of another row.
    """
    padded = pa.array([(t or "").lower() + "  " for t in column.to_pylist()], pa.large_string())
    data, offs = utf8(padded)
    plain = _PLAIN[data].astype(np.uint32)
    codes = plain[:-2] * np.uint32(0x9E3779B1) + plain[1:-1] * np.uint32(0x85EBCA6B) + plain[2:] * np.uint32(0xC2B2AE35)
    codes ^= codes >> np.uint32(15)
    codes *= np.uint32(0x2C1B3C6D)
    codes >>= np.uint32(16)
    own = np.ones(len(codes), bool)
    ends = offs[1:-1]
    own[ends - 1] = own[ends - 2] = False
    return codes[own], offs - 2 * np.arange(len(offs))


@dataclass(frozen=True)
class Model:
    """Languages, their codewords, the classifiers' weights (in parts of _SCALE) and each bit's share in the loss."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, column: pa.Array) -> np.ndarray:
        codes, offs = _features(column)
        out = np.zeros((len(offs) - 1, self.weights.shape[1]), np.int64)
        full = np.flatnonzero(np.diff(offs))
        if len(full):
            step = 1 << 18  # texts are summed in pieces, so that a long one takes no more memory
            for at in range(0, len(codes), step):
                part = self.weights[codes[at : at + step]]
                first, last = np.searchsorted(offs, at, side="right") - 1, np.searchsorted(offs, min(at + step, len(codes)), side="left") - 1
                rows = np.arange(first, last + 1)
                rows = rows[offs[rows + 1] > offs[rows]]
                out[rows] += np.add.reduceat(part, np.maximum(offs[rows] - at, 0), axis=0, dtype=np.int64)
        return out / (np.maximum(np.diff(offs), 1) * float(_SCALE))[:, None]

    def losses(self, column: pa.Array) -> np.ndarray:
        """The loss of each language's codeword, for each text."""
        m = np.clip(self.margins(column), -4, 4)
        return np.stack([(self.trust * np.exp(-row * m)).sum(axis=1) for row in self.code.astype(float)], axis=1) / max(self.trust.sum(), 1e-12)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1) and whether the answer is ambiguous, for each text."""
        if not self.languages:
            n = len(texts)
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        loss = self.losses(texts)
        best = loss.argmin(axis=1)
        order = np.sort(loss, axis=1)
        if loss.shape[1] > 1:
            score = order[:, 1] / np.maximum(order[:, 0] + order[:, 1], 1e-300)
            close = order[:, 1] - order[:, 0] < AMBIGUOUS * order[:, 0]
        else:
            score, close = np.ones(len(best)), np.zeros(len(best), bool)
        letters = np.array([bool(_LETTER.search(t or "")) for t in texts.to_pylist()], bool)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        return names, np.where(letters, score, 0.0), np.where(letters, close, True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            codes, offs = _features(part.column(1))
            for i, lang in enumerate(part.column(0).to_pylist()):
                totals.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                totals[lang] += np.bincount(codes[offs[i] : offs[i + 1]], minlength=DIMENSIONS)
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["lang", "counts"])


def _sum(table: pa.Table) -> pa.Table:
    total = sum((np.frombuffer(x.as_py(), np.int64) for x in table.column("counts")), np.zeros(DIMENSIONS, np.int64))
    return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def bounded_sample(labelled: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """At most about ``per_language`` (doc_id, lang, text) rows of each language, by a hash of doc_id.

    The number of a language's rows sets the share of hashes that it may use.
    """
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language, as the model has
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    chosen = F.lit(False)
    for row in sizes:
        chosen = chosen | ((F.col("lang") == row["lang"]) & (share < per_language / row["n"]))
    return labelled.where(chosen)


def train(labelled: DataFrame, per_language: int = SAMPLE) -> Model:
    """Fit the classifiers on a bounded sample of (doc_id, lang, text) rows with a language.

    Only texts with a letter count. Spark sums the n-gram counts of the sample by language; the
    driver gets one array of 65,536 counts a language. Without any labelled text the model has no
    languages and answers ``und``.
    """
    useful = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sample = bounded_sample(useful, per_language).where(F.col("text").rlike(r"\p{L}"))
    rows = sample.select("lang", "text").mapInArrow(_counts, "lang string, counts binary").groupBy("lang").applyInArrow(_sum, "lang string, counts binary").collect()
    rows.sort(key=lambda r: r["lang"])
    if not rows:
        return Model((), np.zeros((0, 0), np.int8), np.zeros((DIMENSIONS, 0), np.int32), np.zeros(0))
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in rows], float)
    p = (counts + _SMOOTH / 16) / (counts + _SMOOTH / 16).sum(axis=1, keepdims=True)
    code = codewords(len(rows))
    weights, trust = np.zeros((DIMENSIONS, code.shape[1])), np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        one, other = p[code[:, b] > 0], p[code[:, b] < 0]
        if len(one) and len(other):
            w = np.log(one.mean(axis=0)) - np.log(other.mean(axis=0))
            usual = p @ w * code[:, b]  # each language's mean margin on its side
            w = w - ((p[code[:, b] > 0] @ w).mean() + (p[code[:, b] < 0] @ w).mean()) / 2
            usual = p @ w * code[:, b]
            weights[:, b] = w / max(np.abs(usual).mean(), 1e-9)
            trust[b] = max(usual.min() / max(np.abs(usual).mean(), 1e-9), 0.05)
        else:
            weights[:, b], trust[b] = code[0, b], 1.0
    return Model(tuple(r["lang"] for r in rows), code, np.round(weights * _SCALE).astype(np.int32), trust)


def identify(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """Add the three columns named in ``out``: language, score, and whether it is ambiguous.

    Other columns stay, those of the new names are replaced. Whole texts are read, and a text's
    result depends on nothing but the text and the model: equal texts have equal results in any
    order, batch and partition. A null text, or one without a letter, has ``und``, score 0, ambiguous.
    Of codewords with equal losses the language first by name is taken, and the text is ambiguous.
    """
    new = [T.StructField(n, t) for n, t in zip(out, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    kept = docs.drop(*(f.name for f in new)).schema.fields
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 500):
                batch = whole.slice(at, 500)
                lang, score, close = model.predict(batch.column(text))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], [*names, *(f.name for f in new)])

    return docs.drop(*(f.name for f in new)).mapInArrow(run, T.StructType([*kept, *new]))


def held_out() -> Column:
    """Whether a document is never learnt from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each document, learnt from the others."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang").withColumn("held_out", held_out())
    model = train(rows.where("NOT held_out AND doc_id IS NOT NULL"))
    return identify(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
