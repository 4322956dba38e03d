"""Document fingerprints by consistent weighted sampling.

Terms are five-word shingles weighted by their number of occurrences. For each term and each of
``SAMPLES`` positions the method draws r and c from Gamma(2, 1) and beta uniformly, by hashing, and
keeps the term whose variate c * exp(-r * (t - beta) - r) with t = floor(ln(weight) / r + beta) is
least. Two texts keep the same (term, t) with a probability equal to their generalised Jaccard
similarity, sum(min weights) / sum(max weights).

r is the sum of two exponential variates and beta one's share of it, so that for weight 1 the
variate is c times one uniform number. The least variate itself tells (term, t), because it
depends on nothing else; 16 bits of it make one of the signature's positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwell.llm.text import mix, shingle_hashes
from loomwell.runtime import materialize, partitions_for

SAMPLES = 64
_TERMS = 1 << 15
_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_24, _16 = np.float32(2.0**-24), np.float32(2.0**-16)


def _mix32(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _unit(x: np.ndarray, scale: np.float32) -> np.ndarray:
    u = x.view(np.int32).astype(np.float32)
    u += np.float32(0.5)
    u *= scale
    return u


def _variates(low: np.ndarray, high: np.ndarray, weights: np.ndarray, heavy: np.ndarray, k: int) -> np.ndarray:
    """The variate of each term, given by the halves of its hash; weights: those at the places in heavy, elsewhere 1."""
    seed = _SEEDS[k : k + 1].view(np.uint32)
    x = _mix32(low * (seed[0] | np.uint32(1)) + high)
    y = _mix32((high ^ seed[1]) + x * np.uint32(0x9E3779B1))
    u1 = _unit(x >> np.uint32(8), _24)
    c = _unit(y >> np.uint32(16), _16)
    c *= _unit(y & np.uint32(0xFFFF), _16)
    np.log(c, out=c)
    np.negative(c, out=c)
    a = c * u1
    if len(heavy):
        z = mix((x[heavy].astype(np.uint64) << np.uint64(32)) | y[heavy])
        w = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        r = w - np.log(u1[heavy].astype(np.float64))
        t = np.floor(np.log(weights) / r + w / r)
        later = t > 0
        a[heavy[later]] = (c[heavy] * np.exp(w - r * (t + 1)))[later].astype(np.float32)
    return a


def signatures(column: pa.Array) -> np.ndarray:
    """One row of SAMPLES 16-bit positions for each text; all 0 for a text without words."""
    values, offs = shingle_hashes(column)
    n = len(offs) - 1
    out = np.zeros((n, SAMPLES), np.uint16)
    group, size, first = [], 0, 0
    for i in range(n):
        v = values[offs[i] : offs[i + 1]]
        group.append(_counted(v))
        size += len(v)
        if size >= _TERMS or i == n - 1:
            _fill(out[first : i + 1], group)
            group, size, first = [], 0, i + 1
    return out


def _counted(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.sort(v)
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    return v[at], np.diff(at, append=len(v))


def _fill(out: np.ndarray, group: list) -> None:
    lengths = np.array([len(u) for u, _ in group])
    some = np.flatnonzero(lengths)
    if not len(some):
        return
    terms = np.concatenate([u for u, _ in group])
    weights = np.concatenate([c for _, c in group])
    # A term of weight 1 has the same variates in every text, and neighbours share many terms.
    light = weights == 1
    shared, place = np.unique(terms[light], return_inverse=True)
    index = np.empty(len(terms), np.int64)
    index[light] = place
    index[~light] = np.arange(len(shared), len(shared) + len(terms) - len(place))
    terms, weights = np.concatenate([shared, terms[~light]]), np.concatenate([np.ones(len(shared), np.int64), weights[~light]])
    heavy = np.arange(len(shared), len(terms))
    starts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
    low, high = terms.astype(np.uint32), (terms >> np.uint64(32)).astype(np.uint32)
    for k in range(SAMPLES):
        least = np.minimum.reduceat(_variates(low, high, weights[heavy], heavy, k)[index], starts)
        out[some, k] = (mix(least.view(np.uint32).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal positions of two signature matrices, row by row: the estimated similarity."""
    return (a == b).mean(axis=1)


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add a column with the hexadecimal fingerprint of ``text``.

    Null and empty texts, and texts without words, get the all-zero fingerprint; equal texts get
    equal ones. An existing column named ``out`` is replaced; other columns are kept.
    """
    schema = [f for f in df.drop(out).schema.fields]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = signatures(batch.column(text))
            hexes = pa.array([row.tobytes().hex() for row in sig], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), hexes], [*names, out])

    from pyspark.sql.types import StringType, StructField, StructType

    return df.drop(out).mapInArrow(run, StructType([*schema, StructField(out, StringType())]))


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many code points of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "kind int, pid int, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
_ARROW = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
_DONE, _HEAD, _TAIL = 0, 1, 2
_ROWS = 64


def _compared(ids: list, texts: list[str], changed: list[str], sigs: np.ndarray, other: np.ndarray, next_sigs: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([_DONE] * n, pa.int32()),
            pa.array([0] * n, pa.int32()),
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([r.tobytes() for r in sigs], pa.binary()),
            pa.array([r.tobytes() for r in other], pa.binary()),
            pa.array(likeness(sigs, other), pa.float64()),
            pa.array(likeness(sigs, next_sigs), pa.float64()),
            pa.nulls(n, pa.string()),
        ],
        schema=_ARROW,
    )


def _edge(kind: int, pid: int, doc_id, text: str, sig: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([pid], pa.int32()), pa.array([doc_id], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([sig.tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.array([text], pa.string())], schema=_ARROW)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid, held = TaskContext.get().partitionId(), None
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            if held is not None:
                ids, texts, known = [held[0], *ids], [held[1], *texts], held[2][None]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
            mixed = [t for pair in zip(texts[1:], changed) for t in pair]  # each edited text beside its parts
            both = signatures(pa.array(([] if held else texts[:1]) + mixed, pa.string()))
            own = known if held else both[:1]
            both = both if held else both[1:]
            sigs = np.vstack([own, both[0::2]])
            if held is None:
                yield _edge(_HEAD, pid, ids[0], texts[0], sigs[0])
            if changed:
                yield _compared(ids[:-1], texts[:-1], changed, sigs[:-1], both[1::2], sigs[1:])
            held = ids[-1], texts[-1], sigs[-1]
    if held is not None:
        yield _edge(_TAIL, pid, *held)


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            d = b.to_pydict()
            sigs = [np.frombuffer(b"".join(d[c]), np.uint16).reshape(-1, SAMPLES) for c in ("fingerprint", "next_fingerprint")]
            changed = [edited(x or "", y or "") for x, y in zip(d["text"], d["next_text"])]
            yield _compared(d["doc_id"], [t or "" for t in d["text"]], changed, sigs[0], signatures(pa.array(changed, pa.string())), sigs[1])


def against_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited text, and compare both and the next document's.

    The next document is the one that follows in descending order of doc_id (ties: by a hash of the
    text, then ascending text; null ids come last), and the first follows the last. Documents are
    dealt out once by ranges of doc_id and that hash, as many as their size asks for, so that many
    rows of one id, or none, make no large range; each task walks its range in order, and only one row at each end of a range goes
    through a second, small join. Null text counts as empty. An empty table gives an empty result;
    extra columns are ignored.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions_for(docs, "text"), *order[:2]).sortWithinPartitions(*order)
    walked = materialize(dealt.mapInArrow(_walk, _OUT), "fingerprints")
    heads = walked.where(F.col("kind") == _HEAD)
    w = Window.orderBy("pid")  # one narrow row for each partition
    follows = heads.select("pid", F.lead("pid").over(w).alias("after"), F.first("pid").over(w).alias("first")).select("pid", F.coalesce("after", "first").alias("next_pid"))
    ends = (
        walked.where(F.col("kind") == _TAIL)
        .select("pid", "doc_id", "text", "fingerprint")
        .join(follows, "pid")
        .join(heads.select(F.col("pid").alias("next_pid"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")), "next_pid")
        .mapInArrow(_join_edges, _OUT)
    )
    return (
        walked.where(F.col("kind") == _DONE)
        .unionByName(ends)
        .select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
    )
