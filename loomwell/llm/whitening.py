"""Embedding whitening by shifted Cholesky QR over distributed Gram passes.

Entries become whole numbers, floor(SCALE * entry) + OFFSET, so that equal vectors are told, sums are
exact and every row is centred before anything is multiplied. The centred rows A of the distinct
vectors are never gathered. A pass takes the rows through the triangular solves of the factors so
far and adds up their Gram matrix, d * d numbers a task, in two steps; the driver factors it, with a
shift in the first pass and where it isn't positive definite, and the factor joins the next pass.
Rows are orthonormal after some three passes. The product R of the factors (closed by the root of
the last Gram matrix, which is the identity but for directions without variance) has A'A = R'R, so
the singular values and right vectors of R give the covariance's eigenvalues and components without
squaring the condition of A.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.runtime import materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Passes at most, and how near to the identity the last Gram matrix is to be.
PASSES, ORTHONORMAL = 8, 1e-13
#: A direction whose deviation is below this part of the greatest has no variance but rounding.
NO_VARIANCE = 1e-11
_EPS = float(np.finfo(float).eps) / 2
_MOST = float(1 << 61)


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with whole means and the rest of their sums; unit components in columns, by falling eigenvalue."""

    n: int
    mean: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int
    identity_error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.mean, self.rest) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - S)**2, exact; null where a long doesn't hold it."""
        gaps = x - self.mean
        most = self.n * (int(np.abs(gaps).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * gaps - self.rest) ** 2).sum(axis=1).tolist()
        rows = [sum((self.n * int(g) - int(r)) ** 2 for g, r in zip(row, self.rest)) for row in gaps]
        return [v if v < 1 << 63 else None for v in rows]


def centred(x: np.ndarray, n: int, mean: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S / n, with S = n * mean + rest in whole numbers."""
    return (x - mean).astype(float) - rest / n


def numbers(df: DataFrame, column: str = "embedding", out: str = "_x") -> DataFrame:
    """Rows with ``out``, the vector in whole numbers; rows that take no part go.

    Those are: null and empty vectors, null and non-finite entries, entries beyond 2**61 / SCALE (no
    long for them), and vectors of another than the usual length (the most frequent, ties: the longest).
    """
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda e: F.coalesce(F.abs(e) < _MOST / SCALE, F.lit(False)))
    kept = df.where(v.isNotNull() & (F.size(v) > 0) & fine).withColumn(out, F.transform(v, lambda e: F.floor(e * SCALE) + F.lit(OFFSET)))
    usual = kept.groupBy(F.size(out).alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("u")).first()["u"]
    return kept.where(F.size(out) == usual["d"]) if usual is not None else kept.where(F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rows(total: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(kind))], ["i", "row"])


def _sum_rows(table: pa.Table) -> pa.Table:
    total = _matrix(table.column("row").combine_chunks()).sum(axis=0)
    return pa.table({"i": table.column("i")[:1], "row": pa.array([total], table.schema.field("row").type)})


def _total(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], whole: bool = False) -> np.ndarray:
    """The sum of ``part`` over blocks of the distinct vectors: a matrix a task, summed by lots, then by rows.

    The driver gets one matrix, whatever the number of vectors.
    """
    kind, name = (pa.int64(), "bigint") if whole else (pa.float64(), "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64 if whole else float)
        for batch in batches:
            total += part(_matrix(batch.column(0)))
        yield _rows(total, kind)

    schema = f"i int, row array<{name}>"
    partial = df.select("_x").mapInArrow(run, schema).groupBy("i", (F.spark_partition_id() % 64).alias("lot")).applyInArrow(_sum_rows, schema)
    out = np.zeros(shape, np.int64 if whole else float)
    for row in partial.groupBy("i").applyInArrow(_sum_rows, schema).collect():  # a matrix of d rows
        out[row["i"]] = row["row"]
    return out


def _solved(q: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """q times the inverses of upper triangular factors, by substitution, column after column for all rows."""
    for r in factors:
        for j in range(r.shape[1]):
            q[:, j] = (q[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor, with a shift of the diagonal that grows until there is one."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, _EPS * max(float(np.trace(gram)), 1e-300))


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``_x`` (see ``numbers``), each counted once; None without any.

    Fewer components than asked for come out where fewer directions have variance: none where all
    vectors are equal.
    """
    distinct = materialize(x.select("_x").distinct(), "whitening-distinct")
    n = distinct.count()
    if not n:
        return None
    d = distinct.select(F.size("_x").alias("d")).first()["d"]
    # Sums of the numbers' quotients and remainders by 2**20: exact, and far from a long's end.
    low, high = _total(distinct, lambda m: np.stack([(m & 0xFFFFF).sum(axis=0), (m >> 20).sum(axis=0)]), (2, d), whole=True)
    sums = [int(a) + (int(b) << 20) for a, b in zip(low, high)]
    mean, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)

    factors: list[np.ndarray] = []
    while True:
        gram = _total(distinct, lambda m: (lambda q: q.T @ q)(_solved(centred(m, n, mean, rest), factors)), (d, d))
        if not factors:
            trace = float(np.trace(gram)) / n
        if not trace or len(factors) == PASSES or factors and np.abs(gram - np.eye(d)).max() <= ORTHONORMAL:
            break
        factors = [*factors, _factor(gram, 0.0 if factors else 11 * (n * d + d * (d + 1)) * _EPS * float(np.linalg.eigvalsh(gram)[-1]))]
    if not trace:
        none = np.zeros((d, 0))
        return Whitening(n, mean, rest, none, none[0], 0.0, 1, 0.0)
    w, u = np.linalg.eigh(gram)
    r = (u * np.sqrt(np.maximum(w, 0))) @ u.T
    for factor in reversed(factors):
        r = r @ factor
    _, sigma, vt = np.linalg.svd(r)
    k = min(components, int((sigma > NO_VARIANCE * sigma[0]).sum()))
    v = vt[:k].T * np.where(vt[:k][np.arange(k), np.abs(vt[:k]).argmax(axis=1)] < 0, -1.0, 1.0)
    model = Whitening(n, mean, rest, v, sigma[:k] ** 2 / n, trace, len(factors), 0.0)
    own = _total(distinct, lambda m: (lambda q: q.T @ q)(model.whitened(m)), (k, k))
    return Whitening(n, mean, rest, v, sigma[:k] ** 2 / n, trace, len(factors), float(np.abs(own / n - np.eye(k)).max()))


def _mapped(x: DataFrame, fields: list[T.StructField], add: Callable[[np.ndarray], list[pa.Array]]) -> DataFrame:
    kept = x.drop("_x").schema.fields
    names, new = [f.name for f in kept], [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *add(_matrix(batch.column("_x")))], [*names, *new])

    return x.mapInArrow(run, T.StructType([*kept, *fields]))


def whiten(df: DataFrame, column: str = "embedding", components: int = COMPONENTS, out: str = "whitened") -> DataFrame:
    """df's rows whose vector takes part (see ``numbers``), with ``out``: its whitened components.

    Columns stay, but for ``out`` (replaced) and ``_x`` (reserved).
    """
    x = materialize(numbers(df.drop(out, "_x"), column), "whitening-numbers")
    model = fit(x, components)
    field = T.StructField(out, T.ArrayType(T.DoubleType()))
    if model is None:
        return x.drop("_x").withColumn(out, F.lit(None).cast(field.dataType))
    return _mapped(x, [field], lambda m: [pa.array(list(model.whitened(m)), pa.list_(pa.float64()))])


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each vector and component.

    Rows that take no part (see ``numbers``) have none; repeated rows and vec_ids have their own, null
    vec_ids stay null. An empty table, or one whose vectors are all equal, gives an empty result.
    ``deviation`` is null where a long doesn't hold it. Other columns are ignored.
    """
    x = materialize(numbers(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).select("vec_id", "_x"), "whitening-numbers")
    model = fit(x)
    names = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
    if model is None:
        return x.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in names.items())).limit(0)
    k = len(model.eigenvalues)
    kinds = pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def told(m: np.ndarray) -> list[pa.Array]:
        return [pa.StructArray.from_arrays([pa.array(model.deviations(m), pa.int64()), pa.array(list(model.whitened(m)), pa.list_(pa.float64()))], fields=list(kinds))]

    field = T.StructField("_told", T.StructType([T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]))
    rows = _mapped(x, [field], told).select("vec_id", F.col("_told.deviation").alias("deviation"), F.posexplode("_told.whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)), F.col("at") + 1) if k else F.lit(0.0)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
