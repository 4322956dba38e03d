"""Approximate nearest neighbours by inner product: stable projections, kd-trees, a chi-square stop.

A greatest inner product is a least Euclidean distance once every candidate gets one more component,
sqrt(M**2 - |x|**2) with M the greatest norm, and queries 0. Vectors are projected to eight
dimensions by Gaussian (2-stable) directions, so the squared projected distance over the true one
is chi-square with eight degrees of freedom. Projections are indexed by kd-trees: one, built on a
bounded sample, cuts the space into cells; one in each block of a cell has leaves of some dozens of
rows. Leaves are visited in order of their projected distance, and their rows verified on the whole
vectors, until the projected distance is so great that a nearer row beyond it would have had a
probability below 1 - CONFIDENCE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwell.runtime import materialize

PROJECTED = 8
CONFIDENCE = 0.95
NEIGHBOURS = 20
EVERY = 20
#: Rows that the cells are fitted on, at most about; every row is indexed.
SAMPLE = 20_000
CELL = 4096
BLOCK = 8192
QUERY_BLOCK = 2048
LEAF = 48
_ROUNDING = 1e-12
_SEED = 11


def chi_square_cdf(x: np.ndarray) -> np.ndarray:
    """Chance that a chi-square variate with PROJECTED (even) degrees of freedom is below x."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.zeros_like(half)
    for i in range(PROJECTED // 2):
        total += term
        term = term * half / (i + 1)
    return 1 - np.exp(-half) * total


def _quantile(p: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(np.array(mid)) < p else (low, mid)
    return high


LIMIT = _quantile(CONFIDENCE)


def projection(dim: int) -> np.ndarray:
    """Directions for vectors of dim components and the one added."""
    return np.random.default_rng([_SEED, dim]).standard_normal((dim + 1, PROJECTED))


def _lifted(vectors: np.ndarray, greatest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(greatest**2 - (vectors * vectors).sum(axis=1), 0.0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


class Tree:
    """A kd-tree over points: leaves as runs of ``order`` with their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        runs: list[tuple[int, int]] = []

        def split(a: int, b: int) -> None:
            p = points[self.order[a:b]]
            spread = p.max(axis=0) - p.min(axis=0) if b > a else np.zeros(points.shape[1])
            axis = int(spread.argmax())
            if b - a <= leaf or spread[axis] == 0:
                runs.append((a, b))
                return
            m = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(p[:, axis], m)]
            split(a, a + m)
            split(a + m, b)

        split(0, len(points))
        self.runs = np.array(runs, np.int64)
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in runs]) if len(points) else np.zeros((1, points.shape[1]))
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in runs]) if len(points) else np.zeros((1, points.shape[1]))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least squared distance from each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.low)))
        for d in range(queries.shape[1]):
            q = queries[:, d : d + 1]
            gap = np.maximum(np.maximum(self.low[:, d] - q, q - self.high[:, d]), 0)
            out += gap * gap
        return out


def _cell_of(cells: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The cell whose centre is nearest."""
    norms = (cells * cells).sum(axis=1)
    return np.concatenate([(norms - 2 * points[a : a + 4096] @ cells.T).argmin(axis=1) for a in range(0, len(points), 4096)]) if len(points) else np.zeros(0, int)


def _nearest(rows: pd.DataFrame, queries: pd.DataFrame, greatest: float, k: int) -> pd.DataFrame:
    """Each query's k best rows of one block, found through the block's kd-tree."""
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if rows.empty or queries.empty:
        return none
    ids, base = rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(float)
    asked, ask = queries["query_id"].to_numpy(), np.stack(queries["vector"].to_numpy()).astype(float)
    directions = projection(base.shape[1])
    tree = Tree(_lifted(base, greatest) @ directions, LEAF)
    ids, base = ids[tree.order], base[tree.order]
    bound = tree.bounds(np.concatenate([ask, np.zeros((len(ask), 1))], axis=1) @ directions)
    order = np.argsort(bound, axis=1)
    bound = np.take_along_axis(bound, order, axis=1)
    square = (ask * ask).sum(axis=1) + greatest**2  # squared distance = this - 2 * inner product
    kth = queries["kth"].to_numpy().astype(float).copy()
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query, row, score
    at, step = 0, 2
    while at < order.shape[1]:
        # All queries go on together: the next leaves of each, until its stopping test holds.
        reach = np.where(np.isfinite(kth), LIMIT * np.maximum(square - 2 * kth, 0.0), np.inf)
        q, place = np.nonzero(bound[:, at : at + step] <= reach[:, None])
        if not len(q):
            break
        leaf = order[q, at + place]
        by_leaf = np.argsort(leaf, kind="stable")
        q, leaf = q[by_leaf], leaf[by_leaf]
        edges = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
        hit_q, hit_row = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            first, last = tree.runs[leaf[a]]
            near = ask[q[a:b]] @ base[first:last].T  # up to rounding; what may count is summed again below
            i, j = np.nonzero(near >= kth[q[a:b], None] - _ROUNDING * square[q[a:b], None])
            hit_q.append(q[a:b][i])
            hit_row.append(first + j)
        hq, hr = np.concatenate(hit_q), np.concatenate(hit_row)
        other = ids[hr] != asked[hq]
        hq, hr = hq[other], hr[other]
        scores = np.concatenate([(base[hr[s : s + 20_000]] * ask[hq[s : s + 20_000]]).sum(axis=1) for s in range(0, len(hr), 20_000)] or [np.zeros(0)])
        hq, hr, scores = (np.concatenate(x) for x in zip(best, (hq, hr, scores)))
        rank = np.lexsort((ids[hr], -scores, hq))
        hq, hr, scores = hq[rank], hr[rank], scores[rank]
        nth = np.arange(len(hq)) - np.searchsorted(hq, hq, side="left")
        best = hq[nth < k], hr[nth < k], scores[nth < k]
        full = nth == k - 1
        kth[hq[full]] = np.maximum(kth[hq[full]], scores[full])
        at, step = at + step, min(step * 2, 64)
    hq, hr, scores = best
    return pd.DataFrame({"query_id": asked[hq], "vec_id": ids[hr], "score": scores})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the vectors that take part: not null, no null or non-finite component, not zero."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long"), vector.alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.coalesce(good, F.lit(False)) & F.exists("vector", lambda x: x != 0.0))


def _scaled(rows: DataFrame) -> tuple[DataFrame, float]:
    """The rows of the usual length, divided by a power of two where their squares would over- or underflow."""
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("top"))
    usual = sizes.agg(F.max(F.struct("n", "dim", "top")).alias("u")).first()["u"]
    if usual is None:
        return rows, 1.0
    rows = rows.where(F.size("vector") == usual["dim"])
    if 1e-120 < usual["top"] < 1e120:
        return rows, 1.0
    scale = float(2.0 ** int(np.frexp(usual["top"])[1]))
    return rows.withColumn("vector", F.transform("vector", lambda x: x / scale)).where(F.exists("vector", lambda x: x != 0.0)), scale


def search(embeddings: DataFrame, every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query, nearest first.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows but the query's
    own. Score: the inner product of the original vectors in double precision; ties go to the
    smaller vec_id. Each query first searches its own cell; its k-th score there tells which other
    cells the stopping test still lets it search. Cells of more than BLOCK rows, and queries of a
    cell beyond QUERY_BLOCK, are dealt to several groups.

    Null, zero and non-finite vectors take no part, and neither do those of another length than most
    vectors have (of lengths that are as common, the greater counts). Components may be of any size:
    where their squares would overflow, all vectors are searched divided by a power of two, and a
    score too great for a double is infinite, ranked by its true size. Repeated vec_ids are rows of
    their own. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    rows, scale = _scaled(materialize(usable(embeddings), "ann-vectors"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("greatest"), F.min(F.size("vector")).alias("dim")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not seen["n"]:
        return spark.createDataFrame([], schema)
    greatest, directions = float(seen["greatest"]) * (1 + 1e-9), projection(seen["dim"])
    share = min(1.0, SAMPLE / seen["n"])
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("vector").toPandas()
    points = _lifted(np.stack(sample["vector"].to_numpy()).astype(float), greatest) @ directions if len(sample) else np.zeros((1, PROJECTED))
    coarse = Tree(points, max(16, int(CELL * share)))
    centres = np.array([points[coarse.order[a:b]].mean(axis=0) for a, b in coarse.runs])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.stack([np.array(x, float) for x in b.column(1).to_pylist()])
                p = _lifted(v, greatest) @ directions
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_cell_of(centres, p), pa.int32()), pa.array(list(p), pa.list_(pa.float64()))], ["vec_id", "vector", "cell", "point"])

    placed = materialize(rows.mapInArrow(assign, "vec_id long, vector array<double>, cell int, point array<double>"), "ann-cells")
    # A box around all rows of each cell: as many rows as there are cells.
    sides = [f(F.col("point")[d]).alias(f"{n}{d}") for d in range(PROJECTED) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *sides).collect()
    names = np.array([b["cell"] for b in boxes])
    low = np.array([[b[f"lo{d}"] for d in range(PROJECTED)] for b in boxes])
    high = np.array([[b[f"hi{d}"] for d in range(PROJECTED)] for b in boxes])
    lots = {b["cell"]: -(-b["n"] // BLOCK) for b in boxes}
    lot_of = F.create_map(*[F.lit(x) for c, m in lots.items() for x in (c, m)]) if len(lots) <= 2000 else None
    if lot_of is None:
        counts = spark.createDataFrame(list(lots.items()), "cell int, lots int")
        placed = placed.join(counts, "cell")
    else:
        placed = placed.withColumn("lots", F.element_at(lot_of, F.col("cell")))
    index = placed.select("cell", F.pmod(F.xxhash64("vec_id"), F.col("lots")).cast("int").alias("lot"), "vec_id", "vector")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector")

    def near_cells(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v = np.stack([np.array(x, float) for x in b.column(1).to_pylist()])
                p = np.concatenate([v, np.zeros((len(v), 1))], axis=1) @ directions
                bound = np.zeros((len(v), len(names)))
                for d in range(PROJECTED):
                    gap = np.maximum(np.maximum(low[:, d] - p[:, d : d + 1], p[:, d : d + 1] - high[:, d]), 0)
                    bound += gap * gap
                home = bound.argmin(axis=1)
                if first:
                    row, cell = np.arange(len(v)), home
                else:
                    kth = b.column(2).to_numpy(zero_copy_only=False)
                    reach = LIMIT * np.maximum((v * v).sum(axis=1) + greatest**2 - 2 * kth, 0)
                    wanted = ~(bound > np.where(np.isfinite(kth), reach, np.inf)[:, None])
                    wanted[np.arange(len(v)), home] = False
                    row, cell = np.nonzero(wanted)
                kths = np.full(len(row), -np.inf) if first else kth[row]
                for at in range(0, len(row), 5000):
                    r = row[at : at + 5000]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r)), pa.array(names[cell[at : at + 5000]], pa.int32()), pa.array(kths[at : at + 5000])], ["query_id", "vector", "cell", "kth"])

        return run

    def visit(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInArrow(near_cells(first), "query_id long, vector array<double>, cell int, kth double")
        sent = materialize(sent, "ann-visits")
        parts = sent.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
        sent = sent.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        cells = spark.createDataFrame(list(lots.items()), "cell int, lots int")
        sent = sent.join(cells, "cell").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots", "parts")
        blocks = index.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        key = ["cell", "lot", "part"]
        return blocks.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(lambda r, q: _nearest(r, q, greatest, k), "query_id long, vec_id long, score double")

    home = materialize(_best(visit(queries, True), k).drop("rank"), "ann-home")
    kth = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("kth"))
    again = queries.join(kth, "query_id", "left").select("query_id", "vector", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    found = home.unionByName(visit(again, False))
    score = F.col("score") if scale == 1.0 else F.col("score") * scale * scale
    return _best(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", score.alias("score"))
