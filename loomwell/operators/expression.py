"""Counts, normalisation, contrasts and differential-expression tables. Counts stay in long form."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import columns as C
from loomwell.runtime import materialize

GENE_META = "__"
# The counter's own rows.
META = ("__no_feature", "__ambiguous", "__too_low_aQual", "__not_aligned", "__alignment_not_unique")


def drop_meta_rows(counts: DataFrame) -> DataFrame:
    """Without the counter's own rows (``__no_feature`` and the like)."""
    return counts.where(~F.col("gene_id").startswith(GENE_META))


def filter_low_expression(counts: DataFrame, min_mean: float = 10) -> DataFrame:
    """Genes whose mean over all samples, absent ones as 0, is min_mean or more; if none is, all."""
    samples = counts.agg(F.countDistinct("sample_id").alias("samples"))
    means = counts.groupBy("gene_id").agg(F.sum("count").alias("total")).join(F.broadcast(samples))
    marked = means.select("gene_id", (F.col("total") / F.col("samples") >= min_mean).alias("high"))
    some = marked.agg(F.coalesce(F.bool_or("high"), F.lit(False)).alias("some"))
    kept = marked.join(F.broadcast(some)).where(F.col("high") | ~F.col("some")).select("gene_id")
    return counts.join(kept, "gene_id", "left_semi")


def library_sizes(counts: DataFrame, design: DataFrame | None = None) -> DataFrame:
    """Size of each sample, rank by size, mean, and whether it lies under mean - 2 * sd; with its group, by a design."""
    sizes = counts.groupBy("sample_id").agg(F.sum("count").alias("size"))
    stats = sizes.agg(F.avg("size").alias("mean_size"), F.stddev_samp("size").alias("sd"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "sample_id")  # one row a sample
    if design is not None:
        sizes = sizes.join(design.select("sample_id", "grp").distinct(), "sample_id", "left")
    return sizes.join(F.broadcast(stats)).select(*sizes.columns, F.row_number().over(order).alias("rank"), "mean_size", (F.col("size") < F.col("mean_size") - 2 * F.col("sd")).alias("low_outlier"))


def count_qc(counts: DataFrame) -> DataFrame:
    """Assigned counts and the share of each meta category, for each sample."""
    meta = F.col("gene_id").startswith(GENE_META)
    total = F.sum("count")

    def share(name: str) -> Column:
        return (F.sum(F.when(F.col("gene_id") == name, F.col("count")).otherwise(0)) / total).alias(name.strip("_") + "_share")

    return counts.groupBy("sample_id").agg(F.sum(F.when(~meta, F.col("count")).otherwise(0)).alias("assigned"), *map(share, META))


def count_matrix(counts: DataFrame, samples: list[str]) -> DataFrame:
    """One row a gene and one column for each of the given samples; absent counts are 0."""
    if len(samples) > 5000:
        raise ValueError("too many samples for a wide table; keep the long form")
    return counts.groupBy("gene_id").pivot("sample_id", samples).agg(F.sum("count")).na.fill(0, samples)


def tmm_factors(counts: DataFrame, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """(sample_id, lib, factor): trimmed means of M values against a reference sample; product 1.

    The reference is the sample whose upper quartile of count / lib is nearest to the mean one
    (ties: first name). Genes counted in both samples take part. Ranks are average ranks.
    """
    counts = materialize(counts.select("sample_id", "gene_id", "count"), "tmm-counts")  # read five times below
    libs = counts.groupBy("sample_id").agg(F.sum("count").alias("lib"))
    scaled = counts.where("count > 0").join(F.broadcast(libs), "sample_id")
    quartiles = scaled.groupBy("sample_id").agg(F.percentile(F.col("count") / F.col("lib"), F.lit(0.75)).alias("q"))
    mean = quartiles.agg(F.avg("q").alias("mq"))
    ref = quartiles.join(F.broadcast(mean)).agg(F.min(F.struct(F.round(F.abs(F.col("q") - F.col("mq")), 12).alias("gap"), "sample_id")).alias("best")).select(F.col("best.sample_id").alias("ref"))
    of_ref = scaled.join(F.broadcast(ref), F.col("sample_id") == F.col("ref")).select("gene_id", F.col("count").alias("yr"), F.col("lib").alias("nr"))
    yk, nk, yr, nr = (F.col(c).cast("double") for c in ("count", "lib", "yr", "nr"))
    pairs = scaled.join(of_ref, "gene_id").select(
        "sample_id",
        F.log2((yk / nk) / (yr / nr)).alias("m"),
        (F.log2((yk / nk) * (yr / nr)) / 2).alias("a"),
        (1 / ((nk - yk) / (nk * yk) + (nr - yr) / (nr * yr))).alias("w"),
    )
    own = Window.partitionBy("sample_id")

    def rank(c: str) -> Column:
        value = F.round(c, 12)
        return F.rank().over(own.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy("sample_id", value)) - 1) / 2

    ranked = pairs.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("rm", rank("m")).withColumn("ra", rank("a"))
    low_m, low_a = F.floor(F.col("n") * trim_m) + 1, F.floor(F.col("n") * trim_a) + 1
    kept = ranked.where(F.col("rm").between(low_m, F.col("n") + 1 - low_m) & F.col("ra").between(low_a, F.col("n") + 1 - low_a))
    raw = kept.groupBy("sample_id").agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("lf"), F.max(F.abs("m")).alias("top"))
    raw = libs.join(raw, "sample_id", "left").withColumn("lf", F.when(F.coalesce("top", F.lit(0.0)) < 1e-6, 0.0).otherwise(F.col("lf")))
    centre = raw.agg(F.avg("lf").alias("centre"))
    return raw.join(F.broadcast(centre)).select("sample_id", "lib", F.pow(F.lit(2.0), F.col("lf") - F.col("centre")).alias("factor"))


def cpm(counts: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Adds ``cpm``: 1e6 * count / (lib * factor); factors of (sample_id, lib, factor), else all 1."""
    if factors is None:
        factors = counts.groupBy("sample_id").agg(F.sum("count").alias("lib")).withColumn("factor", F.lit(1.0))
    return counts.join(F.broadcast(factors), "sample_id").withColumn("cpm", 1e6 * F.col("count") / (F.col("lib") * F.col("factor"))).select(*counts.columns, "cpm")


def log_cpm(counts: DataFrame, factors: DataFrame | None = None, prior: float = 2.0) -> DataFrame:
    """Adds ``log_cpm``: log2 of counts a million with a prior count in proportion to each library's size."""
    if factors is None:
        factors = counts.groupBy("sample_id").agg(F.sum("count").alias("lib")).withColumn("factor", F.lit(1.0))
    sized = factors.withColumn("_lib", F.col("lib") * F.col("factor"))
    sized = sized.join(F.broadcast(sized.agg(F.avg("_lib").alias("_mean")))).select("sample_id", "_lib", (prior * F.col("_lib") / F.col("_mean")).alias("_prior"))
    value = F.log2((F.col("count") + F.col("_prior")) / (F.col("_lib") + 2 * F.col("_prior")) * 1e6)
    return counts.join(F.broadcast(sized), "sample_id").withColumn("log_cpm", value).select(*counts.columns, "log_cpm")


def ave_log_cpm(counts: DataFrame, factors: DataFrame | None = None, prior: float = 2.0) -> DataFrame:
    """(gene_id, ave_log_cpm): log2 of the mean, over all samples, of counts a million with that prior; absent counts are 0."""
    if factors is None:
        factors = counts.groupBy("sample_id").agg(F.sum("count").alias("lib")).withColumn("factor", F.lit(1.0))
    sized = factors.withColumn("_lib", F.col("lib") * F.col("factor"))
    sized = sized.join(F.broadcast(sized.agg(F.avg("_lib").alias("_mean")))).withColumn("_prior", prior * F.col("_lib") / F.col("_mean"))
    unit = 1e6 / (F.col("_lib") + 2 * F.col("_prior"))
    every = sized.agg(F.sum(F.col("_prior") * unit).alias("_base"), F.count(F.lit(1)).alias("_samples"))
    sums = counts.join(F.broadcast(sized.select("sample_id", unit.alias("_unit"))), "sample_id").groupBy("gene_id").agg(F.sum(F.col("count") * F.col("_unit")).alias("_sum"))
    return sums.join(F.broadcast(every)).select("gene_id", F.log2((F.col("_sum") + F.col("_base")) / F.col("_samples")).alias("ave_log_cpm"))


def log_count_values(counts: DataFrame) -> DataFrame:
    """Adds log2, natural and decimal logarithms of count + 1, ln(count) (null for 0), and those of cpm + 1 (log10, log2)."""
    x, c = F.col("count") + 1, F.col("cpm") + 1
    logs = {"log2_count": F.log2(x), "ln_count": F.log(x.cast("double")), "log10_count": F.log10(x.cast("double")), "ln_positive": F.when(F.col("count") > 0, F.log(F.col("count").cast("double"))), "log10_cpm": F.log10(c), "log2_cpm": F.log2(c)}
    return cpm(counts).withColumns(logs).drop("cpm")


def log_counts(counts: DataFrame, bins: int = 20, high: float = 20.0) -> DataFrame:
    """Histogram of log2(cpm + 1) for each sample."""
    at = F.width_bucket(F.log2(F.col("cpm") + 1), F.lit(0.0), F.lit(high), F.lit(bins))
    return cpm(counts).groupBy("sample_id", at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Samples of a block, and genes whose vectors are multiplied together; blocks of MDS are smaller, as each pair keeps its greatest gaps.
SAMPLES, GENES, MDS_SAMPLES = 512, 2048, 64


def _blocked(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame, int]:
    """Each gene's vector by blocks of samples: (gene_id, block, at, x), samples (sample_id, place), and the number of lots of genes.

    ``rows`` has (sample_id, gene_id, x). There is one row for a gene and block, and one for a sample.
    """
    samples = rows.select("sample_id").distinct().withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("sample_id")) - 1)  # one row a sample
    samples = materialize(samples, "sample-places")
    placed = rows.join(F.broadcast(samples), "sample_id").groupBy("gene_id", F.floor(F.col("place") / block).cast("int").alias("block"))
    vectors = placed.agg(F.collect_list(F.struct((F.col("place") % block).cast("int").alias("at"), "x")).alias("v"))
    vectors = materialize(vectors.select("gene_id", "block", F.col("v.at").alias("at"), F.col("v.x").alias("x")), "sample-vectors")
    return vectors, samples, max(1, math.ceil(vectors.select("gene_id").distinct().count() / GENES))


def _pairs_of_blocks(vectors: DataFrame, lots: int) -> DataFrame:
    """(one <= two, lot, at_a, x_a, at_b, x_b): a row for each gene and pair of its blocks."""
    a, b = (vectors.select("gene_id", F.col("block").alias(n), F.col("at").alias(f"at_{k}"), F.col("x").alias(f"x_{k}")) for k, n in (("a", "one"), ("b", "two")))
    return a.join(b, "gene_id").where("one <= two").select("one", "two", F.pmod(F.xxhash64("gene_id"), F.lit(lots)).cast("int").alias("lot"), "at_a", "x_a", "at_b", "x_b")


def _dense(at: pa.ChunkedArray, x: pa.ChunkedArray, block: int) -> np.ndarray:
    """Genes by samples of a block; NaN where a sample lacks a gene."""
    at, x = at.combine_chunks(), x.combine_chunks()
    out = np.full((len(at), block), np.nan)
    out[np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = x.flatten().to_numpy(zero_copy_only=False)
    return out


_SUMS = "one int, two int, lot int, sums binary"


def _packed(table: pa.Table, lot: int, sums: np.ndarray) -> pa.Table:
    return pa.table({"one": table.column("one")[:1], "two": table.column("two")[:1], "lot": pa.array([lot], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})


def _gram(rows: DataFrame, products: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], finish: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(sample_a < sample_b, value): sums of products over genes for all pairs of samples, block by block.

    ``products`` makes matrices of two blocks' vectors, which are added up over lots of genes, and
    ``finish`` a value of their sums (NaN: no row). No row is made for a pair and a gene.
    """
    vectors, samples, lots = _blocked(rows, SAMPLES)
    block = min(SAMPLES, max(1, samples.count()))

    def multiply(table: pa.Table) -> pa.Table:
        made = products(_dense(table.column("at_a"), table.column("x_a"), block), _dense(table.column("at_b"), table.column("x_b"), block))
        return _packed(table, table.column("lot")[0].as_py() // 16, np.stack(made))

    def add(table: pa.Table) -> pa.Table:
        return _packed(table, table.column("lot")[0].as_py() // 16, sum(np.frombuffer(x.as_py()) for x in table.column("sums")))

    def told(table: pa.Table) -> pa.Table:
        value = finish(sum(np.frombuffer(x.as_py()) for x in table.column("sums")).reshape(-1, block, block))
        one, two = (table.column(c)[0].as_py() * SAMPLES for c in ("one", "two"))
        i, j = np.nonzero(~np.isnan(value) & (np.arange(block)[:, None] + one < np.arange(block)[None, :] + two))
        return pa.table({"a": pa.array(i + one, pa.int64()), "b": pa.array(j + two, pa.int64()), "value": pa.array(value[i, j])})

    sums, left = _pairs_of_blocks(vectors, lots).groupBy("one", "two", "lot").applyInArrow(multiply, _SUMS), math.ceil(lots / 16)
    while left > 1:  # sixteen matrices meet in a task
        sums, left = sums.groupBy("one", "two", "lot").applyInArrow(add, _SUMS), math.ceil(left / 16)
    pairs = sums.groupBy("one", "two").applyInArrow(told, "a long, b long, value double")
    for k in "ab":
        pairs = pairs.join(F.broadcast(samples.select(F.col("place").alias(k), F.col("sample_id").alias(f"sample_{k}"))), k)
    return pairs.select("sample_a", "sample_b", "value")


def _shared_sums(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Over the genes that both samples have: their number, sums, squares and products."""
    in_a, in_b = (~np.isnan(m) * 1.0 for m in (a, b))
    a, b = np.nan_to_num(a), np.nan_to_num(b)
    return [in_a.T @ in_b, a.T @ in_b, in_a.T @ b, (a * a).T @ in_b, in_a.T @ (b * b), a.T @ b]


def _correlated(sums: np.ndarray) -> np.ndarray:
    n, a, b, aa, bb, ab = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.maximum(n * aa - a * a, 0) * np.maximum(n * bb - b * b, 0)
        return np.where(spread > 0, (n * ab - a * b) / np.sqrt(spread), np.nan)


def sample_correlation(values: DataFrame) -> DataFrame:
    """Spearman's correlation of all pairs of samples over the genes both have (average ranks), in blocks.

    Pairs with fewer than two common genes, or with one rank for all of them, have no row.
    """
    own, tie = Window.partitionBy("sample_id"), Window.partitionBy("sample_id", "cpm")
    ranked = values.select("sample_id", "gene_id", (F.rank().over(own.orderBy("cpm")) + (F.count(F.lit(1)).over(tie) - 1) / 2).alias("x"))
    return _gram(ranked, _shared_sums, _correlated).withColumnRenamed("value", "spearman")


def sample_distance(values: DataFrame) -> DataFrame:
    """Euclidean distance of all pairs of samples over log2(cpm + 1), absent genes as 0.

    By sums of squares and products in blocks, so a gene that one sample lacks needs no row.
    """
    rows = values.select("sample_id", "gene_id", F.log2(F.col("cpm") + 1).alias("x"))
    squares = rows.groupBy("sample_id").agg(F.sum(F.col("x") * F.col("x")).alias("ss"))
    dots = _gram(rows, lambda a, b: [np.nan_to_num(a).T @ np.nan_to_num(b)], lambda sums: sums[0])
    for k in "ab":
        dots = dots.join(F.broadcast(squares.select(F.col("sample_id").alias(f"sample_{k}"), F.col("ss").alias(f"ss_{k}"))), f"sample_{k}")
    return dots.select("sample_a", "sample_b", F.sqrt(F.greatest(F.lit(0.0), F.col("ss_a") + F.col("ss_b") - 2 * F.col("value"))).alias("distance"))


def leading_distance(values: DataFrame, top: int = 500) -> DataFrame:
    """(sample_a < sample_b, distance): root mean square of the ``top`` greatest differences over the genes both have.

    A task keeps the greatest gaps of its lot of genes for each pair of a block; the lots' lists of a block
    are then merged, sixteen at a time.
    """
    vectors, samples, lots = _blocked(values.select("sample_id", "gene_id", F.col("log_cpm").cast("double").alias("x")), MDS_SAMPLES)
    block = min(MDS_SAMPLES, max(1, samples.count()))

    def greatest(gaps: np.ndarray) -> np.ndarray:
        """The greatest along the first axis, absent ones (-1) last and padded."""
        kept = np.partition(gaps, len(gaps) - top, axis=0)[len(gaps) - top :] if len(gaps) > top else gaps
        return np.concatenate([kept, np.full((top - len(kept), *kept.shape[1:]), -1.0)])

    def gaps(table: pa.Table) -> pa.Table:
        a, b = (_dense(table.column(f"at_{k}"), table.column(f"x_{k}"), block) for k in "ab")
        out = np.stack([greatest(np.nan_to_num((a[:, i : i + 1] - b) ** 2, nan=-1.0)) for i in range(block)], axis=1)
        return _packed(table, table.column("lot")[0].as_py() // 16, out)

    def merge(table: pa.Table) -> np.ndarray:
        return greatest(np.concatenate([np.frombuffer(x.as_py()).reshape(top, block, block) for x in table.column("sums")]))

    def told(table: pa.Table) -> pa.Table:
        best = merge(table)
        one, two = (table.column(c)[0].as_py() * MDS_SAMPLES for c in ("one", "two"))
        n = (best >= 0).sum(axis=0)
        i, j = np.nonzero((n > 0) & (np.arange(block)[:, None] + one < np.arange(block)[None, :] + two))
        return pa.table({"a": pa.array(i + one, pa.int64()), "b": pa.array(j + two, pa.int64()), "value": pa.array(np.sqrt(np.maximum(best, 0).sum(axis=0)[i, j] / n[i, j]))})

    lists, left = _pairs_of_blocks(vectors, lots).groupBy("one", "two", "lot").applyInArrow(gaps, _SUMS), math.ceil(lots / 16)
    while left > 1:
        lists, left = lists.groupBy("one", "two", "lot").applyInArrow(lambda t: _packed(t, t.column("lot")[0].as_py() // 16, merge(t)), _SUMS), math.ceil(left / 16)
    pairs = lists.groupBy("one", "two").applyInArrow(told, "a long, b long, value double")
    for k in "ab":
        pairs = pairs.join(F.broadcast(samples.select(F.col("place").alias(k), F.col("sample_id").alias(f"sample_{k}"))), k)
    return pairs.select("sample_a", "sample_b", F.col("value").alias("distance"))


def sample_tree(distances: DataFrame, method: str = "average") -> DataFrame:
    """(step, left, right, height, size): merges of the samples by average or complete linkage.

    ``distances`` has (sample_a, sample_b, distance), one row a pair: some thousands of samples at most,
    whose tree one task makes. A merged group goes by its first sample's name; ties by name.
    """
    if method not in ("average", "complete"):
        raise ValueError("average or complete")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([rows["sample_a"], rows["sample_b"]]))
        far = np.full((len(names), len(names)), np.inf)
        i, j = np.searchsorted(names, rows["sample_a"]), np.searchsorted(names, rows["sample_b"])
        far[i, j] = far[j, i] = rows["distance"]
        size, out = np.ones(len(names), int), []
        for step in range(1, len(names)):
            i, j = sorted(divmod(int(far.argmin()), len(names)))
            height, both = far[i, j], size[i] + size[j]
            joined = (size[i] * far[i] + size[j] * far[j]) / both if method == "average" else np.maximum(far[i], far[j])
            far[i], far[:, i] = joined, joined
            far[i, i] = far[j] = far[:, j] = np.inf
            size[i] = both
            out.append((step, names[i], names[j], height, both))
        return pd.DataFrame(out, columns=["step", "left", "right", "height", "size"])

    return distances.groupBy().applyInPandas(merge, "step long, left string, right string, height double, size long")


def mds_coordinates(values: DataFrame, top: int = 500) -> DataFrame:
    """(sample_id, x, y) by classical scaling of leading log fold changes.

    ``values`` has (sample_id, gene_id, log_cpm) with a row for each sample and gene. The distance of
    two samples is the root mean square of their ``top`` greatest differences; the matrix of these,
    one row a pair of samples, is scaled in one task. The sign of an axis is that of its greatest part.
    """
    def scale(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([rows["sample_a"], rows["sample_b"]]))
        d = np.zeros((len(names), len(names)))
        i, j = np.searchsorted(names, rows["sample_a"]), np.searchsorted(names, rows["sample_b"])
        d[i, j] = d[j, i] = rows["distance"]
        centre = np.eye(len(names)) - 1 / len(names)
        values, vectors = np.linalg.eigh(-centre @ (d * d) @ centre / 2)
        order = np.argsort(-values)[:2]
        at = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
        at = np.pad(at, ((0, 0), (0, 2 - at.shape[1])))
        at *= np.where(at[np.abs(at).argmax(axis=0), range(2)] < 0, -1, 1)
        return pd.DataFrame({"sample_id": names, "x": at[:, 0], "y": at[:, 1]})

    return leading_distance(values, top).groupBy().applyInPandas(scale, "sample_id string, x double, y double")


def bcv_table(dispersions: DataFrame) -> DataFrame:
    """(gene_id, ave, bcv, trend, common): square roots of the dispersions against mean abundance."""
    root = lambda c, n: F.sqrt(c).alias(n)
    return dispersions.select("gene_id", "ave", root("dispersion", "bcv"), root("trended", "trend"), root("common", "common"))


def all_pairs(design: DataFrame) -> DataFrame:
    """All pairs of groups, by name, when no contrast is chosen."""
    g = design.select("grp").distinct()
    return g.select(F.col("grp").alias("group1")).join(g.select(F.col("grp").alias("group2")), F.col("group1") < F.col("group2"))


def mean_contrasts(counts: DataFrame, design: DataFrame) -> DataFrame:
    """(contrast, gene_id, logFC) of all pairs of groups, from mean CPM with a prior of 1."""
    sizes = design.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    means = cpm(counts).join(F.broadcast(design), "sample_id").groupBy("gene_id", "grp").agg(F.sum("cpm").alias("total")).join(F.broadcast(sizes), "grp").select("gene_id", "grp", (F.col("total") / F.col("n")).alias("m"))
    of_gene = means.groupBy("gene_id").agg(F.map_from_entries(F.collect_list(F.struct("grp", "m"))).alias("by_group"))

    def of(g: str) -> Column:
        return F.coalesce(F.element_at("by_group", F.col(g)), F.lit(0.0))

    return of_gene.join(F.broadcast(all_pairs(design))).select(F.concat_ws("_vs_", "group1", "group2").alias("contrast"), "gene_id", F.log2((of("group1") + 1) / (of("group2") + 1)).alias("logFC"))


def significant(de: DataFrame, fdr: float = 0.05, lfc: float = 1.0) -> DataFrame:
    """FDR and effect limits inclusive."""
    return de.where((F.col("FDR") <= fdr) & (F.abs("logFC") >= lfc))


def significant_strict(de: DataFrame, fdr: float = 0.05, lfc: float = 1.0) -> DataFrame:
    """The variant for set diagrams: both limits exclusive."""
    return de.where((F.col("FDR") < fdr) & (F.abs("logFC") > lfc))


def up_down_counts(de: DataFrame, contrasts: DataFrame | None = None, lfc: float = 1.0) -> DataFrame:
    """Genes with logFC over lfc and under -lfc in each contrast, whatever their FDR.

    ``contrasts`` lists contrasts that must have a row, if need be with zeros.
    """
    counted = de.groupBy("contrast").agg(F.count_if(F.col("logFC") > lfc).alias("up"), F.count_if(F.col("logFC") < -lfc).alias("down"))
    return counted if contrasts is None else contrasts.join(counted, "contrast", "left").na.fill(0, ["up", "down"])


def up_down_long(counted: DataFrame) -> DataFrame:
    """One row for each contrast and direction, downward counts negative."""
    return counted.withColumn("down", -F.col("down")).unpivot("contrast", ["up", "down"], "direction", "genes")


def bh_fdr(de: DataFrame, p: str = "PValue", out: str = "FDR") -> DataFrame:
    """Benjamini-Hochberg within each contrast; null p-values stay null and don't count."""
    c = Window.partitionBy("contrast")
    order = c.orderBy(F.col(p).asc_nulls_last())
    n = F.count(p).over(c)
    rank = F.count(p).over(order.rangeBetween(Window.unboundedPreceding, 0))
    ranked = de.withColumn("_q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * n / rank)))
    later = c.orderBy(F.col(p).desc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.min("_q").over(later))).drop("_q")


def top_tags(de: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of each contrast by PValue (ties: gene), ranked; the first n only, if given."""
    ranked = de.withColumn("rank", F.row_number().over(Window.partitionBy("contrast").orderBy("PValue", "gene_id")))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def volcano(de: DataFrame, fdr: float = 0.05, lfc: float = 1.0) -> DataFrame:
    """Adds ``neg_log10_fdr`` and ``class`` (up, down, none)."""
    sig = F.col("FDR") <= fdr
    kind = F.when(sig & (F.col("logFC") >= lfc), "up").when(sig & (F.col("logFC") <= -lfc), "down").otherwise("none")
    return de.withColumn("neg_log10_fdr", C.neg_log10(F.col("FDR"))).withColumn("class", kind)


def ma_points(de: DataFrame, fdr: float = 0.05) -> DataFrame:
    """(contrast, gene_id, a, m, significant): mean abundance, effect, and whether the FDR is within the limit."""
    return de.select("contrast", "gene_id", F.col("logCPM").alias("a"), F.col("logFC").alias("m"), F.coalesce(F.col("FDR") <= fdr, F.lit(False)).alias("significant"))


def venn_members(de: DataFrame, contrasts: list[str]) -> DataFrame:
    """(gene_id, region) of the strictly significant genes of 2 to 4 contrasts, two of which de must have."""
    if not 2 <= len(contrasts) <= 4:
        raise ValueError("two to four contrasts are needed")
    chosen = de.where(F.col("contrast").isin(contrasts))
    if chosen.select("contrast").distinct().count() < 2:  # four rows at most
        raise ValueError("fewer than two of the contrasts have rows")
    return significant_strict(chosen).groupBy("gene_id").agg(F.array_join(F.sort_array(F.collect_set("contrast")), "&").alias("region"))


def venn_regions(de: DataFrame, contrasts: list[str]) -> DataFrame:
    """Size of every exclusive region of 2 to 4 contrasts' strictly significant gene sets."""
    return venn_members(de, contrasts).groupBy("region").agg(F.count(F.lit(1)).alias("genes"))


def heatmap_matrix(de: DataFrame, contrasts: list[str]) -> DataFrame:
    """One row a gene, its logFC in each of the contrasts; 0 where it has none."""
    return de.groupBy("gene_id").pivot("contrast", contrasts).agg(F.first("logFC")).na.fill(0.0, contrasts)


def subset_contrasts(de: DataFrame, contrasts: list[str], keep: bool = True) -> DataFrame:
    """Only the listed contrasts, or all but them."""
    listed = F.col("contrast").isin(contrasts)
    return de.where(listed if keep else ~listed)


def search_rows(de: DataFrame, text: str) -> DataFrame:
    """Rows with the text, in any case, in the gene id, Note GFF or a Uniprot column."""
    wanted, hit = text.lower(), F.lit(False)
    for c in de.columns:
        if c in ("gene_id", "Note GFF") or c.lower().startswith("uniprot"):
            hit = hit | F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(wanted), F.lit(False))
    return de.where(hit)
