"""Negative-binomial dispersion, fits and likelihood-ratio tests, over Arrow batches of genes.

Counts are gathered once into one array a gene; samples' library sizes, factors and groups are small
and travel with the function. With one mean a group the fit parts into one Newton iteration for each
gene and group, done for all genes of a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.runtime import materialize

PRIOR_DF = 10.0
PRIOR_COUNT = 0.125
GRID = np.exp(np.linspace(math.log(1e-4), math.log(4.0), 41))
_erfc = np.frompyfunc(math.erfc, 1, 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive arguments: Stirling's series after shifting over 8."""
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    z = 1 / (x * x)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series + shift


def chi2_tail(x: np.ndarray) -> np.ndarray:
    """Upper tail of chi-square with one degree of freedom."""
    return _erfc(np.sqrt(np.maximum(x, 0) / 2)).astype(float)


def log_likelihood(y: np.ndarray, mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Sum over the last axis of negative-binomial log-likelihoods; phi 0 is Poisson, mean 0 gives 0."""
    m = np.maximum(mu, 1e-300)
    safe = np.maximum(phi, 1e-12)
    nb = lgamma(y + 1 / safe) - lgamma(1 / safe) - lgamma(y + 1) + y * (np.log(safe * m) - np.log1p(safe * m)) - np.log1p(safe * m) / safe
    poisson = y * np.log(m) - m - lgamma(y + 1)
    return np.where(mu > 0, np.where(phi > 1e-10, nb, poisson), 0.0).sum(axis=-1)


def fit_mean(y: np.ndarray, size: np.ndarray, phi: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Rate b with means exp(b) = rate times size, for each row of y; 0 where all counts are 0."""
    total = y.sum(axis=1)
    beta = np.log(np.maximum(total, 1e-300) / size.sum())
    live = total > 0
    for _ in range(rounds):
        mu = np.exp(beta)[:, None] * size
        w = 1 + phi[:, None] * mu
        step = ((y - mu) / w).sum(axis=1) / (mu / w).sum(axis=1)
        step = np.where(live, np.clip(step, -5, 5), 0)
        beta = beta + step
        if np.abs(step).max(initial=0) < 1e-10:
            break
    return np.where(live, np.exp(beta), 0.0)


def gene_arrays(counts: DataFrame, samples: list[str]) -> DataFrame:
    """(gene_id, y): counts in the samples' order, absent ones 0. One shuffle, by gene."""
    by = F.map_from_entries(F.collect_list(F.struct("sample_id", "count")))
    order = F.array(*map(F.lit, samples))
    return counts.groupBy("gene_id").agg(by.alias("m")).select("gene_id", F.transform(order, lambda s: F.coalesce(F.element_at("m", s), F.lit(0)).cast("double")).alias("y"))


class Design:
    """Samples with group and effective library size (library times factor)."""

    def __init__(self, rows: list[tuple[str, str, float]]):
        rows = sorted(rows)
        self.samples, self.groups = [r[0] for r in rows], np.array([r[1] for r in rows])
        self.size = np.array([float(r[2]) for r in rows])
        self.names = sorted(set(self.groups))

    def means(self, y: np.ndarray, phi: np.ndarray) -> np.ndarray:
        mu = np.zeros_like(y)
        for g in self.names:
            at = self.groups == g
            mu[:, at] = fit_mean(y[:, at], self.size[at], phi)[:, None] * self.size[at]
        return mu

    def profile(self, y: np.ndarray) -> np.ndarray:
        """Adjusted profile likelihood of each gene at each dispersion of GRID."""
        out = np.zeros((len(y), len(GRID)))
        for k, phi in enumerate(GRID):
            p = np.full(len(y), phi)
            mu = self.means(y, p)
            info = np.stack([(mu[:, self.groups == g] / (1 + phi * mu[:, self.groups == g])).sum(axis=1) for g in self.names])
            out[:, k] = log_likelihood(y, mu, p[:, None]) - 0.5 * np.log(np.maximum(info, 1e-8)).sum(axis=0)
        return out


def design_of(factors: DataFrame, groups: DataFrame) -> Design:
    """From (sample_id, lib, factor) and (sample_id, grp): one small row a sample."""
    rows = factors.join(groups, "sample_id").select("sample_id", "grp", (F.col("lib") * F.col("factor")).alias("e")).collect()
    return Design([(r["sample_id"], r["grp"], r["e"]) for r in rows])


def _best(profile: np.ndarray) -> np.ndarray:
    """The dispersion at the maximum of each row, refined by a parabola in its logarithm."""
    x, k = np.log(GRID), profile.argmax(axis=1)
    inner = np.clip(k, 1, len(GRID) - 2)
    rows = np.arange(len(profile))
    a, b, c = profile[rows, inner - 1], profile[rows, inner], profile[rows, inner + 1]
    bend = a - 2 * b + c
    shift = np.where((bend < 0) & (k == inner), 0.5 * (a - c) / np.where(bend < 0, bend, -1), 0.0)
    return np.exp(np.where(k == inner, x[inner] + np.clip(shift, -1, 1) * (x[1] - x[0]), x[k]))


def trend_weights(ave: np.ndarray, centres: np.ndarray, sizes: np.ndarray, span: float) -> np.ndarray:
    """Weights of bins (columns) for genes (rows): tricube in the distance of abundances times the bin's size.

    The width is the distance of the bin at the place ``span`` of all bins from the nearest, and so
    continuous in the gene's abundance; bins with one centre weigh alike.
    """
    far = np.abs(ave[:, None] - centres[None, :])
    k = min(len(centres), max(2, int(np.ceil(span * len(centres))) + 1)) - 1
    width = np.sort(far, axis=1)[:, k : k + 1]
    near = np.where(width > 0, np.clip(1 - (far / np.where(width > 0, width, 1)) ** 3, 0, None) ** 3, 1.0)
    near = np.where(near.sum(axis=1, keepdims=True) > 0, near, 1.0) * sizes
    return near / near.sum(axis=1, keepdims=True)


def estimate_dispersion(genes: DataFrame, design: Design, bins: int = 50, span: float = 0.3) -> DataFrame:
    """(gene_id, y, ave, common, trended, dispersion) by adjusted profile likelihood on a grid.

    The common value maximises the sum over all genes; the trended one a local mean of likelihoods
    around the gene's abundance (mean log2 rate), made of the means of ``bins`` bins of abundance (see ``trend_weights``), so it
    has no steps; the gene's own the sum of its likelihood and that local mean weighted by prior_df
    over residual degrees of freedom.
    """

    def profiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            y = np.stack(f["y"].to_numpy()) if len(f) else np.zeros((0, len(design.samples)))
            ave = np.log2((y + 0.5).sum(axis=1) / design.size.sum() * 1e6) if len(f) else np.zeros(0)
            yield pd.DataFrame({"gene_id": f["gene_id"], "y": f["y"], "ave": ave, "apl": list(design.profile(y)) if len(f) else []})

    rows = genes.mapInPandas(profiles, "gene_id string, y array<double>, ave double, apl array<double>")
    rows = materialize(rows, "nb-profiles")
    edges = rows.agg(F.percentile_approx("ave", [i / bins for i in range(1, bins)], 10_000).alias("e")).first()["e"] or []
    at = F.lit(0)
    for e in sorted(set(edges)):
        at = at + (F.col("ave") > e).cast("int")
    rows = rows.withColumn("bin", at)
    sums = rows.select("bin", "ave", F.posexplode("apl").alias("k", "v")).groupBy("bin", "k").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"), F.avg("ave").alias("centre")).collect()  # a row a bin and place of the grid
    if not sums:
        return rows.select("gene_id", "y", "ave", *(F.lit(0.0).alias(c) for c in ("common", "trended", "dispersion")))
    found = sorted({r["bin"] for r in sums})
    place = {b: i for i, b in enumerate(found)}
    means, sizes, centres = np.zeros((len(found), len(GRID))), np.zeros(len(found)), np.zeros(len(found))
    for r in sums:
        i = place[r["bin"]]
        means[i, r["k"]], sizes[i], centres[i] = r["v"] / r["n"], r["n"], r["centre"]
    common = float(_best((sizes @ means)[None])[0])
    weight = PRIOR_DF / max(len(design.samples) - len(design.names), 1)

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                local = trend_weights(f["ave"].to_numpy(), centres, sizes, span) @ means
                yield pd.DataFrame({"gene_id": f["gene_id"], "y": f["y"], "ave": f["ave"], "common": common, "trended": _best(local), "dispersion": _best(np.stack(f["apl"].to_numpy()) + weight * local)})

    return rows.mapInPandas(own, "gene_id string, y array<double>, ave double, common double, trended double, dispersion double")


def glm_lrt(fitted: DataFrame, design: Design, contrasts: list[tuple[str, str]]) -> DataFrame:
    """(contrast, gene_id, logFC, logCPM, LR, PValue) of first group against second, all in one pass.

    The null model has one mean for both groups; other groups cancel. A group without samples is an error.
    """
    missing = sorted({g for c in contrasts for g in c} - set(design.names))
    if missing:
        raise ValueError(f"groups without samples: {missing}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            y, phi = np.stack(f["y"].to_numpy()), f["dispersion"].to_numpy()
            for g1, g2 in contrasts:
                a, b = design.groups == g1, design.groups == g2
                ll, rates = [], []
                for at in (a, b, a | b):
                    rate = fit_mean(y[:, at], design.size[at], phi)
                    ll.append(log_likelihood(y[:, at], rate[:, None] * design.size[at], phi[:, None]))
                prior = PRIOR_COUNT * design.size / design.size.mean()
                for at in (a, b):
                    rates.append(fit_mean(y[:, at] + prior[at], design.size[at] + 2 * prior[at], phi))
                lr = np.maximum(2 * (ll[0] + ll[1] - ll[2]), 0)
                yield pd.DataFrame({"contrast": f"{g1}_vs_{g2}", "gene_id": f["gene_id"], "logFC": np.log2(rates[0] / rates[1]), "logCPM": f["ave"], "LR": lr, "PValue": chi2_tail(lr)})

    return fitted.mapInPandas(run, "contrast string, gene_id string, logFC double, logCPM double, LR double, PValue double")
