import math
import random

import numpy as np
import pytest

from loomwell.operators import expression as X
from loomwell.operators import nb


def test_low_expression_counts_absent_samples_as_zero(spark):
    rows = [("s1", "a", 20), ("s2", "a", 0), ("s1", "b", 19), ("s2", "c", 30)]
    counts = spark.createDataFrame(rows, "sample_id string, gene_id string, count long")
    assert {r.gene_id for r in X.filter_low_expression(counts, 10).collect()} == {"a", "c"}
    assert X.filter_low_expression(counts, 1000).count() == 4
    assert X.filter_low_expression(counts.limit(0), 10).count() == 0


def test_meta_rows_go(spark):
    counts = spark.createDataFrame([("s", "__no_feature", 3), ("s", "g", 1)], "sample_id string, gene_id string, count long")
    assert [r.gene_id for r in X.drop_meta_rows(counts).collect()] == ["g"]


def test_limits_on_ties(spark):
    de = spark.createDataFrame([("c", "g1", 1.0, 0.05), ("c", "g2", -1.0, 0.01), ("c", "g3", 1.5, 0.01)], "contrast string, gene_id string, logFC double, FDR double")
    assert X.significant(de).count() == 3
    assert [r.gene_id for r in X.significant_strict(de).collect()] == ["g3"]
    assert X.up_down_counts(de).first()[1:] == (1, 0)


def test_bh_with_ties_zero_and_one(spark):
    p = [0.0, 0.01, 0.01, 0.5, 1.0, None]
    de = spark.createDataFrame([("c", str(i), v) for i, v in enumerate(p)], "contrast string, gene_id string, PValue double")
    got = {r.gene_id: r.FDR for r in X.bh_fdr(de).collect()}
    assert got["5"] is None
    assert [got[str(i)] for i in range(5)] == pytest.approx([0.0, 0.05 / 3, 0.05 / 3, 0.625, 1.0])
    assert X.bh_fdr(de.limit(0)).count() == 0


def test_tmm_factors_multiply_to_one(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{s}", f"g{g}", int(rng.poisson(20 + g))) for s in range(4) for g in range(200)]
    f = X.tmm_factors(spark.createDataFrame(rows, "sample_id string, gene_id string, count long")).collect()
    assert math.prod(r.factor for r in f) == pytest.approx(1.0)
    same = spark.createDataFrame([(f"s{s}", f"g{g}", 10 + g) for s in range(3) for g in range(50)], "sample_id string, gene_id string, count long")
    assert [r.factor for r in X.tmm_factors(same).collect()] == pytest.approx([1, 1, 1])


def test_venn_regions_sum_to_union(spark):
    de = spark.createDataFrame([(c, g, 2.0, 0.0) for c, g in [("x", "1"), ("y", "1"), ("x", "2"), ("z", "3"), ("y", "3")]], "contrast string, gene_id string, logFC double, FDR double")
    got = {r.region: r.genes for r in X.venn_regions(de, ["x", "y", "z"]).collect()}
    assert got == {"x&y": 1, "x": 1, "y&z": 1}
    with pytest.raises(ValueError):
        X.venn_regions(de, ["x"])


def test_heatmap_fills_zero(spark):
    de = spark.createDataFrame([("x", "g", 1.5)], "contrast string, gene_id string, logFC double")
    assert X.heatmap_matrix(de, ["x", "y"]).first().asDict() == {"gene_id": "g", "x": 1.5, "y": 0.0}


def test_lgamma_and_tail_match_math():
    x = np.array([0.01, 0.5, 1, 3.3, 20, 1e4])
    assert nb.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)
    assert nb.chi2_tail(np.array([0.0, 3.841458820694124]))== pytest.approx([1, 0.05], rel=1e-9)


def test_equal_libraries_fit_the_group_mean():
    y = np.array([[1.0, 5, 9], [0, 0, 0]])
    assert nb.fit_mean(y, np.ones(3), np.array([0.3, 0.3])) == pytest.approx([5, 0])


def test_equal_groups_have_no_ratio(spark):
    design = nb.Design([(f"s{i}", "AB"[i % 2], 1e6) for i in range(4)])
    genes = spark.createDataFrame([("same", [10.0] * 4), ("up", [100.0, 10.0, 100.0, 10.0])], "gene_id string, y array<double>")
    rows = {r.gene_id: r for r in nb.glm_lrt(nb.estimate_dispersion(genes, design, bins=2), design, [("A", "B")]).collect()}
    assert rows["same"].LR == pytest.approx(0, abs=1e-8) and rows["same"].PValue == pytest.approx(1, abs=1e-3)
    assert rows["up"].logFC == pytest.approx(math.log2(10), abs=0.1) and rows["up"].PValue < 0.01
    with pytest.raises(ValueError, match="Z"):
        nb.glm_lrt(genes, design, [("A", "Z")])


def test_sample_trees_and_scaling(spark):
    d = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 4.0), ("b", "c", 6.0), ("a", "d", 9.0), ("b", "d", 9.0), ("c", "d", 2.0)], "sample_a string, sample_b string, distance double")
    got = {m: [tuple(r) for r in X.sample_tree(d, m).orderBy("step").collect()] for m in ("average", "complete")}
    assert got["average"] == [(1, "a", "b", 1.0, 2), (2, "c", "d", 2.0, 2), (3, "a", "c", 7.0, 4)]
    assert got["complete"][-1] == (3, "a", "c", 9.0, 4)
    rows = [(s, g, float(v)) for s, vs in (("a", (0, 0)), ("b", (3, 0)), ("c", (0, 4))) for g, v in enumerate(vs)]
    at = {r.sample_id: (r.x, r.y) for r in X.mds_coordinates(spark.createDataFrame(rows, "sample_id string, gene_id int, log_cpm double")).collect()}
    far = lambda p, q: sum((x - y) ** 2 for x, y in zip(at[p], at[q]))
    assert [round(far(*p) * 2, 9) for p in ("ab", "ac", "bc")] == [9, 16, 25]


def test_venn_needs_two_contrasts_with_rows(spark):
    de = spark.createDataFrame([("x", "g", 2.0, 0.01), ("y", "g", 2.0, 0.01), ("y", "h", -2.0, 0.01)], "contrast string, gene_id string, logFC double, FDR double")
    assert {tuple(r) for r in X.venn_members(de, ["x", "y"]).collect()} == {("g", "x&y"), ("h", "y")}
    with pytest.raises(ValueError):
        X.venn_regions(de, ["x", "z"])


def test_kappa_takes_the_last_label(spark):
    from loomwell.operators import evaluation as V

    rows = [(1, "a", "yes", 1), (1, "a", "no", 2), (1, "b", "no", 1), (2, "a", "yes", 1), (2, "b", "yes", 1)]
    r = V.pairwise_kappa(spark.createDataFrame(rows, "item int, annotator string, label string, seq int")).first()
    assert (r["items"], r.kappa) == (2, 1.0)


def scalar_mean(y, size, phi):
    """Rate b that solves sum((y - b s) / (1 + phi b s)) = 0, by bisection in its logarithm."""
    if not sum(y):
        return 0.0
    lo, hi = -60.0, 60.0
    for _ in range(200):
        mid = (lo + hi) / 2
        b = math.exp(mid)
        lo, hi = (mid, hi) if sum((v - b * s) / (1 + phi * b * s) for v, s in zip(y, size)) > 0 else (lo, mid)
    return math.exp((lo + hi) / 2)


def scalar_likelihood(y, mu, phi):
    total = 0.0
    for v, m in zip(y, mu):
        if m > 0:
            r = 1 / phi
            total += math.lgamma(v + r) - math.lgamma(r) - math.lgamma(v + 1) + v * math.log(m / (m + r)) + r * math.log(r / (m + r))
    return total


@pytest.fixture(scope="module")
def many_genes(spark):
    """36 genes of three groups with unequal libraries; absent, rare and widely varying counts among them."""
    rng = random.Random(11)
    design = nb.Design([(f"s{i}", "ABC"[i % 3], 5e5 * (1 + i)) for i in range(9)])
    y = {f"g{k:02}": [float(rng.randrange(1 + (k % 12) ** 2 * (1 + i))) for i in range(9)] for k in range(36)}
    frame = spark.createDataFrame(list(y.items()), "gene_id string, y array<double>").repartition(5)
    return design, y, frame


def test_dispersion_against_scalar_likelihoods(spark, many_genes):
    design, y, frame = many_genes
    bins, span = 6, 0.5
    at = {g: [i for i, name in enumerate(design.groups) if name == g] for g in design.names}

    def profile(v):
        out = []
        for phi in nb.GRID:
            mu, info = [0.0] * len(v), []
            for where in at.values():
                rate = scalar_mean([v[i] for i in where], [design.size[i] for i in where], phi)
                for i in where:
                    mu[i] = rate * design.size[i]
                info.append(max(sum(mu[i] / (1 + phi * mu[i]) for i in where), 1e-8))
            out.append(scalar_likelihood(v, mu, phi) - 0.5 * sum(map(math.log, info)))
        return out

    def peak(p):
        """The maximum of the parabola through the highest point of the grid and its neighbours."""
        k = max(range(len(p)), key=lambda i: p[i])
        x = [math.log(phi) for phi in nb.GRID]
        if k in (0, len(p) - 1):
            return math.exp(x[k])
        bend = p[k - 1] - 2 * p[k] + p[k + 1]
        move = 0.5 * (p[k - 1] - p[k + 1]) / bend if bend < 0 else 0
        return math.exp(x[k] + max(-1, min(1, move)) * (x[1] - x[0]))

    apl = {g: profile(v) for g, v in y.items()}
    ave = {g: math.log2(sum(x + 0.5 for x in v) / sum(design.size) * 1e6) for g, v in y.items()}
    ranked = sorted(ave.values())
    edges = sorted({ranked[math.ceil(i / bins * len(ranked)) - 1] for i in range(1, bins)})
    bin_of = {g: sum(a > e for e in edges) for g, a in ave.items()}
    mean = {b: np.mean([apl[g] for g in y if bin_of[g] == b], axis=0) for b in set(bin_of.values())}
    size = {b: sum(v == b for v in bin_of.values()) for b in mean}
    centre = {b: np.mean([ave[g] for g in y if bin_of[g] == b]) for b in mean}

    def local(a):
        """The local mean of the bins' likelihoods around an abundance."""
        far = {b: abs(a - c) for b, c in centre.items()}
        width = sorted(far.values())[math.ceil(span * len(mean))]
        near = {b: max(0.0, 1 - (far[b] / width) ** 3) ** 3 * size[b] for b in mean}
        return sum(near[b] * mean[b] for b in mean) / sum(near.values())

    got = {r.gene_id: r for r in nb.estimate_dispersion(frame, design, bins=bins, span=span).collect()}
    assert set(got) == set(y) and len(mean) == bins
    weight = nb.PRIOR_DF / (9 - 3)
    for g in y:
        r = got[g]
        assert r.ave == pytest.approx(ave[g])
        assert r.common == pytest.approx(peak(np.sum(list(apl.values()), axis=0)), rel=1e-4)
        assert r.trended == pytest.approx(peak(local(ave[g])), rel=1e-4)
        assert r.dispersion == pytest.approx(peak(np.array(apl[g]) + weight * local(ave[g])), rel=1e-4)


def test_ratio_test_against_scalar_fits(spark, many_genes):
    design, y, frame = many_genes
    fitted = nb.estimate_dispersion(frame, design, bins=3)
    phi = {r.gene_id: r.dispersion for r in fitted.collect()}
    rows = nb.glm_lrt(fitted, design, [("A", "B"), ("C", "A")]).collect()
    assert len(rows) == 2 * len(y)
    for r in rows:
        a, b = ([i for i, name in enumerate(design.groups) if name == g] for g in r.contrast.split("_vs_"))
        v, ll = y[r.gene_id], []
        for where in (a, b, a + b):
            some, size = [v[i] for i in where], [design.size[i] for i in where]
            rate = scalar_mean(some, size, phi[r.gene_id])
            ll.append(scalar_likelihood(some, [rate * s for s in size], phi[r.gene_id]))
        lr = max(0.0, 2 * (ll[0] + ll[1] - ll[2]))
        assert r.LR == pytest.approx(lr, rel=1e-5, abs=1e-6)
        assert r.PValue == pytest.approx(math.erfc(math.sqrt(r.LR / 2)), rel=1e-9)
        prior = nb.PRIOR_COUNT * design.size / design.size.mean()
        rates = [scalar_mean([v[i] + prior[i] for i in where], [design.size[i] + 2 * prior[i] for i in where], phi[r.gene_id]) for where in (a, b)]
        assert r.logFC == pytest.approx(math.log2(rates[0] / rates[1]), rel=1e-5, abs=1e-6)


def test_bcv_is_the_root_of_dispersions(spark, many_genes):
    design, y, frame = many_genes
    fitted = nb.estimate_dispersion(frame, design, bins=3)
    want = {r.gene_id: (r.ave, r.dispersion, r.trended, r.common) for r in fitted.collect()}
    got = X.bcv_table(fitted).collect()
    assert len(got) == len(y)
    for r in got:
        ave, own, trend, common = want[r.gene_id]
        assert (r.ave, r.bcv**2, r.trend**2, r.common**2) == pytest.approx((ave, own, trend, common))


def test_dispersion_of_no_genes(spark, many_genes):
    design, _, frame = many_genes
    assert nb.glm_lrt(nb.estimate_dispersion(frame.limit(0), design), design, [("A", "B")]).count() == 0


def test_sample_pairs_in_blocks_are_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    names = [f"S{i:02d}" for i in range(11)]
    x = {(s, g): float(rng.integers(0, 40)) for s in names for g in range(90) if rng.random() < 0.8}
    x |= {("only", 999): 3.0}
    values = spark.createDataFrame([(s, f"g{g}", v, v / 7) for (s, g), v in x.items()], "sample_id string, gene_id string, cpm double, log_cpm double")
    names.append("only")
    ranks = {}
    for s in names:
        own = {g: v for (t, g), v in x.items() if t == s}
        ranks[s] = {g: sum(w < v for w in own.values()) + (sum(w == v for w in own.values()) + 1) / 2 for g, v in own.items()}
    spearman, far, leading = {}, {}, {}
    for a in names:
        for b in names:
            if a < b:
                both = sorted(ranks[a].keys() & ranks[b].keys())
                if len(both) > 1:
                    spearman[a, b] = np.corrcoef([ranks[a][g] for g in both], [ranks[b][g] for g in both])[0, 1]
                if both:
                    gaps = sorted(((x[a, g] - x[b, g]) / 7) ** 2 for g in both)[-20:]
                    leading[a, b] = np.sqrt(np.mean(gaps))
                far[a, b] = np.sqrt(sum((np.log2(x.get((a, g), 0) + 1) - np.log2(x.get((b, g), 0) + 1)) ** 2 for g in range(1000)))
    for samples, genes in ((512, 2048), (3, 2)):  # one block of all, then four blocks and three levels of lots
        for name, n in (("SAMPLES", samples), ("MDS_SAMPLES", samples), ("GENES", genes)):
            monkeypatch.setattr(X, name, n)
        told = lambda df, c: {(r.sample_a, r.sample_b): r[c] for r in df.collect()}
        assert told(X.sample_correlation(values), "spearman") == pytest.approx(spearman)
        assert told(X.sample_distance(values), "distance") == pytest.approx({k: v for k, v in far.items()})
        assert told(X.leading_distance(values, 20), "distance") == pytest.approx(leading)
    nothing = values.limit(0)
    assert X.sample_correlation(nothing).count() == X.sample_distance(nothing).count() == X.leading_distance(nothing).count() == 0


def test_trend_weights_have_no_steps():
    rng = np.random.default_rng(1)
    centres, sizes = np.sort(rng.normal(size=20)), rng.integers(1, 9, 20).astype(float)
    at = np.linspace(-4, 4, 20_001)
    w = nb.trend_weights(at, centres, sizes, 0.3)
    assert w.sum(axis=1) == pytest.approx(1) and np.abs(np.diff(w, axis=0)).max() < 0.01
    assert nb.trend_weights(np.zeros(2), np.zeros(3), np.array([1.0, 1, 2]), 0.3) == pytest.approx(np.array([[0.25, 0.25, 0.5]] * 2))
    assert nb.trend_weights(np.array([3.0]), np.array([1.0]), np.array([4.0]), 0.3) == pytest.approx(1)
