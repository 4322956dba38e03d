"""Queries over counts and differential-expression tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwell.functions import columns as C
from loomwell.operators import expression as X
from loomwell.operators import nb as NB
from loomwell.plans.inputs import duck, table
from loomwell.runtime import materialize

PAIRS = ["A_vs_B", "A_vs_C", "B_vs_C"]
SAMPLES = [f"S{i}" for i in range(12)]
_R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


def up_down_by_contrast(spark, d):
    counts = X.filter_low_expression(X.drop_meta_rows(table(spark, d, "counts")), 10)
    return X.up_down_counts(X.mean_contrasts(counts, table(spark, d, "design")), lfc=0.1)


_FILTERED = """c AS (SELECT * FROM {counts} WHERE NOT starts_with(gene_id, '__')),
 n AS (SELECT count(DISTINCT sample_id) AS s FROM c), m AS (SELECT gene_id, sum(count) / max(s) AS mean FROM c, n GROUP BY gene_id),
 f AS (SELECT c.* FROM c JOIN m USING (gene_id) WHERE mean >= 10 OR (SELECT count(*) FROM m WHERE mean >= 10) = 0)"""
_CPM = _FILTERED + """, l AS (SELECT sample_id, sum(count) AS lib FROM f GROUP BY sample_id), p AS (SELECT f.*, 1e6 * count / lib AS cpm FROM f JOIN l USING (sample_id))"""
_CONTRAST = _CPM + """, g AS (SELECT grp, count(*) AS n FROM {design} GROUP BY grp),
 gm AS (SELECT gene_id, grp, sum(cpm) / max(n) AS m FROM p JOIN {design} USING (sample_id) JOIN g USING (grp) GROUP BY gene_id, grp),
 pairs AS (SELECT a.grp AS g1, b.grp AS g2 FROM g a JOIN g b ON a.grp < b.grp), genes AS (SELECT DISTINCT gene_id FROM gm),
 lf AS (SELECT g1 || '_vs_' || g2 AS contrast, genes.gene_id, log2((coalesce(a.m, 0) + 1) / (coalesce(b.m, 0) + 1)) AS logFC FROM genes CROSS JOIN pairs
   LEFT JOIN gm a ON a.gene_id = genes.gene_id AND a.grp = g1 LEFT JOIN gm b ON b.gene_id = genes.gene_id AND b.grp = g2)"""


def _filtered(spark, d):
    return X.filter_low_expression(X.drop_meta_rows(table(spark, d, "counts")), 10)


def low_expression_filter(spark, d):
    return _filtered(spark, d)


def contrast_logfc(spark, d):
    return _R6(X.mean_contrasts(_filtered(spark, d), table(spark, d, "design")), "logFC")


def library_sizes(spark, d):
    return _R6(X.library_sizes(X.drop_meta_rows(table(spark, d, "counts")), table(spark, d, "design")), "mean_size")


def count_qc(spark, d):
    return _R6(X.count_qc(table(spark, d, "counts")), "no_feature_share", "ambiguous_share", "too_low_aQual_share", "not_aligned_share", "alignment_not_unique_share")


def count_matrix(spark, d):
    return X.count_matrix(X.drop_meta_rows(table(spark, d, "counts")), SAMPLES)


def tmm_factors(spark, d):
    return _R6(X.tmm_factors(_filtered(spark, d)), "factor")


def cpm(spark, d):
    return _R6(X.cpm(_filtered(spark, d)), "cpm")


def log_count_histogram(spark, d):
    return X.log_counts(_filtered(spark, d))


def sample_correlation(spark, d):
    return _R6(X.sample_correlation(X.cpm(_filtered(spark, d))), "spearman")


def sample_distance(spark, d):
    return _R6(X.sample_distance(X.cpm(_filtered(spark, d))), "distance")


def group_pairs(spark, d):
    return X.all_pairs(table(spark, d, "design"))


def significant_genes(spark, d):
    return X.significant(table(spark, d, "de"))


def significant_genes_strict(spark, d):
    return X.significant_strict(table(spark, d, "de"))


def up_down_counts(spark, d):
    return X.up_down_counts(table(spark, d, "de"), spark.createDataFrame([(p,) for p in [*PAIRS, "C_vs_D"]], "contrast string"))


def up_down_long(spark, d):
    return X.up_down_long(X.up_down_counts(table(spark, d, "de")))


def bh_fdr(spark, d):
    return _R6(X.bh_fdr(table(spark, d, "de").drop("FDR")), "FDR").select("contrast", "gene_id", "PValue", "FDR")


def top_tags(spark, d):
    return X.top_tags(table(spark, d, "de"), 50).select("contrast", "gene_id", "PValue", "rank")


def volcano(spark, d):
    return _R6(X.volcano(table(spark, d, "de")), "neg_log10_fdr").select("contrast", "gene_id", "neg_log10_fdr", "class")


def venn_regions(spark, d):
    return X.venn_regions(table(spark, d, "de"), PAIRS)


def heatmap_matrix(spark, d):
    return X.heatmap_matrix(X.significant(table(spark, d, "de")), PAIRS)


def subset_contrasts(spark, d):
    return X.subset_contrasts(table(spark, d, "de"), ["A_vs_B"]).select("contrast", "gene_id", "logFC")


def delete_contrasts(spark, d):
    return X.subset_contrasts(table(spark, d, "de"), ["A_vs_B"], keep=False).select("contrast", "gene_id", "logFC")


def search_rows(spark, d):
    return X.search_rows(table(spark, d, "de"), "GENE-12").select("contrast", "gene_id", "logFC")


def venn_members(spark, d):
    return X.venn_members(table(spark, d, "de"), PAIRS)


def ma_points(spark, d):
    return X.ma_points(table(spark, d, "de"))


def log_cpm(spark, d):
    return _R6(X.log_cpm(_filtered(spark, d)), "log_cpm")


def ave_log_cpm(spark, d):
    return _R6(X.ave_log_cpm(_filtered(spark, d)), "ave_log_cpm")


def log_count_values(spark, d):
    return _R6(X.log_count_values(_filtered(spark, d)), "log2_count", "ln_count", "log10_count", "ln_positive", "log10_cpm", "log2_cpm")


def sample_trees(spark, d):
    """Merges of the samples by average and by complete linkage."""
    far = materialize(X.sample_distance(X.cpm(_filtered(spark, d))), "distances")
    return _R6(X.sample_tree(far).withColumn("method", F.lit("average")).unionByName(X.sample_tree(far, "complete").withColumn("method", F.lit("complete"))), "height")


def mds_coordinates(spark, d):
    return _R6(X.mds_coordinates(X.log_cpm(_filtered(spark, d))), "x", "y")


def bcv_table(spark, d):
    counts, groups = _filtered(spark, d), table(spark, d, "design")
    design = NB.design_of(X.tmm_factors(counts), groups)
    return _R6(X.bcv_table(NB.estimate_dispersion(NB.gene_arrays(counts, design.samples), design)), "ave", "bcv", "trend", "common")


def nb_dispersion(spark, d):
    counts, groups = _filtered(spark, d), table(spark, d, "design")
    design = NB.design_of(X.tmm_factors(counts), groups)
    return NB.estimate_dispersion(NB.gene_arrays(counts, design.samples), design).drop("y")


def differential_expression(spark, d):
    counts, groups = _filtered(spark, d), table(spark, d, "design")
    design = NB.design_of(X.tmm_factors(counts), groups)
    fitted = NB.estimate_dispersion(NB.gene_arrays(counts, design.samples), design)
    return X.bh_fdr(NB.glm_lrt(fitted, design, [("A", "B"), ("A", "C"), ("B", "C")]))


QUERIES = {
    f.__name__: f
    for f in (up_down_by_contrast, low_expression_filter, contrast_logfc, library_sizes, count_qc, count_matrix, tmm_factors, cpm, log_count_histogram, sample_correlation, sample_distance, group_pairs,
              significant_genes, significant_genes_strict, up_down_counts, up_down_long, bh_fdr, top_tags, volcano, venn_regions, heatmap_matrix, subset_contrasts, delete_contrasts, search_rows,
              venn_members, ma_points, log_cpm, ave_log_cpm, log_count_values, sample_trees, mds_coordinates, bcv_table, nb_dispersion, differential_expression)
}

_TMM = _FILTERED + """, l AS (SELECT sample_id, sum(count) AS lib FROM f GROUP BY sample_id), s AS (SELECT f.*, lib FROM f JOIN l USING (sample_id) WHERE count > 0),
 q AS (SELECT sample_id, quantile_cont(count::DOUBLE / lib, 0.75) AS q FROM s GROUP BY sample_id), r AS (SELECT sample_id AS ref FROM q ORDER BY round(abs(q - (SELECT avg(q) FROM q)), 12), sample_id LIMIT 1),
 x AS (SELECT s.sample_id, log2((s.count::DOUBLE / s.lib) / (t.count::DOUBLE / t.lib)) AS m, log2((s.count::DOUBLE / s.lib) * (t.count::DOUBLE / t.lib)) / 2 AS a,
   1 / ((s.lib - s.count)::DOUBLE / (s.lib::DOUBLE * s.count) + (t.lib - t.count)::DOUBLE / (t.lib::DOUBLE * t.count)) AS w FROM s JOIN s t ON s.gene_id = t.gene_id JOIN r ON t.sample_id = r.ref),
 k AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n, rank() OVER (PARTITION BY sample_id ORDER BY round(m, 12)) + (count(*) OVER (PARTITION BY sample_id, round(m, 12)) - 1) / 2 AS rm,
   rank() OVER (PARTITION BY sample_id ORDER BY round(a, 12)) + (count(*) OVER (PARTITION BY sample_id, round(a, 12)) - 1) / 2 AS ra FROM x),
 t AS (SELECT sample_id, sum(m * w) / sum(w) AS lf, max(abs(m)) AS top FROM k WHERE rm BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05) GROUP BY sample_id),
 u AS (SELECT l.sample_id, lib, CASE WHEN coalesce(top, 0) < 1e-6 THEN 0 ELSE lf END AS lf FROM l LEFT JOIN t USING (sample_id))
 SELECT sample_id, lib::BIGINT AS lib, round(pow(2, lf - (SELECT avg(lf) FROM u)), 6) AS factor FROM u"""

_SQL = {
    "up_down_by_contrast": f"WITH {_CONTRAST} SELECT contrast, count_if(logFC > 0.1)::BIGINT AS up, count_if(logFC < -0.1)::BIGINT AS down FROM lf GROUP BY contrast",
    "low_expression_filter": f"WITH {_FILTERED} SELECT sample_id, gene_id, count FROM f",
    "contrast_logfc": f"WITH {_CONTRAST} SELECT contrast, gene_id, round(logFC, 6) AS logFC FROM lf",
    "library_sizes": """WITH z AS (SELECT sample_id, sum(count)::BIGINT AS size FROM {counts} WHERE NOT starts_with(gene_id, '__') GROUP BY sample_id)
      SELECT sample_id, size, grp, row_number() OVER (ORDER BY size DESC, sample_id) AS rank, round((SELECT avg(size) FROM z), 6) AS mean_size, size < (SELECT avg(size) - 2 * stddev_samp(size) FROM z) AS low_outlier FROM z JOIN {design} USING (sample_id)""",
    "count_qc": """SELECT sample_id, sum(CASE WHEN starts_with(gene_id, '__') THEN 0 ELSE count END)::BIGINT AS assigned, round(sum(CASE WHEN gene_id = '__no_feature' THEN count ELSE 0 END) / sum(count), 6) AS no_feature_share,
      round(sum(CASE WHEN gene_id = '__ambiguous' THEN count ELSE 0 END) / sum(count), 6) AS ambiguous_share,
      round(sum(CASE WHEN gene_id = '__too_low_aQual' THEN count ELSE 0 END) / sum(count), 6) AS too_low_aQual_share,
      round(sum(CASE WHEN gene_id = '__not_aligned' THEN count ELSE 0 END) / sum(count), 6) AS not_aligned_share,
      round(sum(CASE WHEN gene_id = '__alignment_not_unique' THEN count ELSE 0 END) / sum(count), 6) AS alignment_not_unique_share FROM {counts} GROUP BY sample_id""",
    "count_matrix": "SELECT gene_id, " + ", ".join(f"coalesce(sum(CASE WHEN sample_id = '{s}' THEN count END), 0)::BIGINT AS {s}" for s in SAMPLES) + " FROM {counts} WHERE NOT starts_with(gene_id, '__') GROUP BY gene_id",
    "tmm_factors": "WITH " + _TMM,
    "cpm": f"WITH {_CPM} SELECT sample_id, gene_id, count, round(cpm, 6) AS cpm FROM p",
    "log_count_histogram": f"WITH {_CPM} SELECT sample_id, least(floor(log2(cpm + 1)) + 1, 21)::BIGINT AS bin, count(*) AS n FROM p GROUP BY ALL",
    "sample_correlation": f"""WITH {_CPM}, r AS (SELECT sample_id, gene_id, rank() OVER (PARTITION BY sample_id ORDER BY cpm) + (count(*) OVER (PARTITION BY sample_id, cpm) - 1) / 2 AS r FROM p)
      SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, round(corr(a.r, b.r), 6) AS spearman FROM r a JOIN r b ON a.gene_id = b.gene_id AND a.sample_id < b.sample_id GROUP BY ALL""",
    "sample_distance": f"""WITH {_CPM}, g AS (SELECT DISTINCT gene_id FROM p), s AS (SELECT DISTINCT sample_id FROM p), v AS (SELECT s.sample_id, g.gene_id, log2(coalesce(cpm, 0) + 1) AS x FROM g CROSS JOIN s LEFT JOIN p USING (sample_id, gene_id))
      SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS distance FROM v a JOIN v b ON a.gene_id = b.gene_id AND a.sample_id < b.sample_id GROUP BY ALL""",
    "group_pairs": "WITH g AS (SELECT DISTINCT grp FROM {design}) SELECT a.grp AS group1, b.grp AS group2 FROM g a JOIN g b ON a.grp < b.grp",
    "significant_genes": "SELECT * FROM {de} WHERE FDR <= 0.05 AND abs(logFC) >= 1",
    "significant_genes_strict": "SELECT * FROM {de} WHERE FDR < 0.05 AND abs(logFC) > 1",
    "up_down_counts": """WITH w(contrast) AS (VALUES ('A_vs_B'), ('A_vs_C'), ('B_vs_C'), ('C_vs_D')) SELECT w.contrast, coalesce(count_if(logFC > 1), 0)::BIGINT AS up, coalesce(count_if(logFC < -1), 0)::BIGINT AS down FROM w LEFT JOIN {de} d ON d.contrast = w.contrast GROUP BY w.contrast""",
    "up_down_long": "SELECT contrast, 'up' AS direction, count_if(logFC > 1)::BIGINT AS genes FROM {de} GROUP BY contrast UNION ALL SELECT contrast, 'down', -count_if(logFC < -1)::BIGINT FROM {de} GROUP BY contrast",
    "bh_fdr": """WITH r AS (SELECT *, count(*) OVER (PARTITION BY contrast) AS n, count(*) OVER (PARTITION BY contrast ORDER BY PValue) AS k FROM {de})
      SELECT contrast, gene_id, PValue, round(min(least(1.0, PValue * n / k)) OVER (PARTITION BY contrast ORDER BY PValue DESC), 6) AS FDR FROM r""",
    "top_tags": "SELECT contrast, gene_id, PValue, rank FROM (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY PValue, gene_id) AS rank FROM {de}) WHERE rank <= 50",
    "volcano": "SELECT contrast, gene_id, round(-log10(greatest(FDR, 1e-300)), 6) AS neg_log10_fdr, CASE WHEN FDR <= 0.05 AND logFC >= 1 THEN 'up' WHEN FDR <= 0.05 AND logFC <= -1 THEN 'down' ELSE 'none' END AS class FROM {de}",
    "venn_members": "SELECT gene_id, string_agg(DISTINCT contrast, '&' ORDER BY contrast) AS region FROM {de} WHERE FDR < 0.05 AND abs(logFC) > 1 GROUP BY gene_id",
    "ma_points": "SELECT contrast, gene_id, logCPM AS a, logFC AS m, FDR <= 0.05 AS significant FROM {de}",
    "log_cpm": "WITH " + _CPM + ", z AS (SELECT *, 2 * lib / (SELECT avg(lib) FROM l) AS prior FROM l) SELECT gene_id, sample_id, count, round(log2((count + prior) / (lib + 2 * prior) * 1e6), 6) AS log_cpm FROM f JOIN z USING (sample_id)",
    "ave_log_cpm": "WITH " + _CPM + """, z AS (SELECT *, 2 * lib / (SELECT avg(lib) FROM l) AS prior FROM l), g AS (SELECT DISTINCT gene_id FROM f),
      y AS (SELECT g.gene_id, (coalesce(f.count, 0) + prior) / (z.lib + 2 * prior) * 1e6 AS v FROM g CROSS JOIN z LEFT JOIN f ON f.gene_id = g.gene_id AND f.sample_id = z.sample_id) SELECT gene_id, round(log2(avg(v)), 6) AS ave_log_cpm FROM y GROUP BY gene_id""",
    "log_count_values": f"WITH {_CPM} SELECT gene_id, sample_id, count, round(log2(count + 1), 6) AS log2_count, round(ln(count + 1), 6) AS ln_count, round(log10(count + 1), 6) AS log10_count, CASE WHEN count > 0 THEN round(ln(count), 6) END AS ln_positive, round(log10(cpm + 1), 6) AS log10_cpm, round(log2(cpm + 1), 6) AS log2_cpm FROM p",
    "venn_regions": "WITH s AS (SELECT gene_id, string_agg(DISTINCT contrast, '&' ORDER BY contrast) AS region FROM {de} WHERE FDR < 0.05 AND abs(logFC) > 1 GROUP BY gene_id) SELECT region, count(*) AS genes FROM s GROUP BY region",
    "heatmap_matrix": "SELECT gene_id, " + ", ".join(f"coalesce(max(CASE WHEN contrast = '{c}' THEN logFC END), 0) AS \"{c}\"" for c in PAIRS) + " FROM {de} WHERE FDR <= 0.05 AND abs(logFC) >= 1 GROUP BY gene_id",
    "subset_contrasts": "SELECT contrast, gene_id, logFC FROM {de} WHERE contrast = 'A_vs_B'",
    "delete_contrasts": "SELECT contrast, gene_id, logFC FROM {de} WHERE contrast <> 'A_vs_B'",
    "search_rows": "SELECT contrast, gene_id, logFC FROM {de} WHERE contains(lower(gene_id), 'gene-12')",
}
SQL = {k: duck(v) for k, v in _SQL.items()}
