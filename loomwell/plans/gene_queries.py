"""Queries over annotation, ontology and cluster tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwell.functions import columns as C
from loomwell.operators import annotation as A
from loomwell.operators import clustering as K
from loomwell.operators import retrieval as T
from loomwell.plans.inputs import duck, table

_NAMES, _GO = ("name_gff", "uniprot_names"), ("bp", "mf")


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def gff_fields(spark, d):
    return A.gff_table(table(spark, d, "gff_lines")).select("line_no", "id", "name", "product", "note", F.size("attrs").alias("n_attrs"))


def gff_feature_counts(spark, d):
    return A.gff_feature_counts(table(spark, d, "gff_lines"))


def gff_attribute_profile(spark, d):
    return A.gff_attribute_profile(table(spark, d, "gff_lines"))


def normalize_strand(spark, d):
    return A.normalize_strand(table(spark, d, "gff_lines")).select("line_no", "strand", "fixed")


def normalize_ids(spark, d):
    return table(spark, d, "gff_lines").select("line_no", C.normalize_id(F.concat_ws("-", "feature", "seqid", "strand")).alias("norm_id"))


def resolve_id_attribute(spark, d):
    return A.resolve_id_attribute(table(spark, d, "gff_lines"), "exon", "locus_tag")


def annotate_with_gff(spark, d):
    return A.annotate_with_gff(table(spark, d, "de"), table(spark, d, "gff_lines")).select("contrast", "gene_id", "gff_name", "gff_text")


def best_uniprot_hit(spark, d):
    return A.best_hit(table(spark, d, "uniprot_hits"))


def annotate_with_uniprot(spark, d):
    de = A.annotate_with_gff(table(spark, d, "de"), table(spark, d, "gff_lines"))
    # one contrast queries by notes, one by products and one by names
    de = de.withColumn("gff_note", F.when(F.col("contrast") == "A_vs_B", F.col("gff_note"))).withColumn("gff_product", F.when(F.col("contrast") != "B_vs_C", F.col("gff_product")))
    return A.annotate_with_uniprot(de, table(spark, d, "uniprot_hits")).select("contrast", "gene_id", "query", "hit_pos", "organism", "gene_names", "go_bp", "go_mf", "go_cc")


def unique_queries(spark, d):
    return A.unique_queries(table(spark, d, "uniprot_hits"), "query")


def top_go_terms(spark, d):
    return A.top_go_terms(table(spark, d, "genes").withColumn("contrast", F.col("name_gff").substr(1, 1)), "bp", 15)


def top_go_terms_by_ontology(spark, d):
    return A.top_go_terms_by_ontology(table(spark, d, "genes").withColumn("contrast", F.col("name_gff").substr(1, 1)), {"BP": "bp", "MF": "mf"}, 15)


def split_go_valid(spark, d):
    return A.split_invalid_go(table(spark, d, "gene2go"), table(spark, d, "go_terms"))


def split_go_invalid(spark, d):
    return A.split_invalid_go(table(spark, d, "gene2go"), table(spark, d, "go_terms"), valid=False)


def unique_gene2go(spark, d):
    g = table(spark, d, "genes").withColumn("cc", F.concat(F.lit("part ["), F.substring_index(F.substring_index("bp", "[", -1), "]", 1), F.lit("]; "), "bp"))
    return A.unique_gene2go(g, {"BP": "bp", "MF": "mf", "CC": "cc"})


def go_labels(spark, d):
    return table(spark, d, "genes").select("gene_id", F.array_join(C.go_labels(F.concat_ws("; ", "bp", "mf", "bp")), "|").alias("labels"), C.go_count(F.concat_ws(";", "bp", "mf")).cast("long").alias("n"))


def clean_go_annotations(spark, d):
    bad = F.array(*(F.lit(f"GO:{i:07d}") for i in range(64, 80)))
    return table(spark, d, "genes").select("gene_id", C.drop_go_segments(F.col("bp"), bad).alias("bp"))


def invalid_go_dropped(spark, d):
    bad = table(spark, d, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("GO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("go_id"))
    return A.drop_invalid_go(table(spark, d, "genes").select("gene_id", "bp"), "gene_id", "bp", bad)


def gff_maps(spark, d):
    m = C.gff_map(C.gff_attributes(F.concat_ws(";", "attributes", F.lit("Name=last"))))
    return table(spark, d, "gff_lines").select("line_no", F.size(m).cast("long").alias("n"), F.element_at(m, F.lit("Name")).alias("name"))


def selected_genes(spark, d):
    c = table(spark, d, "genes").withColumn("selected_for_search", F.when(F.col("pvalue") < 0.1, "True").otherwise("no"))
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pvalue", "gene_id")))
    return T.selected_genes(ranked).select("gene_id", "rank")


def clean_genes(spark, d):
    return K.clean_genes(table(spark, d, "genes"), _NAMES, "uniprot_function", _GO).select("gene_id", "direction", "useful_name")


def normalize_de_table(spark, d):
    raw = table(spark, d, "de").select(F.col("gene_id").alias("Unnamed: 0"), F.regexp_replace(F.col("logFC").cast("decimal(20,6)").cast("string"), r"\.", ",").alias("logFC"), F.concat(F.lit(" '"), F.col("PValue").cast("string"), F.lit("' ")).alias("PValue"), "FDR")
    return K.normalize_de_table(raw).select("gene_id", "log2FoldChange", "pvalue", "padj", F.col("Name GFF").alias("name_gff"))


def primary_names(spark, d):
    return table(spark, d, "genes").select("gene_id", F.coalesce(F.nullif(C.primary_name(F.col("uniprot_names")), F.lit("")), F.col("name_gff"), F.col("gene_id")).alias("primary_name"))


def name_terms(spark, d):
    return table(spark, d, "genes").select("gene_id", F.array_join(C.name_terms(F.concat_ws(" ", "name_gff", "uniprot_function")), " ").alias("name_terms"))


def go_closure(spark, d):
    return _r6(K.go_closure(table(spark, d, "go_edges"), table(spark, d, "go_terms")), "s")


def term_similarity(spark, d):
    return _r6(K.term_similarity(K.go_closure(table(spark, d, "go_edges"), table(spark, d, "go_terms")), table(spark, d, "gene2go").select("go_id").distinct()), "sim")


def _gene_terms(spark, d):
    return table(spark, d, "gene2go").join(table(spark, d, "go_terms"), "go_id")


def gene_similarity(spark, d):
    closure = K.go_closure(table(spark, d, "go_edges"), table(spark, d, "go_terms"))
    pairs = K.gene_similarity(_gene_terms(spark, d), closure, K.MIN_SIMILARITY, ("ontology",))
    return _r6(pairs.groupBy("ontology", "gene_a").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sim"), 3).alias("total"), F.max("sim").alias("best")), "best")


def semantic_clusters(spark, d):
    genes = table(spark, d, "genes").select("gene_id", F.when(F.col("log2FoldChange") > 0, "upregulated").otherwise("downregulated").alias("direction"))
    return _r6(K.clusters_of_genes(genes, _gene_terms(spark, d), table(spark, d, "go_edges"), table(spark, d, "go_terms")), "cluster_silhouette", "mean_silhouette", "min_silhouette", "min_pairwise_similarity")


def cluster_silhouettes(spark, d):
    return _r6(K.silhouettes(table(spark, d, "similarity"), table(spark, d, "clusters").select("ontology", "direction", "gene_id", "cluster"), ("ontology", "direction")), "silhouette")


def renumber_clusters(spark, d):
    return K.renumber(table(spark, d, "clusters").withColumn("cluster", F.expr("CASE WHEN cluster = -1 THEN -1 ELSE cluster * 3 END")), ["ontology", "direction"]).select("ontology", "direction", "gene_id", "cluster")


def cluster_metrics(spark, d):
    return _r6(K.cluster_metrics(table(spark, d, "clusters"), table(spark, d, "similarity")), "mean_silhouette", "min_silhouette", "min_similarity")


def cluster_representatives(spark, d):
    return _r6(K.cluster_representatives(table(spark, d, "clusters"), table(spark, d, "similarity"), 3), "centrality")


def cluster_summary(spark, d):
    c = table(spark, d, "clusters").where("ontology <> 'CC' OR direction <> 'up'")
    return _r6(K.cluster_summary(c, table(spark, d, "clusters").select("ontology", "direction").distinct()), "mean_silhouette")


def ontology_coverage(spark, d):
    annotated = _gene_terms(spark, d).where("gene_id NOT LIKE '%7'").select("gene_id", "ontology")
    return K.ontology_coverage(annotated, K.clean_genes(table(spark, d, "genes"), _NAMES, "uniprot_function", _GO), table(spark, d, "clusters"))


def coverage_violations(spark, d):
    c, genes = table(spark, d, "clusters"), table(spark, d, "genes")
    annotated = genes.where(C.go_count(F.concat("bp", "mf")) > 2)
    return K.coverage_violations(table(spark, d, "de").where("contrast = 'A_vs_B'").select("gene_id"), annotated, K.clean_genes(genes, _NAMES, "uniprot_function", _GO), c.where("cluster <> -1"))


def final_cluster_table(spark, d):
    return K.final_cluster_table(table(spark, d, "clusters")).select("ontology", "direction", "gene_id", "cluster", "position")


def prioritized_genes(spark, d):
    clusters = table(spark, d, "clusters")
    reps = K.cluster_representatives(clusters, table(spark, d, "similarity")).join(K.cluster_metrics(clusters, table(spark, d, "similarity")).select("ontology", "direction", "cluster", "mean_silhouette"), ["ontology", "direction", "cluster"])
    reps = reps.drop("log2FoldChange").join(table(spark, d, "genes").select("gene_id", F.concat_ws("; ", "bp", "mf").alias("go_terms")), "gene_id")
    themes = clusters.select("ontology", "direction", "cluster").distinct().where("ontology <> 'CC'").withColumn("interpretation", F.concat(F.lit("theme "), F.col("cluster").cast("string")))
    ranked = K.prioritize(reps, table(spark, d, "genes").select("gene_id", "padj", "log2FoldChange", "uniprot_names"), themes)
    return _r6(ranked, "centrality_score", "min_cluster_quality").select("rank", "gene_id", "n_ontologies", "centrality_score", "min_cluster_quality", "represented_clusters", "selection_reason", "primary_name", "search_query", "cluster_interpretations")


def coverage_funnel(spark, d):
    genes = table(spark, d, "genes")
    annotated = genes.where(C.go_count(F.concat("bp", "mf")) > 0)
    eligible = K.clean_genes(genes, _NAMES, "uniprot_function", _GO)
    return K.coverage_funnel(table(spark, d, "de").select("gene_id"), annotated, eligible, eligible.join(table(spark, d, "clusters").where("cluster <> -1"), "gene_id", "left_semi"))


def heaviest_targets(spark, d):
    contrasts = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.concat(F.lit("A(S"), F.col("r_regionkey"), F.lit(";S3)*B(S1; S"), F.col("r_regionkey") + 3, F.lit(")")).alias("name"))
    files = table(spark, d, "design").select("sample_id", F.concat("sample_id", F.lit(".tsv")).alias("file"))
    return A.build_targets(contrasts, files).select("file", "grp")


def target_conflicts(spark, d):
    contrasts = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.concat(F.lit("A(S"), F.col("r_regionkey"), F.lit(";S3)*B(S1; S"), F.col("r_regionkey") + 3, F.lit(")")).alias("name"))
    return A.target_conflicts(contrasts)


QUERIES = {
    f.__name__: f
    for f in (gff_fields, gff_feature_counts, gff_attribute_profile, normalize_strand, normalize_ids, resolve_id_attribute, annotate_with_gff, best_uniprot_hit, annotate_with_uniprot, unique_queries,
              top_go_terms, top_go_terms_by_ontology, split_go_valid, split_go_invalid, unique_gene2go, go_labels, clean_go_annotations, invalid_go_dropped, gff_maps, selected_genes, clean_genes, normalize_de_table, primary_names, name_terms, go_closure, term_similarity,
              gene_similarity, semantic_clusters, cluster_silhouettes, renumber_clusters, cluster_metrics, cluster_representatives, cluster_summary, ontology_coverage, coverage_violations, final_cluster_table, prioritized_genes, coverage_funnel,
              heaviest_targets, target_conflicts)
}
QUERIES["build_targets"] = QUERIES.pop("heaviest_targets")

_ATTR = """a AS (SELECT line_no, feature, list_filter(list_transform(list_filter(list_transform(string_split(attributes, ';'), lambda x: trim(x)), lambda x: x <> ''), lambda x:
   CASE WHEN contains(x, '=') THEN {{'k': trim(x[1:instr(x, '=') - 1]), 'v': trim(trim(x[instr(x, '=') + 1:]), '"')}}
   ELSE {{'k': regexp_extract(x, '^(\\S+)\\s', 1), 'v': trim(regexp_extract(x, '^\\S+\\s+"([^"]+)"', 1))}} END), lambda x: x.k <> '') AS t FROM gff_lines)""".replace("{{", "{").replace("}}", "}")
_V = lambda *ks: "coalesce(" + ", ".join(f"nullif(list_filter(t, lambda x: x.k = '{k}')[-1].v, '')" for k in ks) + ", '')"
_FIELDS = _ATTR + f""", g AS (SELECT line_no, {_V("ID", "gene_id", "GeneID", "gene")} AS id, {_V("Name", "gene", "gene_name")} AS name, {_V("Product", "product", "product_name", "description")} AS product,
   {_V("Note", "note", "description")} AS note, len(t)::INT AS n_attrs FROM a)"""
_NORM = "upper(regexp_replace(regexp_replace(trim({0}), '^[A-Za-z]+[-_:]', ''), '[^A-Za-z0-9]', '', 'g'))"
_GFF = _FIELDS + f""", f AS (SELECT {_NORM.format("id")} AS nid, arg_min(name, line_no) AS name, arg_min(product, line_no) AS product, arg_min(note, line_no) AS note FROM g WHERE id <> '' GROUP BY 1),
 j AS (SELECT d.contrast, d.gene_id, coalesce(f.name, '') AS gff_name, coalesce(product, '') AS product, coalesce(note, '') AS note FROM de d LEFT JOIN f ON f.nid = {_NORM.format("d.gene_id")}),
 k AS (SELECT contrast, gene_id, gff_name, product, note, CASE WHEN bool_or(product <> '') OVER (PARTITION BY contrast) THEN product ELSE note END AS gff_text FROM j)"""
_PLANT = "(CASE WHEN lineage <> '' THEN regexp_matches(lower(lineage), '" + "|".join(C.PLANT_LINEAGE) + "') ELSE regexp_matches(lower(organism), '" + "|".join(C.PLANT_ORGANISM) + "') END)"
_BEST = f"""h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN {_PLANT} AND (trim(function_text) <> '' OR trim(go_bp) <> '') THEN 0 WHEN trim(function_text) <> '' OR trim(go_bp) <> '' THEN 1 ELSE 2 END, hit_pos) AS n FROM uniprot_hits),
 b AS (SELECT query, hit_pos, organism, gene_names, function_text, go_bp, go_mf, go_cc FROM h WHERE n = 1)"""
_CLOSE = """WITH RECURSIVE c0(term, ancestor, s) AS (SELECT go_id, go_id, 1e0 FROM {go_terms} UNION ALL SELECT c0.term, e.parent, c0.s * CASE e.relation WHEN 'is_a' THEN 8e-1 ELSE 6e-1 END FROM c0 JOIN {go_edges} e ON e.child = c0.ancestor),
 c AS (SELECT term, ancestor, max(s) AS s FROM c0 GROUP BY ALL)"""
_SIM = _CLOSE + """, u AS (SELECT c.* FROM c WHERE term IN (SELECT go_id FROM {gene2go})), v AS (SELECT term, sum(s) AS sv FROM u GROUP BY term),
 ts AS (SELECT a.term AS term_a, b.term AS term_b, sum(a.s + b.s) / (max(va.sv) + max(vb.sv)) AS sim FROM u a JOIN u b USING (ancestor) JOIN v va ON va.term = a.term JOIN v vb ON vb.term = b.term GROUP BY a.term, b.term)"""
_TELLING = r"trim(uniprot_function) <> '' AND NOT regexp_full_match(trim(uniprot_function), '(?i)(function:\s*)?(hypothetical|uncharacterized|unknown|predicted|putative|expressed)( protein)?( of unknown function)?[.\s]*')"
_IDS = "len(regexp_extract_all(bp || ';' || mf, 'GO:[0-9]+'))"
_CLEAN = f"FROM {{genes}} WHERE padj <= 0.05 AND abs(log2FoldChange) >= 1 AND {_IDS} >= 2 AND {_TELLING}"
_USEFUL = lambda c: f"(trim({c}) <> '' AND NOT regexp_matches(trim({c}), '(?i)hypothetical|uncharacterized|unknown|predicted|putative protein|expressed protein|similar to .*protein|os[0-9]+g[0-9]+.*protein'))"
_CENTRAL = """sz AS (SELECT ontology, direction, cluster, count(*) AS size FROM {clusters} WHERE cluster <> -1 GROUP BY ALL),
 e AS (SELECT ontology, direction, cluster, gene_a AS gene_id, sim FROM {similarity} UNION ALL SELECT ontology, direction, cluster, gene_b, sim FROM {similarity}),
 t AS (SELECT ontology, direction, cluster, gene_id, sum(sim) AS total FROM e GROUP BY ALL),
 r AS (SELECT c.ontology, c.direction, c.cluster, c.gene_id, c.log2FoldChange, c.cluster_silhouette, CASE WHEN size > 1 THEN coalesce(total, 0) / (size - 1) END AS centrality FROM {clusters} c JOIN sz USING (ontology, direction, cluster) LEFT JOIN t USING (ontology, direction, cluster, gene_id)),
 q AS (SELECT *, row_number() OVER (PARTITION BY ontology, direction, cluster ORDER BY round(centrality, 12) DESC NULLS LAST, cluster_silhouette DESC, abs(log2FoldChange) DESC, gene_id) AS rank FROM r)"""
_METRICS = """mt AS (SELECT ontology, direction, cluster, count(*) AS size, avg(cluster_silhouette) AS mean_silhouette, min(cluster_silhouette) AS min_silhouette FROM {clusters} WHERE cluster <> -1 GROUP BY ALL)"""
_REGION = """s AS (SELECT r_regionkey AS id, unnest(['A', 'A', 'B', 'B']) AS grp, unnest(['S' || r_regionkey, 'S3', 'S1', 'S' || (r_regionkey + 3)]) AS sample_id FROM {region})"""

_SQL = {
    "gff_fields": "{gff_lines}WITH " + _FIELDS.replace("gff_lines", "{gff_lines}") + " SELECT * FROM g",
    "gff_feature_counts": "SELECT feature, count(*) AS n FROM {gff_lines} GROUP BY feature",
    "gff_attribute_profile": "WITH " + _ATTR.replace("gff_lines", "{gff_lines}") + ", x AS (SELECT line_no, unnest(t) AS u FROM a) SELECT u.k AS key, count(DISTINCT u.v) AS n_values, arg_min(u.v, line_no) AS example FROM x GROUP BY u.k",
    "normalize_strand": "SELECT line_no, CASE WHEN strand IN ('+', '-', '.') THEN strand ELSE '.' END AS strand, strand NOT IN ('+', '-', '.') AS fixed FROM {gff_lines}",
    "normalize_ids": "SELECT line_no, " + _NORM.format("feature || '-' || seqid || '-' || strand") + " AS norm_id FROM {gff_lines}",
    "resolve_id_attribute": "WITH " + _ATTR.replace("gff_lines", "{gff_lines}") + """, e AS (SELECT list_transform(t, lambda x: x.k) AS ks FROM a WHERE feature = 'exon' ORDER BY line_no LIMIT 1)
      SELECT coalesce(list_filter(['ID', 'gene_id', 'locus_tag', 'Name', 'Parent', 'transcript_id'], lambda k: list_contains(ks, k))[1], ks[1]) AS attribute FROM e""",
    "annotate_with_gff": "WITH " + _GFF.replace("gff_lines", "{gff_lines}").replace("FROM de d", "FROM {de} d") + " SELECT contrast, gene_id, gff_name, gff_text FROM k",
    "best_uniprot_hit": "WITH " + _BEST.replace("uniprot_hits", "{uniprot_hits}") + " SELECT * FROM b",
    "annotate_with_uniprot": "WITH " + _GFF.replace("gff_lines", "{gff_lines}").replace("FROM de d", "FROM {de} d") + ", " + _BEST.replace("uniprot_hits", "{uniprot_hits}") + """, k2 AS (SELECT contrast, gene_id, gff_name, CASE WHEN contrast = 'A_vs_B' THEN note ELSE '' END AS note, CASE WHEN contrast <> 'B_vs_C' THEN product ELSE '' END AS product FROM k),
      w AS (SELECT contrast, gene_id, CASE WHEN bool_or(note <> '') OVER c THEN note WHEN bool_or(product <> '') OVER c THEN product WHEN bool_or(gff_name <> '') OVER c THEN gff_name ELSE gene_id END AS query FROM k2 WINDOW c AS (PARTITION BY contrast))
      SELECT contrast, gene_id, w.query, hit_pos, organism, gene_names, go_bp, go_mf, go_cc FROM w LEFT JOIN b ON b.query = w.query""",
    "unique_queries": "SELECT DISTINCT trim(query) AS query FROM {uniprot_hits} WHERE lower(trim(query)) NOT IN ('', 'nan', 'none')",
    "top_go_terms": r"""WITH t AS (SELECT substr(name_gff, 1, 1) AS contrast, unnest(list_transform(regexp_split_to_array(bp, '[;,|]'), lambda x: trim(regexp_replace(x, '\s*\[[^\]]*\]', '', 'g')))) AS term FROM {genes}),
      n AS (SELECT contrast, term, count(*) AS n FROM t WHERE term <> '' GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY n DESC, term) AS rank FROM n) WHERE rank <= 15""",
    "top_go_terms_by_ontology": r"""WITH o AS (SELECT substr(name_gff, 1, 1) AS contrast, 'BP' AS ontology, bp AS x FROM {genes} UNION ALL SELECT substr(name_gff, 1, 1), 'MF', mf FROM {genes}),
      t AS (SELECT contrast, ontology, unnest(list_transform(regexp_split_to_array(x, '[;,|]'), lambda y: trim(regexp_replace(y, '\s*\[[^\]]*\]', '', 'g')))) AS term FROM o),
      n AS (SELECT contrast, ontology, term, count(*) AS n FROM t WHERE term <> '' GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contrast, ontology ORDER BY n DESC, term) AS rank FROM n) WHERE rank <= 15""",
    "split_go_valid": "SELECT * FROM {gene2go} WHERE go_id IN (SELECT go_id FROM {go_terms})",
    "split_go_invalid": "SELECT * FROM {gene2go} WHERE go_id NOT IN (SELECT go_id FROM {go_terms})",
    "unique_gene2go": "SELECT gene_id, 'BP' AS ontology, unnest(regexp_extract_all(bp, 'GO:[0-9]+')) AS go_id FROM {genes} UNION SELECT gene_id, 'MF', unnest(regexp_extract_all(mf, 'GO:[0-9]+')) FROM {genes} UNION SELECT gene_id, 'CC', unnest(regexp_extract_all(bp, 'GO:[0-9]+')) FROM {genes}",
    "go_labels": r"""WITH s AS (SELECT gene_id, list_filter(list_transform(string_split(bp || '; ' || mf || '; ' || bp, ';'), lambda x: trim(regexp_replace(x, '\s*\[GO:[0-9]+\]\s*', '', 'g'))), lambda x: x <> '') AS l, len(regexp_extract_all(bp || ';' || mf, 'GO:[0-9]+')) AS n FROM {genes})
      SELECT gene_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS labels, n FROM s""",
    "clean_go_annotations": "SELECT gene_id, array_to_string(list_filter(list_transform(string_split(bp, ';'), lambda x: trim(x)), lambda x: x <> '' AND NOT list_has_any(regexp_extract_all(x, 'GO:[0-9]+'), list_transform(range(64, 80), lambda i: 'GO:' || lpad(i::VARCHAR, 7, '0')))), '; ') AS bp FROM {genes}",
    "invalid_go_dropped": """WITH b AS (SELECT list('GO:' || lpad(p_partkey::VARCHAR, 7, '0')) AS bad FROM {part} WHERE p_partkey % 5 = 0)
      SELECT gene_id, array_to_string(list_filter(list_transform(string_split(bp, ';'), lambda x: trim(x)), lambda x: x <> '' AND NOT list_has_any(regexp_extract_all(x, 'GO:[0-9]+'), bad)), '; ') AS bp FROM {genes}, b""",
    "gff_maps": "SELECT line_no, CASE WHEN starts_with(attributes, 'ID=') THEN 3 ELSE 4 END AS n, 'last' AS name FROM {gff_lines}",
    "selected_genes": "SELECT gene_id, rank FROM (SELECT *, row_number() OVER (ORDER BY pvalue, gene_id) AS rank FROM {genes}) WHERE pvalue < 0.1",
    "clean_genes": f"SELECT gene_id, CASE WHEN log2FoldChange > 0 THEN 'upregulated' ELSE 'downregulated' END AS direction, {_USEFUL('name_gff')} OR {_USEFUL('uniprot_names')} AS useful_name " + _CLEAN,
    "normalize_de_table": "SELECT gene_id, round(logFC, 6) AS log2FoldChange, PValue AS pvalue, FDR AS padj, gene_id AS name_gff FROM {de}",
    "primary_names": r"SELECT gene_id, coalesce(nullif(trim(regexp_replace(uniprot_names, '(?s)\s*[\(\[].*$', '')), ''), name_gff, gene_id) AS primary_name FROM {genes}",
    "name_terms": "WITH w AS (SELECT gene_id, list_filter(regexp_extract_all(lower(name_gff || ' ' || uniprot_function), '[A-Za-z0-9][A-Za-z0-9_.+-]*'), lambda x: length(x) >= 3 AND NOT list_contains(" + str(C.NAME_STOP) + ", x)) AS w FROM {genes}), "
    "h AS (SELECT gene_id, flatten(list_transform(w, lambda x: CASE WHEN contains(x, '-') THEN [x] || list_filter(string_split(x, '-'), lambda y: length(y) >= 3 AND NOT list_contains(" + str(C.NAME_STOP) + ", y)) ELSE [x] END)) AS l FROM w) SELECT gene_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS name_terms FROM h",
    "go_closure": _CLOSE + " SELECT term, ancestor, round(s, 6) AS s FROM c",
    "term_similarity": _SIM + " SELECT term_a, term_b, round(sim, 6) AS sim FROM ts",
    "gene_similarity": _SIM + """, gg AS (SELECT DISTINCT ontology, gene_id, go_id FROM {gene2go} JOIN {go_terms} USING (go_id)), gn AS (SELECT ontology, gene_id, count(*) AS n FROM gg GROUP BY ALL),
      o AS (SELECT a.ontology, a.gene_id AS ga, b.gene_id AS gb, a.go_id, max(sim) AS best FROM gg a JOIN ts ON ts.term_a = a.go_id JOIN gg b ON b.go_id = ts.term_b GROUP BY ALL), w AS (SELECT ontology, ga, gb, sum(best) AS t FROM o GROUP BY ALL),
      p AS (SELECT x.ontology, x.ga AS gene_a, x.gb AS gene_b, (x.t + y.t) / (m.n + n.n) AS sim FROM w x JOIN w y ON x.ontology = y.ontology AND x.ga = y.gb AND x.gb = y.ga JOIN gn m ON m.ontology = x.ontology AND m.gene_id = x.ga JOIN gn n ON n.ontology = x.ontology AND n.gene_id = x.gb WHERE x.ga < x.gb)
      SELECT ontology, gene_a, count(*) AS n, round(sum(sim), 3) AS total, round(max(sim), 6) AS best FROM p WHERE sim >= CASE ontology WHEN 'BP' THEN 5e-1 WHEN 'MF' THEN 6e-1 ELSE 85e-2 END - 1e-12 GROUP BY ontology, gene_a""",
    "renumber_clusters": "SELECT ontology, direction, gene_id, CASE WHEN cluster = -1 THEN -1 ELSE dense_rank() OVER (PARTITION BY ontology, direction, cluster = -1 ORDER BY cluster) END AS cluster FROM {clusters}",
    "cluster_silhouettes": """WITH g AS (SELECT ontology, direction, gene_id, cluster FROM {clusters} WHERE cluster <> -1), p AS (SELECT ontology, direction, gene_a AS x, gene_b AS y, sim FROM {similarity} UNION ALL SELECT ontology, direction, gene_b, gene_a, sim FROM {similarity}),
      d AS (SELECT ontology, direction, a.gene_id, a.cluster, b.cluster AS o, 1 - coalesce(p.sim, 0) AS d FROM g a JOIN g b USING (ontology, direction) LEFT JOIN p ON p.ontology = a.ontology AND p.direction = a.direction AND p.x = a.gene_id AND p.y = b.gene_id WHERE a.gene_id <> b.gene_id),
      m AS (SELECT ontology, direction, gene_id, cluster, o, avg(d) AS m FROM d GROUP BY ALL),
      s AS (SELECT ontology, direction, gene_id, cluster, max(CASE WHEN o = cluster THEN m END) AS a, min(CASE WHEN o <> cluster THEN m END) AS b FROM m GROUP BY ALL)
      SELECT ontology, direction, gene_id, cluster, round(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS silhouette FROM s""",
    "cluster_metrics": f"""WITH {_METRICS}, lo AS (SELECT ontology, direction, cluster, min(sim) AS m FROM {{similarity}} GROUP BY ALL) SELECT mt.ontology, mt.direction, mt.cluster, size, round(mean_silhouette, 6) AS mean_silhouette, round(min_silhouette, 6) AS min_silhouette, round(m, 6) AS min_similarity,
      CASE WHEN mean_silhouette IS NULL THEN 'unknown' WHEN mean_silhouette >= 0.3 THEN 'strong' WHEN mean_silhouette >= 0.1 THEN 'borderline' ELSE 'weak' END AS quality FROM mt LEFT JOIN lo USING (ontology, direction, cluster)""",
    "cluster_representatives": f"WITH {_CENTRAL} SELECT ontology, direction, cluster, gene_id, log2FoldChange, cluster_silhouette, round(centrality, 6) AS centrality, rank FROM q WHERE rank <= 3",
    "cluster_summary": """WITH c AS (SELECT * FROM {clusters} WHERE ontology <> 'CC' OR direction <> 'up') SELECT ontology, direction, count(DISTINCT CASE WHEN cluster <> -1 THEN ontology || direction || cluster END) AS clusters, count(DISTINCT CASE WHEN cluster <> -1 THEN gene_id END) AS clustered_genes, count(DISTINCT gene_id) AS genes,
      round(avg(CASE WHEN cluster <> -1 THEN cluster_silhouette END), 6) AS mean_silhouette FROM c GROUP BY ROLLUP (ontology, direction) UNION ALL SELECT 'CC', 'up', 0, 0, 0, NULL""",
    "ontology_coverage": "WITH el AS (SELECT gene_id " + _CLEAN + """), a AS (SELECT DISTINCT ontology, gene_id FROM {gene2go} JOIN {go_terms} USING (go_id) WHERE gene_id NOT LIKE '%7'), i AS (SELECT DISTINCT ontology, gene_id FROM {clusters} WHERE cluster <> -1),
      n AS (SELECT ontology, count(DISTINCT direction || cluster) AS n FROM {clusters} WHERE cluster <> -1 GROUP BY ontology)
      SELECT a.ontology, count(*) AS annotated, count(el.gene_id) AS eligible, count(CASE WHEN el.gene_id IS NOT NULL THEN i.gene_id END) AS clustered, count(CASE WHEN i.gene_id IS NULL THEN el.gene_id END) AS ungrouped, coalesce(max(n), 0) AS clusters
      FROM a LEFT JOIN el ON el.gene_id = a.gene_id LEFT JOIN i ON i.gene_id = a.gene_id AND i.ontology = a.ontology LEFT JOIN n ON n.ontology = a.ontology GROUP BY a.ontology""",
    "coverage_violations": "WITH el AS (SELECT gene_id " + _CLEAN + """), an AS (SELECT gene_id FROM {genes} WHERE len(regexp_extract_all(bp || mf, 'GO:[0-9]+')) > 2), cl AS (SELECT DISTINCT gene_id FROM {clusters} WHERE cluster <> -1), al AS (SELECT gene_id FROM {de} WHERE contrast = 'A_vs_B')
      SELECT * FROM (SELECT 'clustered_not_eligible' AS rule, count(*) AS genes FROM cl WHERE gene_id NOT IN (SELECT gene_id FROM el) UNION ALL SELECT 'eligible_not_annotated', count(*) FROM el WHERE gene_id NOT IN (SELECT gene_id FROM an)
      UNION ALL SELECT 'annotated_not_all', count(*) FROM an WHERE gene_id NOT IN (SELECT gene_id FROM al)) WHERE genes > 0""",
    "final_cluster_table": "SELECT ontology, direction, gene_id, cluster, row_number() OVER (PARTITION BY ontology, direction ORDER BY cluster = -1, cluster, gene_id) AS position FROM {clusters}",
    "prioritized_genes": f"""WITH {_CENTRAL}, {_METRICS}, rep AS (SELECT q.*, mt.mean_silhouette, ontology || ':' || direction || ':' || cluster AS k FROM q JOIN mt USING (ontology, direction, cluster) WHERE rank = 1),
      c AS (SELECT gene_id, avg(centrality) AS cs, min(mean_silhouette) AS mq, count(DISTINCT ontology) AS n, string_agg(DISTINCT k, '; ' ORDER BY k) AS rc,
        coalesce(string_agg('theme ' || cluster, ' | ' ORDER BY k) FILTER (WHERE ontology <> 'CC'), '') AS ci FROM rep GROUP BY gene_id),
      l AS (SELECT gene_id, list_filter(list_transform(string_split(bp || '; ' || mf, ';'), lambda x: trim(regexp_replace(x, '\\s*\\[GO:[0-9]+\\]\\s*', '', 'g'))), lambda x: x <> '') AS l, trim(regexp_replace(uniprot_names, '\\s*[\\(\\[].*$', '')) AS pn FROM {{genes}})
      SELECT row_number() OVER (ORDER BY n >= 2 DESC, n DESC, mq DESC NULLS LAST, cs DESC NULLS LAST, abs(g.log2FoldChange) DESC NULLS LAST, padj NULLS LAST, c.gene_id) AS rank, c.gene_id, n AS n_ontologies, round(cs, 6) AS centrality_score, round(mq, 6) AS min_cluster_quality, rc AS represented_clusters,
      CASE WHEN n >= 2 THEN 'representative_in_multiple_ontologies' ELSE 'representative_in_single_ontology' END AS selection_reason, pn AS primary_name,
      array_to_string([pn] || list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ', ') AS search_query, ci AS cluster_interpretations FROM c JOIN {{genes}} g ON g.gene_id = c.gene_id JOIN l ON l.gene_id = c.gene_id""",
    "coverage_funnel": "WITH el AS (SELECT gene_id " + _CLEAN + """), x AS (SELECT DISTINCT d.gene_id, g.gene_id IS NOT NULL AS an, el.gene_id IS NOT NULL AS e, el.gene_id IS NOT NULL AND c.gene_id IS NOT NULL AS cl FROM {de} d
      LEFT JOIN (SELECT gene_id FROM {genes} WHERE contains(bp || mf, 'GO:')) g ON g.gene_id = d.gene_id LEFT JOIN el ON el.gene_id = d.gene_id LEFT JOIN (SELECT DISTINCT gene_id FROM {clusters} WHERE cluster <> -1) c ON c.gene_id = d.gene_id)
      SELECT CASE WHEN cl THEN 'clustered' WHEN e THEN 'eligible_not_clustered' WHEN an THEN 'annotated_not_eligible' ELSE 'without_go' END AS stage, count(*) AS genes FROM x GROUP BY 1""",
    "build_targets": f"WITH {_REGION} SELECT DISTINCT s.sample_id || '.tsv' AS file, grp FROM s JOIN (SELECT sample_id FROM {{design}}) d USING (sample_id)",
    "target_conflicts": f"WITH {_REGION} SELECT DISTINCT sample_id, 'within' AS kind FROM s GROUP BY id, sample_id HAVING count(DISTINCT grp) > 1 UNION SELECT sample_id, 'across' FROM s GROUP BY sample_id HAVING count(DISTINCT grp) > 1 AND count(DISTINCT id) > 1",
}
_SQL["gff_fields"] = _SQL["gff_fields"].removeprefix("{gff_lines}")
SQL = {k: duck(v) for k, v in _SQL.items()}
