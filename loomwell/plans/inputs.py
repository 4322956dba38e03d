"""Inputs of the registered queries, derived from the driver's tables by SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name: SQL over driver tables and other inputs, each written in braces.
VIEWS = {
    # gene x sample counts from order lines, with the counter's meta rows
    "counts": """SELECT concat('S', cast(l_suppkey % 12 AS string)) AS sample_id, concat('gene-', cast(l_partkey AS string)) AS gene_id, cast(sum(l_quantity) AS bigint) AS count
      FROM {lineitem} GROUP BY l_suppkey % 12, l_partkey
      UNION ALL SELECT concat('S', cast(l_suppkey % 12 AS string)), '__no_feature', count(*) FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_suppkey % 12
      UNION ALL SELECT concat('S', cast(l_suppkey % 12 AS string)), '__ambiguous', count(*) FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_suppkey % 12""",
    "design": """SELECT DISTINCT concat('S', cast(l_suppkey % 12 AS string)) AS sample_id, CASE l_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS grp FROM {lineitem}""",
    # one group mean of counts for each gene, and a table of contrasts with made-up p-values
    "group_means": """SELECT c.gene_id, d.grp, sum(c.count) / 4e0 AS mean_count FROM {counts} c JOIN {design} d ON c.sample_id = d.sample_id WHERE substr(c.gene_id, 1, 2) <> '__' GROUP BY c.gene_id, d.grp""",
    "de": """SELECT concat(a.grp, '_vs_', b.grp) AS contrast, a.gene_id, round(log2((a.mean_count + 1) / (b.mean_count + 1)) * 15e-1, 6) AS logFC,
        round(log2((a.mean_count + b.mean_count) / 2 + 1), 6) AS logCPM,
        ((cast(substr(a.gene_id, 6) AS bigint) * 7919 + ascii(a.grp) * 31 + ascii(b.grp)) % 1000 + 1) / 4000e0 AS PValue,
        least(1e0, ((cast(substr(a.gene_id, 6) AS bigint) * 7919 + ascii(a.grp) * 31 + ascii(b.grp)) % 1000 + 1) / 2000e0) AS FDR
      FROM {group_means} a JOIN {group_means} b ON a.gene_id = b.gene_id AND a.grp < b.grp""",
    "gff_lines": """SELECT p_partkey AS line_no, concat('chr', cast(p_partkey % 5 AS string)) AS seqid, 'src' AS source,
        CASE p_partkey % 3 WHEN 0 THEN 'gene' WHEN 1 THEN 'mRNA' ELSE 'exon' END AS feature, p_partkey * 100 AS start_at, p_partkey * 100 + p_size * 10 AS end_at,
        CASE p_partkey % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '.' ELSE '?' END AS strand,
        CASE p_partkey % 2 WHEN 0 THEN concat('ID=gene-', cast(p_partkey AS string), ';Name=', p_name, ';product=', p_type)
          ELSE concat('gene_id "gene-', cast(p_partkey AS string), '"; gene_name "', p_name, '"; note "', p_brand, '"') END AS attributes FROM {part}""",
    "uniprot_hits": """SELECT CASE h WHEN 2 THEN p_brand ELSE p_name END AS query, p_partkey * 3 + h AS hit_pos, CASE (p_partkey + h) % 4 WHEN 0 THEN 'Oryza sativa' ELSE 'Homo sapiens' END AS organism,
        CASE (p_partkey + h) % 4 WHEN 0 THEN '' WHEN 1 THEN 'cellular organisms, Viridiplantae' ELSE 'cellular organisms, Metazoa' END AS lineage, concat(p_type, ' (', p_brand, ')') AS gene_names,
        CASE (p_partkey * 7 + h) % 3 WHEN 0 THEN '' ELSE concat(p_type, ' function') END AS function_text,
        CASE (p_partkey * 5 + h) % 4 WHEN 0 THEN '' ELSE concat('response to ', p_brand, ' [GO:', lpad(cast(p_partkey % 61 + 64 AS string), 7, '0'), ']; growth [GO:', lpad(cast(p_partkey % 31 + 32 AS string), 7, '0'), ']') END AS go_bp,
        concat('binding ', p_brand, ' [GO:', lpad(cast(p_partkey % 7 + 125 AS string), 7, '0'), ']') AS go_mf, concat(p_brand, ' membrane') AS go_cc
      FROM (SELECT *, 0 AS h FROM {part} UNION ALL SELECT *, 1 FROM {part} UNION ALL SELECT *, 2 FROM {part}) x""",
    # three ontologies, each a tree with one root that covers all its terms: term 3 * j + o has the parent 3 * floor(j / 2) + o
    "go_terms": """SELECT concat('GO:', lpad(cast(p_partkey AS string), 7, '0')) AS go_id, CASE p_partkey % 3 WHEN 0 THEN 'BP' WHEN 1 THEN 'MF' ELSE 'CC' END AS ontology FROM {part}""",
    "go_edges": """SELECT concat('GO:', lpad(cast(p_partkey AS string), 7, '0')) AS child, concat('GO:', lpad(cast(cast(floor(floor(p_partkey / 3) / 2) AS bigint) * 3 + p_partkey % 3 AS string), 7, '0')) AS parent,
        CASE p_partkey % 4 WHEN 0 THEN 'part_of' ELSE 'is_a' END AS relation FROM {part} WHERE p_partkey >= 6""",
    # two terms of each ontology for a gene, its own and one near it, and now and then one that no ontology has
    "gene2go": """SELECT concat('gene-', cast(p_partkey AS string)) AS gene_id, concat('GO:', lpad(cast(p_partkey AS string), 7, '0')) AS go_id FROM {part}
      UNION SELECT concat('gene-', cast(p_partkey AS string)), concat('GO:', lpad(cast(p_partkey - p_partkey % 24 + (p_partkey * 5 + p_size) % 24 AS string), 7, '0')) FROM {part}
      UNION SELECT concat('gene-', cast(p_partkey AS string)), concat('GO:', lpad(cast(p_partkey - p_partkey % 12 + p_size % 12 AS string), 7, '0')) FROM {part}
      UNION SELECT concat('gene-', cast(p_partkey AS string)), concat('GO:', lpad(cast(CASE WHEN p_partkey % 11 = 0 THEN 9000000 + p_partkey ELSE p_partkey - p_partkey % 6 + (p_partkey * 7 + 2) % 6 END AS string), 7, '0')) FROM {part}""",
    # the canonical gene table: each gene in its contrast of greatest effect, with annotation text
    "genes": """SELECT d.gene_id, d.logFC AS log2FoldChange, d.PValue AS pvalue, d.FDR / 8 AS padj, p.p_name AS name_gff, concat(p.p_type, ' (', p.p_brand, ')') AS uniprot_names,
        CASE p.p_partkey % 5 WHEN 0 THEN 'hypothetical protein' ELSE concat(p.p_type, ' kinase activity') END AS uniprot_function,
        concat('term ', cast(p.p_partkey % 61 AS string), ' [GO:', lpad(cast(p.p_partkey % 61 + 64 AS string), 7, '0'), ']; step ', cast(p.p_partkey % 29 AS string), ' [GO:', lpad(cast(p.p_partkey % 29 + 32 AS string), 7, '0'), ']') AS bp,
        CASE p.p_partkey % 2 WHEN 0 THEN concat('act ', cast(p.p_partkey % 7 AS string), ' [GO:', lpad(cast(p.p_partkey % 7 + 125 AS string), 7, '0'), ']') ELSE '' END AS mf
      FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY abs(logFC) DESC, contrast) AS place FROM {de}) d JOIN {part} p ON d.gene_id = concat('gene-', cast(p.p_partkey AS string)) WHERE d.place = 1""",
    # clusters and pair similarities of genes, in blocks of neighbours
    "clusters": """SELECT CASE p_partkey % 3 WHEN 0 THEN 'BP' WHEN 1 THEN 'MF' ELSE 'CC' END AS ontology, CASE WHEN p_size > 25 THEN 'up' ELSE 'down' END AS direction,
        CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE cast(floor(p_partkey / 60) AS bigint) + 1 END AS cluster, concat('gene-', cast(p_partkey AS string)) AS gene_id, p_partkey AS k,
        (p_size - 25) / 10e0 AS log2FoldChange, ((p_partkey * 37) % 100) / 100e0 - 2e-1 AS cluster_silhouette FROM {part}""",
    "similarity": """SELECT a.ontology, a.direction, a.cluster, a.gene_id AS gene_a, b.gene_id AS gene_b, ((a.k * 31 + b.k * 17) % 100) / 100e0 AS sim
      FROM {clusters} a JOIN {clusters} b ON a.ontology = b.ontology AND a.direction = b.direction AND a.cluster = b.cluster AND a.k < b.k WHERE a.cluster <> -1""",
    "chunks": """SELECT doc_id AS chunk_id, source, CASE doc_id % 9 WHEN 0 THEN 'References' WHEN 1 THEN '2.1 Materials and Methods' ELSE 'Results' END AS section, text FROM {documents}""",
    "lexical_queries": """SELECT item_id AS query_id, text AS query FROM {benchmark}""",
    "rankings": """SELECT CASE m WHEN 0 THEN 'bm25' WHEN 1 THEN 'dense' ELSE 'hybrid' END AS method, doc_id % 97 AS query_id, doc_id AS chunk_id, source,
        row_number() OVER (PARTITION BY m, doc_id % 97 ORDER BY (doc_id * (7919 + m * 104)) % 1009, doc_id) AS rank
      FROM (SELECT *, 0 AS m FROM {documents} UNION ALL SELECT *, 1 FROM {documents} UNION ALL SELECT *, 2 FROM {documents}) x""",
    "qrels": """SELECT doc_id % 97 AS query_id, doc_id AS chunk_id, (doc_id * 31) % 3 AS grade FROM {documents}""",
    "claims": """SELECT conv_id AS gene_id, turn AS claim_index, role AS annotator, text AS claim,
        CASE (conv_id * 3 + turn) % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'partially_supported' WHEN 2 THEN 'unsupported' ELSE 'contradicted' END AS claim_label,
        cast((conv_id + turn) % 2 AS string) AS citations_correct FROM {conversations}""",
    "jobs": """SELECT event_id AS id, concat('S', cast(user_id % 20 AS string)) AS sample, user_id, event_type AS stage,
        CASE cast(floor(value) AS bigint) % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'erro' WHEN 2 THEN ' Running ' WHEN 3 THEN 'na fila' ELSE 'odd' END AS status, ts AS created_at, value FROM {events}""",
    "alignments": """SELECT l_orderkey * 10000000 + l_partkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS read_id, concat('chr', cast(l_partkey % 5 AS string)) AS chrom, (l_orderkey * 37 + l_linenumber * 101) % 200000 AS start_at,
        (l_orderkey * 37 + l_linenumber * 101) % 200000 + 60 AS end_at, CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand,
        cast(floor(l_quantity) AS int) AS mapq, cast(l_suppkey % 12 AS int) AS library, cast(floor(l_extendedprice) AS int) % 1000 AS qual_sum FROM {lineitem}""",
    "reads": """SELECT l_orderkey * 10000000 + l_partkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS read_id, repeat(substr('ACGTTGCAGATTACA', cast(l_linenumber AS int), 5), 4) AS seq,
        concat(repeat('I', cast(floor(l_quantity) AS int) % 15), repeat('#', 20 - cast(floor(l_quantity) AS int) % 15)) AS qual FROM {lineitem}""",
}


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n in VIEWS or n in TABLES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived input as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return query(spark, sf_dir, VIEWS[name])


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of SQL whose tables stand in braces."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in _needs(sql)})


def duck(sql: str) -> str:
    """The same SQL as one statement for DuckDB, derived inputs as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _needs(VIEWS[name]):
                add(n)
            order.append(name)

    for n in _needs(sql):
        add(n)
    plain = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in order]
    body = re.sub(r"{(\w+)}", r"\1", sql)
    if not plain:
        return body
    if body.lstrip()[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ", ".join(plain) + ", " + body.lstrip()[14:]
    return "WITH " + ", ".join(plain) + (", " + body.lstrip()[4:] if body.lstrip()[:5].upper() == "WITH " else " " + body)
