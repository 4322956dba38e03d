"""Annotation of genes: GFF and GTF attributes, protein hits, ontology terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import columns as C

ID_KEYS = ("ID", "gene_id", "GeneID", "gene")
ID_CHOICE = ("ID", "gene_id", "locus_tag", "Name", "Parent", "transcript_id")


def gff_table(lines: DataFrame) -> DataFrame:
    """Adds parsed ``attrs`` and the display fields id, name, product and note."""
    t = lines.withColumn("attrs", C.gff_attributes(F.col("attributes")))
    return (
        t.withColumn("id", C.attribute(F.col("attrs"), *ID_KEYS))
        .withColumn("name", C.attribute(F.col("attrs"), "Name", "gene", "gene_name"))
        .withColumn("product", C.attribute(F.col("attrs"), "Product", "product", "product_name", "description"))
        .withColumn("note", C.attribute(F.col("attrs"), "Note", "note", "description"))
    )


def gff_feature_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def gff_attribute_profile(lines: DataFrame) -> DataFrame:
    """Distinct values and the first example (by line) of each attribute key."""
    one = lines.select("line_no", F.explode(C.gff_attributes(F.col("attributes"))).alias("a"))
    return one.groupBy(F.col("a.key").alias("key")).agg(F.countDistinct("a.value").alias("n_values"), F.min_by("a.value", "line_no").alias("example"))


def normalize_strand(lines: DataFrame) -> DataFrame:
    """Strands other than + - and . become a point; ``fixed`` tells which rows changed."""
    odd = ~F.coalesce(F.col("strand"), F.lit("")).isin("+", "-", ".")
    return lines.withColumn("fixed", odd).withColumn("strand", F.when(odd, ".").otherwise(F.col("strand")))


def resolve_id_attribute(lines: DataFrame, feature: str, wanted: str) -> DataFrame:
    """The attribute that names a feature: the wanted one if any of its rows has it, else the first
    of the usual ones on its first row, else that row's first key."""
    rows = lines.where(F.col("feature") == feature).withColumn("keys", F.transform(C.gff_attributes(F.col("attributes")), lambda a: a["key"]))
    first = F.min_by("keys", "line_no")
    usual = F.element_at(F.array_intersect(F.array(*map(F.lit, ID_CHOICE)), first), 1)
    usual = F.when(F.size(F.array_intersect(F.array(*map(F.lit, ID_CHOICE)), first)) > 0, usual).otherwise(F.get(first, F.lit(0)))
    return rows.agg(F.coalesce(F.when(F.bool_or(F.array_contains("keys", wanted)), wanted), usual).alias("attribute"))


def annotate_with_gff(de: DataFrame, gff: DataFrame) -> DataFrame:
    """Left join on normalised ids; the first GFF row (by line) of an id wins.

    Adds ``gff_name``, ``gff_product``, ``gff_note`` and ``gff_text``: the product, if any row of the
    contrast has one, else the note; empty where the id is unknown. The GFF side is reduced to one
    row an id before the join.
    """
    named = gff_table(gff).where("id <> ''").withColumn("norm_id", C.normalize_id(F.col("id")))
    first = named.groupBy("norm_id").agg(F.min_by(F.struct("name", "product", "note"), "line_no").alias("g"))
    joined = de.withColumn("norm_id", C.normalize_id(F.col("gene_id"))).join(first, "norm_id", "left").drop("norm_id")
    name, product, note = (F.coalesce(F.col(f"g.{c}"), F.lit("")) for c in ("name", "product", "note"))
    joined = joined.select(*de.columns, name.alias("gff_name"), product.alias("gff_product"), note.alias("gff_note"))
    any_product = joined.groupBy("contrast").agg(F.bool_or(F.col("gff_product") != "").alias("_any"))
    return joined.join(any_product, "contrast").withColumn("gff_text", F.when(F.col("_any"), F.col("gff_product")).otherwise(F.col("gff_note"))).drop("_any")


HIT = ("hit_pos", "organism", "gene_names", "function_text", "go_bp", "go_mf", "go_cc")
QUERY_ORDER = ("gff_note", "gff_product", "gff_name")


def best_hit(hits: DataFrame) -> DataFrame:
    """One hit a query: an annotated plant, else an annotated one, else the first; then by position.

    Of the columns in ``HIT`` those that hits have are kept.
    """
    annotated = (F.trim(F.coalesce("function_text", F.lit(""))) != "") | (F.trim(F.coalesce("go_bp", F.lit(""))) != "")
    rank = F.when(C.is_plant(F.col("lineage"), F.col("organism")) & annotated, 0).when(annotated, 1).otherwise(2)
    kept = F.struct(*(c for c in HIT if c in hits.columns))
    return hits.groupBy("query").agg(F.min_by(kept, F.struct(rank.alias("r"), F.col("hit_pos").alias("p"))).alias("h")).select("query", "h.*")


def annotate_with_uniprot(annotated: DataFrame, hits: DataFrame) -> DataFrame:
    """Each contrast's query column (GFF note, product or name: the first with any value; else the gene
    id) joined with the best hit of each query; the query and hits that are missing stay null."""
    used = [c for c in QUERY_ORDER if c in annotated.columns]
    some = annotated.groupBy("contrast").agg(*(F.bool_or(C.usable(F.col(c)) != "").alias(f"_any_{c}") for c in used), F.count(F.lit(1)).alias("_rows"))
    query = F.coalesce(*(F.when(F.col(f"_any_{c}"), F.trim(F.coalesce(c, F.lit("")))) for c in used), F.col("gene_id"))
    joined = annotated.join(some, "contrast").withColumn("query", query).drop("_rows", *(f"_any_{c}" for c in used))
    return joined.join(best_hit(hits), "query", "left")


def unique_queries(annotated: DataFrame, column: str) -> DataFrame:
    return annotated.select(C.usable(F.col(column)).alias("query")).where("query <> ''").distinct()


def top_go_terms_by_ontology(rows: DataFrame, columns: dict[str, str], k: int = 15) -> DataFrame:
    """``top_go_terms`` of each ontology's column, with the ontology, in one pass over the rows."""
    long = rows.select("contrast", F.explode(F.array(*(F.struct(F.lit(o).alias("ontology"), F.col(c).alias("text")) for o, c in columns.items()))).alias("x"))
    both = long.select(F.struct("contrast", "x.ontology").alias("contrast"), "x.text")
    return top_go_terms(both, "text", k).select("contrast.contrast", "contrast.ontology", "term", "n", "rank")


def top_go_terms(rows: DataFrame, column: str, k: int = 15, sep: str = r"[;,|]") -> DataFrame:
    """The k commonest labels of an annotation column for each contrast (ties: by label)."""
    term = F.explode(F.transform(F.split(F.coalesce(column, F.lit("")), sep), lambda t: F.trim(F.regexp_replace(t, r"\s*\[[^\]]*\]", ""))))
    counted = rows.select("contrast", term.alias("term")).where("term <> ''").groupBy("contrast", "term").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("contrast").orderBy(F.desc("n"), "term")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def parse_contrast(c: Column) -> Column:
    """``G1(a;b)*G2(c;d)`` as array of (grp, samples)."""
    return F.transform(F.split(c, r"\*"), lambda g: F.struct(F.trim(F.regexp_extract(g, r"^([^(]*)", 1)).alias("grp"), F.transform(F.split(F.regexp_extract(g, r"\(([^)]*)\)", 1), ";"), lambda t: F.trim(t)).alias("samples")))


def build_targets(contrasts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, grp) of the contrasts' samples that have a file, each pair once, in order of first use."""
    groups = contrasts.select("id", F.posexplode(parse_contrast(F.col("name"))).alias("g", "group"))
    samples = groups.select("id", "g", F.col("group.grp").alias("grp"), F.posexplode("group.samples").alias("s", "sample_id"))
    return samples.join(files, "sample_id").groupBy("file", "grp").agg(F.min(F.struct("id", "g", "s")).alias("first")).select("file", "grp", "first.id", "first.g", "first.s")


def target_conflicts(contrasts: DataFrame) -> DataFrame:
    """Samples in both groups of one contrast (kind ``within``), or in different groups of several (``across``)."""
    groups = contrasts.select("id", F.explode(parse_contrast(F.col("name"))).alias("group"))
    samples = groups.select("id", F.col("group.grp").alias("grp"), F.explode("group.samples").alias("sample_id"))
    within = samples.groupBy("id", "sample_id").agg(F.countDistinct("grp").alias("n")).where("n > 1").select("sample_id", F.lit("within").alias("kind"))
    across = samples.groupBy("sample_id").agg(F.countDistinct("grp").alias("n"), F.countDistinct("id").alias("m")).where("n > 1 AND m > 1").select("sample_id", F.lit("across").alias("kind"))
    return within.union(across).distinct()


def split_invalid_go(gene2go: DataFrame, go_terms: DataFrame, valid: bool = True) -> DataFrame:
    """Rows whose term the ontology has, or those whose term it lacks."""
    return gene2go.join(go_terms.select("go_id"), "go_id", "left_semi" if valid else "left_anti").select(*gene2go.columns)


def drop_invalid_go(rows: DataFrame, key: str, column: str, invalid: DataFrame) -> DataFrame:
    """Rows whose annotation text lost the segments with an id of ``invalid`` (go_id), a table of any size.

    ``key`` tells rows apart. Segments are joined with the table by their ids and put together again
    in order; rows keep their other columns.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    segments = rows.select(key, F.posexplode(parts).alias("_at", "_text"))
    ids = segments.select(key, "_at", F.explode(C.go_ids(F.col("_text"))).alias("go_id"))
    bad = ids.join(invalid.select("go_id").distinct(), "go_id", "left_semi").select(key, "_at").distinct()
    kept = segments.join(bad, [key, "_at"], "left_anti").groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]), "; ").alias("_new"))
    return rows.join(kept, key, "left").withColumn(column, F.coalesce("_new", F.lit(""))).select(*rows.columns)


def unique_gene2go(genes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Distinct (gene_id, ontology, go_id) over the text columns of the ontologies; null texts have none."""
    listed = F.array(*(F.struct(F.lit(o).alias("ontology"), C.go_ids(F.col(c)).alias("ids")) for o, c in columns.items()))
    return genes.select("gene_id", F.explode(listed).alias("x")).select("gene_id", "x.ontology", F.explode("x.ids").alias("go_id")).distinct()
