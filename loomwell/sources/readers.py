"""Readers and writers: counts, GFF, DE tables, articles, evaluation files, index exports, reads."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwell.runtime import materialize


def _in_order(row: Column | None = None) -> Column:
    """A row's place over all files: file name, where its block starts, and the row's number in the read."""
    return F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), (F.monotonically_increasing_id() if row is None else row).alias("row"))


def _stem(pattern: str = r"([^/]+?)(\.[^./]+)?$") -> Column:
    return F.url_decode(F.regexp_extract(F.input_file_name(), pattern, 1))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, gene_id, count) of tab-separated count files; the file's name is the sample, ! starts comments."""
    rows = spark.read.schema("gene_id string, count long").option("sep", "\t").option("comment", "!").csv(path)
    return rows.select(_stem().alias("sample_id"), "gene_id", "count")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF, GFF3 and GTF lines of nine fields; comments and shorter lines go.

    ``line_no``, a struct of file, block and row, is in the order of the lines, over many files too.
    """
    raw = spark.read.text(path).select("value", _in_order().alias("line_no"))
    parts = F.split(F.trim("value"), "\t")
    rows = raw.where(~F.col("value").startswith("#")).select("line_no", parts.alias("p")).where(F.size("p") >= 9)
    return rows.select("line_no", *(F.col("p")[i].alias(n) for i, n in enumerate(("seqid", "source", "feature"))), F.col("p")[3].try_cast("long").alias("start_at"), F.col("p")[4].try_cast("long").alias("end_at"), F.col("p")[5].alias("score"), F.col("p")[6].alias("strand"), F.col("p")[7].alias("phase"), F.col("p")[8].alias("attributes"))


def write_de(df: DataFrame, path: str) -> None:
    """A DE table as one dataset with a partition a contrast; contrasts that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("contrast").parquet(path)


def read_de(spark: SparkSession, path: str, contrast: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if contrast is None else df.where(F.col("contrast") == contrast)


def contrasts_of(spark: SparkSession, path: str) -> DataFrame:
    """(contrast): the sheets of a DE dataset, by the names of its partitions alone; no file is opened."""
    files, place = _files(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(place(path)) if f.isDirectory() and f.getPath().getName().startswith("contrast=")]
    found = [unquote(n.removeprefix("contrast=")) for n in sorted(names)]
    return spark.createDataFrame([(None if n == "__HIVE_DEFAULT_PARTITION__" else n,) for n in found], "contrast string")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Whole Markdown files as (source, stem, text)."""
    return spark.read.text(path, wholetext=True).select(_stem(r"([^/]+)$").alias("source"), _stem().alias("stem"), F.col("value").alias("text"))


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, whose first name may start with a byte-order mark."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_rag_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of results, one row an element; lists in it stay arrays (see rag_chunks)."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def rag_chunks(results: DataFrame, keys: tuple[str, ...] = ("gene_id",), column: str = "chunks") -> DataFrame:
    """One row for each element of a list of structs, with ``keys`` and its place (from 1) as ``hit_rank``."""
    return results.select(*keys, F.posexplode(column).alias("_at", "_x")).select(*keys, (F.col("_at") + 1).alias("hit_rank"), "_x.*")


def read_go(spark: SparkSession, terms: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Ontology terms (go_id, ontology) and edges (child, parent, relation, ontology) from CSV files."""
    return spark.read.schema("go_id string, ontology string").option("header", True).csv(terms), spark.read.schema("child string, parent string, relation string, ontology string").option("header", True).csv(edges)


def read_uniprot_hits(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table of hits; header names kept, ``hit_pos`` (file, block, row) added in order."""
    return spark.read.option("sep", "\t").option("header", True).csv(path).withColumn("hit_pos", _in_order())


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Entity policies (a JSON object by gene) as flat rule rows for evidence.blocked."""
    rule = "struct<any:array<string>,all:array<string>,unless_any:array<string>>"
    kind = f"map<string,struct<blocked_chunk_rules:array<{rule}>,contextual_aliases:array<struct<alias:string,require_any:array<string>>>>>"
    genes = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("gene_id", "p"))
    none = F.array().cast("array<string>")
    rules = genes.select("gene_id", F.posexplode("p.blocked_chunk_rules").alias("i", "r")).select("gene_id", (F.col("i") + 1).alias("rule_index"), F.lit("rule").alias("kind"), *(F.coalesce(f"r.{c}", none).alias(c) for c in ("any", "all", "unless_any")))
    aliases = genes.select("gene_id", F.posexplode("p.contextual_aliases").alias("i", "r")).select("gene_id", (F.col("i") + 1).alias("rule_index"), F.lit("alias").alias("kind"), F.coalesce("r.require_any", none).alias("any"), F.array("r.alias").alias("all"), none.alias("unless_any"))
    return rules.union(aliases)


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(label, phrase) of a pattern file, a JSON object with lists of species, protein-family and ontology terms."""
    kind = "struct<species_terms:array<string>,protein_family_terms:array<string>,go_terms:array<string>>"
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("p"))
    labels = (("SPECIES", "species_terms"), ("PROTEIN_FAMILY", "protein_family_terms"), ("GO_TERM", "go_terms"))
    lists = F.array(*(F.struct(F.lit(label).alias("label"), F.coalesce(f"p.{c}", F.array().cast("array<string>")).alias("t")) for label, c in labels))
    long = row.select(F.explode(lists).alias("x")).select("x.label", F.explode("x.t").alias("phrase"))
    return long.where(F.trim("phrase") != "").distinct()


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity resolution (a JSON object by gene): stable ids, symbols and orthologs as arrays, null ones empty."""
    kind = "map<string,struct<stable_ids:array<string>,aliases:array<string>,orthologs:array<string>,paralogs:array<string>>>"
    genes = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("gene_id", "p"))
    return genes.select("gene_id", *(F.coalesce(f"p.{c}", F.array().cast("array<string>")).alias(c) for c in ("stable_ids", "aliases", "orthologs", "paralogs")))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and Hadoop's class of paths."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


_POINTER = "CURRENT"


def export_index(chunks: DataFrame, doc_count: int, path: str, model: DataFrame | None = None, keep: int = 2) -> None:
    """Chunks, the BM25 model, if given, and a one-row manifest; refused when the chunks aren't doc_count.

    Each export is a version of its own, written whole and checked; then the file that names the
    current version is replaced by a rename, so a crash at any time leaves the export before as it
    was. The ``keep`` newest versions stay, for those who read them.
    """
    spark = chunks.sparkSession
    name = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/versions/{name}"
    files, place = _files(spark, path)
    chunks.write.parquet(f"{folder}/chunks")
    ready = spark.read.parquet(f"{folder}/chunks")
    told = ready.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*ready.columns)).alias("x")).first()
    if told["n"] != doc_count:
        files.delete(place(folder), True)
        raise ValueError(f"the index has {told['n']} chunks, the model {doc_count} documents")
    if model is not None:
        model.write.parquet(f"{folder}/model")
    spark.createDataFrame([(told["n"], told["x"])], "chunks long, digest long").coalesce(1).write.json(f"{folder}/manifest")

    hadoop = spark._jvm.org.apache.hadoop.fs
    beside, pointer = place(f"{path}/.{_POINTER}.{name}"), place(f"{path}/{_POINTER}")
    out = files.create(beside, True)
    out.write(bytearray(name.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, pointer, over)
    older = sorted((f for f in files.listStatus(place(f"{path}/versions")) if f.getPath().getName() != name), key=lambda f: -f.getModificationTime())
    for f in older[max(0, keep - 1) :]:
        files.delete(f.getPath(), True)


def index_version(spark: SparkSession, path: str) -> str:
    """The folder of the current version of an exported index."""
    return f"{path.rstrip('/')}/versions/{spark.read.text(f'{path}/{_POINTER}').first()['value'].strip()}"


def import_model(spark: SparkSession, path: str) -> DataFrame:
    """The BM25 model of an exported index."""
    return spark.read.parquet(f"{index_version(spark, path)}/model")


def import_index(spark: SparkSession, path: str) -> DataFrame:
    """An exported index, if its rows are those that the manifest tells."""
    folder = index_version(spark, path)
    chunks = spark.read.parquet(f"{folder}/chunks")
    want = spark.read.schema("chunks long, digest long").json(f"{folder}/manifest").first()
    have = chunks.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*chunks.columns)).alias("x")).first()
    if want is None or (have["n"], have["x"]) != (want["chunks"], want["digest"]):
        raise ValueError("the export was changed after it was written")
    return chunks


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Reads of four-line records as (read_id, mate, seq, qual); the mate is told by the file's name.

    Files may be large: they are read in blocks, line by line. Only a line's number in its file tells a
    header from a quality line, so the lines of the blocks before are counted first (a row a block),
    and each line's number follows from its block and its place there; the four lines of a record
    then meet by file and record number.
    """
    mate = F.when(F.col("file").rlike(r"_R?2[._]"), 2).otherwise(1)
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("row"))
    lines = materialize(lines, "fastq-lines")
    blocks = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    placed = lines.join(blocks.withColumn("before", F.coalesce(before, F.lit(0))), ["file", "start"])
    line = F.col("before") + F.col("row") - F.col("first")
    numbered = placed.select("file", F.floor(line / 4).alias("record"), (line % 4).alias("at"), "value")
    pick = lambda i: F.max(F.when(F.col("at") == i, F.col("value")))
    records = numbered.groupBy("file", "record").agg(pick(0).alias("h"), pick(1).alias("seq"), pick(3).alias("qual")).where("h IS NOT NULL AND qual IS NOT NULL")
    return records.select(F.regexp_extract("h", r"^@(\S+)", 1).alias("read_id"), mate.alias("mate"), "seq", "qual")
