"""Retrieval metrics, their intervals, claim labels and the agreement of annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import columns as C
from loomwell.runtime import materialize

LABELS = ("supported", "partially_supported", "unsupported", "contradicted")


def pool_documents(rankings: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Each (query, chunk) of any method's first k once, with its pool id, in a blinded order."""
    pool = rankings.where(F.col("rank") <= k).select("query_id", "chunk_id").distinct()
    pool = pool.withColumn("pool_id", C.stable_id(F.col("query_id").cast("string"), F.col("chunk_id").cast("string")))
    order = Window.partitionBy("query_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "pool_id").cast("binary")))
    return pool.withColumn("position", F.row_number().over(order))


def pool_join(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """Rankings with the grades of their pairs; a missing or invalid grade is an error."""
    joined = rankings.join(qrels, ["query_id", "chunk_id"], "left")
    bad = joined.where(F.col("grade").isNull() | ~F.col("grade").isin(0, 1, 2)).limit(1000).count()
    if bad:
        raise ValueError(f"{bad} ranked pairs have no valid grade (counted up to 1000)")
    return joined


def retrieval_metrics(rankings: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """P@5, nDCG@k, reciprocal rank of grade 2 and pooled recall@k of each method and query."""
    graded = pool_join(rankings, qrels)
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    own = graded.groupBy("method", "query_id").agg(
        (F.sum(F.when((F.col("rank") <= 5) & (F.col("grade") > 0), 1).otherwise(0)) / 5).alias("p5"),
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
        F.coalesce(1 / F.min(F.when(F.col("grade") == 2, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when((F.col("rank") <= k) & (F.col("grade") > 0), 1).otherwise(0)).alias("hits"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "chunk_id"))
    ideal = qrels.withColumn("rank", place).groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("ideal"), F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("relevant"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return own.join(ideal, "query_id").select("method", "query_id", "p5", ratio("dcg", "ideal").alias("ndcg"), "rr", ratio("hits", "relevant").alias("recall"))


def method_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("method").agg(F.count(F.lit(1)).alias("queries"), *(F.avg(c).alias(c) for c in ("p5", "ndcg", "rr", "recall")))


def bootstrap_ci(values: DataFrame, repeats: int = 2000, seed: int = 20260811) -> DataFrame:
    """(method, mean, low, high): 95 % percentile interval of the mean by resampling queries.

    ``values`` has (method, value). Draw i of a repeat takes the query whose place among the method's values is
    an md5 of seed, repeat and i, so reruns agree. Draws are rows that meet their values in a join, so a
    method may have any number of queries; only its ``repeats`` means are gathered.
    """
    own = Window.partitionBy("method")
    placed = materialize(values.select("method", "value").withColumn("i", F.row_number().over(own.orderBy("value"))).withColumn("n", F.count(F.lit(1)).over(own)), "bootstrap-values")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("i").cast("string")).cast("binary"))
    draws = placed.select("method", "i", "n", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("r"))
    draws = draws.select("method", "r", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("n") + 1).cast("int").alias("i"))
    means = draws.join(placed.select("method", "i", "value"), ["method", "i"]).groupBy("method", "r").agg(F.avg("value").alias("m"))
    spread = means.groupBy("method").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    at = lambda k: F.get("ms", F.lit(k))
    return placed.groupBy("method").agg(F.avg("value").alias("mean")).join(spread, "method").select("method", "mean", at(int(0.025 * repeats)).alias("low"), at(min(repeats - 1, int(0.975 * repeats))).alias("high"))


def claim_metrics(claims: DataFrame) -> DataFrame:
    """Counts and shares of labels, strict accuracy and citation accuracy, overall (annotator null) and by annotator.

    An unknown label is an error, and so is a table without labels.
    """
    labelled = claims.where(F.coalesce("claim_label", F.lit("")) != "")
    if labelled.where(~F.col("claim_label").isin(*LABELS)).limit(1).count():
        raise ValueError("there are unknown claim labels")
    if not labelled.limit(1).count():
        raise ValueError("no claim has a label")
    judged = F.col("citations_correct").isin("0", "1")
    return labelled.rollup("annotator").agg(
        F.count(F.lit(1)).alias("labels"),
        *(F.count_if(F.col("claim_label") == n).alias(n) for n in LABELS),
        (F.count_if(F.col("claim_label") == "supported") / F.count(F.lit(1))).alias("accuracy"),
        F.try_divide(F.count_if(F.col("citations_correct") == "1"), F.count_if(judged)).alias("citation_accuracy"),
        F.countDistinct("gene_id", "claim_index").alias("claims"),
    )


def pairwise_kappa(labels: DataFrame) -> DataFrame:
    """(annotator_a, annotator_b, items, kappa) of all pairs with common items; expected agreement 1 gives 1.

    Of several labels of one annotator and item the last counts: by the column ``seq``, if there is
    one, else the greatest label.
    """
    last = F.max_by("label", "seq") if "seq" in labels.columns else F.max("label")
    labels = labels.groupBy("item", "annotator").agg(last.alias("label"))
    a, b = (labels.select("item", F.col("annotator").alias(f"annotator_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
    both = a.join(b, "item").where("annotator_a < annotator_b")
    cells = both.groupBy("annotator_a", "annotator_b", "label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))
    pair = ["annotator_a", "annotator_b"]
    whole = cells.groupBy(*pair).agg(F.sum("n").alias("items"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("agreed"))
    rows = cells.groupBy(*pair, F.col("label_a").alias("label")).agg(F.sum("n").alias("x"))
    cols = cells.groupBy(*pair, F.col("label_b").alias("label")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, [*pair, "label"]).groupBy(*pair).agg(F.sum(F.col("x") * F.col("y")).alias("chance"))
    po, pe = F.col("agreed") / F.col("items"), F.coalesce("chance", F.lit(0)) / (F.col("items") * F.col("items"))
    return whole.join(chance, pair, "left").select(*pair, "items", F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def generation_coverage(claims: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes, answered and abstained ones, and accepted and rejected claims (``accepted`` boolean)."""
    of_gene = claims.groupBy("gene_id").agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
    return genes.join(of_gene, "gene_id", "left").agg(
        F.count(F.lit(1)).alias("genes"), F.count_if(F.coalesce("yes", F.lit(0)) > 0).alias("answered"), F.count_if(F.coalesce("yes", F.lit(0)) == 0).alias("abstained"), F.coalesce(F.sum("yes"), F.lit(0)).alias("accepted_claims"), F.coalesce(F.sum("no"), F.lit(0)).alias("rejected_claims")
    )
