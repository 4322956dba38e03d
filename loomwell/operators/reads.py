"""Reads and alignments: quality encoding, trimming, duplicates, counting over features, profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detect_phred(reads: DataFrame, n: int | None = 10_000, order: str = "read_id") -> DataFrame:
    """One row: phred33 if any quality is under character 64 or none over 74 (or no reads), else phred64.

    Of the first ``n`` reads by ``order`` (None: of all); the task of each partition keeps n at most.
    """
    first = reads if n is None else reads.select(order, "qual").orderBy(order).limit(n)
    codes = F.transform(F.filter(F.split("qual", ""), lambda x: x != ""), lambda x: F.ascii(x))
    seen = first.select(F.array_min(codes).alias("lo"), F.array_max(codes).alias("hi")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return seen.select(F.when(F.col("lo") < 64, "phred33").when(F.col("hi") > 74, "phred64").otherwise("phred33").alias("encoding"), "lo", "hi")


def trim_reads(reads: DataFrame, window: int = 4, q: int = 15, leading: int = 3, trailing: int = 3, minlen: int = 36, crop: int | None = None, headcrop: int = 0, avgqual: float = 0, offset: int = 33) -> DataFrame:
    """Reads cut by a sliding window, weak ends, length, crop, head crop and mean quality, in this order; lost ones go.

    Other columns stay, such as the mate that trim_pairs needs.
    """
    others = [c for c in reads.columns if c not in ("seq", "qual")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for at, (seq, qual) in enumerate(zip(f["seq"], f["qual"])):
                v = np.frombuffer((qual or "").encode("latin-1"), np.uint8).astype(int) - offset
                n = min(len(seq or ""), len(v))
                if n >= window:
                    sums = np.convolve(v[:n], np.ones(window, int), "valid")
                    low = np.flatnonzero(sums < q * window)
                    n = int(low[0]) if len(low) else n
                a, b = 0, n
                while a < b and v[a] < leading:
                    a += 1
                while b > a and v[b - 1] < trailing:
                    b -= 1
                if b - a >= minlen:
                    if crop is not None:
                        b = min(b, a + crop)
                    a = min(b, a + headcrop)
                    if b > a and v[a:b].mean() >= avgqual:
                        keep.append((at, seq[a:b], qual[a:b]))
            rows = [k[0] for k in keep]
            texts = {n: pd.Series([k[i] for k in keep], dtype=object) for i, n in ((1, "seq"), (2, "qual"))}
            yield pd.DataFrame({c: pd.Series(f[c].to_numpy()[rows], dtype=None if f[c].dtype.kind in "iuf" else object) for c in others} | texts)

    rows = reads.select(*others, "seq", "qual")
    return rows.mapInPandas(run, rows.schema)


def trim_pairs(reads: DataFrame, **options) -> DataFrame:
    """Trimmed reads of (read_id, mate, seq, qual) whose both mates are left; those that lost one go."""
    mates = F.count(F.lit(1)).over(Window.partitionBy("read_id"))
    return trim_reads(reads, **options).withColumn("_mates", mates).where(F.col("_mates") == 2).drop("_mates")


def dedup_alignments(aln: DataFrame) -> DataFrame:
    """One alignment for each library, chromosome, five-prime end and strand: the best quality, then the least id.

    Where there is a column ``mate_start``, pairs whose mates start elsewhere are apart (null: no mate).

    By an aggregate with partial results, so that a hot place makes no large group.
    """
    end = F.when(F.col("strand") == "-", F.col("end_at")).otherwise(F.col("start_at"))
    best = F.max_by(F.struct(*aln.columns), F.struct("qual_sum", (-F.col("read_id")).alias("r")))
    mate = ["mate_start"] if "mate_start" in aln.columns else []
    return aln.groupBy("library", "chrom", end.alias("five_prime"), "strand", *mate).agg(best.alias("b")).select("b.*")


#: Each level of bins is so many times as wide as the one before; the last holds intervals of any length.
_WIDER, _LEVELS = 8, 12


def feature_bins(features: DataFrame, width: int = 1000) -> DataFrame:
    """(id, chrom, fs, fe, level, bin): each feature in the one or two bins that it touches on the level as wide as it is long."""
    length = F.col("fe") - F.col("fs") + 1
    level = F.lit(_LEVELS - 1)
    for k in range(_LEVELS - 2, -1, -1):
        level = F.when(length <= width * _WIDER**k, k).otherwise(level)
    placed = features.select("id", F.col("seqid").alias("chrom"), F.col("start_at").alias("fs"), F.col("end_at").alias("fe")).where("fs <= fe").withColumn("level", level)
    return placed.withColumn("bin", F.explode(_touched(F.col("fs"), F.col("fe"), F.col("level"), width)))


def _touched(start: Column, end: Column, level: Column, width: int) -> Column:
    step = (width * F.pow(F.lit(_WIDER), level)).cast("long")
    return F.sequence(F.floor(start / step), F.floor(end / step))


def count_features(aln: DataFrame, features: DataFrame, min_mapq: int = 10, width: int = 1000) -> DataFrame:
    """(id, n): reads that overlap one feature count for it; else __no_feature, __ambiguous, __too_low_aQual.

    Intervals are closed; a feature that ends before it starts overlaps none. Features are entered into nested bins, each on the level
    of its length, so a long one has two rows at most as well. Reads of one place are counted first
    and looked up once, on each level that has features, so a hot place is one row. Alignments with the same read_id share their features.
    """
    binned = feature_bins(features, width)
    levels = [r["level"] for r in binned.select("level").distinct().collect()]  # _LEVELS rows at most
    place = ["chrom", "start_at", "end_at"]
    good = aln.where(F.col("mapq") >= min_mapq)
    places = good.select(*place).distinct().withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    places = places.withColumn("bin", F.explode(_touched(F.col("start_at"), F.col("end_at"), F.col("level"), width)))
    hits = places.join(binned, ["chrom", "level", "bin"]).where((F.col("start_at") <= F.col("fe")) & (F.col("fs") <= F.col("end_at")))
    found = hits.groupBy(*place).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    of_read = good.join(found, place).groupBy("read_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    kind = F.when(F.col("mapq") < min_mapq, "__too_low_aQual").when(F.col("lo").isNull(), "__no_feature").when(F.col("lo") < F.col("hi"), "__ambiguous").otherwise(F.col("lo"))
    return aln.select("read_id", "mapq").join(of_read, "read_id", "left").groupBy(kind.alias("id")).agg(F.count(F.lit(1)).alias("n"))


def quality_profile(reads: DataFrame, offset: int = 33) -> DataFrame:
    """Reads and mean quality at each position (from 0)."""
    at = reads.select(F.posexplode(F.filter(F.split("qual", ""), lambda x: x != "")).alias("position", "c"))
    return at.groupBy("position").agg(F.count(F.lit(1)).alias("reads"), F.avg(F.ascii("c") - offset).alias("mean_quality"))


def base_content(reads: DataFrame) -> DataFrame:
    """Share of each base at each position."""
    at = reads.select(F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("position", "base")).groupBy("position", "base").agg(F.count(F.lit(1)).alias("n"))
    return at.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("position")))


def duplication_levels(reads: DataFrame) -> DataFrame:
    """How many distinct sequences occur how often."""
    return reads.groupBy("seq").agg(F.count(F.lit(1)).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("sequences"))


def read_profile(reads: DataFrame, offset: int = 33) -> DataFrame:
    """(read_id, length, gc, mean_quality) of each read; gc is the share of G and C, null for an empty read."""
    codes = F.transform(F.filter(F.split("qual", ""), lambda x: x != ""), lambda x: F.ascii(x) - offset)
    total = F.aggregate(codes, F.lit(0), lambda a, x: a + x)
    return reads.select("read_id", F.length("seq").alias("length"), F.try_divide(F.regexp_count("seq", F.lit("[GCgc]")), F.length("seq")).alias("gc"), F.try_divide(total, F.size(codes)).alias("mean_quality"))


def quality_quantiles(reads: DataFrame, offset: int = 33) -> DataFrame:
    """Lower quartile, median and upper quartile of the quality at each position (from 0), exactly.

    By counts of each position and quality, so that a position's values are never gathered.
    """
    at = reads.select(F.posexplode(F.filter(F.split("qual", ""), lambda x: x != "")).alias("position", "c")).groupBy("position", (F.ascii("c") - offset).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy("position").orderBy("q"))
    ranked = at.withColumn("upto", below).withColumn("all", F.sum("n").over(Window.partitionBy("position")))
    quantile = lambda p, name: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p), F.col("q"))).alias(name)
    return ranked.groupBy("position").agg(quantile(0.25, "q25"), quantile(0.5, "q50"), quantile(0.75, "q75"))


def overrepresented(reads: DataFrame, share: float = 0.001) -> DataFrame:
    """(seq, n, share) of the sequences that make more than ``share`` of all reads."""
    counted = reads.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    total = reads.agg(F.count(F.lit(1)).alias("_all"))
    return counted.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).where(F.col("share") > share).drop("_all")
