"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Documents of a source and an output shard form a stream of words, in a seeded order. Streams are
cut into blocks of equal length. Source quotas (whole blocks) go to the highest quotients
population / (2k + 1), where a source's population is the number of its blocks times its target
over its size; each source's quota is dealt to its shards in the same way, first to groups of
shards with the same leading digits, then within these, so that no source's shards are gathered in
one task. A stream takes each of
its blocks quota // blocks times, and the rest by a seeded systematic draw, so a block is taken at
most one time more than another.

The highest quotients are found without listing them all: every seat count lies within
1.5 * n * share + 2 of the rounded share, so only quotients in that window compete (n: number of
competitors); those below are seated beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.runtime import free_name, materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 64
SEED = "mix-1"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
DOCS_PER_SHARD = 2000
#: Hexadecimal digits by which a group of shards is divided: 4,096 rows at most.
_DIGITS = 3
_UNIT = 1024
_PARTS = 1 << 28


def apportion(df: DataFrame, groups: list[str], population: str, seats: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: the seats of each row by the highest quotients population / (2k + 1).

    ``seats`` (the same in all rows of a group) seats go to the rows of each group. Populations are
    whole numbers; rows without population get none. Ties go to the first row by ``order``, which
    must tell the rows of a group apart.
    """
    one = groups or [F.lit(0)]
    g = Window.partitionBy(*one)
    share = F.col(population) / F.sum(population).over(g)
    df = df.withColumn("_share", F.when(F.col(population) > 0, share).otherwise(F.lit(0.0))).withColumn("_n", F.count(F.lit(1)).over(g))
    df = df.withColumn("_near", F.floor(F.col(seats) * F.col("_share") + 0.5)).withColumn("_slack", F.ceil(1.5 * F.col("_n") * F.col("_share")) + 2)
    df = df.withColumn("_sure", F.when(F.col(population) > 0, F.greatest(F.lit(0), F.col("_near") - F.col("_slack"))).otherwise(F.lit(0)))
    ranked = Window.partitionBy(*one).orderBy(F.desc("_quotient"), *order, "_k")
    won = (
        df.withColumn("_left", F.col(seats) - F.sum("_sure").over(g))
        .where(F.col(population) > 0)
        .withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_near") + F.col("_slack"))))
        .withColumn("_quotient", F.col(population) / (2 * F.col("_k") + 1))
        .withColumn("_rank", F.row_number().over(ranked))
        .groupBy(*groups, *order)
        .agg(F.count_if(F.col("_rank") <= F.col("_left")).alias("_won"))
    )
    return df.join(won, [*groups, *order], "left").withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_share", "_n", "_near", "_slack", "_sure", "_won")


def water_fill(sources: DataFrame, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """Add ``target`` to (key, source, source_size, weight): shares by weight, none above its cap.

    Sharing by weight, stopping sources at cap times their size and sharing the excess again ends
    at min(cap, level * weight) for one level; sources sorted by cap / weight give it in one pass.
    """
    sources = sources.withColumn("_cap", cap * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    at = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("weight"), "key")
    before = F.coalesce(F.sum("_cap").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(at.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("_level", (budget * F.sum("source_size").over(everything) - before) / rest)
    level = F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.col("_level"))).over(everything)
    fair = F.coalesce(level * F.col("weight"), F.col("_cap").cast("double"))
    return sources.withColumn("target", F.least(F.col("_cap").cast("double"), fair)).drop("_cap", "_level")


def shard_digits(n_docs: int, per_shard: int = DOCS_PER_SHARD) -> int:
    """Hexadecimal digits that name a shard, so that shards hold about per_shard documents or fewer."""
    digits = 0
    while per_shard * 16**digits < n_docs:
        digits += 1
    return digits


def _dealt(streams: DataFrame, quotas: DataFrame, digits: int) -> DataFrame:
    """Streams with ``_quota``: each key's quota dealt to its shards, _DIGITS digits of their names at a time."""
    cuts = list(range(digits, 0, -_DIGITS))[::-1] or [0]
    level, before = quotas.withColumn("_at0", F.lit("")), "_at0"
    for i, cut in enumerate(cuts, 1):
        rows = streams.groupBy("key", F.substring("shard", 1, cut).alias(f"_at{i}"), F.substring("shard", 1, cuts[i - 2] if i > 1 else 0).alias(before)).agg(F.sum("_blocks").alias("_population"))
        rows = rows.join(level.select("key", before, "quota"), ["key", before])
        level = apportion(rows, ["key", before], "_population", "quota", [f"_at{i}"], "_got").select("key", f"_at{i}", F.col("_got").alias("quota"))
        before = f"_at{i}"
    return streams.join(level.select("key", F.col(before).alias("shard"), F.col("quota").alias("_quota")), ["key", "shard"])


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of numbers that aren't negative."""
    return ((a - a % b) / b).cast("long")


def _chosen(i: Column) -> Column:
    """Blocks among the first i of a stream that the draw takes once more."""
    return _div(i * F.col("_more") + F.col("_shift"), F.col("_blocks"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, seed: str = SEED, carry: list[str] | None = None, stream: bool = False) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``budget`` times
    all words. Null texts have no words and give none. Rows with equal doc_id are rows of their
    own. Reruns agree: order and draws come from md5 of doc_id (of the text, where that is null),
    source, shard and seed. An empty table gives an empty result; other columns than those in ``carry`` are
    ignored, and one in ``carry`` that has the name of a column of the result stays out. With ``stream``,
    _shard and _key name each row's stream.
    """
    carried = [c for c in carry or [] if c.lower() not in ("doc_id", "size", "source_size", "target", "taken")]
    sized = materialize(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string"),
            F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source"))).alias("key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            *(F.col(f"`{c}`").alias(f"_carried{i}") for i, c in enumerate(carried)),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce("text", F.lit(""))))).cast("binary")).alias("hash"),
        ),
        "mix-sizes",
    )
    digits = shard_digits(sized.count())
    sized = sized.withColumn("shard", F.substring("hash", 1, digits))
    streams = sized.groupBy("shard", "key", "source").agg(F.sum("size").alias("words"))
    sources = streams.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    sources = water_fill(sources, budget)
    # Blocks are short enough that the smallest source has some dozens of them.
    least = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(Window.partitionBy(F.lit(0)))
    sources = sources.withColumn("_length", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.coalesce(F.floor(least / BLOCK), F.lit(1)))))

    streams = streams.drop("source").join(sources, "key")
    streams = streams.withColumn("_length", F.greatest(F.lit(1), F.ceil(F.col("words") / F.greatest(F.lit(1), F.floor(F.col("words") / F.col("_length") + 0.5)))))
    streams = streams.withColumn("_blocks", F.ceil(F.col("words") / F.col("_length")))
    totals = streams.groupBy("key").agg(F.sum("_blocks").alias("_all"), F.first("target").alias("_t"), F.first("source_size").alias("_s"))
    totals = totals.withColumn("_population", F.when(F.col("_s") > 0, F.floor(F.col("_t") / F.col("_s") * F.col("_all") * _UNIT)).otherwise(F.lit(0)).cast("long"))
    totals = totals.withColumn("_seats", F.floor((F.sum("_population").over(Window.partitionBy(F.lit(0))) + _UNIT // 2) / _UNIT))
    quotas = apportion(totals, [], "_population", "_seats", ["key"], "quota").select("key", "quota")
    streams = _dealt(streams, quotas, digits)
    full = F.least(F.col("_quota"), CAP * F.col("_blocks"))
    streams = (
        streams.withColumn("_blocks", F.greatest("_blocks", F.lit(1)))
        .withColumn("_base", _div(full, F.col("_blocks")))
        .withColumn("_more", full % F.col("_blocks"))
        .withColumn("_shift", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), "shard", F.lit("/"), "key").cast("binary")), 1, 12), 16, 10).cast("long") % F.col("_blocks"))
        .select("shard", "key", "source_size", "target", *(F.col(c).cast("long") for c in ("_length", "_blocks", "_base", "_more", "_shift")))
    )
    order = Window.partitionBy("shard", "key").orderBy("hash", "doc_id", "size")
    docs_at = sized.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def words_before(x: Column) -> Column:
        i = _div(x, F.col("_length"))
        return _chosen(i) * F.col("_length") + (_chosen(i + 1) - _chosen(i)) * (x % F.col("_length"))

    start = F.col("_end") - F.col("size")
    taken = F.col("_base") * F.col("size") + words_before(F.col("_end")) - words_before(start)
    out = docs_at.join(streams, ["shard", "key"]).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(F.col(f"_carried{i}").alias(c) for i, c in enumerate(carried)), *([F.col("shard").alias("_shard"), F.col("key").alias("_key")] if stream else []))
    return out


def whole_copies(rows: DataFrame) -> DataFrame:
    """``_copies`` of each document of (_document, _key, _shard, _words, _taken): its taken words over its own, rounded up or down.

    The parts of copies of all documents of a source are added up from short documents to long ones (by
    shard and name among equally long ones), and a document has a copy more where the rounded sum
    grows. As words don't fall along that order, a source's words differ from those it takes by its
    longest document at most. The sums are made in three steps, over a source's lengths, over the
    shards of a length and over documents of both, so that no source is gathered.
    """
    taken, words = F.col("_taken"), F.col("_words")
    rows = rows.withColumn("_part", _div(2 * (taken % words) * _PARTS + words, 2 * words))
    lengths = rows.groupBy("_key", "_words").agg(F.sum("_part").alias("_parts"))
    shards = rows.groupBy("_key", "_words", "_shard").agg(F.sum("_part").alias("_parts"))
    upto = lambda by, order: F.sum("_parts").over(Window.partitionBy(*by).orderBy(order)) - F.col("_parts")
    lengths = lengths.select("_key", "_words", upto(["_key"], "_words").alias("_shorter"))
    shards = shards.select("_key", "_words", "_shard", upto(["_key", "_words"], "_shard").alias("_before"))
    at = shards.join(lengths, ["_key", "_words"]).select("_key", "_words", "_shard", (F.col("_shorter") + F.col("_before")).alias("_from"))
    own = Window.partitionBy("_key", "_words", "_shard").orderBy("_document").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(at, ["_key", "_words", "_shard"]).withColumn("_sum", F.col("_from") + F.sum("_part").over(own))
    rounded = lambda x: _div(x + F.lit(_PARTS // 2), F.lit(_PARTS))
    return summed.select("_document", (_div(taken, words) + rounded(F.col("_sum")) - rounded(F.col("_sum") - F.col("_part"))).cast("int").alias("_copies"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mix itself: whole copies of documents, so that each source has the words it takes within its longest document.

    Each document is taken as often as its taken words over its size, rounded up or down (see
    ``whole_copies``). Columns stay, whatever their names. A document is told from others by its id,
    source and text; rows that agree in all three count as one long document and are taken alike.
    Documents without words go; an empty table gives an empty result.
    """
    names, key, copies = docs.columns, free_name(docs, "_document"), free_name(docs, "_copies")
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "source", "text")]
    keyed = docs.withColumn(key, F.sha2(F.concat_ws("\u001f", *parts).cast("binary"), 256))
    rows = mix(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.col(key).alias("_document")), carry=["_document"], stream=True).where("size > 0")
    one = rows.groupBy("_shard", "_key", "_document").agg(F.sum("size").alias("_words"), F.sum("taken").alias("_taken"))
    told = whole_copies(materialize(one, "mix-documents")).where("_copies > 0").select(F.col("_document").alias(key), F.col("_copies").alias(copies))
    return keyed.join(told, key).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in names))
