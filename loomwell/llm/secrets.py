"""Secret scans, with corpus-wide frequency of ownership, in DataFrame operations only.

Candidates of three base kinds and of a generic kind are found with their places in each text. A
candidate's value is hashed, and for each hash the distinct repositories (documents) and owners
(sources) that hold it are counted over the whole corpus. A value that many owners hold, or many
repositories, is a widely copied example; one that few owners hold in few repositories looks live.
Base spans are always kept; generic ones are added where their value looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.runtime import materialize

_KEYWORD = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
#: kind: (pattern, group of the value, least length of the value)
KINDS = {
    "assign": (_KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: What must occur in a text for a kind to have a span in it.
_HINT = {"assign": _KEYWORD + r"""["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
#: For the last two, runs that are too short can be passed over at once; the spans are the same.
LONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
GENERIC = r"[A-Za-z0-9+/_=-]{20,}"
FEW_OWNERS = 2
FEW_REPOSITORIES = 20
#: A value in more than this share of the candidates is joined by broadcast; fewer than 4,096 values can be.
_HOT_SHARE = 4096


def _found(text: Column, pattern: str, group: int, least: int, hint: str, kind: int) -> Column:
    r"""Spans of a pattern: array of (start, kind, end, hash). \G ties each match to the one before,
    so that the lengths of what lies between add up to its place."""
    whole = F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?)({pattern})"), F.lit(0))
    match = F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?)({pattern})"), F.lit(2))
    value = F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?)({pattern})"), F.lit(2 + group)) if group else match
    rows = F.arrays_zip(whole.alias("w"), match.alias("m"), value.alias("v"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["w"])
        span = F.struct((end - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.substring(F.sha2(x["v"].cast("binary"), 256), 1, 32).alias("hash"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int,hash:string>>")
    folded = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(hint), folded).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """Candidates of each document: base and generic spans with hashed values.

    Adds ``base`` and ``extra`` (arrays of start, kind, end, hash; code points, end exclusive) to
    all columns. Null text counts as empty. Existing columns of those names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = [_found(text, LONG.get(k, p), g, least, _HINT[k], i) for i, (k, (p, g, least)) in enumerate(KINDS.items())]
    out = docs.drop("base", "extra").withColumn("base", F.array_sort(F.concat(*base)))
    generic = _found(text, GENERIC, 0, 20, GENERIC, len(KINDS))
    mixed = F.filter(generic, lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"]).rlike(r"[0-9]") & F.substring(text, x["start"] + 1, x["end"] - x["start"]).rlike("[A-Za-z]"))
    return out.withColumn("extra", F.filter(mixed, lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repositories, rows): distinct sources, distinct (source, document) pairs and rows of each hash.

    From (doc_id, source, hash) rows; null sources and ids count as one each. Rows are reduced to one
    for each hash, owner and repository before they meet by hash, in steps with partial aggregation,
    so that a value that very many documents hold makes no large group.
    """
    owned = candidates.groupBy("hash", "source", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("hash", "source").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return owned.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("rows"))


def _with_ownership(candidates: DataFrame) -> DataFrame:
    """Candidates with the counts of their hashes.

    A hash that holds more than 1 / _HOT_SHARE of all candidates would be a hot key, and there are
    fewer than _HOT_SHARE of them: these are broadcast, the others joined by hash.
    """
    owned = materialize(ownership(candidates), "secret-owners")
    total = owned.agg(F.sum("rows").alias("n")).first()["n"] or 0
    hot = F.col("rows") > max(1000, total // _HOT_SHARE)
    common, rare = owned.where(hot), owned.where(~hot)
    near = candidates.join(F.broadcast(common), "hash")
    far = candidates.join(F.broadcast(common.select("hash")), "hash", "left_anti").join(rare, "hash")
    return near.unionByName(far)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, "generic"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, few_owners: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES, drop: tuple[str, ...] = ()) -> DataFrame:
    """Every document with ``base``, ``found`` (base and added spans), ``counts``, ``n_live`` and ``n_example``.

    A value that more than ``few_owners`` owners (sources; null is one) or more than
    ``few_repositories`` repositories (documents) hold is a copied example. ``counts`` has (owners,
    repositories) of each span in ``found``. The other columns of docs are kept, but for those in
    ``drop``, through a table in the shared folder; columns of the new names are replaced. Empty
    tables, null ids, sources and texts and repeated rows are allowed; each row has one result.
    """
    scanned = materialize(scan(docs).drop(*drop, "found", "counts", "n_live", "n_example").withColumn("_row", F.monotonically_increasing_id()), "secrets")
    hashes = F.array_distinct(F.transform(F.concat("base", "extra"), lambda x: x["hash"]))
    candidates = scanned.where((F.size("base") > 0) | (F.size("extra") > 0)).select("_row", F.col("doc_id"), F.col("source"), F.explode(hashes).alias("hash"))
    told = _with_ownership(candidates).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("hash", F.struct("owners", "repositories")))).alias("_told"))
    joined = scanned.join(told, "_row", "left").drop("_row")

    def live(x: Column) -> Column:
        of = F.element_at("_told", x["hash"])
        return (of["owners"] <= few_owners) & (of["repositories"] <= few_repositories)

    return (
        joined.withColumn("found", F.array_sort(F.concat("base", F.filter("extra", live))))
        .withColumn("counts", F.transform("found", lambda x: F.element_at("_told", x["hash"])))
        .withColumn("n_live", F.size(F.filter("found", live)).cast("long"))
        .withColumn("n_example", (F.size("found") - F.col("n_live")).cast("long"))
        .drop("extra", "_told")
    )


def report(docs: DataFrame, few_owners: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, ownership, n_live and n_example of each document.

    ``ownership`` has owners/repositories of the value of each span in ``spans``.
    """
    slim = find(docs.select(F.col("doc_id").cast("long"), "source", "text"), few_owners, few_repositories, drop=("text",))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.array_remove(kinds, -1)) - F.size(F.array_remove(kinds, i)) for i in range(len(KINDS))]
    counts = [c.cast("long").alias(f"n_{k}") for c, k in zip(counts, KINDS)]
    of_spans = F.array_join(F.transform("counts", lambda x: F.concat_ws("/", x["owners"].cast("string"), x["repositories"].cast("string"))), ",")
    return slim.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"), of_spans.alias("ownership"), "n_live", "n_example")


def redact(docs: DataFrame, few_owners: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES, mark: str = "[secret]") -> DataFrame:
    """Documents with each found span (overlapping ones as one) replaced by ``mark``; all columns stay.

    Documents without spans keep their text as it is, null included. Columns may have any names.
    """
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        apart = x["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(apart, more).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    found = find(docs.select("doc_id", "source", "text", kept.alias("_columns")), few_owners, few_repositories)
    new = F.when(F.size("found") > 0, clean).otherwise(text)
    return found.select(*(new.alias("text") if c == "text" else F.col("_columns")[c].alias(c) for c in docs.columns))
