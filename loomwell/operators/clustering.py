"""Ontology similarity, gene clusters, their metrics, and the ranking of candidates."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import columns as C
from loomwell.runtime import free_name, materialize, partitions

# Function texts that say nothing, weights and limits.
GENERIC_FUNCTION = r"(?i)^(function:\s*)?(hypothetical|uncharacterized|unknown|predicted|putative|expressed)( protein)?( of unknown function)?[.\s]*$"
GENERIC_NAME = r"(?i)hypothetical|uncharacterized|unknown|predicted|putative protein|expressed protein|similar to .*protein|os\d+g\d+.*protein"
WEIGHTS = {"is_a": 0.8, "part_of": 0.6}
MIN_SIMILARITY = {"BP": 0.50, "MF": 0.60, "CC": 0.85}
CANONICAL = ["gene_id", "log2FoldChange", "pvalue", "padj", "Name GFF", "Uniprot gene names", "Uniprot Function", "Uniprot BP", "Uniprot MF", "Uniprot CC"]
ALIASES = {
    "gene_id": ["gene_id", "Unnamed: 0"],
    "log2FoldChange": ["log2FoldChange", "logFC", "log_fold_change"],
    "pvalue": ["pvalue", "PValue", "p.value", "P.Value"],
    "padj": ["padj", "FDR", "adj.P.Val", "qvalue"],
    "Name GFF": ["Name GFF", "protein_name", "Product GFF", "Note GFF", "gene_id", "Unnamed: 0"],
    "Uniprot gene names": ["Uniprot gene names", "Prot. encontrada (C3)", "Prot. encontrada (C4)", "Product GFF", "protein_name", "Name GFF"],
    "Uniprot Function": ["Uniprot Function", "Funcao (C3)", "Funcao (C4)", "Função (C3)", "Função (C4)", "Product GFF", "Note GFF"],
    "Uniprot BP": ["Uniprot BP", "BP (C3)", "BP (C4)"],
    "Uniprot MF": ["Uniprot MF", "MF (C3)", "MF (C4)"],
    "Uniprot CC": ["Uniprot CC", "CC (C3)", "CC (C4)"],
}


def normalize_de_table(df: DataFrame) -> DataFrame:
    """The ten canonical columns, from whichever aliases the table has; texts trimmed, numbers read."""
    out, missing = [], []
    for name in CANONICAL:
        found = next((a for a in ALIASES[name] if a in df.columns), None)
        if found is None and name == "gene_id" and df.columns and df.columns[0] not in {"logFC", "logCPM", "LR", "PValue", "FDR"}:
            found = df.columns[0]
        if found is None and name in ("log2FoldChange", "pvalue", "padj", "gene_id"):
            missing.append(name)
            continue
        c = F.lit("") if found is None else F.col(f"`{found}`")
        out.append((C.parse_number(c) if name in ("log2FoldChange", "pvalue", "padj") else F.trim(F.coalesce(c.cast("string"), F.lit("")))).alias(name))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*out)


def clean_genes(genes: DataFrame, names: tuple[str, ...], function: str, go: tuple[str, ...], padj: float = 0.05, lfc: float = 1.0, min_go: int = 2) -> DataFrame:
    """Genes with an effect, two ontology ids or more and a telling function; adds direction and useful_name.

    Repeated non-empty ids are an error.
    """
    repeated = genes.where("trim(gene_id) <> ''").groupBy("gene_id").count().where("count > 1").limit(10).collect()
    if repeated:
        raise ValueError(f"gene_id must be unique: {[r['gene_id'] for r in repeated]}")
    ids = sum((C.go_count(F.col(c)) for c in go), F.lit(0))
    told = (F.trim(function) != "") & ~F.trim(function).rlike(GENERIC_FUNCTION)
    useful = F.lit(False)
    for n in names:
        t = F.trim(F.coalesce(n, F.lit("")))
        useful = useful | ((t != "") & ~t.rlike(GENERIC_NAME))
    kept = genes.where((F.trim("gene_id") != "") & (F.col("padj") <= padj) & (F.abs("log2FoldChange") >= lfc) & (ids >= min_go) & told)
    return kept.withColumn("direction", F.when(F.col("log2FoldChange") > 0, "upregulated").otherwise("downregulated")).withColumn("useful_name", useful)


def go_closure(edges: DataFrame, terms: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(term, ancestor, s): the greatest product of weights on a path; 1 for the term itself.

    In round k the best walks of exactly 2**k edges are continued by all of up to as many, so that each round
    doubles the length and adds paths that aren't known yet, not all pairs of known ones. Edges of an unknown
    relation lead nowhere.
    """
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    best = lambda rows: rows.groupBy("term", "ancestor").agg(F.max("s").alias("s"))

    def joined(walks: DataFrame, on: DataFrame) -> DataFrame:
        further = on.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("further"), F.col("s").alias("more"))
        return walks.join(further, "ancestor").select("term", F.col("further").alias("ancestor"), (F.col("s") * F.col("more")).alias("s"))

    steps = edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor"), F.element_at(w, F.col("relation")).alias("s")).where("s IS NOT NULL AND child <> parent")
    walks = materialize(best(steps), "go-walks")
    closure = materialize(best(walks.union(terms.select(F.col("go_id").alias("term"), F.col("go_id").alias("ancestor"), F.lit(1.0).alias("s")))), "go-closure")
    while walks.limit(1).count():
        rows = closure.withColumn("old", F.col("s")).unionByName(joined(walks, closure.where("term <> ancestor")).withColumn("old", F.lit(None).cast("double")))
        new = materialize(rows.groupBy("term", "ancestor").agg(F.max("s").alias("s"), F.max("old").alias("old")), "go-closure")
        closure = new.select("term", "ancestor", "s")
        # Products of one path in another order differ in their last digit, which is no better value.
        if not new.where(F.col("old").isNull() | (F.col("s") > F.col("old") * (1 + _ROUNDING))).limit(1).count():
            break
        walks = materialize(best(joined(walks, walks)), "go-walks")
    return closure.join(terms.select(F.col("go_id").alias("term")).distinct(), "term", "left_semi")


#: Terms of an ancestor that meet in one task, and terms of a block whose pairs with another block's are all formed.
LOT, BLOCK = 4096, 1024
_ROUNDING = 1e-12


def _limit(limits: float | dict[str, float]) -> Column:
    """The limit of a row: a number, or by its ``ontology``."""
    if not isinstance(limits, dict):
        return F.lit(float(limits))
    return F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("ontology"))


def _ranked(closure: DataFrame, used: DataFrame) -> DataFrame:
    """(term, ancestor, s, m, sv, mass, least) of the terms in use, an ancestor's m terms.

    A term's ancestors stand in one order, those of few terms first; ``mass`` is what an ancestor and
    those after it bring to the term's whole value ``sv``.
    """
    own = closure.join(used.groupBy(F.col("go_id").alias("term")).agg(F.min("least").alias("least")), "term")
    sizes = own.groupBy("ancestor").agg(F.count(F.lit(1)).alias("m"))
    by_term = Window.partitionBy("term")
    later = by_term.orderBy("m", "ancestor").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return own.join(sizes, "ancestor").select("term", "ancestor", "s", "m", F.sum("s").over(by_term).alias("sv"), F.sum("s").over(later).alias("mass"), "least")


def _candidate_terms(ranked: DataFrame, lot: int) -> DataFrame:
    """Pairs (term_a <= term_b) that can reach their limit, by the rarest ancestor they may share.

    Of two terms' common ancestors the first is c. All that both can have in common is their mass from c
    on, so at least one of them has ``least`` of its value there: only such rows ask an ancestor's terms.
    An ancestor's terms are cut into lots, and askers sent to each, so that a root is many tasks' work.
    """
    lots = F.greatest(F.lit(1), F.ceil(F.col("m") / lot)).cast("int")
    asks = ranked.where(F.col("mass") >= F.col("least") * F.col("sv") - _ROUNDING)
    asks = asks.select("ancestor", F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot"), F.col("term").alias("x"), F.col("mass").alias("mass_x"), F.col("sv").alias("sv_x"), F.col("least").alias("least_x"))
    asked = ranked.select("ancestor", F.pmod(F.xxhash64("term"), lots).cast("int").alias("lot"), F.col("term").alias("y"), F.col("mass").alias("mass_y"), F.col("sv").alias("sv_y"), F.col("least").alias("least_y"))
    enough = F.col("mass_x") + F.col("mass_y") >= F.least("least_x", "least_y") * (F.col("sv_x") + F.col("sv_y")) - _ROUNDING
    met = asks.join(asked, ["ancestor", "lot"]).where(enough)
    return met.select(F.least("x", "y").alias("term_a"), F.greatest("x", "y").alias("term_b")).distinct()


def _valued(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """``sim`` of (term_a, term_b): the values of shared ancestors on both sides over both whole values; 0 without one."""
    values = closure.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("ancestor", "s"))).alias("v"), F.sum("s").alias("sv"))
    for x in "ab":
        pairs = pairs.join(values.select(F.col("term").alias(f"term_{x}"), F.col("v").alias(f"v_{x}"), F.col("sv").alias(f"sv_{x}")), f"term_{x}")
    shared = F.array_intersect(F.map_keys("v_a"), F.map_keys("v_b"))
    both = F.aggregate(shared, F.lit(0.0), lambda t, k: t + F.element_at("v_a", k) + F.element_at("v_b", k))
    return pairs.withColumn("sim", both / (F.col("sv_a") + F.col("sv_b"))).drop("v_a", "v_b", "sv_a", "sv_b")


def _block_product(table: pa.Table) -> pa.Table:
    """All pairs of two blocks' terms (or of one block's) that share an ancestor, both orders.

    Only ancestors that both blocks have are visited; each adds the values on both sides to the pairs under it.
    """
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    sides = []
    for block in dict.fromkeys((one, two)):
        rows = table.filter(pa.array(table.column("block").to_numpy() == block)).combine_chunks()
        lists = rows.column("values").combine_chunks()
        values = lists.flatten()
        at = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
        sides.append((rows.column("term").combine_chunks(), rows.column("sv").to_numpy(), at, values.field("ancestor"), values.field("s").to_numpy()))
    names = pa.concat_arrays([x[3] for x in sides]).dictionary_encode()
    codes, at = names.indices.to_numpy(), 0
    places = []  # of each ancestor: its terms in a block and their values
    for _, _, rows, ancestors, s in sides:
        own = codes[at : at + len(ancestors)]
        at += len(ancestors)
        order = np.argsort(own, kind="stable")
        keys, starts = np.unique(own[order], return_index=True)
        places.append({k: (rows[x], s[x]) for k, x in zip(keys.tolist(), np.split(order, starts[1:]))})
    (left, sv_a, *_), (right, sv_b, *_) = sides[0], sides[-1]
    shared = np.zeros((len(left), len(right)))
    for k in places[0].keys() & places[-1].keys():
        (a, s_a), (b, s_b) = places[0][k], places[-1][k]
        shared[np.ix_(a, b)] += s_a[:, None] + s_b[None, :]
    a, b = np.nonzero(shared)
    sim = shared[a, b] / (sv_a[a] + sv_b[b])
    term_a, term_b = left.take(pa.array(a)), right.take(pa.array(b))
    if one == two:
        return pa.table({"term_a": term_a, "term_b": term_b, "sim": sim})
    return pa.table({"term_a": pa.concat_arrays([term_a, term_b]), "term_b": pa.concat_arrays([term_b, term_a]), "sim": np.concatenate([sim, sim])})


def _all_term_pairs(closure: DataFrame, used: DataFrame, block: int) -> DataFrame:
    """(term_a, term_b, sim) of all terms in use that share an ancestor, as a blocked sparse product.

    Terms are dealt to blocks of about ``block`` terms, each with its ancestors, and every two blocks meet in one task,
    so that an ancestor of all terms is many tasks' work and a pair's whole sum is made where it is formed.
    """
    own = closure.join(used.select(F.col("go_id").alias("term")).distinct(), "term", "left_semi")
    packed = own.groupBy("term").agg(F.sum("s").alias("sv"), F.sort_array(F.collect_list(F.struct("ancestor", "s"))).alias("values"))
    packed = materialize(packed, "terms-packed")
    blocks = max(1, -(-packed.count() // block))
    dealt = packed.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "term", "sv", "values")
    return dealt.groupBy("one", "two").applyInArrow(_block_product, "term_a string, term_b string, sim double")


def term_similarity(closure: DataFrame, used: DataFrame, least: float = 0.0, lot: int = LOT) -> DataFrame:
    """(term_a, term_b, sim) of the terms in use that share an ancestor and are ``least`` alike, both orders and equal ones.

    Without a limit, all pairs are formed in blocks. With a column ``least``, ``used`` has a limit for each term. Pairs
    under the limit aren't formed, but where two terms' rarest common ancestor leaves room for it; a root that covers
    all terms is split into lots of ``lot`` terms.
    """
    if "least" not in used.columns and least <= 0:
        return _all_term_pairs(closure, used, min(lot, BLOCK))
    terms = used if "least" in used.columns else used.withColumn("least", F.lit(float(least)))
    ranked = materialize(_ranked(closure, terms), "terms-ranked")
    limits = terms.groupBy(F.col("go_id").alias("term_a")).agg(F.min("least").alias("least"))
    found = materialize(_valued(_candidate_terms(ranked, lot), ranked).join(limits, "term_a").where((F.col("sim") >= F.col("least") - _ROUNDING) & (F.col("sim") > 0)).select("term_a", "term_b", "sim"), "term-similarity")
    return found.union(found.where("term_a < term_b").select(F.col("term_b").alias("term_a"), F.col("term_a").alias("term_b"), "sim"))


#: Terms below an ancestor that names a home, at most, and terms of the signatures that meet in one task; rows of terms compared at a time.
HOME, LOAD, ROWS = 512, 4096, 256


def _homes(closure: DataFrame, used: DataFrame, most: int) -> DataFrame:
    """(kind, term, home, resident): the homes in which a term of ``used`` (kind, term, limit) meets all that are alike.

    A term lives at its ancestor of most terms, up to ``most``, or by itself. Of two terms' common ancestors, in one
    order of all, the first is c. All that both can have in common is what c and those after it bring to their
    values, so for one of them that is the limit's part of its whole value: this one visits the homes of all terms of c.
    """
    own = closure.join(used, "term")
    sizes = own.groupBy("kind", "ancestor").agg(F.count(F.lit(1)).alias("m"))
    by_term = Window.partitionBy("kind", "term")
    later = by_term.orderBy("m", "ancestor").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    home = F.coalesce(F.max(F.when(F.col("m") <= most, F.struct("m", "ancestor"))).over(by_term)["ancestor"], F.col("term"))
    asks = F.sum("s").over(later) >= F.col("limit") * F.sum("s").over(by_term) * (1 - 1e-9)
    placed = materialize(own.join(sizes, ["kind", "ancestor"]).select("kind", "term", "ancestor", home.alias("lives"), asks.alias("asks")), "term-homes")
    below = placed.select("kind", "ancestor", F.col("lives").alias("home")).distinct()
    return placed.where("asks").join(below, ["kind", "ancestor"]).groupBy("kind", "term", "home").agg(F.max(F.col("lives") == F.col("home")).alias("resident"))


def _best_matches(signatures: pa.Table, terms: pa.Table) -> pa.Table:
    """(sig_a < sig_b, sim) of the residents and all that meet them and reach the limit: best-match averages, rows of terms at a time."""
    out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    if signatures.num_rows and terms.num_rows:
        signatures, terms = signatures.combine_chunks(), terms.combine_chunks()
        sig, lot, resident, limit = (signatures.column(c).to_numpy() for c in ("sig", "lot", "resident", "limit"))
        lists = signatures.column("terms").combine_chunks()
        held = pc.index_in(lists.flatten(), value_set=terms.column("term").combine_chunks()).to_numpy()
        n = lists.value_lengths().to_numpy().astype(np.int64)
        start = np.cumsum(n) - n
        values = terms.column("values").combine_chunks()
        at = np.repeat(np.arange(terms.num_rows), values.value_lengths().to_numpy())
        flat = values.flatten()
        keys, s, sv = flat.field("ancestor").dictionary_encode().indices.to_numpy(), flat.field("s").to_numpy(), terms.column("sv").to_numpy()
        order = np.argsort(keys, kind="stable")
        under = np.split(order, np.flatnonzero(np.diff(keys[order])) + 1)  # of each ancestor: its terms' entries
        two_lots = signatures.column("one")[0].as_py() != signatures.column("two")[0].as_py()
        rows = np.flatnonzero(resident)
        cuts = np.flatnonzero(np.diff((np.cumsum(n[rows]) - n[rows]) // ROWS)) + 1
        found = []
        for part in np.split(rows, cuts) if len(rows) else ():
            size = n[part]
            first = np.cumsum(size) - size
            asked, own = np.unique(held[np.repeat(start[part] - first, size) + np.arange(size.sum())], return_inverse=True)
            place = np.full(len(sv), -1)
            place[asked] = np.arange(len(asked))
            shared = np.zeros((len(asked), len(sv)))
            for e in under:
                a = e[place[at[e]] >= 0]
                if len(a):
                    shared[np.ix_(place[at[a]], at[e])] += s[a][:, None] + s[e][None, :]
            sim = (shared / (sv[asked][:, None] + sv[None, :]))[own]
            to = np.add.reduceat(np.maximum.reduceat(sim, first, axis=0)[:, held], start, axis=1)
            back = np.add.reduceat(np.maximum.reduceat(sim[:, held], start, axis=1), first, axis=0)
            both = (to + back) / (size[:, None] + n[None, :])
            good = (both >= limit[part][:, None] - _ROUNDING) & (both > 0) & (~resident[None, :] | (sig[part][:, None] < sig[None, :])) & (sig[part][:, None] != sig[None, :])
            if two_lots:
                good &= lot[part][:, None] != lot[None, :]
            x, y = np.nonzero(good)
            found.append((np.minimum(sig[part][x], sig[y]), np.maximum(sig[part][x], sig[y]), both[x, y]))
        if found:
            out = [np.concatenate(c) for c in zip(*found)]
    return pa.table({"sig_a": out[0], "sig_b": out[1], "sim": out[2]})


def gene_similarity(gene2go: DataFrame, closure: DataFrame, least: float | dict[str, float] = 0.0, keys: tuple[str, ...] = (), home: int = HOME, load: int = LOAD) -> DataFrame:
    """(keys, gene_a < gene_b, sim): best-match averages of the genes' terms that are ``least`` or more.

    ``keys`` may be ``ontology``, so that each gene has a set of terms for each, with its own limit. Genes with the same
    set are one signature. Two signatures that reach the limit hold two terms that do, so they meet at the home of one
    of these (see ``_homes``); there all residents are compared with all that are there. Homes of more than about ``load``
    terms of signatures are cut into lots, every two of which are a task's work. Signatures move with the names of their
    terms, a home gets each term's ancestors once, and only pairs that reach the limit leave it. With limit 0, all that
    share an ancestor come out.
    """
    k = list(keys)
    known = closure.select(F.col("term").alias("go_id")).distinct()
    sets = gene2go.join(known, "go_id", "left_semi").groupBy(*k, "gene_id").agg(F.sort_array(F.collect_set("go_id")).alias("terms"))
    kind = F.concat_ws("\u001f", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in k)) if k else F.lit("")
    sets = materialize(sets.withColumn("kind", kind).withColumn("named", F.unhex(F.sha2(F.concat_ws(",", "kind", "terms").cast("binary"), 256))), "gene-terms")
    signatures = sets.groupBy("named").agg(*(F.first(x).alias(x) for x in k), F.first("kind").alias("kind"), F.first("terms").alias("terms")).withColumn("limit", _limit(least))
    signatures = materialize(signatures.select("named", F.monotonically_increasing_id().alias("sig"), "kind", "terms", "limit"), "signatures")

    held = signatures.select("sig", "kind", "limit", F.explode("terms").alias("term"))
    homes = _homes(closure, held.groupBy("kind", "term").agg(F.min("limit").alias("limit")), home)
    met = held.join(homes, ["kind", "term"]).groupBy("sig", "kind", "home").agg(F.max("resident").alias("resident"))
    met = materialize(met.join(signatures.select("sig", "limit", "terms"), "sig"), "signature-homes")
    lots = met.groupBy("kind", "home").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("terms")) / load)).cast("int").alias("lots"))
    dealt = met.join(lots, ["kind", "home"]).withColumn("lot", F.pmod(F.xxhash64("sig"), "lots").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    task = ["kind", "home", "one", "two"]
    dealt = dealt.select("kind", "home", F.least("lot", "with").alias("one"), F.greatest("lot", "with").alias("two"), "lot", "sig", "resident", "limit", "terms")
    values = closure.join(held.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("s").alias("sv"), F.collect_list(F.struct("ancestor", "s")).alias("values"))
    needed = dealt.select(*(F.col(c).alias(f"_{c}") for c in task), F.explode("terms").alias("term")).distinct().join(values, "term")
    found = dealt.groupBy(*task).cogroup(needed.groupBy(*(f"_{c}" for c in task))).applyInArrow(_best_matches, "sig_a long, sig_b long, sim double")

    # Two signatures may meet at more than one home.
    pairs = found.repartition("sig_a").groupBy("sig_a", "sig_b").agg(F.max("sim").alias("sim"))
    pairs = pairs.union(signatures.select("sig", "sig", F.lit(1.0)))
    genes = sets.join(signatures.select("named", "sig"), "named")
    left = genes.select(*k, F.col("gene_id").alias("_x"), F.col("sig").alias("sig_a"))
    right = genes.select(F.col("gene_id").alias("_y"), F.col("sig").alias("sig_b"))
    both = pairs.join(left, "sig_a").join(right, "sig_b").where("sig_a <> sig_b AND _x <> _y OR _x < _y")
    return both.select(*k, F.least("_x", "_y").alias("gene_a"), F.greatest("_x", "_y").alias("gene_b"), "sim")


def _components(edges: DataFrame) -> DataFrame:
    """(gene_id, root) by least labels, hopping twice a round, until none changes."""
    both = materialize(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cluster-edges")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")), "cluster-labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hop = labels.join(near, "a").select("a", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = labels.select(F.col("a").alias("root"), F.col("root").alias("further"))
        new = materialize(hop.join(jump, "root", "left").select("a", F.least("root", F.coalesce("further", "root")).alias("root"), "old"), "cluster-labels")
        labels = new.select("a", "root")
        if not new.where("root <> old").limit(1).count():
            return labels.withColumnRenamed("a", "gene_id")


def _link(pairs: pd.DataFrame) -> pd.DataFrame:
    """Complete linkage of one component, in rounds: groups that are each other's nearest merge.

    Of groups equally near the one first by name is taken. Pairs without a row never merge: after a round a
    pair of groups has a row only if all pairs of their parts had one. Memory goes with the pairs.
    """
    names, ends = np.unique(np.concatenate([pairs["a"], pairs["b"]]), return_inverse=True)
    n, sim = len(names), pairs["sim"].to_numpy()
    a, b = np.sort(ends.reshape(2, -1), axis=0)
    leader = np.arange(n)
    while len(a):
        x, y, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sim, sim])
        order = np.lexsort((y, -s, x))
        first = order[np.concatenate([[True], x[order][1:] != x[order][:-1]])]
        best = np.full(n, -1)
        best[x[first]] = y[first]
        keep = np.flatnonzero((best >= 0) & (best[best] == np.arange(n)) & (np.arange(n) < best))
        to, parts = np.arange(n), np.ones(n, np.int64)
        to[best[keep]], parts[keep] = keep, 2
        leader = to[leader]
        lo, hi = np.sort([to[a], to[b]], axis=0)
        apart = lo != hi
        key, sim = lo[apart] * n + hi[apart], sim[apart]
        order = np.argsort(key, kind="stable")
        key, sim = key[order], sim[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        a, b = key[at] // n, key[at] % n
        whole = np.diff(np.append(at, len(key))) == parts[a] * parts[b]
        sim = np.minimum.reduceat(sim, at)[whole] if len(at) else sim
        a, b = a[whole], b[whole]
    size = np.bincount(leader, minlength=n)
    return pd.DataFrame({"node": names, "leader": names[leader], "size": size[leader]})


def _link_in_rounds(edges: DataFrame) -> DataFrame:
    """What _link gives, by joins and aggregates over (a < b, sim) of components of any size.

    After a round a pair of groups has a row only if all pairs of their parts had one, so groups
    that hold a pair under the limit stay apart.
    """
    members = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("leader", F.col("node")), "link-members")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
        best = both.groupBy("a").agg(F.min(F.struct((-F.col("sim")).alias("far"), "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        mutual = materialize(best.where("a < b").join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]), "link-mutual")
        if not mutual.limit(1).count():
            break
        for side in ("a", "b"):
            to = mutual.select(F.col("b").alias(side), F.col("a").alias("_to")).unionByName(mutual.select(F.col("a").alias(side), F.col("a").alias("_to")))
            edges = edges.join(to, side, "left").withColumn(f"_parts_{side}", F.when(F.col("_to").isNull(), 1).otherwise(2)).withColumn(side, F.coalesce("_to", side)).drop("_to")
        merged = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("sim").alias("sim"), F.count(F.lit(1)).alias("n"), F.first(F.col("_parts_a") * F.col("_parts_b")).alias("all"))
        edges = materialize(merged.where("n = all").select("a", "b", "sim"), "link-edges")
        members = materialize(members.join(mutual.select(F.col("b").alias("leader"), F.col("a").alias("_to")), "leader", "left").select("node", F.coalesce("_to", "leader").alias("leader")), "link-members")
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    return members.join(sizes, "leader").select("node", "leader", "size")


def _node(keys: list[str], gene: str) -> Column:
    return F.concat_ws("\u001f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), gene)


def complete_linkage(pairs: DataFrame, min_sim: float | Column, min_size: int = 3, keys: tuple[str, ...] = (), local: int = 2_000_000) -> DataFrame:
    """(keys, gene_id, cluster): clusters whose members are all at least min_sim alike; -1 for small ones.

    ``min_sim`` may be a column, such as a limit for each ontology. Groups only merge inside a
    connected component of the pairs that reach it. Components of up to ``local`` pairs are linked
    in a task each, larger ones by rounds of joins over all of them; both merge groups that are each
    other's nearest (ties: by name), round by round. Clusters are numbered by their first gene
    within ``keys`` (texts; null counts as empty). Genes without such a pair have no row.
    """
    names = list(keys)
    # Averages that are equal but for their last digit are a tie.
    close = pairs.withColumn("sim", F.round("sim", 12)).where(F.col("sim") >= min_sim).select(_node(names, "gene_a").alias("a"), _node(names, "gene_b").alias("b"), "sim")
    close = materialize(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").where("a < b").groupBy("a", "b").agg(F.max("sim").alias("sim")), "link-pairs")
    roots = _components(close.select("a", "b"))
    inside = close.join(roots.select(F.col("gene_id").alias("a"), "root"), "a")
    large = materialize(inside.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local).select("root"), "link-large")
    schema = "node string, leader string, size long"
    linked = inside.join(large, "root", "left_anti").groupBy("root").applyInPandas(_link, schema)
    if large.limit(1).count():
        linked = linked.unionByName(_link_in_rounds(inside.join(large, "root", "left_semi").select("a", "b", "sim")))
    parts = F.split("node", "\u001f")
    linked = linked.select(*(parts[i].alias(k) for i, k in enumerate(names)), parts[len(names)].alias("gene_id"), "leader", "size")
    small = F.col("size") < min_size
    order = Window.partitionBy(*(names or [F.lit(0)])).orderBy("leader")  # leaders only: a row a cluster
    leaders = linked.where(~small).select(*names, "leader").distinct().withColumn("cluster", F.row_number().over(order))
    return linked.join(leaders, [*names, "leader"], "left").select(*names, "gene_id", F.when(small, -1).otherwise(F.col("cluster")).cast("long").alias("cluster"))


def silhouettes(pairs: DataFrame, labels: DataFrame, keys: tuple[str, ...] = (), of: DataFrame | None = None) -> DataFrame:
    """(keys, gene_id, cluster, silhouette) of the clustered genes, or those named in ``of`` (keys, gene_id); null with fewer than two clusters.

    Pairs that have no row are at distance 1, so a cluster without a pair is at the greatest distance
    and needs no row: the nearest other cluster is the nearest of those with a pair, or at distance 1.
    """
    k = list(keys) or ["_all"]
    if not keys:
        pairs, labels, of = pairs.withColumn("_all", F.lit(0)), labels.withColumn("_all", F.lit(0)), of and of.withColumn("_all", F.lit(0))
    inside = labels.where("cluster <> -1").select(*k, "gene_id", "cluster")
    sizes = inside.groupBy(*k, "cluster").agg(F.count(F.lit(1)).alias("n"))
    clusters = sizes.groupBy(*k).agg(F.count(F.lit(1)).alias("clusters"))
    known = pairs.select(*k, F.col("gene_a").alias("gene_id"), F.col("gene_b").alias("other"), "sim").union(pairs.select(*k, "gene_b", "gene_a", "sim"))
    asked = inside
    if of is not None:
        known, asked = (df.join(of, [*k, "gene_id"], "left_semi") for df in (known, inside))
    near = known.join(inside.select(*k, F.col("gene_id").alias("other"), F.col("cluster").alias("towards")), [*k, "other"]).groupBy(*k, "gene_id", "towards").agg(F.sum("sim").alias("total"))
    near = near.join(sizes.select(*k, F.col("cluster").alias("towards"), F.col("n").alias("m")), [*k, "towards"])
    own = F.col("cluster") == F.col("towards")
    sums = asked.join(near, [*k, "gene_id"], "left").groupBy(*k, "gene_id", "cluster").agg(F.max(F.when(own, F.col("total"))).alias("total"), F.min(F.when(~own, 1 - F.col("total") / F.col("m"))).alias("nearest"))
    out = sums.join(sizes, [*k, "cluster"]).join(clusters, k)
    a, b = 1 - F.coalesce("total", F.lit(0.0)) / (F.col("n") - 1), F.least(F.coalesce("nearest", F.lit(1.0)), F.lit(1.0))
    score = F.when(F.col("n") < 2, 0.0).when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(0.0)
    return out.select(*keys, "gene_id", "cluster", F.when(F.col("clusters") > 1, score).alias("silhouette"))


def prune_silhouette(pairs: DataFrame, labels: DataFrame, min_size: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Labels with genes of negative silhouette, and clusters under min_size, made noise, until none is left.

    All keys go through the rounds together. After the first, only genes of the clusters that have changed and
    genes with a pair in one of these are looked at again, as no other silhouette can have changed.
    """

    def without_small(x: DataFrame) -> DataFrame:
        sizes = x.where("cluster <> -1").groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("_n"))
        kept = x.join(sizes.where(F.col("_n") >= min_size), [*keys, "cluster"], "left")
        return kept.select(*keys, "gene_id", F.when(F.col("_n").isNull(), -1).otherwise(F.col("cluster")).cast("long").alias("cluster"))

    labels, again = materialize(without_small(labels.select(*keys, "gene_id", F.col("cluster").cast("long"))), "labels"), None
    while True:
        bad = materialize(silhouettes(pairs, labels, keys, again).where("silhouette < 0").select(*keys, "gene_id", "cluster"), "labels-bad")
        if not bad.limit(1).count():
            return labels
        changed = bad.select(*keys, "cluster").distinct()
        members = materialize(labels.join(changed, [*keys, "cluster"], "left_semi").select(*keys, "gene_id"), "labels-changed")
        beside = [pairs.select(*keys, F.col(x).alias("gene_id"), F.col(y).alias("other")).join(members.withColumnRenamed("gene_id", "other"), [*keys, "other"], "left_semi").select(*keys, "gene_id") for x, y in (("gene_a", "gene_b"), ("gene_b", "gene_a"))]
        again = materialize(members.union(beside[0]).union(beside[1]).distinct(), "labels-again")
        marked = labels.join(bad.select(*keys, "gene_id", F.lit(True).alias("bad")), [*keys, "gene_id"], "left")
        labels = materialize(without_small(marked.select(*keys, "gene_id", F.when(F.col("bad"), -1).otherwise(F.col("cluster")).cast("long").alias("cluster"))), "labels")


def semantic_clusters(genes: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("ontology", "direction"), limits: dict[str, float] = MIN_SIMILARITY, min_size: int = 3) -> DataFrame:
    """Clusters of the genes of each key, and their metrics, in one run over all keys.

    ``genes`` has the keys and gene_id, ``pairs`` the keys, gene_a, gene_b and sim; one of the keys is
    ``ontology``, whose limit the linkage takes. Complete linkage, pruning by silhouette and numbering
    follow each other. Genes without a cluster, as those without a pair, have -1 and null metrics.
    """
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("ontology"))
    linked = materialize(complete_linkage(pairs, limit, min_size, keys), "linked")
    # Genes that no cluster holds now have none later, so their pairs count in none of the rounds.
    for x in "ab":
        pairs = pairs.join(linked.where("cluster <> -1").select(*keys, F.col("gene_id").alias(f"gene_{x}")), [*keys, f"gene_{x}"], "left_semi")
    pairs = materialize(pairs.select(*keys, "gene_a", "gene_b", "sim"), "clustered-pairs")
    labels = materialize(renumber(prune_silhouette(pairs, linked, min_size, keys), list(keys)), "labels")
    scored = materialize(silhouettes(pairs, labels, keys).withColumnRenamed("silhouette", "cluster_silhouette"), "silhouettes")
    a, b = (labels.where("cluster <> -1").select(*keys, F.col("gene_id").alias(f"gene_{x}"), F.col("cluster").alias(f"cluster_{x}")) for x in "ab")
    inner = pairs.join(a, [*keys, "gene_a"]).join(b, [*keys, "gene_b"]).where("cluster_a = cluster_b").groupBy(*keys, F.col("cluster_a").alias("cluster")).agg(F.min("sim").alias("min_pairwise_similarity"))
    whole = scored.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("cluster_size"), F.avg("cluster_silhouette").alias("mean_silhouette"), F.min("cluster_silhouette").alias("min_silhouette"))
    metrics = whole.join(inner, [*keys, "cluster"], "left").withColumn("cluster_quality", quality(F.col("mean_silhouette")))
    told = scored.join(metrics, [*keys, "cluster"])
    names = ["cluster_silhouette", "cluster_size", "mean_silhouette", "min_silhouette", "min_pairwise_similarity", "cluster_quality"]
    return genes.select(*keys, "gene_id").join(told, [*keys, "gene_id"], "left").select(*keys, "gene_id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), *names)


def clusters_of_genes(genes: DataFrame, gene2go: DataFrame, edges: DataFrame, terms: DataFrame, limits: dict[str, float] = MIN_SIMILARITY, min_size: int = 3) -> DataFrame:
    """The whole chain: ontology closure, gene similarities over each ontology's limit, linkage, pruning, numbers and metrics.

    ``genes`` has gene_id and direction, ``gene2go`` gene_id, ontology and go_id, ``terms`` go_id. Genes of a
    direction are clustered by themselves, in each ontology in which they have terms.
    """
    closure = go_closure(edges, terms)
    directed = genes.select("gene_id", "direction").distinct()
    own = materialize(gene2go.join(terms.select("go_id"), "go_id", "left_semi").join(directed, "gene_id").select("gene_id", "ontology", "direction", "go_id"), "chain-terms")
    pairs = materialize(gene_similarity(own, closure, limits, ("ontology", "direction")), "chain-pairs")
    return semantic_clusters(own.select("ontology", "direction", "gene_id").distinct(), pairs, ("ontology", "direction"), limits, min_size)


def renumber(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters 1..n in order of their old number within each key; noise stays -1."""
    noise = (F.col("cluster") == -1).alias("_noise")
    return labels.withColumn("cluster", F.when(F.col("cluster") == -1, -1).otherwise(F.dense_rank().over(Window.partitionBy(*keys, noise).orderBy("cluster"))).cast("long"))


_KEY = ["ontology", "direction", "cluster"]


def quality(mean: Column) -> Column:
    return F.when(mean.isNull(), "unknown").when(mean >= 0.30, "strong").when(mean >= 0.10, "borderline").otherwise("weak")


def cluster_metrics(clusters: DataFrame, similarity: DataFrame) -> DataFrame:
    """Size, mean and least silhouette, least pairwise similarity and quality of each cluster."""
    own = clusters.where("cluster <> -1").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size"), F.avg("cluster_silhouette").alias("mean_silhouette"), F.min("cluster_silhouette").alias("min_silhouette"))
    least = similarity.groupBy(*_KEY).agg(F.min("sim").alias("min_similarity"))
    return own.join(least, _KEY, "left").withColumn("quality", quality(F.col("mean_silhouette")))


def _totals(similarity: DataFrame) -> DataFrame:
    """(ontology, direction, cluster, gene_id, total): sums of each gene's similarities, each in one order of the partners.

    Ranks by unrounded sums hang on their last digit, so they mustn't on how rows are dealt: a gene's partners before it
    (by length and text of the name) are added from the first on, those after it from the last on.
    """
    ends = F.explode(F.array(*(F.struct(F.col(own).alias("gene_id"), F.col(other).alias("other"), F.lit(first).alias("first")) for own, other, first in (("gene_a", "gene_b", True), ("gene_b", "gene_a", False)))))
    rows = similarity.select(*_KEY, ends.alias("x"), "sim").select(*_KEY, "x.*", F.struct(F.length("x.other").alias("n"), F.col("x.other").alias("name"), "sim").alias("row"))
    added = lambda mine, asc: F.aggregate(F.sort_array(F.collect_list(F.when(mine, F.col("row"))), asc), F.lit(0.0), lambda t, r: t + F.coalesce(r["sim"], F.lit(0.0)))
    return rows.groupBy(*_KEY, "gene_id").agg((added(F.col("first"), False) + added(~F.col("first"), True)).alias("total"))


def cluster_representatives(clusters: DataFrame, similarity: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` members of each cluster by centrality (to 12 places), silhouette, effect and gene id."""
    inside = clusters.where("cluster <> -1")
    sizes = inside.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size"))
    scored = inside.join(sizes, _KEY).join(_totals(similarity), [*_KEY, "gene_id"], "left").withColumn("centrality", F.when(F.col("size") > 1, F.coalesce("total", F.lit(0.0)) / (F.col("size") - 1)))
    order = Window.partitionBy(*_KEY).orderBy(F.desc_nulls_last(F.round("centrality", 12)), F.desc_nulls_last("cluster_silhouette"), F.desc_nulls_last(F.abs("log2FoldChange")), "gene_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*_KEY, "gene_id", "log2FoldChange", "cluster_silhouette", "centrality", "rank")


def cluster_summary(clusters: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Clusters, clustered genes, genes and mean silhouette of each ontology and direction, and rolled up.

    ``asked`` (ontology, direction) names pairs that have a row in any case, with zeros if they have no genes.
    """
    inside = F.col("cluster") != -1
    told = clusters.rollup("ontology", "direction").agg(
        F.countDistinct(F.when(inside, F.struct("ontology", "direction", "cluster"))).alias("clusters"),
        F.countDistinct(F.when(inside, F.col("gene_id"))).alias("clustered_genes"),
        F.countDistinct("gene_id").alias("genes"),
        F.avg(F.when(inside, F.col("cluster_silhouette"))).alias("mean_silhouette"),
    )
    if asked is None:
        return told
    missing = asked.select("ontology", "direction").distinct().join(clusters.select("ontology", "direction").distinct(), ["ontology", "direction"], "left_anti")
    zero = F.lit(0).cast("long")
    return told.unionByName(missing.select("ontology", "direction", *(zero.alias(c) for c in ("clusters", "clustered_genes", "genes")), F.lit(None).cast("double").alias("mean_silhouette")))


def final_cluster_table(clusters: DataFrame) -> DataFrame:
    """Position of each row: noise last, then by cluster and gene, within ontology and direction."""
    order = Window.partitionBy("ontology", "direction").orderBy(F.col("cluster") == -1, "cluster", "gene_id")
    return clusters.withColumn("position", F.row_number().over(order))


def prioritize(representatives: DataFrame, genes: DataFrame, interpretations: DataFrame | None = None) -> DataFrame:
    """Candidates ranked over ontologies: selected ones first, then breadth, quality, centrality, effect, padj, gene.

    With a ``go_terms`` column of representatives, the candidates get the distinct labels (clusters in
    order of their key) as ``go_labels``; with ``uniprot_names`` in genes, a primary name; and with
    both a ``search_query`` of the name and the first three labels. ``interpretations`` (ontology,
    direction, cluster, interpretation) give ``cluster_interpretations``.
    """
    key = F.concat_ws(":", "ontology", "direction", F.col("cluster").cast("string"))
    labelled = "go_terms" in representatives.columns
    in_order = F.sort_array(F.collect_list(F.struct(key.alias("k"), *([F.coalesce("go_terms", F.lit("")).alias("t")] if labelled else []))))
    grouped = representatives.groupBy("gene_id").agg(
        F.avg("centrality").alias("centrality_score"),
        F.min("mean_silhouette").alias("min_cluster_quality"),
        F.countDistinct("ontology").alias("n_ontologies"),
        F.array_join(F.sort_array(F.collect_set("ontology")), "; ").alias("represented_ontologies"),
        F.array_join(F.sort_array(F.collect_set(key)), "; ").alias("represented_clusters"),
        *([C.go_labels(F.array_join(F.transform(in_order, lambda x: x["t"]), ";")).alias("go_labels")] if labelled else []),
    )
    found = grouped.join(genes, "gene_id").withColumn("selected_for_search", F.col("n_ontologies") >= 2)
    found = found.withColumn("selection_reason", F.when(F.col("selected_for_search"), "representative_in_multiple_ontologies").otherwise("representative_in_single_ontology"))
    if "uniprot_names" in genes.columns:
        found = found.withColumn("primary_name", C.primary_name(F.col("uniprot_names")))
        if labelled:
            found = found.withColumn("search_query", F.array_join(F.concat(F.array("primary_name"), F.slice("go_labels", 1, 3)), ", "))
    if interpretations is not None:
        told = representatives.join(interpretations, _KEY).groupBy("gene_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), "interpretation"))), lambda x: x["interpretation"]), " | ").alias("cluster_interpretations"))
        found = found.join(told, "gene_id", "left").withColumn("cluster_interpretations", F.coalesce("cluster_interpretations", F.lit("")))
    return rank_candidates(found.withColumn("abs_log2FoldChange", F.abs("log2FoldChange")))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Adds ``rank``, from 1, in each contrast, or over all candidates where there is none.

    Without contrasts candidates are dealt to ranges of their order, and a range's ranks follow those of
    the ranges before it, so that no task has them all.
    """
    keys = [F.desc("selected_for_search"), F.desc("n_ontologies"), F.desc_nulls_last("min_cluster_quality"), F.desc_nulls_last("centrality_score"), F.desc_nulls_last("abs_log2FoldChange"), F.asc_nulls_last("padj"), F.asc("gene_id")]
    if "contrast" in candidates.columns:
        return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("contrast").orderBy(*keys)))
    part = free_name(candidates, "_range")
    # Written once: the ranges are drawn by sampling, and both uses below must see the same ones.
    dealt = materialize(candidates.repartitionByRange(partitions(candidates.sparkSession), *keys).withColumn(part, F.spark_partition_id()), "candidates")
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(part, (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_before"))  # one row a range
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(part).orderBy(*keys))).join(before, part)
    return ranked.withColumn("rank", (F.col("rank") + F.col("_before")).cast("int")).drop(part, "_before")


def coverage_funnel(genes: DataFrame, annotated: DataFrame, eligible: DataFrame, clustered: DataFrame) -> DataFrame:
    """Each gene's furthest stage, counted: without_go, annotated, eligible or clustered; they sum to all genes."""
    out = genes.select("gene_id").distinct()
    for name, stage in (("annotated", annotated), ("eligible", eligible), ("clustered", clustered)):
        out = out.join(stage.select("gene_id", F.lit(True).alias(name)).distinct(), "gene_id", "left")
    case = F.when(F.col("clustered"), "clustered").when(F.col("eligible"), "eligible_not_clustered").when(F.col("annotated"), "annotated_not_eligible").otherwise("without_go")
    return out.groupBy(case.alias("stage")).agg(F.count(F.lit(1)).alias("genes"))


def ontology_coverage(annotated: DataFrame, eligible: DataFrame, clusters: DataFrame) -> DataFrame:
    """Annotated, eligible, clustered and ungrouped genes and the clusters of each ontology.

    ``annotated`` has (gene_id, ontology), ``eligible`` gene_id and ``clusters`` ontology, direction, gene_id and cluster.
    Ungrouped are eligible genes with a term of the ontology that no cluster of it holds.
    """
    inside = clusters.where("cluster <> -1")
    genes = annotated.select("ontology", "gene_id").distinct().join(eligible.select("gene_id", F.lit(True).alias("ok")).distinct(), "gene_id", "left")
    genes = genes.join(inside.select("ontology", "gene_id", F.lit(True).alias("in")).distinct(), ["ontology", "gene_id"], "left")
    counted = genes.groupBy("ontology").agg(F.count(F.lit(1)).alias("annotated"), F.count_if(F.col("ok")).alias("eligible"), F.count_if(F.col("ok") & F.col("in")).alias("clustered"), F.count_if(F.col("ok") & F.col("in").isNull()).alias("ungrouped"))
    numbers = inside.groupBy("ontology").agg(F.countDistinct("direction", "cluster").alias("clusters"))
    return counted.join(numbers, "ontology", "left").na.fill(0, ["clusters"])


def coverage_violations(genes: DataFrame, annotated: DataFrame, eligible: DataFrame, clustered: DataFrame) -> DataFrame:
    """(rule, genes): how many genes break clustered <= eligible <= annotated <= all genes; no row for a rule that holds."""
    sets = {"clustered": clustered, "eligible": eligible, "annotated": annotated, "all": genes}
    out, names = None, list(sets)
    for inner, outer in zip(names, names[1:]):
        outside = sets[inner].select("gene_id").distinct().join(sets[outer].select("gene_id").distinct(), "gene_id", "left_anti")
        row = outside.agg(F.count(F.lit(1)).alias("genes")).where("genes > 0").select(F.lit(f"{inner}_not_{outer}").alias("rule"), "genes")
        out = row if out is None else out.union(row)
    return out
