import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwell.functions import columns as C
from loomwell.operators import annotation as A
from loomwell.operators import clustering as K


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


def test_gff_attributes_of_both_kinds(spark):
    got = value(spark, ' ID=gene-1 ;Note="a=b" ; gene_id "g x"; lone; k v ', C.gff_attributes)
    assert [(a.key, a.value) for a in got] == [("ID", "gene-1"), ("Note", "a=b"), ("gene_id", "g x"), ("k", "v")]
    assert value(spark, None, C.gff_attributes) == []


def test_normal_ids_and_numbers(spark):
    assert value(spark, "gene-ABC_1", C.normalize_id) == "ABC1"
    assert value(spark, " '1,5' ", C.parse_number) == 1.5
    assert value(spark, "x", C.parse_number) is None
    assert value(spark, "NaN", C.usable) == ""


def test_go_text(spark):
    assert value(spark, "old [GO:9999999]; activity [GO:0000002]", lambda c: C.drop_go_segments(c, F.array(F.lit("GO:9999999")))) == "activity [GO:0000002]"
    assert value(spark, "a [GO:1]; b [GO:2]; a [GO:3]", C.go_labels) == ["a", "b"]
    assert value(spark, "Name X (EC 1.1) [y]", C.primary_name) == "Name X"


def test_aliases_and_normalisation(spark):
    raw = spark.createDataFrame([("gene-a", "1,5", "0.001", "0.01", "kinase protein", "response to stimulus [GO:0050896]")], ["Unnamed: 0", "logFC", "PValue", "FDR", "Product GFF", "BP (C3)"])
    r = K.normalize_de_table(raw).first()
    assert list(r.asDict()) == K.CANONICAL
    assert (r["gene_id"], r["log2FoldChange"], r["padj"], r["Uniprot Function"]) == ("gene-a", 1.5, 0.01, "kinase protein")
    with pytest.raises(ValueError):
        K.normalize_de_table(raw.drop("FDR"))


def test_clean_genes_rules(spark):
    rows = [("up", 2.0, 0.01, "kinase activity"), ("down", -2.5, 0.01, "transport activity"), ("not-deg", 0.5, 0.01, "binding"), ("generic", 2.0, 0.01, "hypothetical protein")]
    g = spark.createDataFrame([(*r, "n", "process [GO:0008150]", "function [GO:0003674]") for r in rows], "gene_id string, log2FoldChange double, padj double, f string, n string, bp string, mf string")
    got = {r.gene_id: r.direction for r in K.clean_genes(g, ("n",), "f", ("bp", "mf")).collect()}
    assert got == {"up": "upregulated", "down": "downregulated"}
    with pytest.raises(ValueError):
        K.clean_genes(g.union(g), ("n",), "f", ("bp", "mf"))


def test_best_hit_prefers_annotated_plants(spark):
    h = spark.createDataFrame([("q", 1, "Homo", "Metazoa", "f", ""), ("q", 2, "Oryza", "Viridiplantae", "f", ""), ("r", 1, "x", "", "", ""), ("r", 2, "y", "", "", "")], "query string, hit_pos int, organism string, lineage string, function_text string, go_bp string")
    assert {r.query: r.hit_pos for r in A.best_hit(h).collect()} == {"q": 2, "r": 1}


def pairs(spark, **sims):
    return spark.createDataFrame([(k[0], k[1], v) for k, v in sims.items()], "gene_a string, gene_b string, sim double")


def test_complete_linkage_at_the_limit(spark):
    five = pairs(spark, ab=0.8, ac=0.7, bc=0.6, de=0.9, ad=0.1, ae=0.1, bd=0.1, be=0.1, cd=0.1, ce=0.1)
    assert {r.gene_id: r.cluster for r in K.complete_linkage(five, 0.6).collect()} == dict(a=1, b=1, c=1, d=-1, e=-1)
    assert {r.cluster for r in K.complete_linkage(pairs(spark, ab=0.8, bc=0.8, ac=0.5), 0.6).collect()} == {-1}
    assert K.complete_linkage(five.limit(0), 0.6).count() == 0


def test_silhouette_pruning(spark):
    d = {}
    for i in range(7):
        for j in range(i + 1, 7):
            x, y = (i, j)
            d[i, j] = 0.1 if y < 3 or x > 3 else 0.5 if y == 3 else 0.1 if x == 3 else 0.9
    p = spark.createDataFrame([(str(i), str(j), 1 - v) for (i, j), v in d.items()], "gene_a string, gene_b string, sim double")
    labels = spark.createDataFrame([(str(i), int(i > 3)) for i in range(7)], "gene_id string, cluster long")
    assert [r.cluster for r in K.prune_silhouette(p, labels).orderBy("gene_id").collect()] == [0, 0, 0, -1, 1, 1, 1]


def test_wang_chain(spark):
    edges = spark.createDataFrame([("c", "b", "is_a"), ("b", "a", "is_a")], "child string, parent string, relation string")
    terms = spark.createDataFrame([("a",), ("b",), ("c",)], "go_id string")
    closure = K.go_closure(edges, terms)
    assert {r.ancestor: round(r.s, 9) for r in closure.where("term = 'c'").collect()} == {"c": 1.0, "b": 0.8, "a": 0.64}
    sims = K.term_similarity(closure, terms)
    assert {round(r.sim, 9) for r in sims.where("term_a = term_b").collect()} == {1.0}


def test_medoid(spark):
    c = spark.createDataFrame([("BP", "up", 1, g, 2.0, 0.5) for g in "abc"], "ontology string, direction string, cluster int, gene_id string, log2FoldChange double, cluster_silhouette double")
    s = spark.createDataFrame([("BP", "up", 1, "a", "b", 0.9), ("BP", "up", 1, "b", "c", 0.8), ("BP", "up", 1, "a", "c", 0.5)], "ontology string, direction string, cluster int, gene_a string, gene_b string, sim double")
    r = K.cluster_representatives(c, s).first()
    assert (r.gene_id, round(r.centrality, 9)) == ("b", 0.85)


def test_representatives_of_equal_centrality(spark):
    """Sums that differ in their last digit alone are a tie, which the silhouette breaks; they don't hang on the order of rows."""
    sims = [("a", "b", 0.1), ("a", "c", 0.2), ("a", "d", 0.3), ("b", "c", 0.3), ("b", "d", 0.2), ("c", "d", 0.1)]
    assert 0.3 + 0.2 + 0.1 != 0.1 + 0.2 + 0.3
    rng, seen = random.Random(5), set()
    for parts in (1, 2, 3):
        rng.shuffle(sims)
        c = spark.createDataFrame([("BP", "up", 1, g, 1.0, s) for g, s in zip("abcd", (0.1, 0.2, 0.3, 0.4))], "ontology string, direction string, cluster int, gene_id string, log2FoldChange double, cluster_silhouette double")
        p = spark.createDataFrame([("BP", "up", 1, *x) for x in sims], "ontology string, direction string, cluster int, gene_a string, gene_b string, sim double").repartition(parts)
        rows = sorted(K.cluster_representatives(c, p, 4).collect(), key=lambda r: r.rank)
        assert [r.gene_id for r in rows] == ["d", "c", "b", "a"]
        seen.add(tuple(r.centrality for r in rows))
    assert len(seen) == 1


def test_dictionary_of_equal_centrality(spark):
    from loomwell.operators import reports

    sims = [("a", "b", 0.1), ("a", "c", 0.2), ("a", "d", 0.3), ("b", "c", 0.3), ("b", "d", 0.2), ("c", "d", 0.1)]
    c = spark.createDataFrame([("BP", "up", 1, g, 1.0, s) for g, s in zip("abcd", (0.1, 0.2, 0.3, 0.4))], "ontology string, direction string, cluster int, gene_id string, log2FoldChange double, cluster_silhouette double")
    p = spark.createDataFrame([("BP", "up", 1, *x) for x in sims], "ontology string, direction string, cluster int, gene_a string, gene_b string, sim double").coalesce(1)
    entry = json.loads(reports.cluster_dictionary(c, K.cluster_representatives(c, p)).first().entry)
    assert (entry["representative_gene_id"], entry["gene_ids"]) == ("d", ["a", "b", "c", "d"])


def test_ranks_of_equal_centrality_whatever_the_order_of_rows(spark):
    sims = [(1, "a", "b", 0.1), (1, "a", "c", 0.2), (1, "a", "d", 0.3), (2, "e", "h", 0.3), (2, "e", "g", 0.2), (2, "e", "f", 0.1)]
    c = spark.createDataFrame([("BP", "up", 1 + (g > "d"), g, 1.0, 0.5) for g in "abcdefgh"], "ontology string, direction string, cluster int, gene_id string, log2FoldChange double, cluster_silhouette double")
    genes = spark.createDataFrame([(g, 0.01, 2.0) for g in "abcdefgh"], "gene_id string, padj double, log2FoldChange double")
    for rows in (sims, sims[::-1]):
        p = spark.createDataFrame([("BP", "up", *x) for x in rows], "ontology string, direction string, cluster int, gene_a string, gene_b string, sim double").coalesce(1)
        reps = K.cluster_representatives(c, p).join(K.cluster_metrics(c, p), ["ontology", "direction", "cluster"]).drop("log2FoldChange")
        assert {r.gene_id: r["rank"] for r in K.prioritize(reps, genes).collect()} == {"a": 1, "e": 2}


def test_candidate_order(spark):
    c = spark.createDataFrame([("single", False, 1, 0.5, 0.5, 1.0, 0.01), ("triple", True, 3, 0.1, 0.5, 1.0, 0.01), ("double", True, 2, 0.9, 0.5, 1.0, 0.01)], "gene_id string, selected_for_search boolean, n_ontologies int, min_cluster_quality double, centrality_score double, abs_log2FoldChange double, padj double")
    assert [r.gene_id for r in K.rank_candidates(c).orderBy("rank").collect()] == ["triple", "double", "single"]


def test_conflicts(spark):
    c = spark.createDataFrame([(1, "A(s1;s2)*B(s2;s3)"), (2, "C(s3)*D(s4)")], "id int, name string")
    assert {(r.sample_id, r.kind) for r in A.target_conflicts(c).collect()} >= {("s2", "within"), ("s3", "across")}


def brute_linkage(rows, limit):
    """Groups that are each other's nearest merge, round by round (ties: by name)."""
    sim = {frozenset(r[:2]): r[2] for r in rows if r[2] >= limit}
    groups = {g: [g] for pair in sim for g in pair}
    least = lambda x, y: min(sim.get(frozenset((p, q)), -1) for p in groups[x] for q in groups[y])
    while True:
        near = {x: min(((-least(x, y), y) for y in groups if y != x and least(x, y) >= limit), default=None) for x in groups}
        pairs = [(x, near[x][1]) for x in groups if near[x] and x < near[x][1] and near[near[x][1]][1] == x]
        if not pairs:
            return {g: i for i, x in enumerate(sorted(groups), 1) for g in groups[x]}
        for x, y in pairs:
            groups[x] += groups.pop(y)


def test_linkage_of_small_and_large_components(spark):
    rng = random.Random(3)
    rows = [(f"g{i:02d}", f"g{j:02d}", round(rng.random() ** 0.4 if i // 6 == j // 6 else rng.random() * 0.7, 2)) for i in range(30) for j in range(i + 1, 30) if rng.random() < 0.9]
    p = spark.createDataFrame(rows, "gene_a string, gene_b string, sim double")
    want = brute_linkage(rows, 0.5)
    for local in (2000, 2):
        assert {r.gene_id: r.cluster for r in K.complete_linkage(p.repartition(3), 0.5, 1, local=local).collect()} == want


def test_similarities_that_differ_in_their_last_digit_are_a_tie(spark):
    p = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9000000000000001)], "gene_a string, gene_b string, sim double")
    for local in (2000, 0):
        assert {r.gene_id: r.cluster for r in K.complete_linkage(p, 0.5, 2, local=local).collect()} == {"a": 1, "b": 1, "c": -1}


def test_pruning_in_rounds_is_brute_force(spark, monkeypatch):
    rng, seen, whole = random.Random(4), [], K.silhouettes
    names = [f"g{i:02d}" for i in range(60)]
    label = {n: i // 6 for i, n in enumerate(names)}
    rows = [(x, y, round(rng.random() if label[x] == label[y] else rng.random() * 0.8, 3)) for x in names for y in names if x < y and (label[x] == label[y] or abs(label[x] - label[y]) == 1 and rng.random() < 0.3)]
    sim = {frozenset(r[:2]): r[2] for r in rows}
    want = dict(label)
    while True:
        groups = {}
        for n, c in want.items():
            groups.setdefault(c, []).append(n)
        groups = {c: g for c, g in groups.items() if c != -1 and len(g) >= 3}
        want = {n: next((c for c, g in groups.items() if n in g), -1) for n in names}
        far = lambda n, g: [1 - sim.get(frozenset((n, x)), 0) for x in g if x != n]
        mean = lambda d: sum(d) / len(d)
        bad = [n for c, g in groups.items() for n in g if len(groups) > 1 and min(mean(far(n, h)) for d, h in groups.items() if d != c) < mean(far(n, g))]
        if not bad:
            break
        want |= dict.fromkeys(bad, -1)
    monkeypatch.setattr(K, "silhouettes", lambda *a: seen.append(a) or whole(*a))
    got = K.prune_silhouette(spark.createDataFrame(rows, "gene_a string, gene_b string, sim double").coalesce(1), spark.createDataFrame(list(label.items()), "gene_id string, cluster long").coalesce(1))
    assert {r.gene_id: r.cluster for r in got.collect()} == want
    assert len(seen) > 1 and all(a[3] is not None for a in seen[1:])  # later rounds look at some genes only


def test_semantic_clusters_keep_keys_apart(spark):
    rows = [(o, d, a, b, s) for o, s in (("BP", 0.55), ("MF", 0.55), ("CC", 0.9)) for d in ("up", "down") for a, b in ("ab", "ac", "bc")]
    p = spark.createDataFrame(rows, "ontology string, direction string, gene_a string, gene_b string, sim double")
    genes = p.select("ontology", "direction").distinct().join(spark.createDataFrame([(g,) for g in "abcd"], "gene_id string"))
    got = {(r.ontology, r.direction, r.gene_id): (r.cluster, r.cluster_size, r.cluster_silhouette) for r in K.semantic_clusters(genes, p).collect()}
    for (o, _, g), v in got.items():
        assert v == ((1, 3, None) if o != "MF" and g != "d" else (-1, None, None))
    assert len(got) == 24 and K.semantic_clusters(genes.limit(0), p.limit(0)).count() == 0


def test_silhouettes_against_brute_force(spark):
    rng = random.Random(9)
    names = [f"g{i}" for i in range(14)]
    label = {n: rng.choice([1, 1, 2, 3, -1]) for n in names}
    sim = {(a, b): rng.random() for a in names for b in names if a < b and rng.random() < 0.5}
    got = {r.gene_id: r.silhouette for r in K.silhouettes(spark.createDataFrame([(*k, v) for k, v in sim.items()], "gene_a string, gene_b string, sim double"), spark.createDataFrame(list(label.items()), "gene_id string, cluster long")).collect()}
    far = lambda x, y: 1 - sim.get((min(x, y), max(x, y)), 0)
    for x, c in label.items():
        if c == -1:
            assert x not in got
            continue
        mean = {k: [far(x, y) for y in names if y != x and label[y] == k] for k in set(label.values()) - {-1}}
        b = min(sum(v) / len(v) for k, v in mean.items() if k != c)
        a = sum(mean[c]) / len(mean[c]) if mean[c] else None
        assert got[x] == pytest.approx(0 if a is None else (b - a) / max(a, b))


def test_search_query_of_name_and_labels(spark):
    reps = spark.createDataFrame([("g", "MF", "up", 2, 0.5, 0.4, "binding [GO:1]"), ("g", "BP", "up", 1, 0.7, 0.2, "growth [GO:2]; step [GO:3]; growth [GO:4]; last [GO:5]")], "gene_id string, ontology string, direction string, cluster int, centrality double, mean_silhouette double, go_terms string")
    genes = spark.createDataFrame([("g", 0.01, 2.0, "Kinase X (KX1) [Fragment]")], "gene_id string, padj double, log2FoldChange double, uniprot_names string")
    r = K.prioritize(reps, genes).first()
    assert r.search_query == "Kinase X, growth, step, last" and r.represented_clusters == "BP:up:1; MF:up:2" and r.selected_for_search


def ontology(rng, n, prefix):
    """A random ontology with one root: (child, parent, relation), and s of each term's ancestors by brute force."""
    edges = [(f"{prefix}{i}", f"{prefix}{j}", rng.choice(("is_a", "part_of"))) for i in range(1, n) for j in {rng.randrange(max(0, i // 3 - 1), i) for _ in range(rng.choice((1, 1, 2)))}]
    up = {}
    for c, p, r in edges:
        up.setdefault(c, []).append((p, K.WEIGHTS[r]))
    s = {}
    for i in range(n):
        t = f"{prefix}{i}"
        s[t] = {t: 1.0}
        for p, w in up.get(t, []):
            for a, v in s[p].items():
                s[t][a] = max(s[t].get(a, 0), v * w)
    return edges, s


def wang(s, a, b):
    shared = s[a].keys() & s[b].keys()
    return sum(s[a][k] + s[b][k] for k in shared) / (sum(s[a].values()) + sum(s[b].values()))


def best_match(s, x, y):
    return (sum(max(wang(s, a, b) for b in y) for a in x) + sum(max(wang(s, a, b) for a in x) for b in y)) / (len(x) + len(y))


@pytest.fixture(scope="module")
def gene_ontology(spark):
    rng = random.Random(12)
    edges, s = [], {}
    for prefix, n in (("b", 60), ("m", 40), ("c", 30)):
        e, v = ontology(rng, n, prefix)
        edges += e
        s |= v
    names = {"b": "BP", "m": "MF", "c": "CC"}
    sets = {}
    for g in range(45):
        for o in "bmc":
            own = [t for t in s if t[0] == o]
            at = rng.randrange(len(own))
            sets[names[o], f"g{g:02d}"] = {own[max(0, min(len(own) - 1, at + rng.randint(-4, 4)))] for _ in range(rng.choice((1, 2, 3, 9)))}
    for g in range(45, 50):
        sets["BP", f"g{g:02d}"] = sets["BP", "g07"]
    frames = (
        spark.createDataFrame(edges + [("b5", "b2", "regulates")], "child string, parent string, relation string"),
        spark.createDataFrame([(t,) for t in s], "go_id string"),
        spark.createDataFrame([(o, g, t) for (o, g), ts in sets.items() for t in [*ts, "unknown"]], "ontology string, gene_id string, go_id string"),
    )
    return s, sets, frames


def test_closure_and_term_pairs_over_their_limit(gene_ontology):
    s, _, (edges, terms, _) = gene_ontology
    closure = K.go_closure(edges, terms)
    assert {(r.term, r.ancestor): round(r.s, 12) for r in closure.collect()} == {(t, a): round(v, 12) for t, vs in s.items() for a, v in vs.items()}
    for least, lot in ((0.0, 4096), (0.0, 7), (0.4, 4096), (0.4, 5), (0.7, 3)):
        got = {(r.term_a, r.term_b): r.sim for r in K.term_similarity(closure, terms, least, lot).collect()}
        want = {(a, b): wang(s, a, b) for a in s for b in s if s[a].keys() & s[b].keys() and wang(s, a, b) >= least}
        assert got == pytest.approx(want)
    ranked = K._ranked(closure, terms.withColumn("least", F.lit(0.7)))
    assert K._candidate_terms(ranked, 4096).count() < 0.5 * K._candidate_terms(K._ranked(closure, terms.withColumn("least", F.lit(0.0))), 4096).count()


def test_term_similarity_query_returns_every_pair_that_shares_an_ancestor(spark):
    import duckdb

    from loomwell.plans import registry

    db = duckdb.connect()
    db.execute("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.001/part.parquet'")
    want = {(a, b): v for a, b, v in db.execute(registry.oracle_sql()["term_similarity"]).fetchall()}
    rows = registry.QUERIES["term_similarity"](spark, "/root/testdata/sf0.001").collect()
    got = {(r.term_a, r.term_b): r.sim for r in rows}
    assert len(rows) == len(got) and got == pytest.approx(want, abs=1.5e-6)
    # Terms of one ontology share its root, however unlike they are, but for its terms 0 to 2, which have no edge.
    per = Counter(int(t[3:]) % 3 for t in {a for a, _ in got} if int(t[3:]) >= 3)
    assert len(got) >= sum(n * n for n in per.values()) and min(got.values()) < 0.5


def test_gene_pairs_over_their_limits_are_brute_force(gene_ontology):
    s, sets, (edges, terms, gene2go) = gene_ontology
    closure = K.go_closure(edges, terms)
    whole = {(o, a, b): best_match(s, x, y) for (o, a), x in sets.items() for (p, b), y in sets.items() if o == p and a < b}
    for limits in (K.MIN_SIMILARITY, {"BP": 0.0, "MF": 0.95, "CC": 1.0}):
        got = {(r.ontology, r.gene_a, r.gene_b): r.sim for r in K.gene_similarity(gene2go, closure, limits, ("ontology",)).collect()}
        assert got == pytest.approx({k: v for k, v in whole.items() if v >= limits[k[0]] - 1e-12})
    bp = gene2go.where("ontology = 'BP'").drop("ontology")
    got = {(r.gene_a, r.gene_b): r.sim for r in K.gene_similarity(bp, closure, 0.5).collect()}
    assert got == pytest.approx({k[1:]: v for k, v in whole.items() if k[0] == "BP" and v >= 0.5})
    assert K.gene_similarity(gene2go.limit(0), closure, K.MIN_SIMILARITY, ("ontology",)).count() == 0


def test_gene_pairs_meet_at_homes_without_rows_of_their_terms(gene_ontology, monkeypatch):
    s, sets, (edges, terms, gene2go) = gene_ontology
    closure = K.go_closure(edges, terms)
    rows, write = [], K.materialize

    def counted(df, tag):
        written = write(df, tag)
        rows.append(written.count())
        return written

    monkeypatch.setattr(K, "materialize", counted)
    whole = {(o, a, b): best_match(s, x, y) for (o, a), x in sets.items() for (p, b), y in sets.items() if o == p and a < b}
    want = {k: v for k, v in whole.items() if v >= K.MIN_SIMILARITY[k[0]] - 1e-12}
    found = K.gene_similarity(gene2go, closure, K.MIN_SIMILARITY, ("ontology",)).collect()
    assert {(r.ontology, r.gene_a, r.gene_b): r.sim for r in found} == pytest.approx(want) and len(found) == len(want)
    assert max(rows) <= closure.count() + len(sets)  # no table of pairs or of pairs' terms
    for size in ({"home": 3, "load": 25}, {"home": 40, "load": 60}):
        found = K.gene_similarity(gene2go, closure, K.MIN_SIMILARITY, ("ontology",), **size).collect()
        assert {(r.ontology, r.gene_a, r.gene_b): r.sim for r in found} == pytest.approx(want) and len(found) == len(want)


def test_the_chain_clusters_real_similarities(spark, gene_ontology):
    s, sets, (edges, terms, gene2go) = gene_ontology
    direction = {f"g{g:02d}": "up" if g % 3 else "down" for g in range(48)}
    genes = spark.createDataFrame(list(direction.items()), "gene_id string, direction string")
    rows = [(o, direction[a], a, b, best_match(s, x, y)) for (o, a), x in sets.items() for (p, b), y in sets.items() if o == p and a < b and a in direction and b in direction and direction[a] == direction[b]]
    pairs = spark.createDataFrame([r for r in rows if r[4] >= K.MIN_SIMILARITY[r[0]] - 1e-12], "ontology string, direction string, gene_a string, gene_b string, sim double")
    asked = spark.createDataFrame([(o, direction[g], g) for o, g in sets if g in direction], "ontology string, direction string, gene_id string")
    told = lambda df: {(r.ontology, r.direction, r.gene_id): (r.cluster, r.cluster_size, r.cluster_silhouette and round(r.cluster_silhouette, 9)) for r in df.collect()}
    got = told(K.clusters_of_genes(genes, gene2go, edges, terms))
    assert got == told(K.semantic_clusters(asked, pairs)) and max(v[0] for v in got.values()) > 1


def test_summary_rows_without_genes(spark):
    c = spark.createDataFrame([("BP", "up", 1, "g", 0.5), ("BP", "up", -1, "h", None)], "ontology string, direction string, cluster int, gene_id string, cluster_silhouette double")
    asked = spark.createDataFrame([("BP", "up"), ("CC", "down"), ("CC", "down")], "ontology string, direction string")
    got = {(r.ontology, r.direction): (r.clusters, r.clustered_genes, r.genes, r.mean_silhouette) for r in K.cluster_summary(c, asked).collect()}
    assert got == {("BP", "up"): (1, 1, 2, 0.5), ("BP", None): (1, 1, 2, 0.5), (None, None): (1, 1, 2, 0.5), ("CC", "down"): (0, 0, 0, None)}


def test_coverage_of_ontologies_and_its_containment(spark):
    frame = lambda genes: spark.createDataFrame([(g,) for g in genes], "gene_id string")
    annotated = spark.createDataFrame([("BP", g) for g in "abcd"] + [("MF", "a"), ("MF", "a")], "ontology string, gene_id string")
    clusters = spark.createDataFrame([("BP", "up", 1, "a"), ("BP", "down", 1, "b"), ("BP", "up", -1, "c"), ("BP", "up", 1, "x")], "ontology string, direction string, cluster int, gene_id string")
    got = {r.ontology: tuple(r)[1:] for r in K.ontology_coverage(annotated, frame("abc"), clusters).collect()}
    assert got == {"BP": (4, 3, 2, 1, 2), "MF": (1, 1, 0, 1, 0)}
    told = lambda *sets: {r.rule: r.genes for r in K.coverage_violations(*map(frame, sets)).collect()}
    assert told("abcd", "abc", "ab", "a") == {} and told("ab", "abc", "abcd", "xy") == {"annotated_not_all": 1, "eligible_not_annotated": 1, "clustered_not_eligible": 2}


def test_terms_of_all_ontologies_once(spark):
    rows = [("g", "a [GO:1]; b [GO:2]", "c [GO:1]", None), ("g", "a [GO:1]", "", "d [GO:9]"), ("h", None, None, None)]
    got = A.unique_gene2go(spark.createDataFrame(rows, "gene_id string, bp string, mf string, cc string"), {"BP": "bp", "MF": "mf", "CC": "cc"})
    assert sorted(map(tuple, got.collect())) == [("g", "BP", "GO:1"), ("g", "BP", "GO:2"), ("g", "CC", "GO:9"), ("g", "MF", "GO:1")]


def test_candidates_are_ranked_over_ranges(spark):
    rng = random.Random(1)
    rows = [(f"g{i:03d}", rng.random() < 0.5, rng.randint(1, 3), rng.choice((None, 0.1, 0.2)), rng.choice((None, 0.5, 0.6)), rng.choice((None, 1.0, 2.0)), rng.choice((None, 0.01, 0.02))) for i in range(200)]
    c = spark.createDataFrame(rows, "gene_id string, selected_for_search boolean, n_ontologies int, min_cluster_quality double, centrality_score double, abs_log2FoldChange double, padj double")
    down = lambda v: (v is None, 0 if v is None else -v)
    want = sorted(rows, key=lambda r: (not r[1], -r[2], down(r[3]), down(r[4]), down(r[5]), (r[6] is None, r[6] or 0), r[0]))
    ranked = K.rank_candidates(c.repartition(7))
    assert [r.gene_id for r in ranked.orderBy("rank").collect()] == [r[0] for r in want] and ranked.columns == [*c.columns, "rank"]
    assert [r["rank"] for r in ranked.select("rank").orderBy("rank").collect()] == list(range(1, 201)) and K.rank_candidates(c.limit(0)).count() == 0
