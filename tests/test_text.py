import math
import random

import pytest
from pyspark.sql import functions as F

from loomwell.functions import columns as C
from loomwell.operators import evaluation as V
from loomwell.operators import evidence as E
from loomwell.operators import jobs as J
from loomwell.operators import literature as L
from loomwell.operators import reads as R
from loomwell.operators import reports as P
from loomwell.operators import retrieval as T
from loomwell.sources import readers as S


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


def test_tokens_and_claims(spark):
    assert value(spark, "Carbamoyl-phosphate synthase", C.bm25_tokens) == ["carbamoyl-phosphate", "carbamoyl", "phosphate", "synthase"]
    text = "Gene A responds to stress [C1]. It is localized in roots [C2, C3]."
    assert len(value(spark, text, C.split_claims)) == 2
    assert value(spark, text, C.citation_refs) == ["C1", "C2", "C3"]
    assert value(spark, "2.1 Materials and Methods", C.is_low_value_section) and not value(spark, "Results", C.is_low_value_section)
    assert value(spark, "|" * 12, C.is_table_like) and not value(spark, "|" * 11, C.is_table_like)


def test_chunks_stay_in_their_section(spark):
    text = "# Article Title\nFirst sentence here now. Second sentence here now. Third sentence here now.\n\n## Results\nFourth sentence here now. Fifth sentence here now.\n## References\nNot this one at all."
    a = spark.createDataFrame([("a.md", text), ("b.md", ""), ("c.md", None)], "source string, text string")
    chunks = [r.text for r in L.chunk_articles(a, target_words=4, overlap=1, min_words=1).collect()]
    assert not any("Third sentence" in c and "Fourth sentence" in c for c in chunks)
    assert sum("First sentence" in c for c in chunks) >= 1 and not any("Not this" in c for c in chunks)
    assert sum("Second sentence" in c for c in chunks) == 2


def test_bm25_weight(spark):
    c = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, "")], "chunk_id long, text string")
    model, stats = L.bm25_model(c), L.bm25_stats(c)
    w = {(r.chunk_id, r.token): r.weight for r in L.bm25_weights(L.bm25_terms(c), model, stats).collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert w[1, "beta"] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (4 / 3))))


def test_rrf_and_diversity(spark):
    lists = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 11, 2), ("b", 1, 11, 1), ("b", 1, 12, 2)], "list string, query_id long, chunk_id long, rank int")
    assert T.rrf_fuse(lists).orderBy("rank").first().chunk_id == 11
    rows = [(1, 1, "refs.md", "References", "x"), (1, 2, "table.md", "Results", "|" * 19), (1, 3, "a", "Discussion", "t"), (1, 4, "a", "Discussion", "u"), (1, 5, "a", "Discussion", "v"), (1, 6, "b", "Results", "w")]
    got = T.diversify(spark.createDataFrame(rows, "query_id long, hit_rank int, source string, section string, text string"), 3, 1).orderBy("final_rank").collect()
    assert [(r.hit_rank, r.citation_id) for r in got] == [(3, "C1"), (6, "C2"), (4, "C3")]


def test_aliases_and_facets(spark):
    u = "Probable xyloglucan 6-xylosyltransferase 5 (EC 2.4.2.39) (Putative glycosyltransferase 5) (AtGT5)"
    got = spark.createDataFrame([(u,)], "u string").select(T.aliases(F.lit("Gene One"), F.lit(""), F.col("u")).alias("a")).first().a
    assert "AtGT5" in got and "Gene One" in got and not any("EC 2" in x for x in got[:1])
    f = spark.range(1).select(T.facet_queries(F.lit("Gene One"), T.context_phrases(F.lit("enzyme activity, response to drought, nucleus"))).alias("f")).first().f
    assert [x.facet for x in f] == ["identity", "molecular_function", "expression_or_stress", "localization"]


def test_retrieval_metrics(spark):
    r = spark.createDataFrame([("m", 1, i + 1, i + 1) for i in range(5)], "method string, query_id long, chunk_id long, rank int")
    q = spark.createDataFrame([(1, i + 1, g) for i, g in enumerate([2, 0, 1, 0, 0])], "query_id long, chunk_id long, grade int")
    m = V.retrieval_metrics(r, q, 5).first()
    assert (m.p5, m.rr, m.recall) == (0.4, 1.0, 1.0) and m.ndcg > 0.9
    with pytest.raises(ValueError):
        V.retrieval_metrics(r, q.where("grade > 0"))


def test_kappa_and_intervals(spark):
    rows = [(i, a, l) for i, l in enumerate("ab") for a in ("x", "y")]
    assert V.pairwise_kappa(spark.createDataFrame(rows, "item int, annotator string, label string")).first().kappa == 1.0
    ci = V.bootstrap_ci(spark.createDataFrame([("m", 0.5)], "method string, value double"), 50).first()
    assert (ci.mean, ci.low, ci.high) == (0.5, 0.5, 0.5)


def evidence(spark, text, **more):
    row = {"gene_id": "g1", "citation_id": "C1", "text": text, "primary_name": "", "blocked_reason": None, "stable_ids": [], "ortholog_terms": [], "alias_matches": [], "protein_family_matches": [], "species_mentions": []} | more
    kinds = {k: "array<string>" if isinstance(v, list) else "string" for k, v in row.items()}
    return E.classify_evidence(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())))


def claims(spark, **more):
    row = {"gene_id": "g1", "claim_index": 1, "claim": "It grows.", "citations": ["C1"], "evidence_level": "general", "relationship_to_query": "unknown", "species": "", "conditions": [], "confidence": "low"} | more
    return spark.createDataFrame([tuple(row.values())], "gene_id string, claim_index int, claim string, citations array<string>, evidence_level string, relationship_to_query string, species string, conditions array<string>, confidence string")


def test_claim_rules(spark):
    named = evidence(spark, "KOR1 acts in roots.", primary_name="kor1")
    assert E.validate_claims(claims(spark), named).first().accepted
    assert E.validate_claims(claims(spark, citations=[]), named).first().reasons == ["missing_citation"]
    assert "unverified_direct_evidence" in E.validate_claims(claims(spark, evidence_level="direct"), named).first().reasons
    assert "unknown_citation" in E.validate_claims(claims(spark, citations=["C9"]), named).first().reasons
    assert "unverified_ortholog_attribution" in E.validate_claims(claims(spark, relationship_to_query="ortholog"), named).first().reasons
    family = claims(spark, claim="The gene's function is known.", relationship_to_query="family")
    assert "indirect_evidence_attributed_to_query_gene" in E.validate_claims(family, named).first().reasons
    apart = evidence(spark, "Arabidopsis grows. TBM was used.", primary_name="grows", species_mentions=["Arabidopsis"])
    got = E.validate_claims(claims(spark, species="Arabidopsis", conditions=["TBM"]), apart).first().reasons
    assert got == ["unverified_species_condition_pair:Arabidopsis:TBM"]


def test_conditions_beside_accented_letters(spark):
    got = evidence(spark, "Un lIMité éIM était; TBMé, mais non aIM ou TBM_.").first()
    assert got.conditions == ["TBM", "IM"]
    reasons = E.validate_claims(claims(spark, claim="étéIM is écentral."), evidence(spark, "KOR1 acts.", primary_name="kor1")).first().reasons
    assert reasons == ["unsupported_claim_strength", "unsupported_condition_in_text:IM"]
    assert E.validate_claims(claims(spark, claim="aIM is acentral."), evidence(spark, "KOR1 acts.", primary_name="kor1")).first().accepted


def test_blocking_rules(spark):
    rules = spark.createDataFrame([("g1", 1, "rule", ["cellulose"], [], ["lipid"]), ("g1", 1, "alias", ["kinase"], ["ATP9"], [])], "gene_id string, rule_index int, kind string, any array<string>, all array<string>, unless_any array<string>")
    rows = [("g1", 1, "", "", "in cellulose synthesis"), ("g1", 2, "", "", "cellulose and lipid"), ("g1", 3, "", "", "ATP9 here"), ("g1", 4, "", "", "ATP9 kinase"), ("g2", 5, "", "", "cellulose")]
    got = {r.chunk_id: r.blocked_reason for r in E.blocked(spark.createDataFrame(rows, "gene_id string, chunk_id int, article_title string, section string, text string"), rules).collect()}
    assert got == {1: "entity_policy_rule_1", 2: None, 3: "ambiguous_alias_without_context:atp9", 4: None, 5: None}


def test_reads(spark):
    one = lambda q: spark.createDataFrame([(1, "A" * len(q), q)], "read_id long, seq string, qual string")
    assert R.detect_phred(one(chr(35) + "h")).first().encoding == "phred33"
    assert R.detect_phred(one(chr(66) + chr(104))).first().encoding == "phred64"
    assert R.detect_phred(one(chr(66) + chr(74))).first().encoding == "phred33"
    assert R.detect_phred(one("I").limit(0)).first().encoding == "phred33"
    assert R.trim_reads(one("#II" + "I" * 40 + "#####"), minlen=36).first().seq == "A" * 41  # the first window under the limit is cut off whole


def test_status_and_lines(spark):
    assert [value(spark, s, C.normalize_status) for s in (None, "Erro", "in progress", "odd")] == ["PENDING", "FAILED", "RUNNING", "ODD"]
    lines = spark.createDataFrame([(1, i, l) for i, l in enumerate(["a", "a", " ", "a", "b", "a"])], "job_id long, seq long, line string")
    assert [r.line for r in J.consecutive_dedup(lines).orderBy("seq").collect()] == ["a", "b", "a"]


def test_sources(spark, tmp_path):
    (tmp_path / "s1.tsv").write_text("! note\ng1\t5\n__no_feature\t2\n")
    assert {tuple(r) for r in S.read_counts(spark, str(tmp_path / "s1.tsv")).collect()} == {("s1", "g1", 5), ("s1", "__no_feature", 2)}
    (tmp_path / "x.gff").write_text("# c\n\nchr1\ts\tgene\t1\t9\t.\t+\t.\tID=a\nshort\tline\n")
    assert [(r.seqid, r.start_at, r.attributes) for r in S.read_gff(spark, str(tmp_path / "x.gff")).collect()] == [("chr1", 1, "ID=a")]
    (tmp_path / "r_R2.fastq").write_text("@a 1\nACGT\n+\n@III\n@b\nAC\n+\nII\n")
    assert [tuple(r) for r in S.read_fastq(spark, str(tmp_path / "r_R2.fastq")).collect()] == [("a", 2, "ACGT", "@III"), ("b", 2, "AC", "II")]
    (tmp_path / "e.csv").write_bytes("﻿a,b\n1,x\n".encode())
    assert S.read_eval_csv(spark, str(tmp_path / "e.csv")).columns == ["a", "b"]
    de = spark.createDataFrame([("x", "g", 1.0), ("y", "h", 2.0)], "contrast string, gene_id string, logFC double")
    S.write_de(de, str(tmp_path / "de"))
    S.write_de(de.where("contrast = 'x'").withColumn("logFC", F.lit(9.0)), str(tmp_path / "de"))
    assert {(r.contrast, r.logFC) for r in S.read_de(spark, str(tmp_path / "de")).collect()} == {("x", 9.0), ("y", 2.0)}
    chunks = spark.createDataFrame([("c1", "t")], "chunk_id string, text string")
    with pytest.raises(ValueError):
        S.export_index(chunks, 2, str(tmp_path / "i"))
    S.export_index(chunks, 1, str(tmp_path / "i"))
    assert S.import_index(spark, str(tmp_path / "i")).count() == 1
    assert S.contrasts_of(spark, str(tmp_path / "de")).orderBy("contrast").collect() == [("x",), ("y",)]
    odd = spark.createDataFrame([("a/b =c", "g", 1.0), (None, "h", 2.0)], "contrast string, gene_id string, logFC double")
    S.write_de(odd, str(tmp_path / "odd"))
    assert {r.contrast for r in S.contrasts_of(spark, str(tmp_path / "odd")).collect()} == {"a/b =c", None}
    with pytest.raises(ValueError):  # a refused export leaves the one before as it was
        S.export_index(chunks.limit(0), 1, str(tmp_path / "i"))
    assert S.import_index(spark, str(tmp_path / "i")).count() == 1
    for n in range(3):
        S.export_index(chunks.withColumn("text", F.lit(f"v{n}")), 1, str(tmp_path / "i"))
    assert S.import_index(spark, str(tmp_path / "i")).first().text == "v2" and len(list((tmp_path / "i/versions").iterdir())) == 2
    chunks.write.mode("append").parquet(S.index_version(spark, str(tmp_path / "i")) + "/chunks")
    with pytest.raises(ValueError):
        S.import_index(spark, str(tmp_path / "i"))


def test_rules_file(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"g1": {"blocked_chunk_rules": [{"any": ["x"]}], "contextual_aliases": [{"alias": "A9", "require_any": ["k"]}]}}')
    assert {(r.kind, tuple(r["any"]), tuple(r["all"])) for r in S.read_rules(spark, str(tmp_path / "p.json")).collect()} == {("rule", ("x",), ()), ("alias", ("k",), ("A9",))}


def test_dictionary_phrases_of_all_lengths(spark):
    from loomwell.operators import literature

    phrases = [("x", " ".join(f"w{j}" for j in range(n))) for n in range(1, 16)]
    chunks = spark.createDataFrame([(1, "a " + phrases[-1][1].upper() + " b"), (2, "none"), (3, None)], "chunk_id long, text string")
    got = literature.dictionary_mentions(chunks, spark.createDataFrame(phrases, "label string, phrase string")).collect()
    assert [(r.chunk_id, r.label, sorted(r.mentions)) for r in got] == [(1, "x", sorted(p for _, p in phrases))]
    assert literature.dictionary_mentions(chunks, spark.createDataFrame([], "label string, phrase string")).count() == 0
    odd = spark.createDataFrame([("y", "B"), ("y", "b!"), ("y", None), ("y", "--"), ("z", "W3 w4"), (None, "a")], "label string, phrase string")
    found = literature.dictionary_mentions(chunks, odd)
    assert {(r.chunk_id, r.label): r.mentions for r in found.collect()} == {(1, "y"): ["B", "b!"], (1, "z"): ["W3 w4"], (1, None): ["a"]}
    flags = literature.mention_columns(chunks.withColumn("has_z", F.lit("clash")), found, {"y": "why", "z": "z"})
    assert {r.chunk_id: (r.has_why, r.has_z, r.why_mentions) for r in flags.collect()} == {1: (True, True, ["B", "b!"]), 2: (False, False, []), 3: (False, False, [])}


def test_mentions_against_brute_force(spark):
    import re

    from loomwell.operators import literature

    rng = random.Random(2)
    text = lambda n: rng.choice(" ,-").join(rng.choice(("ab", "Ab", "c", "dd", "é1", "ab_c")) for _ in range(n))
    chunks = [(i, text(rng.randint(0, 30))) for i in range(80)]
    phrases = sorted({(rng.choice("xy"), text(rng.randint(1, 4))) for _ in range(60)})
    want = {}
    for c, t in chunks:
        line = " " + " ".join(re.findall(r"[a-zA-Z0-9_]+", t.lower())) + " "
        for label in "xy":
            hits = sorted((line.find(k), p) for k, p in ((" " + " ".join(re.findall(r"[a-zA-Z0-9_]+", p.lower())) + " ", p) for lab, p in phrases if lab == label) if k.strip() and k in line)
            if hits:
                want[c, label] = [p for _, p in hits][:3]
    got = literature.dictionary_mentions(spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(phrases, "label string, phrase string"), 3)
    assert {(r.chunk_id, r.label): r.mentions for r in got.collect()} == want


def test_counts_over_nested_bins_are_brute_force(spark):
    from loomwell.operators import reads

    rng = random.Random(4)
    features = [(f"f{i:03d}", rng.choice(("c1", "c2")), s := rng.randrange(5_000_000), s + int(rng.choice((0, 10, 900, 40_000, 3_000_000)) * rng.random())) for i in range(120)] + [("back", "c1", 500, 400), ("whole", "c3", 1, 90_000_000_000)]
    rows = [(i, rng.choice(("c1", "c2", "c3", "c4")), s := rng.randrange(5_000_000), s + rng.randrange(3000), rng.choice((5, 30, 30, 30))) for i in range(400)]
    rows += [(1000 + i, "c1", features[0][2], features[0][3], 40) for i in range(50)] + [(2000, "c3", 7, 9, 40)]
    want = {}
    for _, chrom, a, b, q in rows:
        own = [f for f, c, s, e in features if c == chrom and s <= e and a <= e and s <= b]
        kind = "__too_low_aQual" if q < 10 else "__no_feature" if not own else "__ambiguous" if len(own) > 1 else own[0]
        want[kind] = want.get(kind, 0) + 1
    f = spark.createDataFrame(features, "id string, seqid string, start_at long, end_at long")
    for width in (1000, 1):
        got = {r.id: r.n for r in reads.count_features(spark.createDataFrame(rows, "read_id long, chrom string, start_at long, end_at long, mapq int"), f, width=width).collect()}
        assert got == want
        assert reads.feature_bins(f, width).groupBy("id").count().agg(F.max("count")).first()[0] <= 2 or width == 1
    assert reads.count_features(spark.createDataFrame(rows, "read_id long, chrom string, start_at long, end_at long, mapq int"), f.limit(0)).count() == 2


def test_phred_of_the_first_reads(spark):
    from loomwell.operators import reads

    rows = spark.createDataFrame([(i, "hhhh" if i < 5 else "!!!!") for i in range(10)], "read_id long, qual string")
    assert [reads.detect_phred(rows.repartition(3), n).first().encoding for n in (5, 6, None)] == ["phred64", "phred33", "phred33"]
    assert reads.detect_phred(rows.limit(0)).first().encoding == "phred33"


def test_dense_search_of_many_queries_is_that_of_few(spark):
    import numpy as np

    from loomwell.operators import retrieval

    x = np.random.default_rng(2).normal(size=(300, 6)).round(2)
    rows = spark.createDataFrame([(f"v{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("zero", [0.0] * 6), ("none", None)], "vec_id string, embedding array<double>")
    asked = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    few, many = (sorted(map(tuple, retrieval.dense_topk(rows, asked, 5, block=40, most=m, part=70).collect())) for m in (1000, 1))
    assert few == many and len(few) == 301 * 5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = (unit[7] @ unit.T).round(9)
    assert [r[1] for r in sorted((r for r in few if r[0] == "v007"), key=lambda r: r[3])] == [f"v{i:03d}" for i in np.lexsort((np.arange(300), -scores))[:5]]


def test_sparse_search_is_exact_without_all_pairs(spark):
    rng = random.Random(6)
    rows = [(c, t, round(rng.random() * (0.01 if t == "the" else 1), 6)) for c in range(120) for t in ("the", *rng.sample("abcdefghij", 3))]
    queries = [(q, t, 1.0) for q in range(5) for t in ("the", *rng.sample("abcdefghij", 2))] + [(9, "unknown", 1.0)]
    weights = spark.createDataFrame(rows, "chunk_id long, token string, weight double")
    asked = spark.createDataFrame(queries, "chunk_id long, token string, weight double")
    want = {}
    for q in range(5):
        own = {t for a, t, _ in queries if a == q}
        score = {}
        for c, t, w in rows:
            if t in own:
                score[c] = score.get(c, 0) + w
        want |= {(q, c): i for i, c in enumerate(sorted(score, key=lambda c: (-round(score[c], 9), c))[:4], 1)}
    for most in (1000, 0):
        counts = {}
        assert {(r.query_id, r.chunk_id): r["rank"] for r in L.sparse_topk(asked, weights, 4, probe=1, most=most, counts=counts).collect()} == want
        assert 0 < counts["skipped"] < counts["blocks"]
    assert L.sparse_topk(asked.limit(0), weights, 4).count() == L.sparse_topk(asked, weights.limit(0), 4).count() == 0
    assert {(r.query_id, r.chunk_id) for r in L.sparse_topk(asked, weights, 1000, probe=2).collect()} == {(q, c) for q in range(5) for c in range(120)}


def test_sections_and_chunks(spark):
    text = "intro one.\n# First  #\nbody a.\nbody b.\n\n## \n## References\nx\n### Third\n"
    got = L.split_sections(spark.createDataFrame([("d", text), ("e", None), ("f", "")], "source string, text string")).orderBy("section_index").collect()
    assert [(r.section, r.level, r.text) for r in got] == [("Article", 1, "intro one."), ("First", 1, "First\nbody a.\nbody b.\n\n## "), ("References", 2, "References\nx"), ("Third", 3, "Third\n")]
    body = " ".join(f"word{i} w w w." for i in range(20))
    chunks = L.chunk_articles(spark.createDataFrame([("d", "# Results\n" + body)], "source string, text string"), target_words=20, overlap=1, min_words=5).orderBy("chunk_index").collect()
    assert chunks[0].text == "Results word0 w w w. " + " ".join(f"word{i} w w w." for i in range(1, 4)) and chunks[1].text.startswith("word3 w w w. word4")
    assert all(c.word_count <= 21 for c in chunks) and [c.chunk_index for c in chunks] == list(range(len(chunks)))


def test_pairs_and_mean_quality_of_reads(spark):
    reads = spark.createDataFrame([(1, 1, "ACGTACGT", "IIIIIIII"), (1, 2, "ACGTACGT", "IIIIIIII"), (2, 1, "ACGTACGT", "IIIIIIII"), (2, 2, "ACGTACGT", "########")], "read_id long, mate int, seq string, qual string")
    assert sorted((r.read_id, r.mate) for r in R.trim_pairs(reads, minlen=4).collect()) == [(1, 1), (1, 2)]
    assert R.trim_reads(reads, minlen=1, avgqual=41).count() == 0


def test_alignments_with_other_mates_stay(spark):
    rows = [(1, 0, "c", 5, 9, "+", 7, 100), (2, 0, "c", 5, 9, "+", 8, 100), (3, 0, "c", 5, 9, "+", 1, 200)]
    aln = spark.createDataFrame(rows, "read_id long, library int, chrom string, start_at long, end_at long, strand string, qual_sum int, mate_start long")
    assert sorted(r.read_id for r in R.dedup_alignments(aln).collect()) == [2, 3]
    assert [r.read_id for r in R.dedup_alignments(aln.drop("mate_start")).collect()] == [2]


def test_status_and_text_of_genes(spark):
    named = evidence(spark, "KOR1 acts in roots.", primary_name="kor1")
    done = E.validate_claims(claims(spark), named)
    asked = spark.createDataFrame([("g1", True), ("g2", None), ("g3", False)], "gene_id string, model_output_valid boolean")
    assert {(r.gene_id, r.accepted, r.rejected, r.status) for r in E.gene_status(done, asked).collect()} == {("g1", 1, 0, "supported_claims"), ("g2", 0, 0, "insufficient_evidence"), ("g3", 0, 1, "invalid_model_output")}
    assert E.render_claims(done).first().text == "It grows. [C1]"
    assert E.render_claims(E.validate_claims(claims(spark, citations=[]), named)).first().text == E.ABSTENTION


def test_structured_claims_come_first(spark):
    kind = "array<struct<claim:string,citations:array<string>,evidence_level:string,relationship_to_query:string,species:string,conditions:array<string>,confidence:string>>"
    rows = [("g1", "Free text [C1].", [("It grows.", ["C1", "C2"], "direct", "same_gene", "Oryza", ["salt", "cold"], "high")]), ("g2", "One [C1, C3]. Two. " + E.ABSTENTION, []), ("g3", E.ABSTENTION, None)]
    chunks = spark.createDataFrame([("g1", 2, "C2", "s", "b", "two"), ("g1", 1, "C1", "s", "a", "one")], "gene_id string, hit_rank int, citation_id string, source string, section string, text string")
    got = E.claim_sheet(spark.createDataFrame(rows, f"gene_id string, answer string, claims {kind}"), chunks).orderBy("gene_id", "claim_index").collect()
    assert [(r.gene_id, r.claim, r.refs, r.conditions, r.evidence_level) for r in got] == [("g1", "It grows.", "C1;C2", "salt;cold", "direct"), ("g2", "One [C1, C3].", "C1;C3", "", ""), ("g2", "Two.", "", "", "")]
    assert got[0].retrieved_evidence == "[C1] s \u2014 a\none\n\n[C2] s \u2014 b\ntwo"


def test_markdown_json_and_scorers(spark):
    from loomwell.operators import reports

    assert value(spark, "# Head\n- **a** *b* `c`\n2. d", C.strip_markdown) == "Head a b c d"
    kind = "struct<claims:array<string>,note:string>"
    for text, want in (('x ```json\n{"note": "n"}\n```', ([], "n")), ("no object", None), ("{broken", None), (None, None)):
        got = value(spark, text, lambda c: reports.extract_json_object(c, kind, {"claims": "array<string>"}))
        assert (got and (got.claims, got.note)) == want
    rows = spark.createDataFrame([("g", 1), ("g", 2), ("h", 5)], "gene_id string, x long")
    assert {tuple(r) for r in reports.with_scorer(rows, lambda f: f.groupby("gene_id", as_index=False)["x"].sum(), "gene_id string, x long").collect()} == {("g", 3), ("h", 5)}


def test_more_sources(spark, tmp_path):
    for i in (2, 1):
        (tmp_path / f"{i}.gff").write_text("".join(f"chr1\ts\tgene\t{k}\t9\t.\t+\t.\tID=f{i}-{k}\n" for k in range(3)))
    assert [r.attributes for r in S.read_gff(spark, str(tmp_path / "*.gff")).orderBy("line_no").collect()] == [f"ID=f{i}-{k}" for i in (1, 2) for k in range(3)]
    (tmp_path / "hits.tsv").write_text("query\torganism\nq\ta\nq\tb\n")
    assert [r.organism for r in S.read_uniprot_hits(spark, str(tmp_path / "hits.tsv")).orderBy("hit_pos").collect()] == ["a", "b"]
    (tmp_path / "t.csv").write_text("go_id,ontology\nGO:1,BP\n")
    (tmp_path / "e.csv").write_text("child,parent,relation,ontology\nGO:2,GO:1,is_a,BP\n")
    terms, edges = S.read_go(spark, str(tmp_path / "t.csv"), str(tmp_path / "e.csv"))
    assert terms.first().go_id == "GO:1" and edges.first().relation == "is_a"
    (tmp_path / "a.md").write_text("# T\n\nx")
    assert [tuple(r) for r in S.read_articles(spark, str(tmp_path / "a.md")).collect()] == [("a.md", "a", "# T\n\nx")]
    (tmp_path / "r.json").write_text('[{"gene_id": "g", "chunks": [{"text": "t"}, {"text": "u"}]}]')
    rag = S.read_rag_json(spark, str(tmp_path / "r.json"), "gene_id string, chunks array<struct<text:string>>")
    assert [tuple(r) for r in S.rag_chunks(rag).collect()] == [("g", 1, "t"), ("g", 2, "u")]
    (tmp_path / "p.json").write_text('{"species_terms": ["Oryza"], "go_terms": ["growth", ""]}')
    assert {tuple(r) for r in S.read_phrases(spark, str(tmp_path / "p.json")).collect()} == {("SPECIES", "Oryza"), ("GO_TERM", "growth")}
    (tmp_path / "n.json").write_text('{"g1": {"stable_ids": ["S1"]}}')
    r = S.read_entities(spark, str(tmp_path / "n.json")).first()
    assert (r.gene_id, r.stable_ids, r.orthologs) == ("g1", ["S1"], [])


def test_large_fastq_and_index_with_model(spark, tmp_path):
    (tmp_path / "l_1.fastq").write_text("".join(f"@r{i} x\nACGT\n+\n@II{i % 10}\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sorted((int(r.read_id[1:]), r.mate, r.seq, r.qual) for r in S.read_fastq(spark, str(tmp_path / "l_1.fastq")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, 1, "ACGT", f"@II{i % 10}") for i in range(500)]
    chunks, model = spark.createDataFrame([("c1", "a b"), ("c2", "a")], "chunk_id string, text string"), spark.createDataFrame([("a", 2, 0.5)], "token string, df long, idf double")
    for _ in range(2):
        S.export_index(chunks, 2, str(tmp_path / "i"), model)
    assert S.import_index(spark, str(tmp_path / "i")).count() == 2 and S.import_model(spark, str(tmp_path / "i")).first().token == "a"


@pytest.mark.parametrize("candidates, per_source", [(40, 2), (9, 1)])
def test_hybrid_search_against_brute_force(spark, candidates, per_source):
    rng = random.Random(candidates)
    chunks = {}
    for i in range(60):
        words = [rng.choice(["leaf", "root", "stem"]) for _ in range(6)] + ["Abc1"] * (rng.random() < 0.3) + ["chlorophyll"] * (rng.random() < 0.4)
        chunks[i] = (rng.choice(["Results", "Discussion", "References"]), rng.choice(["p", "q", "r", "", None]), " ".join(words))
    lists = {"sparse": {}, "dense": {}, "other": {}}
    for q in range(4):  # the last query has no lexical list
        for name in lists if q < 3 else ["dense"]:
            lists[name][q] = rng.sample(sorted(chunks), 25)

    want = []
    for q in range(4):
        score = {}
        for ranked in lists.values():
            for place, c in enumerate(ranked.get(q, []), 1):
                score[c] = score.get(c, 0) + 1 / (60 + place)
        fused = sorted(score, key=lambda c: (-round(score[c], 12), c))[:candidates]

        def keys(c):
            alias, context = "Abc1" in chunks[c][2], "chlorophyll" in chunks[c][2]
            return (-alias, -(alias and context), -context, fused.index(c))

        seen, first, later = {}, [], []
        for c in sorted(fused, key=keys):
            section, source, _ = chunks[c]
            if section == "References":
                continue
            seen[source] = seen.get(source, 0) + 1
            (later if source and seen[source] > per_source else first).append(c)
        want += [(q, c, place, f"C{place}") for place, c in enumerate((first + later)[:5], 1)]

    rows = [(name, q, c, place) for name, of in lists.items() for q, ranked in of.items() for place, c in enumerate(ranked, 1)]
    ranks = spark.createDataFrame(rows, "list string, query_id long, chunk_id long, rank int")
    none = F.array().cast("array<string>")
    texts = spark.createDataFrame([(c, *v) for c, v in chunks.items()], "chunk_id long, section string, source string, text string")
    texts = texts.withColumns({c: none for c in ("gene_like_mentions", "protein_family_mentions", "go_mentions", "cellular_component_mentions", "simple_chemical_mentions")})
    queries = spark.range(4).select(F.col("id").alias("query_id"), F.array(F.lit("Abc1")).alias("aliases"), F.lit("").alias("bm25"), F.lit("chlorophyll").alias("embedding"), none.alias("context_phrases"))
    got = P.hybrid_search(ranks.where("list = 'sparse'"), ranks.where("list <> 'sparse'"), texts, queries, candidates=candidates, per_source=per_source)
    assert sorted((r.query_id, r.chunk_id, r.final_rank, r.citation_id) for r in got.collect()) == sorted(want)
    assert P.hybrid_search(ranks.limit(0), ranks.limit(0), texts, queries).count() == 0


def test_accents_are_folded_by_decomposition(spark):
    from loomwell.operators import reports

    text = "Ångström ǅo Ếlan ά Žluťoučký ñ\u0303 ß naïve e\u0301"
    blob = spark.createDataFrame([(text,)], "t string").select(reports.search_blob(F.col("t")).alias("b"), reports.matches_all(reports.search_blob(F.col("t")), "ANGSTRÖM zlutoucky élan").alias("m")).first()
    assert blob.m and all(w in blob.b for w in ("angstrom", "elan", "α", "zlutoucky", " n ", "ß", "naive", " e"))


def test_rules_keep_rows_that_agree(spark):
    from loomwell.operators import evidence

    rows = spark.createDataFrame([("g", 1, "t", "s", "has bad word"), ("g", 1, "t", "s", "has bad word"), ("g", 2, "t", "s", "fine"), ("h", 3, "t", "s", None), (None, 4, "t", "s", "bad")], "gene_id string, chunk_id int, article_title string, section string, text string").withColumns({"_rules": F.lit("own"), "_text": F.lit("own")})
    none = []
    rules = spark.createDataFrame([("g", 2, "rule", ["bad"], none, none), ("g", 1, "rule", ["word"], ["bad"], none), ("g", 1, "alias", ["ctx"], ["fine"], none)], "gene_id string, rule_index int, kind string, any array<string>, all array<string>, unless_any array<string>")
    out = evidence.blocked(rows, rules)
    assert sorted((r.chunk_id, r.blocked_reason) for r in out.collect()) == [(1, "entity_policy_rule_1"), (1, "entity_policy_rule_1"), (2, "ambiguous_alias_without_context:fine"), (3, None), (4, None)]
    assert out.where("_rules <> 'own' OR _text <> 'own'").count() == 0
