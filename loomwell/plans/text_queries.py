"""Queries over articles, retrieval, evaluation, claims, jobs and reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwell.functions import columns as C
from loomwell.operators import evaluation as V
from loomwell.operators import evidence as E
from loomwell.operators import jobs as J
from loomwell.operators import literature as L
from loomwell.operators import reads as R
from loomwell.operators import retrieval as T
from loomwell.plans.inputs import duck, table


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def low_value_chunks(spark, d):
    return table(spark, d, "chunks").select("chunk_id", C.low_value_reason(F.col("section"), F.col("text")).alias("reason"))


def article_sections(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.regexp_replace("text", "\n", "\n## ").alias("text"))
    return L.split_sections(docs).select("source", "section_index", "level", F.length("text").alias("n"))


def article_chunks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    return L.chunk_articles(docs).select("chunk_id", "source", "section_index", "chunk_index", "word_count")


def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(C.split_sentences(F.col("text"))).cast("long").alias("n"))


def bm25_model(spark, d):
    return _r6(L.bm25_model(table(spark, d, "chunks")), "idf")


def bm25_stats(spark, d):
    return _r6(L.bm25_stats(table(spark, d, "chunks")), "avg_doc_length")


def bm25_index(spark, d):
    return L.bm25_index(L.bm25_model(table(spark, d, "chunks")).select("token")).select("token", F.col("token_id").cast("long").alias("token_id"))


def bm25_weights(spark, d):
    w = L.bm25_weights(*L.bm25_corpus(table(spark, d, "chunks")))
    return w.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("tokens"), F.round(F.sum("weight"), 3).alias("total"))


def sparse_topk(spark, d):
    terms, model, stats = L.bm25_corpus(table(spark, d, "chunks"))
    queries = L.bm25_weights(L.bm25_terms(table(spark, d, "lexical_queries").select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text"))), model, stats)
    return _r6(L.sparse_topk(queries, L.bm25_weights(terms, model, stats), 10), "score")


def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    return _r6(T.dense_topk(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10), "score")


def mean_pooled(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("vec_id"), "embedding", F.when(F.col("vec_id") % 7 == 0, 0).otherwise(1).alias("mask"))
    return T.mean_pool(e).select("vec_id", F.round(F.get("pooled", F.lit(0)), 5).alias("first"), F.round(F.get("pooled", F.lit(63)), 5).alias("last"))


def rrf_fusion(spark, d):
    lists = table(spark, d, "rankings").where("rank <= 40").select(F.col("method").alias("list"), "query_id", "chunk_id", "rank")
    return _r6(T.rrf_fuse(lists), "score")


def diversified(spark, d):
    r = table(spark, d, "rankings").join(table(spark, d, "chunks").select("chunk_id", "section", "text"), "chunk_id").withColumnRenamed("rank", "hit_rank")
    r = r.withColumn("source", F.concat("source", F.col("query_id") % 2)).withColumn("query_id", F.concat_ws("-", "method", "query_id"))
    return T.diversify(r).select("query_id", "chunk_id", "final_rank", "citation_id")


def _matched(spark, d):
    r = table(spark, d, "rankings").withColumnRenamed("rank", "hit_rank").withColumn("query_id", F.concat_ws("-", "method", "query_id")).join(table(spark, d, "chunks").select("chunk_id", "section", "text"), "chunk_id")
    words = F.split(F.col("text"), r"\s+")
    none = F.array().cast("array<string>")
    rows = r.withColumns({"aliases": F.array(F.lit("the"), F.lit("queur"), F.lit("token = ")), "bm25": F.lit("licensed public work"), "embedding": F.lit("general public licensed growth activity"), "context_phrases": F.array(F.lit("general public"))})
    rows = rows.withColumns({"gene_like_mentions": F.slice(words, 1, 2), "protein_family_mentions": F.array(F.lit("public family"), F.lit("other")), "go_mentions": F.array(F.lit("general public license"), F.lit("growth")), "cellular_component_mentions": none, "simple_chemical_mentions": F.slice(words, 3, 1)})
    return T.payload_match(rows)


def reranked(spark, d):
    return T.rerank(_matched(spark, d)).select("query_id", "chunk_id", "rerank")


def evidence_signals(spark, d):
    return T.evidence_signals(_matched(spark, d)).select("query_id", "chunks", "sources", "sections", "payload_chunks", "name_chunks", "family_chunks", "context_chunks", F.array_join("terms", "|").alias("terms"), F.array_join("signal_types", "|").alias("signal_types"))


def gene_aliases(spark, d):
    g = table(spark, d, "genes")
    return g.select("gene_id", F.array_join(T.aliases(F.col("uniprot_names"), F.col("name_gff"), F.col("uniprot_names")), "|").alias("aliases"))


def facet_queries(spark, d):
    g = table(spark, d, "genes").withColumn("phrases", T.context_phrases(F.concat_ws(", ", "name_gff", "uniprot_function", F.lit("response to salt"), "bp")))
    return g.select("gene_id", F.posexplode(T.facet_queries(F.col("name_gff"), F.col("phrases"))).alias("pos", "f")).select("gene_id", "pos", "f.facet", "f.query")


def _mentions(spark, d):
    words = [("SPECIES", "of the"), ("SPECIES", "les"), ("GO_TERM", "public license"), ("GO_TERM", "in"), ("PROTEIN_FAMILY", "MIT License")]
    return L.dictionary_mentions(table(spark, d, "chunks"), spark.createDataFrame(words, "label string, phrase string"))


def dictionary_mentions(spark, d):
    return _mentions(spark, d).select("chunk_id", "label", F.array_join("mentions", "|").alias("mentions"))


def mention_flags(spark, d):
    names = {"SPECIES": "species", "GO_TERM": "go", "PROTEIN_FAMILY": "protein_family"}
    flagged = L.mention_columns(table(spark, d, "chunks"), _mentions(spark, d), names)
    return flagged.select("chunk_id", *(f"has_{n}" for n in names.values()), *(F.array_join(f"{n}_mentions", "|").alias(n) for n in names.values()))


def pooled_documents(spark, d):
    return V.pool_documents(table(spark, d, "rankings"), 5)


def retrieval_metrics(spark, d):
    return _r6(V.retrieval_metrics(table(spark, d, "rankings"), table(spark, d, "qrels")), "p5", "ndcg", "rr", "recall")


def method_summary(spark, d):
    return _r6(V.method_summary(V.retrieval_metrics(table(spark, d, "rankings"), table(spark, d, "qrels"))), "p5", "ndcg", "rr", "recall")


def bootstrap_intervals(spark, d):
    m = V.retrieval_metrics(table(spark, d, "rankings"), table(spark, d, "qrels"))
    return _r6(V.bootstrap_ci(m.select("method", F.round("ndcg", 9).alias("value"))), "mean", "low", "high")


def claim_metrics(spark, d):
    return _r6(V.claim_metrics(table(spark, d, "claims")), "accuracy", "citation_accuracy")


def pairwise_kappa(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("annotator"))
    return _r6(V.pairwise_kappa(c.withColumn("label", ((F.col("item") * 7 + F.col("item") % 3 * F.ascii("annotator")) % 4).cast("string"))), "kappa")


def generation_coverage(spark, d):
    c = table(spark, d, "claims")
    return V.generation_coverage(c.withColumn("accepted", F.col("claim_label") == "supported"), c.select("gene_id").distinct())


def claim_sheet(spark, d):
    answer = F.concat(F.col("claim"), F.lit(" [C1, C2]. Then [C1]"), F.when(F.col("claim_index") % 2 == 0, F.lit(". " + E.ABSTENTION)).otherwise(""))
    return E.claim_sheet(table(spark, d, "claims").select(F.concat_ws("-", "gene_id", "claim_index").alias("gene_id"), answer.alias("answer"))).select("gene_id", "claim_id", "claim_index", "claim", "refs")


def _assessed(spark, d):
    c = table(spark, d, "claims")
    few = F.array().cast("array<string>")
    rows = c.select("gene_id", F.concat(F.lit("C"), F.col("claim_index")).alias("citation_id"), F.concat("claim", F.when(F.col("claim_index") % 2 == 0, " Under drought, Oryza grew. Salt in roots.").otherwise("")).alias("text"))
    rows = rows.withColumns({"primary_name": F.lit("gene x"), "blocked_reason": F.when(F.col("gene_id") % 5 == 0, F.lit("entity_policy_rule_1")), "stable_ids": F.array(F.lit("oryza")), "ortholog_terms": few, "alias_matches": few, "protein_family_matches": few, "species_mentions": F.array(F.lit("Oryza"))})
    return E.classify_evidence(rows)


def evidence_classes(spark, d):
    return _assessed(spark, d).select("gene_id", "citation_id", "relationship_to_query", "evidence_level", F.array_join("conditions", ",").alias("conditions"), F.when(F.col("text").isNotNull(), F.size("pairs")).cast("long").alias("pairs"))


def _validated(spark, d):
    c = table(spark, d, "claims").withColumns({"citations": F.array(F.concat(F.lit("C"), F.col("claim_index")), F.concat(F.lit("C"), F.col("claim_index") + 1)), "evidence_level": F.when(F.col("claim_index") % 3 == 0, "direct").otherwise("general"), "relationship_to_query": F.when(F.col("gene_id") % 3 == 0, "same_gene").otherwise("unknown"), "species": F.lit("oryza"), "conditions": F.when(F.col("claim_index") % 2 == 0, F.array(F.lit("drought"))).otherwise(F.array(F.lit("cold"))), "confidence": F.lit("high")})
    return E.validate_claims(c, _assessed(spark, d))


def validated_claims(spark, d):
    return _validated(spark, d).select("gene_id", "claim_index", "accepted", F.array_join("reasons", "|").alias("reasons"))


def gene_status(spark, d):
    asked = table(spark, d, "claims").select("gene_id").distinct().select("gene_id", (F.col("gene_id") % 7 != 0).alias("model_output_valid"))
    return E.gene_status(_validated(spark, d), asked)


def rendered_claims(spark, d):
    return E.render_claims(_validated(spark, d))


def blocked_chunks(spark, d):
    """Every chunk against the rules of one of five genes."""
    none = F.array().cast("array<string>")
    genes = spark.range(5).withColumnRenamed("id", "gene_id")
    rule = genes.select("gene_id", F.lit(1).alias("rule_index"), F.lit("rule").alias("kind"), F.array(F.lit("license"), F.lit("token")).alias("any"), none.alias("all"), F.array(F.lit("public")).alias("unless_any"))
    alias = genes.where("gene_id % 2 = 0").select("gene_id", F.lit(1).alias("rule_index"), F.lit("alias").alias("kind"), F.array(F.lit("growth")).alias("any"), F.array(F.lit("of")).alias("all"), none.alias("unless_any"))
    chunks = table(spark, d, "chunks").select((F.col("chunk_id") % 5).alias("gene_id"), "chunk_id", F.lit("Title").alias("article_title"), "section", "text")
    return E.blocked(chunks, rule.union(alias)).select("gene_id", "chunk_id", "blocked_reason")


def stripped_markdown(spark, d):
    marked = F.concat(F.lit("## "), F.regexp_replace("text", "\n", "\n- "), F.lit(" **bold** and *thin* `code`\n12. last"))
    return table(spark, d, "documents").select("doc_id", F.md5(C.strip_markdown(marked).cast("binary")).alias("digest"))


def expired_jobs(spark, d):
    return table(spark, d, "jobs").where(J.expired(F.col("created_at"), F.lit("2024-01-20").cast("timestamp"), 7)).select("id")


def payload_jobs(spark, d):
    jobs = table(spark, d, "jobs").withColumn("payload", F.to_json(F.struct(F.col("sample").alias("sra_code"), "stage"))).drop("sample")
    return J.latest_job(J.with_payload(jobs)).select("user_id", "sample", "id")


def trimmed_pairs(spark, d):
    one = table(spark, d, "reads").withColumn("mate", F.lit(1))
    two = one.select("read_id", "seq", F.concat(F.substring("qual", 3, 1000), F.lit("##")).alias("qual"), F.lit(2).alias("mate"))
    return R.trim_pairs(one.unionByName(two), minlen=4, avgqual=12).select("read_id", "mate", F.length("seq").alias("n"))


def read_profile(spark, d):
    return _r6(R.read_profile(table(spark, d, "reads")), "gc", "mean_quality")


def quality_quantiles(spark, d):
    return R.quality_quantiles(table(spark, d, "reads"))


def overrepresented_reads(spark, d):
    return _r6(R.overrepresented(table(spark, d, "reads")), "share")


def job_durations(spark, d):
    j = table(spark, d, "jobs").withColumns({"started_at": F.col("created_at"), "finished_at": F.col("created_at") + F.expr("make_interval(0, 0, 0, 0, 0, 0, floor(value))")})
    return _r6(J.job_durations(j), "mean_ms")


def latest_jobs(spark, d):
    return J.latest_job(table(spark, d, "jobs")).select("user_id", "sample", "id", "stage")


def recent_jobs(spark, d):
    return J.recent_jobs(table(spark, d, "jobs"), "click", 200).select("id", "user_id")


def job_statuses(spark, d):
    return table(spark, d, "jobs").select("id", C.normalize_status(F.col("status")).alias("status"))


def progress_lines(spark, d):
    return J.consecutive_dedup(table(spark, d, "jobs").select(F.col("user_id").alias("job_id"), F.col("id").alias("seq"), F.col("stage").alias("line")))


def stale_jobs(spark, d):
    now = F.lit("2030-01-01").cast("timestamp")
    return table(spark, d, "jobs").where(J.is_stale(F.col("status"), F.col("created_at"), now)).select("id")


def resume_genes(spark, d):
    return J.resume(table(spark, d, "claims").select("gene_id").distinct(), table(spark, d, "claims").where("claim_label = 'supported'"), ["gene_id"])


def job_windows(spark, d):
    return J.status_counts(table(spark, d, "jobs"))


def phred_encoding(spark, d):
    return R.detect_phred(table(spark, d, "reads"))


def trimmed_reads(spark, d):
    return R.trim_reads(table(spark, d, "reads"), minlen=4).select("read_id", F.length("seq").alias("n"))


def deduplicated_alignments(spark, d):
    return R.dedup_alignments(table(spark, d, "alignments")).select("library", "chrom", "read_id")


def feature_counts(spark, d):
    features = table(spark, d, "gff_lines").select(F.concat(F.lit("g"), F.col("line_no")).alias("id"), "seqid", "start_at", "end_at")
    return R.count_features(table(spark, d, "alignments"), features)


def quality_profile(spark, d):
    return _r6(R.quality_profile(table(spark, d, "reads")), "mean_quality")


def base_content(spark, d):
    return _r6(R.base_content(table(spark, d, "reads")), "share")


def duplication_levels(spark, d):
    return R.duplication_levels(table(spark, d, "reads"))


QUERIES = {
    f.__name__: f
    for f in (low_value_chunks, article_sections, article_chunks, sentences, bm25_model, bm25_stats, bm25_index, bm25_weights, sparse_topk, dense_topk, mean_pooled, rrf_fusion, diversified, reranked, evidence_signals, gene_aliases,
              facet_queries, dictionary_mentions, mention_flags, pooled_documents, retrieval_metrics, method_summary, bootstrap_intervals, claim_metrics, pairwise_kappa, generation_coverage, claim_sheet, evidence_classes, validated_claims, gene_status, rendered_claims, blocked_chunks, stripped_markdown, expired_jobs, payload_jobs, trimmed_pairs, read_profile, quality_quantiles, overrepresented_reads,
              job_durations, latest_jobs, recent_jobs, job_statuses, progress_lines, stale_jobs, resume_genes, job_windows, phred_encoding, trimmed_reads, deduplicated_alignments, feature_counts, quality_profile, base_content, duplication_levels)
}

_MENTIONS = r"""WITH w AS (SELECT chunk_id, ' ' || array_to_string(regexp_extract_all(lower(text), '\w+'), ' ') || ' ' AS h FROM {chunks}),
      p AS (SELECT * FROM (VALUES ('SPECIES', 'of the'), ('SPECIES', 'les'), ('GO_TERM', 'public license'), ('GO_TERM', 'in'), ('PROTEIN_FAMILY', 'MIT License')) v(label, phrase)),
      f AS (SELECT chunk_id, label, phrase, strpos(h, ' ' || lower(phrase) || ' ') AS place FROM w, p),
      m AS (SELECT chunk_id, label, string_agg(phrase, '|' ORDER BY place, phrase) AS mentions FROM f WHERE place > 0 GROUP BY chunk_id, label) """

_LOW = r"""CASE WHEN regexp_matches(lower(trim(regexp_replace(regexp_replace(section, '[*_`#>\[\]()]|<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), '""" + C.LOW_VALUE_SECTION + r"""') THEN 'low_value_section'
 WHEN len(string_split(lower(text), '|')) - 1 >= 12 OR (len(string_split(lower(text), '|')) - 1 >= 6 AND len(string_split(lower(text), '<br')) - 1 >= 8) THEN 'table_like_text'
 WHEN starts_with(lower(trim(text)), 'references ') OR starts_with(lower(trim(text)), '**references') OR regexp_matches(lower(text), 'google scholar|pubmed:|refhub\.elsevier\.com|doi\.org/') THEN 'reference_like_text' END"""
_TOK = "list_filter(regexp_extract_all(lower({0}), '[A-Za-z0-9][A-Za-z0-9_.-]*'), lambda x: length(x) >= 2)"
_TOKENS = lambda c: f"flatten(list_transform({_TOK.format(c)}, lambda x: CASE WHEN contains(x, '-') THEN [x] || list_filter(string_split(x, '-'), lambda y: length(y) >= 2) ELSE [x] END))"
_BM = f"""tk AS (SELECT chunk_id, {_TOKENS('text')} AS t FROM {{chunks}}), st AS (SELECT count(*) AS doc_count, avg(len(t)) AS al FROM tk), tf AS (SELECT chunk_id, len(t) AS length, unnest(t) AS token FROM tk),
 tc AS (SELECT chunk_id, token, length, count(*) AS tf FROM tf GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tc GROUP BY token), md AS (SELECT token, df, ln(1 + (doc_count - df + 0.5) / (df + 0.5)) AS idf FROM df, st)"""
_W = lambda a: f"idf * tf * 2.5 / (tf + CASE WHEN al > 0 THEN 1.5 * (0.25 + 0.75 * {a}.length / al) ELSE 1.5 END)"
_MET = """g AS (SELECT r.*, q.grade FROM {rankings} r JOIN {qrels} q USING (query_id, chunk_id)), o AS (SELECT method, query_id, count_if(rank <= 5 AND grade > 0) / 5 AS p5, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
  coalesce(1 / min(CASE WHEN grade = 2 THEN rank END), 0) AS rr, count_if(rank <= 10 AND grade > 0) AS hits FROM g GROUP BY ALL),
 i0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS rank FROM {qrels}), i AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS ideal, count_if(grade > 0) AS rel FROM i0 GROUP BY query_id),
 m AS (SELECT method, query_id, p5, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg, rr, CASE WHEN rel > 0 THEN hits / rel ELSE 0 END AS recall FROM o JOIN i USING (query_id))"""
_STATUS = "coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in C.STATUS_NAMES.items()) + "}[lower(trim(status))], upper(status))"

_TERMS = "regexp_extract_all(lower({0}), '[A-Za-z0-9][A-Za-z0-9_.+-]*')"
_JOINED = lambda c: f"array_to_string({_TERMS.format(c)}, ' ')"
_HOLDS = lambda c, words: f"len(list_filter({list(words)}, lambda t: contains({c}, t)))"
_NAMES, _CONTEXT = ("licensed", "public", "work"), ("general", "public", "licensed", "growth")
_MATCHED = f"""r AS (SELECT r.method || '-' || r.query_id AS query_id, r.chunk_id, r.source, r.rank AS hit_rank, c.section, {_JOINED('c.text')} AS j, regexp_split_to_array(c.text, '\\s+') AS w FROM {{rankings}} r JOIN {{chunks}} c ON c.chunk_id = r.chunk_id),
 x AS (SELECT *, list_filter(['the', 'queur', 'token = '], lambda t: contains(j, trim(replace(t, '=', '')))) AS ta, list_filter(['the', 'queur', 'token = '], lambda t: contains({_JOINED("array_to_string(w[1:2], ' ')")}, trim(replace(t, '=', '')))) AS ap,
   CASE WHEN len(w) >= 3 AND {_HOLDS(_JOINED('w[3]'), _CONTEXT)} > 0 THEN 1 ELSE 0 END AS cp, {_HOLDS('j', _NAMES)} AS nm, {_HOLDS('j', _CONTEXT)} AS cx FROM r)"""
_SENTENCES = r"string_split(regexp_replace({0}, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1))"
_SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_FOUND = lambda c: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, '(?i){p}') THEN '{n}' END" for n, p in E.CONDITIONS.items()) + "], lambda y: y IS NOT NULL)"
_ASSESSED = f"""t0 AS (SELECT gene_id, claim_index, 'C' || claim_index AS cid, {_SQUEEZED.format("claim || CASE WHEN claim_index % 2 = 0 THEN ' Under drought, Oryza grew. Salt in roots.' ELSE '' END")} AS t FROM {{claims}}),
 t1 AS (SELECT *, contains(lower(t), gene_id::VARCHAR) OR contains(lower(t), 'oryza') AS exact, contains(lower(t), 'gene x') AS named, gene_id % 5 = 0 AS blocked, {_FOUND('t')} AS cs,
   flatten(list_transform(list_filter({_SENTENCES.format('t')}, lambda s: contains(lower(s), 'oryza')), lambda s: {_FOUND('s')})) AS ps FROM t0),
 ev AS (SELECT *, CASE WHEN blocked THEN 'none' WHEN exact THEN 'same_gene' WHEN named THEN 'unknown' ELSE 'none' END AS rel, CASE WHEN blocked THEN 'general' WHEN exact THEN 'direct' ELSE 'general' END AS lev FROM t1)"""
_VALIDATED = _ASSESSED + f""", cl AS (SELECT gene_id, claim_index, {_SQUEEZED.format("claim")} AS claim, ['C' || claim_index, 'C' || (claim_index + 1)] AS cits, CASE WHEN claim_index % 3 = 0 THEN 'direct' ELSE 'general' END AS lvl,
   CASE WHEN gene_id % 3 = 0 THEN 'same_gene' ELSE 'unknown' END AS rel, CASE WHEN claim_index % 2 = 0 THEN 'drought' ELSE 'cold' END AS cond FROM {{claims}}),
 ct AS (SELECT gene_id, claim_index, unnest(cits) AS cid FROM cl),
 es AS (SELECT ct.gene_id, ct.claim_index, bool_or(ev.cid IS NULL) AS unknown, count(ev.cid) AS n, coalesce(bool_or(blocked), false) AS blocked, coalesce(bool_or(rel = 'same_gene'), false) AS same, coalesce(bool_or(lev = 'direct'), false) AS direct,
   coalesce(bool_or(rel NOT IN ('family', 'none')), false) AS own, list_transform(flatten(coalesce(list(cs) FILTER (WHERE ev.cid IS NOT NULL), [])), lambda c: lower(c)) AS sup, list_transform(flatten(coalesce(list(ps) FILTER (WHERE ev.cid IS NOT NULL), [])), lambda c: lower(c)) AS pairs
   FROM ct LEFT JOIN ev ON ev.gene_id = ct.gene_id AND ev.cid = ct.cid GROUP BY ct.gene_id, ct.claim_index),
 rs AS (SELECT cl.*, list_filter([CASE WHEN claim = '' THEN 'empty_claim' END, CASE WHEN unknown THEN 'unknown_citation' END, CASE WHEN blocked THEN 'blocked_entity_evidence' END, CASE WHEN rel = 'same_gene' AND NOT same THEN 'unverified_same_gene_attribution' END,
   CASE WHEN lvl = 'direct' AND NOT direct THEN 'unverified_direct_evidence' END, CASE WHEN n > 0 AND NOT own THEN 'family_or_context_used_as_gene_specific' END, CASE WHEN regexp_matches(claim, '{E.STRONG}') AND lvl <> 'direct' THEN 'unsupported_claim_strength' END,
   CASE WHEN NOT list_contains(sup, cond) THEN 'unsupported_condition:' || cond END, """ + ", ".join(f"CASE WHEN regexp_matches(claim, '(?i){p}') AND NOT list_contains(sup, '{n.lower()}') THEN 'unsupported_condition_in_text:{n}' END" for n, p in E.CONDITIONS.items()) + """,
   CASE WHEN NOT list_contains(pairs, cond) THEN 'unverified_species_condition_pair:oryza:' || cond END], lambda y: y IS NOT NULL) AS reasons FROM cl JOIN es USING (gene_id, claim_index))"""
_ABOUT = lambda c: f"list_filter(list_filter(regexp_extract_all(lower({c}), '[A-Za-z0-9][A-Za-z0-9_.+-]*'), lambda t: length(t) >= 3), lambda t: NOT list_contains({C.NAME_STOP}, t))"
_ONCE = lambda c: f"list_filter({c}, lambda x, i: list_position(list_transform({c}, lambda y: lower(y)), lower(x)) = i)"
_FACET = "CASE " + " ".join(f"WHEN regexp_matches(lower(x), '{'|'.join(w)}') THEN '{n}'" for n, w in T.FACETS) + " ELSE 'biological_process' END"
_TRIM = """w0 AS (SELECT *, list_transform(string_split(qual, ''), lambda x: ascii(x) - 33) AS v FROM {0}), w1 AS (SELECT *, coalesce(list_filter(range(0, len(v) - 3), lambda i: list_sum(v[i + 1:i + 4]) < 60)[1], len(v)) AS n FROM w0),
 w2 AS (SELECT *, list_filter(range(1, n + 1), lambda i: v[i] >= 3) AS ok FROM w1), kept AS (SELECT *, ok[-1] - ok[1] + 1 AS len_, list_avg(v[ok[1]:ok[-1]]) AS mq FROM w2 WHERE len(ok) > 0 AND ok[-1] - ok[1] + 1 >= 4)"""

_SQL = {
    "article_sections": r"""WITH a AS (SELECT doc_id::VARCHAR AS source, string_split(regexp_replace(replace(text, chr(10), chr(10) || '## '), '\r\n?', chr(10), 'g'), chr(10)) AS l FROM {documents}),
      b AS (SELECT source, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM a), c AS (SELECT *, regexp_matches(line, '^\s{0,3}(#{1,6})\s+(\S.*)$') AS head FROM b),
      d AS (SELECT *, sum(CASE WHEN head OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY i) AS g, CASE WHEN head THEN trim(regexp_replace(regexp_extract(line, '^\s{0,3}(#{1,6})\s+(\S.*)$', 2), '#+\s*$', '')) ELSE line END AS t FROM c),
      e AS (SELECT source, g, string_agg(t, chr(10) ORDER BY i) AS text, max(CASE WHEN head THEN length(regexp_extract(line, '^\s{0,3}(#{1,6})\s+', 1)) END) AS level FROM d GROUP BY source, g)
      SELECT source, (row_number() OVER (PARTITION BY source ORDER BY g) - 1)::INT AS section_index, coalesce(level, 1)::INT AS level, length(text)::INT AS n FROM e WHERE trim(text) <> ''""",
    "dictionary_mentions": _MENTIONS + "SELECT * FROM m",
    "mention_flags": _MENTIONS + """SELECT c.chunk_id, coalesce(bool_or(label = 'SPECIES'), false) AS has_species, coalesce(bool_or(label = 'GO_TERM'), false) AS has_go, coalesce(bool_or(label = 'PROTEIN_FAMILY'), false) AS has_protein_family,
      coalesce(max(mentions) FILTER (WHERE label = 'SPECIES'), '') AS species, coalesce(max(mentions) FILTER (WHERE label = 'GO_TERM'), '') AS go, coalesce(max(mentions) FILTER (WHERE label = 'PROTEIN_FAMILY'), '') AS protein_family
      FROM {chunks} c LEFT JOIN m USING (chunk_id) GROUP BY c.chunk_id""",
    "reranked": f"WITH {_MATCHED} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY 2 * len(ap) + len(ta) DESC, cp DESC, nm DESC, cx DESC, hit_rank, chunk_id) AS rerank FROM x",
    "evidence_signals": f"""WITH {_MATCHED}, c AS (SELECT query_id, count(*) AS chunks, count(DISTINCT source) AS sources, count(DISTINCT section) AS sections, count(*) AS payload_chunks, count_if(len(ta) + len(ap) > 0)::BIGINT AS name_chunks, count(*) AS family_chunks, count(*) AS context_chunks,
      flatten(list(ta || ap ORDER BY hit_rank, chunk_id)) AS t FROM x GROUP BY query_id)
      SELECT * EXCLUDE t, array_to_string(list_filter(t, lambda y, i: list_position(t, y) = i)[1:20], '|') AS terms, CASE WHEN name_chunks > 0 THEN 'name|' ELSE '' END || 'family|context' AS signal_types FROM c""",
    "gene_aliases": rf"""WITH g AS (SELECT gene_id, trim(uniprot_names) AS u, trim(name_gff) AS nm FROM {{genes}}),
      h AS (SELECT *, [u, nm, trim(regexp_replace(u, '\s*\([^)]*\)', '', 'g'))] || list_filter(list_transform(regexp_extract_all(u, '\(([^()]+)\)', 1), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(ec |go:)')) AS given FROM g),
      s AS (SELECT gene_id, list_transform(given || list_filter(regexp_extract_all(array_to_string(given, ' ') || ' ' || u, '\b[A-Za-z]{{1,8}}[A-Za-z-]*\d+[A-Za-z0-9-]*\b'), lambda x: length(x) >= 3 AND NOT starts_with(upper(x), 'GO')), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^[ ,;]+|[ ,;]+$', '', 'g')) AS l FROM h),
      k AS (SELECT gene_id, list_filter(l, lambda x: length(x) >= 3 AND (len({_ABOUT('x')}) > 0 OR regexp_matches(x, '\d'))) AS l FROM s) SELECT gene_id, array_to_string({_ONCE('l')}, '|') AS aliases FROM k""",
    "facet_queries": rf"""WITH g AS (SELECT gene_id, name_gff, list_filter(list_transform(regexp_split_to_array(concat_ws(', ', name_gff, uniprot_function, 'response to salt', bp), '[,;|]'), lambda p: regexp_replace(p, '^[ ,;:-]+|[ ,;:-]+$', '', 'g')), lambda p: p <> '') AS l FROM {{genes}}),
      h AS (SELECT gene_id, name_gff, list_filter({_ONCE('l')}, lambda p: lower(p) <> lower(name_gff)) AS l FROM g),
      q AS (SELECT gene_id, ([{{'facet': 'identity', 'query': name_gff}}] || list_transform(l, lambda x: {{'facet': {_FACET}, 'query': name_gff || ', ' || x}}))[1:5] AS f FROM h)
      SELECT gene_id, unnest(range(0, len(f)))::INT AS pos, unnest(f).facet AS facet, unnest(f).query AS query FROM q""",
    "bootstrap_intervals": f"""WITH {_MET}, v AS (SELECT method, list(round(ndcg, 9) ORDER BY round(ndcg, 9)) AS v, avg(round(ndcg, 9)) AS mean FROM m GROUP BY method),
      d AS (SELECT method, mean, r, i, v[('0x' || substr(md5('20260811:' || r || ':' || i), 1, 8))::BIGINT % len(v) + 1] AS x FROM v, unnest(range(1, 2001)) AS a(r), LATERAL unnest(range(1, len(v) + 1)) AS b(i)),
      s AS (SELECT method, mean, r, avg(x) AS m FROM d GROUP BY ALL), l AS (SELECT method, mean, list(m ORDER BY m) AS ms FROM s GROUP BY ALL) SELECT method, round(mean, 6) AS mean, round(ms[51], 6) AS low, round(ms[1951], 6) AS high FROM l""",
    "claim_sheet": rf"""WITH a AS (SELECT gene_id || '-' || claim_index AS gene_id, trim(claim || ' [C1, C2]. Then [C1]' || CASE WHEN claim_index % 2 = 0 THEN '. {E.ABSTENTION}' ELSE '' END) AS t FROM {{claims}}),
      b AS (SELECT gene_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '' AND x <> '{E.ABSTENTION}') AS l FROM a),
      c AS (SELECT gene_id, unnest(range(1, len(l) + 1))::INT AS claim_index, unnest(l) AS claim FROM b), d AS (SELECT *, regexp_extract_all(array_to_string(regexp_extract_all(claim, '\[[^\]]*\]'), ' '), '\bC\d+\b') AS r FROM c)
      SELECT gene_id, substr(sha256(gene_id || chr(31) || claim_index || chr(31) || claim), 1, 16) AS claim_id, claim_index, claim, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ';') AS refs FROM d""",
    "evidence_classes": f"WITH {_ASSESSED} SELECT gene_id, cid AS citation_id, rel AS relationship_to_query, lev AS evidence_level, array_to_string(cs, ',') AS conditions, len(ps) AS pairs FROM ev",
    "validated_claims": f"WITH {_VALIDATED} SELECT gene_id, claim_index, len(reasons) = 0 AS accepted, array_to_string(reasons, '|') AS reasons FROM rs",
    "gene_status": f"""WITH {_VALIDATED}, g AS (SELECT gene_id, count_if(len(reasons) = 0)::BIGINT AS a, count_if(len(reasons) > 0)::BIGINT AS r FROM rs GROUP BY gene_id)
      SELECT gene_id, CASE WHEN gene_id % 7 = 0 THEN 0 ELSE a END AS accepted, CASE WHEN gene_id % 7 = 0 THEN 1 ELSE r END AS rejected, CASE WHEN gene_id % 7 = 0 THEN 'invalid_model_output' WHEN a > 0 THEN 'supported_claims' ELSE 'insufficient_evidence' END AS status FROM g""",
    "rendered_claims": f"WITH {_VALIDATED} SELECT gene_id, coalesce(string_agg(claim || ' [' || array_to_string(cits, ', ') || ']', ' ' ORDER BY claim_index) FILTER (WHERE len(reasons) = 0), '{E.ABSTENTION}') AS text FROM rs GROUP BY gene_id",
    "blocked_chunks": rf"""WITH c AS (SELECT chunk_id % 5 AS gene_id, chunk_id, lower('Title ' || {_SQUEEZED.format('section')} || ' ' || {_SQUEEZED.format("coalesce(text, '')")}) AS t FROM {{chunks}})
      SELECT gene_id, chunk_id, CASE WHEN (contains(t, 'license') OR contains(t, 'token')) AND NOT contains(t, 'public') THEN 'entity_policy_rule_1' WHEN gene_id % 2 = 0 AND contains(t, 'of') AND NOT contains(t, 'growth') THEN 'ambiguous_alias_without_context:of' END AS blocked_reason FROM c""",
    "stripped_markdown": r"""WITH a AS (SELECT doc_id, '## ' || replace(text, chr(10), chr(10) || '- ') || ' **bold** and *thin* `code`' || chr(10) || '12. last' AS t FROM {documents}),
      b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#{1,6}\s*', '', 'g'), '(?m)^\s*[-*]\s+', '', 'g'), '(?m)^\s*\d+\.\s+', '', 'g') AS t FROM a)
      SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*\n]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '\s+', ' ', 'g'))) AS digest FROM b""",
    "expired_jobs": "SELECT id FROM {jobs} WHERE created_at < TIMESTAMP '2024-01-13'",
    "payload_jobs": "SELECT user_id, sample, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sample ORDER BY created_at DESC, id DESC) AS n FROM {jobs}) WHERE n = 1",
    "trimmed_reads": "WITH " + _TRIM.format("{reads}") + " SELECT read_id, len_::INT AS n FROM kept",
    "trimmed_pairs": "WITH two AS (SELECT read_id, 1 AS mate, qual FROM {reads} UNION ALL SELECT read_id, 2, substr(qual, 3) || '##' FROM {reads}), " + _TRIM.format("two") + ", g AS (SELECT *, count(*) OVER (PARTITION BY read_id) AS m FROM kept WHERE mq >= 12) SELECT read_id, mate, len_::INT AS n FROM g WHERE m = 2",
    "read_profile": "SELECT read_id, length(seq)::INT AS length, round(len(regexp_extract_all(seq, '[GC]')) / length(seq), 6) AS gc, round(list_avg(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)), 6) AS mean_quality FROM {reads}",
    "quality_quantiles": "WITH c AS (SELECT unnest(range(0, length(qual)))::INT AS position, unnest(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)) AS q FROM {reads}) SELECT position, quantile_disc(q, 0.25)::INT AS q25, quantile_disc(q, 0.5)::INT AS q50, quantile_disc(q, 0.75)::INT AS q75 FROM c GROUP BY position",
    "overrepresented_reads": "WITH n AS (SELECT seq, count(*) AS n FROM {reads} GROUP BY seq) SELECT seq, n, round(n / (SELECT count(*) FROM {reads}), 6) AS share FROM n WHERE n / (SELECT count(*) FROM {reads}) > 0.001",
    "low_value_chunks": "SELECT chunk_id, " + _LOW + " AS reason FROM {chunks}",
    "sentences": r"SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(text, E' \t\n\r\x0B\f'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS n FROM {documents}",
    "bm25_model": f"WITH {_BM} SELECT token, df, round(idf, 6) AS idf FROM md",
    "bm25_stats": f"WITH {_BM} SELECT doc_count, round(al, 6) AS avg_doc_length FROM st",
    "bm25_index": f"WITH {_BM} SELECT token, row_number() OVER (ORDER BY token) AS token_id FROM md",
    "bm25_weights": f"WITH {_BM} SELECT chunk_id, count(*) AS tokens, round(sum({_W('tc')}), 3) AS total FROM tc JOIN md USING (token), st WHERE {_W('tc')} > 0 GROUP BY chunk_id",
    "sparse_topk": f"""WITH {_BM}, w AS (SELECT chunk_id, token, {_W('tc')} AS w FROM tc JOIN md USING (token), st), qt AS (SELECT query_id, {_TOKENS('query')} AS t FROM {{lexical_queries}}), qx AS (SELECT query_id, len(t) AS length, unnest(t) AS token FROM qt),
      qc AS (SELECT query_id, token, length, count(*) AS tf FROM qx GROUP BY ALL), qw AS (SELECT query_id, token, {_W('qc')} AS w FROM qc JOIN md USING (token), st), s AS (SELECT query_id, chunk_id, sum(w.w * qw.w) AS score FROM w JOIN qw USING (token) GROUP BY ALL)
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""",
    "dense_topk": """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM {embeddings}),
      s AS (SELECT q.vec_id AS query_id, n.vec_id, round(list_inner_product(q.e, n.e) / (q.n * n.n), 9) AS score FROM n q, n WHERE q.vec_id % 50 = 0)
      SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "mean_pooled": """WITH x AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS v FROM {embeddings} WHERE vec_id % 7 <> 0), a AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL)
      SELECT label AS vec_id, round(max(CASE WHEN i = 1 THEN v END) / sqrt(sum(v * v)), 5) AS first, round(max(CASE WHEN i = 64 THEN v END) / sqrt(sum(v * v)), 5) AS last FROM a GROUP BY label""",
    "rrf_fusion": """WITH s AS (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS score FROM {rankings} WHERE rank <= 40 GROUP BY ALL)
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM s) WHERE rank <= 40""",
    "diversified": f"""WITH r AS (SELECT method || '-' || r.query_id AS query_id, r.chunk_id, r.rank, r.source || (r.query_id % 2) AS source, section, text FROM {{rankings}} r JOIN {{chunks}} c ON c.chunk_id = r.chunk_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 2 AS later FROM r WHERE ({_LOW}) IS NULL),
      f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, rank) AS final_rank FROM k) SELECT query_id, chunk_id, final_rank, 'C' || final_rank AS citation_id FROM f WHERE final_rank <= 5""",
    "pooled_documents": """WITH p AS (SELECT DISTINCT query_id, chunk_id FROM {rankings} WHERE rank <= 5), s AS (SELECT *, substr(sha256(query_id || chr(31) || chunk_id), 1, 16) AS pool_id FROM p) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('0:' || pool_id)) AS position FROM s""",
    "retrieval_metrics": f"WITH {_MET} SELECT method, query_id, round(p5, 6) AS p5, round(ndcg, 6) AS ndcg, round(rr, 6) AS rr, round(recall, 6) AS recall FROM m",
    "method_summary": f"WITH {_MET} SELECT method, count(*) AS queries, round(avg(p5), 6) AS p5, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr, round(avg(recall), 6) AS recall FROM m GROUP BY method",
    "claim_metrics": """SELECT annotator, count(*) AS labels, count_if(claim_label = 'supported')::BIGINT AS supported, count_if(claim_label = 'partially_supported')::BIGINT AS partially_supported, count_if(claim_label = 'unsupported')::BIGINT AS unsupported, count_if(claim_label = 'contradicted')::BIGINT AS contradicted,
      round(count_if(claim_label = 'supported') / count(*), 6) AS accuracy, round(count_if(citations_correct = '1') / count_if(citations_correct IN ('0', '1')), 6) AS citation_accuracy, count(DISTINCT (gene_id, claim_index)) AS claims FROM {claims} GROUP BY ROLLUP (annotator)""",
    "pairwise_kappa": """WITH c AS (SELECT doc_id AS item, a, (doc_id * 7 + doc_id % 3 * ascii(a)) % 4 AS l FROM {documents}, (VALUES ('a'), ('b'), ('c')) v(a)), p AS (SELECT x.a AS aa, y.a AS ab, x.l AS la, y.l AS lb FROM c x JOIN c y ON x.item = y.item AND x.a < y.a),
      n AS (SELECT aa, ab, count(*) AS n, count_if(la = lb) AS agreed FROM p GROUP BY ALL), r AS (SELECT aa, ab, la AS l, count(*) AS x FROM p GROUP BY ALL), s AS (SELECT aa, ab, lb AS l, count(*) AS y FROM p GROUP BY ALL), e AS (SELECT aa, ab, sum(x * y) AS ch FROM r JOIN s USING (aa, ab, l) GROUP BY ALL)
      SELECT aa AS annotator_a, ab AS annotator_b, n AS items, round(CASE WHEN coalesce(ch, 0) / (n * n) >= 1 THEN 1 ELSE (agreed / n - coalesce(ch, 0) / (n * n)) / (1 - coalesce(ch, 0) / (n * n)) END, 6) AS kappa FROM n LEFT JOIN e USING (aa, ab)""",
    "generation_coverage": """WITH g AS (SELECT gene_id, count_if(claim_label = 'supported') AS y, count_if(claim_label <> 'supported') AS n FROM {claims} GROUP BY gene_id)
      SELECT count(*) AS genes, count_if(y > 0)::BIGINT AS answered, count_if(y = 0)::BIGINT AS abstained, sum(y)::BIGINT AS accepted_claims, sum(n)::BIGINT AS rejected_claims FROM g""",
    "latest_jobs": "SELECT user_id, sample, id, stage FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sample ORDER BY created_at DESC, id DESC) AS n FROM {jobs}) WHERE n = 1",
    "recent_jobs": "SELECT id, user_id FROM {jobs} WHERE stage = 'click' ORDER BY created_at DESC, id DESC LIMIT 200",
    "job_statuses": f"SELECT id, {_STATUS} AS status FROM {{jobs}}",
    "job_durations": f"SELECT stage, {_STATUS} AS status, count(*) AS jobs, round(avg(floor(value) * 1000), 6) AS mean_ms, max(floor(value) * 1000)::BIGINT AS max_ms FROM {{jobs}} GROUP BY ALL",
    "progress_lines": "SELECT user_id AS job_id, id AS seq, stage AS line FROM (SELECT *, lag(stage) OVER (PARTITION BY user_id ORDER BY id) AS b FROM {jobs} WHERE trim(stage) <> '') WHERE b IS NULL OR b <> stage",
    "stale_jobs": f"SELECT id FROM {{jobs}} WHERE {_STATUS} = 'PENDING' AND epoch(TIMESTAMP '2030-01-01') - epoch(created_at) > 300",
    "resume_genes": "SELECT DISTINCT gene_id FROM {claims} WHERE gene_id NOT IN (SELECT gene_id FROM {claims} WHERE claim_label = 'supported')",
    "job_windows": f"SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start, stage, {_STATUS} AS status, count(*) AS n FROM {{jobs}} GROUP BY ALL",
    "phred_encoding": "WITH c AS (SELECT unnest(list_transform(string_split(qual, ''), lambda x: ascii(x))) AS c FROM (SELECT qual FROM {reads} ORDER BY read_id LIMIT 10000)) SELECT CASE WHEN min(c) < 64 THEN 'phred33' WHEN max(c) > 74 THEN 'phred64' ELSE 'phred33' END AS encoding, min(c)::INT AS lo, max(c)::INT AS hi FROM c",
    "deduplicated_alignments": "SELECT library, chrom, read_id FROM (SELECT *, row_number() OVER (PARTITION BY library, chrom, CASE WHEN strand = '-' THEN end_at ELSE start_at END, strand ORDER BY qual_sum DESC, read_id) AS n FROM {alignments}) WHERE n = 1",
    "feature_counts": """WITH h AS (SELECT a.read_id, a.mapq, min('g' || f.line_no) AS lo, max('g' || f.line_no) AS hi FROM {alignments} a LEFT JOIN {gff_lines} f ON f.seqid = a.chrom AND a.start_at <= f.end_at AND f.start_at <= a.end_at GROUP BY ALL)
      SELECT CASE WHEN mapq < 10 THEN '__too_low_aQual' WHEN lo IS NULL THEN '__no_feature' WHEN lo < hi THEN '__ambiguous' ELSE lo END AS id, count(*) AS n FROM h GROUP BY 1""",
    "quality_profile": "WITH c AS (SELECT unnest(range(0, length(qual)))::INT AS position, unnest(string_split(qual, '')) AS c FROM {reads}) SELECT position, count(*) AS reads, round(avg(ascii(c) - 33), 6) AS mean_quality FROM c GROUP BY position",
    "base_content": "WITH c AS (SELECT unnest(range(0, length(seq)))::INT AS position, unnest(string_split(seq, '')) AS base FROM {reads}), n AS (SELECT position, base, count(*) AS n FROM c GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY position), 6) AS share FROM n",
    "duplication_levels": "SELECT level, count(*) AS sequences FROM (SELECT seq, count(*) AS level FROM {reads} GROUP BY seq) GROUP BY level",
}
SQL = {k: duck(v) for k, v in _SQL.items()}
