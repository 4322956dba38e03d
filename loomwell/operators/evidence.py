"""Evidence for generated claims: blocked chunks, evidence classes, validation of claims."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions import columns as C
from loomwell.runtime import free_name

# Classes of evidence, and patterns of strong wording and of conditions.
LEVELS = ("direct", "ortholog", "paralog", "family", "general")
RELATIONS = ("same_gene", "ortholog", "paralog", "family", "none", "unknown")
CONFIDENCE = ("high", "medium", "low")
STRONG = r"(?i)\b(?:critical|crucial|essential|indispensable|major|central|required for|demonstrates?|proves?|controls?)\b"
INDIRECT = r"(?i)\b(?:the|this|query) gene(?:'s)?\b|\bits function\b"
CONDITIONS = {
    "drought": r"\b(?:drought|water deficit|dehydration)\b",
    "salt": r"\b(?:salt|salinity|nacl)\b",
    "cold": r"\b(?:cold|chilling|freezing)\b",
    "heat": r"\b(?:heat|heat shock|high temperature)\b",
    "pathogen": r"\b(?:pathogen|infection|infected|disease)\b",
    "dark": r"\b(?:dark|dark-induced)\b",
    "light": r"\b(?:light|de-etiolation)\b",
    "ABA": r"\b(?:ABA|abscisic acid)\b",
    "TBM": r"\bTBM\b",
    "IM": r"\bIM\b",
}
_LIST = "array<string>"


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))


def told(text: Column, pattern: str) -> Column:
    """Whether a text matches, letters in either case; words end at all but A-Z, a-z, 0-9 and _.

    Spark's own ``\\b`` takes accented letters for parts of a word, other engines don't. Patterns have it
    before the first and after the last letter of their alternatives.
    """
    begun = re.sub(r"(^|\|)\\b", r"\1(?<!\\w)", pattern.removeprefix("(?i)"))
    return text.rlike("(?i)" + begun.replace(r"\b", r"(?!\w)"))


def conditions(text: Column) -> Column:
    """Names of the conditions that a text mentions."""
    return F.array_compact(F.array(*(F.when(told(text, p), F.lit(n)) for n, p in CONDITIONS.items())))


def species_condition_pairs(text: Column, species: Column) -> Column:
    """(species, condition) structs that occur in one sentence."""
    sentences = F.split(text, r"(?<=[.!?;])\s+")

    def of(sentence: Column) -> Column:
        here = F.filter(species, lambda s: F.lower(sentence).contains(F.lower(squeezed(s))))
        return F.flatten(F.transform(here, lambda s: F.transform(conditions(sentence), lambda c: F.struct(s.alias("species"), c.alias("condition")))))

    return F.flatten(F.transform(sentences, of))


def blocked(chunks: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``blocked_reason`` (null if none) to (gene_id, chunk) rows.

    ``rules``: (gene_id, rule_index, kind, any, all, unless_any) with kind ``rule`` or ``alias``; for
    an alias, ``all`` holds the alias and ``any`` the words of which one must stand beside it. The
    first matching rule names the reason; aliases come after rules. A gene's rules are tested in one
    list beside each chunk's text, so rows stay as they are.
    """
    text = F.lower(F.concat_ws(" ", *(squeezed(F.col(c)) for c in ("article_title", "section", "text"))))
    rules_, text_ = free_name(chunks, "_rules"), free_name(chunks, "_text")

    def reason(r: Column) -> Column:
        has = lambda words: F.exists(words, lambda t: F.col(text_).contains(F.lower(t)))
        every = F.forall(r["all"], lambda t: F.col(text_).contains(F.lower(t)))
        rule = ((F.size(r["any"]) == 0) | has(r["any"])) & ((F.size(r["all"]) == 0) | every) & ~has(r["unless_any"])
        alias = (F.size(r["all"]) > 0) & every & (F.size(r["any"]) > 0) & ~has(r["any"])
        named = F.when(r["kind"] == "rule", F.concat(F.lit("entity_policy_rule_"), r["rule_index"].cast("string"))).otherwise(F.concat(F.lit("ambiguous_alias_without_context:"), F.lower(F.element_at(r["all"], 1))))
        return F.when(F.when(r["kind"] == "rule", rule).otherwise(alias), named)

    listed = rules.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "rule", 0).otherwise(1).alias("o"), "rule_index", "kind", "any", "all", "unless_any"))).alias(rules_))
    joined = chunks.join(listed, "gene_id", "left").withColumn(text_, text)
    first = F.get(F.filter(F.transform(rules_, reason), lambda x: x.isNotNull()), F.lit(0))
    return joined.withColumn("blocked_reason", first).drop(rules_, text_)


def classify_evidence(rows: DataFrame) -> DataFrame:
    """Adds signals, ``relationship_to_query``, ``evidence_level``, ``conditions`` and pairs to chunk rows.

    Rows carry gene_id, primary_name, text, blocked_reason, stable_ids, ortholog_terms, alias_matches,
    protein_family_matches and species_mentions. A blocked chunk supports nothing; else an exact id
    goes before an ortholog, that before a name (whose relation stays unknown), that before a family.
    """
    text = F.lower(squeezed(F.col("text")))
    gene, name = F.lower(squeezed(F.col("gene_id"))), F.lower(squeezed(F.col("primary_name")))
    inside = lambda words: F.exists(words, lambda t: (squeezed(t) != "") & text.contains(F.lower(squeezed(t))))
    exact = ((gene != "") & text.contains(gene)) | inside("stable_ids")
    named = ((name != "") & text.contains(name)) | (F.size("alias_matches") > 0)
    family = F.size("protein_family_matches") > 0
    ortholog = inside("ortholog_terms")
    case = lambda *values: F.when(F.col("blocked_reason").isNotNull(), values[0]).when(exact, values[1]).when(ortholog, values[2]).when(named, values[3]).when(family, values[4]).otherwise(values[5])
    return rows.withColumns(
        {
            "relationship_to_query": case("none", "same_gene", "ortholog", "unknown", "family", "none"),
            "evidence_level": case("general", "direct", "ortholog", "general", "family", "general"),
            "name_signal": named,
            "family_signal": family,
            "conditions": conditions(squeezed(F.col("text"))),
            "pairs": species_condition_pairs(squeezed(F.col("text")), F.col("species_mentions")),
        }
    )


def normalize_claims(claims: DataFrame) -> DataFrame:
    """Claims with known classes only, citations C<n> once each, and texts squeezed."""
    pick = lambda c, known, other: F.when(F.lower(squeezed(F.col(c))).isin(*known), F.lower(squeezed(F.col(c)))).otherwise(other)
    return claims.withColumns(
        {
            "claim": squeezed(F.col("claim")),
            "citations": F.array_distinct(F.filter(F.coalesce("citations", F.array().cast(_LIST)), lambda c: c.rlike(r"^C\d+$"))),
            "evidence_level": pick("evidence_level", LEVELS, "general"),
            "relationship_to_query": pick("relationship_to_query", RELATIONS, "unknown"),
            "confidence": pick("confidence", CONFIDENCE, "low"),
            "species": squeezed(F.col("species")),
            "conditions": F.filter(F.transform(F.coalesce("conditions", F.array().cast(_LIST)), squeezed), lambda c: c != ""),
        }
    )


def validate_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim with ``reasons`` (in a fixed order) and ``accepted``: whether it has none.

    Citations are joined with the gene's chunks by citation_id; unknown ones are found by the left
    join. ``evidence`` has what classify_evidence adds, with gene_id and citation_id.
    """
    n = normalize_claims(claims)
    facts = evidence.select("gene_id", "citation_id", F.struct(F.col("relationship_to_query").alias("rel"), F.col("evidence_level").alias("level"), F.col("name_signal").alias("named"), F.col("family_signal").alias("family"), F.col("blocked_reason").isNotNull().alias("blocked"), "conditions", "pairs").alias("e"))
    cited = n.select("gene_id", "claim_index", F.explode("citations").alias("citation_id")).join(facts, ["gene_id", "citation_id"], "left").groupBy("gene_id", "claim_index")
    found = cited.agg(F.collect_list("e").alias("es"), F.bool_or(F.col("e").isNull()).alias("unknown"))
    x = n.join(found, ["gene_id", "claim_index"], "left")
    none = F.filter(F.col("es"), lambda e: F.lit(False))
    x = x.withColumn("es", F.coalesce("es", none, F.expr("array()").cast(found.schema["es"].dataType)))
    rel, level = F.col("relationship_to_query"), F.col("evidence_level")
    some = lambda test: F.exists("es", test)
    supported = F.transform(F.flatten(F.transform("es", lambda e: e["conditions"])), lambda c: F.lower(c))
    in_text = [F.when(told(F.col("claim"), p) & ~F.array_contains(supported, name.lower()), F.lit(f"unsupported_condition_in_text:{name}")) for name, p in CONDITIONS.items()]
    pairs = F.flatten(F.transform("es", lambda e: e["pairs"]))
    species = F.lower(F.col("species"))

    def unpaired(c: Column) -> Column:
        match = F.exists(pairs, lambda p: (F.lower(p["condition"]) == F.lower(c)) & (F.lower(p["species"]).contains(species) | species.contains(F.lower(p["species"]))))
        return F.when((species != "") & ~match, F.concat(F.lit("unverified_species_condition_pair:"), F.col("species"), F.lit(":"), c))

    single = [
        F.when(F.col("claim") == "", "empty_claim"),
        F.when(F.size("citations") == 0, "missing_citation"),
        F.when(F.col("unknown"), "unknown_citation"),
        F.when(some(lambda e: e["blocked"]), "blocked_entity_evidence"),
        F.when((rel == "same_gene") & ~some(lambda e: e["rel"] == "same_gene"), "unverified_same_gene_attribution"),
        F.when((level == "direct") & ~some(lambda e: e["level"] == "direct"), "unverified_direct_evidence"),
        F.when(rel.isin("ortholog", "paralog") & ~some(lambda e: e["rel"] == rel), F.concat(F.lit("unverified_"), rel, F.lit("_attribution"))),
        F.when((rel == "family") & ~some(lambda e: (e["rel"] == "family") | e["family"] | e["named"]), "unverified_family_attribution"),
        F.when(rel.isin("family", "none") & told(F.col("claim"), INDIRECT), "indirect_evidence_attributed_to_query_gene"),
        F.when(level.isin("ortholog", "paralog", "family") & ~some(lambda e: e["level"] == level), F.concat(F.lit("unverified_"), level, F.lit("_evidence"))),
        F.when(rel.isin("same_gene", "unknown") & (F.size("es") > 0) & ~some(lambda e: ~e["rel"].isin("family", "none")), "family_or_context_used_as_gene_specific"),
        F.when(told(F.col("claim"), STRONG) & (level != "direct"), "unsupported_claim_strength"),
    ]
    listed = F.transform(F.filter("conditions", lambda c: ~F.array_contains(supported, F.lower(c))), lambda c: F.concat(F.lit("unsupported_condition:"), c))
    reasons = F.array_compact(F.concat(F.array(*single), listed, F.array(*in_text), F.transform("conditions", unpaired)))
    return x.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0).drop("es", "unknown")


# Fixed value: what an answer says that has no accepted claim.
ABSTENTION = "The retrieved literature is insufficient to support a gene-specific interpretation."


def gene_status(validated: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Accepted and rejected claims and the status of each gene.

    ``answers`` (gene_id, model_output_valid) list all genes asked about: those whose output was no
    valid JSON have ``invalid_model_output`` and one rejected claim, those without claims too little evidence.
    """
    counted = validated.groupBy("gene_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    if answers is None:
        return counted.withColumn("status", F.when(F.col("accepted") > 0, "supported_claims").otherwise("insufficient_evidence"))
    told = answers.select("gene_id", F.coalesce("model_output_valid", F.lit(True)).alias("_valid")).join(counted, "gene_id", "left").na.fill(0, ["accepted", "rejected"])
    status = F.when(~F.col("_valid"), "invalid_model_output").when(F.col("accepted") > 0, "supported_claims").otherwise("insufficient_evidence")
    return told.select("gene_id", F.when(F.col("_valid"), F.col("accepted")).otherwise(0).alias("accepted"), F.when(F.col("_valid"), F.col("rejected")).otherwise(1).alias("rejected"), status.alias("status"))


def render_claims(validated: DataFrame) -> DataFrame:
    """One text a gene: its accepted claims with their citations, in order; without any, the abstention."""
    one = F.concat(F.col("claim"), F.lit(" ["), F.array_join("citations", ", "), F.lit("]"))
    listed = F.sort_array(F.collect_list(F.when(F.col("accepted"), F.struct("claim_index", one.alias("t")))))
    return validated.groupBy("gene_id").agg(F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda s: s["t"]), " ")).otherwise(ABSTENTION).alias("text"))


def evidence_text(chunks: DataFrame) -> DataFrame:
    """(gene_id, retrieved_evidence): citation, source, section and text of a gene's chunks, in order of hit_rank."""
    one = F.concat(F.lit("["), F.coalesce("citation_id", F.lit("")), F.lit("] "), F.coalesce("source", F.lit("")), F.lit(" \u2014 "), F.coalesce("section", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return chunks.groupBy("gene_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hit_rank", "citation_id", one.alias("t")))), lambda s: s["t"]), "\n\n").alias("retrieved_evidence"))


def claim_sheet(answers: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(gene_id, claim_id, claim_index, claim, refs, ...): one row a claim, with the chunks it cites.

    ``answers`` has gene_id and ``answer``; where a column ``claims`` (array of structs with claim,
    citations, evidence_level, relationship_to_query, species, conditions, confidence) has elements,
    these are the claims. Else the answer's sentences are, without the abstention. ``chunks`` add
    their texts as ``retrieved_evidence``.
    """
    parts = F.filter(C.split_claims(F.col("answer")), lambda c: c != ABSTENTION)
    names = ("evidence_level", "relationship_to_query", "species", "confidence")
    none = F.lit("")
    free = F.transform(parts, lambda c: F.struct(F.trim(c).alias("claim"), F.array_join(C.citation_refs(c), ";").alias("refs"), none.alias("conditions"), *(none.alias(n) for n in names)))
    if "claims" in answers.columns:
        told = lambda x, n: F.coalesce(x[n], none).alias(n)
        listed = F.transform("claims", lambda x: F.struct(F.trim(F.coalesce(x["claim"], none)).alias("claim"), F.array_join(F.coalesce(x["citations"], F.array().cast(_LIST)), ";").alias("refs"), F.array_join(F.coalesce(x["conditions"], F.array().cast(_LIST)), ";").alias("conditions"), *(told(x, n) for n in names)))
        free = F.when(F.size(F.coalesce("claims", F.array())) > 0, listed).otherwise(free)
    rows = answers.select("gene_id", F.posexplode(free).alias("_at", "c")).select("gene_id", (F.col("_at") + 1).alias("claim_index"), "c.*")
    rows = rows.withColumn("claim_id", C.stable_id(F.col("gene_id").cast("string"), F.col("claim_index").cast("string"), F.col("claim")))
    return rows if chunks is None else rows.join(evidence_text(chunks), "gene_id", "left").withColumn("retrieved_evidence", F.coalesce("retrieved_evidence", none))
