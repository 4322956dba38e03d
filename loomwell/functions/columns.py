"""Scalar functions as Column expressions: names, annotations, text, terms. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that results depend on.
ABSENT = ("", "nan", "none")
NAME_STOP = "probable putative protein proteins family domain containing chloroplastic mitochondrial uncharacterized like isoform subunit large chain class".split()
CONTEXT_STOP = NAME_STOP + "process activity binding response regulation positive negative cellular component located central cluster theme".split()
TERM = r"[A-Za-z0-9][A-Za-z0-9_.+-]*"
BM25_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_.-]*"
LOW_VALUE_SECTION = (
    r"^(?:\d+(?:\.\d+)*\s*)?(?:(?:references?|bibliography|literature\s+cited|parsed\s+citations?|acknowledg(?:e)?ments?|funding"
    r"|author\s+contributions?|data\s+availability|supplement(?:ary)?(?:\s+(?:material|materials|information))?|supporting\s+information"
    r"|abbreviations?|keywords?|accession\s+numbers?|tables?|figures?|materials?\s+(?:and|&)\s+methods?|methods?|star\+methods)\b"
    r"|(?:supplementary\s+)?(?:fig(?:ure)?\.?|table)\s*\d*)"
)
REFERENCE_MARKERS = ("google scholar", "pubmed:", "refhub.elsevier.com", "doi.org/")
PLANT_LINEAGE = "viridiplantae streptophyta embryophyta tracheophyta euphyllophyta spermatophyta magnoliopsida mesangiospermae eudicotyledons monocots liliopsida chlorophyta chloroplast plantae plant".split()
PLANT_ORGANISM = (
    "arabidopsis,oryza,zea,glycine,solanum,vitis,coffea,brassica,gossypium,triticum,hordeum,sorghum,setaria,brachypodium,populus,eucalyptus,"
    "cucumis,cucurbita,cicer,phaseolus,pisum,medicago,lotus,lupinus,fragaria,malus,prunus,pyrus,citrus,theobroma,camellia,spinacia,"
    "beta vulgaris,spinach,lettuce,lettuca,plant,plantae"
).split(",")
STATUS_NAMES = {
    "pending": "PENDING", "na fila": "PENDING",
    "in progress": "RUNNING", "running": "RUNNING", "aligning": "RUNNING", "counting": "RUNNING",
    "completed": "COMPLETED", "done": "COMPLETED", "clustered": "COMPLETED", "interpreted": "COMPLETED",
    "failed": "FAILED", "erro": "FAILED", "error": "FAILED",
    "canceled": "CANCELED", "cancelled": "CANCELED",
}


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def usable(c: Column) -> Column:
    """Trimmed text; null, empty, ``nan`` and ``none`` are the empty text."""
    t = F.trim(_text(c))
    return F.when(F.lower(t).isin(*ABSENT), "").otherwise(t)


def parse_number(c: Column) -> Column:
    """A number written with decimal comma or point, spaces and quotes around it; else null."""
    t = F.regexp_replace(F.trim(_text(c)), "^'+|'+$", "")
    return F.regexp_replace(t, ",", ".").try_cast("double")


def clean_text(c: Column) -> Column:
    """Without empty span elements, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_text(c), r"<span[^>]*>\s*</span>", " "), r"\s+", " "))


def strip_markdown(c: Column) -> Column:
    """Without heading, list and emphasis marks and backticks, white space squeezed."""
    t = _text(c)
    for pattern, new in ((r"(?m)^#{1,6}\s*", ""), (r"(?m)^\s*[-*]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"), ("`([^`]+)`", "$1"), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, new)
    return F.trim(t)


def normalize_section(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_text(c), r"[*_`#>\[\]()]|<[^>]+>", " "), r"\s+", " ")))


def is_low_value_section(section: Column) -> Column:
    return normalize_section(section).rlike(LOW_VALUE_SECTION)


def is_table_like(text: Column) -> Column:
    """Twelve pipes, or six and eight line-break tags."""
    t = F.lower(_text(text))
    pipes, breaks = F.regexp_count(t, F.lit(r"\|")), F.regexp_count(t, F.lit("<br"))
    return (pipes >= 12) | ((pipes >= 6) & (breaks >= 8))


def low_value_reason(section: Column, text: Column) -> Column:
    """Why a chunk isn't worth keeping (section, table, reference list: in this order), or null."""
    t = F.lower(F.trim(_text(text)))
    starts = t.startswith("references ") | t.startswith("**references")
    marks = F.lit(False)
    for m in REFERENCE_MARKERS:
        marks = marks | t.contains(m)
    return F.when(is_low_value_section(section), "low_value_section").when(is_table_like(text), "table_like_text").when(starts | marks, "reference_like_text")


def normalize_id(c: Column) -> Column:
    """An identifier without leading ``letters-`` part and punctuation, in upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(_text(c)), "^[A-Za-z]+[-_:]", ""), "[^A-Za-z0-9]", ""))


def gff_attributes(c: Column) -> Column:
    """Attributes of GFF (key=value) and GTF (key "value") lines, in order, repeats kept."""
    parts = F.filter(F.transform(F.split(_text(c), ";"), lambda t: F.trim(t)), lambda p: p != "")

    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        gff = F.struct(F.trim(F.substring(p, F.lit(1), at - 1)).alias("key"), F.trim(F.trim(F.substring(p, at + 1, F.length(p))), F.lit("\"")).alias("value"))
        key = F.regexp_extract(p, r"^(\S+)\s", 1)
        quoted = F.struct(key.alias("key"), F.trim(F.regexp_extract(p, r'^\S+\s+"([^"]+)"', 1)).alias("value"))
        plain = F.struct(key.alias("key"), F.trim(F.regexp_extract(p, r"^\S+\s+(\S+)", 1), F.lit("\"")).alias("value"))
        return F.when(at > 0, gff).when(p.rlike(r'^\S+\s+"[^"]+"'), quoted).otherwise(plain)

    return F.filter(F.transform(parts, pair), lambda a: a["key"] != "")


def gff_map(attrs: Column) -> Column:
    """Parsed attributes as a map; of a repeated key the last value counts."""
    last = F.filter(attrs, lambda a, i: ~F.exists(F.slice(attrs, i + 2, F.size(attrs)), lambda b: b["key"] == a["key"]))
    return F.map_from_entries(last)


def attribute(attrs: Column, *keys: str) -> Column:
    """The last value of the first of the keys that has one; the empty text if none has."""
    found = [F.nullif(F.coalesce(F.element_at(_of(attrs, k), -1)["value"], F.lit("")), F.lit("")) for k in keys]
    return F.coalesce(*found, F.lit(""))


def _of(attrs: Column, key: str) -> Column:
    found = F.filter(attrs, lambda a: a["key"] == key)
    return F.when(F.size(found) > 0, found)


def go_ids(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(r"GO:\d+"), F.lit(0))


def go_count(c: Column) -> Column:
    return F.regexp_count(_text(c), F.lit(r"GO:\d+"))


def go_labels(c: Column) -> Column:
    """Labels of ``label [GO:n]; ...``, without ids, each once, in order."""
    labels = F.transform(F.split(_text(c), ";"), lambda t: F.trim(F.regexp_replace(t, r"\s*\[GO:\d+\]\s*", "")))
    return F.array_distinct(F.filter(labels, lambda t: t != ""))


def drop_go_segments(c: Column, invalid: Column) -> Column:
    """Annotation text without the segments that hold an id of the array ``invalid``."""
    parts = F.filter(F.transform(F.split(_text(c), ";"), lambda t: F.trim(t)), lambda t: t != "")
    return F.array_join(F.filter(parts, lambda t: ~F.arrays_overlap(F.regexp_extract_all(t, F.lit(r"GO:\d+"), F.lit(0)), invalid)), "; ")


def primary_name(c: Column) -> Column:
    """What stands before the first parenthesis or bracket."""
    return F.trim(F.regexp_replace(usable(c), r"(?s)\s*[\(\[].*$", ""))


def terms(c: Column, stop: list[str], least: int) -> Column:
    """Terms of a text in lower case, then the parts of hyphenated ones; long enough, not in stop, once each."""
    words = F.regexp_extract_all(F.lower(_text(c)), F.lit(TERM), F.lit(0))
    banned = F.array(*map(F.lit, stop))

    def fits(t: Column) -> Column:
        return (F.length(t) >= least) & ~F.array_contains(banned, t)

    kept = F.filter(words, fits)
    return F.array_distinct(F.flatten(F.transform(kept, lambda t: F.when(t.contains("-"), F.concat(F.array(t), F.filter(F.split(t, "-"), fits))).otherwise(F.array(t)))))


def name_terms(c: Column) -> Column:
    return terms(c, NAME_STOP, 3)


def context_terms(c: Column) -> Column:
    return terms(c, CONTEXT_STOP, 5)


def normalized_phrase(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(usable(c)), F.lit(TERM), F.lit(0)), " ")


def matched_terms(text: Column, wanted: Column) -> Column:
    """Those of an array of terms that the text, as its terms joined, contains."""
    joined = F.array_join(F.regexp_extract_all(F.lower(_text(text)), F.lit(TERM), F.lit(0)), " ")
    return F.filter(wanted, lambda t: joined.contains(t))


def phrase_matches(text: Column, phrases: Column) -> Column:
    """Those phrases whose normal form the text's normal form contains."""
    joined = normalized_phrase(text)
    return F.filter(phrases, lambda p: (normalized_phrase(p) != "") & joined.contains(normalized_phrase(p)))


def bm25_tokens(c: Column) -> Column:
    """Tokens of two letters or more, each followed by its hyphenated parts; repeats kept."""
    found = F.filter(F.regexp_extract_all(F.lower(_text(c)), F.lit(BM25_TOKEN), F.lit(0)), lambda t: F.length(t) >= 2)
    return F.flatten(F.transform(found, lambda t: F.when(t.contains("-"), F.concat(F.array(t), F.filter(F.split(t, "-"), lambda p: F.length(p) >= 2))).otherwise(F.array(t))))


def split_sentences(c: Column) -> Column:
    return F.filter(F.split(F.trim(_text(c)), r"(?<=[.!?])\s+"), lambda s: s != "")


def split_claims(c: Column) -> Column:
    """Sentences that end with a point, exclamation or question mark and are followed by a capital."""
    return F.filter(F.transform(F.split(F.trim(_text(c)), r"(?<=[.!?])\s+(?=[A-Z])"), lambda t: F.trim(t)), lambda s: s != "")


def citation_refs(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.array_join(F.regexp_extract_all(_text(c), F.lit(r"\[[^\]]*\]"), F.lit(0)), " "), F.lit(r"\bC\d+\b"), F.lit(0)))


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts).cast("binary"), 256), 1, 16)


def is_plant(lineage: Column, organism: Column) -> Column:
    """By the lineage; by the organism only where there is no lineage."""
    line, name = _text(lineage), F.lower(_text(organism))
    by_line = F.lower(line).rlike("|".join(PLANT_LINEAGE))
    return F.when(line != "", by_line).otherwise(name.rlike("|".join(PLANT_ORGANISM)))


def neg_log10(c: Column) -> Column:
    return -F.log10(F.greatest(c, F.lit(1e-300)))


def normalize_status(c: Column) -> Column:
    """A job's status by its usual name; null is PENDING, unknown ones stay in upper case."""
    names = F.create_map(*[F.lit(x) for kv in STATUS_NAMES.items() for x in kv])
    return F.when(c.isNull(), "PENDING").otherwise(F.coalesce(F.element_at(names, F.lower(F.trim(c))), F.upper(c)))
