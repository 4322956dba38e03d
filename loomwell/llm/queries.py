"""The queries of the subpackage's operators, one opN_<name> each, and their SQL where SQL can say it.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomwell.llm import ann, bpe, fingerprints, jaccard_join, langid, licenses, mixing, secrets, sharding, spelling, suffix_dedup, token_files, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_edits(_documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "n_chars")
    return sharding.place(docs.withColumn("slot", sharding.slot_of(docs["doc_id"])), "doc_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(_documents(spark, sf_dir))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_mixing": op3_mixing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_sharding": op5_sharding,
    "op6_secrets": op6_secrets,
    "op7_licenses": op7_licenses,
    "op8_token_files": op8_token_files,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_language_id": op10_language_id,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_suffix_dedup": op13_suffix_dedup,
}

_MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))) AS hash
  FROM documents),
digits AS (SELECT CASE WHEN count(*) <= 2000 THEN 0 WHEN count(*) <= 32000 THEN 1 WHEN count(*) <= 512000 THEN 2 ELSE 3 END AS p FROM documents),
placed AS (SELECT sized.*, substr(hash, 1, p) AS shard FROM sized, digits),
stream0 AS (SELECT shard, key, source, sum(size)::BIGINT AS words FROM placed GROUP BY ALL),
source0 AS (SELECT key, source, sum(words)::BIGINT AS source_size FROM stream0 GROUP BY ALL),
source1 AS (SELECT *, 2 * source_size AS cap, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM source0),
source2 AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT
      - coalesce((sum(cap) OVER (ORDER BY cap::DOUBLE / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM source1),
source3 AS (SELECT *, least(cap::DOUBLE, coalesce(max(CASE WHEN level <= cap::DOUBLE / weight THEN level END) OVER () * weight, cap::DOUBLE)) AS target,
    greatest(1, least(64, coalesce(min(CASE WHEN source_size > 0 THEN source_size END) OVER () // 64, 1))) AS length0 FROM source2),
stream1 AS (SELECT s.shard, s.key, s.words, t.source_size, t.target,
    greatest(1, ceil(s.words::DOUBLE / greatest(1, floor(s.words::DOUBLE / t.length0 + 0.5))))::BIGINT AS length FROM stream0 s JOIN source3 t USING (key)),
stream2 AS (SELECT *, ceil(words::DOUBLE / length)::BIGINT AS blocks FROM stream1),
total0 AS (SELECT key, sum(blocks)::BIGINT AS n, first(target) AS t, first(source_size) AS s FROM stream2 GROUP BY key),
total1 AS (SELECT *, CASE WHEN s > 0 THEN floor(t / s * n * 1024) ELSE 0 END::BIGINT AS population FROM total0),
total2 AS (SELECT *, floor(((sum(population) OVER ())::BIGINT + 512)::DOUBLE / 1024)::BIGINT AS seats FROM total1),
quotient AS (SELECT key, k, population::DOUBLE / (2 * k + 1) AS q, seats FROM total2, LATERAL unnest(range(0, 2 * n + 2)) AS u(k) WHERE population > 0),
won AS (SELECT key, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY q DESC, key, k) AS r FROM quotient) WHERE r <= seats GROUP BY key),
dealt0 AS (SELECT stream2.*, coalesce(won.quota, 0) AS quota FROM stream2 LEFT JOIN won USING (key)),
dealt1 AS (SELECT key, shard, k, quota, blocks::DOUBLE / (2 * k + 1) AS q FROM dealt0, LATERAL unnest(range(0, 3 * blocks + 3)) AS u(k) WHERE blocks > 0),
dealt2 AS (SELECT key, shard, count(*) AS got FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY q DESC, shard, k) AS r FROM dealt1) WHERE r <= quota GROUP BY ALL),
stream3 AS (SELECT d.*, least(coalesce(got, 0), 2 * blocks) AS full_, greatest(blocks, 1) AS nb FROM dealt0 d LEFT JOIN dealt2 USING (key, shard)),
stream4 AS (SELECT shard, key, source_size, target, length, nb, full_ // nb AS base, full_ % nb AS more,
    ('0x' || substr(md5('mix-1/' || shard || '/' || key), 1, 12))::BIGINT % nb AS shift FROM stream3),
doc AS (SELECT *, (sum(size) OVER (PARTITION BY shard, key ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS e FROM placed),
cut AS (SELECT doc_id, size, source_size, target, base, length, more, shift, nb, e, e - size AS b FROM doc JOIN stream4 USING (shard, key))
SELECT doc_id, size, source_size, target, (base * size
  + ((e // length) * more + shift) // nb * length + (((e // length + 1) * more + shift) // nb - ((e // length) * more + shift) // nb) * (e % length)
  - ((b // length) * more + shift) // nb * length - (((b // length + 1) * more + shift) // nb - ((b // length) * more + shift) // nb) * (b % length))::BIGINT AS taken
FROM cut
"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.r AS ra, a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.r < b.r
  GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON s.doc_id = m.a
"""

_SHARDING_SQL = """
WITH slots AS (SELECT unnest(range(0, {slots}))::INT AS slot, unnest(string_split('{owners}', ','))::INT AS owner)
SELECT doc_id, source, n_chars, d.slot, 'shard-' || lpad(owner::VARCHAR, 3, '0') AS shard
FROM (SELECT *, (('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN 'null' ELSE '=' || doc_id::VARCHAR END), 1, 12))::BIGINT % {slots})::INT AS slot FROM documents) d
JOIN slots USING (slot)
"""


_SCANNED = {k: (secrets.LONG.get(k, p), g, n) for k, (p, g, n) in secrets.KINDS.items()} | {"generic": (secrets.GENERIC, 0, 20)}


def _matches(name: str) -> str:
    """SQL for the lists of gap and match together, match, and value of one kind in t."""
    pattern, group, _ = _SCANNED[name]
    p = f"'(?s)(.*?)({pattern.replace(chr(39), chr(39) * 2)})'"
    return ", ".join(f"regexp_extract_all(t, {p}, {n}) AS {name}_{c}" for n, c in ((0, "w"), (2, "m"), (2 + group, "v")))


def _places(name: str) -> str:
    """SQL for one kind's spans: a list of (start, kind, end, value)."""
    end = f"list_sum(list_transform({name}_w[1:i], lambda x: length(x)))::INT"
    return f"""list_filter(list_transform(range(1, len({name}_w) + 1), lambda i: {{'start': {end} - length({name}_m[i])::INT,
      'kind': {list(_SCANNED).index(name)}, 'end': {end}, 'value': {name}_v[i]}}), lambda s: length(s.value) >= {_SCANNED[name][2]})"""


def _secrets_sql() -> str:
    written = "array_to_string(list_transform({0}, lambda x: ['assign', 'access', 'hex', 'generic'][x.kind + 1] || ':' || x.start || ':' || x['end']), ',')"
    return f"""
WITH t0 AS (SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, source, r, {", ".join(map(_matches, _SCANNED))} FROM t0),
b AS (SELECT doc_id, source, r, list_sort({" || ".join(map(_places, secrets.KINDS))}) AS base, {_places("generic")} AS g FROM a),
c AS (SELECT * EXCLUDE g, list_filter(g, lambda x: regexp_matches(x.value, '[0-9]') AND regexp_matches(x.value, '[A-Za-z]')
  AND len(list_filter(base, lambda y: y.start < x['end'] AND x.start < y['end'])) = 0) AS extra FROM b),
spread AS (SELECT r, doc_id, source, unnest(base || extra) AS u FROM c),
candidate AS (SELECT DISTINCT r, doc_id, source, u.value AS v FROM spread),
owned AS (SELECT v, count(DISTINCT coalesce('=' || source, '-')) AS owners, count(DISTINCT coalesce('=' || source, '-') || chr(1) || coalesce(doc_id::VARCHAR, '-')) AS repositories FROM candidate GROUP BY v),
told AS (SELECT r, map_from_entries(list((v, {{'o': owners, 'n': repositories}}))) AS vs FROM candidate JOIN owned USING (v) GROUP BY r),
d0 AS (SELECT c.*, vs, list_filter(extra, lambda x: vs[x.value].o <= {secrets.FEW_OWNERS} AND vs[x.value].n <= {secrets.FEW_REPOSITORIES}) AS added FROM c LEFT JOIN told USING (r)),
d AS (SELECT *, list_sort(base || coalesce(added, [])) AS found FROM d0)
SELECT doc_id, len(list_filter(base, lambda x: x.kind = 0))::BIGINT AS n_assign, len(list_filter(base, lambda x: x.kind = 1))::BIGINT AS n_access,
  len(list_filter(base, lambda x: x.kind = 2))::BIGINT AS n_hex, sha256({written.format("base")}) AS base_sha256, {written.format("found")} AS spans,
  array_to_string(list_transform(found, lambda x: vs[x.value].o || '/' || vs[x.value].n), ',') AS ownership,
  len(list_filter(found, lambda x: vs[x.value].o <= {secrets.FEW_OWNERS} AND vs[x.value].n <= {secrets.FEW_REPOSITORIES}))::BIGINT AS n_live,
  len(list_filter(found, lambda x: NOT (vs[x.value].o <= {secrets.FEW_OWNERS} AND vs[x.value].n <= {secrets.FEW_REPOSITORIES})))::BIGINT AS n_example
FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": _MIXING_SQL,
        "op4_ngram_jaccard": _JACCARD_SQL,
        "op5_sharding": _SHARDING_SQL.format(slots=sharding.SLOTS, owners=",".join(map(str, sharding.lookup_table()))),
        "op6_secrets": _secrets_sql(),
    }
