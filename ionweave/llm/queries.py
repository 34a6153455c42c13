"""Thin queries opN_<name> over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, toxicity
from .common import documents
from .decontaminate import contaminated
from .exact_dedup import exact_duplicates
from .line_dedup import dedup_lines
from .packing import pack
from .secret_scan import BASE_RULES, RULES, joined, scan
from .sharding import assign_shards
from .simhash import near_duplicates
from .substring_dedup import repeated_passages


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir))
    count = lambda at: F.size(F.filter("found", lambda s: s["kind_at"] == at)).cast("long")
    counts = [count(at).alias(f"n_{r.kind}") for at, r in enumerate(BASE_RULES)]
    base = F.sha2(joined(F.col("found"), len(BASE_RULES)).cast("binary"), 256)
    return out.select("doc_id", *counts, base.alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.fit(docs))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(documents(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s[0], s[1])), ",")
    return out.select("doc_id", "class_id", "links", F.round("similarity", 6).alias("similarity"), "n_words", spans.alias("spans"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_secret_scan, op4_language_id, op5_line_dedup, op6_substring_dedup, op7_simhash, op8_decontaminate, op9_packing, op10_sharding)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _spans_sql(at: int, rule) -> str:
    """Spans of a rule from the pieces between its matches, as SQL."""
    quoted = "'" + rule.pattern.replace("'", "''") + "'"
    size = f"length(regexp_extract(m[i], {quoted}, {rule.group})) >= {rule.least}" if rule.least else "true"
    return f"""
SELECT row, {at} AS k, p[i] AS s, p[i] + length(m[i]) AS e FROM (
  SELECT row, m, i, list_transform(range(1, len(m) + 1), lambda j: list_sum(list_transform(a[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0))::BIGINT[] AS p
  FROM (SELECT row, m, a, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT row, regexp_extract_all(t, {quoted}) AS m, regexp_split_to_array(t, {quoted}) AS a FROM d WHERE regexp_matches(t, {quoted})))) WHERE {size}"""


_KIND = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "][k + 1]"

ORACLES = {
    "op3_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
     f AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(RULES))}),
     g AS (SELECT row, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2,
                  string_agg({_KIND} || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (WHERE k < {len(BASE_RULES)}) AS base,
                  string_agg({_KIND} || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM f GROUP BY row)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.row = g.row""",
    "op1_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""",
    "op5_line_dedup": f"""
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
     k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM l),
     f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     m AS (SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AND k.doc_id < f.top AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
