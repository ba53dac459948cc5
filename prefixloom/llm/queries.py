"""The registered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_templates, language_id, license_scan, mixing, pii, quality_classifier, quality_rules, simhash, token_count
from .common import read


#: The counted vocabulary; a path, never a copy.
TOKEN_MODEL = "piece_bpe_32k.model"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    weights = quality_classifier.fit(docs, labels.where(language_id.remainder(F.col("doc_id"), 3) != 1))
    held = F.coalesce(language_id.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return quality_classifier.scored(docs.withColumn("held_out", held), weights).select("doc_id", "held_out", "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    rest = language_id.remainder(F.col("doc_id"), 4)
    model = language_id.fit(docs.where(rest != 2))
    out = language_id.predicted(docs.drop("lang").withColumn("held_out", F.coalesce(rest == 2, F.lit(False))), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return quality_rules.judge(docs).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_templates.extracted(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.searched(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.counted(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(TOKEN_MODEL))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")
    out = decontaminate.contamination(docs, items)
    ids = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_host_rules": op4_host_rules,
    "op5_main_text": op5_main_text,
    "op6_personal_data": op6_personal_data,
    "op7_licenses": op7_licenses,
    "op8_token_count": op8_token_count,
    "op9_mix_sources": op9_mix_sources,
    "op10_decontaminate": op10_decontaminate,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op4_host_rules"] = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), r AS (SELECT *, row_number() OVER () AS rid FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS gram FROM r, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS u(k) GROUP BY rid),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM r LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2,
         n_symbols > 0.5 * word_chars AS f3, n_dup_lines > 0.5 * n_lines AS f4
  FROM m
), s AS (
  SELECT source, count(*)::DOUBLE AS n, sum(f1::INT)::DOUBLE AS a1, sum(f2::INT)::DOUBLE AS a2, sum(f3::INT)::DOUBLE AS a3, sum(f4::INT)::DOUBLE AS a4
  FROM f GROUP BY source
), long AS (
  SELECT source, n, a, a / n AS p, k FROM (
    SELECT source, n, unnest([a1, a2, a3, a4]) AS a, unnest([1, 2, 3, 4]) AS k FROM s)
), prior AS (SELECT k, avg(n) AS size, avg(p) AS m, var_pop(p) AS v FROM long GROUP BY k),
shrunk AS (
  SELECT source, (a + wgt * m) / (n + wgt) AS rate FROM (
    SELECT source, a, n, m, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 0) ELSE size END AS wgt
    FROM long JOIN prior USING (k))
), host AS (SELECT source, max(rate) <= 0.6 AS host_ok FROM shrunk GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 OR f2) AS base_failed, (NOT (f1 OR f2)) AND host_ok AS kept
FROM f JOIN host ON f.source IS NOT DISTINCT FROM host.source
"""

ORACLE_SQL["op9_mix_sources"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source
), rounds AS (
  SELECT 0 AS i, source, source_size, w, (3 * source_size = 0) AS capped FROM s
  UNION ALL
  SELECT i + 1, source, source_size, w,
         capped OR w * (sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ())
                   >= 3 * source_size * sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()
  FROM rounds WHERE i < 40
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (3 * source_size)::DOUBLE
              ELSE ((sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ()) * w)::DOUBLE
                   / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE END AS target
  FROM rounds WHERE i = 40
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS due,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN due // source_size ELSE 0 END AS epochs FROM o)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, due - epochs * source_size - ahead)))::BIGINT AS taken
FROM e
"""

_ITEM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op10_decontaminate"] = rf"""
WITH b AS (SELECT item_id, {_ITEM} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS u(i) WHERE len(w) > 0
), d AS (SELECT row_number() OVER () AS rid, doc_id, {_ITEM} AS w FROM documents),
k AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM d, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS u(i)
), hit AS (SELECT rid, i, k, item_id FROM dw JOIN bw USING (k, win)),
words AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, k)) AS u(j) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hit) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
