"""One query per operator, as the driver registers them, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language_id, mixing, neardup, pseudo_likelihood, quality_gam, quality_rules, secrets, sharding, toxicity
from .common import documents, table


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir)).drop("copies", "source")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(documents(spark, sf_dir)).drop("lang", "source")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_ids(documents(spark, sf_dir))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.lm_scores(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_near_dedup, op3_decontaminate, op4_mix_sources, op5_shard, op6_quality_rules, op7_secret_scan, op8_quality_classifier, op9_language_id, op10_lm_score)}


#: SQL for the word pattern's runs; a null text has none.
N_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

#: Words between blanks with A-Z as lower case.
FOLDED_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP2_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {FOLDED_WORDS} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, len(w) >= 3 AS long, md5(array_to_string(list_slice(w, p, p + 2), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.long = b.long AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""

OP4_SQL = f"""
WITH d AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM (SELECT doc_id, source, {N_WORDS} AS size FROM documents)
), v AS (
  SELECT *, (('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || CASE WHEN copy > 0 THEN ':' || CAST(copy AS VARCHAR) ELSE '' END), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows FROM d GROUP BY source
), w AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0, 1.0], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)) AS weight,
         3.0::DOUBLE * source_size AS full_size
  FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY full_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), one AS (
  SELECT *, arg_min(CASE WHEN level * weight < full_size THEN level END, full_size / weight) FILTER (WHERE level * weight < full_size) OVER () AS found FROM l
), t AS (
  SELECT source, source_size, n_rows, CASE WHEN found IS NULL THEN full_size ELSE least(full_size, found * weight) END AS target FROM one
), p AS (
  SELECT *, coalesce(target / nullif(source_size, 0), 0.0) AS share FROM t
), r AS (
  SELECT v.doc_id, v.copy, v.size, v.u, p.source, p.source_size, p.n_rows, p.target, floor(p.share) AS whole, p.share - floor(p.share) AS part,
         v.size * CAST(p.n_rows AS DOUBLE) / nullif(CAST(p.source_size AS DOUBLE), 0) + 1.0 AS weight
  FROM v JOIN p ON v.source IS NOT DISTINCT FROM p.source
), z AS (
  SELECT source, size, count(*) AS c, any_value(n_rows) AS n_rows, any_value(source_size) AS source_size, any_value(part * source_size) AS missing, any_value(weight) AS weight
  FROM r WHERE part > 0 AND size > 0 GROUP BY source, size
), k AS (
  SELECT source, size, weight, coalesce(sum(size * c) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, missing,
         CAST(sum(CAST(size AS HUGEINT) * size * c) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) * CAST(n_rows AS DOUBLE) / CAST(source_size AS DOUBLE)
         + CAST(sum(size * c) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest
  FROM z
), m AS (
  SELECT source, arg_max((missing - above) / rest, size) AS k, arg_max(above, size) AS above, max(size) AS largest FROM k WHERE (missing - above) / rest * weight < 1 GROUP BY source
), q AS (
  SELECT r.*, m.largest, r.part * r.source_size - coalesce(m.above, 0) AS missing, (r.part > 0 AND r.size > 0 AND r.size <= m.largest) AS drawn,
         CASE WHEN r.part > 0 AND r.size > 0 AND r.size <= m.largest THEN (u / (1 - u)) / (m.k * r.weight / (1 - m.k * r.weight)) END AS odds
  FROM r LEFT JOIN m ON r.source IS NOT DISTINCT FROM m.source
), c AS (
  SELECT *, sum(CASE WHEN drawn THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id NULLS FIRST, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN part > 0 AND size > largest OR drawn AND upto - size / 2.0 <= missing THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


#: Words of ASCII digits, letters as lower case, and anything beyond ASCII, of a table's texts.
ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), iw AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM i WHERE len(w) > 0)
), d AS (
  SELECT doc_id, {ALNUM_WORDS} AS w FROM documents
), dw AS (
  SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)
), m AS (
  SELECT dw.doc_id, dw.p, dw.k, iw.item FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win
), h AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM m) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op3_decontaminate": OP3_SQL, "op4_mix_sources": OP4_SQL}
