"""Queries over ``documents`` and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import byte_bpe, fill_middle, frames, jaccard_join, language_id, mixing, pii_feistel, quality, secret_scan
from tidepanel.llm.line_dedup import drop_frequent_lines


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", frames.sha256_hex("text").alias("kept_sha256"))


OP4_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT keyed.*, frequent.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = frames.staged(mixing.sized(docs).select("row.doc_id", "source", "size", "hash"), "mix-rows")
    out = mixing.decide(rows, mixing.plan(rows))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH doc AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    ('0x' || md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, ''))[1:15])::BIGINT AS h FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM doc GROUP BY source
), weighted AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS most FROM src
), full_first AS (
  SELECT *, most / w AS fill, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w,
    coalesce(sum(most) OVER (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    coalesce(sum(w) OVER (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM weighted
), level AS (
  SELECT arg_min((total - spent) / (all_w - closed), closed) FILTER (WHERE fill >= (total - spent) / (all_w - closed)) AS level FROM full_first
), target AS (
  SELECT source, source_size, least(most, w * level) AS target FROM weighted, level
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM target
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN run <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT doc.*, p.source_size, p.target, p.whole, sum(size) OVER (PARTITION BY doc.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS run
      FROM doc JOIN planned p ON doc.source IS NOT DISTINCT FROM p.source)
"""

def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    counted = quality.rule_counts(docs).drop("text").withColumn("base_failed", quality.base_failed())
    return quality.with_verdicts(frames.staged(counted, "quality-counts")).drop("source", "host_rate")


OP10_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, w[i:i + 4] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM doc WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n >= 2
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r
), line AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM doc)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), counted AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(line.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM doc LEFT JOIN line USING (r) LEFT JOIN repeated USING (r)
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
), host AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS bad FROM failed GROUP BY source
), moment AS (
  SELECT m, v - m * (1 - m) * e AS beyond FROM (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v, avg(1 / n) AS e FROM host)
), prior AS (
  SELECT m, CASE WHEN beyond > 0 THEN least(greatest(m * (1 - m) / beyond - 1, 1.0::DOUBLE), 1e6::DOUBLE) ELSE 1e6::DOUBLE END AS s FROM moment
), verdict AS (
  SELECT source, r - 2.0::DOUBLE * sqrt(r * (1 - r) / (n + s + 1)) <= least(0.5::DOUBLE, 2.0::DOUBLE * m) AS good
  FROM (SELECT source, n, m, s, (bad + m * s) / (n + s) AS r FROM host, prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept
FROM failed JOIN verdict ON failed.source IS NOT DISTINCT FROM verdict.source
"""

def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    model = language_id.learned(docs.select("doc_id", "text", "lang"))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (F.coalesce(language_id.fold(F.col("doc_id")), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")


def op2_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_feistel.pseudonymised(docs, key="catalogue key, not a secret")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.transcode(docs, path)
    digest = F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(frames.table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8, n=5)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.learn(docs)).select("doc_id", "secrets")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "format")
    likelihood = F.array_max(F.transform("secrets", lambda s: s["score"])).alias("best_likelihood")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), likelihood)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transformed(frames.table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = F.sha2(F.encode(fill_middle.restored(F.col("form"), F.col("output")), "UTF-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", frames.sha256_hex("output").alias("output_sha256"), back.alias("restored_sha256"))


OP12_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hash FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || hash[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || hash[9:16])::BIGINT % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || hash[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || hash[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM doc
), cut AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(units[greatest(a, b) + 1:n], '') AS suffix FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""

QUERIES = {
    "op2_pii_feistel": op2_pii_feistel,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_source_mix": op5_source_mix,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_secret_scan": op7_secret_scan,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op12_fill_middle": op12_fill_middle,
}
ORACLE_SQL = {"op4_line_dedup": OP4_SQL, "op5_source_mix": OP5_SQL, "op10_quality_rules": OP10_SQL, "op12_fill_middle": OP12_SQL}
