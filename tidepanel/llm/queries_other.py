"""Queries over ``embeddings`` and ``pages`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import frames, hard_negatives, html_extract, topk_search, url_filter


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(frames.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return topk_search.top_k(vectors.filter("id % 100 = 0"), vectors, k=10)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pair
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = frames.table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = topk_search.quantised(frames.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), 256, more={"label": label})
    return hard_negatives.mine(rows, rows.filter("id % 50 = 0"), positives=5, negatives=3, low=50, high=95)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS positive_rank FROM pair WHERE same) WHERE positive_rank <= 5
), mined AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score, p.positive_rank::INTEGER AS positive_rank,
    row_number() OVER (PARTITION BY p.r, p.positive_rank ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM positive p JOIN pair n ON p.r = n.r AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT * FROM mined WHERE rank <= 3
"""


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = frames.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.learn(pages)).select("page_id", "url", "text", "n_chars")


QUERIES = {"op1_topk_search": op1_topk_search, "op8_url_filter": op8_url_filter, "op11_hard_negatives": op11_hard_negatives, "op13_html_extract": op13_html_extract}
ORACLE_SQL = {"op1_topk_search": OP1_SQL, "op11_hard_negatives": OP11_SQL}
