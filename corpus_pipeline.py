"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing and tokenisation of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All
but the last return the columns of ``documents``; n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import byte_bpe, frames, jaccard_join, language_id, line_dedup, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the predicted language; texts without one (null, or no letter) go."""
    found = language_id.identify(docs, language_id.learned(docs))
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays."""
    kept = line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word n-gram similarity of 0.8 or more, one stays."""
    return jaccard_join.one_of_each_group(docs, threshold=0.8, n=5).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it: not at all, once or twice."""
    taken = mixing.mixed(docs).filter(F.col("copies") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (array<int>), and whether decoding the ids gives the text's bytes."""
    decoded = byte_bpe.transcode(docs.select("doc_id", "text", "lang", "source"), RANKS)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenise),
]

#: Language models, MinHash groups and merges by rank have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage was given is deleted once it is written. ``frames.clear`` deletes the rest when the rows have been used."""
    docs = frames.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, frames.staged(stage(spark, docs, sf_dir), name)
        frames.discard(before)
    return docs
