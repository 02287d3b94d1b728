"""Temporal splits of a labelled panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eligible(labelled: DataFrame, min_months: int = 2) -> DataFrame:
    """Rows with a label, of accounts that have been seen for ``min_months``."""
    own = labelled.filter("churn IS NOT NULL")
    return own.filter(F.col("months_in_panel") >= min_months) if min_months > 1 else own


def partition_periods(periods: list[int], n_test: int = 2, n_val: int = 2) -> tuple[list[int], list[int], list[int]]:
    """Train, validation and test periods: the last ones test."""
    own = sorted(periods)
    if len(own) < n_test + n_val + 1:
        raise ValueError(f"{len(own)} periods with labels are too few for {n_test} test and {n_val} validation periods")
    cut = len(own) - n_test
    return own[: cut - n_val], own[cut - n_val : cut], own[cut:]


def temporal_split(labelled: DataFrame, n_test: int = 2, n_val: int = 2, min_months: int = 2, excluded: DataFrame | None = None) -> DataFrame:
    """Adds ``split`` (train, val, test) to eligible rows. Excluded ids go from train and val, never from test. Only the list of periods comes to the driver."""
    own = eligible(labelled, min_months)
    train, val, test = partition_periods([r["period"] for r in own.select("period").distinct().collect()], n_test, n_val)
    part = F.when(F.col("period").isin(*test), "test").when(F.col("period").isin(*val), "val").otherwise("train")
    out = own.withColumn("split", part)
    if excluded is None:
        return out
    gone = excluded.select("id").distinct().withColumn("_gone", F.lit(True))
    return out.join(gone, "id", "left").filter(F.col("_gone").isNull() | (F.col("split") == "test")).drop("_gone")


def holdout(labelled: DataFrame, n_test: int = 2, n_val: int = 2, min_months: int = 2) -> DataFrame:
    """The eligible rows of the test periods alone: what an artifact that exists is judged by, the same rows that ``temporal_split`` calls test."""
    own = eligible(labelled, min_months)
    test = partition_periods([r["period"] for r in own.select("period").distinct().collect()], n_test, n_val)[2]
    return own.filter(F.col("period").isin(*test))


def summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.sum("churn").alias("positives"), F.avg("churn").alias("rate"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))
