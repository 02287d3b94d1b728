"""Queries behind a read-only service: listings, lookups, histograms, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 200


def filtered(scored: DataFrame, risk: list[str] | None = None, search: str | None = None, country: str | None = None, min_probability: float | None = None, seasonal: bool | None = None) -> DataFrame:
    """Rows that pass every filter given: categories, a literal part of the name (any case) or the exact id, country (any case), least probability, seasonal or not."""
    out = scored
    if risk:
        out = out.filter(F.col("risk_category").isin(*risk))
    if country:
        out = out.filter(F.lower("country") == country.lower())
    if min_probability is not None:
        out = out.filter(F.col("churn_probability") >= min_probability)
    if seasonal is not None:
        out = out.filter(F.coalesce("is_seasonal", F.lit(False)) == seasonal)
    if search:
        named = F.contains(F.lower("name"), F.lit(search.lower())) if "name" in scored.columns else F.lit(False)
        out = out.filter(named | (F.col("id").cast("string") == search.strip()))
    return out


def page(rows: DataFrame, sort_by: str = "revenue_at_risk", ascending: bool = False, page: int = 1, size: int = 50) -> DataFrame:
    """One page, nulls last either way, ties by id; an unknown column sorts by id alone, sizes are cut at 200."""
    size = min(size, MAX_PAGE)
    order = [F.col(sort_by).asc_nulls_last() if ascending else F.col(sort_by).desc_nulls_last()] if sort_by in rows.columns else []
    return rows.orderBy(*order, "id").offset((page - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int = 50) -> DataFrame:
    n = F.count("*")
    return rows.agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / min(size, MAX_PAGE))).cast("long").alias("pages"))


def detail(scored: DataFrame, account: int) -> DataFrame:
    return scored.filter(F.col("id") == account)


def histogram(scored: DataFrame, column: str = "churn_probability", bins: int = 20) -> DataFrame:
    """bin (from 0), low, high, n: equal-width bins, closed on the right, the first also on the left; empty bins are there.

    A column with one value is widened by 0.1 % of it (0.001 at zero) on both sides.
    """
    values = scored.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    flat = F.when(F.col("a") == F.col("b"), F.when(F.col("a") == 0, 0.001).otherwise(F.abs("a") * 0.001)).otherwise(0.0)
    ends = values.agg(F.min("v").alias("a"), F.max("v").alias("b")).filter("a IS NOT NULL").select((F.col("a") - flat).alias("low"), ((F.col("b") - F.col("a") + 2 * flat) / bins).alias("width"))
    low, width = ends.select("low").scalar(), ends.select("width").scalar()
    place = F.least(F.greatest(F.ceil((F.col("v") - low) / width) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("low", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def batch_periods(batches: DataFrame) -> DataFrame:
    """period, rows, is_latest: the batches that there are, latest first."""
    own = batches.groupBy("period").agg(F.count("*").alias("rows"))
    return own.withColumn("is_latest", F.col("period") == F.max("period").over(Window.partitionBy())).orderBy(F.desc("period"))


def resolve(batches: DataFrame, period: int | None = None) -> DataFrame:
    """The rows of a period, the latest by default; an unknown one is an error."""
    known = {r["period"] for r in batches.select("period").distinct().collect()}
    if not known:
        raise FileNotFoundError("no batch has been written")
    wanted = max(known) if period is None else period
    if wanted not in known:
        raise KeyError(wanted)
    return batches.filter(F.col("period") == wanted)
