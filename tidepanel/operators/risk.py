"""Revenue at risk, categories and their summary; price coverage of plan codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import plan_codes
from tidepanel.spec import RISK_ORDER


@dataclass(frozen=True)
class RiskBands:
    threshold: float = 0.324
    medium: float = 15.0
    high: float = 40.0


def assign(scored: DataFrame, bands: RiskBands = RiskBands()) -> DataFrame:  # noqa: B008
    """Adds churn_probability (6 decimals), monthly_revenue, revenue_at_risk (2), risk_category, will_churn from probability and revenue (null as 0). Categories go by unrounded values."""
    revenue = F.coalesce("revenue", F.lit(0.0))
    at_risk = F.col("probability") * revenue
    flagged = F.col("probability") >= bands.threshold
    category = F.when(~flagged, RISK_ORDER[0]).when(at_risk >= bands.high, RISK_ORDER[3]).when(at_risk >= bands.medium, RISK_ORDER[2]).otherwise(RISK_ORDER[1])
    return scored.select(
        *[c for c in scored.columns if c not in ("probability", "revenue")],
        F.bround("probability", 6).alias("churn_probability"),
        F.bround(revenue, 2).alias("monthly_revenue"),
        F.bround(at_risk, 2).alias("revenue_at_risk"),
        category.alias("risk_category"),
        flagged.cast("int").alias("will_churn"),
    )


def summary(scored: DataFrame) -> DataFrame:
    """risk_category, accounts, mean_probability (percent), revenue, at_risk: all four categories, empty ones with 0."""
    own = scored.groupBy("risk_category").agg(F.count("*").alias("accounts"), (F.avg("churn_probability") * 100).alias("mean_probability"), F.sum("monthly_revenue").alias("revenue"), F.sum("revenue_at_risk").alias("at_risk"))
    every = scored.sparkSession.createDataFrame([(c,) for c in RISK_ORDER], "risk_category string")
    return every.join(own, "risk_category", "left").fillna(0).fillna(0.0)


def revenues(panel: DataFrame, plans: dict, modules: dict, default: str) -> DataFrame:
    """Adds revenue, missing and items from the plan code: native expressions on the column, no lookup join."""
    out = panel.withColumn("_r", plan_codes.revenue(plan_codes.parse(F.col("plan")), plans, modules, default))
    return out.withColumns({"revenue": F.col("_r.revenue"), "missing": F.col("_r.missing"), "items": F.col("_r.items")}).drop("_r")


def coverage(panel: DataFrame, plans: dict, modules: dict, default: str) -> DataFrame:
    """plan, accounts, revenue, complete, missing (comma-joined): one row a plan code."""
    codes = panel.groupBy(F.coalesce("plan", F.lit("")).alias("plan")).agg(F.count("*").alias("accounts"))
    priced = revenues(codes, plans, modules, default)
    return priced.select("plan", "accounts", "revenue", (F.size("missing") == 0).alias("complete"), F.array_join("missing", ",").alias("missing"))


def token_counts(panel: DataFrame) -> DataFrame:
    """token, accounts: how many rows carry each part of a plan code; what a price template has to list."""
    parts = F.explode(F.array_distinct(F.filter(F.split(F.lower(F.trim("plan")), "-"), lambda x: x != "")))
    return panel.select(parts.alias("token")).groupBy("token").agg(F.count("*").alias("accounts"))


def ordered(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """By revenue at risk, most first, ties by id; with a limit only that many (a top-k, not a full sort)."""
    out = scored.orderBy(F.col("revenue_at_risk").desc_nulls_last(), "id")
    return out.limit(limit) if limit else out


def ranked_within(scored: DataFrame, by: str, n: int) -> DataFrame:
    """The first ``n`` of each value of ``by``."""
    w = Window.partitionBy(by).orderBy(F.col("revenue_at_risk").desc_nulls_last(), "id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
