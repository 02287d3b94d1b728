"""Scoring a period end to end."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import plan_codes
from tidepanel.operators import explain, pauses, risk
from tidepanel.operators.learning import Artifact
from tidepanel.operators.panel import next_period
from tidepanel.sources.prices import PriceBook

#: The columns of a batch.
COLUMNS = (
    "id", "period", "predicted_period", "name", "plan", "plan_text", "country", "state", "churn_probability", "monthly_revenue", "revenue_at_risk", "risk_category", "will_churn", "revenue_items",
    "price_incomplete", "past_pauses", "usual_pause_month", "is_seasonal", "factors", "narrative",
)


def _rounded(factor: Column) -> Column:
    """A factor as it is published: value and Shapley value to four places."""
    return factor.withField("value", F.round(factor["value"], 4)).withField("shap", F.round(factor["shap"], 4))


def score_period(
    features: DataFrame,
    artifact: Artifact,
    prices: PriceBook,
    period: int | None = None,
    bands: risk.RiskBands | None = None,
    rules: pauses.SeasonRules = pauses.SeasonRules(),  # noqa: B008
    known: Mapping[str, str] | None = None,
    writer: Callable[[dict], str | None] | None = None,
) -> DataFrame:
    """The accounts of one period (the last by default) with the 20 ``COLUMNS``; columns that the features lack are null. An empty period is an error.

    Factors carry percentiles among the period's accounts; pauses are what was known by then. ``writer`` may write the texts of high risks.
    """
    period = period or features.agg(F.max("period")).first()[0]
    batch = features.filter(F.col("period") == period)
    if batch.isEmpty():
        raise ValueError(f"no accounts in period {period}")
    keep = ("id", "period", "name", "plan", "country", "state")
    lacking = {c: F.lit(None).cast("string") for c in keep if c not in batch.columns}
    priced = prices.priced(batch.withColumns(lacking) if lacking else batch)
    told = (*keep, "probability", "revenue", "price_incomplete", "items")
    scored = artifact.score(priced).select(*told, *[f for f in artifact.model.features if f in priced.columns and f not in told])
    found = explain.contributions(scored, artifact, known=known).select(*keep, "probability", "revenue", "price_incomplete", F.to_json("items").alias("revenue_items"), "factors")
    found = explain.with_percentiles(found, batch, artifact.features).withColumn("factors", F.transform("factors", _rounded))
    out = risk.assign(found, bands or risk.RiskBands(threshold=artifact.threshold)).join(pauses.causal_flags(features, period, rules), "id", "left")
    out = out.withColumnsRenamed({"n_pauses": "past_pauses", "usual_month": "usual_pause_month"})
    text = explain.narrative(F.col("risk_category"), F.col("churn_probability"), F.col("monthly_revenue"), F.col("factors"), prices.currency)
    out = out.withColumns({"narrative": text, "predicted_period": next_period(F.col("period")), "plan_text": plan_codes.describe(plan_codes.parse(F.col("plan")))}).select(*COLUMNS)
    return explain.rewritten(out, writer) if writer else out


def batch_metadata(scored: DataFrame, artifact: Artifact, prices: PriceBook, importance: DataFrame, bands: risk.RiskBands, generated_at: str) -> dict:
    """What is kept beside a batch: its head, the categories, what weighs most, and the model that scored it."""
    head = scored.agg(F.first("period").alias("period"), F.first("predicted_period").alias("predicted_period"), F.count("*").alias("accounts")).first().asDict()
    return {
        **head, "generated_at": generated_at, "currency": prices.currency, "prices_loaded": prices.is_filled, "threshold": bands.threshold, "bands": {"medium": bands.medium, "high": bands.high},
        "summary": [r.asDict() for r in risk.summary(scored).collect()], "importance": [r.asDict() for r in importance.collect()],
        "metrics": artifact.metrics, "features": len(artifact.features), "trained_periods": artifact.periods, "baseline": artifact.metrics.get("baseline"),
    }
