"""Population stability of features between reference periods and one period.

All features go through together: the table is turned long once and counted by (feature, value), exact quantile edges come from running
sums of these counts (see ``ranks``), and counts by (feature, bin, side) are pre-aggregated, so no task holds a feature's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import ranks

EPS = 1e-6
MODERATE, HIGH = 0.10, 0.25


def level(psi: Column, moderate: float = MODERATE, high: float = HIGH) -> Column:
    return F.when(psi >= high, "high").when(psi >= moderate, "moderate").otherwise("stable")


def _psi(shares: DataFrame) -> DataFrame:
    """feature, psi from rows of feature, ref and act shares; shares under EPS are lifted to it, without scaling the rest."""
    ref, act = F.greatest("ref", F.lit(EPS)), F.greatest("act", F.lit(EPS))
    return shares.groupBy("feature").agg(F.sum((act - ref) * F.ln(act / ref)).alias("psi"))


def numeric(rows: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """feature, psi, kind: from rows with ``is_ref`` (reference or compared).

    Edges are the distinct quantiles of the reference's values; the outer ones are open, bins are [a, b), missing values a bin of their
    own, shares of all rows. Without values on a side, or with fewer than three edges, only missing against present is compared.
    """
    long = ranks.unpivoted(rows, features, "double", ("is_ref",))
    counted = long.groupBy("feature", "value").agg(F.count_if("is_ref").alias("r"), F.count_if(~F.col("is_ref")).alias("a"))
    probes = {f"q{i}": i / bins for i in range(bins + 1)}
    found = ranks.quantiles(long.filter("is_ref"), probes, ("feature",))
    edges = found.select("feature", F.array_sort(F.array_distinct(F.array(*probes))).alias("edges"))
    present = counted.groupBy("feature").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("a"))).alias("_act"))
    edges = present.join(edges, "feature", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))
    inner = F.when((F.size("edges") >= 3) & (F.col("_act") > 0), F.slice("edges", 2, F.size("edges") - 2)).otherwise(F.array().cast("array<double>"))
    place = F.when(F.col("value").isNull(), -1).otherwise(F.size(F.filter("inner", lambda e: F.col("value") >= e)))
    binned = counted.join(F.broadcast(edges.select("feature", inner.alias("inner"))), "feature")  # a row a feature: as many as the caller named
    counts = binned.groupBy("feature", place.alias("bin")).agg(F.sum("r").alias("r"), F.sum("a").alias("a"))
    every = edges.select("feature", F.explode(F.sequence(F.lit(-1), F.size(inner))).alias("bin")).join(counts, ["feature", "bin"], "left").fillna(0)
    total = Window.partitionBy("feature")
    shares = every.select("feature", (F.col("r") / F.nullif(F.sum("r").over(total), F.lit(0))).alias("ref"), (F.col("a") / F.nullif(F.sum("a").over(total), F.lit(0))).alias("act")).fillna(0.0)
    return _psi(shares).withColumn("kind", F.lit("numeric"))


def categorical(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, psi, kind: frequencies of values, null as a value of its own."""
    counts = ranks.unpivoted(rows, features, "string", ("is_ref",)).groupBy("feature", "value").agg(F.count_if("is_ref").alias("r"), F.count_if(~F.col("is_ref")).alias("a"))
    total = Window.partitionBy("feature")
    shares = counts.select("feature", (F.col("r") / F.nullif(F.sum("r").over(total), F.lit(0))).alias("ref"), (F.col("a") / F.nullif(F.sum("a").over(total), F.lit(0))).alias("act")).fillna(0.0)
    return _psi(shares).withColumn("kind", F.lit("categorical"))


def report(panel: DataFrame, period: int, reference: list[int], numbers: list[str], categories: list[str] = (), bins: int = 10, exclude: tuple[str, ...] = ()) -> DataFrame:
    """feature, kind, psi, level. The compared period never counts as its own reference."""
    ref = [p for p in reference if p != period]
    if not ref:
        raise ValueError("no reference periods")
    rows = panel.filter(F.col("period").isin(*ref, period)).withColumn("is_ref", F.col("period") != period)
    keep = lambda cols: [c for c in cols if not any(x in c for x in exclude)]
    parts = [f(rows, cols) for f, cols in ((lambda r, c: numeric(r, c, bins), keep(numbers)), (categorical, keep(categories))) if cols]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("feature", "kind", "psi", level(F.col("psi")).alias("level"))


def level_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("level").agg(F.count("*").alias("features"))


def at_level(found: DataFrame, *levels: str) -> DataFrame:
    """The features of these levels, most drifted first; ties by name."""
    return found.filter(F.col("level").isin(*levels)).orderBy(F.desc("psi"), "feature")


def has_drifted(found: DataFrame) -> bool:
    """Whether any feature has moved at all."""
    return not at_level(found, "moderate", "high").isEmpty()


def document(found: DataFrame, period: int, reference: list[int], generated_at: str) -> dict:
    """What is written as JSON: the header, counts by level, and a record a feature (a row each: as many as the caller named)."""
    records = [r.asDict() for r in found.orderBy(F.desc("psi"), "feature").collect()]
    counts = dict.fromkeys(("high", "moderate", "stable"), 0)
    for r in records:
        counts[r["level"]] += 1
    return {"generated_at": generated_at, "period": period, "reference_periods": sorted(reference), "features_compared": len(records), "levels": counts, "features": [{**r, "psi": round(r["psi"], 4)} for r in records]}


def as_text(doc: dict, top: int = 10) -> str:
    """A short table of the most drifted features of ``document``."""
    lines = [f"Drift of {doc['period']} against {len(doc['reference_periods'])} periods: " + ", ".join(f"{n} {k}" for k, n in doc["levels"].items())]
    return "\n".join([*lines, *[f"{r['level']:>8}  {r['psi']:.4f}  {r['feature']}" for r in doc["features"][:top]]])
