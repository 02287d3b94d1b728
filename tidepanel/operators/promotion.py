"""Whether a candidate model replaces the champion: rules and their outcomes are rows.

A rule is (metric, kind, limit): ``least`` holds the candidate's metric to a floor, ``gain`` asks for so much more than the champion has, and
``loss`` allows so much less. Outcomes are a small table, which is what is stored, shown and decided from.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules, and how far off a limit still counts as met.
RULES = (("pr_auc", "least", 0.20), ("pr_auc", "gain", 0.005), ("roc_auc", "loss", 0.01))
TOLERANCE = 1e-9
SHOWN = ("pr_auc", "roc_auc", "best_f1", "brier")


def outcomes(spark: SparkSession, candidate: Mapping[str, float], champion: Mapping[str, float] | None = None, rules: tuple = RULES) -> DataFrame:
    """metric, kind, limit, candidate, champion, margin (how far the rule is met by, below 0 if not), met. Without a champion only floors apply."""
    known = [(m, k, float(x), candidate.get(m), (champion or {}).get(m)) for m, k, x in rules if champion is not None or k == "least"]
    rows = spark.createDataFrame(known, "metric string, kind string, limit double, candidate double, champion double")
    margin = F.when(F.col("kind") == "least", F.col("candidate") - F.col("limit")).when(F.col("kind") == "gain", F.col("candidate") - F.col("champion") - F.col("limit")).otherwise(F.col("limit") - (F.col("champion") - F.col("candidate")))
    return rows.withColumn("margin", margin).withColumn("met", F.coalesce(F.col("margin") >= -TOLERANCE, F.lit(False)))


def verdict(found: DataFrame, forced: bool = False) -> dict:
    """promote, forced, failed, rules: whether all rules are met. ``forced`` passes over those against the champion, never over a floor."""
    rows = [r.asDict() for r in found.collect()]
    failed = [r for r in rows if not r["met"]]
    blocking = [r for r in failed if r["kind"] == "least" or not forced]
    said = [f"{r['metric']} {r['kind']} {r['limit']:g} missed by {-r['margin']:.4f}" if r["margin"] is not None else f"{r['metric']} isn't known" for r in failed]
    return {"promote": not blocking, "forced": forced, "failed": said, "rules": rows}


def as_markdown(decided: dict, candidate: Mapping[str, float], champion: Mapping[str, float] | None, version: str, same_test: bool = True) -> str:
    """A page for people: what was decided, metrics side by side, and each rule."""
    number = lambda x: "-" if x is None else f"{x:.4f}"
    rows = "".join(f"| {m} | {number(candidate.get(m))} | {number((champion or {}).get(m))} |\n" for m in SHOWN)
    rules = "".join(f"| {r['metric']} | {r['kind']} {r['limit']:g} | {'met' if r['met'] else 'missed'} by {number(None if r['margin'] is None else abs(r['margin']))} |\n" for r in decided["rules"])
    basis = "There is no champion." if champion is None else "Both were scored on the same rows." if same_test else "The champion can't score these rows: its stored metrics, of other rows, stand in."
    head = f"# {version}: {'promoted' if decided['promote'] else 'not promoted'}{' (forced)' if decided['forced'] else ''}\n\n{basis}\n"
    return f"{head}\n| metric | candidate | champion |\n|---|---|---|\n{rows}\n| metric | rule | outcome |\n|---|---|---|\n{rules}"
