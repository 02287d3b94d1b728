"""What is written for people and services: report tables, price templates."""

from __future__ import annotations

from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.sources import files
from tidepanel.spec import MARKETS, MODULES, PLAN_RANK


def report_rows(frames: dict[str, DataFrame], limit: int = 10_000) -> dict[str, list[dict]]:
    """Small result tables as lists of records; a table above ``limit`` rows is refused rather than cut."""
    out = {}
    for name, df in frames.items():
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{name} is no report: over {limit} rows")
        out[name] = [r.asDict(recursive=True) for r in rows]
    return out


def evaluation_text(metrics: dict[str, float], top: list[dict] = ()) -> str:
    """An evaluation for people to read: a line a metric, and one for each fraction of ``metrics.top_k`` (as dictionaries)."""
    lines = [f"{k:<12}{v:>10.4f}" if v is not None else f"{k:<12}{'-':>10}" for k, v in metrics.items()]
    lines += [f"top {r['fraction']:>5.1%}{r['n_accounts']:>8} accounts, precision {r['precision']:.3f}, recall {r['recall'] or 0:.3f}, lift {r['lift'] or 0:.2f}" for r in top]
    return "\n".join(lines) + "\n"


def price_template(tokens: DataFrame, path: str, currency: str = "USD") -> dict:
    """A YAML of all base plans and modules by market, null where no price is known; prices in an existing file stay. Returns what was written."""
    spark = tokens.sparkSession
    counts = {r["token"]: r["accounts"] for r in tokens.filter(F.col("token").isin(*PLAN_RANK, *MODULES)).collect()}
    old = (yaml.safe_load(files.read_text(spark, path)) if files.exists(spark, path) else None) or {}
    body: dict[str, Any] = {"currency": old.get("currency", currency)}
    for part, items in (("plans", PLAN_RANK), ("modules", MODULES)):
        known = old.get(part) or {}
        body[part] = {i: {m: (known.get(i) or {}).get(m) for m in MARKETS} for i in items if i in counts or i in known}
    files.write_text(spark, path, "".join(f"# {i}: {n} accounts\n" for i, n in sorted(counts.items())) + yaml.safe_dump(body, sort_keys=False))
    return body
