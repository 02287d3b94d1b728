"""Features of a panel row: sales mix, configuration ratios, plan, billing state, gap-aware history.

Windows share one partitioning and order (id, t), so a feature build takes one shuffle on id and one sort. Metrics go through windows as
structs, one expression a lag and not one a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.functions import plan_codes
from tidepanel.functions.arithmetic import clip, in_use, ratio, total, zero
from tidepanel.operators.panel import severity
from tidepanel.spec import MODULES

#: Columns that are never lagged: keys, labels, and what is history itself.
NOT_LAGGED = ("id", "period", "t", "churn", "months_in_panel", "tenure_months", "severity_max_3m", "severity_delta_1m", "plan_rank", "plan_modules")


def by_id() -> WindowSpec:
    return Window.partitionBy("id").orderBy("t")


def sales_mix(panel: DataFrame, sales: list[str], additions: list[str], delivery: list[str], salon: str | None, usage: list[str]) -> DataFrame:
    """Adds sales_total, active_channels, delivery_ratio, salon_ratio, additions_total, no_sales, features_in_use; columns that aren't there don't count."""
    has = lambda cols: [c for c in cols if c in panel.columns]
    out = panel.withColumns({"sales_total": total(has(sales)), "active_channels": in_use(has(sales)), "additions_total": total(has(additions)), "features_in_use": in_use(has(usage))})
    out = out.withColumn("delivery_ratio", ratio(total(has(delivery)), F.col("sales_total")))
    if salon and salon in panel.columns:
        out = out.withColumn("salon_ratio", ratio(zero(F.col(salon)), F.col("sales_total")))
    return out.withColumn("no_sales", (F.col("sales_total") <= 0).cast("int"))


def config_ratios(panel: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds each ratio num / den, within 0 to 5, where both columns are there."""
    return panel.withColumns({name: ratio(F.col(num), F.col(den), 0, 5) for name, (num, den) in pairs.items() if num in panel.columns and den in panel.columns})


def plan_features(panel: DataFrame) -> DataFrame:
    """Adds plan_base and plan_market (``unknown`` if none), plan_rank, plan_modules (how many) and a 0/1 column a module, from the code in ``plan``."""
    out = panel.withColumn("_plan", plan_codes.parse(F.col("plan")))
    own = {
        "plan_base": F.coalesce("_plan.base", F.lit("unknown")),
        "plan_market": F.coalesce("_plan.market", F.lit("unknown")),
        "plan_rank": plan_codes.rank(F.col("_plan.base")),
        "plan_modules": F.size("_plan.modules"),
        **{f"plan_module_{m}": F.array_contains("_plan.modules", m).cast("int") for m in MODULES},
    }
    return out.withColumns(own).drop("_plan")


def state_features(panel: DataFrame) -> DataFrame:
    """Adds severity, severity_max_3m (worst of three rows), severity_delta_1m (against the row before, 0 at first) and debt_streak.

    All four go by rows, not by periods: a missing period doesn't break a streak of rows in debt; a healthy row does.
    """
    w = by_id()
    own = panel.withColumn("severity", severity(F.col("state")))
    own = own.withColumns(
        {
            "severity_max_3m": F.max("severity").over(w.rowsBetween(-2, 0)),
            "severity_delta_1m": F.coalesce(F.col("severity") - F.lag("severity").over(w), F.lit(0)),
            "_sick": F.count_if(F.col("severity") > 0).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    # rows in debt since the last healthy row: their running count, less what it was at that row; by the same windows, so nothing is sorted again
    before = F.max(F.when(F.col("severity") == 0, F.col("_sick"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("debt_streak", F.col("_sick") - F.coalesce(before, F.lit(0).cast("long"))).drop("_sick")


def lags(panel: DataFrame, metrics: list[str], steps: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``_lag{k}``, a struct of the metrics at t - k; null where the account was absent then. One window frame a step."""
    w = by_id()
    row = F.struct(*[F.col(m).cast("double").alias(m) for m in metrics])
    return panel.withColumns({f"_lag{k}": F.first(row).over(w.rangeBetween(-k, -k)) for k in steps})


def temporal(panel: DataFrame, metrics: list[str], core: list[str] = (), steps: tuple[int, ...] = (1, 2, 3), window: int = 3) -> DataFrame:
    """Adds per metric: _lag_k, _delta_1m, _ratio_3m (against the mean of what lags there are, 0 to 10), and for core metrics _delta_3m and _slope_3m.

    The slope is that of the least-squares line through t-3..t and null unless all four are there. Columns that exist are not replaced.
    """
    return from_lags(lags(panel, metrics, steps), metrics, core, steps, window)


def from_lags(out: DataFrame, metrics: list[str], core: list[str] = (), steps: tuple[int, ...] = (1, 2, 3), window: int = 3) -> DataFrame:
    """The features of ``temporal``, from a table that has the structs ``_lag{k}``; these go."""
    at = lambda m, k: F.col(f"_lag{k}.{m}")
    new: dict[str, Column] = {}
    for m in metrics:
        now = F.col(m).cast("double")
        new |= {f"{m}_lag_{k}": at(m, k) for k in steps}
        if 1 in steps:
            new[f"{m}_delta_1m"] = now - at(m, 1)
        if near := [k for k in steps if k <= window]:
            n = sum((at(m, k).isNotNull().cast("int") for k in near), F.lit(0))
            mean = sum((zero(at(m, k)) for k in near), F.lit(0.0)) / F.nullif(n, F.lit(0))
            new[f"{m}_ratio_3m"] = clip(now / F.nullif(mean, F.lit(0.0)), 0, 10)
        if m in core and 3 in steps:
            new[f"{m}_delta_3m"] = now - at(m, 3)
            if {1, 2} <= set(steps):
                new[f"{m}_slope_3m"] = (-1.5 * at(m, 3) - 0.5 * at(m, 2) + 0.5 * at(m, 1) + 1.5 * now) / 5
    return out.withColumns({k: v for k, v in new.items() if k not in out.columns}).drop(*[f"_lag{k}" for k in steps])


def history(panel: DataFrame) -> DataFrame:
    """Adds months_since_first, prior_pauses, plan_changed, plan_rank_delta, plan_modules_delta, plan_downgrade; plan changes are against the row before."""
    w = by_id()
    own = panel.withColumns(
        {
            "months_since_first": F.col("t") - F.min("t").over(Window.partitionBy("id")),
            "_plan": F.lag(F.coalesce("plan", F.lit(""))).over(w),
            "plan_rank_delta": F.coalesce(F.col("plan_rank") - F.lag("plan_rank").over(w), F.lit(0)),
            "plan_modules_delta": F.coalesce(F.col("plan_modules") - F.lag("plan_modules").over(w), F.lit(0)),
        }
    )
    changed = F.col("_plan").isNotNull() & (F.coalesce("plan", F.lit("")) != F.col("_plan"))
    return own.withColumns(
        {
            "prior_pauses": F.greatest(F.col("months_since_first") + 1 - F.col("months_in_panel"), F.lit(0)),
            "plan_changed": changed.cast("int"),
            "plan_downgrade": ((F.col("plan_rank_delta") < 0) | (F.col("plan_modules_delta") < 0)).cast("int"),
        }
    ).drop("_plan")


def lagged_columns(panel: DataFrame) -> list[str]:
    """Numeric columns that get a history."""
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    return [c for c, kind in panel.dtypes if kind in numeric and c not in NOT_LAGGED and not c.startswith("plan_module_")]


def feature_columns(features: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """What a model may use: numbers and categories, without keys, labels, free text, names with a leading ``__`` or an excluded part."""
    never = {"id", "period", "t", "churn", "is_ambiguous", "is_labelable", "created", "plan", "country", "state"}
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    wanted = lambda c, kind: kind in numeric or (kind == "string" and c.startswith("plan_"))
    return [c for c, kind in features.dtypes if c not in never and not c.startswith("__") and wanted(c, kind) and not any(p in c for p in exclude)]
