"""The descriptive report of a labelled panel: header, base, countries, adoption, usage against churn.

Wide aggregates read the panel once; per-metric rows come from unpivoting their single result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import ranks
from tidepanel.spec import MIN_ROWS, TENURE_EDGES

TENURE_NAMES = ("0-3 months", "3-6 months", "6-12 months", "1-2 years", "2-4 years", "4+ years")


def header(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("accounts"), F.count_distinct("period").alias("periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def _by_period(labelled: DataFrame) -> DataFrame:
    """One aggregate over the table; all else about the base comes from its rows, one a period."""
    own = labelled.groupBy("period").agg(
        F.count("*").alias("active"), F.count_if(F.col("months_in_panel") == 1).alias("_new"), F.sum("churn").alias("churned"), F.nullif(F.count("churn"), F.lit(0)).alias("evaluable"), F.count_if("is_ambiguous").alias("_ambiguous")
    )
    first = F.min("period").over(Window.partitionBy())
    new = F.when(F.col("period") == first, F.lit(0)).otherwise(F.col("_new"))
    return own.select("period", "active", new.alias("new"), "churned", "evaluable", (F.col("churned") * 100.0 / F.col("evaluable")).alias("churn_rate"), "_ambiguous")


def base_series(labelled: DataFrame) -> DataFrame:
    """period, active, new, churned, evaluable, churn_rate: one aggregate. In the first period no account is new; without labels the last three are null."""
    return _by_period(labelled).drop("_ambiguous")


def base_scalars(labelled: DataFrame) -> DataFrame:
    """One row of totals and rates out of the series: growth, monthly growth, churn (weighted by evaluable rows), least and greatest, yearly retention, mean life."""
    one = _by_period(labelled).agg(
        F.min_by("active", "period").alias("active_first"), F.max_by("active", "period").alias("active_last"), (F.count("*") - 1).alias("_months"), F.sum("new").alias("new_total"), F.sum("churned").alias("churned_total"),
        F.sum("evaluable").alias("labelled"), F.min("churn_rate").alias("churn_rate_min"), F.max("churn_rate").alias("churn_rate_max"), F.count_if(F.col("evaluable").isNull()).alias("unlabelled_periods"), F.sum("_ambiguous").alias("ambiguous"),
    )
    rate = F.col("churned_total") / F.col("labelled")
    return one.select(
        "active_first", "active_last", "new_total", "churned_total", "labelled", "unlabelled_periods", "churn_rate_min", "churn_rate_max", "ambiguous",
        ((F.col("active_last") / F.col("active_first") - 1) * 100).alias("growth"),
        ((F.pow(F.col("active_last") / F.col("active_first"), 1 / F.nullif(F.col("_months"), F.lit(0))) - 1) * 100).alias("monthly_growth"),
        (rate * 100).alias("churn_rate"), (F.pow(1 - rate, 12) * 100).alias("yearly_retention"), (1 / F.nullif(rate, F.lit(0.0))).alias("mean_life"),
    )


def _rate(rows: Column, churn: Column) -> Column:
    return F.when(rows >= MIN_ROWS, churn * 100)


def country_mix(labelled: DataFrame, top: int = 8) -> DataFrame:
    """country, accounts, base_pct, churn_rate: the largest countries of the last period; a rate needs 100 labelled rows. A null country is ``unknown``.

    The table is summed once by country and period; what follows are as many rows.
    """
    own = labelled.groupBy(F.coalesce("country", F.lit("unknown")).alias("country"), "period").agg(F.count("*").alias("accounts"), F.count("churn").alias("n"), F.sum("churn").alias("gone"))
    own = own.withColumn("last", F.max("period").over(Window.partitionBy()))
    by = own.groupBy("country").agg(F.sum(F.when(F.col("period") == F.col("last"), F.col("accounts"))).alias("accounts"), F.sum("n").alias("n"), F.sum("gone").alias("gone")).filter("accounts IS NOT NULL")
    by = by.withColumn("base_pct", F.col("accounts") * 100.0 / F.sum("accounts").over(Window.partitionBy()))
    return by.select("country", "accounts", "base_pct", _rate(F.col("n"), F.col("gone") / F.col("n")).alias("churn_rate")).orderBy(F.desc("accounts"), "country").limit(top)


def _unpivot(one: DataFrame, metrics: list[str], values: list[str], name: str = "metric") -> DataFrame:
    """Rows of (metric, values...) out of one row with columns ``{metric}__{value}``."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias(name), *[F.col(f"{m}__{v}").cast("double").alias(v) for v in values]) for m in metrics])).alias("_r")
    return one.select(rows).select("_r.*")


def _last_period(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("period") == panel.agg(F.max("period")).scalar())


def adoption(panel: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, accounts, pct, median_of_users: who has a value above 0 in the last period; null is unused."""
    last = _last_period(panel)
    one = last.agg(*[c for m in metrics for c in (F.count_if(F.col(m) > 0).alias(f"{m}__accounts"), (F.count_if(F.col(m) > 0) * 100.0 / F.count("*")).alias(f"{m}__pct"))])
    shares = _unpivot(one, metrics, ["accounts", "pct"]).withColumn("accounts", F.col("accounts").cast("long"))
    users = ranks.unpivoted(last, metrics, "double", name="metric").filter("value > 0")
    return shares.join(ranks.quantiles(users, {"median_of_users": 0.5}, ("metric",)), "metric", "left")


def volumes(panel: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, p25, median, p75, p95 in the last period: exact quantiles, linear between neighbours; a metric without values has none."""
    found = ranks.quantiles(ranks.unpivoted(_last_period(panel), metrics, "double", name="metric"), {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}, ("metric",))
    return panel.sparkSession.createDataFrame([(m,) for m in metrics], "metric string").join(found, "metric", "left")


def usage_vs_churn(labelled: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, stay_pct, churn_pct, lift, stay_median, churn_median, median_ratio over labelled rows: how often, and how much, those that go use a thing against those that stay."""
    own = labelled.filter("churn IS NOT NULL")
    cols = []
    for m in metrics:
        used = F.when(F.col(m) > 0, 1).otherwise(0)
        cols += [F.avg(F.when(F.col("churn") == c, used)).alias(f"{m}__{k}") for k, c in (("stay", 0), ("churn", 1))]
    rows = _unpivot(own.agg(*cols), metrics, ["stay", "churn"])
    medians = ranks.quantiles(ranks.unpivoted(own.withColumn("gone", F.col("churn").cast("int")), metrics, "double", ("gone",), "metric"), {"median": 0.5}, ("metric", "gone"))
    wide = medians.groupBy("metric").agg(*[F.max(F.when(F.col("gone") == c, F.col("median"))).alias(f"{k}_median") for k, c in (("stay", 0), ("churn", 1))])
    lift = F.col("churn") / F.nullif(F.col("stay"), F.lit(0.0))
    ratio = F.col("churn_median") / F.nullif(F.col("stay_median"), F.lit(0.0))
    return rows.join(wide, "metric", "left").select("metric", (F.col("stay") * 100).alias("stay_pct"), (F.col("churn") * 100).alias("churn_pct"), lift.alias("lift"), "stay_median", "churn_median", ratio.alias("median_ratio"))


def churn_by(labelled: DataFrame, key: Column, name: str, floor: int = MIN_ROWS) -> DataFrame:
    """``name``, accounts, churn_rate over labelled rows, groups of ``floor`` rows or more."""
    own = labelled.filter("churn IS NOT NULL").groupBy(key.alias(name)).agg(F.count("*").alias("accounts"), (F.avg("churn") * 100).alias("churn_rate"))
    return own.filter(F.col("accounts") >= floor)


def tenure_bucket(tenure: Column) -> Column:
    """The bucket's name; edges belong to the upper bucket, negative and null tenures to none."""
    out = F.lit(None).cast("string")
    for low, name in zip(TENURE_EDGES, TENURE_NAMES, strict=True):
        out = F.when(tenure >= low, F.lit(name)).otherwise(out)
    return out


def crosstab(labelled: DataFrame, key: str) -> DataFrame:
    """``key``, active_share, churn_share: labelled rows of each value, shares of its row."""
    own = labelled.filter("churn IS NOT NULL").groupBy(key).agg(F.avg((F.col("churn") == 0).cast("int")).alias("active_share"), F.avg((F.col("churn") == 1).cast("int")).alias("churn_share"))
    return own


def seasonal_counts(profile: DataFrame, panel: DataFrame) -> DataFrame:
    """One row: paused accounts, seasonal ones, and their share of all accounts in percent."""
    accounts = panel.agg(F.count_distinct("id")).scalar()
    return profile.agg(F.count("*").alias("paused"), F.count_if("is_seasonal").alias("seasonal")).withColumn("seasonal_pct", F.col("seasonal") * 100.0 / accounts)


def capability_adoption(panel: DataFrame, catalogue: dict[str, tuple[str, ...]]) -> DataFrame:
    """group, place, metric, accounts, pct, median_of_users: ``adoption`` of a catalogue's columns, those that the panel has, by group from the most used down."""
    groups = {m: g for g, metrics in catalogue.items() for m in metrics if m in panel.columns}
    found = adoption(panel, list(groups))
    own = found.withColumn("group", F.create_map(*[F.lit(x) for mg in groups.items() for x in mg])[F.col("metric")])
    return own.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("pct"), "metric"))).select("group", "place", "metric", "accounts", "pct", "median_of_users")


def usage_signals(labelled: DataFrame, signals: list[str]) -> DataFrame:
    """``usage_vs_churn`` of the columns that are there, with their place: what fades most before an account leaves comes first, a lift that isn't known counts as 1."""
    found = usage_vs_churn(labelled, [s for s in signals if s in labelled.columns])
    # a row a signal: as many as the caller named
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("lift", F.lit(1.0)), "metric")))


def document(labelled: DataFrame, catalogue: dict[str, tuple[str, ...]], volume: tuple[str, ...], signals: tuple[str, ...], generated_at: str, seasonal: DataFrame | None = None) -> dict:
    """The whole report as it is written in JSON; tables are small by their nature: a row a period, country, state, bucket or named column."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    gone = labelled.filter("churn IS NOT NULL").agg(F.count_if(F.col("churn") == 0).alias("stay"), F.count_if(F.col("churn") == 1).alias("churn")).first().asDict()
    has = lambda names: [n for n in names if n in labelled.columns]
    groups: dict[str, list[dict]] = {g: [] for g in catalogue}
    if any(has(m) for m in catalogue.values()):
        for r in sorted(rows(capability_adoption(labelled, catalogue)), key=lambda r: r["place"]):
            groups[r.pop("group")].append(r)
    return {
        "generated_at": generated_at,
        "panel": rows(header(labelled))[0],
        "base": {**rows(base_scalars(labelled))[0], "series": sorted(rows(base_series(labelled)), key=lambda r: r["period"]), **(rows(seasonal)[0] if seasonal is not None else {}), "countries": rows(country_mix(labelled)) if "country" in labelled.columns else []},
        "adoption": {"groups": [{"group": g, "items": items} for g, items in groups.items() if items], "volumes": rows(volumes(labelled, has(volume))) if has(volume) else []},
        "churn": {
            **gone,
            "signals": sorted(rows(usage_signals(labelled, has(signals))), key=lambda r: r["place"]) if has(signals) else [],
            "states": rows(churn_by(labelled, F.coalesce("state", F.lit("unknown")), "state").orderBy(F.desc("churn_rate"))) if "state" in labelled.columns else [],
            "tenure": rows(churn_by(labelled, tenure_bucket(F.col("tenure_months")), "bucket")) if "tenure_months" in labelled.columns else [],
        },
    }
