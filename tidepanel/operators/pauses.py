"""Pauses (absences that end in a return), seasonality of accounts, and profiles over the calendar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.panel import calendar, month_of
from tidepanel.spec import HIGH_SEASON, LOW_SEASON


@dataclass(frozen=True)
class SeasonRules:
    """When an account counts as seasonal: this many pauses, or one season-like signature of a mean length between the limits."""

    min_pauses: int = 2
    shortest: float = 3
    longest: float = 8
    signature_suffices: bool = True


def month_table(panel: DataFrame) -> DataFrame:
    """t, period of ``calendar``, as a local table: the panel is asked for its periods once, however often the months are joined. It has a row a period."""
    rows = [(r["t"], r["period"]) for r in calendar(panel).collect()]
    return panel.sparkSession.createDataFrame(rows, "t int, period int")


def _presence(panel: DataFrame) -> DataFrame:
    """id, seen: the sorted distinct t of each account; one shuffle, and an array as long as the panel has periods at most."""
    return panel.groupBy("id").agg(F.sort_array(F.collect_set(F.col("t").cast("int"))).alias("seen"))


def _gaps(seen: str) -> Column:
    """The absences between neighbours in a sorted array: structs of t_left and t_back."""
    pairs = F.transform(F.slice(seen, F.lit(2), F.greatest(F.size(seen) - 1, F.lit(0))), lambda back, i: F.struct(F.get(seen, i).alias("t_left"), back.alias("t_back")))
    return F.filter(pairs, lambda g: g["t_back"] > g["t_left"] + 1)


def episodes(panel: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """id, t_left (last seen), t_back, duration, period_left (first month away), period_back, month_left, month_back.

    The last disappearance of an account is none: it may be for good. ``months``: a ``month_table`` of the panel, if there is one already.
    """
    months = month_table(panel) if months is None else months
    gaps = _presence(panel).select("id", F.explode(_gaps("seen")).alias("g")).select("id", "g.t_left", "g.t_back").withColumn("t_away", F.col("t_left") + 1)
    # a row a period on the other side
    left = F.broadcast(months.select(F.col("t").alias("t_away"), F.col("period").alias("period_left")))
    back = F.broadcast(months.select(F.col("t").alias("t_back"), F.col("period").alias("period_back")))
    out = gaps.join(left, "t_away", "left").join(back, "t_back", "left")
    return out.select(
        "id", "t_left", "t_back", (F.col("t_back") - F.col("t_left") - 1).alias("duration"), "period_left", "period_back", month_of(F.col("period_left")).alias("month_left"), month_of(F.col("period_back")).alias("month_back")
    )


def near_months(months: Column) -> Column:
    """Whether one of the months has all others within one month of it, around the year; true for one or none."""
    near = lambda a, b: F.least(F.pmod(a - b, F.lit(12)), F.pmod(b - a, F.lit(12))) <= 1
    return (F.size(months) <= 1) | F.exists(months, lambda a: F.forall(months, lambda b: near(a, b)))


def account_seasonality(pauses: DataFrame, rules: SeasonRules = SeasonRules()) -> DataFrame:  # noqa: B008
    """One row an account that ever paused: n_pauses, mean_duration (1 decimal), total_duration, modal months (ties to the smallest), same_month, signature, is_seasonal, kind."""
    own = pauses.groupBy("id").agg(
        F.count("*").alias("n_pauses"),
        F.bround(F.avg("duration"), 1).alias("mean_duration"),
        F.sum("duration").alias("total_duration"),
        F.mode("month_left", True).alias("modal_left"),
        F.mode("month_back", True).alias("modal_back"),
        near_months(F.collect_set("month_left")).alias("same_month"),
    )
    signature = F.col("modal_left").isin(*LOW_SEASON) & F.col("modal_back").isin(*HIGH_SEASON) & F.col("mean_duration").between(rules.shortest, rules.longest)
    recurrent = F.col("n_pauses") >= rules.min_pauses
    own = own.withColumn("signature", signature)
    seasonal = recurrent | F.col("signature") if rules.signature_suffices else recurrent
    kind = F.when(F.col("signature"), "season").when(recurrent, "intermittent").otherwise("-")
    return own.withColumns({"is_seasonal": seasonal, "kind": kind})


def seasonal_ids(pauses: DataFrame, rules: SeasonRules = SeasonRules()) -> DataFrame:  # noqa: B008
    return account_seasonality(pauses, rules).filter("is_seasonal").select("id")


EVENTS = ("churn", "pause", "return", "new")
#: The names of the months.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def month_name(month: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), month - 1)


def monthly_profile(panel: DataFrame, min_future: int = 3) -> DataFrame:
    """event, month, n, coverage, pct, index: churn, pause, return and new accounts by calendar month, all 48 cells.

    ``index`` is the rate per chance to see the event in that month over the overall rate: a panel rarely covers whole years. The panel is
    read for its periods, and once more for all events of an account from the sorted months in which it was seen.
    """
    spark = panel.sparkSession
    months = {r["t"]: r["period"] % 100 for r in month_table(panel).collect()}
    last = max(months, default=0) - 1
    first, end = F.get("seen", F.lit(0)), F.get("seen", F.size("seen") - 1)
    event = lambda name, t: F.struct(F.lit(name).alias("event"), t.cast("int").alias("t"))
    found = F.flatten(F.array(
        F.transform(_gaps("seen"), lambda g: event("pause", g["t_left"] + 1)),
        F.transform(_gaps("seen"), lambda g: event("return", g["t_back"])),
        F.when(end <= last - min_future, F.array(event("churn", end + 1))).otherwise(F.array().cast("array<struct<event:string,t:int>>")),
        F.when(first > 0, F.array(event("new", first))).otherwise(F.array().cast("array<struct<event:string,t:int>>")),
    ))
    counts = _presence(panel).select(F.explode(found).alias("e")).groupBy("e.event", "e.t").agg(F.count("*").alias("c"))
    chances = {"churn": (1, last - min_future + 1), "pause": (1, last - 1), "return": (2, last), "new": (1, last)}
    # a row an event and period
    grid = spark.createDataFrame([(e, t, m, int(low <= t <= high)) for e, (low, high) in chances.items() for t, m in months.items()], "event string, t int, month int, chance int")
    cells = spark.createDataFrame([(e, m) for e in EVENTS for m in range(1, 13)], "event string, month int")
    seen = grid.join(counts, ["event", "t"], "left").groupBy("event", "month").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum("chance").alias("coverage"))
    full = cells.join(seen, ["event", "month"], "left").fillna(0, ["n", "coverage"])
    by = Window.partitionBy("event")
    expected = F.col("coverage") * (F.sum("n").over(by) / F.nullif(F.sum("coverage").over(by), F.lit(0)))
    return full.select("event", "month", "n", "coverage", (F.col("n") * 100.0 / F.greatest(F.sum("n").over(by), F.lit(1))).alias("pct"), F.when(expected > 0, F.col("n") / expected).alias("index"))


def leading_months(profile: DataFrame, top: int = 3) -> DataFrame:
    """event, place, month, name, n: of each event the months with the most, ties to the earlier month."""
    place = F.row_number().over(Window.partitionBy("event").orderBy(F.desc("n"), "month"))
    return profile.withColumn("place", place).filter(F.col("place") <= top).select("event", "place", "month", month_name(F.col("month")).alias("name"), "n")


def longest_pausers(profile: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` rows of ``account_seasonality`` by signature, pauses and time away, most first, ties by id."""
    return profile.orderBy(F.desc("signature"), F.desc("n_pauses"), F.desc("total_duration"), "id").limit(top)


def by_country(panel: DataFrame, min_accounts: int = 300) -> DataFrame:
    """country, accounts, paused, paused_pct, low_season_pct: an account counts where it was ever seen, its pauses in its last country."""
    last = panel.filter("country IS NOT NULL").groupBy("id").agg(F.max_by("country", "t").alias("country"))
    pauses = episodes(panel).join(last, "id", "left")
    total = panel.groupBy("country").agg(F.count_distinct("id").alias("accounts"))
    paused = pauses.groupBy("country").agg(F.count_distinct("id").alias("paused"), (F.avg(F.col("month_left").isin(*LOW_SEASON).cast("int")) * 100).alias("low_season_pct"))
    joined = total.join(paused, "country", "full_outer").fillna(0, ["accounts", "paused"]).filter(F.col("accounts") >= min_accounts)
    return joined.select("country", "accounts", "paused", (F.col("paused") * 100.0 / F.col("accounts")).alias("paused_pct"), "low_season_pct")


def recurrence(panel: DataFrame) -> DataFrame:
    """One row: accounts, paused_once, paused_twice, ratio: of the accounts that paused, the share that paused again."""
    own = episodes(panel).groupBy("id").agg(F.count("*").alias("n"))
    counts = own.agg(F.count("*").alias("paused_once"), F.count_if(F.col("n") >= 2).alias("paused_twice"))
    accounts = panel.agg(F.count_distinct("id")).scalar()
    return counts.select(accounts.alias("accounts"), "paused_once", "paused_twice", (F.col("paused_twice") / F.col("paused_once")).alias("ratio"))


def causal_flags(panel: DataFrame, period: int, rules: SeasonRules = SeasonRules()) -> DataFrame:  # noqa: B008
    """id, n_pauses, mean_duration, usual_month, is_seasonal for the accounts of one period, from what was known by then: no later row is looked at."""
    known = panel.filter(F.col("period") <= period)
    own = account_seasonality(episodes(known), rules).select("id", "n_pauses", "mean_duration", F.col("modal_left").alias("usual_month"), "is_seasonal")
    out = panel.filter(F.col("period") == period).select("id").join(own, "id", "left")
    return out.select("id", F.coalesce("n_pauses", F.lit(0)).alias("n_pauses"), "mean_duration", "usual_month", F.coalesce("is_seasonal", F.lit(False)).alias("is_seasonal"))
