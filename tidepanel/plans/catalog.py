"""The queries of the engine's own operators on panels of the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import plan_codes
from tidepanel.operators import attribution, drift, explain, features, labels, learning, metrics, panel, pauses, prepare, promotion, ranks, report, risk, scoring, serving, split
from tidepanel.plans.sql_parts import CALENDAR, CM, EPISODES, LAB, PLAN, SCORE, SEASONALITY, SEVERITY, SM, UD, labelled, query
from tidepanel.sources import adapters, files
from tidepanel.sources.adapters import SALES
from tidepanel.sources.prices import PriceBook, unpriced

Query = Callable[[SparkSession, str], DataFrame]

PLAN_PRICES = {"ini": {"ar": 10.0, "mx": 12.5}, "st": {"ar": 20.0, "mx": None, "br": 22.25}, "adv": {"ar": 31.4}, "fu": {"ar": 99.0}}
MODULE_PRICES = {"tbl": {"ar": 3.25, "cl": 3.5}, "dv": {"ar": 4.1}, "kds": {"mx": 5.0}}
DEFAULT_MARKET = "ar"
BOOK = PriceBook(PLAN_PRICES, MODULE_PRICES, "USD", DEFAULT_MARKET)
PRICE_SQL = (
    "CASE k WHEN 'ini' THEN CASE m WHEN 'mx' THEN 12.5 ELSE 10.0 END WHEN 'st' THEN CASE m WHEN 'br' THEN 22.25 ELSE 20.0 END WHEN 'adv' THEN 31.4 WHEN 'fu' THEN 99.0 END",
    "CASE k WHEN 'tbl' THEN CASE m WHEN 'cl' THEN 3.5 ELSE 3.25 END WHEN 'dv' THEN 4.1 WHEN 'kds' THEN CASE m WHEN 'mx' THEN 5.0 END END",
)
REVENUE = f"""
priced AS (
  SELECT *, coalesce(CASE WHEN base IS NOT NULL THEN (SELECT {PRICE_SQL[0]} FROM (SELECT base AS k, market AS m)) END, 0)::DOUBLE AS base_price,
    list_transform(modules, lambda k: {PRICE_SQL[1].replace("CASE m ", "CASE market ")}) AS module_prices FROM plans
), revs AS (
  SELECT *, (base_price + coalesce(list_sum(module_prices), 0))::DOUBLE AS revenue,
    list_concat(CASE WHEN base IN ('ba', 'pr', 'pro') THEN [base] ELSE [] END, list_filter(modules, lambda k: k IN ('idvsls', 'fi', 'fe', 'sbw', 'top') OR (k = 'kds' AND coalesce(market, '') <> 'mx'))) AS missing FROM priced
)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.dense_index(adapters.customer_months(spark, sf_dir))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.dense_index(adapters.supplier_months(spark, sf_dir))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.dense_index(adapters.user_days(spark, sf_dir))


def customers_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label(customers(spark, sf_dir))


def with_score(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", ((F.col("id") * 7919 + F.col("t") * 104729) % 1000) / 1000.0)


def six(x: Column) -> Column:
    return F.round(x, 6)


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Panel


@register(query(CM, body="SELECT period, t, count(*) AS rows FROM cm GROUP BY period, t"))
def dense_period_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).groupBy("period", "t").agg(F.count("*").alias("rows"))


QUARTERS = (1, 4, 7, 10)
_MISSING = "SELECT (y * 100 + m)::INTEGER AS period FROM range(1900, 2100) a(y), range(1, 13) b(m) WHERE y * 100 + m BETWEEN (SELECT min(period) FROM own) AND (SELECT max(period) FROM own) AND y * 100 + m NOT IN (SELECT period FROM own)"


@register(query(CM, body=f"SELECT * FROM (WITH own AS (SELECT period FROM cm WHERE period % 100 IN {QUARTERS}) {_MISSING})"))
def missing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What quarterly snapshots of the customers lack of a monthly panel."""
    own = adapters.customer_months(spark, sf_dir)
    return panel.missing_periods(own.filter(panel.month_of(F.col("period")).isin(*QUARTERS)))


@register(f"WITH own AS (SELECT (year(o_orderdate) * 100 + month(o_orderdate))::INTEGER AS period FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') {_MISSING}")
def missing_periods_of_pending_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months without any urgent order that is still pending."""
    own = adapters.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    return panel.missing_periods(own.select(adapters.month_period(F.col("o_orderdate")).alias("period")))


@register(query(CM, body="SELECT id, period, CASE WHEN d >= 0 AND d < 400 THEN d END AS tenure_months FROM (SELECT id, period, floor(date_diff('second', created, make_date(period // 100, period % 100, 1)::TIMESTAMP) / 86400) / 30.44::DOUBLE AS d FROM cm)"))
def tenure_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = adapters.customer_months(spark, sf_dir)
    return own.select("id", "period", panel.tenure_months(F.col("period"), F.col("created")).alias("tenure_months"))


@register(query(CM, body=f"SELECT coalesce(state, 'none') AS state, ({SEVERITY})::INTEGER AS severity, count(*) AS rows FROM cm GROUP BY 1, 2"))
def status_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = adapters.customer_months(spark, sf_dir).select(F.coalesce("state", F.lit("none")).alias("state"), panel.severity(F.col("state")).alias("severity"))
    return own.groupBy("state", "severity").agg(F.count("*").alias("rows"))


@register("""
SELECT id, period, amount FROM (
  SELECT *, row_number() OVER (PARTITION BY id, period ORDER BY file DESC, place DESC) AS n FROM (
    SELECT o_custkey AS id, (year(o_orderdate) * 100 + month(o_orderdate))::INTEGER AS period, o_orderkey % 3 AS file, o_orderkey AS place, o_totalprice AS amount FROM orders)) WHERE n = 1""")
def last_file_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshot rows of three files: of each customer and month the row last by file and place stays."""
    o = adapters.table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("id"), adapters.month_period(F.col("o_orderdate")).alias("period"), (F.col("o_orderkey") % 3).alias("file"), F.col("o_orderkey").alias("place"), F.col("o_totalprice").alias("amount"))
    return panel.last_wins(rows, ["file", "place"]).select("id", "period", "amount")


@register(query(CM, CALENDAR, body="SELECT t, period FROM cal"))
def calendar_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.calendar(customers(spark, sf_dir))


# Labels

LABELS_BODY = "SELECT id, period, t, churn, is_ambiguous, is_labelable, months_in_panel FROM lab"
LABEL_COLUMNS = ["id", "period", "t", "churn", "is_ambiguous", "is_labelable", "months_in_panel"]


@register(query(LAB, body=LABELS_BODY))
def churn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_labelled(spark, sf_dir).select(LABEL_COLUMNS)


@register(query(CM, labelled("cm", "lab", policy="negative"), body=LABELS_BODY))
def churn_labels_negative_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label(customers(spark, sf_dir), policy="negative").select(LABEL_COLUMNS)


@register(query(UD, labelled("ud", "lab", window=2), body=LABELS_BODY))
def churn_labels_user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label(users(spark, sf_dir), window=2).select(LABEL_COLUMNS)


@register(query(LAB, body="SELECT count(*) AS rows, count(churn) AS labelled, coalesce(avg(churn), 0) AS churn_rate, count(*) FILTER (WHERE is_ambiguous) AS ambiguous, avg(is_ambiguous::INT) AS ambiguous_share FROM lab"))
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_summary(customers_labelled(spark, sf_dir))


@register(query(LAB, body="SELECT period, count(*) AS accounts, avg(churn) * 100 AS churn_rate FROM lab WHERE churn IS NOT NULL GROUP BY period"))
def churn_rate_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.churn_rate_by_period(customers_labelled(spark, sf_dir))


@register(query(LAB, body="SELECT months_in_panel, count(*) AS rows FROM lab GROUP BY months_in_panel"))
def months_in_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_labelled(spark, sf_dir).groupBy("months_in_panel").agg(F.count("*").alias("rows"))


@register(query(CM, body="SELECT id, min(t) AS first_t, max(t) AS last_t, count(DISTINCT t) AS periods, max(t) - min(t) + 1 - count(DISTINCT t) AS gaps FROM cm GROUP BY id"))
def presence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.presence_gaps(customers(spark, sf_dir))


@register(query(CM, body="SELECT count(*) AS disappearances, count(n) AS returned, count(n) / count(*) AS share FROM (SELECT t, lead(t) OVER (PARTITION BY id ORDER BY t) AS n, max(t) OVER () AS last FROM cm) WHERE t < last AND (n IS NULL OR n > t + 1)"))
def naive_return_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.naive_return_share(customers(spark, sf_dir))


# Pauses and seasonality


@register(query(CM, EPISODES, body="SELECT * FROM ep"))
def pause_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses.episodes(customers(spark, sf_dir))


PROFILE_COLUMNS = "id, n_pauses, mean_duration, total_duration, modal_left, modal_back, same_month, signature, is_seasonal, kind"


@register(query(CM, EPISODES, SEASONALITY, body=f"SELECT {PROFILE_COLUMNS} FROM prof"))
def account_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses.account_seasonality(pauses.episodes(customers(spark, sf_dir)))


@register(query(CM, EPISODES, SEASONALITY, body="SELECT id FROM prof WHERE is_seasonal"))
def seasonal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses.seasonal_ids(pauses.episodes(customers(spark, sf_dir)))


@register(query(CM, EPISODES, body="""
, ends AS (SELECT id, min(t) AS a, max(t) AS z FROM cm GROUP BY id), mx AS (SELECT max(t) AS x FROM cm), seen AS (
  SELECT 'churn' AS event, z + 1 AS t FROM ends, mx WHERE z <= x - 3 UNION ALL SELECT 'pause', t_left + 1 FROM ep UNION ALL SELECT 'return', t_back FROM ep UNION ALL SELECT 'new', a FROM ends WHERE a > 0
), chance AS (
  SELECT e AS event, period % 100 AS month, count(*) AS coverage FROM cal, mx, (VALUES ('churn'), ('pause'), ('return'), ('new')) v(e)
  WHERE CASE e WHEN 'churn' THEN t BETWEEN 1 AND x - 2 WHEN 'pause' THEN t >= 1 AND t < x WHEN 'return' THEN t BETWEEN 2 AND x ELSE t BETWEEN 1 AND x END GROUP BY 1, 2
), n AS (SELECT event, period % 100 AS month, count(*) AS n FROM seen JOIN cal USING (t) GROUP BY 1, 2
), cell AS (
  SELECT e AS event, m AS month, coalesce(n, 0) AS n, coalesce(coverage, 0) AS coverage FROM (VALUES ('churn'), ('pause'), ('return'), ('new')) v(e) CROSS JOIN range(1, 13) r(m)
  LEFT JOIN n ON n.event = e AND n.month = m LEFT JOIN chance ON chance.event = e AND chance.month = m
), full_cell AS (SELECT *, sum(n) OVER (PARTITION BY event) AS all_n, sum(coverage) OVER (PARTITION BY event) AS all_c FROM cell)
SELECT event, month::INTEGER AS month, n, coverage, round(n * 100.0 / greatest(all_n, 1), 6) AS pct, round(CASE WHEN coverage * all_n > 0 THEN n / (coverage * (all_n / all_c)) END, 6) AS index FROM full_cell""".replace("\n, ends", ", ends", 1)).replace(")\n, ends", "), ends"))
def monthly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses.monthly_profile(customers(spark, sf_dir)).withColumns({"pct": six(F.col("pct")), "index": six(F.col("index"))})


@register(query(CM, EPISODES, body=""", home AS (SELECT id, arg_max(country, t) AS country FROM cm WHERE country IS NOT NULL GROUP BY id),
a AS (SELECT country, count(DISTINCT id) AS accounts FROM cm GROUP BY country),
p AS (SELECT country, count(DISTINCT id) AS paused, avg((month_left IN (4, 5, 6, 7))::INT) * 100 AS low_season_pct FROM ep LEFT JOIN home USING (id) GROUP BY country)
SELECT country, coalesce(accounts, 0) AS accounts, coalesce(paused, 0) AS paused, coalesce(paused, 0) * 100.0 / accounts AS paused_pct, low_season_pct FROM a FULL JOIN p USING (country) WHERE accounts >= 3""".lstrip()))
def seasonality_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses.by_country(customers(spark, sf_dir), min_accounts=3)


@register(query(CM, EPISODES, body="SELECT (SELECT count(DISTINCT id) FROM cm) AS accounts, count(*) AS paused_once, count(*) FILTER (WHERE n >= 2) AS paused_twice, count(*) FILTER (WHERE n >= 2) / count(*) AS ratio FROM (SELECT id, count(*) AS n FROM ep GROUP BY id)"))
def pause_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses.recurrence(customers(spark, sf_dir))


@register(query(CM.replace("FROM orders GROUP BY 1, 2", "FROM orders WHERE year(o_orderdate) * 100 + month(o_orderdate) <= 199806 GROUP BY 1, 2"), EPISODES, SEASONALITY, body="SELECT cm.id, coalesce(n_pauses, 0) AS n_pauses, mean_duration, modal_left AS usual_month, coalesce(is_seasonal, false) AS is_seasonal FROM cm LEFT JOIN prof USING (id) WHERE period = 199806"))
def causal_pause_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses.causal_flags(customers(spark, sf_dir), 199806)


# Features


@register(query(CM, body="""SELECT id, period, sales_total, active_channels, delivery_ratio, salon_ratio, additions_total, no_sales, features_in_use FROM (
  SELECT *, (coalesce(sales_high, 0) + coalesce(sales_medium, 0)) / nullif(sales_total, 0) AS delivery_ratio, coalesce(sales_urgent, 0) / nullif(sales_total, 0) AS salon_ratio, (sales_total <= 0)::INT AS no_sales FROM (
    SELECT *, 0.0::DOUBLE + coalesce(sales_urgent, 0) + coalesce(sales_high, 0) + coalesce(sales_medium, 0) + coalesce(sales_other, 0) + coalesce(sales_low, 0) AS sales_total, orders::DOUBLE AS additions_total,
      (coalesce(sales_urgent, 0) > 0)::INT + (coalesce(sales_high, 0) > 0)::INT + (coalesce(sales_medium, 0) > 0)::INT + (coalesce(sales_other, 0) > 0)::INT + (coalesce(sales_low, 0) > 0)::INT AS active_channels,
      (coalesce(sales_urgent, 0) > 0)::INT + (coalesce(orders, 0) > 0)::INT AS features_in_use FROM cm))"""))
def sales_totals_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.sales_mix(adapters.customer_months(spark, sf_dir), list(SALES), ["orders", "not there"], ["sales_high", "sales_medium"], "sales_urgent", ["sales_urgent", "orders"])
    return out.select("id", "period", "sales_total", "active_channels", "delivery_ratio", "salon_ratio", "additions_total", "no_sales", "features_in_use")


@register(query(CM, body="""SELECT id, period, CASE WHEN r1 IS NOT NULL THEN least(greatest(r1, 0), 5) END AS high_to_urgent, CASE WHEN r2 IS NOT NULL THEN least(greatest(r2, 0), 5) END AS low_to_other
FROM (SELECT id, period, sales_high / nullif(sales_urgent, 0) AS r1, sales_low / nullif(sales_other, 0) AS r2 FROM cm)"""))
def config_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = features.config_ratios(adapters.customer_months(spark, sf_dir), {"high_to_urgent": ("sales_high", "sales_urgent"), "low_to_other": ("sales_low", "sales_other"), "left_out": ("sales_low", "not there")})
    return own.select("id", "period", "high_to_urgent", "low_to_other")


@register(query(CM, PLAN, body="SELECT id, period, coalesce(base, 'unknown') AS plan_base, coalesce(market, 'unknown') AS plan_market, plan_rank, len(modules) AS plan_modules, " + ", ".join(f"list_contains(modules, '{m}')::INT AS plan_module_{m}" for m in ("tbl", "dv", "idvsls", "kds", "fi", "fe", "sbw", "top")) + " FROM plans"))
def plan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.plan_features(adapters.customer_months(spark, sf_dir))
    return out.select("id", "period", *[c for c in out.columns if c.startswith("plan_")])


@register(query(CM, body=f"""SELECT id, t, severity, max(severity) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS severity_max_3m, coalesce(severity - lag(severity) OVER w, 0) AS severity_delta_1m,
  CASE WHEN severity > 0 THEN sum((severity > 0)::INT) OVER (PARTITION BY id, block ORDER BY t) ELSE 0 END AS debt_streak
FROM (SELECT *, sum((severity = 0)::INT) OVER (PARTITION BY id ORDER BY t) AS block FROM (SELECT id, t, {SEVERITY} AS severity FROM cm)) WINDOW w AS (PARTITION BY id ORDER BY t)"""))
def billing_state_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.state_features(customers(spark, sf_dir)).select("id", "t", "severity", "severity_max_3m", "severity_delta_1m", "debt_streak")


def _lags_sql(panel_name: str, metrics_: list[str], core: list[str]) -> str:
    """The temporal features in SQL, by self-joins, so that a different plan stands against the windows."""
    out = []
    for m in metrics_:
        mean = f"(coalesce(a.{m}, 0) + coalesce(b.{m}, 0) + coalesce(c.{m}, 0)) / nullif((a.{m} IS NOT NULL)::INT + (b.{m} IS NOT NULL)::INT + (c.{m} IS NOT NULL)::INT, 0)"
        out += [f"a.{m}::DOUBLE AS {m}_lag_1", f"b.{m}::DOUBLE AS {m}_lag_2", f"c.{m}::DOUBLE AS {m}_lag_3", f"round((x.{m} - a.{m})::DOUBLE, 4) AS {m}_delta_1m"]
        out.append(f"round(CASE WHEN x.{m} / nullif({mean}, 0) IS NOT NULL THEN least(greatest(x.{m} / nullif({mean}, 0), 0), 10) END, 4) AS {m}_ratio_3m")
        if m in core:
            out += [f"round((x.{m} - c.{m})::DOUBLE, 4) AS {m}_delta_3m", f"round((-1.5::DOUBLE * c.{m} - 0.5::DOUBLE * b.{m} + 0.5::DOUBLE * a.{m} + 1.5::DOUBLE * x.{m}) / 5, 4) AS {m}_slope_3m"]
    joins = " ".join(f"LEFT JOIN {panel_name} {n} ON {n}.id = x.id AND {n}.t = x.t - {k}" for n, k in (("a", 1), ("b", 2), ("c", 3)))
    return f"SELECT x.id, x.t, {', '.join(out)} FROM {panel_name} x {joins}"


def _temporal(own: DataFrame, metrics_: list[str], core: list[str]) -> DataFrame:
    out = features.temporal(own.select("id", "t", *metrics_), metrics_, core)
    keep = [c for c in out.columns if c not in metrics_]
    return out.select([F.round(c, 4).alias(c) if c.endswith("m") and c != "m" else F.col(c) for c in keep])


@register(query(CM, body=_lags_sql("cm", ["sales_urgent", "orders"], [])))
def lag_delta_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _temporal(customers(spark, sf_dir), ["sales_urgent", "orders"], [])


@register(query(SM, body=_lags_sql("sm", ["quantity", "amount"], ["quantity", "amount"])))
def delta_slope_3m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _temporal(suppliers(spark, sf_dir), ["quantity", "amount"], ["quantity", "amount"])


@register(query(CM, PLAN, body="""SELECT id, t, months_since_first, greatest(months_since_first + 1 - n, 0) AS prior_pauses, plan_changed, plan_rank_delta, plan_modules_delta, (plan_rank_delta < 0 OR plan_modules_delta < 0)::INT AS plan_downgrade FROM (
  SELECT id, t, t - min(t) OVER (PARTITION BY id) AS months_since_first, row_number() OVER w AS n, coalesce(plan <> lag(plan) OVER w, false)::INT AS plan_changed,
    coalesce(plan_rank - lag(plan_rank) OVER w, 0) AS plan_rank_delta, coalesce(len(modules) - lag(len(modules)) OVER w, 0) AS plan_modules_delta FROM plans WINDOW w AS (PARTITION BY id ORDER BY t))"""))
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = features.history(features.plan_features(customers_labelled(spark, sf_dir)))
    return own.select("id", "t", "months_since_first", "prior_pauses", "plan_changed", "plan_rank_delta", "plan_modules_delta", "plan_downgrade")


# Plans, prices, risk


@register(query(CM, PLAN, body="SELECT id, period, base, market, array_to_string(modules, '+') AS modules, array_to_string(unknown, '+') AS unknown, plan_rank FROM plans"))
def plan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = adapters.customer_months(spark, sf_dir).withColumn("p", plan_codes.parse(F.col("plan")))
    return own.select("id", "period", "p.base", "p.market", F.array_join("p.modules", "+").alias("modules"), F.array_join("p.unknown", "+").alias("unknown"), plan_codes.rank(F.col("p.base")).alias("plan_rank"))


@register(query(CM, PLAN, REVENUE, body="SELECT id, period, round(revenue, 2) AS revenue, array_to_string(missing, ',') AS missing FROM revs"))
def plan_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = risk.revenues(adapters.customer_months(spark, sf_dir), PLAN_PRICES, MODULE_PRICES, DEFAULT_MARKET)
    return own.select("id", "period", "revenue", F.array_join("missing", ",").alias("missing"))


@register(query(CM, PLAN, REVENUE, body="SELECT coalesce(plan, '') AS plan, count(*) AS accounts, round(max(revenue), 2) AS revenue, len(any_value(missing)) = 0 AS complete, array_to_string(any_value(missing), ',') AS missing FROM revs GROUP BY 1"))
def pricing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.coverage(adapters.customer_months(spark, sf_dir), PLAN_PRICES, MODULE_PRICES, DEFAULT_MARKET)


@register(query(CM, body="SELECT token, count(*) AS accounts FROM (SELECT DISTINCT id, period, unnest(string_split(lower(trim(plan)), '-')) AS token FROM cm) WHERE token <> '' GROUP BY token"))
def plan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.token_counts(adapters.customer_months(spark, sf_dir))


RISK = f"""
risk AS (
  SELECT id, t, period, country, p AS churn_probability, v AS monthly_revenue, round_even(p * v, 2) AS revenue_at_risk,
    CASE WHEN p < 0.324 THEN 'no_churn' WHEN p * v >= 40 THEN 'alto' WHEN p * v >= 15 THEN 'medio' ELSE 'bajo' END AS risk_category, (p >= 0.324)::INT AS will_churn
  FROM (SELECT id, t, period, country, {SCORE} AS p, orders * 24.0::DOUBLE AS v FROM cm)
)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = with_score(customers(spark, sf_dir)).select("id", "t", "period", "country", F.col("score").alias("probability"), (F.col("orders") * 24.0).alias("revenue"))
    return risk.assign(own)


@register(query(CM, RISK, body="SELECT * FROM risk"))
def risk_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@register(query(CM, RISK, body="SELECT c AS risk_category, count(id) AS accounts, round(coalesce(avg(churn_probability) * 100, 0), 6) AS mean_probability, coalesce(sum(monthly_revenue), 0) AS revenue, round(coalesce(sum(revenue_at_risk), 0), 4) AS at_risk FROM (VALUES ('no_churn'), ('bajo'), ('medio'), ('alto')) v(c) LEFT JOIN risk ON risk_category = c GROUP BY c"))
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.summary(_scored(spark, sf_dir)).withColumns({"mean_probability": six(F.col("mean_probability")), "at_risk": F.round("at_risk", 4)})


@register(query(CM, RISK, body="SELECT id, t, revenue_at_risk, country, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY revenue_at_risk DESC NULLS LAST, id, t) AS place FROM risk) WHERE place <= 3"))
def top_risk_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scored(spark, sf_dir).withColumn("id2", F.col("id")).withColumn("id", F.struct("id", "t"))
    return risk.ranked_within(own, "country", 3).select(F.col("id2").alias("id"), "t", "revenue_at_risk", "country", "place")


# Report


@register(query(CM, body="SELECT count(*) AS rows, count(DISTINCT id) AS accounts, count(DISTINCT period) AS periods, min(period) AS first_period, max(period) AS last_period FROM cm"))
def panel_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.header(adapters.customer_months(spark, sf_dir))


SERIES = """
series AS (
  SELECT period, count(*) AS active, CASE WHEN period = (SELECT min(period) FROM lab) THEN 0 ELSE count(*) FILTER (WHERE months_in_panel = 1) END AS new,
    sum(churn)::BIGINT AS churned, nullif(count(churn), 0) AS evaluable, sum(churn) * 100.0 / nullif(count(churn), 0) AS churn_rate FROM lab GROUP BY period
)"""


@register(query(LAB, SERIES, body="SELECT * FROM series"))
def base_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.base_series(customers_labelled(spark, sf_dir))


@register(query(LAB, SERIES, body="""SELECT active_first, active_last, new_total, churned_total, labelled, unlabelled_periods, churn_rate_min, churn_rate_max, (SELECT count(*) FROM lab WHERE is_ambiguous) AS ambiguous,
  round((active_last / active_first - 1) * 100, 6) AS growth, round((pow(active_last / active_first, 1 / nullif(months, 0)) - 1) * 100, 6) AS monthly_growth, round(r * 100, 6) AS churn_rate, round(pow(1 - r, 12) * 100, 6) AS yearly_retention, round(1 / nullif(r, 0), 6) AS mean_life
FROM (SELECT *, churned_total / labelled AS r FROM (SELECT arg_min(active, period) AS active_first, arg_max(active, period) AS active_last, count(*) - 1 AS months, sum(new)::BIGINT AS new_total, sum(churned)::BIGINT AS churned_total, sum(evaluable)::BIGINT AS labelled,
  min(churn_rate) AS churn_rate_min, max(churn_rate) AS churn_rate_max, count(*) FILTER (WHERE evaluable IS NULL) AS unlabelled_periods FROM series))"""))
def base_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = report.base_scalars(customers_labelled(spark, sf_dir))
    return own.withColumns({c: six(F.col(c)) for c in ("growth", "monthly_growth", "churn_rate", "yearly_retention", "mean_life")})


@register(query(LAB, body="""SELECT country, accounts, accounts * 100.0 / total AS base_pct, CASE WHEN n >= 100 THEN rate * 100 END AS churn_rate FROM (
  SELECT coalesce(country, 'unknown') AS country, count(*) AS accounts, sum(count(*)) OVER () AS total FROM lab WHERE period = (SELECT max(period) FROM lab) GROUP BY 1)
LEFT JOIN (SELECT coalesce(country, 'unknown') AS country, count(churn) AS n, avg(churn) AS rate FROM lab GROUP BY 1) USING (country) ORDER BY accounts DESC, country LIMIT 8"""))
def country_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.country_mix(customers_labelled(spark, sf_dir))


def _each(body: str, names: tuple[str, ...] = SALES) -> str:
    return " UNION ALL ".join(body.replace("$", m) for m in names)


@register(query(CM, body=_each("SELECT '$' AS metric, count(*) FILTER (WHERE $ > 0) AS accounts, count(*) FILTER (WHERE $ > 0) * 100.0 / count(*) AS pct, median($) FILTER (WHERE $ > 0) AS median_of_users FROM cm WHERE period = (SELECT max(period) FROM cm)")))
def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.adoption(adapters.customer_months(spark, sf_dir), list(SALES))


@register(query(CM, body=_each("SELECT '$' AS metric, " + ", ".join(f"round(quantile_cont($, {v}), 4) AS {k}" for k, v in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))) + " FROM cm WHERE period = (SELECT max(period) FROM cm)")))
def volume_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.volumes(adapters.customer_months(spark, sf_dir), list(SALES))
    return out.select("metric", *[F.round(c, 4).alias(c) for c in ("p25", "median", "p75", "p95")])


@register(query(LAB, body=_each("SELECT '$' AS metric, stay * 100 AS stay_pct, gone * 100 AS churn_pct, gone / nullif(stay, 0) AS lift, stay_median, churn_median, round(ratio, 4) AS median_ratio FROM (SELECT median($) FILTER (WHERE churn = 1) / nullif(median($) FILTER (WHERE churn = 0), 0) AS ratio, avg(CASE WHEN churn = 0 THEN (coalesce($, 0) > 0)::INT END) AS stay, avg(CASE WHEN churn = 1 THEN (coalesce($, 0) > 0)::INT END) AS gone, round(median($) FILTER (WHERE churn = 0), 4) AS stay_median, round(median($) FILTER (WHERE churn = 1), 4) AS churn_median FROM lab)")))
def usage_vs_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.usage_vs_churn(customers_labelled(spark, sf_dir), list(SALES))
    return out.withColumns({c: F.round(c, 4) for c in ("stay_median", "churn_median", "median_ratio")})


@register(query(LAB, body="SELECT coalesce(state, 'unknown') AS state, count(*) AS accounts, avg(churn) * 100 AS churn_rate FROM lab WHERE churn IS NOT NULL GROUP BY 1 HAVING count(*) >= 100"))
def churn_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.churn_by(customers_labelled(spark, sf_dir), F.coalesce("state", F.lit("unknown")), "state")


@register(query(LAB, body="""SELECT CASE WHEN m >= 48 THEN '4+ years' WHEN m >= 24 THEN '2-4 years' WHEN m >= 12 THEN '1-2 years' WHEN m >= 6 THEN '6-12 months' WHEN m >= 3 THEN '3-6 months' WHEN m >= 0 THEN '0-3 months' END AS bucket, count(*) AS accounts, avg(churn) * 100 AS churn_rate
FROM (SELECT churn, CASE WHEN d >= 0 AND d < 400 THEN d END AS m FROM (SELECT churn, floor(date_diff('second', created, make_date(period // 100, period % 100, 1)::TIMESTAMP) / 86400) / 30.44::DOUBLE AS d FROM lab WHERE churn IS NOT NULL)) GROUP BY 1 HAVING count(*) >= 100"""))
def churn_by_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenure = panel.tenure_months(F.col("period"), F.col("created"))
    return report.churn_by(customers_labelled(spark, sf_dir), report.tenure_bucket(tenure), "bucket")


@register(query(LAB, body="SELECT state, avg((churn = 0)::INT) AS active_share, avg((churn = 1)::INT) AS churn_share FROM lab WHERE churn IS NOT NULL GROUP BY state"))
def state_churn_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.crosstab(customers_labelled(spark, sf_dir), "state")


@register(query(CM, PLAN, labelled("plans", "plab"), body="SELECT coalesce(base, 'unknown') AS plan_base, count(*) AS accounts, avg(churn) * 100 AS churn_rate FROM plab WHERE churn IS NOT NULL GROUP BY 1 HAVING count(*) >= 100"))
def churn_by_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.churn_by(features.plan_features(customers_labelled(spark, sf_dir)), F.col("plan_base"), "plan_base")


@register(query(CM, EPISODES, SEASONALITY, body="SELECT count(*) AS paused, count(*) FILTER (WHERE is_seasonal) AS seasonal, count(*) FILTER (WHERE is_seasonal) * 100.0 / (SELECT count(DISTINCT id) FROM cm) AS seasonal_pct FROM prof"))
def seasonal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = customers(spark, sf_dir)
    return report.seasonal_counts(pauses.account_seasonality(pauses.episodes(own)), own)


# Support for models

SPLIT = """
elig AS (SELECT *, dense_rank() OVER (ORDER BY period DESC) AS back FROM lab WHERE churn IS NOT NULL AND months_in_panel >= 2),
parts AS (SELECT *, CASE WHEN back <= 2 THEN 'test' WHEN back <= 4 THEN 'val' ELSE 'train' END AS split FROM elig)"""


@register(query(LAB, EPISODES, SEASONALITY, SPLIT, body="SELECT split, count(*) AS rows, sum(churn)::BIGINT AS positives, avg(churn) AS rate, min(period) AS first_period, max(period) AS last_period FROM parts WHERE split = 'test' OR id NOT IN (SELECT id FROM prof WHERE kind = 'season') GROUP BY split"))
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = customers_labelled(spark, sf_dir)
    season = pauses.account_seasonality(pauses.episodes(own)).filter("kind = 'season'")
    return split.summary(split.temporal_split(own, excluded=season))


CURVE = f"""
curve AS (
  SELECT score, n, pos, sum(n) OVER (ORDER BY score DESC) AS seen, sum(pos) OVER (ORDER BY score DESC) AS hits, sum(n) OVER () AS total, sum(pos) OVER () AS positives
  FROM (SELECT {SCORE} AS score, count(*) AS n, sum(churn) AS pos FROM lab WHERE churn IS NOT NULL GROUP BY 1)
)"""


def _with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_score(customers_labelled(spark, sf_dir))


@register(query(LAB, CURVE, body="SELECT round(sum(pos / positives * hits / seen), 8) AS pr_auc, round(max(positives) / max(total), 8) AS baseline, round(sum(pos / positives * hits / seen) / (max(positives) / max(total)), 8) AS lift FROM curve"))
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.average_precision(_with_labels(spark, sf_dir))
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@register(query(LAB, CURVE, body="SELECT round(sum((n - pos) * (hits - pos + pos / 2)) / (max(positives) * (max(total) - max(positives))), 8) AS roc_auc FROM curve"))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_with_labels(spark, sf_dir)).select(F.round("roc_auc", 8).alias("roc_auc"))


@register(query(LAB, CURVE, body="SELECT score AS threshold, (2 * hits / (seen + positives))::DOUBLE AS f1, (hits / seen)::DOUBLE AS precision, (hits / positives)::DOUBLE AS recall FROM curve ORDER BY f1 DESC, score LIMIT 1"))
def best_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_f1(_with_labels(spark, sf_dir))


@register(query(LAB, body=f"SELECT round(avg(pow({SCORE} - churn, 2)), 8) AS brier FROM lab WHERE churn IS NOT NULL"))
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.brier(_with_labels(spark, sf_dir)).select(F.round("brier", 8).alias("brier"))


@register(query(LAB, body=f""", r AS (SELECT churn, row_number() OVER (ORDER BY {SCORE} DESC, id, t) AS place, count(*) OVER () AS n, sum(churn) OVER () AS positives FROM lab WHERE churn IS NOT NULL),
k AS (SELECT f, greatest(1, round_even(n * f, 0))::BIGINT AS k FROM (SELECT max(n) AS n FROM r), (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) v(f))
SELECT f AS fraction, k AS n_accounts, sum(churn)::BIGINT AS hits, sum(churn) / k AS precision, sum(churn) / max(positives) AS recall, round(sum(churn) / k / (max(positives) / max(n)), 8) AS lift FROM k JOIN r ON place <= k GROUP BY f, k""".lstrip()))
def top_k_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_k(_with_labels(spark, sf_dir)).withColumn("lift", F.round("lift", 8))


@register(query(CM, body="SELECT id, period, CASE WHEN sales_urgent IS NOT NULL THEN round((rank() OVER (PARTITION BY period ORDER BY sales_urgent NULLS LAST) + (count(sales_urgent) OVER (PARTITION BY period, sales_urgent) - 1) / 2) / count(sales_urgent) OVER (PARTITION BY period) * 100, 6) END AS percentile FROM cm"))
def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ranks.with_percentile(adapters.customer_months(spark, sf_dir).select("id", "period", "sales_urgent"), "sales_urgent", ("period",))
    return own.select("id", "period", six(F.col("percentile")).alias("percentile"))


def _psi_sql(names: tuple[str, ...]) -> str:
    """Numeric PSI of each metric, period 200006 against the 65 periods before."""
    one = """SELECT '$' AS feature, 'numeric' AS kind, round(sum((greatest(act, 1e-6) - greatest(ref, 1e-6)) * ln(greatest(act, 1e-6) / greatest(ref, 1e-6))), 6) AS psi FROM (
  SELECT bin, count(*) FILTER (WHERE is_ref) / max(nr) AS ref, count(*) FILTER (WHERE NOT is_ref) / max(na) AS act FROM (
    SELECT is_ref, nr, na, CASE WHEN $::DOUBLE IS NULL THEN -1 ELSE len(list_filter(inner_edges, lambda e: $::DOUBLE >= e)) END AS bin FROM rows_,
      (SELECT CASE WHEN len(e) >= 3 AND present > 0 THEN e[2:-2] ELSE [] END AS inner_edges FROM (SELECT list_sort(list_distinct(quantile_cont($::DOUBLE, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) FILTER (WHERE is_ref))) AS e, count($) FILTER (WHERE NOT is_ref) AS present FROM rows_)),
      (SELECT count(*) FILTER (WHERE is_ref) AS nr, count(*) FILTER (WHERE NOT is_ref) AS na FROM rows_)) GROUP BY bin)"""
    return _each(one, names)


PSI_ROWS = "rows_ AS (SELECT *, period <> 200006 AS is_ref FROM cm WHERE period <= 200006)"
PSI_CAT = "SELECT '$' AS feature, 'categorical' AS kind, round(sum((greatest(act, 1e-6) - greatest(ref, 1e-6)) * ln(greatest(act, 1e-6) / greatest(ref, 1e-6))), 6) AS psi FROM (SELECT $, count(*) FILTER (WHERE is_ref) / (SELECT count(*) FROM rows_ WHERE is_ref) AS ref, count(*) FILTER (WHERE NOT is_ref) / (SELECT count(*) FROM rows_ WHERE NOT is_ref) AS act FROM rows_ GROUP BY $)"
NUMBERS = (*SALES, "orders")


def _psi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.customer_months(spark, sf_dir).filter("period <= 200006").withColumn("is_ref", F.col("period") != 200006)


@register(query(CM, PSI_ROWS, body=_psi_sql(NUMBERS)))
def psi_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.numeric(_psi_rows(spark, sf_dir), list(NUMBERS)).select("feature", "kind", six(F.col("psi")).alias("psi"))


@register(query(CM, PSI_ROWS, body=_each(PSI_CAT, ("state", "country"))))
def psi_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.categorical(_psi_rows(spark, sf_dir), ["state", "country"]).select("feature", "kind", six(F.col("psi")).alias("psi"))


@register(query(CM, PSI_ROWS, body="SELECT *, CASE WHEN psi >= 0.25 THEN 'high' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS level FROM (" + _psi_sql(NUMBERS) + " UNION ALL " + _each(PSI_CAT, ("state", "country")) + ")"))
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = adapters.customer_months(spark, sf_dir)
    reference = [r["period"] for r in own.filter("period <= 200006").select("period").distinct().collect()]
    return drift.report(own, 200006, reference, list(NUMBERS), ["state", "country"]).withColumn("psi", six(F.col("psi")))


# Serving


@register(query(CM, RISK, body="SELECT id, t, country, churn_probability, revenue_at_risk, risk_category FROM (SELECT *, id * 1000 + t AS k FROM risk WHERE period = 199806 AND risk_category IN ('alto', 'medio') AND churn_probability >= 0.5) ORDER BY revenue_at_risk DESC NULLS LAST, k LIMIT 20 OFFSET 20"))
def account_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of twenty of one batch's riskier accounts; an account stands once in a batch."""
    batch = _scored(spark, sf_dir).filter("period = 199806")
    rows = serving.filtered(batch, risk=["alto", "medio"], min_probability=0.5)
    return serving.page(rows, page=2, size=20).select("id", "t", "country", "churn_probability", "revenue_at_risk", "risk_category")


@register(query(CM, RISK, body="SELECT id, t, period, churn_probability, risk_category FROM risk WHERE id = 7"))
def account_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.detail(_scored(spark, sf_dir), 7).select("id", "t", "period", "churn_probability", "risk_category")


@register(query(CM, RISK, body="""SELECT b::INTEGER AS bin, round(lo + b * w, 8) AS low, round(lo + (b + 1) * w, 8) AS high, count(p) AS n FROM (SELECT min(churn_probability) AS lo, (max(churn_probability) - min(churn_probability)) / 20 AS w FROM risk) e CROSS JOIN range(20) r(b)
LEFT JOIN (SELECT churn_probability AS p FROM risk) x ON b = least(greatest(ceil((p - lo) / w) - 1, 0), 19) GROUP BY b, lo, w"""))
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.histogram(_scored(spark, sf_dir)).withColumns({"low": F.round("low", 8), "high": F.round("high", 8)})


@register(query(CM, body="SELECT period, count(*) AS rows, period = (SELECT max(period) FROM cm) AS is_latest FROM cm GROUP BY period"))
def batch_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.batch_periods(adapters.customer_months(spark, sf_dir))


# Tickets

TICKETS = """
tk AS (
  SELECT event_id AS ticket_id, (year(ts) * 100 + month(ts))::INTEGER AS period, event_type AS category,
    CASE WHEN event_type = 'error' THEN user_id END AS explicit_id, CASE WHEN event_id % 4 <> 0 THEN 'c' || (user_id % 40)::VARCHAR END AS company_ref,
    CASE WHEN event_type = 'view' THEN (user_id * 3)::VARCHAR WHEN event_type = 'click' THEN 'u' || user_id::VARCHAR END AS external_id,
    (props::JSON->>'$.k')::BIGINT AS k FROM events
), comp AS (SELECT 'c' || (c_custkey % 40)::VARCHAR AS company_ref, min(c_custkey) AS account_id FROM customer GROUP BY 1)"""


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("ticket_id"),
        adapters.month_period(F.col("ts")).alias("period"),
        kind.alias("category"),
        F.when(kind == "error", F.col("user_id")).alias("explicit_id"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string"))).alias("company_ref"),
        F.when(kind == "view", (F.col("user_id") * 3).cast("string")).when(kind == "click", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("external_id"),
        F.get_json_object("props", "$.k").try_cast("long").alias("k"),
    )


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.table(spark, sf_dir, "customer")
    companies = c.select(F.concat(F.lit("c"), (F.col("c_custkey") % 40).cast("string")).alias("company_ref"), F.col("c_custkey").alias("account_id"))
    return attribution.attribute(_tickets(spark, sf_dir), companies, _accounts(spark, sf_dir), order="account_id")


ATTRIBUTION = (
    TICKETS
    + """,
s3 AS (
  SELECT *, CASE WHEN explicit_id IS NOT NULL THEN 'explicit' WHEN via IS NOT NULL THEN 'company' WHEN ext IS NOT NULL THEN 'external_id' END AS source3, coalesce(explicit_id, via, ext) AS a3 FROM (
    SELECT tk.*, comp.account_id AS via, v.c_custkey AS ext FROM tk LEFT JOIN comp USING (company_ref) LEFT JOIN (SELECT c_custkey FROM customer) v ON try_cast(external_id AS BIGINT) = v.c_custkey)
), d1 AS (SELECT external_id, min(a3) AS d FROM s3 WHERE external_id IS NOT NULL AND a3 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT a3) = 1
), s4 AS (SELECT s3.*, coalesce(a3, d) AS a4, CASE WHEN a3 IS NULL AND d IS NOT NULL THEN 'user_map' ELSE source3 END AS source4 FROM s3 LEFT JOIN d1 USING (external_id)
), d2 AS (SELECT company_ref, min(a4) AS d2 FROM s4 WHERE company_ref IS NOT NULL AND a4 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT a4) = 1
), att AS (SELECT ticket_id, period, category, k, coalesce(a4, d2) AS account_id, CASE WHEN a4 IS NULL AND d2 IS NOT NULL THEN 'company_map' ELSE source4 END AS source FROM s4 LEFT JOIN d2 USING (company_ref))"""
)


@register(query(TICKETS, body="SELECT ticket_id, period, category, company_ref, external_id, k FROM tk"))
def ticket_flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tickets(spark, sf_dir).select("ticket_id", "period", "category", "company_ref", "external_id", "k")


@register(query(ATTRIBUTION, body="SELECT ticket_id, account_id, source FROM att"))
def ticket_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).select("ticket_id", "account_id", "source")


@register(query(ATTRIBUTION, body="SELECT coalesce(source, 'unattributed') AS source, count(*) AS tickets, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM att GROUP BY 1"))
def attribution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.report(_attributed(spark, sf_dir))


@register(query(ATTRIBUTION, body="SELECT count(*) AS usable, count(DISTINCT account_id) AS accounts, count(*) >= 5000 AS enough FROM att WHERE account_id IS NOT NULL AND period BETWEEN 202401 AND 202401"))
def ticket_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.sufficiency(_attributed(spark, sf_dir), 202401, 202401)


@register(query(ATTRIBUTION, body="SELECT s AS source, avg(CASE WHEN list_position(['explicit', 'company', 'external_id', 'user_map', 'company_map'], source) <= i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM att, (VALUES ('explicit', 1), ('company', 2), ('external_id', 3), ('user_map', 4), ('company_map', 5)) v(s, i) GROUP BY s"))
def attribution_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.cumulative_coverage(_attributed(spark, sf_dir))


@register(query(ATTRIBUTION, body="SELECT category, count(*) AS tickets, avg((account_id IS NOT NULL)::INT) AS covered_share FROM att GROUP BY category HAVING count(*) >= 20"))
def ticket_coverage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.coverage_by(_attributed(spark, sf_dir), "category")


@register("SELECT count(*) AS keys, avg((a = 1)::INT) AS one_account_share, avg(n) AS tickets_a_key FROM (SELECT event_type || (event_id % 97)::VARCHAR AS key, count(DISTINCT user_id) AS a, count(*) AS n FROM events GROUP BY 1)")
def key_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").select(F.concat("event_type", (F.col("event_id") % 97).cast("string")).alias("key"), F.col("user_id").alias("account_id"))
    return attribution.key_stability(e, "key")


@register(query(TICKETS, body="SELECT length(external_id) AS length, count(*) AS tickets, avg(regexp_matches(external_id, '^[0-9]+$')::INT) AS numeric_share FROM tk WHERE external_id IS NOT NULL GROUP BY 1"))
def key_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.key_lengths(_tickets(spark, sf_dir), "external_id")


@register(query(TICKETS, body="SELECT count(*) AS holders, avg((k = 1)::INT) AS one_key_share FROM (SELECT company_ref, count(DISTINCT external_id) AS k FROM tk WHERE company_ref IS NOT NULL AND external_id IS NOT NULL GROUP BY 1)"))
def one_key_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.one_key_share(_tickets(spark, sf_dir), "company_ref", "external_id")


@register("""WITH both_ids AS (SELECT user_id AS explicit_id, CASE WHEN event_type IN ('view', 'click') THEN (user_id * 3)::VARCHAR ELSE user_id::VARCHAR END AS ext FROM events),
n AS (SELECT *, ext::BIGINT AS n FROM both_ids), r AS (SELECT 'short' AS rule, * FROM n WHERE length(ext) <= 2 UNION ALL
  SELECT 'in range', * FROM n WHERE n BETWEEN 1 AND (SELECT max(c_custkey) FROM customer) UNION ALL SELECT 'an account', * FROM n WHERE n IN (SELECT c_custkey FROM customer))
SELECT rule, count(*) AS tickets, avg((n = explicit_id)::INT) AS agree_share, count(*) FILTER (WHERE n <> explicit_id) AS against FROM r GROUP BY rule""")
def id_rule_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose external id is the user's or three times it, against the user as the explicit id."""
    e = adapters.table(spark, sf_dir, "events")
    ext = F.when(F.col("event_type").isin("view", "click"), F.col("user_id") * 3).otherwise(F.col("user_id"))
    return attribution.rule_agreement(e.select(F.col("user_id").alias("explicit_id"), ext.cast("string").alias("external_id")), _accounts(spark, sf_dir), most_digits=2)


@register(query(ATTRIBUTION, body="SELECT category, count(*) AS tickets, count(*) FILTER (WHERE source = 'explicit') AS explicit, count(*) FILTER (WHERE source <> 'explicit') AS rescued, count(*) FILTER (WHERE source <> 'explicit') / nullif(count(*) - count(*) FILTER (WHERE source = 'explicit'), 0) AS rescued_share FROM att GROUP BY category"))
def tickets_rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.rescued_by(_attributed(spark, sf_dir), "category")


# Prices


_MARKET_LIST = "['ar', 'cl', 'co', 'br', 'mx', 'uy', 'int']"


@register(query(CM, body=f"""SELECT * FROM (WITH item AS (SELECT kind, k, unnest({_MARKET_LIST}) AS m FROM (VALUES ('plan', 'ini'), ('plan', 'st'), ('plan', 'adv'), ('plan', 'fu'), ('module', 'tbl'), ('module', 'dv'), ('module', 'kds')) v(kind, k)),
own AS (SELECT *, CASE k || '|' || m WHEN 'ini|ar' THEN 10.0::DOUBLE WHEN 'ini|mx' THEN 12.5::DOUBLE WHEN 'st|ar' THEN 20.0::DOUBLE WHEN 'st|br' THEN 22.25::DOUBLE WHEN 'adv|ar' THEN 31.4::DOUBLE WHEN 'fu|ar' THEN 99.0::DOUBLE
  WHEN 'tbl|ar' THEN 3.25::DOUBLE WHEN 'tbl|cl' THEN 3.5::DOUBLE WHEN 'dv|ar' THEN 4.1::DOUBLE WHEN 'kds|mx' THEN 5.0::DOUBLE END AS p FROM item),
used AS (SELECT k, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(lower(trim(plan)), '-'))) AS k FROM cm) GROUP BY k)
SELECT a.kind, a.k AS item, a.m AS market, a.p AS own, coalesce(a.p, b.p) AS price, coalesce(n, 0)::BIGINT AS accounts FROM own a LEFT JOIN own b ON b.k = a.k AND b.m = 'ar' LEFT JOIN used ON used.k = a.k)"""))
def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price book with how many customer months have each item in their plan codes."""
    used = risk.token_counts(adapters.customer_months(spark, sf_dir))
    return BOOK.rows(spark).join(used.withColumnRenamed("token", "item"), "item", "left").select("kind", "item", "market", "own", "price", F.coalesce("accounts", F.lit(0)).alias("accounts"))


@register(query(CM, PLAN, body=f"""SELECT kind, item, market, sum(n)::BIGINT AS accounts FROM (
  SELECT DISTINCT plan, kind, item, coalesce(market, 'ar') AS market, n FROM (
    SELECT plan, 'plan' AS kind, base AS item, market, n FROM (SELECT plan, any_value(base) AS base, any_value(market) AS market, count(*) AS n FROM plans WHERE plan IS NOT NULL GROUP BY plan)
    UNION ALL SELECT plan, 'module', unnest(modules), market, n FROM (SELECT plan, any_value(modules) AS modules, any_value(market) AS market, count(*) AS n FROM plans WHERE plan IS NOT NULL GROUP BY plan)))
WHERE item IS NOT NULL AND coalesce(CASE kind WHEN 'plan' THEN (SELECT {PRICE_SQL[0]} FROM (SELECT item AS k, market AS m)) ELSE (SELECT {PRICE_SQL[1]} FROM (SELECT item AS k, market AS m)) END, -1) < 0 GROUP BY 1, 2, 3"""))
def unpriced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpriced(adapters.customer_months(spark, sf_dir), BOOK)


# The report as a whole

CATALOGUE = {"fast": ("sales_urgent", "sales_high"), "slow": ("sales_medium", "sales_other", "sales_low"), "all": ("orders", "not there")}
_ADOPTED = " UNION ALL ".join(
    f"SELECT '{g}' AS g, '{m}' AS metric, count(*) FILTER (WHERE {m} > 0) AS accounts, count(*) FILTER (WHERE {m} > 0) * 100.0 / count(*) AS pct, median({m}) FILTER (WHERE {m} > 0)::DOUBLE AS median_of_users FROM cm WHERE period = (SELECT max(period) FROM cm)"
    for g, own in CATALOGUE.items() for m in own if m != "not there"
)


@register(query(CM, body=f'SELECT g AS "group", row_number() OVER (PARTITION BY g ORDER BY pct DESC, metric)::INTEGER AS place, metric, accounts, pct, median_of_users FROM ({_ADOPTED})'))
def capability_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.capability_adoption(adapters.customer_months(spark, sf_dir), CATALOGUE)


@register(query(LAB, body="SELECT metric, lift, row_number() OVER (ORDER BY coalesce(lift, 1.0), metric)::INTEGER AS place FROM (" + _each("SELECT '$' AS metric, avg(CASE WHEN churn = 1 THEN (coalesce($, 0) > 0)::INT END) / nullif(avg(CASE WHEN churn = 0 THEN (coalesce($, 0) > 0)::INT END), 0) AS lift FROM lab WHERE churn IS NOT NULL") + ")"))
def usage_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.usage_signals(customers_labelled(spark, sf_dir), [*SALES, "not there"]).select("metric", "lift", "place")


@register(query(CM, EPISODES, body="""SELECT event, place::INTEGER AS place, month, name, n FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY n DESC, month) AS place, ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][month] AS name FROM (
  SELECT e AS event, m::INTEGER AS month, count(t) AS n FROM (VALUES ('pause'), ('return')) v(e) CROSS JOIN range(1, 13) r(m) LEFT JOIN (
    SELECT 'pause' AS k, month_left AS mm, t_left AS t FROM ep UNION ALL SELECT 'return', month_back, t_back FROM ep) x ON k = e AND mm = m GROUP BY 1, 2)) WHERE place <= 3"""))
def leading_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses.leading_months(pauses.monthly_profile(customers(spark, sf_dir)).filter("event in ('pause', 'return')"))


@register(query(CM, EPISODES, SEASONALITY, body="SELECT id, n_pauses, total_duration, signature FROM prof ORDER BY signature DESC, n_pauses DESC, total_duration DESC, id LIMIT 20"))
def longest_pausers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pauses.account_seasonality(pauses.episodes(customers(spark, sf_dir)))
    return pauses.longest_pausers(own).select("id", "n_pauses", "total_duration", "signature")


@register(query(LAB, CURVE, body=f"""SELECT round(ap, 8) AS pr_auc, round(base, 8) AS baseline, round(ap / base, 8) AS lift, round(roc, 8) AS roc_auc, round(brier, 8) AS brier, round(f1, 8) AS best_f1, low AS threshold FROM (
  SELECT sum(pos / positives * hits / seen) AS ap, max(positives) / max(total) AS base, sum((n - pos) * (hits - pos + pos / 2)) / (max(positives) * (max(total) - max(positives))) AS roc FROM curve),
  (SELECT avg(pow({SCORE} - churn, 2)) AS brier FROM lab WHERE churn IS NOT NULL), (SELECT score AS low, (2 * hits / (seen + positives))::DOUBLE AS f1 FROM curve ORDER BY f1 DESC, score LIMIT 1)"""))
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.evaluation(_with_labels(spark, sf_dir))
    return out.select(*[F.round(c, 8).alias(c) if c != "threshold" else F.col(c) for c in out.columns])


# Models. What is deterministic has SQL; trees have none, and tests compare them with brute force


@register(query(LAB, body=f"""
, b AS (SELECT floor({SCORE} * 20)::INTEGER AS x, sum(churn)::DOUBLE AS s, count(*) AS w FROM lab WHERE churn IS NOT NULL GROUP BY 1),
part AS (SELECT lo.x AS a, hi.x AS z, sum(m.s) / sum(m.w) AS mean FROM b lo JOIN b hi ON hi.x >= lo.x JOIN b m ON m.x BETWEEN lo.x AND hi.x GROUP BY 1, 2)
SELECT x / 20.0::DOUBLE AS score, w AS accounts, round(max(least_), 8) AS calibrated FROM (SELECT b.x, b.w, p.a, min(p.mean) AS least_ FROM b JOIN part p ON p.a <= b.x AND p.z >= b.x GROUP BY 1, 2, 3) GROUP BY 1, 2""".replace("\n, b AS", ", b AS", 1)))
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration of scores cut to twentieths; SQL takes the largest of the least means around each."""
    own = _with_labels(spark, sf_dir).filter("churn IS NOT NULL").select((F.floor(F.col("score") * 20) / 20.0).alias("_raw"), F.col("churn").cast("double").alias("label"))
    rows = own.groupBy("_raw").agg(F.count("*").alias("accounts"))
    out = learning.isotonic(own).transform(rows)
    return out.select(F.col("_raw").alias("score"), "accounts", F.round("_calibrated", 8).alias("calibrated"))


@register(query(LAB, body=f"""SELECT * FROM (WITH score AS (SELECT 'candidate' AS model, {SCORE} AS score, churn FROM lab WHERE churn IS NOT NULL UNION ALL SELECT 'champion', floor({SCORE} * 10) / 10.0, churn FROM lab WHERE churn IS NOT NULL),
counted AS (SELECT model, score, count(*) AS n, sum(churn) AS pos FROM score GROUP BY 1, 2),
run AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS hits, sum(n) OVER (PARTITION BY model) AS total, sum(pos) OVER (PARTITION BY model) AS positives FROM counted WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
metric AS (SELECT model, sum(pos / positives * hits / seen) AS pr_auc, sum((n - pos) * (hits - pos + pos / 2)) / (max(positives) * (max(total) - max(positives))) AS roc_auc FROM run GROUP BY model),
pair AS (SELECT a.pr_auc AS ca, a.roc_auc AS cr, b.pr_auc AS ha, b.roc_auc AS hr FROM metric a, metric b WHERE a.model = 'candidate' AND b.model = 'champion'),
rule AS (SELECT 'pr_auc' AS metric, 'least' AS kind, 0.2::DOUBLE AS "limit", ca AS candidate, ha AS champion, ca - 0.2::DOUBLE AS margin FROM pair
  UNION ALL SELECT 'pr_auc', 'gain', 0.005::DOUBLE, ca, ha, ca - ha - 0.005::DOUBLE FROM pair UNION ALL SELECT 'roc_auc', 'loss', 0.01::DOUBLE, cr, hr, 0.01::DOUBLE - (hr - cr) FROM pair)
SELECT metric, kind, "limit", round(candidate, 8) AS candidate, round(champion, 8) AS champion, round(margin, 8) AS margin, margin >= -1e-9 AS met FROM rule)"""))
def promotion_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a score would replace the same score cut to tenths, both evaluated on all labelled rows."""
    own = _with_labels(spark, sf_dir)
    candidate, champion = (metrics.evaluation(x).first().asDict() for x in (own, own.withColumn("score", F.floor(F.col("score") * 10) / 10.0)))
    found = promotion.outcomes(spark, candidate, champion)
    return found.withColumns({c: F.round(c, 8) for c in ("candidate", "champion", "margin")})


BUILD = prepare.Build(sales=SALES, additions=("orders",), delivery=("sales_high", "sales_medium"), salon="sales_urgent", usage=(*SALES, "orders"), ratios=(("high_to_urgent", "sales_high", "sales_urgent"),), core=("orders",))


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of customer months; there are no more of these than orders, whose number stands in the files' footers.

    Orders and customers are dealt before anything holds rows, so that every later step has tasks of a bounded number of them. Months are dealt
    once more, to half as many tasks: were the numbers equal, the planner would leave that out, and the buffers of all steps would add up in a task.
    """
    orders = adapters.table(spark, sf_dir, "orders").count()
    months = adapters.customer_months(spark, sf_dir, lambda rows, key: panel.spread(rows, 2 * orders, key))
    own = panel.spread(panel.dense_index(months), orders)
    return prepare.feature_matrix(labels.label(own), BUILD)


@register()
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of all customer months."""
    return _model_rows(spark, sf_dir)


#: The model of a folder of tables, the feature matrix that it was learned from, and when the tables were written: four queries ask for them.
_MODELS: dict[tuple[str, str], tuple[learning.Artifact, DataFrame, tuple]] = {}
#: The tables that customer months are made of.
MODEL_TABLES = ("customer", "orders", "nation")


def forget() -> None:
    """Deletes the matrices that are kept, once no DataFrame of the model queries is to be read any more."""
    for _, rows, _ in _MODELS.values():
        files.release(rows)
    _MODELS.clear()


def _trained(spark: SparkSession, sf_dir: str) -> tuple[learning.Artifact, DataFrame]:
    """What is kept for the folder if its tables haven't been written since; else it is built anew, and the old matrix deleted."""
    key, written = (spark.sparkContext.applicationId, sf_dir), tuple(files.modified(spark, f"{sf_dir}/{t}.parquet") for t in MODEL_TABLES)
    if key in _MODELS and _MODELS[key][2] != written:
        files.release(_MODELS.pop(key)[1])
    if key not in _MODELS:
        rows = files.kept(_model_rows(spark, sf_dir), "matrix", "period")
        columns = [c for c in features.feature_columns(rows) if not c.startswith("plan_market") and "_lag_" not in c]
        artifact = learning.train(split.temporal_split(rows), [c for c in columns if c != "plan_base"] + ["plan_base"], ["plan_base"])
        _MODELS[key] = artifact, rows, written
    return _MODELS[key][:2]


@register()
def train_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One period, scored end to end with a model of the periods before its labels: the 20 columns of a batch."""
    artifact, rows = _trained(spark, sf_dir)
    return scoring.score_period(rows, artifact, BOOK, 200006)


@register()
def global_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifact, rows = _trained(spark, sf_dir)
    return explain.mean_abs_shap(rows.filter("period = 200006"), artifact)


@register()
def tree_shap_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, place, feature, value, shap of what weighs most in each account's score."""
    artifact, rows = _trained(spark, sf_dir)
    own = rows.filter("period = 200006").select("id", *[c for c in artifact.model.features if c in rows.columns])
    found = explain.contributions(own, artifact).select("id", F.posexplode("factors").alias("place", "f"))
    return found.select("id", (F.col("place") + 1).alias("place"), "f.feature", "f.value", "f.shap", "f.direction")


@register()
def narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(spark, sf_dir).select("id", "risk_category", "narrative")
