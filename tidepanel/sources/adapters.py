"""Panels out of order, shipment and event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.spec import MARKETS

#: Order priorities as sales channels.
CHANNELS = {"1-URGENT": "sales_urgent", "2-HIGH": "sales_high", "3-MEDIUM": "sales_medium", "4-NOT SPECIFIED": "sales_other", "5-LOW": "sales_low"}
SALES = tuple(CHANNELS.values())
STATES = {"O": "ACTIVE", "P": "PENDING_PAYMENT", "F": "BLOCKED"}
BASES = {"AUTOMOBILE": "ini", "BUILDING": "st", "FURNITURE": "adv", "HOUSEHOLD": "pro", "MACHINERY": "xx"}
CHANNEL_MODULES = dict(zip(SALES, ("tbl", "dv", "kds", "fi", "zz"), strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_period(ts: Column) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def cents(amount: Column) -> Column:
    """Money as whole cents, so that sums don't depend on their order."""
    return F.round(amount * 100).cast("long")


def customer_months(spark: SparkSession, sf_dir: str, dealt: Callable[[DataFrame, str], DataFrame] = lambda rows, key: rows) -> DataFrame:
    """One row a customer and month with orders: channel sales (null without an order there), orders, state, country, plan code, created.

    One shuffle of pre-aggregated orders on (customer, month); the customer attributes come by a join on the customer. ``dealt`` may deal
    orders and customers to tasks by their key before anything is summed, sorted or joined: nothing by customer is shuffled after that.
    """
    orders = dealt(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", cents(F.col("o_totalprice")).alias("cents")), "o_custkey")
    months = orders.groupBy(F.col("o_custkey").alias("id"), month_period(F.col("o_orderdate")).alias("period")).agg(
        *[(F.sum(F.when(F.col("o_orderpriority") == p, F.col("cents"))) / 100.0).alias(name) for p, name in CHANNELS.items()],
        F.count("*").alias("orders"),
        F.max("o_orderstatus").alias("status"),
    )
    created = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("created"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_nationkey"), "id")
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(created, "id", "left")
    joined = months.join(people, "id", "left")
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("status")]
    base = F.create_map(*[F.lit(x) for kv in BASES.items() for x in kv])[F.col("c_mktsegment")]
    modules = [F.when(F.col(c).isNotNull(), F.lit(m)) for c, m in CHANNEL_MODULES.items()]
    market = F.get(F.array(*[F.lit(m) for m in MARKETS]), F.col("c_nationkey") % 9)
    plan = F.concat_ws("-", base, *modules, market)
    return joined.select("id", "period", *SALES, "orders", state.alias("state"), F.col("n_name").alias("country"), plan.alias("plan"), "created")


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a supplier and month with shipments: quantity, amount, lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", cents(F.col("l_extendedprice")).alias("cents"))
    return lines.groupBy(F.col("l_suppkey").alias("id"), month_period(F.col("l_shipdate")).alias("period")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"), (F.sum("cents") / 100.0).alias("amount"), F.count("*").alias("lines")
    )


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user and day (yyyymmdd) with events: events, purchases."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    day = (month_period(F.col("ts")) * 100 + F.day("ts")).cast("int")
    return events.groupBy(F.col("user_id").alias("id"), day.alias("period")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


#: The same panels in SQL, as common table expressions.
CUSTOMER_MONTHS_SQL = """
cm_base AS (
  SELECT o_custkey AS id, (year(o_orderdate) * 100 + month(o_orderdate))::INTEGER AS period,
    sum(CASE WHEN o_orderpriority = '1-URGENT' THEN round(o_totalprice * 100)::BIGINT END)::BIGINT / 100.0::DOUBLE AS sales_urgent,
    sum(CASE WHEN o_orderpriority = '2-HIGH' THEN round(o_totalprice * 100)::BIGINT END)::BIGINT / 100.0::DOUBLE AS sales_high,
    sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN round(o_totalprice * 100)::BIGINT END)::BIGINT / 100.0::DOUBLE AS sales_medium,
    sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN round(o_totalprice * 100)::BIGINT END)::BIGINT / 100.0::DOUBLE AS sales_other,
    sum(CASE WHEN o_orderpriority = '5-LOW' THEN round(o_totalprice * 100)::BIGINT END)::BIGINT / 100.0::DOUBLE AS sales_low,
    count(*) AS orders, max(o_orderstatus) AS status
  FROM orders GROUP BY 1, 2
), cm_created AS (
  SELECT o_custkey AS id, min(o_orderdate) AS created FROM orders GROUP BY 1
), cm_raw AS (
  SELECT b.id, b.period, sales_urgent, sales_high, sales_medium, sales_other, sales_low, orders,
    CASE status WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'PENDING_PAYMENT' WHEN 'F' THEN 'BLOCKED' END AS state, n_name AS country,
    concat_ws('-', CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ini' WHEN 'BUILDING' THEN 'st' WHEN 'FURNITURE' THEN 'adv' WHEN 'HOUSEHOLD' THEN 'pro' WHEN 'MACHINERY' THEN 'xx' END,
      CASE WHEN sales_urgent IS NOT NULL THEN 'tbl' END, CASE WHEN sales_high IS NOT NULL THEN 'dv' END, CASE WHEN sales_medium IS NOT NULL THEN 'kds' END,
      CASE WHEN sales_other IS NOT NULL THEN 'fi' END, CASE WHEN sales_low IS NOT NULL THEN 'zz' END,
      ['ar', 'cl', 'co', 'br', 'mx', 'uy', 'int'][CASE WHEN c_nationkey % 9 < 7 THEN c_nationkey % 9 + 1 END]) AS plan, created
  FROM cm_base b LEFT JOIN customer ON c_custkey = b.id LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN cm_created c ON c.id = b.id
), cm_period AS (
  SELECT period, (row_number() OVER (ORDER BY period) - 1)::INTEGER AS t FROM (SELECT DISTINCT period FROM cm_raw)
), cm AS (
  SELECT r.*, p.t FROM cm_raw r JOIN cm_period p USING (period)
)"""

SUPPLIER_MONTHS_SQL = """
sm_raw AS (
  SELECT l_suppkey AS id, (year(l_shipdate) * 100 + month(l_shipdate))::INTEGER AS period, sum(l_quantity::BIGINT)::BIGINT AS quantity,
    sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS amount, count(*) AS lines
  FROM lineitem GROUP BY 1, 2
), sm_period AS (
  SELECT period, (row_number() OVER (ORDER BY period) - 1)::INTEGER AS t FROM (SELECT DISTINCT period FROM sm_raw)
), sm AS (
  SELECT r.*, p.t FROM sm_raw r JOIN sm_period p USING (period)
)"""

USER_DAYS_SQL = """
ud_raw AS (
  SELECT user_id AS id, strftime(ts, '%Y%m%d')::INTEGER AS period, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS purchases
  FROM events GROUP BY 1, 2
), ud_period AS (
  SELECT period, (row_number() OVER (ORDER BY period) - 1)::INTEGER AS t FROM (SELECT DISTINCT period FROM ud_raw)
), ud AS (
  SELECT r.*, p.t FROM ud_raw r JOIN ud_period p USING (period)
)"""
