"""Common table expressions that the catalogue's SQL is put together from."""

from __future__ import annotations

from tidepanel.sources.adapters import CUSTOMER_MONTHS_SQL, SUPPLIER_MONTHS_SQL, USER_DAYS_SQL


def labelled(panel: str, name: str, window: int = 3, policy: str = "drop") -> str:
    known = f"t + {window} <= max_t" + (" AND NOT (gone AND back)" if policy == "drop" else "")
    return f"""
{name} AS (
  SELECT * EXCLUDE (gone, back, max_t), gone AND back AS is_ambiguous, t + {window} <= max_t AS is_labelable,
    CASE WHEN {known} THEN CASE WHEN gone AND NOT back THEN 1 ELSE 0 END END AS churn
  FROM (SELECT *, count(*) OVER (PARTITION BY id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) = 0 AS gone,
          count(*) OVER (PARTITION BY id ORDER BY t RANGE BETWEEN 2 FOLLOWING AND {window} FOLLOWING) > 0 AS back,
          (row_number() OVER (PARTITION BY id ORDER BY t))::INTEGER AS months_in_panel, max(t) OVER () AS max_t FROM {panel})
)"""


CALENDAR = """
cal AS (SELECT t, period FROM cm_period UNION ALL
  SELECT max(t) + 1, (CASE WHEN max(period) % 100 < 12 THEN max(period) + 1 ELSE (max(period) // 100 + 1) * 100 + 1 END)::INTEGER FROM cm_period)"""

EPISODES = (
    CALENDAR
    + """,
ep AS (
  SELECT e.id, t_left, t_back, t_back - t_left - 1 AS duration, l.period AS period_left, b.period AS period_back, (l.period % 100)::INTEGER AS month_left, (b.period % 100)::INTEGER AS month_back
  FROM (SELECT id, t AS t_left, lead(t) OVER (PARTITION BY id ORDER BY t) AS t_back FROM cm) e
  JOIN cal l ON l.t = e.t_left + 1 JOIN cal b ON b.t = e.t_back WHERE t_back > t_left + 1
)"""
)

SEASONALITY = """
months AS (
  SELECT id, (max(m) FILTER (WHERE r = 1 AND side = 'l'))::INTEGER AS modal_left, (max(m) FILTER (WHERE r = 1 AND side = 'b'))::INTEGER AS modal_back FROM (
    SELECT id, side, m, row_number() OVER (PARTITION BY id, side ORDER BY count(*) DESC, m) AS r
    FROM (SELECT id, 'l' AS side, month_left AS m FROM ep UNION ALL SELECT id, 'b', month_back FROM ep) GROUP BY id, side, m) GROUP BY id
), near AS (
  SELECT id, bool_or(ok) AS same_month FROM (
    SELECT a.id, a.m, bool_and(least((a.m - b.m + 24) % 12, (b.m - a.m + 24) % 12) <= 1) AS ok
    FROM (SELECT DISTINCT id, month_left AS m FROM ep) a JOIN (SELECT DISTINCT id, month_left AS m FROM ep) b ON a.id = b.id GROUP BY a.id, a.m) GROUP BY id
), prof AS (
  SELECT *, CASE WHEN signature THEN 'season' WHEN n_pauses >= 2 THEN 'intermittent' ELSE '-' END AS kind, n_pauses >= 2 OR signature AS is_seasonal FROM (
    SELECT *, modal_left IN (4, 5, 6, 7) AND modal_back IN (10, 11, 12, 1, 2, 3) AND mean_duration BETWEEN 3 AND 8 AS signature FROM (
      SELECT id, count(*) AS n_pauses, round_even(avg(duration), 1) AS mean_duration, sum(duration)::BIGINT AS total_duration FROM ep GROUP BY id)
    JOIN months USING (id) JOIN near USING (id))
)"""

SEVERITY = "CASE state WHEN 'PAYMENT_VERIFICATION' THEN 1 WHEN 'PENDING_PAYMENT' THEN 2 WHEN 'BLOCKING_ALERT' THEN 3 WHEN 'BLOCKED' THEN 4 ELSE 0 END"

PLAN = """
pl AS (
  SELECT *, CASE WHEN base IS NOT NULL THEN rest[2:] ELSE rest END AS tail FROM (
    SELECT *, CASE WHEN list_contains(['ini', 'ba', 'st', 'adv', 'pr', 'pro', 'fu'], rest[1]) THEN rest[1] END AS base FROM (
      SELECT *, CASE WHEN market IS NOT NULL THEN parts[:-2] ELSE parts END AS rest FROM (
        SELECT *, CASE WHEN list_contains(['ar', 'cl', 'co', 'br', 'mx', 'uy', 'int'], parts[-1]) THEN parts[-1] END AS market
        FROM (SELECT *, list_filter(string_split(lower(trim(coalesce(plan, ''))), '-'), lambda x: x <> '') AS parts FROM cm))))
), plans AS (
  SELECT * EXCLUDE (parts, rest, tail), list_filter(tail, lambda x: list_contains(['tbl', 'dv', 'idvsls', 'kds', 'fi', 'fe', 'sbw', 'top'], x)) AS modules,
    list_filter(tail, lambda x: NOT list_contains(['tbl', 'dv', 'idvsls', 'kds', 'fi', 'fe', 'sbw', 'top'], x)) AS unknown,
    CASE base WHEN 'ini' THEN 1 WHEN 'ba' THEN 2 WHEN 'st' THEN 3 WHEN 'adv' THEN 4 WHEN 'pr' THEN 5 WHEN 'pro' THEN 5 WHEN 'fu' THEN 6 ELSE 0 END AS plan_rank FROM pl
)"""

#: A score that both engines compute alike.
SCORE = "((id * 7919 + t * 104729) % 1000) / 1000.0::DOUBLE"

CM, SM, UD = CUSTOMER_MONTHS_SQL, SUPPLIER_MONTHS_SQL, USER_DAYS_SQL
LAB = CM + "," + labelled("cm", "lab")


def query(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body
