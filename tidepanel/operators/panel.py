"""From stacked snapshots to a panel: period index, calendar, tenure, severity, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.spec import STATE_SEVERITY


#: Rows of a task, about, where wide rows are made, sorted and written: what bounds its memory.
TASK_ROWS = 250_000


def next_period(period: Column, months: Column | int = 1) -> Column:
    """The YYYYMM that is ``months`` later."""
    n = F.floor(period / 100) * 12 + period % 100 - 1 + (F.lit(months) if isinstance(months, int) else months)
    return (F.floor(n / 12) * 100 + n % 12 + 1).cast("int")


def month_of(period: Column) -> Column:
    return F.pmod(period, F.lit(100)).cast("int")


def periods(panel: DataFrame) -> DataFrame:
    """period, t: the periods present, numbered from 0. The window runs over the distinct periods alone."""
    seen = panel.select("period").distinct()
    return seen.select("period", (F.row_number().over(Window.orderBy("period")) - 1).alias("t"))


def dense_index(panel: DataFrame) -> DataFrame:
    """Adds ``t``, the number of the period among those present: a missing month makes its neighbours adjacent. The table of periods is small and is broadcast: rows stay in their tasks."""
    return panel.join(F.broadcast(periods(panel)), "period")


def spread(panel: DataFrame, rows: int, key: str = "id") -> DataFrame:
    """``panel``, which has ``rows`` rows at most, dealt by ``key`` to tasks of about ``TASK_ROWS``; as it is, if one task may have them all.

    Steps by the key that follow need no other shuffle. Tasks grow in number and not in size: the planner alone sizes them by what it shuffles,
    which is narrow where the rows that are made of it are wide.
    """
    tasks = -(-rows // TASK_ROWS)
    return panel.repartition(max(tasks, panel.sparkSession.sparkContext.defaultParallelism), key) if tasks > 1 else panel


def missing_periods(panel: DataFrame) -> DataFrame:
    """period: months between the first and the last that no row has."""
    ends = panel.agg(F.min("period").alias("low"), F.max("period").alias("high"))
    span = (F.floor(F.col("high") / 100) * 12 + F.col("high") % 100) - (F.floor(F.col("low") / 100) * 12 + F.col("low") % 100)
    every = ends.filter("low IS NOT NULL").select("low", F.explode(F.sequence(F.lit(0), span.cast("int"))).alias("k")).select(next_period(F.col("low"), F.col("k")).alias("period"))
    return every.join(panel.select("period").distinct(), "period", "left_anti")


def calendar(panel: DataFrame) -> DataFrame:
    """t, period: every t from the least to one past the greatest; a t that no row has continues the months from the last one that has."""
    seen = panel.select("t", "period").distinct()
    ends = seen.agg(F.min("t").alias("low"), F.max("t").alias("high")).filter("low IS NOT NULL")
    every = ends.select(F.explode(F.sequence(F.col("low"), F.col("high") + 1)).alias("t")).join(seen, "t", "left")
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("period").isNotNull(), F.struct("t", "period")), ignorenulls=True).over(before)
    return every.withColumn("_l", last).select("t", F.coalesce("period", next_period(F.col("_l.period"), F.col("t") - F.col("_l.t"))).alias("period"))


def epoch_seconds(at: Column) -> Column:
    """Whole seconds since the epoch, whatever the session's zone; a date, or a time without a zone, counts as UTC."""
    epoch = F.lit("1970-01-01").cast("date")
    local = F.datediff(at.cast("date"), epoch).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.floor(F.second(at))
    return F.when(F.typeof(at) == "timestamp", F.unix_seconds(at.cast("timestamp"))).otherwise(local)


def period_of(seconds: Column) -> Column:
    """The YYYYMM, in UTC, of seconds since the epoch."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    return (F.year(day) * 100 + F.month(day)).cast("int")


def tenure_months(period: Column, created: Column) -> Column:
    """Whole days from creation to the first of the month (UTC) over 30.44; null below 0, from 400 on, or without a date."""
    # days since the epoch know no time zone; dates and local times count as UTC
    first = F.datediff(F.make_date(F.floor(period / 100).cast("int"), month_of(period), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    months = F.floor((first - epoch_seconds(created)) / 86400) / 30.44
    return F.when((months >= 0) & (months < 400), months)


def severity(state: Column) -> Column:
    """0 (active) to 4 (blocked); an unknown or null state counts as 0."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATE_SEVERITY.items() for x in kv])[F.upper(F.trim(state))], F.lit(0))


def last_wins(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of rows with the same id and period, the one last by ``order`` (file, then place in it)."""
    last = Window.partitionBy("id", "period").orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
