"""Labels from presence: who is gone after a month, and who only pauses.

All window expressions partition by id and order by t, so labels take one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def by_id() -> WindowSpec:
    return Window.partitionBy("id").orderBy("t")


def label(panel: DataFrame, window: int = 3, policy: str = "drop") -> DataFrame:
    """Adds churn (1, 0, null), is_ambiguous, is_labelable and months_in_panel.

    A row is churn if the account is absent next period and doesn't return within ``window``. One that does return is ambiguous: null
    under ``drop``, 0 under ``negative``. Rows whose window ends past the last period have no label, even if the account is there next.
    """
    if policy not in ("drop", "negative"):
        raise ValueError(f"unknown policy {policy!r}")
    gone = F.count("*").over(by_id().rangeBetween(1, 1)) == 0
    back = F.count("*").over(by_id().rangeBetween(2, window)) > 0 if window >= 2 else F.lit(False)
    last = panel.agg(F.max("t")).scalar()
    seen = panel.withColumns({"_gone": gone, "_back": back, "months_in_panel": F.row_number().over(by_id())})
    out = seen.withColumns({"is_ambiguous": F.col("_gone") & F.col("_back"), "is_labelable": F.col("t") + window <= last})
    value = F.when(F.col("_gone") & ~F.col("_back"), 1).otherwise(0)
    known = F.col("is_labelable") & ~F.col("is_ambiguous") if policy == "drop" else F.col("is_labelable")
    return out.withColumn("churn", F.when(known, value)).drop("_gone", "_back")


def churn_rate_by_period(labelled: DataFrame) -> DataFrame:
    """period, accounts, churn_rate (percent): over labelled rows."""
    return labelled.filter("churn IS NOT NULL").groupBy("period").agg(F.count("*").alias("accounts"), (F.avg("churn") * 100).alias("churn_rate"))


def label_summary(labelled: DataFrame) -> DataFrame:
    """One row: rows, labelled, churn_rate, ambiguous, ambiguous_share (shares of 1; rate 0 without labels)."""
    return labelled.agg(
        F.count("*").alias("rows"),
        F.count("churn").alias("labelled"),
        F.coalesce(F.avg("churn"), F.lit(0.0)).alias("churn_rate"),
        F.count_if("is_ambiguous").alias("ambiguous"),
        F.avg(F.col("is_ambiguous").cast("int")).alias("ambiguous_share"),
    )


def presence_gaps(panel: DataFrame) -> DataFrame:
    """id, first_t, last_t, periods, gaps: how many periods between the first and the last an account is absent."""
    own = panel.groupBy("id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_distinct("t").alias("periods"))
    return own.withColumn("gaps", F.col("last_t") - F.col("first_t") + 1 - F.col("periods"))


def naive_return_share(panel: DataFrame) -> DataFrame:
    """One row: disappearances (absent next period, though periods follow), returned, share: what a label without a window would get wrong."""
    last = panel.agg(F.max("t")).scalar()
    after = F.lead("t").over(by_id())
    gone = panel.withColumn("_after", after).filter((F.col("t") < last) & (F.col("_after").isNull() | (F.col("_after") > F.col("t") + 1)))
    return gone.agg(F.count("*").alias("disappearances"), F.count("_after").alias("returned"), (F.count("_after") / F.count("*")).alias("share"))
