"""Running sums, quantiles and percentile ranks over an order, without a task that holds the whole of it.

Values are first counted by group. Approximate quantiles of a group's distinct values cut its order into buckets of about equal size; sums by
bucket, a bounded number of rows a group, are added up first, and running sums are then taken inside each bucket. The cuts only decide
how evenly the work is spread: results are exact, and the same however the cuts fall.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 128


def _cuts(value: Column) -> Column:
    return F.percentile_approx(value, F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(1000))


def running(rows: DataFrame, value: str, sums: list[str], groups: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """Adds, for each column s of ``sums``, s_upto (its sum up to this value, inclusive) and s_all (over the group).

    ``rows``: one for each group and value, neither of them null. Without groups the driver asks for the cuts, ``BUCKETS`` values, at once.
    """
    if groups:
        own = rows.join(rows.groupBy(*groups).agg(_cuts(F.col(value)).alias("_cuts")), list(groups))
        above = F.size(F.filter("_cuts", lambda c: F.col(value) > c))
    else:
        own, cuts = rows, sorted(set(rows.agg(_cuts(F.col(value))).first()[0] or []))
        above = reduce(lambda case, i: case.when(F.col(value) <= F.lit(cuts[i]), i), range(len(cuts)), F).otherwise(len(cuts)) if cuts else F.lit(0)
    own = own.withColumn("_bucket", -above if descending else above).drop("_cuts")
    by = own.groupBy(*groups, "_bucket").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    before, every = Window.partitionBy(*groups).orderBy("_bucket"), Window.partitionBy(*groups)
    by = by.select(*groups, "_bucket", *[x for s in sums for x in ((F.sum(f"_{s}").over(before) - F.col(f"_{s}")).alias(f"_{s}"), F.sum(f"_{s}").over(every).alias(f"{s}_all"))])
    inside = Window.partitionBy(*groups, "_bucket").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = own.join(by, [*groups, "_bucket"])
    return out.select(*rows.columns, *[x for s in sums for x in ((F.col(f"_{s}") + F.sum(s).over(inside)).alias(f"{s}_upto"), F.col(f"{s}_all"))])


def unpivoted(rows: DataFrame, names: list[str], kind: str, keep: tuple[str, ...] = (), name: str = "feature") -> DataFrame:
    """``keep``, ``name``, value: a row for each of the named columns, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias(name), F.col(n).cast(kind).alias("value")) for n in names])).alias("_p")
    return rows.select(*keep, pairs).select(*keep, f"_p.{name}", "_p.value")


def quantiles(rows: DataFrame, probes: dict[str, float], groups: tuple[str, ...], value: str = "value") -> DataFrame:
    """``groups`` and a column for each probe: exact quantiles of the values that aren't null, linear between neighbours; groups without values aren't there."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    placed = running(counts, value, ["n"], groups)

    def at(place: Column) -> Column:
        """The value at a place from 0: the least that has more than so many values up to it."""
        return F.min(F.when(F.col("n_upto") > place, F.col(value)))

    ends = []
    for k, p in probes.items():
        place = F.lit(p) * (F.col("n_all") - 1)
        ends += [at(F.floor(place)).alias(f"_low_{k}"), at(F.ceil(place)).alias(f"_high_{k}")]
    found = placed.groupBy(*groups).agg(F.max("n_all").alias("_n"), *ends)
    share = {k: F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1)) for k, p in probes.items()}
    return found.select(*groups, *[(F.col(f"_low_{k}") + share[k] * (F.col(f"_high_{k}") - F.col(f"_low_{k}"))).alias(k) for k in probes])


def percentiles(counts: DataFrame, value: str, groups: tuple[str, ...] = (), name: str = "percentile") -> DataFrame:
    """Adds the percentile (0 to 100) of a value in its group, ties at their mean rank, to rows of group, value and ``n``, how often it occurs."""
    placed = running(counts, value, ["n"], groups)
    return placed.withColumn(name, (F.col("n_upto") - (F.col("n") - 1) / 2) / F.col("n_all") * 100).drop("n_upto", "n_all")


def with_percentile(rows: DataFrame, value: str, groups: tuple[str, ...] = (), name: str = "percentile") -> DataFrame:
    """``rows`` with the percentile of a column in its group; null stays null and doesn't count. A value or group that many rows share is one row of counts."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    return rows.join(percentiles(counts, value, groups, name).drop("n"), [*groups, value], "left").select(*rows.columns, name)
