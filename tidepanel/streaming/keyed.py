"""Features and labels kept up to date from a stream of snapshots, with state by account.

The state of an account is its rows so far: what a period was, and which file said so. When rows arrive, in whatever order, the account's rows that
they touch come out anew, each with the rows before it that lags look back on, how many there are, and the period that it is seen in next.
These facts are the account's own; what depends on all accounts, the numbering of periods and how far they reach, is applied when the table is
read: so labels mature as later periods come, and a month that comes late moves no state. Reading is a projection, without windows or shuffles.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidepanel.operators import features
from tidepanel.streaming.incremental import merged, placed

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Periods of a table at most: they are literals of the plan that reads it.
MOST_PERIODS = 5000


def _schema(ids: T.DataType, metrics: list[str]) -> T.StructType:
    own = [T.StructField(m, T.DoubleType()) for m in metrics]
    before = T.StructType([T.StructField("period", T.IntegerType()), *own])
    more = [T.StructField("months_in_panel", T.IntegerType()), T.StructField("next_period", T.IntegerType()), T.StructField("earlier", T.ArrayType(before))]
    return T.StructType([T.StructField("id", ids), T.StructField("period", T.IntegerType()), *own, *more])


class Account(StatefulProcessor):
    """The rows of one account, as JSON: by period the place of the row that counts, and its metrics. An account has as many as there are periods."""

    def __init__(self, metrics: list[str], steps: int):
        self.metrics, self.steps = metrics, steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rows", T.StructType([T.StructField("rows", T.StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[list, list]] = {int(p): v for p, v in json.loads(self.state.get()[0]).items()} if self.state.exists() else {}
        touched = None
        for pdf in rows:
            values = pdf[self.metrics].astype(float).astype(object)
            values = values.where(pdf[self.metrics].notna(), None)
            for period, *place, own in zip(pdf["period"].tolist(), pdf["file_time"].tolist(), pdf["file_name"].tolist(), pdf["file_block"].tolist(), pdf["place"].tolist(), values.to_numpy().tolist(), strict=True):
                old = known.get(period)
                if old is None or list(old[0]) < place:
                    known[period] = (place, own)
                    touched = period if touched is None else min(touched, period)
        if touched is None:
            return
        self.state.update((json.dumps(known),))
        order = sorted(known)
        first = max(0, order.index(touched) - 1)  # the row before has a new next one; all later ones may look back on it
        out = []
        for i in range(first, len(order)):
            earlier = [{"period": p, **dict(zip(self.metrics, known[p][1], strict=True))} for p in order[max(0, i - self.steps) : i]]
            out.append([key[0], order[i], *known[order[i]][1], i + 1, order[i + 1] if i + 1 < len(order) else None, earlier])
        yield pd.DataFrame(out, columns=["id", "period", *self.metrics, "months_in_panel", "next_period", "earlier"]).astype({"next_period": "Int32"})

    def close(self) -> None:
        pass


def follow(spark: SparkSession, source: str, schema: T.StructType, metrics: list[str], target: str, checkpoint: str, steps: int = 3, kind: str = "parquet") -> StreamingQuery:
    """Files that come into ``source`` (id, period and ``metrics`` among their columns), followed into the table of facts at ``target``; ends when all files there are read.

    Of rows with one id and period the one in the latest file counts, in a file the last. Rows without id or period are left out. A batch that
    runs again after a failure gives the same rows. Periods that a batch touches are replaced.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = placed(spark.readStream.schema(schema).format(kind).load(source), kind).filter("id IS NOT NULL AND period IS NOT NULL")
    own = rows.select("id", F.col("period").cast("int").alias("period"), "file_time", "file_name", "file_block", "place", *[F.col(m).cast("double").alias(m) for m in metrics])
    facts = own.withColumn("file_time", F.unix_micros("file_time")).groupBy("id").transformWithStateInPandas(Account(metrics, steps), _schema(schema["id"].dataType, metrics), "Update", "None")
    return facts.writeStream.outputMode("update").foreachBatch(merged(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, target: str, metrics: list[str], core: list[str] = (), window: int = 3, policy: str = "drop", steps: int = 3) -> DataFrame:
    """id, period, t, metrics, the labels of ``labels.label`` and the features of ``features.temporal``, equal to a batch build over all rows that have come."""
    facts = spark.read.parquet(f"{target}/data")
    seen = sorted(r["period"] for r in facts.select("period").distinct().limit(MOST_PERIODS + 1).collect())
    if len(seen) > MOST_PERIODS:
        raise ValueError(f"more than {MOST_PERIODS} periods")
    numbers = F.create_map(*[F.lit(x) for t, p in enumerate(seen) for x in (p, t)])
    number = lambda period: F.try_element_at(numbers, period)
    t, following, last = number(F.col("period")), number(F.col("next_period")), len(seen) - 1
    own = facts.withColumns({"t": t, "_next": following})
    gone, back = F.coalesce(F.col("_next") != F.col("t") + 1, F.lit(True)), F.coalesce(F.col("_next").between(F.col("t") + 2, F.col("t") + window), F.lit(False))
    own = own.withColumns({"is_ambiguous": gone & back, "is_labelable": F.col("t") + window <= last})
    known: Column = F.col("is_labelable") & ~F.col("is_ambiguous") if policy == "drop" else F.col("is_labelable")
    own = own.withColumn("churn", F.when(known, F.when(gone & ~back, 1).otherwise(0)))
    at = lambda k: F.get(F.filter("earlier", lambda e: number(e["period"]) == F.col("t") - k), F.lit(0))
    lagged = own.withColumns({f"_lag{k}": at(k) for k in range(1, steps + 1)})
    return features.from_lags(lagged, metrics, list(core), tuple(range(1, steps + 1))).drop("earlier", "next_period", "_next")
