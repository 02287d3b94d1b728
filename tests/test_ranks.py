"""Ranks, quantiles and metrics without a task that holds an order, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import drift, metrics, ranks, report


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("buckets", [2, 128])
def test_running_sums(spark, monkeypatch, buckets):
    monkeypatch.setattr(ranks, "BUCKETS", buckets)
    random.seed(1)
    rows = [(g, v, random.randint(1, 9)) for g in "abc" for v in random.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, v int, n long")
    got = {(r["g"], r["v"]): (r["n_upto"], r["n_all"]) for r in ranks.running(df, "v", ["n"], ("g",)).collect()}
    assert got == {(g, v): (sum(m for h, w, m in rows if h == g and w <= v), sum(m for h, _, m in rows if h == g)) for g, v, _ in rows}
    down = {r["v"]: r["n_upto"] for r in ranks.running(df.filter("g = 'a'").drop("g"), "v", ["n"], descending=True).collect()}
    assert down == {v: sum(m for h, w, m in rows if h == "a" and w >= v) for g, v, _ in rows if g == "a"}
    assert ranks.running(df.limit(0), "v", ["n"], ("g",)).count() == ranks.running(df.limit(0), "v", ["n"]).count() == 0


def test_quantiles_and_percentiles(spark):
    random.seed(2)
    rows = [(g, random.choice([None, random.random(), 0.5])) for g in ("x", "y") for _ in range(501)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {r["g"]: r for r in ranks.quantiles(df, {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}, ("g",)).collect()}
    for g in ("x", "y"):
        own = [v for h, v in rows if h == g and v is not None]
        assert np.allclose([got[g][k] for k in "abcd"], np.quantile(own, [0, 0.37, 0.5, 1]))
    out = ranks.with_percentile(df.withColumn("i", F.monotonically_increasing_id()), "value", ("g",)).collect()
    for r in out[::37]:
        own = [v for h, v in rows if h == r["g"] and v is not None]
        want = None if r["value"] is None else (sum(v < r["value"] for v in own) + (sum(v == r["value"] for v in own) + 1) / 2) / len(own) * 100
        assert (r["percentile"] is None) == (want is None) and (want is None or abs(r["percentile"] - want) < 1e-9)
    assert len(out) == len(rows)


def test_top_k_breaks_ties_by_key(spark):
    random.seed(3)
    rows = [(i // 3, i % 3, random.choice([0.1, 0.5, 0.9]), random.randint(0, 1)) for i in range(600)] + [(7, 7, None, 1), (8, 8, 0.9, None)]
    df = spark.createDataFrame(rows, "id int, t int, score double, churn int")
    out = {r["fraction"]: r for r in metrics.top_k(df).collect()}
    order = sorted((r for r in rows if None not in r), key=lambda r: (-r[2], r[0], r[1]))
    for f in (0.01, 0.05, 0.1, 0.2):
        k = max(1, round(len(order) * f))
        assert (out[f]["n_accounts"], out[f]["hits"]) == (k, sum(r[3] for r in order[:k]))
    same = spark.createDataFrame([(1, 1, 0.5, i % 2) for i in range(10)], "id int, t int, score double, churn int")
    assert metrics.top_k(same, fractions=(0.5, 0.7)).select("hits").collect() == [(0,), (2,)]  # equal in all: negatives first
    assert metrics.top_k(df.limit(0)).count() == 0


def test_no_window_holds_the_rows(spark):
    """Windows without a partition see sums by bucket alone."""
    df = spark.range(50_000).select(F.col("id"), F.lit(1).alias("t"), (F.col("id") * 7919 % 49_999 / 49_999).alias("score"), (F.col("id") % 5 == 0).cast("int").alias("churn"))
    one = metrics.evaluation(df)
    one.collect()
    windows = [s for s in plan_of(one).split("\n") if re.search(r"\bWindow \[", s)]
    whole = [s for s in windows if not re.search(r"\], \[_bucket#", s)]
    assert len(windows) > len(whole) and all(re.search(r"sum\(_(n|pos)#", s) for s in whole)
    assert abs(one.first()["baseline"] - 0.2) < 1e-9


def test_drift_and_report_documents(spark):
    rows = [(i, 202401 + i % 3, float(i % 50), None if i % 3 == 2 else 1.0, "ab"[i % 2]) for i in range(900)]
    panel = spark.createDataFrame(rows, "id int, period int, same double, gone double, kind string")
    found = drift.report(panel, 202403, [202401, 202402, 202403], ["same", "gone"], ["kind"])
    doc = drift.document(found, 202403, [202402, 202401], "now")
    assert doc["levels"]["high"] == 1 and doc["features"][0]["feature"] == "gone" and doc["features_compared"] == 3
    assert drift.has_drifted(found) and [r["feature"] for r in drift.at_level(found, "high").collect()] == ["gone"]
    assert drift.as_text(doc).splitlines()[1].split()[0] == "high"
    labelled = panel.withColumns({"churn": F.when(F.col("period") < 202403, (F.col("id") % 10 == 0).cast("int")), "is_ambiguous": F.lit(False), "months_in_panel": F.lit(1), "country": F.col("kind"), "state": F.lit("ACTIVE"), "tenure_months": F.lit(5.0)})
    own = report.document(labelled, {"one": ("same", "nowhere"), "none": ("nowhere",)}, ("same",), ("same", "nowhere"), "now")
    assert own["panel"]["rows"] == 900 and [g["group"] for g in own["adoption"]["groups"]] == ["one"] and own["base"]["unlabelled_periods"] == 1
    assert own["churn"]["stay"] + own["churn"]["churn"] == 600 and own["churn"]["signals"][0]["metric"] == "same" and own["churn"]["tenure"][0]["bucket"] == "3-6 months"
    assert len(own["base"]["series"]) == 3 and own["base"]["series"][2]["churned"] is None and own["base"]["countries"][0]["accounts"] == 150
