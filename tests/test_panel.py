import random

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import plan_codes
from tidepanel.operators import attribution, drift, features, labels, metrics, panel, pauses, prepare, report, risk, serving, split


def presence(spark, seen):
    rows = [(i, t, 202401 + t if t < 12 else 202501 + t - 12) for i, ts in seen.items() for t in ts]
    return spark.createDataFrame(rows, "id int, t int, period int")


def by_key(df, *columns):
    return {(r["id"], r["t"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_labels_of_known_accounts(spark):
    own = presence(spark, {1: range(7), 2: [0, 1], 3: [0, 1, 3, 4, 5, 6]})
    got = by_key(labels.label(own), "churn", "is_ambiguous", "months_in_panel")
    assert got[1, 0] == (0, False, 1) and got[2, 1] == (1, False, 2) and got[3, 1] == (None, True, 2)
    assert got[1, 4][0] is None and got[1, 6][0] is None and got[3, 3][2] == 3
    assert by_key(labels.label(own, policy="negative"), "churn")[3, 1] == (0,)
    with pytest.raises(ValueError):
        labels.label(own, policy="other")


def test_labels_against_brute_force(spark):
    random.seed(1)
    seen = {i: [t for t in range(12) if random.random() < 0.6] for i in range(80)}
    there = {(i, t) for i, ts in seen.items() for t in ts}
    last = max(t for _, t in there)
    for window in (1, 3):
        got = by_key(labels.label(presence(spark, seen), window=window), "churn", "is_ambiguous")
        for i, t in there:
            gone, back = (i, t + 1) not in there, any((i, t + k) in there for k in range(2, window + 1))
            churn = None if t + window > last or (gone and back) else int(gone)
            assert got[i, t] == (churn, gone and back)


def test_missing_month_makes_neighbours_adjacent(spark):
    own = spark.createDataFrame([(1, 202401), (1, 202403), (2, 202312)], "id int, period int")
    assert {r["period"]: r["t"] for r in panel.dense_index(own).collect()} == {202312: 0, 202401: 1, 202403: 2}
    assert [r["period"] for r in panel.missing_periods(own).collect()] == [202402]
    assert panel.missing_periods(own.limit(0)).count() == 0


def test_calendar_fills_and_goes_one_past_the_end(spark):
    own = spark.createDataFrame([(1, 0, 202311), (1, 3, 202402)], "id int, t int, period int")
    assert [(r["t"], r["period"]) for r in panel.calendar(own).orderBy("t").collect()] == [(0, 202311), (1, 202312), (2, 202401), (3, 202402), (4, 202403)]


def test_tenure_counts_whole_days(spark):
    own = spark.sql("SELECT 202402 AS p, timestamp'2024-01-31 12:00:00' AS c UNION ALL SELECT 202402, timestamp'2024-03-01' UNION ALL SELECT 202402, NULL UNION ALL SELECT 202402, timestamp'2023-02-01'")
    got = [r[0] for r in own.select(panel.tenure_months(F.col("p"), F.col("c"))).collect()]
    assert got[0] == 0 and got[1] is None and got[2] is None and abs(got[3] - 365 / 30.44) < 1e-9


def test_last_file_wins(spark):
    own = spark.createDataFrame([(1, 202401, 0, 5, "a"), (1, 202401, 1, 2, "b"), (1, 202401, 1, 3, "c"), (2, 202401, 0, 0, "d")], "id int, period int, file int, place int, v string")
    assert sorted(r["v"] for r in panel.last_wins(own, ["file", "place"]).collect()) == ["c", "d"]


def test_pauses(spark):
    own = presence(spark, {1: [0, 1, 5, 6, 13], 2: [0, 1], 3: range(14)})
    got = [(r["id"], r["t_left"], r["t_back"], r["duration"], r["month_left"]) for r in pauses.episodes(own).orderBy("t_left").collect()]
    assert got == [(1, 1, 5, 3, 3), (1, 6, 13, 6, 8)]
    profile = pauses.account_seasonality(pauses.episodes(own)).collect()
    assert len(profile) == 1 and profile[0]["n_pauses"] == 2 and profile[0]["is_seasonal"] and profile[0]["kind"] == "intermittent"


def test_signature_of_a_season(spark):
    own = presence(spark, {1: [0, 1, 2, 9, 10], 2: range(12)})  # away April to September
    row = pauses.account_seasonality(pauses.episodes(own)).first()
    assert row["signature"] and row["kind"] == "season" and row["modal_left"] == 4 and row["modal_back"] == 10


def test_near_months_go_around_the_year(spark):
    cases = {(12, 1): True, (1, 3): False, (2, 3, 4): True, (11, 12, 1, 2): False, (5,): True, (): True}
    for months, near in cases.items():
        own = spark.range(1).select(pauses.near_months(F.array(*[F.lit(m) for m in months]).cast("array<int>")).alias("x"))
        assert own.first()["x"] is near


def test_profile_has_all_cells_and_uniform_index(spark):
    own = presence(spark, {i: [t] for i, t in enumerate(t for t in range(20) for _ in range(10))})
    rows = pauses.monthly_profile(own).collect()
    assert len(rows) == 48
    churn = {r["month"]: r["index"] for r in rows if r["event"] == "churn"}
    assert all(abs(x - 1) < 1e-9 for x in churn.values() if x is not None)


def test_features_are_gap_aware(spark):
    own = spark.createDataFrame([(1, 0, 10.0), (1, 1, 20.0), (1, 3, 40.0), (1, 4, None), (2, 0, 1.0), (2, 1, 2.0), (2, 2, 3.0), (2, 3, 4.0)], "id int, t int, v double")
    got = by_key(features.temporal(own, ["v"], ["v"]), "v_lag_1", "v_delta_1m", "v_ratio_3m", "v_slope_3m")
    assert got[1, 0] == (None, None, None, None) and got[1, 1][:3] == (10.0, 10.0, 2.0)
    assert got[1, 3][:2] == (None, None) and abs(got[1, 3][2] - 40 / 15) < 1e-12 and got[1, 4][2] is None
    assert got[2, 3] == (3.0, 1.0, 2.0, 1.0)


def test_debt_streak_goes_by_rows(spark):
    own = spark.createDataFrame([(1, 0, "ACTIVE"), (1, 1, "BLOCKED"), (1, 4, "BLOCKED"), (1, 5, "ACTIVE"), (1, 6, "PENDING_PAYMENT"), (2, 0, "BLOCKED")], "id int, t int, state string")
    got = by_key(features.state_features(own), "severity", "severity_max_3m", "severity_delta_1m", "debt_streak")
    assert got[1, 4] == (4, 4, 0, 2) and got[1, 5] == (0, 4, -4, 0) and got[1, 6] == (2, 4, 2, 1) and got[2, 0] == (4, 4, 0, 1)


def test_plan_codes(spark):
    cases = {"adv-tbl-dv-mx": ("adv", ["tbl", "dv"], "mx", []), " PRO--kds ": ("pro", ["kds"], None, []), "zzz-tbl": (None, ["tbl"], None, ["zzz"]), None: (None, [], None, []), "mx": (None, [], "mx", []), "ini-kds-foo-kds-ar": ("ini", ["kds", "kds"], "ar", ["foo"])}
    own = spark.createDataFrame([(c,) for c in cases], "plan string").withColumn("p", plan_codes.parse(F.col("plan")))
    for r in own.select("plan", "p.*").collect():
        assert (r["base"], r["modules"], r["market"], r["unknown"]) == cases[r["plan"]], r["plan"]


def test_revenue_falls_back_and_names_what_is_missing(spark):
    plans, modules = {"adv": {"ar": 10.0, "mx": None}}, {"tbl": {"ar": 2.5, "mx": 3.0}, "kds": {"mx": None}}
    own = spark.createDataFrame([("adv-tbl-mx",), ("adv-kds",), ("pro-tbl-cl",), (None,)], "plan string")
    got = {r["plan"]: (r["revenue"], r["missing"]) for r in risk.revenues(own, plans, modules, "ar").collect()}
    assert got == {"adv-tbl-mx": (13.0, []), "adv-kds": (10.0, ["kds"]), "pro-tbl-cl": (2.5, ["pro"]), None: (0.0, [])}


def test_risk(spark):
    own = spark.createDataFrame([(1, 0.5, 100.0), (2, 0.5, 40.0), (3, 0.5, None), (4, 0.1, 900.0)], "id int, probability double, revenue double")
    scored = risk.assign(own, risk.RiskBands(0.3, 15, 40))
    assert [r["risk_category"] for r in scored.orderBy("id").collect()] == ["alto", "medio", "bajo", "no_churn"]
    assert {r["risk_category"]: r["accounts"] for r in risk.summary(scored.filter("id = 1")).collect()} == {"alto": 1, "medio": 0, "bajo": 0, "no_churn": 0}


def test_metrics_of_a_small_case(spark):
    own = spark.createDataFrame([(1, 0, 1, 0.9), (2, 0, 0, 0.8), (3, 0, 1, 0.7), (4, 0, 0, 0.7), (5, 0, 0, 0.1)], "id int, t int, churn int, score double")
    assert abs(metrics.average_precision(own).first()["pr_auc"] - (0.5 * 1 + 0.5 * 2 / 4)) < 1e-12
    assert abs(metrics.roc_auc(own).first()["roc_auc"] - (3 + 1.5) / 6) < 1e-12
    best = metrics.best_f1(own).first()
    assert best["threshold"] == 0.7 and abs(best["f1"] - 2 / 3) < 1e-12  # ties go to the lowest threshold
    assert [r["hits"] for r in metrics.top_k(own, fractions=(0.01, 0.6)).orderBy("fraction").collect()] == [1, 2]


def test_drift(spark):
    rows = [(i % 2 == 0, float(i // 2 % 100), "a" if i % 3 else None) for i in range(4000)] + [(False, 500.0, "b")] * 2000
    own = spark.createDataFrame(rows, "is_ref boolean, v double, c string").withColumns({"flat": F.lit(1.0), "gone": F.when(F.col("is_ref"), 1.0)})
    got = {r["feature"]: r["psi"] for r in drift.numeric(own, ["v", "flat", "gone"]).collect()}
    assert got["v"] > 0.25 and abs(got["flat"]) < 1e-9 and got["gone"] > 5
    same = drift.numeric(own.filter("v < 500"), ["v"]).first()["psi"]
    assert abs(same) < 1e-9
    assert drift.categorical(own, ["c"]).first()["psi"] > 0.25
    assert own.select(drift.level(F.lit(0.1)), drift.level(F.lit(0.25)), drift.level(F.lit(0.05))).first()[:] == ("moderate", "high", "stable")
    with pytest.raises(ValueError):
        drift.report(own, 1, [1], ["v"])


def test_split_excludes_only_outside_the_test(spark):
    own = spark.createDataFrame([(i, 202401 + t, 2, 0) for i in (1, 2) for t in range(6)], "id int, period int, months_in_panel int, churn int")
    got = split.temporal_split(own, excluded=spark.createDataFrame([(2,)], "id int")).groupBy("split", "id").count().collect()
    assert {(r["split"], r["id"]): r["count"] for r in got} == {("train", 1): 2, ("val", 1): 2, ("test", 1): 2, ("test", 2): 2}
    with pytest.raises(ValueError):
        split.partition_periods([1, 2, 3])


def test_serving(spark):
    rows = [(i, f"Name {i}", "AR" if i % 2 else "mx", i / 100, float(i) if i % 3 else None, "alto") for i in range(1, 51)]
    own = spark.createDataFrame(rows, "id int, name string, country string, churn_probability double, revenue_at_risk double, risk_category string")
    page = serving.page(serving.filtered(own, country="ar", min_probability=0.1), ascending=True, size=500).collect()
    assert len(page) == 20 and page[-1]["revenue_at_risk"] is None and page[0]["id"] == 11
    assert {r["id"] for r in serving.filtered(own, search="NAME 4").collect()} == {4, *range(40, 50)}
    assert [r["id"] for r in serving.filtered(own.drop("name"), search="7").collect()] == [7]
    bars = serving.histogram(own, bins=10).collect()
    assert len(bars) == 10 and sum(r["n"] for r in bars) == 50 and bars[0]["n"] == 5
    flat = serving.histogram(own.withColumn("one", F.lit(0.5)), "one", bins=5).orderBy("bin").collect()
    assert [r["n"] for r in flat] == [0, 0, 50, 0, 0]
    with pytest.raises(KeyError):
        serving.resolve(own.withColumn("period", F.lit(1)), 2)


def test_attribution_chain(spark):
    tickets = spark.createDataFrame(
        [(1, 10, "c1", "5"), (2, None, "c1", "u1"), (3, None, " c2 ", None), (4, None, None, "7"), (5, None, None, "8"), (6, None, "c3", "7"), (7, None, "c3", None), (8, 20, "c9", None), (9, 21, "c9", None), (10, None, "c9", None)],
        "ticket_id int, explicit_id long, company_ref string, external_id string",
    )
    companies = spark.createDataFrame([("c2", 30)], "company_ref string, account_id long")
    out = attribution.attribute(tickets, companies, spark.createDataFrame([(7,)], "id int"))
    got = {r["ticket_id"]: (r["account_id"], r["source"]) for r in out.collect()}
    assert got == {1: (10, "explicit"), 2: (10, "company_map"), 3: (30, "company"), 4: (7, "external_id"), 5: (None, None), 6: (7, "external_id"), 7: (7, "company_map"), 8: (20, "explicit"), 9: (21, "explicit"), 10: (None, None)}
    assert {r["source"]: r["tickets"] for r in attribution.report(out).collect()}["unattributed"] == 2


def test_report_rates_need_rows(spark):
    rows = [(i, 202401, 0, int(i % 4 == 0), "big" if i < 150 else "small", 1, False) for i in range(200)]
    own = spark.createDataFrame(rows, "id int, period int, t int, churn int, country string, months_in_panel int, is_ambiguous boolean")
    assert {r["country"]: r["churn_rate"] is None for r in report.country_mix(own).collect()} == {"big": False, "small": True}
    assert report.base_series(own).first()["new"] == 0
    got = report.base_scalars(own).first()
    assert abs(got["churn_rate"] - 25) < 1e-9 and abs(got["mean_life"] - 4) < 1e-9 and abs(got["yearly_retention"] - 100 * 0.75**12) < 1e-9


def test_holdout_is_the_test_part(spark):
    own = spark.createDataFrame([(i, 202401 + p, p, int(i % 2), 1 + p) for i in range(6) for p in range(8)], "id int, period int, t int, churn int, months_in_panel int")
    want = sorted(tuple(r) for r in split.temporal_split(own).filter("split = 'test'").drop("split").collect())
    assert sorted(tuple(r) for r in split.holdout(own).collect()) == want and len(want) == 12


def test_feature_build_sorts_once_in_bounded_tasks(spark, monkeypatch):
    """More rows make more tasks, not larger ones; all windows share one sort, made before the rows are wide; features stay the same."""
    base = spark.range(800).selectExpr("id % 80 AS id", "CAST(id DIV 80 AS INT) AS t", "CAST(202001 + id DIV 80 AS INT) AS period", "CAST(id * 7 % 13 AS DOUBLE) AS v", "element_at(array('ACTIVE', 'BLOCKED', 'PENDING_PAYMENT'), CAST(id * 11 % 3 + 1 AS INT)) AS state", "'adv-tbl-ar' AS plan")
    build = prepare.Build(sales=("v",))
    plain = prepare.feature_matrix(labels.label(base), build)
    monkeypatch.setattr(panel, "TASK_ROWS", 50)
    assert panel.spread(base, 50) is base
    own = prepare.feature_matrix(labels.label(panel.spread(base, 800)), build)
    assert own._jdf.queryExecution().executedPlan().toString().count(" Sort [") == 1
    sizes = [r["count"] for r in own.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert own.rdd.getNumPartitions() == 16 and sum(sizes) == 800 and max(sizes) <= 200
    assert own.columns == plain.columns and sorted(map(str, own.collect())) == sorted(map(str, plain.collect()))
