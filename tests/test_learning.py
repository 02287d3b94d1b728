import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import names
from tidepanel.operators import boosting, explain, learning, panel, promotion, risk, scoring
from tidepanel.plans import catalog
from tidepanel.sources.prices import PriceBook


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(3)
    own = []
    for i in range(1500):
        a, b = random.random(), random.choice([0.0, 1.0, None])
        own.append((i, 202401 + i % 6, int(random.random() < (0.8 if a > 0.7 and b == 1.0 else 0.1)), a, b, random.choice("xyz")))
    df = spark.createDataFrame(own, "id int, period int, churn int, a double, b double, c string")
    return df.withColumn("split", F.when(F.col("period") == 202406, "test").when(F.col("period") == 202405, "val").otherwise("train"))


@pytest.fixture(scope="module")
def artifact(rows):
    return learning.train(rows, ["a", "b", "c"], ["c"], boosting.Settings(trees=6, depth=3, least_hessian=5.0))


def test_model_separates_and_is_calibrated(rows, artifact):
    assert artifact.metrics["pr_auc"] > 2 * artifact.metrics["baseline"] and artifact.metrics["roc_auc"] > 0.7
    p = [r["probability"] for r in artifact.score(rows.filter("split = 'test'")).collect()]
    assert 0 <= min(p) and max(p) <= 1
    assert artifact.periods == [202401, 202402, 202403, 202404]
    assert learning.gain_importance(artifact)[0][0] in ("a", "b")


def test_absent_and_unseen_features_are_scored(spark, artifact):
    odd = spark.createDataFrame([(1, 0.9, "never seen")], "id int, a double, c string")
    assert artifact.score(odd).count() == 1


def binned(artifact, rows):
    own = rows.select(*artifact.model.columns(rows)).toPandas()
    return artifact.model.binned([own[c].to_numpy() for c in own.columns])


def test_shapley_values_add_up(rows, artifact):
    """To each row's margin; and each is the mean over all orders of what a feature adds, for absent features over the shares of the training rows."""
    bins = binned(artifact, rows.filter("split = 'test'").limit(60))
    phi, base = explain.shapley(bins, explain.leaves(artifact))
    assert np.allclose(phi.sum(axis=1) + base, artifact.model.margins(bins))

    def expected(tree, node, row, known):
        if not tree.left[node]:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if tree.feature[node] in known:
            return expected(tree, left if tree.table[node][row[tree.feature[node]]] else right, row, known)
        return sum(tree.cover[k] / tree.cover[node] * expected(tree, k, row, known) for k in (left, right))

    for i in range(5):
        want = np.zeros(len(bins))
        for order in itertools.permutations(range(len(bins))):
            for k, f in enumerate(order):
                with_f, without = set(order[: k + 1]), set(order[:k])
                want[f] += sum(expected(t, 0, bins[:, i], with_f) - expected(t, 0, bins[:, i], without) for t in artifact.model.trees)
        assert np.allclose(phi[i], want / 6)


def test_contributions_and_narrative(rows, artifact):
    out = explain.contributions(rows.filter("split = 'test'"), artifact, top=2)
    for r in out.limit(40).collect():
        sizes = [abs(f["shap"]) for f in r["factors"]]
        assert len(sizes) <= 2 and sizes == sorted(sizes, reverse=True) and 0 not in sizes
    placed = explain.with_percentiles(out.drop("percentile"), rows.filter("split = 'test'"), ["a", "b", "c"])
    text = placed.select(explain.narrative(F.lit("alto"), F.lit(0.5), F.lit(100.0), F.col("factors")).alias("t")).first()["t"]
    assert text.startswith("High risk of leaving: estimated probability 50%. Worth 100 USD a month, 50 at risk.")
    values = sorted(r["a"] for r in rows.filter("split = 'test'").collect())
    for r in placed.collect():
        for f in r["factors"]:
            if f["feature"] == "a":
                assert abs(f["percentile"] - 100 * (values.index(f["value"]) + 1) / len(values)) < 1e-9
            elif f["feature"] == "c":
                assert f["percentile"] is None
    before = {r["id"]: [f["feature"] for f in r["factors"]] for r in out.collect()}
    assert {r["id"]: [f["feature"] for f in r["factors"]] for r in placed.collect()} == before


def test_phrases_by_percentile(spark):
    kind = "array<struct<label:string,direction:string,percentile:double>>"
    own = spark.createDataFrame([([("ACTIVE days", "up", 5.0), ("Orders", "up", 95.0), ("Plan", "up", None), ("More", "up", 1.0), ("Tenure", "down", 50.0)],)], f"f {kind}")
    say = lambda c: own.select(explain.narrative(F.lit(c), F.lit(0.25), F.lit(None).cast("double"), F.col("f")).alias("t")).first()["t"]
    assert say("medio") == "Medium risk of leaving: estimated probability 25%. What pushes it: aCTIVE days (far below the others, percentile 5); orders (far above the others, percentile 95); plan. What holds it: tenure (like the others, percentile 50)."
    assert "holds" not in say("no_churn")


def test_a_writer_never_stops_a_batch(spark):
    own = spark.createDataFrame([(1, "alto", "rule 1"), (2, "alto", "rule 2"), (3, "bajo", "rule 3"), (4, None, "rule 4")], "id int, risk_category string, narrative string")

    def writer(row):
        if row["id"] == 2:
            raise RuntimeError("no answer")
        return f"written {row['id']}"

    assert {r["id"]: r["narrative"] for r in explain.rewritten(own, writer).collect()} == {1: "written 1", 2: "rule 2", 3: "rule 3", 4: "rule 4"}


def test_names_and_groups():
    assert names.label("ad_pc_ratio_3m") == "Ad pc (level against the last three months)" and names.label("x_delta_1m", {"x": "Sales"}) == "Sales (change in a month)"
    assert names.label("plan_module_tbl", modules={"tbl": "Tables"}) == "Module Tables" and names.label("known", {"known": "As said"}) == "As said"
    assert [names.group(x) for x in ("plan_rank", "severity_max_3m", "debt_streak", "sales_total_slope_3m", "orders", "usuarios", "months_since_first", "zzz")] == ["plan", "billing", "billing", "sales", "daily operation", "team and access", "life cycle", "other"]


def test_scoring_gives_the_whole_batch(spark, rows, artifact, tmp_path):
    own = rows.withColumns({"t": F.col("period") - 202401, "plan": F.lit("adv-tbl-ar"), "country": F.lit("x"), "state": F.lit("ACTIVE")})
    book = PriceBook({"adv": {"ar": 50.0}}, {}, "EUR", "ar")
    out = scoring.score_period(own, artifact, book, writer=lambda row: None)
    assert tuple(out.columns) == scoring.COLUMNS and len(scoring.COLUMNS) == 20
    got = out.collect()
    assert len(got) == rows.filter("period = 202406").count() and {r["predicted_period"] for r in got} == {202407}
    assert all(r["price_incomplete"] and r["monthly_revenue"] == 50.0 and r["name"] is None and " EUR a month" in r["narrative"] for r in got)
    meta = scoring.batch_metadata(out, artifact, book, explain.mean_abs_shap(own, artifact), risk.RiskBands(), "now")
    assert meta["accounts"] == len(got) and sum(r["accounts"] for r in meta["summary"]) == len(got) and meta["importance"][0]["feature"] in ("a", "b")
    with pytest.raises(ValueError):
        scoring.score_period(own, artifact, book, 209901)


def test_a_champion_that_lacks_features_counts_with_its_stored_metrics(rows, artifact):
    test = rows.filter("split = 'test'")
    decided = learning.challenge(test.drop("b"), artifact, artifact)
    assert decided["same_test"] is False and decided["champion"] == artifact.metrics
    again = learning.challenge(test, artifact, artifact)
    assert again["same_test"] and not again["promote"] and abs(again["champion"]["pr_auc"] - artifact.metrics["pr_auc"]) < 1e-9
    assert learning.challenge(test, artifact, None)["promote"]


def test_categories_of_the_caller_stay(spark, artifact):
    odd = spark.createDataFrame([(1, 0.9, None)], "id int, a double, c string")
    assert artifact.score(odd).first()["c"] is None


def test_importance_counts_every_feature(spark, monkeypatch):
    """The registered query against the mean over the whole matrix, with more features than a row's factors."""
    names = [f"f{k}" for k in range(14)]
    random.seed(5)
    own = []
    for i in range(900):
        x = [random.random() for _ in names]
        own.append((i, 200006, int(sum(x) + random.random() > 7.5), ("train", "train", "val", "test")[i % 4], *x))
    rows = spark.createDataFrame(own, "id int, period int, churn int, split string, " + ", ".join(f"{f} double" for f in names)).repartition(3)
    artifact = learning.train(rows, names, [], boosting.Settings(trees=12, depth=3, least_hessian=5.0))
    phi, _ = explain.shapley(binned(artifact, spark.createDataFrame(own, rows.schema)), explain.leaves(artifact))
    assert ((phi != 0).sum(axis=1) > explain.TOP).any()
    monkeypatch.setattr(catalog, "_trained", lambda spark, sf_dir: (artifact, rows))
    got = [tuple(r) for r in catalog.global_importance(spark, "").collect()]
    want = sorted(zip(names, np.abs(phi).mean(axis=0)), key=lambda x: (-x[1], x[0]))
    assert [f for f, _ in got] == [f for f, _ in want] and np.allclose([v for _, v in got], [v for _, v in want])


def test_artifacts_travel(tmp_path, rows, artifact):
    registry = learning.Registry(str(tmp_path))
    assert registry.champion() is None
    said = lambda ap: promotion.verdict(promotion.outcomes(rows.sparkSession, {"pr_auc": ap}))
    assert registry.promote(artifact, "v1", said(0.5)) and not registry.promote(artifact, "v2", said(0.1))
    assert (tmp_path / "decisions" / "v2" / "decision.md").read_text().startswith("# v2: not promoted") and registry.release()["version"] == "v1"
    again = registry.champion()
    key = lambda a: sorted((r["id"], round(r["probability"], 9)) for r in a.score(rows.filter("split = 'test'")).collect())
    assert key(again) == key(artifact) and again.threshold == artifact.threshold
    assert registry.rollback("v1").features == artifact.features


def test_one_class_is_an_error(rows):
    with pytest.raises(ValueError):
        learning.train(rows.withColumn("churn", F.lit(0)), ["a"])


def test_a_kept_model_is_built_anew_when_its_tables_are(spark, monkeypatch):
    """Unchanged tables: nothing is built or read again. Newer ones: another matrix, and the old one's files are gone; ``forget`` deletes the last."""
    clock, built = {"t": 1}, []
    monkeypatch.setattr(catalog, "_MODELS", {})
    monkeypatch.setattr(catalog, "_model_rows", lambda spark, sf_dir: spark.range(3).withColumn("period", F.lit(202401)))
    monkeypatch.setattr(catalog.learning, "train", lambda *a: built.append(a) or len(built))
    monkeypatch.setattr(catalog.split, "temporal_split", lambda rows: rows)
    monkeypatch.setattr(catalog.files, "modified", lambda spark, path: clock["t"])
    first, rows = catalog._trained(spark, "/x")
    assert catalog._trained(spark, "/x")[0] == first == 1 and catalog._trained(spark, "/x")[1] is rows
    old = rows.inputFiles()[0]
    clock["t"] = 2
    again, newer = catalog._trained(spark, "/x")
    assert again == 2 and newer.count() == 3 and not catalog.files.exists(spark, old)
    last = newer.inputFiles()[0]
    catalog.forget()
    assert not catalog._MODELS and not catalog.files.exists(spark, last)


def executed(df):
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_features_go_to_the_explanation(spark, rows, artifact, monkeypatch, tmp_path):
    """What neither the model nor the result needs isn't read, however wide the kept matrix is."""
    rows.withColumns({"period": F.lit(200006), "unused": F.lit("x")}).write.parquet(f"{tmp_path}/wide")
    wide = spark.read.parquet(f"{tmp_path}/wide")
    monkeypatch.setattr(catalog, "_trained", lambda spark, sf_dir: (artifact, wide))
    out = catalog.tree_shap_topn(spark, "")
    assert "unused" not in executed(out)
    want = explain.contributions(wide, artifact).select("id", F.posexplode("factors").alias("p", "f")).select("id", F.col("p") + 1, "f.feature", "f.value", "f.shap", "f.direction")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_only_what_a_batch_tells_goes_through_scoring(spark, rows, artifact, tmp_path):
    """A column that no feature and no part of a batch is doesn't go through the explanation; the batch is the same."""
    own = rows.withColumns({"t": F.col("period") - 202401, "plan": F.lit("adv-tbl-ar"), "country": F.lit("x"), "state": F.lit("ACTIVE"), "name": F.lit("n")})
    own.withColumn("unused", F.lit("y")).write.parquet(f"{tmp_path}/wide")
    book = PriceBook({"adv": {"ar": 50.0}}, {}, "EUR", "ar")
    wide = spark.read.parquet(f"{tmp_path}/wide")
    got, want = (scoring.score_period(x, artifact, book) for x in (wide, wide.drop("unused")))
    plan = executed(got)
    assert plan.count("MapInPandas") and not [line for line in plan.splitlines() if "MapInPandas" in line and "unused" in line]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_the_model_rows_are_dealt_before_any_step_holds_them(spark, monkeypatch):
    """Sums, sorts and joins by customer have tasks of a bounded number of rows, not of a size that the planner or the files give; the rows are the same."""
    sf_dir = "/root/testdata/sf0.001"
    plain = catalog._model_rows(spark, sf_dir)
    monkeypatch.setattr(panel, "TASK_ROWS", 100)
    own = catalog._model_rows(spark, sf_dir)
    shuffles = [line for line in executed(own).splitlines() if "Exchange hashpartitioning(" in line]
    by_customer = [line for line in shuffles if "custkey#" in line or "(id#" in line]
    assert by_customer and all("REPARTITION_BY_NUM" in line for line in by_customer)
    assert own.rdd.getNumPartitions() == 15 and sum(", 30), REPARTITION_BY_NUM" in line for line in by_customer) >= 3
    assert sorted(map(str, own.collect())) == sorted(map(str, plain.collect()))
