import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidepanel.operators import boosting, metrics


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema + ", y int, w double, val boolean").repartition(3)


def fit(df, numbers, categories=(), **settings):
    s = boosting.Settings(**{"rows": 1.0, "columns": 1.0, "least_hessian": 0.1, **settings})
    return boosting.fit(df, list(numbers), list(categories), "y", "w", "val", s)


def test_one_split_is_the_best_of_all(spark):
    """Against trying every cut, with the nulls on either side: gain, sides and values."""
    rng = np.random.default_rng(1)
    x = [None if rng.random() < 0.2 else float(rng.integers(0, 30)) for _ in range(400)]
    y = [int(rng.random() < (0.7 if v is None else 0.2 if v < 11 else 0.6)) for v in x]
    model = fit(frame(spark, [(v, k, 1.0, False) for v, k in zip(x, y, strict=True)], "x double"), ["x"], trees=1, depth=1, step=1.0, l1=0.5, l2=2.0)
    g, h = np.array([0.5 - k for k in y]), np.full(len(y), 0.25)
    worth = lambda m: max(0, abs(g[m].sum()) - 0.5) ** 2 / (h[m].sum() + 2.0)
    best = (0.0, None, None)
    for cut in range(-1, 30):
        for nulls in (False, True):
            left = np.array([nulls if v is None else v <= cut for v in x])
            if 0 < left.sum() < len(left):
                gain = worth(left) + worth(~left) - worth(np.ones(len(left), dtype=bool))
                best = max(best, (gain, cut, nulls), key=lambda b: b[0])
    tree = model.trees[0]
    assert np.isclose(tree.gain[0], best[0]) and tree.table[0][0] == best[2]
    left = np.array([best[2] if v is None else v <= best[1] for v in x])
    assert np.isclose(tree.value[1], -np.sign(g[left].sum()) * (abs(g[left].sum()) - 0.5) / (h[left].sum() + 2.0))
    assert np.isclose(sum(tree.cover[1:]), tree.cover[0]) and np.isclose(tree.cover[0], 100.0)


def test_nulls_have_a_side_of_their_own_in_the_middle(spark):
    """Nulls behave like large values at one feature and like small ones at another: a fixed stand-in for null couldn't do both in one split each."""
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(900):
        a, b = (None if rng.random() < 0.3 else float(rng.integers(0, 10) / 10) for _ in range(2))
        high = (a is None or a > 0.5) and (b is None or b < 0.5)
        rows.append((a, b, int(high), 1.0, False))
    df = frame(spark, rows, "a double, b double")
    model = fit(df, "ab", trees=1, depth=2, step=1.0)
    scored = model.score(df).collect()
    assert all((r["_raw"] > 0.5) == (r["y"] == 1) for r in scored)
    nan = spark.createDataFrame([(float("nan"), 0.1)], "a double, b double")
    assert model.score(nan).first()["_raw"] == model.score(spark.createDataFrame([(None, 0.1)], "a double, b double")).first()["_raw"] == model.score(spark.createDataFrame([(0.1,)], "b double")).first()["_raw"]


def test_categories_are_parted_not_ordered(spark):
    """Every other one of 20 categories is positive, in no order of theirs: one split has to do."""
    rng = np.random.default_rng(3)
    names = [f"c{k:02d}" for k in range(20)]
    rows = [(c, int(names.index(c) % 2), 1.0, False) for c in rng.choice(names, 1500)] + [(None, 1, 1.0, False)] * 30
    df = frame(spark, rows, "c string")
    model = fit(df, [], ["c"], trees=1, depth=1, step=1.0)
    assert len(model.trees[0].value) == 3
    assert all((r["_raw"] > 0.5) == (r["y"] == 1) for r in model.score(df).collect())
    unseen = spark.createDataFrame([("never seen",), (None,)], "c string")
    assert len({r["_raw"] for r in model.score(unseen).collect()}) == 1


def noisy(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    y = rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0, x[:, 3], -1.5) - 1.5)))
    missing = rng.random((n, 8)) < 0.1
    return [(*[None if m else float(v) for v, m in zip(r, q, strict=True)], int(k), 1.0, i % 4 == 0) for i, (r, q, k) in enumerate(zip(x, missing, y, strict=True))]


def test_ranks_at_least_as_well_as_spark_ml(spark):
    names = [f"x{k}" for k in range(8)]
    known, test = (frame(spark, noisy(spark, 4000, seed), ", ".join(f"{c} double" for c in names)).cache() for seed in (4, 5))
    model = fit(known, names, trees=60, depth=4, rows=0.8, columns=0.8, least_hessian=1.0)
    own = metrics.average_precision(model.score(test), "y", "_raw").first()["pr_auc"]
    filled = lambda df: VectorAssembler(inputCols=names, outputCol="x").transform(df.fillna(-1e9, names).withColumn("label", F.col("y").cast("double")))
    other = GBTClassifier(featuresCol="x", maxIter=30, maxDepth=4, stepSize=0.15, subsamplingRate=0.8, seed=7, validationIndicatorCol="val", maxBins=64).fit(filled(known))
    theirs = metrics.average_precision(other.transform(filled(test)).withColumn("p", vector_to_array("probability")[1]), "y", "p").first()["pr_auc"]
    assert own >= theirs - 0.002


def test_fitting_ends_at_the_best_average_precision(spark):
    """Labels of chance: precision on the rows held back soon stops rising. What is kept is the best number of trees, and reruns agree."""
    rng = np.random.default_rng(6)
    df = frame(spark, [(float(a), int(rng.random() < 0.3), 1.0, i % 2 == 0) for i, a in enumerate(rng.random(600))], "x double")
    once, twice = (fit(df, ["x"], trees=40, patience=3, depth=4, rows=0.7) for _ in range(2))
    assert len(once.trees) < 40 and once.as_json() == twice.as_json()
    again = boosting.Boosted.of_json(once.as_json())
    assert [r["_raw"] for r in again.score(df).sort("x").collect()] == [r["_raw"] for r in once.score(df).sort("x").collect()]


def test_margins_are_the_same_with_and_without_folding(spark, monkeypatch):
    names = [f"x{k}" for k in range(8)]
    df = frame(spark, noisy(spark, 800, 7), ", ".join(f"{c} double" for c in names)).coalesce(2).cache()
    one = fit(df, names, trees=9, depth=3)
    monkeypatch.setattr(boosting, "FOLD", 2)
    other = fit(df, names, trees=9, depth=3)
    assert [t.feature for t in one.trees] == [t.feature for t in other.trees]
    assert np.allclose([v for t in one.trees for v in t.value], [v for t in other.trees for v in t.value])


def test_columns_are_drawn_for_each_tree(spark):
    df = frame(spark, noisy(spark, 600, 8), ", ".join(f"x{k} double" for k in range(8)))
    model = fit(df, [f"x{k}" for k in range(8)], trees=12, depth=2, columns=0.25, patience=99)
    used = [{f for f, left in zip(t.feature, t.left, strict=True) if left} for t in model.trees]
    assert all(len(u) <= 2 for u in used) and len(set().union(*used)) > 3


def test_odd_features(spark):
    """Constant, all null, and repeated rows; more categories than bins; no split gains on one value."""
    rows = [(1.0, None, f"k{i % 200}", i % 2, 1.0, False) for i in range(800)] + [(1.0, None, None, 1, 1.0, False)] * 40
    model = fit(frame(spark, rows, "a double, b double, c string"), "ab", ["c"], trees=3, depth=3)
    assert len(model.levels["c"]) == boosting.BINS - 1 and model.edges["b"] == []
    assert all(t.feature[0] == 2 for t in model.trees)
    nothing = fit(frame(spark, [(1.0, 1, 1.0, False), (1.0, 0, 1.0, False)] * 20, "a double"), ["a"], trees=3)
    assert nothing.trees == []
    with pytest.raises(ValueError):
        fit(frame(spark, [], "a double"), ["a"], trees=1)
