"""Writes that fail at any step leave what was there before."""

import json

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import boosting, learning, promotion
from tidepanel.sources import files, store
from tidepanel.sources.versions import Versions


class Broken(Exception):
    pass


@pytest.fixture
def fails_at(monkeypatch):
    """Sets the step, of all that touch files, at which the next one fails; returns whether it came to that."""
    state = {"left": None}
    own = files._of

    def counted(spark, path):
        if state["left"] is not None:
            state["left"] -= 1
            if state["left"] < 0:
                raise Broken(path)
        return own(spark, path)

    monkeypatch.setattr(files, "_of", counted)

    def run(step, action):
        state["left"] = step
        try:
            action()
            return False
        except Broken:
            return True
        finally:
            state["left"] = None

    return run


def test_versions_stay_and_go(spark, tmp_path):
    own = Versions(spark, str(tmp_path / "v"))
    assert own.current() is None
    seen = [own.write(lambda at, n=n: files.write_text(spark, f"{at}/x", str(n))) for n in range(4)]
    assert own.current() == seen[-1] and files.read_text(spark, f"{own.current()}/x") == "3"
    assert files.read_text(spark, f"{seen[-2]}/x") == "2"  # for those who still read it
    assert len(files.names(spark, f"{own.folder}/versions")) == len(files.names(spark, f"{own.folder}/commits")) == 2


def test_a_failing_column_leaves_the_old_batch(spark, tmp_path):
    kept = store.BatchStore(spark, str(tmp_path))
    kept.write(spark.range(3).withColumn("p", F.lit(0.5)), 202401, {"accounts": 3})
    bad = spark.range(5).withColumn("p", F.when(F.col("id") == 4, F.raise_error(F.lit("broken")).cast("double")).otherwise(0.1))
    with pytest.raises(Exception, match="broken"):
        kept.write(bad, 202401, {"accounts": 5})
    assert kept.periods() == [202401] and kept.load().count() == 3 and kept.metadata()["accounts"] == 3
    with pytest.raises(Exception, match="broken"):
        kept.write(bad, 202402, {"accounts": 5})
    assert kept.periods() == [202401] and json.loads((tmp_path / "latest.json").read_text())["period"] == 202401
    kept.write(spark.range(7).withColumn("p", F.lit(0.2)), 202401, {"accounts": 7})
    assert kept.load().count() == 7 and kept.metadata()["accounts"] == 7


def test_a_batch_is_old_or_new_whatever_step_fails(spark, tmp_path, fails_at):
    kept = store.BatchStore(spark, str(tmp_path))
    write = lambda n: kept.write(spark.range(n), 202401, {"accounts": n})
    write(1)
    n, step, failures = 2, 0, 0
    while fails_at(step, lambda: write(n)):
        rows = kept.load().count()
        assert rows == kept.metadata()["accounts"] and 1 <= rows <= n
        assert json.loads((tmp_path / "latest.json").read_text())["period"] == 202401
        n, step, failures = n + 1, step + 1, failures + 1
    assert failures > 5 and kept.load().count() == n


def test_a_champion_is_old_or_new_whatever_step_fails(spark, tmp_path, fails_at):
    known = spark.createDataFrame([(float(i % 7), int(i % 7 > 3), "train" if i % 3 else ("val" if i % 2 else "test"), 202401) for i in range(400)], "a double, churn int, split string, period int").cache()
    small, large = (learning.train(known, ["a"], settings=boosting.Settings(trees=n, depth=2, least_hessian=0.1, patience=99)) for n in (1, 2))
    large.threshold = 0.77
    registry = learning.Registry(str(tmp_path))
    decided = promotion.verdict(promotion.outcomes(spark, {"pr_auc": 0.9}))
    assert registry.champion() is None and registry.promote(small, "v0", decided)
    step, failures = 0, 0
    while fails_at(step, lambda: registry.promote(large if failures % 2 == 0 else small, f"v{failures + 1}", decided)):
        own, said = registry.champion(), registry.release()
        assert own.threshold == (large if said["version"] != "v0" and int(said["version"][1:]) % 2 else small).threshold
        assert own.score(known).count() == 400 and said["log"][-1]["version"] == said["version"]
        step, failures = step + 3, failures + 1
    assert failures > 4
    assert registry.release()["version"] == f"v{failures + 1}"
    with pytest.raises(KeyError):
        registry.rollback("never")
    assert registry.rollback("v0").threshold == small.threshold == registry.champion().threshold
    assert json.loads((tmp_path / "registry.json").read_text())[-1] == {"version": "v0", "rollback": True}
