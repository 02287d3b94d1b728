"""Gradient-boosted risk scores: training, calibration, storage, promotion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import boosting, metrics, promotion
from tidepanel.sources import files
from tidepanel.sources.versions import Versions


@dataclass
class Artifact:
    """Trees with their feature contract, and the ``calibrator`` that maps their probability."""

    model: boosting.Boosted
    calibrator: IsotonicRegressionModel
    features: list[str]
    categories: list[str]
    threshold: float
    metrics: dict[str, float]
    periods: list[int]

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``probability``, calibrated. Features that ``rows`` lacks, nulls and categories that weren't there in training go the way that trees have for nulls."""
        out = self.calibrator.transform(self.model.score(rows)).drop("_raw")
        return out.withColumn("probability", F.least(F.greatest("_calibrated", F.lit(0.0)), F.lit(1.0))).drop("_calibrated")

    def save(self, folder: str) -> None:
        """Calibrator and trees, and last the metadata, without which a folder holds no artifact."""
        spark = SparkSession.active()
        self.calibrator.write().overwrite().save(f"{folder}/calibrator")
        files.write_json(spark, f"{folder}/trees.json", self.model.as_json())
        data = {k: getattr(self, k) for k in ("features", "categories", "threshold", "metrics", "periods")}
        files.write_json(spark, f"{folder}/metadata.json", data)

    @classmethod
    def load(cls, folder: str) -> Artifact:
        spark = SparkSession.active()
        data = files.read_json(spark, f"{folder}/metadata.json")
        return cls(boosting.Boosted.of_json(files.read_json(spark, f"{folder}/trees.json")), IsotonicRegressionModel.load(f"{folder}/calibrator"), **data)


def evaluate(scored: DataFrame, label: str = "churn", score: str = "probability") -> dict[str, float]:
    return metrics.evaluation(scored.select(label, score), label, score).first().asDict()


def isotonic(rows: DataFrame, label: str = "label", raw: str = "_raw", to: str = "_calibrated") -> IsotonicRegressionModel:
    """The least-squares step function of a score that never falls; between its points it is linear, beyond them level."""
    return IsotonicRegression(featuresCol=raw, labelCol=label, predictionCol=to).fit(rows)


def train(split: DataFrame, features: list[str], categories: list[str] = (), settings: boosting.Settings | None = None) -> Artifact:
    """From rows with ``churn`` and ``split``: trees on train (positives weighed up to the negatives, stopped by average precision on val), isotonic calibration and the threshold on val, metrics on test."""
    counts = split.filter("split = 'train'").agg(F.count_if(F.col("churn") == 1), F.count_if(F.col("churn") == 0)).first()
    if not counts[0] or not counts[1]:
        raise ValueError("the training periods have one class only")
    numbers = [f for f in features if f not in categories]
    known = split.filter("split IN ('train', 'val') AND churn IS NOT NULL")
    known = known.withColumns({"_weight": F.when(F.col("churn") == 1, counts[1] / counts[0]).otherwise(1.0), "_val": F.col("split") == "val"})
    model = boosting.fit(known, numbers, list(categories), "churn", "_weight", "_val", settings)
    calibrator = isotonic(model.score(known.filter("_val")).select(F.col("churn").cast("double").alias("label"), "_raw"))
    periods = sorted(r["period"] for r in split.filter("split = 'train'").select("period").distinct().collect())
    out = Artifact(model, calibrator, list(features), list(categories), 0.5, {}, periods)
    out.threshold = evaluate(out.score(split.filter("split = 'val'")))["threshold"]
    out.metrics = evaluate(out.score(split.filter("split = 'test'")))
    return out


def gain_importance(artifact: Artifact, top: int = 30) -> list[tuple[str, float, float]]:
    """(feature, gain, percent of what is shown), most first."""
    own = sorted(zip(artifact.model.features, map(float, artifact.model.gains()), strict=True), key=lambda x: (-x[1], x[0]))[:top]
    total = sum(g for _, g in own) or 1.0
    return [(n, g, g * 100 / total) for n, g in own]


def comparable(test: DataFrame, champion: Artifact | None) -> tuple[dict[str, float] | None, bool]:
    """A champion's metrics on these rows, and whether they are of these rows: if any feature of its contract is missing, its stored ones stand in."""
    if champion is None:
        return None, True
    if set(champion.features) <= set(test.columns):
        return evaluate(champion.score(test)), True
    return champion.metrics, False


def challenge(test: DataFrame, candidate: Artifact, champion: Artifact | None, rules: tuple = promotion.RULES, forced: bool = False) -> dict:
    """The verdict on a candidate, both models on the same rows where the champion can score them: see ``promotion.verdict``, with same_test added."""
    other, same = comparable(test, champion)
    return {**promotion.verdict(promotion.outcomes(test.sparkSession, evaluate(candidate.score(test)), other, rules), forced), "champion": other, "same_test": same}


class Registry:
    """Champion and releases below a folder on any file system, with a log; promotion copies, rollback promotes an older release.

    Champion and releases are folders of versions (see ``versions``): the model, ``release.json`` and the log change in one step, so whatever
    fails before it leaves the old champion. ``registry.json`` repeats the log for other readers.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _versions(self, name: str) -> Versions:
        return Versions(SparkSession.active(), f"{self.folder}/{name}")

    def release(self) -> dict | None:
        """What is known of the champion: version, metrics and ``log``, the entries of all promotions, the last one its own."""
        at = self._versions("champion").current()
        return files.read_json(SparkSession.active(), f"{at}/release.json") if at else None

    def _crown(self, artifact: Artifact, version: str, entry: dict) -> None:
        spark = SparkSession.active()
        log = [*(self.release() or {"log": []})["log"], {"version": version, **entry}]

        def filled(at: str) -> None:
            artifact.save(at)
            files.write_json(spark, f"{at}/release.json", {"version": version, "metrics": artifact.metrics, "log": log})

        self._versions("champion").write(filled)
        files.write_json(spark, f"{self.folder}/registry.json", log, files.replace_text)

    def promote(self, artifact: Artifact, version: str, decided: dict) -> bool:
        """Writes the decision (JSON and Markdown) in any case, and if it is for promotion the release and the champion."""
        spark, at = SparkSession.active(), f"{self.folder}/decisions/{version}"
        files.write_json(spark, f"{at}/decision.json", decided, files.replace_text)
        files.replace_text(spark, f"{at}/decision.md", promotion.as_markdown(decided, artifact.metrics, decided.get("champion"), version, decided.get("same_test", True)))
        if not decided["promote"]:
            return False
        self._versions(f"releases/{version}").write(artifact.save)
        self._crown(artifact, version, {"metrics": artifact.metrics, "decision": decided})
        return True

    def champion(self) -> Artifact | None:
        at = self._versions("champion").current()
        return Artifact.load(at) if at else None

    def rollback(self, version: str) -> Artifact:
        """The champion becomes an older release; one that isn't there is an error."""
        at = self._versions(f"releases/{version}").current()
        if not at:
            raise KeyError(version)
        own = Artifact.load(at)
        self._crown(own, version, {"rollback": True})
        return own
