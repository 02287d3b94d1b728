"""From raw snapshots to the matrix that models and reports read: panel, labels, features, kept as Parquet by period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidepanel.operators import features, labels
from tidepanel.sources import files, snapshots

#: Columns of the slim panel.
SLIM = ("id", "period", "t", "plan", "country", "state", "name", "churn", "is_ambiguous", "is_labelable", "months_in_panel")


@dataclass(frozen=True)
class Build:
    """What features are built of; columns that a panel lacks are left out."""

    sales: tuple[str, ...] = ()
    additions: tuple[str, ...] = ()
    delivery: tuple[str, ...] = ()
    salon: str | None = None
    usage: tuple[str, ...] = ()
    ratios: tuple[tuple[str, str, str], ...] = ()
    core: tuple[str, ...] = ()
    lags: tuple[int, ...] = (1, 2, 3)
    window: int = 3
    confirm_window: int = 3
    ambiguous_policy: str = "drop"


def feature_matrix(labelled: DataFrame, build: Build) -> DataFrame:
    """All features of a labelled panel: one row a row. Every window is by id and t, so the whole build is one shuffle and its sorts."""
    own = features.sales_mix(labelled, list(build.sales), list(build.additions), list(build.delivery), build.salon, list(build.usage))
    own = features.config_ratios(own, {name: (num, den) for name, num, den in build.ratios})
    if "state" in own.columns:
        own = features.state_features(own)
    if "plan" in own.columns:
        own = features.plan_features(own)
    lagged = features.lagged_columns(own)
    core = [c for c in (*build.core, "sales_total", "additions_total") if c in lagged]
    own = features.temporal(own, lagged, core, build.lags, build.window)
    return features.history(own) if "plan" in own.columns else own


def prepare(spark: SparkSession, raw: str, matrix: str, slim: str, build: Build, force: bool = False, **names: str) -> DataFrame:
    """The feature matrix at ``matrix`` (Parquet by period), built from the snapshots at ``raw`` where it is missing, older than one of them, or ``force`` is set.

    The labelled panel without features goes to ``slim``. ``names``: what the snapshots call id, period, creation and state, as of
    ``snapshots.load_panel``. What is returned is read from the written files, so nothing is computed twice.
    """
    if force or snapshots.is_stale(spark, raw, matrix):
        labelled = labels.label(snapshots.load_panel(spark, raw, **names), build.confirm_window, build.ambiguous_policy)
        feature_matrix(labelled, build).write.mode("overwrite").partitionBy("period").parquet(matrix)
        labelled.select(*[c for c in SLIM if c in labelled.columns]).write.mode("overwrite").parquet(slim)
    if not files.exists(spark, matrix):
        raise FileNotFoundError(matrix)
    return spark.read.parquet(matrix)
