"""Scored batches and reports as they are kept: a versioned folder a period, its metadata in it, and views of both.

Layout: ``{folder}/{period}`` is a folder of versions (see ``versions``), each of ``predictions.parquet``, ``predictions.json`` where asked for, and
``metadata.json``; ``{folder}/latest.json`` names the latest period and its folder, for readers without this library. A period is replaced alone and at
once: until all of it is written, the old version is what ``load`` and all views read.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.sources import files
from tidepanel.sources.versions import Versions


@dataclass(frozen=True)
class BatchStore:
    """The batches below a folder, on any file system."""

    spark: SparkSession
    folder: str

    def write(self, scored: DataFrame, period: int, metadata: dict[str, Any], formats: tuple[str, ...] = ("parquet",)) -> None:
        """One period's batch. In JSON, nested columns are strings of JSON."""
        def filled(at: str) -> None:
            for kind in formats:
                nested = [c for c, t in scored.dtypes if t.startswith(("array<struct", "struct"))]
                rows = scored if kind == "parquet" else scored.withColumns({c: F.to_json(c) for c in nested})
                rows.write.format(kind).save(f"{at}/predictions.{kind}")
            files.write_json(self.spark, f"{at}/metadata.json", {**metadata, "period": period})

        self._of(period).write(filled)
        latest = self.periods()[0]
        files.write_json(self.spark, f"{self.folder}/latest.json", {"period": latest, "folder": self._of(latest).current()}, files.replace_text)

    def _of(self, period: int) -> Versions:
        return Versions(self.spark, f"{self.folder}/{period}")

    def periods(self) -> list[int]:
        """The periods that there are, latest first."""
        return sorted((int(n) for n in files.names(self.spark, self.folder, folders=True) if n.isdigit() and self._of(int(n)).current()), reverse=True)

    def folder_of(self, period: int | None = None) -> str:
        """Where the current version of a period (the latest by default) lies."""
        return self._of(self.resolve(period)).current()

    def resolve(self, period: int | None = None) -> int:
        """A period that is there, the latest by default."""
        known = self.periods()
        if not known:
            raise FileNotFoundError(f"no batch in {self.folder}")
        if period is not None and period not in known:
            raise KeyError(period)
        return known[0] if period is None else period

    def load(self, period: int | None = None, nested: dict[str, str] | None = None) -> DataFrame:
        """A batch. ``nested``: columns that are JSON strings, with their types; a string that isn't such JSON becomes an empty array."""
        rows = self.spark.read.parquet(f"{self.folder_of(period)}/predictions.parquet")
        kinds = dict(rows.dtypes)
        decoded = {c: F.coalesce(F.from_json(c, t), F.array().cast(t)) for c, t in (nested or {}).items() if kinds.get(c) == "string"}
        return rows.withColumns(decoded) if decoded else rows

    def metadata(self, period: int | None = None) -> dict[str, Any]:
        return files.read_json(self.spark, f"{self.folder_of(period)}/metadata.json")

    def view(self, name: str, period: int | None = None) -> Any:
        """``summary``: the head of a batch with its categories; ``importance``: the features that weigh most; ``model``: what scored it."""
        own = self.metadata(period)
        heads = {
            "summary": ("period", "predicted_period", "generated_at", "accounts", "currency", "prices_loaded", "threshold", "bands", "summary"),
            "model": ("trained_periods", "features", "baseline", "threshold", "metrics"),
        }
        return own.get("importance", []) if name == "importance" else {k: own.get(k) for k in heads[name]}

    def health(self, model_folder: str | None = None, report: str | None = None) -> dict[str, Any]:
        """Whether there is a batch, a model (its folder, or a champion's folder of versions) and a report to serve; ``degraded`` without a batch."""
        known = self.periods()
        has = lambda path: bool(path) and files.exists(self.spark, path)
        model = bool(model_folder) and (has(f"{model_folder}/metadata.json") or Versions(self.spark, model_folder).current() is not None)
        return {"status": "ok" if known else "degraded", "periods": known, "model": model, "report": has(report)}


def load_report(spark: SparkSession, path: str) -> dict:
    """The report as it was last written; one that isn't there is an error."""
    return files.read_json(spark, path)
