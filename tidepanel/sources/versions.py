"""Folders that are replaced as a whole, on any file system: a new version beside the old one, then one step that makes it the current one.

Layout: ``{folder}/versions/{number}-{random}/...`` and ``{folder}/commits/{number}-{random}``, an empty file. What isn't named by a commit isn't
there; the current version is the one of the highest commit. Creating an empty file is one step on every store, and nothing is
ever renamed or overwritten, so a writer that fails anywhere leaves the old version as it was, and readers that have it open keep it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tidepanel.sources import files


@dataclass(frozen=True)
class Versions:
    """The versions below a folder. ``keep``: how many committed ones stay, for those who still read an older one."""

    spark: SparkSession
    folder: str
    keep: int = 2

    def _commits(self) -> list[str]:
        return files.names(self.spark, f"{self.folder}/commits")

    def _path(self, version: str) -> str:
        return f"{self.folder}/versions/{version}"

    def current(self) -> str | None:
        """The folder of the current version; None before the first."""
        known = self._commits()
        return self._path(known[-1]) if known else None

    def write(self, writer: Callable[[str], None]) -> str:
        """``writer`` fills the folder that it is given; when it has returned, that folder is the current version.

        If it fails, what it wrote is deleted, and nothing else has changed. Of two writers at once both may commit; the higher name stays current.
        """
        known = self._commits()
        number = int(known[-1].split("-")[0]) + 1 if known else 1
        version = f"{number:012d}-{uuid.uuid4().hex}"
        try:
            writer(self._path(version))
            files.touch(self.spark, f"{self.folder}/commits/{version}")
        except BaseException:
            files.delete(self.spark, self._path(version))
            raise
        self._prune([*known, version])
        return self._path(version)

    def _prune(self, known: list[str]) -> None:
        """Deletes versions before the oldest that stays, commits first, with what failed writers may have left among them."""
        first = known[-self.keep :][0]
        for v in known[: -self.keep]:
            files.delete(self.spark, f"{self.folder}/commits/{v}")
        for v in files.names(self.spark, f"{self.folder}/versions"):
            if v < first:
                files.delete(self.spark, self._path(v))
