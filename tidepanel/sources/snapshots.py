"""Snapshot files to one table: resolution, header names, union by name, last file wins, and a cache of features."""

from __future__ import annotations

import csv
import logging
import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.arithmetic import not_nan
from tidepanel.operators.panel import dense_index, last_wins, missing_periods, severity, tenure_months
from tidepanel.sources import files

log = logging.getLogger(__name__)
SUFFIXES = (".csv", ".csv.gz", ".parquet")


#: What is dropped from a header, and the characters that its words are made of; words are joined by one underscore.
DROPPED, WORD = "($)", "[a-z0-9]+"


def normalised(name: str) -> str:
    """A header as a column name: its words in lower case."""
    return "_".join(re.findall(WORD, "".join(name.split(DROPPED)).lower()))


def resolve(spark: SparkSession, path: str) -> list[str]:
    """The snapshot files of a file, folder (known suffixes) or pattern, in order of their names; on any file system that Spark reads. None is an error."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(own) or []
    if len(found) == 1 and found[0].isDirectory() and not found[0].getPath().getName().endswith(".parquet"):
        found = [s for s in fs.listStatus(found[0].getPath()) if s.getPath().getName().endswith(SUFFIXES)]
    if not len(found):
        raise FileNotFoundError(path)
    return sorted(s.getPath().toString() for s in found)


def _clean(df: DataFrame, extra: dict | None = None) -> DataFrame:
    """Normalised headers, no NaN, and ``extra`` columns."""
    names = [normalised(c) for c in df.columns]
    own = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)], *[c.alias(k) for k, c in (extra or {}).items()])
    return own.withColumns({f.name: not_nan(F.col(f.name)) for f in own.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def _reader(spark: SparkSession, paths: list[str], schema: T.StructType | None) -> DataFrame:
    if paths[0].endswith(".parquet"):
        return spark.read.parquet(*paths)
    # times without a zone are in UTC
    reader = spark.read.option("header", True).option("multiLine", False).option("timeZone", "UTC")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(paths)


def read_one(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One file with normalised headers and no NaN. Without a schema the types of a CSV are inferred, which reads it twice; names and types of Parquet are its own."""
    return _clean(_reader(spark, [path], schema))


#: Files whose first lines are read at a time.
OPENED = 32


def headers(spark: SparkSession, paths: list[str]) -> dict[str, tuple]:
    """The header of each file: for Parquet its names and types, for a CSV the names in its first line. No more of a file is read, and no CSV takes a Spark job."""

    def one(p: str) -> tuple:
        if p.endswith(".parquet"):
            return ("parquet", *((f.name, f.dataType.simpleString()) for f in spark.read.parquet(p).schema.fields))
        names = next(csv.reader([files.first_line(spark, p).lstrip("\ufeff")]), [])
        return ("csv", *((n or f"_c{i}", "") for i, n in enumerate(names)))

    with ThreadPoolExecutor(OPENED) as pool:
        return dict(zip(paths, pool.map(one, paths), strict=True))


def header_drift(found: dict[str, tuple]) -> dict[str, tuple[set[str], set[str]]]:
    """By file: columns that it lacks, and that it has besides those of the first file; files that agree are left out."""
    names = {p: {normalised(c) for c, _ in h[1:]} for p, h in found.items()}
    first = next(iter(names.values()))
    return {p: (first - own, own - first) for p, own in names.items() if own != first}


def load_raw(spark: SparkSession, path: str, id_name: str = "id", period_name: str = "periodo", schema: T.StructType | None = None) -> DataFrame:
    """All files of ``path``, put together by name; of rows with one id and period the last file's last stays.

    Files with the same header are one scan (a CSV reader goes by position, so those with another are another), and each scan infers types
    once: as many scans as there are headers, however many files. Files are in order of their paths; a file's rows in order of its blocks.
    """
    found = headers(spark, resolve(spark, path))
    for p, (missing, extra) in header_drift(found).items():
        log.warning("%s: lacks %s, adds %s", p, sorted(missing), sorted(extra))
    alike: dict[tuple, list[str]] = {}
    for p, h in found.items():
        alike.setdefault(h, []).append(p)
    place = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_place": F.monotonically_increasing_id()}
    parts = [_clean(_reader(spark, own, schema), place) for own in alike.values()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for name in (id_name, period_name):
        if name not in rows.columns:
            raise ValueError(f"required column {name!r} is missing")
    rows = rows.withColumnsRenamed({id_name: "id", period_name: "period"})
    return last_wins(rows, ["_file", "_block", "_place"]).drop("_file", "_block", "_place")


def load_panel(spark: SparkSession, path: str, id_name: str = "id", period_name: str = "periodo", created: str | None = "fecha_ts", state: str | None = "estado", schema: T.StructType | None = None) -> DataFrame:
    """``load_raw`` with t, tenure_months and severity where their columns are there; months without rows are warned of."""
    rows = dense_index(load_raw(spark, path, id_name, period_name, schema))
    if created and created in rows.columns:
        text = F.regexp_replace(F.col(created).cast("string"), r"\s*\+0000$", "").try_cast("timestamp_ntz")
        at = F.col(created) if dict(rows.dtypes)[created].startswith(("timestamp", "date")) else text
        rows = rows.withColumn("tenure_months", tenure_months(F.col("period"), at))
    if state and state in rows.columns:
        rows = rows.withColumn("severity", severity(F.col(state)))
    if gone := [r["period"] for r in missing_periods(rows).orderBy("period").collect()]:
        log.warning("no rows in %s: their neighbours count as adjacent", gone)
    return rows


def downcast(df: DataFrame, keep: tuple[str, ...] = ("id", "period")) -> DataFrame:
    """Long and double columns as 32 bits, to save memory in what collects them; Spark itself doesn't need it."""
    kinds = {"bigint": "int", "double": "float"}
    return df.withColumns({c: F.col(c).cast(kinds[k]) for c, k in df.dtypes if k in kinds and c not in keep})


def is_stale(spark: SparkSession, raw: str, cached: str) -> bool:
    """Whether the cache is missing, or older than a raw file; remote raw files never make it stale."""
    at = files.modified(spark, cached)
    if at is None:
        return True
    if "://" in raw and not raw.startswith("file:"):
        return False
    return any((files.modified(spark, p) or 0) > at for p in resolve(spark, raw))
