"""Helpers shared by the operators: staged tables, Arrow batches in pieces, column handling.

The one setting of the session that the operators change is ``spark.sql.execution.arrow.maxBytesPerBatch``: see ``bounded_batches``.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``[\x20\x09-\x0D]``, the white space of all word and line rules here.
SPACE = " \t\n\x0b\x0c\r"

#: The same class, and its complement, for Java's and DuckDB's regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch of rows that goes to Python, about.
BATCH_BYTES = 4 << 20

#: The folders behind tables that ``staged`` has made.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a session in one process (``local[n]``, as in tests) gets a temporary one, and a cluster an error: its executors
    and driver don't share temporary folders.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="staged-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    What only leads to the next table is deleted by ``discard``; tables that a returned DataFrame still reads stay until ``clear``.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``staged`` that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        if path := _FOLDERS.pop(t, None):
            _delete(t.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged, once the results have been written."""
    _delete(spark, _root(spark))


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches to Python hold ``BATCH_BYTES`` at most (a longer row alone) instead of Spark's default of 64 MB.

    A query runs after its operator has returned, so the setting can't be undone; one that the user has made stays.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if name not in conf.getAll:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def column(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """A struct of all columns of ``df`` but those named (in any case): what passes through an operator can't clash with its own columns."""
    gone = {w.lower() for w in without}
    return F.struct(*[column(c).alias(c) for c in df.columns if c.lower() not in gone] or [F.lit(None).cast("int").alias("none")])


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece hold about ``most_bytes``; a longer text is a piece of its own."""
    if batch.num_rows == 0:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def replaced(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with the columns in ``new`` set, in the order of ``extended``."""
    out, left = {}, {k.lower(): k for k in new}
    for name, own in zip(batch.schema.names, batch.columns, strict=True):
        if name.lower() not in {k.lower() for k in new}:
            out[name] = own
        elif key := left.pop(name.lower(), None):
            out[key] = new[key]
    out |= {k: new[k] for k in left.values()}
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def extended(df: DataFrame, **types: str) -> T.StructType:
    """The schema of ``df``, where each named column is set to the given type: in its place if ``df`` has it, in any case as Spark itself does, else at the end."""
    out, left = [], {k.lower(): k for k in types}
    for f in df.schema.fields:
        if f.name.lower() not in {k.lower() for k in types}:
            out.append(f)
        elif key := left.pop(f.name.lower(), None):
            out.append(T.StructField(key, T.DataType.fromDDL(types[key])))
    return T.StructType([*out, *[T.StructField(k, T.DataType.fromDDL(types[k])) for k in left.values()]])


def applied(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: dict[str, str], adds: dict[str, str], **more: Column) -> DataFrame:
    """``df`` with the columns ``adds`` (name to type) that ``function`` sets, on batches of the columns that it ``uses`` (its name to that of ``df``) and ``more``, which it leaves out of its result.

    All other columns go along in a struct, so they may have any name; those that are added replace any of the same name.
    """
    rows = df.select(packed(df, (*uses.values(), *adds)).alias("row"), *[column(v).alias(k) for k, v in uses.items()], *[c.alias(k) for k, c in more.items()])
    out = bounded_batches(rows).mapInArrow(function, extended(rows.drop(*more), **adds))
    back, gone = {v.lower(): k for k, v in uses.items()}, {k.lower() for k in adds}
    names = [c for c in df.columns if c.lower() not in gone]
    return out.select(*[(F.col(back[c.lower()]) if c.lower() in back else F.col("row").getField(c)).alias(c) for c in names], *adds)


def sha256_hex(column: str):
    """Lowercase hex of the UTF-8 bytes; null counts as empty."""
    return F.sha2(F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8"), 256)
