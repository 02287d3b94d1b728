"""Small files by Spark's file systems, so that any store will do."""

from __future__ import annotations

import json
import tempfile
import uuid
import weakref
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


#: The folders behind tables that ``kept`` has made.
_KEPT: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _of(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    fs, own = _of(spark, path)
    return fs.exists(own)


def names(spark: SparkSession, path: str, folders: bool = False) -> list[str]:
    """What a folder holds, or the folders in it alone, in order; nothing where it isn't there."""
    fs, own = _of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(own) if not folders or s.isDirectory()) if fs.exists(own) else []


def touch(spark: SparkSession, path: str) -> None:
    """Creates an empty file; one that is there is an error."""
    fs, own = _of(spark, path)
    fs.create(own, False).close()


def modified(spark: SparkSession, path: str) -> int | None:
    fs, own = _of(spark, path)
    return fs.getFileStatus(own).getModificationTime() if fs.exists(own) else None


def delete(spark: SparkSession, path: str) -> None:
    fs, own = _of(spark, path)
    fs.delete(own, True)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in place of another of that name, which readers see until it is replaced: written beside it, then renamed over it."""
    beside = f"{path}.{uuid.uuid4().hex}"
    write_text(spark, beside, text)
    jvm, context = spark._jvm, spark.sparkContext
    fs = jvm.org.apache.hadoop.fs
    old, new = fs.Path(beside), fs.Path(path)
    over = context._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    over[0] = getattr(fs, "Options$Rename").OVERWRITE
    conf = spark._jsc.hadoopConfiguration()
    fs.FileContext.getFileContext(old.getFileSystem(conf).getUri(), conf).rename(old, new, over)


def read_text(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first()[0]


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file, decompressed if its name says so; empty if there is none. Only its first block is opened."""
    fs, own = _of(spark, path)
    jvm = spark._jvm
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(own)
    stream = fs.open(own)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Without a checksum beside it: such files are edited by hand, and a local file system would then refuse to read them."""
    fs, own = _of(spark, path)
    sums = hasattr(fs, "getChecksumFile")
    if sums:
        fs.delete(fs.getChecksumFile(own), False)
        fs.setWriteChecksum(False)
    try:
        out = fs.create(own, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
    finally:
        if sums:
            fs.setWriteChecksum(True)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))


def write_json(spark: SparkSession, path: str, data: Any, write: Callable[[SparkSession, str, str], None] = write_text) -> None:
    write(spark, path, json.dumps(data, ensure_ascii=False, indent=2, default=str))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir`` or the context's; only a session in one process may do with a temporary one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and context.master.split("[")[0] == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kept-"))
        found = context.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet (by some columns) and read back: what several queries read is computed once, until ``release``."""
    folder = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(f"{folder}/{name}")
    out = df.sparkSession.read.parquet(f"{folder}/{name}")
    _KEPT[out] = folder
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables made by ``kept`` that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        if folder := _KEPT.pop(t, None):
            delete(t.sparkSession, folder)
