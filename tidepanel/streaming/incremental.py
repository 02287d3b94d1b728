"""Snapshots as they arrive: a file stream that upserts by id and period."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidepanel.operators.panel import last_wins
from tidepanel.sources import files


def upsert(current: DataFrame | None, batch: DataFrame, order: list[str]) -> DataFrame:
    """The rows of both, the last by ``order`` for each id and period."""
    own = last_wins(batch, order)
    return own if current is None else last_wins(current.unionByName(own, allowMissingColumns=True), order)


ORDER = ("file_time", "file_name", "file_block", "place")


def placed(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` of a stream as they come from files, with the file, block and place in it that each is from: what decides between rows of one id and period.

    Parquet numbers its rows itself; those of other files are counted as each block is read.
    """
    meta = {"file_time": "file_modification_time", "file_name": "file_path", "file_block": "file_block_start"}
    own = rows.select("*", *[F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()], (F.col("_metadata.row_index") if kind == "parquet" else F.lit(0).cast("long")).alias("place"))
    if kind == "parquet":
        return own

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            yield b.set_column(b.schema.get_field_index("place"), "place", pa.array(range(n, n + b.num_rows), pa.int64()))
            n += b.num_rows

    return own.mapInArrow(counted, own.schema)


def merged(target: str, order: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """Puts a batch into the period folders below ``target``: only the periods of the batch are read and replaced (dynamic partition overwrite).

    Of rows with one id and period the last by ``order`` stays, of all there are; without an order the batch's own.
    """

    def merge(batch: DataFrame, _: int) -> None:
        touched = [r["period"] for r in batch.select("period").distinct().collect()]
        if not touched:
            return
        session = batch.sparkSession
        current = None
        if files.exists(session, f"{target}/data"):
            current = session.read.parquet(f"{target}/data").filter(F.col("period").isin(touched))
        if order:
            rows = upsert(current, batch, list(order))
        else:
            rows = batch if current is None else batch.unionByName(current.join(batch.select("id", "period"), ["id", "period"], "left_anti"), allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{target}/staged")
        session.read.parquet(f"{target}/staged").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(f"{target}/data")

    return merge


def follow(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Files that come into ``source``, merged into period folders below ``target``; ends when all files there are read.

    A batch that runs again after a failure writes the same rows again: what a row corrects is decided by its file's time and name and its
    place in it, not by when it is read.
    """
    rows = placed(spark.readStream.schema(schema).format(kind).load(source), kind)
    return rows.writeStream.foreachBatch(merged(target, ORDER)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
