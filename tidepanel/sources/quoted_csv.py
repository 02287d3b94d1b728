"""CSV files with line ends inside quotes, read by as many tasks as there are blocks.

Whether a line end is inside quotes depends on all quotes before it, so a file seems to need one reader. But only their parity counts: every
block (what Spark's splits of the file are) reports its number of quotes, modulo two; the running sum of these tells each block whether it
begins inside quotes. Then all blocks cut their lines into records at once. What a block holds before its first record starts and after its last one
has begun is a fragment; fragments of a record, and they alone, are brought together. Records are parsed in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.sources import files

#: Blocks whose parities are handed to the tasks; beyond this the input should be read in parts. 100 TB in splits of 128 MB are below it.
MOST_BLOCKS = 1_000_000
BATCH = 4096
OPTIONS = {"escape": '"', "multiLine": "true"}


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, line: lines by line feeds alone, in the order of their block."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def parities(lines: DataFrame) -> dict[tuple[str, int], int]:
    """By file and block: whether it begins inside quotes."""
    odd = F.sum(F.length("line") - F.length(F.replace("line", F.lit('"'))))
    counts = lines.groupBy("file", "block").agg(odd.alias("quotes"))
    before = F.coalesce(F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = counts.select("file", "block", (before % 2).cast("int").alias("inside")).limit(MOST_BLOCKS + 1).collect()
    if len(found) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks: read the files in parts")
    return {(r["file"], r["block"]): r["inside"] for r in found}


def _cut(lines: DataFrame, inside: dict[tuple[str, int], int], whole: bool) -> DataFrame:
    """file, block, place, record, part: the records that lie in one block, or (not ``whole``) the fragments of the others, and each file's first record if it is no fragment."""
    shared = lines.sparkSession.sparkContext.broadcast(inside)
    names, kinds = ["file", "block", "place", "record", "part"], (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, place, odd, head = shared.value, None, 0, 0, False
        held: list[str] = []
        out: list[tuple] = []

        def put(part: str | None) -> None:
            if whole == (part is None) or (part is None and place == 0 and at[1] == 0):
                out.append((*at, place, "\n".join(held), part))

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for b in batches:
            own_files, blocks, texts = b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("line").to_pylist()
            quotes = np.asarray(pc.count_substring(b.column("line"), '"')) % 2
            for file, block, line, o in zip(own_files, blocks, texts, quotes.tolist(), strict=True):
                if (file, block) != at:
                    if held:
                        put("middle" if head else "start")
                    at, place, held = (file, block), 0, []
                    odd = state[at]
                    head = bool(odd)  # lines up to the next start belong to a record of a block before
                held.append(line)
                odd ^= o
                if not odd:
                    put("end" if head else None)
                    held, head, place = [], False, place + 1
            if len(out) >= BATCH:
                yield packed()
        if held:
            put("middle" if head else "start")
        yield packed()

    return lines.mapInArrow(cut, "file string, block long, place long, record string, part string")


def _records(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """file, block, place, record of all records, and of the first of each file alone."""
    lines = _lines(spark, path)
    inside = parities(lines)
    few = files.kept(_cut(lines, inside, whole=False), "fragments")
    # a fragment belongs to the last start at or before it: a block has two at most
    chain = F.last(F.when(F.col("part") == "start", F.struct("block", "place")), ignorenulls=True).over(Window.partitionBy("file").orderBy("block", "place"))
    pieces = few.filter("part IS NOT NULL").withColumn("_of", chain)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "record"))), lambda x: x["record"]), "\n")
    joined = pieces.groupBy("file", "_of").agg(text.alias("record")).select("file", "_of.block", "_of.place", "record")
    first = few.filter("part IS NULL").drop("part").unionByName(joined.filter("block = 0 AND place = 0"))
    return _cut(lines, inside, whole=True).drop("part").unionByName(joined), first


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, place, record: the records of CSV files as text, with the line ends inside their quotes; the first of a file has block 0 and place 0.

    A quote is doubled inside quotes. A record that quotes never close runs to the end of its file. Order within a file is by block and place.
    """
    return _records(spark, path)[0]


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns of quoted CSV files with a header, as strings: what ``spark.read`` with ``multiLine`` gives, but in parallel; with ``_file``, ``_block`` and ``_place``.

    Files are told by their own headers and put together by name. A byte order mark is dropped, and so are empty records, and a carriage
    return at the end of one. Fields that a record lacks are null, and so are empty ones; those beyond the header are dropped.
    """
    own, first = _records(spark, path)
    text = F.regexp_replace("record", r"\r\z", "")
    alike: dict[tuple[str, ...], list[str]] = {}
    for r in first.select("file", F.regexp_replace(text, "^\ufeff", "").alias("head")).orderBy("file").collect():
        alike.setdefault(_fields(spark, r["head"]), []).append(r["file"])
    parts = []
    body = own.filter("NOT (block = 0 AND place = 0)").withColumn("record", text).filter("record <> ''")
    for names, own_files in alike.items():
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        mine = body if len(alike) == 1 else body.filter(F.col("file").isin(own_files))
        parsed = mine.select(F.from_csv("record", schema, OPTIONS).alias("r"), "file", "block", "place")
        parts.append(parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("place").alias("_place")))
    if not parts:
        return spark.createDataFrame([], "_file string, _block long, _place long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _fields(spark: SparkSession, head: str) -> tuple[str, ...]:
    """The names in a header record."""
    most = head.count(",") + 1
    schema = ", ".join(f"c{i} string" for i in range(most))
    r = spark.range(1).select(F.from_csv(F.lit(head), schema, OPTIONS).alias("r")).first()["r"]
    names = [x for x in r]
    while len(names) > 1 and names[-1] is None and not head.endswith(","):
        names.pop()
    return tuple(n if n is not None else f"_c{i}" for i, n in enumerate(names))
