"""State by account: after any order of arrivals the table is what a batch build over all rows gives."""

import random
import time

import pytest
from pyspark.sql import types as T

from tidepanel.operators import features, labels, panel
from tidepanel.streaming import incremental, keyed

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("period", T.IntegerType()), T.StructField("a", T.DoubleType()), T.StructField("b", T.IntegerType())])
METRICS = ["a", "b"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(12):
        for p in (202311, 202312, 202401, 202402, 202404, 202405, 202406, 202407):  # 202403 is missing
            if rng.random() < 0.65:
                out.append((i, p, None if rng.random() < 0.2 else round(rng.random() * 9, 3), rng.choice([None, 1, 2, 3])))
    return out


def put(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{name}")
    time.sleep(0.02)  # files of a later batch have a later time


def batch(spark, rows, **more):
    own = spark.createDataFrame(rows, SCHEMA)
    out = features.temporal(labels.label(panel.dense_index(own), **more), METRICS, ["a"])
    return {(r["id"], r["period"]): r.asDict() for r in out.collect()}


def streamed(spark, folder, **more):
    keyed.follow(spark, f"{folder}/in/*", SCHEMA, METRICS, f"{folder}/out", f"{folder}/ck").awaitTermination()
    return {(r["id"], r["period"]): r.asDict() for r in keyed.read(spark, f"{folder}/out", METRICS, ["a"], **more).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k].keys() == w.keys()
        for c, v in w.items():
            assert got[k][c] == v if not isinstance(v, float) else abs(got[k][c] - v) < 1e-9, (k, c)


@pytest.mark.parametrize("seed", [None, 1])
def test_equal_to_the_batch_build_in_any_order(spark, tmp_path, rows, seed):
    """Month by month, or dealt by chance: after each batch the table is what a build over the rows so far gives, and labels mature."""
    own = sorted(rows, key=lambda r: r[1])
    if seed is not None:
        random.Random(seed).shuffle(own)
    cuts = [0, len(own) // 3, 2 * len(own) // 3, len(own)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        put(spark, own[a:b], tmp_path, f"f{n}")
        same(streamed(spark, tmp_path), batch(spark, own[:b]))
    same({(r["id"], r["period"]): r.asDict() for r in keyed.read(spark, f"{tmp_path}/out", METRICS, ["a"], window=2, policy="negative").collect()}, batch(spark, own, window=2, policy="negative"))


def test_corrections_and_repeated_rows(spark, tmp_path):
    """The later file counts, in a file the last row; nothing else of the account is lost."""
    put(spark, [(1, 202401, 1.0, 1), (1, 202401, 2.0, 2), (1, 202402, 5.0, 1), (None, 202401, 1.0, 1), (2, None, 1.0, 1)], tmp_path, "f0")
    streamed(spark, tmp_path)
    put(spark, [(1, 202401, 7.0, None), (1, 202403, 6.0, 1), (1, 202401, 8.0, None)], tmp_path, "f1")
    same(streamed(spark, tmp_path), batch(spark, [(1, 202401, 8.0, None), (1, 202402, 5.0, 1), (1, 202403, 6.0, 1)]))


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_upserts_decide_ties_in_a_file_by_place(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, 202401, float(v), v) for v in range(50)] + [(2, 202401, 0.0, 0)], SCHEMA)
    rows.coalesce(1).write.format(kind).save(f"{tmp_path}/in/f0")
    incremental.follow(spark, f"{tmp_path}/in/*", SCHEMA, f"{tmp_path}/out", f"{tmp_path}/ck", kind).awaitTermination()
    got = {r["id"]: r["b"] for r in spark.read.parquet(f"{tmp_path}/out/data").collect()}
    assert got == {1: 49, 2: 0}
