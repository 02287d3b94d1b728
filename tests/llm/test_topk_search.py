import random

import numpy as np
import pytest

from tidepanel.llm import topk_search as ts


def brute(queries, rows, k):
    out = []
    for q, v in queries:
        own = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q), key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(own)]
    return sorted(out)


def run(spark, queries, rows, k=10):
    make = lambda x: spark.createDataFrame(x, "id long, vec array<long>")
    return sorted(tuple(r) for r in ts.top_k(make(queries), make(rows).repartition(3), k).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ts, "SHARD_BYTES", 8 * 8 * 200)  # several shards, several blocks each
    random.seed(2)
    rows = [(i, [random.randint(-900, 900) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties
    queries = rows[::50]
    assert run(spark, queries, rows) == brute(queries, rows, 10)


def test_short_empty_and_huge_vectors(spark):
    rows = [(1, [1, 2, 3]), (2, [4]), (3, []), (4, [0, 0, 0, 9]), (5, [2**40, 1, 1]), (5, [2**40, 1, 1])]
    assert run(spark, rows[:5], rows, 3) == brute(rows[:5], rows, 3)
    assert run(spark, rows, [], 3) == [] and run(spark, [], rows, 3) == []
    assert len(run(spark, [(9, [1])], rows[:2], 10)) == 2


def test_quantised_leaves_out_what_has_no_number(spark):
    nan, inf = float("nan"), float("inf")
    own = spark.createDataFrame([(1, [0.5, -0.0001], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [nan], 1), (5, [-inf], 1), (None, [1.0], 1), (6, [], None)], "vec_id long, embedding array<float>, id int")
    assert sorted((r["id"], r["vec"]) for r in ts.quantised(own).collect()) == [(1, [512, -1]), (6, [])]


def clustered(n, width=16, clusters=8):
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (clusters, width))
    return centres[rng.integers(0, clusters, n)] + rng.integers(-20, 20, (n, width))


@pytest.mark.parametrize("shard_rows", [100_000, 500])
def test_top_k_prunes_clustered_vectors(spark, monkeypatch, shard_rows):
    """Through the whole operator, with one shard and with several: most blocks are never scored, and the result is that of brute force."""
    monkeypatch.setattr(ts, "SHARD_BYTES", 8 * 16 * shard_rows)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(4000))]
    queries = rows[::200]
    make = lambda x: spark.createDataFrame(x, "id long, vec array<long>")
    seen = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
    got = sorted(tuple(r) for r in ts.top_k(make(queries), make(rows).repartition(3), 10, seen).collect())
    assert got == brute(queries, rows, 10)
    assert seen[1].value >= len(queries) * 4000 // ts.BLOCK_ROWS
    assert seen[0].value < 0.35 * seen[1].value


def test_a_floor_spares_shards_without_good_blocks(spark, monkeypatch):
    """Blocks scored in the second pass, with floors from the first and without them."""
    monkeypatch.setattr(ts, "SHARD_BYTES", 8 * 16 * 250)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(4000))]
    make = lambda x: spark.createDataFrame(x, "id long, vec array<long>")

    def scored():
        seen = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
        ts.top_k(make(rows[::200]), make(rows).repartition(3), 10, seen).collect()
        return seen[0].value

    with_floor = scored()
    monkeypatch.setattr(ts, "_floors", lambda c, asked, shards, k: asked.select("id", "floor").filter("false"))
    assert with_floor < 0.9 * scored()


def test_bounds_hold():
    rows = clustered(4000).astype(np.int64)
    blocks = ts.Blocks(np.arange(4000), rows)
    query = rows[7].astype(float)
    assert (blocks.bounds(query[None])[0] >= np.maximum.reduceat(blocks.rows @ query, blocks.starts)).all()
    assert blocks.sizes.max() <= ts.BLOCK_ROWS and blocks.sizes.sum() == 4000


def test_shards_are_bounded_by_bytes(spark, monkeypatch):
    """Wide vectors get more shards; equal vectors, a third of all, are no hot key."""
    monkeypatch.setattr(ts, "SHARD_BYTES", 1 << 16)
    rows = [(i, [i % 7] * 300 if i % 3 else [5] * 300) for i in range(300)]
    assert run(spark, rows[::60], rows, 4) == brute(rows[::60], rows, 4)
