import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import hard_negatives as hn
from tidepanel.llm import topk_search


def score(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute(anchors, rows, positives=5, negatives=3):
    out = []
    for a, label, v in anchors:
        near = sorted(((score(v, w), i, k) for i, k, w in rows if i != a), key=lambda x: (-x[0], x[1]))
        for rank, (p, i, _) in enumerate([x for x in near if x[2] == label][:positives]):
            fit = [x for x in near if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p][:negatives]
            out += [(a, i, n + 1, j, p, s, rank + 1) for n, (s, j, _) in enumerate(fit)]
    return sorted(out)


def run(spark, anchors, rows, seen=None):
    make = lambda x: spark.createDataFrame(x, "id long, label int, vec array<long>")
    return sorted(tuple(r) for r in hn.mine(make(rows).repartition(3), make(anchors), seen=seen).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 32)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 8)
    monkeypatch.setattr(hn, "PAGE_ZONES", 7)
    monkeypatch.setattr(hn, "SLOT_BLOCKS", 1)


@pytest.mark.parametrize("axes", [1, 2, 3])
def test_hilbert_steps_are_of_length_one(axes):
    bits = 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    keys = hn.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_against_brute_force(spark, small_blocks):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 4)), rng.integers(-40, 90, 6).tolist()) for i in range(600)]
    rows += [(1000 + i, i % 2, rows[9][2]) for i in range(80)]  # ties across labels
    rows += rows[:20]  # repeated rows
    rows += [(2000 + i, 7, [0] * 6) for i in range(3)] + [(2100, 8, [-5] * 6)]  # scores of 0, below 0, and a label of one row
    anchors = rows[::25] + rows[-4:] + rows[:1]
    assert run(spark, anchors, rows) == brute(anchors, rows)


def test_short_empty_and_huge_vectors(spark):
    rows = [(1, 0, [3, 2, 1]), (2, 0, [4]), (3, 1, []), (4, 1, [1, 0, 0, 9]), (5, 1, [2, 1]), (6, 2, [2**40, 1]), (7, 2, [2**20, 2**20])]
    assert run(spark, rows[:5], rows[:5]) == brute(rows[:5], rows[:5])
    assert run(spark, rows, rows) == brute(rows, rows)
    assert run(spark, rows, []) == run(spark, [], rows) == []


def test_nulls_take_no_part(spark):
    rows = [(1, 0, [9]), (2, 0, [9]), (3, 1, [6]), (4, None, [6]), (None, 1, [6]), (5, 1, None)]
    assert run(spark, rows, rows) == [(1, 2, 1, 3, 81, 54, 1), (2, 1, 1, 3, 81, 54, 1)]
    nan = float("nan")
    own = spark.createDataFrame([(1, [0.5], 3, 1), (2, [nan], 3, 1), (3, [0.25], None, 1)], "vec_id long, embedding array<float>, label int, id int")
    kept = topk_search.quantised(own, 256, more={"label": F.col("label")}).collect()
    assert [tuple(r) for r in kept] == [(1, [128], 3), (3, [64], None)]


def test_clustered_vectors_are_mostly_not_read(spark, small_blocks):
    """Most pairs of want and block are skipped by zone maps, and the result is that of brute force."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (12, 16))
    own = rng.integers(0, 12, 3000)
    rows = [(i, int(own[i] + (i % 5 == 0)), (centres[own[i]] * (1 - (i % 3) / 6) + rng.integers(-20, 20, 16)).astype(int).tolist()) for i in range(3000)]
    seen = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
    assert run(spark, rows[::100], rows, seen) == brute(rows[::100], rows)
    assert seen[0].value < 0.35 * seen[1].value


def test_one_label_and_copies(spark, small_blocks):
    """A third of all rows are one vector with one label; blocks cut through it."""
    rng = np.random.default_rng(6)
    rows = [(i, 1 if i % 3 == 0 else int(rng.integers(0, 5)), [5, 5, 5, 5] if i % 3 == 0 else rng.integers(-9, 20, 4).tolist()) for i in range(900)]
    assert run(spark, rows[::50], rows) == brute(rows[::50], rows)
