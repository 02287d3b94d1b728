"""Hard-negative mining: for each anchor its best rows of the same label, and for each of these the best rows of other labels in a window of scores.

Candidates are ordered along a Hilbert curve through the leading principal axes of a bounded sample, cut into blocks, and written as Parquet, a
row for each block with a zone map: the smallest and the largest value of every dimension, and of the label. Anchors are ordered and cut alike.
Interval arithmetic on a zone map bounds the scores that an anchor can have in a block from both sides, so an anchor's windows read only
the blocks whose interval meets them.

There are four searches of the same form: the block that suits each anchor best gives a floor for its positives; positives at or
above the floor are searched in all blocks that can hold one; they make the windows, and the block that suits each window best gives it
a floor; then all blocks that can hold a negative are searched. In each, zone maps (some hundredths of the data) meet the anchors' blocks in pages,
and blocks that have to be read meet the blocks of anchors that need them by equi-joins on block numbers. A task holds a few blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm import frames
from tidepanel.llm.topk_search import matrix

#: Bytes of a block's vectors, and rows at most; zone maps in a page; anchors' blocks that share a copy of a page.
BLOCK_BYTES = 512 << 10
BLOCK_ROWS = 1024
ANCHOR_ROWS = 256
PAGE_ZONES = 512
SLOT_BLOCKS = 4
#: Rows, by hash of their id, that the axes of the curve are fitted on; axes and bits of each.
SAMPLE_ROWS = 4096
AXES = 8
BITS = 7
#: Beyond any score.
ANY = 1 << 62

ZONE = "lo array<long>, hi array<long>, label_lo long, label_hi long"
BLOCK = f"block long, ids array<long>, labels array<long>, vecs array<long>, {ZONE}"
WANTS = "array<struct<row:int, window:int, low:long, high:long>>"


def hilbert_keys(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of integer coordinates, of so many bits, along the Hilbert curve: J. Skilling's transform, on whole columns."""
    x = [c.astype(np.int64) for c in coordinates.T]
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(up, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> level) & 1)
    return key


class Curve:
    """Principal axes of a sample and their quantiles; the sample decides how well blocks are cut, never what is found."""

    def __init__(self, sample: np.ndarray, width: int):
        self.width = width
        own = sample.astype(np.float64) if len(sample) else np.zeros((1, width))
        self.mean = own.mean(axis=0)
        _, turned = np.linalg.eigh(np.atleast_2d(np.cov(own - self.mean, rowvar=False, bias=True)))
        self.axes = turned[:, ::-1][:, :AXES]
        at = np.linspace(0, 1, (1 << BITS) + 1)[1:-1]
        self.edges = np.quantile((own - self.mean) @ self.axes, at, axis=0)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        along = (rows - self.mean) @ self.axes
        return hilbert_keys(np.stack([np.searchsorted(e, a) for e, a in zip(self.edges.T, along.T, strict=True)], axis=1), BITS)


def _fitted(rows: DataFrame, width: int) -> Curve:
    sample = rows.select("vec", F.xxhash64("id").alias("hash"), "id").orderBy("hash", "id").limit(SAMPLE_ROWS).select("vec").toArrow()
    vectors = sample.column("vec").combine_chunks()
    return Curve(matrix(vectors, width) if len(vectors) else np.zeros((0, width)), width)


def _blocks(rows: DataFrame, curve: Curve, most_rows: int, parts: int) -> DataFrame:
    """``rows`` as blocks of up to ``most_rows`` neighbours along the curve, with zone maps."""
    width = curve.width

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = curve.keys(matrix(b.column("vec"), width)) if b.num_rows else np.zeros(0, dtype=np.int64)
            yield frames.replaced(b, {"place": pa.array(keys, pa.int64())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, most_rows - n))
                b, n = b.slice(held[-1].num_rows), n + held[-1].num_rows
                if n == most_rows:
                    yield packed(number, held)
                    number, held, n = number + 1, [], 0
        if held:
            yield packed(number, held)

    def packed(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        vectors, labels = matrix(own.column("vec"), width), np.asarray(own.column("label"))
        by_id = np.argsort(np.asarray(own.column("id")), kind="stable")  # the first of equal scores is the one with the smallest id
        columns = [[number], [np.asarray(own.column("id"))[by_id]], [labels[by_id]], [vectors[by_id].ravel()], [vectors.min(axis=0)], [vectors.max(axis=0)], [labels.min()], [labels.max()]]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.int64(), pa.int64()]
        names = ["block", "ids", "labels", "vecs", "lo", "hi", "label_lo", "label_hi"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    placed = frames.bounded_batches(rows.select("id", "label", "vec")).mapInArrow(keyed, "id long, label long, vec array<long>, place long")
    spread = placed.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, "place", "id", "tie").sortWithinPartitions("place", "id", "tie")
    return spread.select("id", "label", "vec").mapInArrow(cut, BLOCK)


class Anchors:
    """A block of anchors as it comes to a task, with what they want: pairs of row and window, each with the lowest and the highest score."""

    def __init__(self, labels: pa.Scalar, vecs: pa.Scalar, wants: pa.Scalar, exact: bool):
        self.labels = np.asarray(labels.values)
        self.vecs = _square(vecs, len(self.labels), exact)
        own = wants.values
        self.row, self.window, self.low, self.high = (np.asarray(own.field(f)).astype(np.int64) for f in ("row", "window", "low", "high"))

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each anchor (row) can have in each block (column): sums of intervals."""
        up, down = np.maximum(self.vecs, 0), np.minimum(self.vecs, 0)
        return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T

    def meets(self, zones: pa.StructArray, same: bool, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each want (row) and block (column): whether the block can hold a score in the window at a fitting label, and how far the interval's middle is from the window's top."""
        first, last = np.asarray(zones.field("label_lo")), np.asarray(zones.field("label_hi"))
        own = self.labels[self.row][:, None]
        fits = (first <= own) & (own <= last) if same else ~((first == own) & (last == own))
        if not exact or not len(self.row):
            return fits, np.zeros(fits.shape)
        least, most = self.bounds(*(_square(zones.field(f), len(zones), True) for f in ("lo", "hi")))
        least, most = least[self.row], most[self.row]
        low, high = self.low[:, None].astype(np.float64), self.high[:, None].astype(np.float64)
        return fits & (most >= low) & (least <= high) & (low <= high), np.abs((least + most) / 2 - np.minimum(high, ANY))


def _square(values, rows: int, exact: bool) -> np.ndarray:
    flat = np.asarray(values.values if isinstance(values, pa.Scalar) else values.flatten())
    return flat.reshape(rows, -1).astype(np.float64 if exact else np.int64)


class Search:
    """What the four searches share: the blocks, the anchors' blocks, and pages of zone maps."""

    def __init__(self, blocks: DataFrame, anchors: DataFrame, exact: bool, seen: tuple[Accumulator, Accumulator] | None):
        self.blocks, self.anchors, self.exact, self.seen = blocks, anchors, exact, seen
        self.n_blocks, self.n_anchors = blocks.count(), anchors.count()
        self.parts = max(anchors.sparkSession.sparkContext.defaultParallelism, self.n_blocks // 16)

    def _pairs(self, wanted: DataFrame, same: bool, best_only: bool) -> DataFrame:
        """anchors, block: the blocks that each block of anchors has to read; with ``best_only`` those that suit one of its wants best."""
        pages, slots = -(-self.n_blocks // PAGE_ZONES), -(-self.n_anchors // SLOT_BLOCKS)
        page, slot = F.pmod(F.xxhash64("block"), F.lit(pages)), F.pmod(F.xxhash64("anchors"), F.lit(slots))
        zones = self.blocks.select(page.alias("page"), F.struct("block", "lo", "hi", "label_lo", "label_hi").alias("zone")).groupBy("page").agg(F.collect_list("zone").alias("zones"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
        asked = wanted.select("anchors", "labels", "vecs", "wants", slot.alias("slot"), every(pages).alias("page"))
        met = asked.join(zones.select("page", "zones", every(slots).alias("slot")).repartition(max(self.parts, slots), "page", "slot"), ["page", "slot"]).select("anchors", "labels", "vecs", "wants", "zones")
        exact = self.exact

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    own, zones = Anchors(b["labels"][i], b["vecs"][i], b["wants"][i], exact), b["zones"][i].values
                    meets, gap = own.meets(zones, same, exact)
                    numbers = np.asarray(zones.field("block"))
                    if best_only:
                        some = np.flatnonzero(meets.any(axis=1))
                        at = np.where(meets, gap, np.inf)[some].argmin(axis=1) if len(some) else some
                        columns = [own.row[some], own.window[some], numbers[at], gap[some, at]]
                    else:
                        at = np.flatnonzero(meets.any(axis=0))
                        columns = [np.zeros(len(at)), np.zeros(len(at)), numbers[at], np.zeros(len(at))]
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64()]
                    arrays = [pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["anchors"][i].as_py(), len(arrays[0])), pa.int64()), *arrays], ["anchors", "row", "window", "block", "gap"])

        out = frames.bounded_batches(met).mapInArrow(routed, "anchors long, row int, window int, block long, gap double")
        if best_only:
            out = out.groupBy("anchors", "row", "window").agg(F.min_by("block", F.struct("gap", "block")).alias("block"))
        return out.select("anchors", "block").distinct()

    def best(self, wants: DataFrame, same: bool, k: int, best_only: bool = False) -> DataFrame:
        """anchors, row, window, anchor_id, place (from 1), id, score: the ``k`` best rows of each want, of the anchor's label if ``same``, else of others.

        ``wants``: anchors, row, window, low, high. The anchor's own id is left out; ties go to the smaller id.
        """
        listed = wants.groupBy("anchors").agg(F.collect_list(F.struct(F.col("row").cast("int").alias("row"), F.col("window").cast("int").alias("window"), "low", "high")).alias("wants"))
        wanted = self.anchors.join(listed, "anchors")
        pairs = self._pairs(wanted, same, best_only)
        own = wanted.select("anchors", F.col("ids").alias("own_ids"), F.col("labels").alias("own_labels"), F.col("vecs").alias("own_vecs"), "wants")
        read = pairs.join(own, "anchors").repartition(self.parts, "block").join(self.blocks, "block")
        exact, seen = self.exact, None if best_only else self.seen

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                zones = pa.StructArray.from_arrays([b[c] for c in ("lo", "hi", "label_lo", "label_hi")], ["lo", "hi", "label_lo", "label_hi"])
                for i in range(b.num_rows):
                    own = Anchors(b["own_labels"][i], b["own_vecs"][i], b["wants"][i], exact)
                    use = np.flatnonzero(own.meets(zones.slice(i, 1), same, exact)[0][:, 0])
                    if seen:
                        seen[0].add(len(use))
                    yield scored(b, i, own, use)

        def scored(b: pa.RecordBatch, i: int, own: Anchors, use: np.ndarray) -> pa.RecordBatch:
            ids, labels = np.asarray(b["ids"][i].values), np.asarray(b["labels"][i].values)
            rows, at = np.unique(own.row[use], return_inverse=True)
            score = own.vecs[rows] @ _square(b["vecs"][i], len(ids), exact).T
            own_ids = np.asarray(b["own_ids"][i].values)[rows]
            fits = ((labels == own.labels[rows][:, None]) if same else (labels != own.labels[rows][:, None])) & (ids != own_ids[:, None])
            none, out = (-np.inf if exact else np.iinfo(np.int64).min), []
            low, high = own.low[use][:, None], own.high[use][:, None]
            for part in range(0, len(use), 256):
                some = np.arange(part, min(part + 256, len(use)))
                near = score[at[some]]
                ok = fits[at[some]] & (near >= low[some]) & (near <= high[some])
                near = np.where(ok, near, none)
                for _ in range(min(k, len(ids))):
                    top = near.argmax(axis=1)
                    hit = ok[np.arange(len(some)), top]
                    got = some[hit]
                    out.append((own.row[use[got]], own.window[use[got]], own_ids[at[got]], ids[top[hit]], near[hit, top[hit]]))
                    near[np.arange(len(some)), top] = none
                    ok[np.arange(len(some)), top] = False
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c.astype(kind.to_pandas_dtype()), kind) for c, kind in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(b["anchors"][i].as_py(), len(arrays[0])), pa.int64()), *arrays], ["anchors", "row", "window", "anchor_id", "id", "score"])

        hits = frames.bounded_batches(read).mapInArrow(found, "anchors long, row int, window int, anchor_id long, id long, score long")
        place = F.row_number().over(Window.partitionBy("anchors", "row", "window").orderBy(F.desc("score"), "id"))
        return hits.withColumn("place", place).filter(F.col("place") <= k)

    def above_floor(self, wants: DataFrame, same: bool, k: int) -> DataFrame:
        """``wants``, each with its low raised to the k-th best score in the blocks that suit best, where these hold as many."""
        floors = self.best(wants, same, k, best_only=True).filter(F.col("place") == k).select("anchors", "row", "window", F.col("score").alias("floor"))
        raised = wants.join(floors, ["anchors", "row", "window"], "left")
        return raised.withColumn("low", F.greatest("low", "floor")).drop("floor")


def _share(score: Column, percent: int) -> Column:
    """percent * score / 100, exact beyond 64 bits."""
    return score.cast("decimal(20,0)") * F.lit(percent).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, seen: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score, positive_rank (int): hard negatives of each anchor.

    Both tables hold id, label (long) and vec (array<long>); scores are integer inner products, components that the other vector lacks count
    as 0. Higher scores come first, ties by smaller id. An anchor's positives are its best ``positives`` rows of the same label, without
    rows of its own id; for each, the best ``negatives`` rows of another label whose score is from ``low`` to ``high`` percent of the
    positive's are returned, all if fewer. So a positive with a negative score has none, and one with score 0 those with score 0. A repeated
    row counts each time it is there, as a candidate, a positive or an anchor. Rows with a null in any of the three columns take no part; no
    anchors or no rows give no rows. Scores beyond 64 bits wrap around; where scores could pass 2**53 every block is read.

    ``seen``: two accumulators that get the pairs of want and block that were read in the two full searches, and all such pairs.
    """
    rows, anchors = (t.select("id", F.col("label").cast("long").alias("label"), "vec").dropna() for t in (rows, anchors))
    largest = F.max(F.greatest(*[F.abs(x("vec").cast("double")) for x in (F.array_max, F.array_min)]))
    n, width, most = rows.agg(F.count("*"), F.max(F.size("vec")), largest).first()
    asked, asked_width, asked_most = anchors.agg(F.count("*"), F.max(F.size("vec")), largest).first()
    spark = rows.sparkSession
    if not n or not asked:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")
    width = max(1, width or 0, asked_width or 0)
    exact = width * (most or 0) * (asked_most or 0) < 2**53
    curve = _fitted(rows, width)
    block_rows = max(16, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    parts = lambda n: max(1, -(-n * width * 8 // (32 << 20)), min(spark.sparkContext.defaultParallelism, n // 1024))
    blocks = frames.staged(_blocks(rows, curve, block_rows, parts(n)), "mining-blocks")
    own = frames.staged(_blocks(anchors, curve, min(ANCHOR_ROWS, block_rows), parts(asked)).select(F.col("block").alias("anchors"), "ids", "labels", "vecs"), "mining-anchors")
    search = Search(blocks, own, exact, seen)

    any_score = own.select("anchors", F.posexplode("ids").alias("row", "id")).select("anchors", "row", F.lit(0).alias("window"), F.lit(-ANY).alias("low"), F.lit(ANY).alias("high"))
    if exact:
        any_score = frames.staged(search.above_floor(any_score, True, positives), "mining-floors")
    found = frames.staged(search.best(any_score, True, positives), "mining-positives")
    if seen:
        seen[1].add(search.n_blocks * asked)
    windows = found.select("anchors", "row", F.col("place").alias("window"), F.ceil(_share(F.col("score"), low)).cast("long").alias("low"), F.floor(_share(F.col("score"), high)).cast("long").alias("high"))
    windows = windows.filter("low <= high")
    if seen:
        seen[1].add(search.n_blocks * windows.count())
    if exact:
        windows = frames.staged(search.above_floor(windows, False, negatives), "mining-windows")
    mined = search.best(windows, False, negatives).select("anchors", "row", "window", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = mined.join(found.select("anchors", "row", F.col("place").alias("window"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchors", "row", "window"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("window").alias("positive_rank"))
