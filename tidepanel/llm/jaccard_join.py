"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

Documents with the same set of n-grams form a class; only classes are compared, so exact copies cost one row each. The numbers of bands
and rows follow from the target recall at the threshold. Classes are shuffled on band hashes; buckets with the same members as a bucket
of an earlier band are dropped, and the n-gram sets (made anew from the texts of the classes that still share a bucket) are sent to
the buckets that are left. A pair counts in the first band that it shares, so it is verified once, and pairs are counted where they
are verified, never emitted: a bucket gives each of its classes a number of links and one edge to a root. Large buckets are cut into
blocks, one task for each pair of blocks, so a group of near copies may be of any size. Groups are the connected components of the edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 64
#: Classes, and n-grams, in a block of a bucket, about.
BLOCK_CLASSES = 512
BLOCK_GRAMS = 1 << 21
SEED = 20_240_607


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which pairs at the threshold share a band with chance ``recall`` within the hashes given."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_sets(texts: list[bytes], n: int = NGRAM) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-grams of words (runs outside ``[\\x20\\x09-\\x0D]``).

    A text of fewer than ``n`` words has one n-gram, of all its words; one without words has none.
    """
    split = [t.split() for t in texts]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for own in split for w in own), dtype=np.uint64)
    out, at = [], 0
    for own in split:
        words = hashes[at : at + len(own)]
        at += len(own)
        width = max(1, len(words) - n + 1) if len(words) else 0
        grams = np.full(width, min(n, len(words)), dtype=np.uint64)
        for k in range(min(n, len(words))):
            grams = _mix(grams + words[k : k + width])
        out.append(np.unique(grams))
    return out


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """Two signed 64-bit halves of a hash of each set."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """The band hashes (columns) of sets (rows), none of them empty."""
    rng = np.random.default_rng(SEED)
    turns = rng.integers(0, 2**63, size=(bands * rows, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    grams, out = np.concatenate(sets), np.zeros((len(sets), bands), dtype=np.uint64)
    for i, (turn, times) in enumerate(turns):
        least = np.minimum.reduceat((grams ^ turn) * times, starts)
        out[:, i // rows] = _mix(out[:, i // rows] + least)
    return out.view(np.int64)


def _list_array(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))


def text_code(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def signatures(docs: DataFrame, bands: int, rows: int, key: str = "doc_id", text: str = "text", n: int = NGRAM) -> DataFrame:
    """id, code (a hash of the text), h1, h2 (of the n-gram set), size, bands (array<long>; zeros for a text without words)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in frames.pieces(whole, "text", 2 << 20):
                sets = gram_sets(frames.utf8(batch, "text"), n)
                halves, sizes = set_hashes(sets), np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                own = np.zeros((len(sets), bands), dtype=np.int64)
                if len(full):
                    own[full] = band_hashes([sets[i] for i in full], bands, rows)
                lists = _list_array(own)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("code"), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes), lists], ["id", "code", "h1", "h2", "size", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("id"), text_code(text).alias("code"), F.col(text).alias("text"))
    return frames.bounded_batches(own).mapInArrow(signed, f"id {kind}, code long, h1 long, h2 long, size long, bands array<long>")


def gram_table(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = NGRAM) -> DataFrame:
    """h1, h2, grams (binary): the n-gram sets of ``docs``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in frames.pieces(whole, text, 2 << 20):
                sets = gram_sets(frames.utf8(batch, text), n)
                halves = set_hashes(sets)
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], ["h1", "h2", "grams"])

    return frames.bounded_batches(docs).select(text).mapInArrow(made, "h1 long, h2 long, grams binary")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of a partition that is sorted by ``keys``, one batch each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([np.asarray(batch.column(k)) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1).tolist(), len(own)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if held and tuple(own[start]) != last:
                yield pa.concat_batches(held)
                held = []
            last = tuple(own[start])
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.concat_batches(held)


def verify(grams: list[np.ndarray], bands: np.ndarray, band: int, block: np.ndarray, crossed: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one group: each class's number of new links, and the root (the least place) of its component among them.

    A pair is new if it shares no band before ``band``; if the group is ``crossed``, that is of two blocks, only pairs across them count.
    """
    m = len(grams)
    links, root = np.zeros(m, dtype=np.int64), np.arange(m)
    sizes = np.array([len(g) for g in grams])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, codes = np.unique(np.concatenate(grams), return_inverse=True)
    mark = np.zeros(int(codes.max(initial=-1)) + 1, dtype=np.uint8)
    for i in range(m - 1):
        rest = np.arange(i + 1, m)
        fit = np.minimum(sizes[rest], sizes[i]) >= threshold * np.maximum(sizes[rest], sizes[i]) - 1e-9
        if crossed:
            fit &= block[rest] != block[i]
        if band:
            fit &= ~(bands[rest, :band] == bands[i, :band]).any(axis=1)
        rest = rest[fit]
        if not len(rest):
            continue
        mine = codes[starts[i] : starts[i + 1]]
        mark[mine] = 1
        n = sizes[rest]
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(first[-1]) + np.repeat(starts[rest] - first[:-1], n)
        shared = np.add.reduceat(mark[codes[at]], first[:-1], dtype=np.int64)
        mark[mine] = 0
        # counts are whole numbers: the small slack only undoes the rounding of the product
        found = rest[shared >= threshold * (n + sizes[i] - shared) - 1e-9]
        if len(found):
            links[found] += 1
            links[i] += len(found)
            joined = np.append(root[found], root[i])
            root[np.isin(root, joined)] = joined.min()
    return links, root


def _linked(members: DataFrame, threshold: float) -> DataFrame:
    """h1, h2, links, r1, r2: for each class of each group that has new links there."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ["band", "bucket", "low", "high"]):
            block = np.asarray(group.column("block"))
            crossed = group.column("low")[0] != group.column("high")[0]
            # of two blocks one may be empty: the pairs within the other are counted in its own group
            if group.num_rows < 2 or crossed and (block == block[0]).all():
                continue
            grams = [np.frombuffer(x, dtype=np.uint64) for x in group.column("grams").to_pylist()]
            width = len(group.column("bands")[0])
            bands = np.asarray(group.column("bands").flatten()).reshape(-1, width)
            links, root = verify(grams, bands, group.column("band")[0].as_py(), block, crossed, threshold)
            own = np.flatnonzero(links)
            h1, h2 = np.asarray(group.column("h1")), np.asarray(group.column("h2"))
            if len(own):
                columns = [h1[own], h2[own], links[own], h1[root[own]], h2[root[own]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "links", "r1", "r2"])

    return frames.bounded_batches(members).mapInArrow(checked, "h1 long, h2 long, links long, r1 long, r2 long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (staged) from edges of node and other (any comparable type): the least node of each connected component.

    Labels fall to the least among neighbours and then to the label of the label, until nothing changes; every round is staged.
    """
    both = frames.staged(edges.select("node", "other").union(edges.select("other", "node")).distinct(), "edges")
    held = labels = frames.staged(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("_near")), "other").groupBy("node").agg(F.min("_near").alias("_near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("_before"), F.least("root", "_near").alias("_at"))
        jump = labels.select(F.col("node").alias("_at"), F.col("root").alias("_jump"))
        after = step.join(jump, "_at").select("node", F.least("_at", "_jump").alias("root"), (F.least("_at", "_jump") != F.col("_before")).alias("moved"))
        after = frames.staged(after, "labels")
        frames.discard(held)
        held, labels = after, after.select("node", "root")
        if not after.filter("moved").limit(1).count():
            frames.discard(both)
            return after


def placed(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = NGRAM, key: str = "doc_id", text: str = "text", block_classes: int = BLOCK_CLASSES) -> tuple[DataFrame, list[DataFrame]]:
    """One row a document: id, code, size, class_id, set_id, n_copies, n_links, first (whether it leads its group); see ``join``. And the staged tables that it reads."""
    bands, rows = choose_bands(threshold, recall)
    signed = frames.staged(signatures(docs, bands, rows, key, text, n), "signatures")
    lead = F.struct(F.col("id").isNull().alias("last"), "id", "code")
    classes = signed.filter("size > 0").groupBy("h1", "h2").agg(F.min(lead).alias("lead"), F.count("*").alias("n_copies"), F.min(F.struct("size", "bands")).alias("_own"))
    classes = frames.staged(classes.select("h1", "h2", "lead", "n_copies", "_own.size", "_own.bands"), "classes")
    spread = classes.select("h1", "h2", "size", F.posexplode("bands").alias("band", "bucket"))
    buckets = spread.groupBy("band", "bucket").agg(F.count("*").alias("m"), F.sum("size").alias("grams"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")).filter("m > 1")
    kept = buckets.groupBy("m", "x1", "x2").agg(F.min(F.struct("band", "bucket", "grams")).alias("_b")).select("m", "_b.*")
    blocks = F.greatest(F.ceil(F.col("m") / block_classes), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    kept = frames.staged(kept.select("band", "bucket", blocks.alias("blocks")), "buckets")
    members = frames.staged(spread.drop("size").join(kept, ["band", "bucket"]), "members")
    needed = members.select("h1", "h2").distinct().join(classes.select("h1", "h2", "lead", "bands"), ["h1", "h2"])
    needed = frames.staged(needed.select("h1", "h2", F.col("lead.id").alias("_id"), "bands"), "needed")
    texts = docs.select(key, text).join(needed.select("_id").distinct(), F.col(key).eqNullSafe(F.col("_id")), "left_semi")
    grams = gram_table(texts, key, text, n).join(needed.drop("_id"), ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    block = F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int")
    paired = members.withColumn("block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("h1", "h2", "band", "bucket", "block", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"))
    group = ["band", "bucket", "low", "high"]
    found = frames.staged(_linked(paired.join(grams, ["h1", "h2"]).repartition(*group).sortWithinPartitions(*group), threshold), "links")
    counts = found.groupBy("h1", "h2").agg(F.sum("links").alias("n_links"))
    edges = found.filter("h1 <> r1 OR h2 <> r2").select(F.struct("h1", "h2").alias("node"), F.struct(F.col("r1").alias("h1"), F.col("r2").alias("h2")).alias("other"))
    labels = components(edges)
    own = labels.select("node.h1", "node.h2", "root").join(classes.select("h1", "h2", "lead"), ["h1", "h2"])
    group_lead = own.join(own.groupBy("root").agg(F.min("lead").alias("group_lead")), "root").select("h1", "h2", "group_lead")
    told = classes.drop("size", "bands").join(counts, ["h1", "h2"], "left").join(group_lead, ["h1", "h2"], "left").filter("n_copies > 1 OR n_links > 0")
    told = frames.staged(told.withColumn("group_lead", F.coalesce("group_lead", "lead")), "told")
    frames.discard(classes, kept, members, needed, found, labels)
    out = signed.select("id", "code", "h1", "h2", "size").join(told, ["h1", "h2"], "left")
    leads = F.col("group_lead").isNull() | (F.col("id").eqNullSafe(F.col("group_lead.id")) & (F.col("code") == F.col("group_lead.code")))
    out = out.select(
        "id",
        "code",
        "size",
        F.coalesce("group_lead.id", "id").alias("class_id"),
        F.coalesce("lead.id", "id").alias("set_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        leads.alias("first"),
    )
    return out, [signed, told]


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = NGRAM, key: str = "doc_id", text: str = "text", block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """One row a document: ``key``, class_id, set_id, n_copies, n_links.

    ``set_id``: the least id among documents with the same set of word n-grams, ``n_copies`` their number. ``n_links``: other n-gram sets
    whose Jaccard similarity with this one is ``threshold`` or more. ``class_id``: the least id in the document's group, the
    connected component of links; a document without links has its set_id. Words are runs outside ``[\\x20\\x09-\\x0D]``, case kept; a
    text of fewer than ``n`` words has one n-gram of all of them. A null text, or one without words, is alone: its own id, one copy,
    no links. Repeated rows count as copies. Null ids take part; they never are the least unless a group has no other. An empty table
    gives an empty table. Each pair at the threshold is found with chance ``recall`` at least, more similar ones with more. Columns of
    ``docs`` but the two named are not looked at.
    """
    return placed(docs, threshold, recall, n, key, text, block_classes)[0].select(F.col("id").alias(key), "class_id", "set_id", "n_copies", "n_links")


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = NGRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that lead their groups (see ``join``): of least id, then text. Of rows with the same id and text one stays; texts without words all stay."""
    rows, read = placed(docs, threshold, recall, n, key, text)
    keys = rows.filter("NOT first OR size > 0").groupBy("id", "code").agg(F.bool_and("first").alias("leads"), F.count("*").alias("rows"))
    keys = frames.staged(keys.filter("NOT leads OR rows > 1"), "group-keys")
    frames.discard(*read)

    def of(which: DataFrame, how: str) -> DataFrame:
        own = which.select(F.col("id").alias("_id"), F.col("code").alias("_code"))
        return docs.join(own, docs[key].eqNullSafe(own["_id"]) & (text_code(text) == own["_code"]), how)

    alone = of(keys, "left_anti")
    repeated = keys.filter("leads")
    return alone if repeated.isEmpty() else alone.unionByName(of(repeated, "left_semi").dropDuplicates([key, text]))
