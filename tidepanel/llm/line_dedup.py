"""Line dedup: drop every line whose key stands in many documents.

A sharded minimal perfect hash indexes the distinct hashes of lines over compact arrays of fingerprints and of counts (documents that
hold the line); lines of one document alone have nothing to count and are left out, all others are indexed. Documents probe the arrays, and
the count found there decides; lines are never joined. A line that isn't in the index lands on some slot and is turned away by that
slot's 64-bit fingerprint (slot and fingerprint come from the two halves of a 128-bit hash, so both would have to agree by chance).

Plan: one pass hashes lines and counts documents by hash (pre-aggregated in each batch, then by Spark), the counts are staged and the
shards are built in parallel. An index of bounded size is broadcast, and documents probe it where they are. A larger one stays in its
shards: the hashes of lines (never lines or texts) go to the shards once, and what comes back are the places of dropped lines by text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames

SPACE_BYTES = frames.SPACE.encode()
#: Keys in a shard of the index, about.
SHARD_KEYS = 1 << 16
#: Bytes of the index for a key: fingerprint, count, and the bits of the levels with their ranks.
KEY_BYTES = 8 + 4 + 1
#: Bytes of index up to which it is broadcast.
BROADCAST_BYTES = 64 << 20
#: Tasks that share the probes of a shard where the probes go to the shards: a third of all documents may ask for one line.
SALTS = 16
LEVELS = 40


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(SPACE_BYTES).lower() for line in text.split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """Two unsigned 64-bit halves of each key's hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)


def _level_slots(halves: np.ndarray, level: int, size: int) -> np.ndarray:
    x = halves[:, 0] + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
    x ^= halves[:, 1] >> np.uint64(17)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return ((x * np.uint64(0x94D049BB133111EB)) >> np.uint64(20)) % np.uint64(size)


@dataclass
class Shard:
    """A minimal perfect hash in levels: a key belongs to the first level at whose slot it was alone; the rank of that bit is its index."""

    sizes: list[int]
    bits: np.ndarray
    ranks: np.ndarray
    prints: np.ndarray
    counts: np.ndarray

    @classmethod
    def load(cls, sizes: list[int], bits: bytes, prints: bytes, counts: bytes) -> Shard:
        own = np.frombuffer(bits, dtype=np.uint8)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(own), dtype=np.uint32)])
        return cls(list(sizes), own, ranks, np.frombuffer(prints, dtype="<u8"), np.frombuffer(counts, dtype="<u4"))

    def count(self, halves: np.ndarray) -> np.ndarray:
        """Documents of each key, 0 if it isn't indexed."""
        out, rest, base = np.zeros(len(halves), dtype=np.uint32), np.arange(len(halves)), 0
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = _level_slots(halves[rest], level, size) + np.uint64(base)
            byte, bit = (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)
            held = self.bits[byte]
            hit = (held >> bit) & 1 == 1
            slot = self.ranks[byte[hit]] + np.bitwise_count(held[hit] & ((np.uint8(1) << bit[hit]) - np.uint8(1)))
            own = rest[hit]
            same = self.prints[slot] == halves[own, 1]
            out[own[same]] = self.counts[slot[same]]
            rest, base = rest[~hit], base + size
        return out


def build_shard(halves: np.ndarray, counts: np.ndarray) -> tuple[list[int], bytes, bytes, bytes]:
    """Level sizes (multiples of 8), bits, fingerprints and counts, for distinct keys."""
    sizes, bits, owners, rest = [], [], [], np.arange(len(halves))
    while len(rest):
        if len(sizes) == LEVELS:
            raise ValueError("line hashes that no level tells apart")
        size = -(-2 * len(rest) // 8) * 8
        at = _level_slots(halves[rest], len(sizes), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        owner = np.full(size, -1)
        owner[at] = rest
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little"))
        owners.append(owner[alone])
        rest = rest[~alone[at]]
    order = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
    return sizes, b"".join(x.tobytes() for x in bits), halves[order, 1].astype("<u8").tobytes(), counts[order].astype("<u4").tobytes()


@dataclass(frozen=True)
class LineIndex:
    """``table``: one row a shard with the arrays of its minimal perfect hash (staged); ``keys``: how many are indexed; ``least``: of at least so many documents."""

    table: DataFrame
    shards: int
    keys: int
    least: int


def line_counts(docs: DataFrame, min_chars: int, text: str = "text") -> DataFrame:
    """h1, h2, n: the hashes of keys of at least ``min_chars`` code points, and the documents that hold them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for t in frames.utf8(batch, text) for k in set(line_keys(t)) if long_enough(k, min_chars)]
            if keys:
                own, n = np.unique(key_hashes(keys).view("<u8,<u8").ravel(), return_counts=True)
                halves = own.view("<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(n)], ["h1", "h2", "n"])

    found = frames.bounded_batches(docs).select(text).mapInArrow(counted, "h1 long, h2 long, n long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, min_chars: int = 1, text: str = "text", least: int = 2) -> LineIndex:
    """The index of all lines in ``least`` documents or more; any greater number can be asked of it. Shards are built side by side."""
    counts = frames.staged(line_counts(docs, min_chars, text).filter(F.col("n") >= least), "line-counts")
    keys = counts.count()
    shards = max(1, -(-keys // SHARD_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        halves = np.ascontiguousarray(pdf[["h1", "h2"]].to_numpy(dtype=np.int64)).view(np.uint64)
        own = np.minimum(pdf["n"].to_numpy(), 2**32 - 1)
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), *build_shard(halves, own))], columns=["shard", "sizes", "bits", "prints", "counts"])

    keyed = counts.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)))
    table = keyed.groupBy("shard").applyInPandas(build, "shard long, sizes array<long>, bits binary, prints binary, counts binary")
    out = LineIndex(frames.staged(table, "line-index"), shards, keys, least)
    frames.discard(counts)
    return out


def _cut(batch: pa.RecordBatch, places: dict[int, Iterable[int]]) -> pa.RecordBatch:
    """The batch with the lines at ``places`` of its rows gone from text, and n_dropped added."""
    text, dropped = batch.column("text"), np.zeros(batch.num_rows, dtype=np.int64)
    if places:
        texts = text.to_pylist()
        for i, own in places.items():
            gone = set(own)
            dropped[i] = len(gone)
            texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
        text = pa.array(texts, pa.string())
    return frames.replaced(batch, {"text": text, "n_dropped": pa.array(dropped)})


def _probed_here(rows: DataFrame, index: LineIndex, min_docs: int) -> DataFrame:
    """``rows`` with text cut and n_dropped added, by a broadcast index."""
    loaded = {r["shard"]: (r["sizes"], bytes(r["bits"]), bytes(r["prints"]), bytes(r["counts"])) for r in index.table.collect()}
    shared, shards = rows.sparkSession.sparkContext.broadcast(loaded), index.shards

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {k: Shard.load(*v) for k, v in shared.value.items()}
        for whole in batches:
            for batch in frames.pieces(whole, "text"):
                keys = [line_keys(t) for t in frames.utf8(batch, "text")]
                halves = key_hashes([k for own in keys for k in own])
                shard = halves[:, 0].astype(np.int64) % shards
                counts, order = np.zeros(len(halves), dtype=np.uint32), np.argsort(shard, kind="stable")
                ends = np.searchsorted(shard[order], np.arange(shards + 1))
                for k, own in arrays.items():
                    at = order[ends[k] : ends[k + 1]]
                    counts[at] = own.count(halves[at])
                starts = np.cumsum([0, *map(len, keys)])
                drop = counts >= min_docs
                places = {i: np.flatnonzero(drop[starts[i] : starts[i + 1]]) for i in np.unique(np.searchsorted(starts, np.flatnonzero(drop), side="right") - 1).tolist()}
                yield _cut(batch, places)

    return frames.bounded_batches(rows).mapInArrow(probed, frames.extended(rows, n_dropped="long"))


def _probed_there(rows: DataFrame, index: LineIndex, min_docs: int, min_chars: int) -> DataFrame:
    """The same for an index that stays in its shards. Texts are told by 128 bits of hash, so copies of a text share their places."""
    shards = index.shards
    code = [F.xxhash64(F.col("text")).alias("t1"), F.xxhash64(F.lit("second"), F.col("text")).alias("t2")]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in frames.pieces(whole, "text"):
                keys = [line_keys(t) for t in frames.utf8(batch, "text")]
                own = [(i, p, k) for i, lines in enumerate(keys) for p, k in enumerate(lines) if long_enough(k, min_chars)]
                if own:
                    at, halves = np.array([i for i, _, _ in own]), key_hashes([k for _, _, k in own]).view(np.int64)
                    t1, t2 = (np.asarray(batch.column(c))[at] for c in ("t1", "t2"))
                    columns = [t1, t2, np.array([p for _, p, _ in own], dtype=np.int32), halves[:, 0], halves[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t1", "t2", "place", "h1", "h2"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        for batch in batches:
            keys = np.asarray(batch.column("shard")) * SALTS + np.asarray(batch.column("salt"))
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                own = batch.slice(start, end - start)
                if own.num_rows and keys[start] != key:
                    # the arrays come first; a shard without keys has no row of them
                    key, first = keys[start], own.slice(0, 1).to_pylist()[0]
                    shard = Shard.load(first["sizes"], first["bits"], first["prints"], first["counts"]) if first["part"] == 0 else None
                    own = own.slice(1 if shard else 0)
                if shard and own.num_rows:
                    halves = np.stack([np.asarray(own.column(c)) for c in ("h1", "h2")], axis=1).view(np.uint64)
                    hit = pa.array(shard.count(halves) >= min_docs)
                    yield own.select(["t1", "t2", "place"]).filter(hit)

    lines = frames.bounded_batches(rows.select("text", *code)).mapInArrow(asked, "t1 long, t2 long, place int, h1 long, h2 long")
    lines = lines.withColumns({"shard": F.pmod(F.col("h1"), F.lit(shards)), "salt": F.pmod(F.col("t1"), F.lit(SALTS)), "part": F.lit(1)})
    salted = index.table.withColumns({"part": F.lit(0), "salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))})
    both = salted.unionByName(lines, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "part")
    hits = frames.bounded_batches(both).mapInArrow(answered, "t1 long, t2 long, place int")
    places = frames.staged(hits.groupBy("t1", "t2").agg(F.collect_set("place").alias("places")), "line-places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {i: p for i, p in enumerate(batch.column("places").to_pylist()) if p}
            yield _cut(batch.drop_columns(["places"]), own)

    joined = rows.select("*", *code).join(places, ["t1", "t2"], "left").select(*rows.columns, "places")
    return frames.bounded_batches(joined).mapInArrow(cut, frames.extended(rows, n_dropped="long"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, index: LineIndex | None = None) -> DataFrame:
    """``docs`` with the frequent lines of ``text`` gone, and n_lines (before) and n_dropped added.

    Lines split at \\n; a null or empty text is one empty line. A line's key is the line with white space stripped at both ends and
    A-Z lower-cased; a key of at least ``min_chars`` code points in at least ``min_docs`` rows loses all its lines everywhere. Kept
    lines keep their order and bytes. A text that loses every line becomes empty; a null text stays null. Repeated rows count as
    documents of their own, ids are not looked at. Columns named n_lines or n_dropped, in any case, are replaced; others pass through,
    nulls too, whatever they are called. An empty table gives an empty table.

    ``index``: one that ``build_index`` has made of these or other documents (with this ``min_chars``); else one is built.
    Up to ``broadcast_bytes`` of index is broadcast; for a larger one the hashes of lines are sent to its shards.
    """
    if min_chars < 1:
        raise ValueError("min_chars: an empty key is never dropped")
    index = index or build_index(docs, min_chars, text, min(2, min_docs))
    if min_docs < index.least:
        raise ValueError(f"the index holds lines of {index.least} documents or more")
    n_lines = F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).cast("long")
    rows = docs.select(frames.packed(docs, (text, "n_lines", "n_dropped")).alias("row"), frames.column(text).alias("text"), n_lines.alias("n_lines"))
    small = index.keys * KEY_BYTES <= broadcast_bytes
    out = _probed_here(rows, index, min_docs) if small else _probed_there(rows, index, min_docs, min_chars)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[(F.col("text") if c.lower() == text.lower() else F.col("row").getField(c)).alias(c) for c in names], "n_lines", "n_dropped")
