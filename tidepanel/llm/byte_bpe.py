"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Every code point has a class; a class is a function on the eight states that a scanner of
the split pattern can be in; composing functions is associative, so the state before every character of a batch comes from one scan
over function numbers, run side by side over strips. A table of state and class tells where pieces begin. Distinct pieces are merged
side by side, by rank, behind a cache, and byte offsets of tokens stay with the ids for decoding.

The pattern, of the public vocabularies: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm import frames

# Classes of characters: letter, number, other, an apostrophe that opens a contraction of two or three characters, a blank before a
# non-space, other space before a non-space, space before space or the end, and the gap between texts.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, LAST, INNER, GAP = range(9)
# States: nothing open, in letters, in numbers, in others, after a blank that joins what follows, in space, one or two characters of a
# contraction still to come.
OPEN, LETTERS, NUMBERS, OTHERS, JOINING, SPACES, ONE_MORE, TWO_MORE = range(8)
#: Code points of Unicode's White_Space.
SPACES_AT = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
STRIP = 256
CACHED_BYTES = 64
CACHED_PIECES = 300_000
HASH_BASE = 0x2545F4914F6CDD1D
NO_RANK = 1 << 40
#: Ids of texts that are decoded at once, and ids whose bytes are gathered at once.
DECODED_IDS = 1 << 19
GATHERED_IDS = 1 << 17


def _move(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at this character."""
    if kind == GAP:
        return OPEN, True
    if state in (ONE_MORE, TWO_MORE):
        return (OPEN if state == ONE_MORE else ONE_MORE), False
    if kind in (LETTER, NUMBER, OTHER):
        to = (LETTERS, NUMBERS, OTHERS)[kind]
        return to, state not in (to, JOINING)
    if kind in (SHORT, LONG):
        return (OTHERS, False) if state in (OTHERS, JOINING) else (ONE_MORE if kind == SHORT else TWO_MORE, True)
    if kind == INNER:
        return SPACES, state != SPACES
    return (JOINING if kind == BLANK else OPEN), True


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The function number of each class, the composition of two numbers (first, then), the state a number leads to from each state, and where pieces begin by state and class."""
    moves = [tuple(_move(s, k)[0] for s in range(8)) for k in range(9)]
    found = dict.fromkeys([tuple(range(8)), *moves])
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in moves:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = None
                todo.append(h)
    number = {f: i for i, f in enumerate(found)}
    compose = np.array([[number[tuple(g[s] for s in f)] for g in found] for f in found], dtype=np.uint8 if len(found) < 256 else np.uint16)
    begins = np.array([[_move(s, k)[1] for k in range(9)] for s in range(8)])
    return np.array([number[m] for m in moves], dtype=compose.dtype), compose, np.array(list(found), dtype=np.uint8), begins


@cache
def code_classes() -> np.ndarray:
    """The class of each code point, by Unicode's general category; apostrophes and spaces are told apart by what follows."""
    kinds = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], dtype=np.uint8)
    kinds[SPACES_AT] = INNER
    return kinds


def _scan(codes: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """The composition of all functions up to and with each position."""
    n = len(codes)
    if n <= STRIP:
        out = codes.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], codes[i]]
        return out
    strips = -(-n // STRIP)
    grid = np.zeros(strips * STRIP, dtype=codes.dtype)
    grid[:n] = codes
    grid = np.ascontiguousarray(grid.reshape(strips, STRIP).T)
    flat, width = compose.ravel(), compose.shape[1]
    for i in range(1, STRIP):
        grid[i] = flat[grid[i - 1].astype(np.int32) * width + grid[i]]
    before = _scan(grid[-1][:-1], compose)
    grid[:, 1:] = flat[before.astype(np.int32)[None, :] * width + grid[:, 1:]]
    return grid.T.ravel()[:n]


def piece_starts(points: np.ndarray, gaps: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of texts that are joined by one character each, at ``gaps``; the gaps begin pieces of their own."""
    kinds = classes[points]
    kinds[gaps] = GAP
    after = np.concatenate([kinds[1:], [GAP]]).astype(np.uint8)
    space = kinds == INNER
    closing = space & (after != INNER) & (after != GAP)
    kinds[closing] = np.where(points[closing] == 32, BLANK, LAST)
    quotes = np.flatnonzero((points == 39) & (kinds == OTHER))
    padded = np.concatenate([points[:], np.zeros(2, dtype=np.uint32)])
    one, two = padded[quotes + 1], padded[quotes + 2]
    kinds[quotes[np.isin(one, [ord(x) for x in "stmd"])]] = SHORT
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    kinds[quotes[pair]] = LONG
    functions, compose, lead, begins = _tables()
    upto = _scan(functions[kinds], compose)
    state = np.concatenate([[OPEN], lead[upto[:-1], OPEN]])
    return np.flatnonzero(begins[state, kinds])


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of a piece: neighbours whose union has the lowest rank are merged, leftmost first, until none has a rank; n log n."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] == n or end[end[i]] != stop:
            continue
        right = end[i]
        alive[right], end[i] = False, stop
        if stop < n:
            back[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (left := back[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


class Merger:
    """Merges many pieces side by side: each round joins the leftmost pair of lowest rank of every piece that has one left.

    Pairs are looked up by their ids among all ways in which a token is made of two tokens.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        own = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.keys, self.made = np.append(own[:, 0], np.iinfo(np.int64).max), np.append(own[:, 1], 0)
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], NO_RANK)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after the other, and the number of ids of each; pieces that are tokens, and long ones, are taken on their own."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        whole = np.array([self.ranks.get(p, -1) for p in pieces], dtype=np.int64)
        done_ids, done_owner = [whole[whole >= 0]], [np.flatnonzero(whole >= 0)]
        for i in np.flatnonzero((whole < 0) & (sizes > CACHED_BYTES)).tolist():
            done_ids.append(np.array(merge(pieces[i], self.ranks)))
            done_owner.append(np.full(len(done_ids[-1]), i))
        rest = np.flatnonzero((whole < 0) & (sizes <= CACHED_BYTES) & (sizes > 0))
        ids = self.bytes[np.frombuffer(b"".join([pieces[i] for i in rest.tolist()]), dtype=np.uint8)]
        owner = np.repeat(rest, sizes[rest])
        rank = np.append(self.pair_ranks(ids[:-1], ids[1:]), NO_RANK)[: len(ids)]
        rank[:-1][owner[1:] != owner[:-1]] = NO_RANK
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            active = np.repeat(least < NO_RANK, sizes)
            if not active.all():
                done_ids.append(ids[~active])
                done_owner.append(owner[~active])
                ids, owner, rank, least, sizes = ids[active], owner[active], rank[active], least[least < NO_RANK], sizes[least < NO_RANK]
                if not len(ids):
                    break
            spot = np.flatnonzero(rank == np.repeat(least, sizes))
            spot = spot[np.append(True, owner[spot[1:]] != owner[spot[:-1]])]
            ids[spot] = rank[spot]
            keep = np.ones(len(ids), dtype=bool)
            keep[spot + 1] = False
            at = spot - np.arange(len(spot))
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            # only the pairs on both sides of a merged place are new
            for k in (at[(at > 0)] - 1, at[at < len(ids) - 1]):
                k = k[owner[k] == owner[k + 1]]
                rank[k] = self.pair_ranks(ids[k], ids[k + 1])
            end = at[(at == len(ids) - 1) | (owner[np.minimum(at + 1, len(ids) - 1)] != owner[at])]
            rank[end] = NO_RANK
        every, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return every[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pieces))


class Pieces:
    """Ids by piece, filled as pieces come; long pieces aren't kept, and a full cache starts anew."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merger = Merger(ranks)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts = np.zeros(1 << 16, dtype=np.int32), np.zeros(CACHED_PIECES + 1, dtype=np.int64)

    def of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each piece where its ids begin among them and how many they are."""
        if len(self.place) + len(pieces) > CACHED_PIECES:
            self.clear()
        get, kept = self.place.get, len(self.place)
        at = np.array([get(p, -1) for p in pieces], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        names = [pieces[i] for i in new.tolist()]
        raw = [p.encode() for p in names]
        ids, counts = self.merger.merge_all(raw)
        base, end = int(self.starts[kept]), int(self.starts[kept]) + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[:base], np.zeros(2 * end - base, dtype=np.int32)])
        self.ids[base:end] = ids
        begin = base + np.cumsum(counts) - counts
        known = at >= 0
        starts, sizes = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        starts[known] = self.starts[at[known]]
        sizes[known] = self.starts[at[known] + 1] - starts[known]
        starts[new], sizes[new] = begin, counts
        out = self.ids
        if len(pieces) <= CACHED_PIECES and all(len(x) <= CACHED_BYTES for x in raw):
            self.place.update(zip(names, range(kept, kept + len(names)), strict=True))
            self.starts[kept + 1 : kept + 1 + len(names)] = begin + counts
        return out, starts, sizes


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash base, and of its inverse, modulo 2**64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, base, dtype=np.uint64))) for base in (HASH_BASE, pow(HASH_BASE, -1, 1 << 64)))


def _distinct(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of slices of ``points``: the first of each kind, and the number of its kind for each. Slices go by a hash of their content and are compared in full."""
    powers, back = _powers((len(points) >> 20) + 1 << 20)
    value = (points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value * powers[: len(value)])])
    hashes = (prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64)
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    sizes, twin = ends - starts, first[kind]
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if (sizes != sizes[twin]).any() or (points[at + np.repeat(starts, sizes)] != points[at + np.repeat(starts[twin], sizes)]).any():
        return np.arange(len(starts)), np.arange(len(starts))
    return first, kind


def encode_texts(texts: list[str], pieces: Pieces, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one after the other, and the number of ids of each text."""
    joined = "\n".join(texts)
    sizes = np.array([len(t) for t in texts])
    gaps = (np.cumsum(sizes + 1) - 1)[:-1]
    if not joined:
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    starts = piece_starts(points, gaps, classes)
    ends = np.append(starts[1:], len(joined))
    gap = np.zeros(len(points), dtype=bool)
    gap[gaps] = True
    starts, ends = starts[~gap[starts]], ends[~gap[starts]]
    begin = np.concatenate([[0], gaps + 1, [len(joined) + 1]])
    if not len(starts):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    first, kind = _distinct(points, starts, ends)
    every, lead, counts = pieces.of([joined[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
    lead, counts = lead[kind], counts[kind]
    after = np.cumsum(counts)
    ids = every[np.arange(int(after[-1])) + np.repeat(lead - (after - counts), counts)]
    return ids, np.diff(np.concatenate([[0], after])[np.searchsorted(starts, begin)])


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes, a blank, its rank, a line each."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Tokens:
    """The bytes of all ids in one array, ``first`` and ``sizes`` of each."""

    def __init__(self, ranks: dict[bytes, int]):
        own: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            own[rank] = piece
        self.data = np.frombuffer(b"".join(own), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in own], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def bytes_of(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes that ``ids`` stand for; ``ends`` says where each ends. Some hundred thousand ids at a time, so long texts need little besides."""
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
        for at in range(0, len(ids), GATHERED_IDS):
            own, end = ids[at : at + GATHERED_IDS], ends[at : at + GATHERED_IDS]
            sizes, begin = self.sizes[own], int(ends[at - 1]) if at else 0
            out[begin : end[-1]] = self.data[np.arange(begin, end[-1]) + np.repeat(self.first[own] - (end - sizes), sizes)]
        return out


def decode_ids(ids: np.ndarray, counts: np.ndarray, ends: np.ndarray, tokens: Tokens, gone: np.ndarray | None = None) -> pa.BinaryArray:
    """The bytes of each text: its ids' bytes, cut where the offsets say. ``ends``: where each id ends in the bytes of all texts together; ``gone``: texts that are null."""
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    large = pa.py_buffer(cuts.astype(np.int64).tobytes())
    valid = None if gone is None else pa.py_buffer(np.packbits(~gone, bitorder="little").tobytes())
    own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [valid, large, pa.py_buffer(tokens.bytes_of(ids, ends).tobytes())])
    return own.cast(pa.binary())


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def _encoded(docs: DataFrame, ranks_path: str, text: str, decoded: str | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    adds = {"ids": "array<int>", **({decoded: "binary"} if decoded else {"ends": "array<int>"})}

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, classes = shared.value, code_classes()
        pieces, tokens = Pieces(ranks), Tokens(ranks)
        for whole in batches:
            for batch in frames.pieces(whole, "text", 2 << 20):
                ids, counts = encode_texts([x or "" for x in batch.column("text").to_pylist()], pieces, classes)
                ends = np.cumsum(tokens.sizes[ids])
                before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])[:-1]]
                more = {decoded: decode_ids(ids, counts, ends, tokens)} if decoded else {"ends": _lists(ends - np.repeat(before, counts), counts)}
                yield frames.replaced(batch, {"ids": _lists(ids, counts), **more})

    return frames.applied(docs, encoded, {"text": text}, adds)


def encode(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids and ends (array<int>) added: the ids of the whole text, and the byte offset where each token ends in its UTF-8.

    Ids are those of the rank file at ``ranks_path`` (read once, on the driver, and broadcast) under the pattern above, without special
    tokens: their strings are ordinary text. A null or empty text has no ids. Very long texts and pieces take n log n. Repeated rows are
    encoded alike; an empty table gives an empty table. Columns named ids or ends, in any case, are replaced; all others pass through.
    """
    return _encoded(docs, ranks_path, text, None)


def transcode(docs: DataFrame, ranks_path: str, text: str = "text", to: str = "decoded") -> DataFrame:
    """ids as of ``encode``, and the bytes (binary) that ids and offsets stand for, in one pass: neither needs to travel to another Python worker, and offsets to none."""
    return _encoded(docs, ranks_path, text, to)


def decode(encoded: DataFrame, ranks_path: str, to: str = "decoded") -> DataFrame:
    """Adds the bytes (binary) that the ids stand for; null where ids is null. An id that the rank file lacks is an error.

    Where a column ``ends`` is there, the bytes are cut by it, and a row whose offsets aren't those of its ids is an error. A column of the
    new name, in any case, is replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    checked = "ends" in encoded.columns
    uses = {"ids": "ids", **({"ends": "ends"} if checked else {})}

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for whole in batches:
            counts = np.diff(np.asarray(whole.column("ids").offsets))
            group = np.cumsum(counts) // DECODED_IDS
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(counts)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                yield cut(whole.slice(start, end - start), tokens)

    def cut(batch: pa.RecordBatch, tokens: Tokens) -> pa.RecordBatch:
        gone = np.asarray(batch.column("ids").is_null())
        lists = batch.column("ids").fill_null([])
        counts, ids = np.diff(np.asarray(lists.offsets)), np.asarray(lists.flatten())
        if len(ids) and not (0 <= ids.min() and ids.max() < len(tokens.sizes)):
            raise ValueError("an id that the rank file lacks")
        ends = np.cumsum(tokens.sizes[ids])
        if checked:
            before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])[:-1]]
            own = batch.column("ends").fill_null([])
            if (np.diff(np.asarray(own.offsets)) != counts).any() or (np.asarray(own.flatten()) != ends - np.repeat(before, counts)).any():
                raise ValueError("ids and offsets disagree")
        return frames.replaced(batch, {to: decode_ids(ids, counts, ends, tokens, gone)})

    return frames.applied(encoded, decoded, uses, {to: "binary"})
