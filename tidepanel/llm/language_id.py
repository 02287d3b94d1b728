"""Language ID by prediction with partial matching.

Each language has a variable-order byte context tree: how often each byte followed each context of up to ``ORDER`` bytes in its training
texts. A byte's code length under a language is that of its longest known context, with an escape to the next shorter one wherever the
byte was never seen there (method C: a context with n counts over d different bytes escapes with d / (n + d)), down to 8 bits for any
byte. Statistics are frozen after training, so a text's code length is an exact sum that doesn't depend on where it is cut.

For scoring, the contexts of all languages become the states of one automaton; its tables give the next state and every language's
code length for each byte. A batch of texts is cut into strips that are stepped side by side, each warmed up with the ``ORDER`` bytes
before it. Training takes a bounded sample of labelled documents (see ``sample``), and the tables, of bounded size, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames

#: Bytes of context at most.
ORDER = 4
#: Training documents a language, about, bytes of a document that may serve, and bytes of the whole sample: its bound on the driver. Many
#: languages share the last, so each has fewer documents.
SAMPLE_DOCS = 300
SAMPLE_BYTES = 32_768
SAMPLE_TOTAL = 128 << 20
#: States of the automaton, and bytes of its table of code lengths while it is made, at most; contexts are kept by how often they occur.
STATES = 12_000
TABLE_BYTES = 256 << 20
#: Code lengths in 1/256 bit.
UNIT = 256
STRIP = 512
UNKNOWN = "und"


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 3; documents of fold 1 are held out."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(3))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", most_docs: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """(language, text) of about ``most_docs`` labelled documents a language; of one above ``SAMPLE_BYTES`` bytes a slice of so many.

    All samples together hold about ``SAMPLE_TOTAL`` bytes at most: with many languages there are fewer documents of each, one at least.

    Documents are chosen by a hash of id and text against a threshold, most_docs / documents of that language: any number of documents
    may have one language, no task gathers them, and reruns choose alike. Another hash places the slice, so every part of a long text may serve.
    """
    fit = docs.filter(F.col(label).isNotNull() & (F.octet_length(text) > 0)).select(F.col(label).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    counts = {r["lang"]: r["count"] for r in fit.groupBy("lang").count().collect()}
    if not counts:
        return []
    most_docs = max(1, min(most_docs, SAMPLE_TOTAL // (SAMPLE_BYTES * len(counts))))
    at = F.xxhash64("key", "text").cast("double") / 2.0**64 + 0.5
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, most_docs / n)]), F.col("lang"))
    start = F.pmod(F.xxhash64("key", "text", F.lit("slice")), F.greatest(F.octet_length("text") - SAMPLE_BYTES, F.lit(0)) + 1).cast("int") + 1
    part = F.substring(F.col("text").cast("binary"), start, F.lit(SAMPLE_BYTES))
    # characters that a slice cuts through are left out
    return [(r["lang"], bytes(r["text"]).decode(errors="ignore").encode()) for r in fit.filter(at < share).select("lang", part.alias("text")).collect()]


@dataclass
class Automaton:
    """``step``[state, symbol]: the next state; ``cost``[state, symbol, language] in 1/256 bit; ``symbol``: of each byte."""

    languages: list[str]
    symbol: np.ndarray
    step: np.ndarray
    cost: np.ndarray


def _windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ``width`` bytes in a text as an integer, with its count."""
    keys = []
    for t in texts:
        own = np.frombuffer(t, dtype=np.uint8).astype(np.uint64)
        if len(own) >= width:
            key = np.zeros(len(own) - width + 1, dtype=np.uint64)
            for i in range(width):
                key = (key << np.uint64(8)) | own[i : len(own) - width + 1 + i]
            keys.append(key)
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def train(samples: list[tuple[str, bytes]], order: int = ORDER, states: int = STATES) -> Automaton | None:
    """The automaton of the languages in ``samples``; None if there are none."""
    by: dict[str, list[bytes]] = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(text)
    if not by:
        return None
    languages = sorted(by)
    grams = {(lang, w): _windows(by[lang], w) for lang in languages for w in range(1, order + 2)}
    used = np.unique(np.concatenate([grams[lang, 1][0] for lang in languages])).astype(np.int64)
    symbol = np.full(256, len(used), dtype=np.uint8 if len(used) < 256 else np.int16)
    symbol[used] = np.arange(len(used))
    # contexts kept: by total count over the languages; a context's suffix counts no less, so it is kept too
    kept: list[np.ndarray] = [np.zeros(1, dtype=np.uint64)]
    pool = [np.unique(np.concatenate([grams[lang, w][0] for lang in languages])) for w in range(1, order + 1)]
    totals = []
    for w, keys in enumerate(pool, 1):
        total = np.zeros(len(keys), dtype=np.int64)
        for lang in languages:
            k, n = grams[lang, w]
            total[np.searchsorted(keys, k)] += n
        totals.append(total)
    states = min(states, max(1, TABLE_BYTES // (8 * len(languages) * (len(used) + 1))))
    every = np.sort(np.concatenate(totals))[::-1]
    least = max(2, int(every[states - 1]) + 1) if len(every) >= states else 2
    kept += [keys[total >= least] for keys, total in zip(pool, totals, strict=True)]
    sizes = [len(k) for k in kept]
    first = np.concatenate([[0], np.cumsum(sizes)])
    n, width = int(first[-1]), len(used) + 1
    step = np.zeros((n, width), dtype=np.int32)
    cost = np.zeros((n, width, len(languages)), dtype=np.float64)
    cost[0] = 8.0

    def find(w: int, keys: np.ndarray) -> np.ndarray:
        """The state of contexts of ``w`` bytes, or -1."""
        at = np.minimum(np.searchsorted(kept[w], keys), max(0, sizes[w] - 1))
        return np.where(kept[w][at] == keys, first[w] + at, -1) if sizes[w] else np.full(len(keys), -1)

    for w in range(order + 1):
        own = np.arange(first[w], first[w + 1])
        shorter = np.zeros(len(own), dtype=np.int64)
        if w:
            tail = find(w - 1, kept[w] & np.uint64((1 << (8 * (w - 1))) - 1))
            shorter, step[own], cost[own] = tail, step[tail], cost[tail]
        if w < order:
            for s, byte in enumerate(used):
                to = find(w + 1, (kept[w] << np.uint64(8)) | np.uint64(byte))
                step[own[to >= 0], s] = to[to >= 0]
        for i, lang in enumerate(languages):
            keys, counts = grams[lang, w + 1]
            context = find(w, keys >> np.uint64(8)) if w else np.zeros(len(keys), dtype=np.int64)
            seen = context >= 0
            context, sym, counts = context[seen], symbol[(keys[seen] & np.uint64(255)).astype(np.int64)], counts[seen]
            n_in, kinds = np.bincount(context, counts, minlength=n), np.bincount(context, minlength=n)
            known = own[n_in[own] > 0]
            cost[known, :, i] += np.log2((n_in[known] + kinds[known]) / kinds[known])[:, None]
            cost[context, sym, i] = np.log2((n_in[context] + kinds[context]) / counts)
    return Automaton(languages, symbol, step, np.minimum(np.rint(cost * UNIT), 65535).astype(np.uint16))


def code_lengths(texts: list[bytes], model: Automaton, order: int = ORDER) -> np.ndarray:
    """Bits of each text (rows) under each language (columns)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), len(model.languages)))
    strips = -(-sizes // STRIP)
    text_of = np.repeat(np.arange(len(texts)), strips)
    if not len(text_of):
        return out
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    data = model.symbol[data].astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    within = np.arange(len(text_of)) - np.repeat(np.concatenate([[0], np.cumsum(strips)])[:-1], strips)
    begin = starts[text_of] + within * STRIP
    length = np.minimum(STRIP, sizes[text_of] - within * STRIP)
    by = np.argsort(-length, kind="stable")
    begin, length, within = begin[by], length[by], within[by]
    width = model.step.shape[1]
    step, cost = model.step.ravel(), model.cost.reshape(-1, len(model.languages))
    state = np.zeros(len(by), dtype=np.int64)
    for k in range(order, 0, -1):
        # bytes before a strip, where they are of the same text
        warm = np.flatnonzero(within * STRIP >= k)
        state[warm] = step[state[warm] * width + data[begin[warm] - k]]
    total = np.zeros((len(by), len(model.languages)), dtype=np.int64)
    alive = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
    for k, m in enumerate(alive):
        at = state[:m] * width + data[begin[:m] + k]
        total[:m] += cost[at]
        state[:m] = step[at]
    np.add.at(out, text_of[by], total / UNIT)
    return out


def identify(docs: DataFrame, model: Automaton | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and bits_per_byte (of the predicted language) added.

    The language is the one that codes the whole text in the fewest bits, ties to the first by name. ``score`` is its posterior for a
    stretch of 64 bytes that codes like the whole text (a shorter text stands for itself), languages alike before. A text that is null or
    has no letter is ``und`` with score 0, and so is every text where nothing could be learned. Repeated rows are judged alike; an empty
    table gives an empty table. Columns of these names, in any case, are replaced; all others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in frames.pieces(whole, "text"):
                yield cut(batch, own)

    def cut(batch: pa.RecordBatch, own: Automaton | None) -> pa.RecordBatch:
        texts = frames.utf8(batch, "text")
        known = np.asarray(batch.column("lettered"), dtype=bool)
        langs, score, rate = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts)), np.zeros(len(texts))
        if own is not None and known.any():
            at = np.flatnonzero(known)
            bits = code_lengths([texts[i] for i in at], own)
            sizes = np.array([len(texts[i]) for i in at])
            best = np.argmin(bits, axis=1)
            over = (bits - bits.min(axis=1)[:, None]) * (np.minimum(sizes, 64) / sizes)[:, None]
            langs[at] = np.array(own.languages, dtype=object)[best]
            score[at] = 1 / np.exp2(-np.minimum(over, 1000)).sum(axis=1)
            rate[at] = bits.min(axis=1) / sizes
        return frames.replaced(batch.drop_columns(["lettered"]), {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(score), "bits_per_byte": pa.array(rate)})

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return frames.applied(docs, scored, {"text": text}, {"lang_pred": "string", "score": "double", "bits_per_byte": "double"}, lettered=lettered)


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Automaton | None:
    """The model learned from labelled documents outside the held-out fold; a null id has no fold and isn't learned from."""
    return train(sample(docs.filter(fold(F.col(key)) != 1), key, text, label))
