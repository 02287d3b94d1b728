"""Fill-in-the-middle transformation: a text is cut into prefix, middle and suffix at unit ends, and its middle is moved to the end.

Units are runs of ASCII letters and single other code points. They are found without a regular expression: the UTF-8 bytes of a batch are
viewed as 64-bit words, arithmetic on whole words marks each byte that ends a unit, ``bitwise_count`` counts the marks of a word, and the k-th
end of a text is found by a search in the running counts and a select inside one word. Each text is read once; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames

MARKERS = ("<P>", "<S>", "<M>")

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
#: Words that are marked at a time, which bounds what the arithmetic needs beside the text.
CHUNK = 1 << 16


def _letters(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is an ASCII letter."""
    low = (words | (ONES << np.uint64(5))) & LOW7
    from_a, past_z = low + ONES * np.uint64(0x80 - ord("a")), low + ONES * np.uint64(0x80 - ord("z") - 1)
    return from_a & ~past_z & ~words & HIGH


def _continued(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that continues a code point."""
    return words & ~(words << np.uint64(1)) & HIGH


def _ends(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte of all words but the last that ends a unit: a letter before none, or another byte before none that continues it."""

    def next_byte(marks: np.ndarray) -> np.ndarray:
        return (marks[:-1] >> np.uint64(8)) | (marks[1:] << np.uint64(56))

    letters, continued = _letters(words), _continued(words)
    return ((letters[:-1] & ~next_byte(letters)) | (~letters[:-1] & ~next_byte(continued))) & HIGH


class Units:
    """Units of texts that lie one after another in ``data``, text i from ``offsets[i]`` to ``offsets[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data) // 8 + 1
        padded = np.zeros(8 * (n + 1), dtype=np.uint8)
        padded[: len(data)] = data
        self.words = padded.view("<u8")
        self.marks = np.empty(n, dtype="<u8")
        for at in range(0, n, CHUNK):
            self.marks[at : at + CHUNK] = _ends(self.words[at : min(n, at + CHUNK) + 1])
        by_byte = self.marks.view(np.uint8)
        by_byte[offsets[1:][np.diff(offsets) > 0] - 1] = 0x80
        by_byte[len(data) :] = 0
        self.before = np.zeros(n + 1, dtype=np.int64)
        self.continued = np.zeros(n + 1, dtype=np.int64)
        for at in range(0, n, CHUNK):
            self.before[at + 1 : at + CHUNK + 1] = np.bitwise_count(self.marks[at : at + CHUNK])
            self.continued[at + 1 : at + CHUNK + 1] = np.bitwise_count(_continued(self.words[at : min(n, at + CHUNK)]))
        np.cumsum(self.before, out=self.before)
        np.cumsum(self.continued, out=self.continued)

    @staticmethod
    def _rank(before: np.ndarray, marks: np.ndarray, places: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (places.astype(np.uint64) % np.uint64(8) * np.uint64(8))) - np.uint64(1)
        return before[places >> 3] + np.bitwise_count(marks & below)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ends before each byte."""
        return self._rank(self.before, self.marks[places >> 3], places)

    def chars(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code points from byte to byte."""
        more = [self._rank(self.continued, _continued(self.words[p >> 3]), p) for p in (starts, ends)]
        return ends - starts - (more[1] - more[0])

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th end, from 1."""
        word = np.searchsorted(self.before, k) - 1
        left = (k - self.before[word]).astype(np.uint64)
        running = (self.marks[word] >> np.uint64(7)) * ONES  # each byte: marks up to it
        reached = ((running | HIGH) - left * ONES) & HIGH
        return word * 8 + 8 - np.bitwise_count(reached)


def _transformed(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("text").fill_null("")
    _, offset_bytes, held = texts.buffers()
    ends = np.frombuffer(offset_bytes, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held else np.zeros(0, np.uint8)
    ends -= ends[0]
    units, start, end = Units(data, ends), ends[:-1], ends[1:]
    first = units.rank(start)
    n = units.rank(end) - first
    draws = [np.asarray(batch.column(c)) % (n + 1) for c in ("draw1", "draw2")]
    cuts = []
    for taken in (np.minimum(*draws), np.maximum(*draws)):
        cut = start.copy()
        some = taken > 0
        cut[some] = units.select((first + taken)[some]) + 1
        cuts.append(cut)
    forms, view = batch.column("shape").to_pylist(), memoryview(np.ascontiguousarray(data))
    p, s, m = (x.encode() for x in MARKERS)
    parts: list = []
    sizes = np.zeros(len(n), dtype=np.int64)
    for i, (form, a, b, c, d) in enumerate(zip(forms, start.tolist(), cuts[0].tolist(), cuts[1].tolist(), end.tolist(), strict=True)):
        if form == "plain":
            own = (view[a:d],)
        elif form == "psm":
            own = (p, view[a:b], s, view[c:d], m, view[b:c])
        else:
            own = (s, view[c:d], p, view[a:b], m, view[b:c])
        parts += own
        sizes[i] = sum(map(len, own))
    out = pa.StringArray.from_buffers(len(n), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(b"".join(parts)))
    plain = np.array([f == "plain" for f in forms], dtype=bool)
    counted = {"prefix_chars": units.chars(start, cuts[0]), "middle_chars": units.chars(cuts[0], cuts[1])}
    new = {"n": pa.array(n), "form": batch.column("shape"), **{k: pa.array(v, mask=plain) for k, v in counted.items()}, "output": out}
    return frames.replaced(batch.drop_columns(["draw1", "draw2", "shape"]), new)


def transformed(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n (long), form (plain, psm or spm), prefix_chars, middle_chars (long, code points) and output (string) added.

    n counts the units of the whole text. Four draws of 32 bits come from the SHA-256 of seed, colon and decimal key (null: nothing after
    the colon): the smaller and the larger of the first two, modulo n + 1, are the units before the first and the second cut; the third
    leaves ``plain_percent`` of the texts as they are, the fourth makes ``spm_percent`` of the rest spm (suffix first), the others psm. A text
    that is empty, null or holds a marker stays plain, and then both counts are null and output is the text (null: empty). Pieces may be empty.
    Repeated rows are cut alike; an empty table gives an empty table. A text takes some four times its bytes of memory. Columns of the new
    names, in any case, are replaced; all others pass through.
    """
    hashed = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(frames.column(key).cast("string"), F.lit(""))), "UTF-8"), 256)
    draw = [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    own = F.coalesce(frames.column(text), F.lit(""))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | own.contains(m)
    shape = F.when((own == "") | marked | (draw[2] % 100 >= 100 - plain_percent), "plain").when(draw[3] % 100 < spm_percent, "spm").otherwise("psm")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in frames.pieces(whole, "text"):
                yield _transformed(batch)

    adds = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    return frames.applied(docs, cut, {"text": text}, adds, draw1=draw[0], draw2=draw[1], shape=shape)


def restored(form: Column, output: Column) -> Column:
    """The text from its form and output: pieces hold no marker, so the markers part them."""
    pieces = F.split(output, "<[PSM]>", -1)
    first, second, middle = (pieces[i] for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
