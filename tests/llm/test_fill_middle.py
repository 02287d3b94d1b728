import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepanel.llm import fill_middle as fm

NEW = {"n", "form", "prefix_chars", "middle_chars", "output"}


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fm.MARKERS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aZz@[`{mé漢😀 \n0\x7f\x00Ā")), max_size=40), max_size=6))
def test_units_of_texts_side_by_side(texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    units = fm.Units(np.frombuffer(b"".join(data), np.uint8), offsets)
    ends = []
    for start, t in zip(offsets, texts, strict=False):
        own = [len(t[: m.end()].encode()) - 1 for m in re.finditer("[A-Za-z]+|[^A-Za-z]", t, re.S)]
        ends += [start + e for e in own]
    every = np.arange(offsets[-1] + 1)
    assert units.rank(every).tolist() == np.searchsorted(ends, every).tolist()
    assert units.select(np.arange(1, len(ends) + 1)).tolist() == ends
    assert units.chars(offsets[:-1], offsets[1:]).tolist() == [len(t) for t in texts]


def test_against_brute_force_and_back(spark):
    words = ["alpha", "B2", "é漢", "😀", " ", "\n", "<", "<S", "P>", "x" * 90, "0"]
    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(words, rng.integers(0, 60)))) for i in range(600)]
    rows += [(None, "null key"), (7, None), (8, ""), (9, "a<P>b"), (10, "<M>"), (11, "word " * 300_000), (11, "word " * 300_000), (12, "q" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = fm.transformed(docs).withColumn("back", fm.restored(F.col("form"), F.col("output"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(odd_docs, no_docs, passed_through, empty):
    docs = no_docs if empty else odd_docs
    passed_through(fm.transformed(docs), NEW, docs)
