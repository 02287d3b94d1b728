from collections import Counter

import numpy as np
import pytest

from tidepanel.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"


def brute(texts, min_docs):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        gone = [count[key(x)] >= min_docs for x in lines]
        out.append((len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def texts():
    own = [f"head\n  Common LINE\t\nbody {i}\n\ncommon line" for i in range(12)]
    return [*own, None, "", "\n", "É common line", "COMMON LINE\r", "É\né", "only", "common line\ncommon line"]


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 1])
def test_against_brute_force(spark, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", 2)  # several shards; with one byte the probes go to them
    own = texts() + [f"r{i % 7}\ns{i % 5}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in ld.drop_frequent_lines(docs, 10, broadcast_bytes=broadcast_bytes).collect()}
    assert [got[i] for i in range(len(own))] == brute(own, 10)


def test_shard_is_minimal_and_turns_strangers_away():
    keys = ld.key_hashes([f"k{i}".encode() for i in range(5000)])
    sizes, bits, prints, counts = ld.build_shard(keys, np.arange(5000) + 10)
    shard = ld.Shard.load(sizes, bits, prints, counts)
    assert len(shard.counts) == 5000
    assert (shard.count(keys) == np.arange(5000) + 10).all()
    assert not shard.count(ld.key_hashes([f"other{i}".encode() for i in range(20_000)])).any()


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 1])
def test_counts_in_the_index_decide(spark, broadcast_bytes, monkeypatch):
    """One index, built once, answers for any number of documents: what it holds are counts, not verdicts."""
    monkeypatch.setattr(ld, "SHARD_KEYS", 3)
    own = [f"l{i % 3}\nm{i % 8}\nn{i % 20}\nalone{i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    index = ld.build_index(docs)
    assert index.keys == 3 + 8 + 20 and index.shards == 11
    for min_docs in (2, 4, 8, 21):
        out = ld.drop_frequent_lines(docs, min_docs, broadcast_bytes=broadcast_bytes, index=index)
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()}
        assert [got[i] for i in range(len(own))] == brute(own, min_docs)
    with pytest.raises(ValueError):
        ld.drop_frequent_lines(docs, 1, index=index)


def test_one_line_of_a_third_of_all_texts_and_copies(spark, monkeypatch):
    """Where probes go to the shards: a hot line, a hot text, nulls and empty texts."""
    own = ["hot\nline"] * 300 + [f"hot\nx{i}" for i in range(200)] + [None, "", "\n"] * 20
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in ld.drop_frequent_lines(docs, 10, broadcast_bytes=1).collect()}
    assert [got[i] for i in range(len(own))] == brute(own, 10)


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 1])
def test_columns_pass_through(odd_docs, passed_through, broadcast_bytes):
    out = ld.drop_frequent_lines(odd_docs, 1000, broadcast_bytes=broadcast_bytes)
    passed_through(out, ("n_lines", "n_dropped"))


def test_odd_rows(odd_docs, no_docs):
    out = ld.drop_frequent_lines(odd_docs, 3)
    assert sorted(out.columns) == sorted([*odd_docs.columns, "n_dropped"])
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], (r["text"] or "")[:3]) for r in out.collect()}
    assert (1, 1, 1, "") in got and (None, 1, 1, "") in got and (5, 4, 0, "\n\n ") in got and (4, 1, 0, "lor") in got and (2, 1, 0, "") in got
    assert ld.drop_frequent_lines(no_docs).count() == 0
    with pytest.raises(ValueError):
        ld.drop_frequent_lines(odd_docs, min_chars=0)
