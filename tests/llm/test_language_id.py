import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidepanel.llm import language_id as li

SAMPLES = [("en", b"the cat and the hat sat on the mat. " * 8), ("de", "der Hund und die Straße über dem Fluß. ".encode() * 8), ("en", b"another the"), ("fr", "le été où ça va très bien. ".encode() * 8)]


def brute_bits(text, lang, model_contexts, order):
    """Code length by the definition: longest known context, escapes, 8 bits at last; ``model_contexts`` are those that the model keeps."""
    follow = defaultdict(Counter)
    for name, t in SAMPLES:
        if name == lang:
            for i in range(len(t)):
                for k in range(min(i, order) + 1):
                    follow[t[i - k : i]][t[i]] += 1
    bits = 0.0
    for i, byte in enumerate(text):
        k = max(k for k in range(min(i, order) + 1) if text[i - k : i] in model_contexts)
        while True:
            seen = follow.get(text[i - k : i], Counter())
            n, d = sum(seen.values()), len(seen)
            if n and seen[byte]:
                bits += math.log2((n + d) / seen[byte])
                break
            if n:
                bits += math.log2((n + d) / d)
            if k == 0:
                bits += 8
                break
            k -= 1
    return bits


def contexts(order, least=2):
    every = Counter()
    for _, t in SAMPLES:
        for k in range(1, order + 1):
            for i in range(len(t) - k + 1):
                every[t[i : i + k]] += 1
    return {b""} | {c for c, n in every.items() if n >= least}


def test_code_lengths_by_definition(monkeypatch):
    monkeypatch.setattr(li, "STRIP", 16)  # texts are cut, and the cuts must not show
    model = li.train(SAMPLES)
    kept = contexts(li.ORDER)
    texts = [b"the hat and the Hund", "Straße où the \x00 zzz".encode() * 3, b"x", b"", "été".encode(), b"the " * 40]
    got = li.code_lengths(texts, model)
    for row, t in zip(got, texts):
        for bits, lang in zip(row, model.languages):
            assert abs(bits - brute_bits(t, lang, kept, li.ORDER)) <= (len(t) + 1) / li.UNIT


def test_states_are_bounded():
    rng = np.random.default_rng(0)
    noise = [("a", rng.integers(97, 123, 50_000).astype(np.uint8).tobytes())]
    assert len(li.train(noise, states=500).step) <= 501
    assert li.train([]) is None


def test_many_languages_share_the_sample_and_the_table(spark, monkeypatch):
    monkeypatch.setattr(li, "SAMPLE_TOTAL", 40 * li.SAMPLE_BYTES)
    monkeypatch.setattr(li, "TABLE_BYTES", 8 * 20 * 30 * 100)
    rows = [(i, f"word{i % 20} and {i} more", f"l{i % 20}") for i in range(2000)]
    own = li.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = li.train(own)
    assert 19 <= len(own) <= 80 and 8 * model.step.size * len(model.languages) <= li.TABLE_BYTES


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = li.identify(docs, li.learned(docs)).filter(li.fold(F.col("doc_id")) == 1)
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 250 and right > 0.98


def test_language_of_long_texts_only(spark):
    """A language whose documents are all longer than a sample's slice is learned too."""
    long = "der Hund und die Straße über dem Fluß, "
    rows = [(i, "the cat and the hat sat on the mat. " * 8, "en") for i in range(20)] + [(100 + i, (long + f"Haus {i} ") * 2_000, "de") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = li.sample(docs)
    assert sorted(len(t) for lang, t in own if lang == "en") == [288] * 20
    assert [li.SAMPLE_BYTES - 6 < len(t) <= li.SAMPLE_BYTES for lang, t in own if lang == "de"] == [True] * 5
    assert all(any(t.decode() in x[1] for x in rows) for _, t in own)
    assert len({t[:40] for lang, t in own if lang == "de"}) > 1  # slices start at different places
    found = li.identify(docs, li.learned(docs)).select("lang", "lang_pred").distinct().collect()
    assert {tuple(r) for r in found} == {("en", "en"), ("de", "de")}


def test_fold_is_the_crc():
    assert zlib.crc32(b"17") % 3 in (0, 1, 2)


def test_odd_rows(spark, odd_docs, no_docs, passed_through):
    ids = spark.range(50).select(F.col("id"), li.fold(F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in ids)
    model = li.train(SAMPLES)
    got = {(r["doc_id"], r["lang_pred"]) for r in li.identify(odd_docs, model).select("doc_id", "lang_pred").collect()}
    assert {(2, "und"), (3, "und"), (5, "und"), (None, "und")} <= got and not {(1, "und"), (4, "und"), (6, "und"), (7, "und")} & got
    out = li.identify(odd_docs, model)
    passed_through(out, ("lang_pred", "score", "bits_per_byte"))
    assert all(0 <= r["score"] <= 1 for r in out.select("score").collect())
    assert li.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in li.identify(odd_docs, li.learned(no_docs)).collect()} == {"und"}
