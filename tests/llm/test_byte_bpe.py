import random

import public_tokenizers
import pytest
import tiktoken

from tidepanel.llm import byte_bpe as bb

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bb.read_ranks(PATH), special_tokens={})


def test_pieces_and_ids_as_the_library(library):
    random.seed(5)
    alphabet = list("  \n\t'''stmdrevlab19.,!é 　漢😀\r\x85\x1c")
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 80))) for _ in range(4000)]
    texts += ["", "don't we'll they've 'll ''s 's's <|endoftext|>", " " * 700, "ab" * 5000, "\n\n  x", "x  "]
    ids, counts = bb.encode_texts(texts, bb.Pieces(bb.read_ranks(PATH)), bb.code_classes())
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == library.encode_ordinary(text), repr(text)
        at += n


def test_long_pieces_merge_alike(library):
    ranks = bb.read_ranks(PATH)
    for piece in ("a" * 3000, "xyzzy" * 500, "漢字" * 400):
        assert list(bb.merge(piece.encode(), ranks)) == library.encode_ordinary(piece)


def test_full_cache_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bb, "CACHED_PIECES", 50)
    pieces = bb.Pieces(bb.read_ranks(PATH))
    for k in range(5):
        text = " ".join(f"word{k}{i}" for i in range(40))
        ids, _ = bb.encode_texts([text], pieces, bb.code_classes())
        assert ids.tolist() == library.encode_ordinary(text)


def test_round_trip_of_odd_rows(odd_docs, no_docs, library, passed_through):
    encoded = bb.encode(odd_docs, PATH)
    assert {c.lower() for c in encoded.columns} == {c.lower() for c in odd_docs.columns}
    for r in bb.decode(encoded, PATH).collect():
        text = r["text"] or ""
        assert r["decoded"] == text.encode() and r["ids"] == library.encode_ordinary(text)
        assert r["ends"] == sorted(r["ends"]) and (r["ends"][-1] if r["ends"] else 0) == len(text.encode())
    assert bb.decode(bb.encode(no_docs, PATH), PATH).count() == bb.transcode(no_docs, PATH).count() == 0
    passed_through(encoded, ("ids", "ends"))
    passed_through(bb.transcode(odd_docs, PATH), ("ids", "decoded"))
    key = ["doc_id", "ids", "decoded"]
    assert sorted(map(str, bb.transcode(odd_docs, PATH).select(key).collect())) == sorted(map(str, bb.decode(encoded, PATH).select(key).collect()))


def test_decode_rejects_what_it_cannot_decode(spark):
    bad = spark.createDataFrame([([10**7],)], "ids array<int>")
    with pytest.raises(Exception, match="rank file lacks"):
        bb.decode(bad, PATH).collect()
    none = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert sorted([r["decoded"] for r in bb.decode(none, PATH).collect()], key=str) == sorted([None, b""], key=str)


def test_offsets_decide_where_texts_end(spark, library):
    """Offsets that aren't those of the ids are an error; many ids at a time are cut at the same places."""
    text = "offsets decide " * 30_000
    own = bb.encode(spark.createDataFrame([(1, text), (2, "x"), (3, "")], "doc_id long, text string"), PATH)
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bb.decode(own, PATH).collect()}
    assert got == {1: text.encode(), 2: b"x", 3: b""}
    wrong = spark.createDataFrame([(library.encode_ordinary("two words"), [3, 8])], "ids array<int>, ends array<int>")
    with pytest.raises(Exception, match="disagree"):
        bb.decode(wrong, PATH).collect()
