import corpus_pipeline as cp

BASIC = "doc_id long, text string, lang string, source string, n_chars long"


def test_whole_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    rows = out.collect()
    assert rows and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    found = cp.identify_language(spark, docs, "")
    assert ids(found) == ids(docs.filter(r"text rlike '\\p{L}'"))
    lines = cp.drop_lines(spark, found, "")
    assert ids(lines) == ids(found)
    alone = cp.drop_near_copies(spark, lines, "")
    assert len(ids(alone)) == alone.count()
    for df in (found, lines, alone, cp.mix_sources(spark, alone, "")):
        assert df.columns == docs.columns


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, "")
            docs.collect()


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(100))
    near = base.replace("w50 ", "other ")
    rows = [(2, base), (1, near), (1, near), (3, base), (None, base), (4, ""), (4, ""), (5, None), (6, "far " * 3 + base[:200])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], BASIC)
    got = sorted(((r["doc_id"], (r["text"] or "")[:3]) for r in cp.drop_near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, "w0 "), (4, ""), (4, ""), (5, ""), (6, "far")], key=str)
