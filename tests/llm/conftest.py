import pytest

LONG = "lorem ipsum " * 40_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like what operators add."""
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 3),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 3),
        (2, "", "en", "a", 0),
        (3, None, None, None, None),
        (None, "one two three four five six seven eight nine ten eleven", "en", None, 5),
        (None, None, None, None, None),
        (4, LONG, "la", "b", len(LONG)),
        (5, "\n\n \n", None, "b", 4),
        (6, "x" * 100_000, "en", "", 100_000),
        (7, "ünï çødé 漢字 😀\r\nzwei", "de", "ü", 20),
    ]
    clash = """size hash ids ends secrets score host kept n_lines lang_pred code id first row whole below target copies _mix_hash found hits
        tokens windows lines failed base_failed _host n_card N_DATE IDS_ Ends_ url path rule a.b back`tick batch shard part block bands decoded""".split()
    own = spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` int" for c in clash))
    return own.repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def passed_through(odd_docs):
    """Holds that an operator's result has every column of ``odd_docs`` that it doesn't set (``new``, in any case), with its values, once a row."""

    def check(out, new=(), source=odd_docs):
        gone = {n.lower() for n in new}
        names = [c for c in source.columns if c.lower() not in gone]
        assert [c for c in out.columns if c.lower() not in gone] == names
        at, back = [out.columns.index(c) for c in names], [source.columns.index(c) for c in names]
        rows = sorted(str([r[i] for i in at]) for r in out.collect())
        assert rows == sorted(str([r[i] for i in back]) for r in source.collect())

    return check
