"""The join against brute force over all pairs."""

from collections import Counter, defaultdict

import pytest

from tidepanel.llm import jaccard_join as jj

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def grams(text):
    words = (text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """{id: (class_id, set_id, n_copies, n_links)}, ids distinct."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[grams(t) or ("none", i)].append(i)
    keys = list(sets)
    links = defaultdict(set)
    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if isinstance(x, frozenset) and isinstance(y, frozenset) and 5 * len(x & y) >= 4 * len(x | y):
                links[a].add(b)
                links[b].add(a)
    group = list(range(len(keys)))
    moved = True
    while moved:
        moved = False
        for a, near in links.items():
            least = min(group[x] for x in [a, *near])
            for x in [a, *near]:
                moved |= group[x] != least
                group[x] = least
    classes = defaultdict(list)
    for a, g in enumerate(group):
        classes[g] += sets[keys[a]]
    return {i: (min(classes[group[a]]), min(sets[k]), len(sets[k]), len(links[a])) for a, k in enumerate(keys) for i in sets[k]}


def edited(base, k):
    words = base.split()
    words[k % len(words)] = f"edit{k}"
    return " ".join(words)


def sample_rows():
    base = " ".join(WORDS[(i * i + i // 3) % len(WORDS)] + str(i % 7) for i in range(120))
    other = " ".join(WORDS[(i * 7 + 3) % len(WORDS)] + str(i % 11) for i in range(60))
    texts = [base, base, *[edited(base, k) for k in range(0, 110, 4)], edited(edited(base, 5), 60), base.replace(" ", "\n"), other, edited(other, 30), "", None, " \t\n", "two words", "two words", "one", "x y z w v", base + " tail", WORDS[0]]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [1024, 3, 2])
def test_against_brute_force(spark, block):
    rows = sample_rows()
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, size int")
    got = {r["doc_id"]: (r["class_id"], r["set_id"], r["n_copies"], r["n_links"]) for r in jj.join(docs, block_classes=block).collect()}
    assert got == brute(rows)


def test_few_long_texts_in_many_blocks(spark, monkeypatch):
    """Blocks by n-grams outnumber the classes of a bucket, so most are empty; each pair still counts once."""
    monkeypatch.setattr(jj, "BLOCK_GRAMS", 40)
    texts = []
    for group in range(12):
        base = " ".join(f"w{group}x{i * i % 101}" for i in range(100))
        texts += [base, *[edited(base, 30 + k) for k in range(1 + group % 2)]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["set_id"], r["n_copies"], r["n_links"]) for r in jj.join(docs).collect()}
    assert got == brute(rows)


def test_null_and_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_copies"]) for r in jj.join(docs).collect()), key=str)
    assert got == [(3, 3, 3), (3, 3, 3), (None, 3, 3), (None, None, 1)]
    assert jj.join(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = jj.choose_bands(threshold, 0.999, 256)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


def test_blocks_of_single_classes(spark):
    """Twelve pairs in blocks of one class: every group is of two blocks, and many blocks are empty."""
    texts = []
    for group in range(12):
        base = " ".join(f"w{group}x{i * i % 101}" for i in range(100))
        texts += [base, edited(base, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["n_links"] for r in jj.join(docs, block_classes=1).collect()} == {1}


def test_recall_against_all_pairs(spark):
    """Links of every document of a larger table; sets that share no n-gram can't be linked."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: grams(t) for i, t in rows}
    distinct, holders = list({s for s in sets.values() if s}), defaultdict(list)
    for k, s in enumerate(distinct):
        for g in s:
            holders[g].append(k)
    links = {}
    for k, s in enumerate(distinct):
        shared = Counter(j for g in s for j in holders[g] if j != k)
        links[s] = sum(5 * n >= 4 * (len(s) + len(distinct[j]) - n) for j, n in shared.items())
    got = {r["doc_id"]: r["n_links"] for r in jj.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    truth = {i: links.get(s, 0) for i, s in sets.items()}
    print(f"links: {sum(got.values())} of {sum(truth.values())}")
    assert sum(truth.values()) > 10 and all(got[i] <= n for i, n in truth.items())
    assert sum(got.values()) >= 0.99 * sum(truth.values())


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["set_id"], r["n_copies"], r["n_links"]) for r in jj.join(docs).collect()}
    assert got == brute(rows)


def test_odd_rows(odd_docs, no_docs, passed_through):
    assert jj.join(odd_docs).count() == odd_docs.count()
    alone = jj.one_of_each_group(odd_docs)
    assert alone.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in alone.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert jj.one_of_each_group(no_docs).count() == 0
