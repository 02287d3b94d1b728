import html
import itertools
import re

import numpy as np
import pytest

from tidepanel.llm import dom
from tidepanel.llm import html_extract as hx
from tidepanel.llm.layouts import Layouts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return hx.learn(pages)


def blocks(page):
    return [t for _, t in sorted(dom.parsed(page).texts.items())]


@pytest.mark.parametrize(
    ("page", "found"),
    [
        ("a<p>b <b>c</b>\t\n d<p>e&amp;f&lt;&#233;&nbsp;g</p>", ["a", "b c d", "e&f<é g"]),
        ("<p>x<br>y<script>var t='</p>';</script>z<style>p{}</style><!-- <p>no</p> -->w</p>", ["x yzw"]),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>5", ["1", "2", "3", "4", "5"]),
        ("<table><tr><td>a<td>b</div>c<tr><td>d</table>", ["a", "bc", "d"]),
        ("<div>a<div>b</div>c</div></div></p>d", ["a", "b", "c", "d"]),
        ("1 < 2 <> 3 <a href='x>y'>link</a> <IMG SRC=q> end <p", ["1 < 2 <> 3 link end"]),
        ("<p title=\"a > b\">t</p><p>u<!-- never ends <p>v</p>", ["t", "u"]),
        ("<title>no</title><textarea><p>no</p></textarea><svg><text>no</text></svg><button>kept, as it never ends", ["kept, as it never ends"]),
        ("&am &amp &quo <p>&copy;&unknown;", ["&am & &quo", "©&unknown;"]),
        ("", []),
        (" \n\t<p> </p>", []),
    ],
)
def test_text_blocks(page, found):
    assert blocks(page) == found


def test_odd_pages_take_linear_time():
    for part in ("<div>", "<a <a ", '<p title="', "<", "</x>", "<td><div></section>", "<li>", "<button>", "<!-", "&#", "<b"):
        tree = dom.parsed(part * 40_000)
        assert max(tree.depth) <= dom.MOST_DEPTH + 1
    assert blocks("<div>" * 3000 + "deep") == ["deep"]


def test_marginals_against_all_labelings():
    """Messages give what summing over every labelling gives."""
    rng = np.random.default_rng(0)
    trees = [dom.parsed("<div class=a>x<p>y</p><ul><li><a href=#>z</a></li></ul></div>"), dom.parsed(""), dom.parsed("t<section><h1>u</h1></section>")]
    model = hx.Model(rng.normal(size=(hx.N_FEATURES, 3)), rng.normal(size=(hx.N_KINDS, 3, 3)) + hx.Model.empty().edge)
    forest = hx.Forest(trees)
    node, (got, pairs, total) = forest.potentials(model), forest.marginals(model)
    log_z = 0.0
    for start, size in zip(forest.first, [len(t.parent) for t in trees], strict=True):
        want, joint, z = np.zeros((size, 3)), np.zeros((size, 3, 3)), 0.0
        for labels in itertools.product(range(3), repeat=size):
            s = sum(node[start + i, x] for i, x in enumerate(labels))
            s += sum(model.edge[forest.kind[start + i], labels[forest.parent[start + i] - start], labels[i]] for i in range(1, size))
            w = np.exp(s)
            z += w
            for i, x in enumerate(labels):
                want[i, x] += w
                if i:
                    joint[i, labels[forest.parent[start + i] - start], x] += w
        assert np.allclose(got[start : start + size], want / z)
        assert np.allclose(pairs[start + 1 : start + size], joint[1:] / z)
        log_z += np.log(z)
    assert np.isclose(total, log_z)


def test_layouts_not_learned_from(model):
    """Blocks of pages in new layouts: held-out accuracy of text blocks."""
    made = Layouts("held out", ["these words stand in no page", "nor do those of this other text, which is a little longer"])
    right = whole = missed = 0
    for _ in range(150):
        own = [("h1", made.words(2, 9)), *[("p", made.words(8, 90)) for _ in range(made.rng.randint(1, 9))]]
        tree, want = dom.parsed(made.page(own)), {" ".join(t.split()) for _, t in own}
        got = set(hx.main_blocks(tree, model))
        whole += len(tree.texts)
        missed += len(want - got)
        right += sum((t in got) == (t in want) for t in tree.texts.values())
    assert right > 0.97 * whole and missed < 0.02 * whole


STORY = ["How the harbour was rebuilt", "The first stones were laid in spring, and by autumn the wall stood two metres high.", "Short.", "Nobody expected that the old pier would hold, but it did, through all of the winter."]
OWN = f"<h1>{STORY[0]}</h1><p>{STORY[1]}</p><p>{STORY[2]}</p><p>{STORY[3]}</p>"
CHATTER = "<p>I lived there as a child and the pier was never safe; my uncle fell from it twice, and nobody cared at all.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<header><a href=/>Site</a></header><nav><a href=/a>A</a> <a href=/b>B</a></nav><article>{OWN}</article><aside><h3>Related</h3><a href=/c>C</a></aside><footer>&copy; 2020 Us</footer>",
        f"<div id=header>Daily</div><div class=menu><ul><li><a href=/x>X</a></li></ul></div><div class='post-content'>{OWN}</div><div class=sidebar>{CHATTER}</div><div id=footer>Legal</div>",
        f"<div class=cookie-banner><p>We use cookies to make this site better for you.</p><button>OK</button></div><main>{OWN}</main><section id=comments><h3>2 comments</h3><div class=comment>{CHATTER}</div><div class=comment>{CHATTER}</div></section>",
        f"<body><div class=wrapper><article class=story>{OWN}<div class=advertisement>Buy two, get one free today</div><form><p>Sign up for our letter</p><input></form><ol class=comment-list><li>{CHATTER}</li></ol></article></div>",
    ],
)
def test_pages_by_hand(model, page):
    assert hx.main_blocks(dom.parsed(page), model) == STORY


def expected(page):
    own = re.search("<article>(.*?)</article>", page, re.S)[1]
    parts = re.split("</?(?:p|h1)>", own)
    return "\n\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", p))).split()) for p in parts) if x)


def test_given_pages(pages, model):
    rows = hx.extract(pages, model).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert r["text"] == expected(r["html"])
        assert r["n_chars"] == len(r["text"])


def test_odd_rows(spark, model, odd_docs, no_docs, passed_through):
    rows = [(1, None, 1), (2, "", 2), (None, "<p", 3), (3, "<p>word</p>" * 30_000, 4), (3, "plain text", 5), (3, "plain text", 6)]
    own = spark.createDataFrame(rows, "page_id long, html string, `TEXT` int")
    out = hx.extract(own, model)
    assert out.columns == ["page_id", "html", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in out.collect())[:2] == [(0, 0), (1, 0)]
    for docs in (odd_docs, no_docs):
        passed_through(hx.extract(docs.withColumnRenamed("text", "html"), model), ("text", "n_chars"), docs.withColumnRenamed("text", "html"))
    nothing = hx.learn(own.filter("page_id = 2"))  # no page tells: layouts of words by chance
    assert hx.main_blocks(dom.parsed(f"<nav><a href=/a>A</a></nav><article>{OWN}</article><footer>Legal</footer>"), nothing) == STORY
