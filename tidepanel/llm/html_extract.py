"""Main text of web pages by a tree-structured graphical model over their DOM nodes.

Each block element and each text block is a node with a label: mixed (main text and other things below it), main, or other. Potentials of
a node come from its tag, the words that name it, its length, its place and the share of links below it; potentials between a node and
its parent depend on the kind of the node, and exclude what cannot be (something else below a main node, main text below an other one).
Sum-product messages go upward from the leaves and downward from the page, which gives exact marginals; a text block belongs to the
main text if main is the more probable label. Potentials are fitted by the likelihood of labelled pages, whose gradient is what the same
messages give: observed minus expected counts.

Pages pass through once, in Arrow batches; levels of all trees of a batch are computed together. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import dom, frames
from tidepanel.llm.layouts import Layouts

MIXED, MAIN, OTHER = range(3)
#: Bound of the sample that the model is fitted on: pages, bytes of each (longer ones aren't drawn); and layouts made of them.
SAMPLE_PAGES = 160
SAMPLE_BYTES = 64 << 10
LAYOUTS = 1500
EPOCHS, PAGES_A_STEP, RATE, DECAY = 10, 32, 0.15, 1e-4
#: Label pairs (parent, child) that cannot be, and the log potential of such.
NEVER = -1e4
BARRED = [(MAIN, MIXED), (MAIN, OTHER), (OTHER, MIXED), (OTHER, MAIN)]
BINS = 12
MEASURES = 7
N_FEATURES = dom.BUCKETS + 2 * MEASURES * BINS
N_KINDS = dom.OTHER_KIND + 1


@dataclass
class Model:
    """Log potentials: of features by label, and of label pairs (parent, child) by kind of the child."""

    node: np.ndarray
    edge: np.ndarray

    @classmethod
    def empty(cls) -> Model:
        edge = np.zeros((N_KINDS, 3, 3))
        for a, b in BARRED:
            edge[:, a, b] = NEVER
        return cls(np.zeros((N_FEATURES, 3)), edge)


class Forest:
    """Trees side by side, as arrays over all nodes, level by level."""

    def __init__(self, trees: list[dom.Tree]):
        sizes = np.array([len(t.parent) for t in trees], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.first = starts
        shift = np.repeat(starts, sizes)
        self.parent = np.array([p for t in trees for p in t.parent], dtype=np.int64) + shift
        self.parent[starts] = -1
        self.depth = np.array([d for t in trees for d in t.depth], dtype=np.int64)
        self.kind = np.array([k for t in trees for k in t.kind], dtype=np.int64)
        self.tree = np.repeat(np.arange(len(trees)), sizes)
        by_depth = np.argsort(self.depth, kind="stable")
        self.levels = np.split(by_depth, np.flatnonzero(np.diff(self.depth[by_depth])) + 1) if len(by_depth) else []
        self.leaf = np.zeros(len(shift), dtype=bool)
        chars, linked = np.zeros(len(shift)), np.zeros(len(shift))
        for start, t in zip(starts.tolist(), trees, strict=True):
            for node, text in t.texts.items():
                self.leaf[start + node] = True
                chars[start + node], linked[start + node] = len(text), t.linked[node]
        self._features(trees, chars, linked)

    def _features(self, trees: list[dom.Tree], chars: np.ndarray, linked: np.ndarray) -> None:
        named = [f for t in trees for f in t.features]
        counts = np.array([len(f) for f in named], dtype=np.int64)
        own = np.fromiter((x for f in named for x in f), dtype=np.int64, count=int(counts.sum()))
        before = np.concatenate([[0], np.cumsum(chars)])[:-1]
        before -= before[self.first][self.tree] if len(self.tree) else 0
        blocks = self.leaf.astype(float)
        for level in self.levels[:0:-1]:
            for total in (chars, linked, blocks):
                np.add.at(total, self.parent[level], total[level])
        whole = np.maximum(1, chars[self.first][self.tree]) if len(self.tree) else np.ones(0)
        some = np.maximum(1, chars)
        measures = [
            np.log2(chars + 1) * 0.75,
            np.where(linked > 0, 1 + 10 * linked / some, 0),
            1.2 * -np.log2(some / whole),
            np.log2(chars / np.maximum(1, blocks) + 1),
            before / whole * 11.99,
            (before + chars) / whole * 11.99,
            np.log2(blocks + 1) * 1.5,
        ]
        at = np.stack([np.clip(m, 0, BINS - 1).astype(np.int64) + i * BINS for i, m in enumerate(measures)], axis=1)
        at += dom.BUCKETS + np.where(self.leaf, 0, MEASURES * BINS)[:, None]
        self.feature = np.concatenate([own, at.ravel()])
        self.owner = np.concatenate([np.repeat(np.arange(len(counts)), counts), np.repeat(np.arange(len(counts)), MEASURES)])

    def potentials(self, model: Model) -> np.ndarray:
        n = len(self.parent)
        out = np.stack([np.bincount(self.owner, weights=model.node[self.feature, s], minlength=n) for s in range(3)], axis=1)
        out[self.leaf, MIXED] = NEVER
        return out

    def marginals(self, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
        """Of labels by node, of label pairs (parent, child) by node, and the sum of all log normalisers: messages up, then down."""
        up = self.potentials(model)
        sent = np.zeros_like(up)
        for level in self.levels[:0:-1]:
            sent[level] = _log_sum(model.edge[self.kind[level]] + up[level][:, None, :], 2)
            np.add.at(up, self.parent[level], sent[level])
        total = float(_log_sum(up[self.first], 1).sum())
        full, pairs = up.copy(), np.zeros((len(up), 3, 3))
        for level in self.levels[1:]:
            above = full[self.parent[level]] - sent[level]
            joint = above[:, :, None] + model.edge[self.kind[level]] + up[level][:, None, :]
            full[level] = _log_sum(joint, 1)
            norm = _log_sum(full[level], 1)
            pairs[level] = np.exp(joint - norm[:, None, None])
            full[level] -= norm[:, None]
        return np.exp(full - _log_sum(full, 1)[:, None]), pairs, total

    def labels(self, main: np.ndarray) -> np.ndarray:
        """Label of every node, from whether each text block is main text; a node without any is other."""
        has = np.stack([self.leaf & main, self.leaf & ~main], axis=1)
        for level in self.levels[:0:-1]:
            np.logical_or.at(has, self.parent[level], has[level])
        return np.where(has.all(axis=1), MIXED, np.where(has[:, 0], MAIN, OTHER))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis)
    return most + np.log(np.exp(x - np.expand_dims(most, axis)).sum(axis=axis))


def fit(examples: list[tuple[dom.Tree, set[str]]], epochs: int = EPOCHS) -> Model:
    """Potentials of greatest likelihood (with a little decay) of trees and the texts of their main blocks, by adaptive gradient steps."""
    model, seen_node, seen_edge = Model.empty(), np.full((N_FEATURES, 3), 1e-8), np.full((N_KINDS, 3, 3), 1e-8)
    steps = []
    for at in range(0, len(examples), PAGES_A_STEP):
        own = examples[at : at + PAGES_A_STEP]
        forest = Forest([t for t, _ in own])
        main = np.zeros(len(forest.parent), dtype=bool)
        for start, (tree, texts) in zip(forest.first.tolist(), own, strict=True):
            main[[start + node for node, text in tree.texts.items() if text in texts]] = True
        steps.append((forest, forest.labels(main), len(own)))
    open_edge = model.edge > NEVER / 2
    for _ in range(epochs):
        for forest, labels, n in steps:
            beliefs, pairs, _ = forest.marginals(model)
            wrong = -beliefs
            wrong[np.arange(len(labels)), labels] += 1
            node = np.stack([np.bincount(forest.feature, weights=wrong[forest.owner, s], minlength=N_FEATURES) for s in range(3)], axis=1) / n - DECAY * model.node
            below = forest.parent >= 0
            observed = np.zeros_like(pairs)
            observed[np.flatnonzero(below), labels[forest.parent[below]], labels[below]] = 1
            edge = np.zeros_like(model.edge)
            np.add.at(edge, forest.kind, (observed - pairs) / n)
            seen_node += node**2
            seen_edge += edge**2
            model.node += RATE * node / np.sqrt(seen_node)
            model.edge += np.where(open_edge, RATE * edge / np.sqrt(seen_edge), 0)
    return model


def main_blocks(tree: dom.Tree, model: Model) -> list[str]:
    return _chosen([tree], model)[0]


def _chosen(trees: list[dom.Tree], model: Model) -> list[list[str]]:
    if not trees:
        return []
    forest = Forest(trees)
    main = forest.marginals(model)[0][:, MAIN]
    return [[text for node, text in t.texts.items() if main[start + node] > 0.5] for start, t in zip(forest.first.tolist(), trees, strict=True)]


def marked_main(tree: dom.Tree) -> list[tuple[str, str]] | None:
    """Tag and text of the blocks in a page's one ``article`` element (or ``main``, where there is no article), without menus, asides, footers, forms and what lies in their like; None where the markup doesn't tell."""
    tags = {t: dom.bucket(f"tag {t}") for t in ("article", "main", "nav", "aside", "footer", "form", "header", "h1", "h2", "h3", "pre", "blockquote", "p")}
    for tag in ("article", "main"):
        own = [i for i, f in enumerate(tree.features) if tags[tag] in f and i not in tree.texts]
        if len(own) == 1:
            break
    else:
        return None
    inside, dropped = set(own), {tags[t] for t in ("nav", "aside", "footer", "form")}
    for i in range(own[0] + 1, len(tree.parent)):
        if tree.parent[i] in inside and not dropped & set(tree.features[i]):
            inside.add(i)
    named = {dom.bucket(f"in {t}"): t for t in ("h1", "h2", "h3", "pre", "blockquote", "p")}
    return [(next((named[f] for f in tree.features[i] if f in named), "p"), text) for i, text in tree.texts.items() if i in inside]


def learn(pages: DataFrame, key: str = "page_id", html: str = "html") -> Model:
    """A model from the pages whose markup labels them, and from new layouts of their blocks.

    A bounded sample is drawn by hash of key and page: ``SAMPLE_PAGES`` of up to ``SAMPLE_BYTES`` that have an article or main element. It
    is learned from as it is, and ``LAYOUTS`` pages are made from it. Where the table has none, these are made of words by chance.
    """
    own = frames.column(html)
    tells = own.rlike("(?i)<(article|main)[\\s>]") & (F.octet_length(own) <= SAMPLE_BYTES)
    hashed = pages.filter(tells).select(own.alias("html"), F.xxhash64(frames.column(key), own).alias("hash"))
    share, drawn = min(1.0, 2 * SAMPLE_PAGES / max(1, pages.count())), []
    while True:
        # a share of all hashes first: each task sends its own candidates to the driver, so these must not grow with the tasks
        within = hashed.filter(F.shiftrightunsigned("hash", 40) < int(share * (1 << 24)))
        drawn = within.orderBy(F.shiftrightunsigned("hash", 40), "hash", "html").limit(SAMPLE_PAGES).collect()
        if len(drawn) == SAMPLE_PAGES or share == 1.0:
            break
        share = min(1.0, share * 16)
    trees = [(t, m) for t in (dom.parsed(r["html"]) for r in drawn) if (m := marked_main(t))]
    pool = [text for _, blocks in trees for _, text in blocks]
    made = Layouts("layouts", pool)
    examples = [(t, {text for _, text in m}) for t, m in trees]
    for i in range(LAYOUTS):
        blocks = trees[i % len(trees)][1] if trees else [("h1", made.words(2, 9)), *[("p", made.words(3, 90)) for _ in range(made.rng.randint(1, 9))]]
        # paragraphs of other pages as well: short and long pages, and texts that stand in comments elsewhere
        if made.rng.random() < 0.5:
            blocks = [*blocks[: made.rng.randint(1, 6)], *[("p", made.words(2, 90)) for _ in range(made.rng.randint(0, 6))]]
        blocks = [(tag, " ".join(text.split())) for tag, text in blocks if text.strip()]
        tree = dom.parsed(made.page(blocks))
        examples.append((tree, {text for _, text in blocks}))
    made.rng.shuffle(examples)
    return fit(examples)


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """``pages`` with text (the blocks of the main text in page order, joined by two line feeds; empty if none) and n_chars (long, its code points).

    Of the whole html; character references are decoded, white space of any kind inside a block (and a line break element) becomes one space, blocks are
    trimmed. Text in scripts, styles, other elements that show none, comments and tags is no text. A null or empty page has an empty text,
    and so has one without main text; broken or cut markup is read as far as it goes, an element that never ends included. Elements deeper
    than ``dom.MOST_DEPTH`` are taken to stand side by side. Repeated pages are treated alike; an empty table gives an empty table. A page
    takes memory in proportion to its length and nodes. Columns of the new names, in any case, are replaced; others pass through.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model.node, model.edge))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for whole in batches:
            for batch in frames.pieces(whole, "html"):
                texts = ["\n\n".join(b) for b in _chosen([dom.parsed(x or "") for x in batch.column("html").to_pylist()], own)]
                yield frames.replaced(batch, {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return frames.applied(pages, extracted, {"html": html}, {"text": "string", "n_chars": "long"})
