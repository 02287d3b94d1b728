"""Small trees of web pages: block elements and the text blocks in them, from any HTML, in time linear in its length."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

#: Elements nest so deep; what lies deeper is put side by side.
MOST_DEPTH = 512
#: Buckets that tags and words of attributes are hashed into.
BUCKETS = 1 << 13

# Fixed values of HTML: how its elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What they hold is no text of the page; of ``RAW`` nothing but their own end tag is markup.
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp".split())
UNSHOWN = RAW | frozenset("template svg math select button object canvas audio video datalist".split())
#: Elements that run inside a block.
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rb rp rt rtc ruby s samp small span strike strong sub sup
    time tt u var picture map progress meter""".split()
)
CLOSES_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr
    main menu nav ol p pre search section summary table ul""".split()
)
#: An opening tag ends an open element of these, up to one of those.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
TABLE = frozenset("table thead tbody tfoot tr td th".split())

#: Kinds of nodes that share the potentials between them and their parent.
KINDS = {"text": 0, **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), 1), **dict.fromkeys("p pre blockquote".split(), 2), **dict.fromkeys("ul ol li dl dt dd".split(), 3)}
KINDS |= {**dict.fromkeys("div center".split(), 4), **dict.fromkeys("article main section".split(), 5), **dict.fromkeys("nav aside footer header form dialog menu".split(), 6), **dict.fromkeys(TABLE, 7)}
OTHER_KIND = 8

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?>[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
NAMING = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def bucket(feature: str) -> int:
    return crc32(feature.encode()) % BUCKETS


@lru_cache(maxsize=1 << 16)
def features_of(tag: str, attributes: str) -> tuple[int, ...]:
    """Buckets of an element's tag and of the words that name it: class, id and the like, whole and by their first four letters."""
    out = {bucket(f"tag {tag}")}
    for _, value in NAMING.findall(attributes):
        for word in WORDS.findall(value):
            w = word.lower()
            if len(w) > 1:
                out |= {bucket(f"word {w}"), bucket(f"start {w[:4]}")}
    if HIDDEN.search(attributes):
        out.add(bucket("hidden"))
    return tuple(sorted(out))


@lru_cache(maxsize=1 << 10)
def _end_of(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I)


@dataclass
class Tree:
    """Nodes in page order, each after its parent; the first is the page. A text block is a node with a text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    kind: list[int] = field(default_factory=lambda: [OTHER_KIND])
    features: list[tuple[int, ...]] = field(default_factory=lambda: [(bucket("page"),)])
    texts: dict[int, str] = field(default_factory=dict)
    linked: dict[int, int] = field(default_factory=dict)


class _Builder:
    def __init__(self) -> None:
        self.tree = Tree()
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.open: dict[str, int] = {}
        self.run: list[str] = []
        self.linked, self.link = 0, 0

    def text(self, own: str) -> None:
        if "&" in own:
            own = entities.unescape(own)
        self.run.append(own)
        if self.link:
            self.linked += len(own)

    def flush(self) -> None:
        """The run of text so far becomes a block, if it has more than white space."""
        if not self.run:
            return
        text = " ".join("".join(self.run).split())
        if text:
            tree, (tag, at) = self.tree, self.stack[-1]
            above = self.stack[-2][0] if len(self.stack) > 1 else ""
            node = self.add("text", at, _text_features(tag, above))
            tree.texts[node], tree.linked[node] = text, min(self.linked, len(text))
        self.run, self.linked = [], 0

    def add(self, tag: str, parent: int, features: tuple[int, ...]) -> int:
        tree = self.tree
        tree.parent.append(parent)
        tree.depth.append(tree.depth[parent] + 1)
        tree.kind.append(KINDS.get(tag, OTHER_KIND))
        tree.features.append(features)
        return len(tree.parent) - 1

    def pop(self) -> None:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        if self.link > len(self.stack):
            self.link = 0

    def end(self, tag: str, until: tuple[str, ...] = ("td", "th")) -> None:
        """Closes the innermost ``tag`` and what is open in it, unless one of ``until`` lies between."""
        if not self.open.get(tag):
            return
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            if self.stack[at][0] in until:
                return
            at -= 1
        while len(self.stack) > at:
            self.pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self.end("p", ("td", "th", "table"))
        if tag in ENDS:
            ended, within = ENDS[tag]
            for e in ended:
                self.end(e, within)
        if tag in VOID:
            return
        if len(self.stack) > MOST_DEPTH:
            self.pop()
        self.stack.append((tag, self.add(tag, self.stack[-1][1], features_of(tag, attributes))))
        self.open[tag] = self.open.get(tag, 0) + 1


@lru_cache(maxsize=1 << 12)
def _text_features(tag: str, above: str) -> tuple[int, ...]:
    return tuple(sorted({bucket("text"), bucket(f"in {tag}"), bucket(f"within {above} {tag}")}))


def parsed(page: str) -> Tree:
    """The tree of a page. Unclosed and stray tags, unquoted attributes, unknown elements and cut pages are all taken as they come."""
    b, at, unclosed = _Builder(), 0, set()
    while True:
        tag_at = page.find("<", at)
        if tag_at < 0:
            b.text(page[at:])
            break
        if tag_at > at:
            b.text(page[at:tag_at])
        m = TAG.match(page, tag_at)
        if not m:
            if page.startswith("<!--", tag_at):
                end = page.find("-->", tag_at + 4)
                if end < 0:
                    break
                at = end + 3
                continue
            after = page[tag_at + 1 : tag_at + 2]
            if not (after and (after in "!?/" or (after.isascii() and after.isalpha()))):
                b.text("<")
                at = tag_at + 1
                continue
            m = LOOSE_TAG.match(page, tag_at) if after not in "!?" else None
            if not m:
                end = page.find(">", tag_at)
                if end < 0:
                    break
                at = end + 1
                continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in INLINE:
            if tag == "a":
                b.link = 0 if closing else len(b.stack)
            continue
        if tag == "br":
            b.run.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in UNSHOWN:
            if closing or tag in unclosed:
                continue
            end = _end_of(tag).search(page, at)
            if end:
                at = end.end()
            elif tag in RAW:
                break
            else:
                unclosed.add(tag)
            continue
        if closing and not b.open.get(tag):
            continue
        b.flush()
        if closing:
            b.end(tag, () if tag in TABLE else ("td", "th"))
        else:
            b.start(tag, attributes)
    b.flush()
    return b.tree
