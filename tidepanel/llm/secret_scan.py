"""Secret scans: base rules, and automata inferred from labelled credentials.

The base rules find assignments, access keys and hex digests. Their matches are labelled credentials of three formats; from a bounded
sample of them a prefix tree of character classes is built for each format, and states whose frequencies of ending and of each class
are statistically compatible are merged into a probabilistic automaton. Compatible means that one Dirichlet-multinomial explains the counts of both
better than two do: a test that needs few tokens to tell states apart. States at the same depth are merged first, so that each position has the
tokens of all paths as evidence; then states of different depths, with all that follows, which makes loops where position doesn't matter and keeps
a chain, which knows its length, where it does. A further automaton is learned from tokens that no rule matched. Candidates are what the base rules match
and all other tokens that might be credentials (see ``CANDIDATE``). A candidate's format likelihood is the best log-likelihood per character
under the credential automata less that of the ordinary tokens. Every candidate is scored; where the likelihood of one that no rule
matched is high enough, a span of kind ``format`` is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames

#: The base rules. A value of 8 characters or more makes an assignment (shorter ones use up their match), 16 an access key,
#: 32 a digest; runs are taken whole, so a length in the pattern drops what is shorter.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "format")
LEAST_VALUE = 8
#: Tokens are whole runs of these characters; a candidate has 8 of them or more with a letter and a digit among them, or 16 or more of any kind.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:(?=[+/_=-]*+[A-Za-z][A-Za-z+/_=-]*+[0-9]|[+/_=-]*+[0-9][0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{8,}|[A-Za-z0-9+/_=-]{16,})")
#: Labelled credentials of a format, and ordinary tokens, that the automata learn from, about: the bound of the sample.
SAMPLE = 2_000
#: Characters of a token that the automata read while learning, so that one long token doesn't make a deep tree: a longer one counts as still
#: running there, neither ended nor going on. Scoring reads all.
DEPTH = 64
#: The prior count of each outcome at a state, and the log odds against a merger that no pair of states may exceed.
PRIOR = 0.2
LEAST_ODDS = -3.0
#: The score a character, and in all, from which a token is taken for a secret.
LEAST_SCORE = 0.2
LEAST_EVIDENCE = 7.0

#: Classes of characters: A-F, G-Z, a-f, g-z, digits, underscore, hyphen, others.
CLASSES = 8
END = CLASSES
CLASS_OF = np.full(256, 7, dtype=np.int8)
for _class, _members in enumerate(("ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "abcdef", "ghijklmnopqrstuvwxyz", "0123456789", "_", "-")):
    CLASS_OF[[ord(c) for c in _members]] = _class


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules in code points, by start and then by kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def classes_of(token: str) -> list[int]:
    return CLASS_OF[np.frombuffer(token.encode("latin-1", "replace"), dtype=np.uint8)].tolist()


def _evidence(counts: np.ndarray) -> np.ndarray:
    """Log-probability of sequences with these counts (last axis) under a Dirichlet-multinomial with ``PRIOR`` for each outcome."""
    k = counts.shape[-1]
    gamma = np.vectorize(lgamma, otypes=[float])
    return gamma(k * PRIOR) - gamma(counts.sum(axis=-1) + k * PRIOR) + (gamma(counts + PRIOR) - gamma(PRIOR)).sum(axis=-1)


class Inference:
    """Merging of compatible states of a prefix tree: ``counts[state]`` by class or END (strings cut there count nowhere), ``next[state]`` by class."""

    def __init__(self, strings: list[list[int]], depth: int = DEPTH):
        self.counts: list[np.ndarray] = []
        self.next: list[dict[int, int]] = []
        layer = [np.arange(len(strings))]
        # what each string does at each depth: a class, its end, or nothing known beyond the cut
        acts = np.full((len(strings), depth + 2), -1, dtype=np.int64)
        for i, s in enumerate(strings):
            acts[i, : min(len(s), depth)] = s[:depth]
            if len(s) <= depth:
                acts[i, len(s)] = END
        parents: list[list[tuple[int, int]]] = [[]]
        for d in range(depth + 1):
            kept: list[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]] = []
            for rows, above in sorted(zip(layer, parents, strict=True), key=lambda x: -len(x[0])):
                own = np.bincount(acts[rows, d][acts[rows, d] >= 0], minlength=CLASSES + 1)
                odds = [self.odds(k[1], own) for k in kept]
                best = int(np.argmax(odds)) if odds else -1
                if best >= 0 and odds[best] > 0:
                    kept[best] = (np.concatenate([kept[best][0], rows]), kept[best][1] + own, kept[best][2] + above)
                else:
                    kept.append((rows, own, list(above)))
            layer, parents = [], []
            for rows, own, above in kept:
                state = len(self.counts)
                self.counts.append(own)
                self.next.append({})
                for parent, c in above:
                    self.next[parent][c] = state
                for c in np.flatnonzero(own[:CLASSES]).tolist():
                    layer.append(rows[acts[rows, d] == c])
                    parents.append([(state, c)])
            if not layer:
                break

    @staticmethod
    def odds(a: np.ndarray, b: np.ndarray) -> float:
        """The log odds that both counts are of one state."""
        return float(_evidence(a + b) - _evidence(a) - _evidence(b))

    def folded(self, into: int, of: int) -> dict[int, int] | None:
        """The states that become one with others if ``of`` becomes ``into``, what follows them included; None if that explains the strings worse."""
        one: dict[int, int] = {}

        def root(x: int) -> int:
            while x in one:
                x = one[x]
            return x

        counts, following, gained, todo = {}, {}, 0.0, [(into, of)]
        while todo:
            p, q = (root(x) for x in todo.pop())
            if p == q:
                continue
            p, q = min(p, q), max(p, q)
            own = [counts.get(x, self.counts[x]) for x in (p, q)]
            odds = self.odds(*own)
            gained += odds
            if odds < LEAST_ODDS:
                return None
            one[q], counts[p] = p, own[0] + own[1]
            after = dict(following.get(p, self.next[p]))
            for c, x in following.get(q, self.next[q]).items():
                if c in after:
                    todo.append((after[c], x))
                else:
                    after[c] = x
            following[p] = after
        return {x: root(x) for x in one} if gained > 0 else None

    def fold(self, one: dict[int, int]) -> None:
        for x, r in one.items():
            self.counts[r] = self.counts[r] + self.counts[x]
            for c, y in self.next[x].items():
                self.next[r].setdefault(c, y)
        for own in self.next:
            for c, y in own.items():
                own[c] = one.get(y, y)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """``step``[state, class] and ``log``[state, class or END]: the automaton.

        A state's frequencies are smoothed by three strings that do as all training strings do on the whole; the last state, for what was
        never seen, does so too: what is unlike a format anywhere stays unlikely on unseen ground.
        """
        every = sum(self.counts, np.zeros(CLASSES + 1)) + 0.5
        every = every / every.sum()
        red: list[int] = []
        gone: set[int] = set()
        for blue in range(len(self.counts)):
            if blue in gone:
                continue
            one = next((found for r in reversed(red) if (found := self.folded(r, blue))), None)
            if one is None:
                red.append(blue)
            else:
                self.fold(one)
                gone |= one.keys()
                red = [r for r in red if r not in gone]
        rank = {r: i for i, r in enumerate(red)}
        n = len(red)
        step, log = np.full((n + 1, CLASSES), n, dtype=np.int32), np.zeros((n + 1, CLASSES + 1))
        log[n] = np.log(every)
        for i, r in enumerate(red):
            for c, x in self.next[r].items():
                step[i, c] = rank[x]
            counts = self.counts[r] + 3 * every
            log[i] = np.log(counts / counts.sum())
        return step, log


def infer(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The automaton of some tokens; of those longer than ``DEPTH`` one character more is enough."""
    return Inference([classes_of(t) for t in sorted(tokens)]).merged()


def likelihoods(tokens: list[str], automaton: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log-likelihood per character of each token with its end, stepped side by side, longest first."""
    step, log = automaton
    sizes = np.array([len(t) for t in tokens])
    order = np.argsort(-sizes, kind="stable")
    data = CLASS_OF[np.frombuffer("".join(tokens).encode("latin-1", "replace"), dtype=np.uint8)].astype(np.int64)
    starts = (np.cumsum(sizes) - sizes)[order]
    state, total = np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens))
    alive = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), side="right")
    for k, m in enumerate(alive):
        c = data[starts[:m] + k]
        total[:m] += log[state[:m], c]
        state[:m] = step[state[:m], c]
    out = np.zeros(len(tokens))
    out[order] = (total + log[state, END]) / (sizes[order] + 1)
    return out


def tokens_of(text: str, spans: list[tuple]) -> list[tuple[int, int]]:
    """Candidates that no base span touches; spans are sorted by their starts, so one pass over both is enough."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach, at = max(reach, spans[at][1]), at + 1
        if reach <= m.start():
            out.append((m.start(), m.end()))
    return out


def credential(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """Where the credential itself stands in a span: the value of an assignment, else the whole."""
    return ASSIGN.match(text, start).span(1) if kind == "assign" else (start, end)


def scores(tokens: list[str], automata: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The format likelihood of each token: per character, the best under the credential automata less that of ordinary tokens (without any, of even odds)."""
    if not tokens:
        return np.zeros(0)
    plain = likelihoods(tokens, automata["token"]) if "token" in automata else np.full(len(tokens), -np.log(CLASSES + 1))
    return np.max([likelihoods(tokens, a) for k, a in automata.items() if k != "token"], axis=0) - plain


def _labelled(docs: DataFrame, text: str) -> DataFrame:
    """kind, token: the credentials that the base rules match, and every token (kind ``token``) that they don't."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in frames.pieces(whole, text):
                kinds, tokens = [], []
                for t in batch.column(text).to_pylist():
                    spans = base_spans(t or "")
                    own = {(k, t[slice(*credential(t, s, e, k))]) for s, e, k in spans}
                    own |= {("token", t[s:e]) for s, e in tokens_of(t or "", spans)}
                    for k, x in own:
                        kinds.append(k)
                        tokens.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(tokens, pa.string())], ["kind", "token"])

    return frames.bounded_batches(docs).select(text).mapInArrow(found, "kind string, token string")


def learn(docs: DataFrame, text: str = "text", most: int = SAMPLE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The automata by kind, from about ``most`` distinct tokens a kind that are chosen by a hash; a kind without tokens has none.

    The driver gets ``most`` * 4 tokens of ``DEPTH`` + 1 characters, whatever the table's size.
    """
    tokens = frames.staged(_labelled(docs, text).distinct(), "tokens")
    counts = {r["kind"]: r["count"] for r in tokens.groupBy("kind").count().collect()}
    if not counts:
        return {}
    at = F.xxhash64("token").cast("double") / 2.0**64 + 0.5
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, most / n)]), F.col("kind"))
    by: dict[str, list[str]] = {}
    for r in tokens.filter(at < share).select("kind", F.substring("token", 1, DEPTH + 1).alias("token")).collect():
        by.setdefault(r["kind"], []).append(r["token"])
    frames.discard(tokens)
    return {k: infer(v) for k, v in sorted(by.items())}


def scan(docs: DataFrame, automata: dict[str, tuple[np.ndarray, np.ndarray]] | None, text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with ``secrets`` added: array of (start, end, kind, score), by start and then kind as listed in ``KINDS``.

    Places are code points of the whole text, end exclusive. Base spans are those of the rules, whatever the automata say; ``score`` is the
    format likelihood of what they hold (of an assignment its value), null without automata of credentials. ``format`` spans are other
    candidates with a score of ``least_score`` a character or more and of ``LEAST_EVIDENCE`` or more in all, that is times the characters
    and the end; without automata there are none. A null or empty text has no spans. Texts and tokens may be of any length; repeated rows
    are scanned alike; an empty table gives an empty table. A column named secrets, in any case, is replaced; others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automata or {})
    kind = "array<struct<start:int,end:int,kind:string,score:double>>"
    own_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in frames.pieces(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                spans = [base_spans(t) for t in texts]
                if any(k != "token" for k in own):
                    spans = with_scores(texts, spans, own)
                rows = [[dict(zip(("start", "end", "kind", "score"), (*s, None), strict=False)) for s in x] for x in spans]
                yield frames.replaced(batch, {"secrets": pa.array(rows, own_type)})

    def with_scores(texts: list[str], spans: list[list[tuple]], own: dict) -> list[list[tuple]]:
        places = [(i, *s) for i, t in enumerate(texts) for s in [*spans[i], *((*x, "format") for x in tokens_of(t, spans[i]))]]
        parts = [credential(texts[i], s, e, k) for i, s, e, k in places]
        tokens = [texts[i][s:e] for (i, *_), (s, e) in zip(places, parts, strict=True)]
        out: list[list[tuple]] = [[] for _ in texts]
        for (i, s, e, k), score, token in zip(places, scores(tokens, own).tolist(), tokens, strict=True):
            if k != "format" or score >= least_score and score * (len(token) + 1) >= LEAST_EVIDENCE:
                out[i].append((s, e, k, score))
        return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in out]

    return frames.applied(docs, scanned, {"text": text}, {"secrets": kind})
