import hashlib
import random
import re

import numpy as np

from tidepanel.llm import secret_scan as ss


def brute(text):
    """The base rules as stated, matched in full and then dropped if too short."""
    kinds = [("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    return [(s, e, name) for s, _, e, name in sorted(found)]


HEX40 = hashlib.sha1(b"x").hexdigest()
TEXTS = [
    None, "", "token:secret:password123", "token=secret=abcdefgh", f'Password = "{HEX40}" rest', f"é漢 API_KEY: '{HEX40}'", "apikey=short", "AKIA" + "A" * 11, "AKIA" + "A" * 12, "AKIAAKIAAKIAAKIA1x",
    "f" * 31, "f" * 32, "g" + "f" * 33 + "g", f"passwd: {HEX40}{HEX40} token={HEX40}", "secret" + " " * 5 + ":" + "b" * 70, "TOKEN='aB3/x+Y9=_.-'", "tokens are = none", "password=\nabcdefghij",
]


def test_base_spans_against_brute_force():
    for t in TEXTS:
        assert ss.base_spans(t or "") == brute(t), t
    random.seed(4)
    parts = ["token", "secret", "=", ":", " ", '"', "'", "abcdef12", HEX40, "AKIA", "Z9" * 7, "é", "\n", "api_key", "passwd", "."]
    for _ in range(3000):
        t = "".join(random.choice(parts) for _ in range(random.randint(1, 14)))
        assert ss.base_spans(t) == brute(t), t


def test_automata_tell_formats_apart():
    random.seed(1)
    draw = lambda alphabet, n: "".join(random.choice(alphabet) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys, words = [draw(mixed, 24) for _ in range(600)], ["-".join(draw("aeioulnrst", 5) for _ in range(4)) + "1" for _ in range(600)]
    credential, ordinary = ss.infer(keys[:300]), ss.infer(words[:300])
    score = lambda x: ss.likelihoods(x, credential) - ss.likelihoods(x, ordinary)
    assert (score(keys[300:]) > ss.LEAST_SCORE).mean() > 0.95
    assert (score(words[300:]) > ss.LEAST_SCORE).mean() < 0.01
    step, log = credential
    assert len(step) < 200 and np.allclose(np.exp(log).sum(axis=1), 1)


def test_automata_know_lengths_and_positions():
    """Few digests of 32 make a chain that knows where they end, and keys that begin alike keep their beginning: one state could do neither."""
    random.seed(4)
    draw = lambda alphabet, n: "".join(random.choice(alphabet) for _ in range(n))
    own = ss.infer([draw("0123456789abcdef", 32) for _ in range(40)])
    assert len(own[0]) - 1 >= 33
    right, short, long = (ss.likelihoods([draw("0123456789abcdef", n) for _ in range(50)], own) for n in (32, 27, 40))
    assert right.mean() > short.max() and right.mean() > long.max() and (right > short.max()).mean() > 0.9
    step, log = ss.infer(["AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16) for _ in range(60)])
    good = ss.likelihoods(["AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16) for _ in range(50)], (step, log))
    assert good.mean() > ss.likelihoods([draw("0123456789", 4) + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16) for _ in range(50)], (step, log)).max()
    assert len(step) > 10
    loop = ss.infer([draw("abcdef", 1 + int(random.expovariate(0.1))) for _ in range(400)])
    assert len(loop[0]) < 8  # where position doesn't matter, states become loops


def test_automata_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    automata = ss.learn(docs)
    assert all(len(step) - 1 > 1 for kind, (step, _) in automata.items() if kind != "token")


def test_merging_keeps_what_differs():
    # strings of letters of length 3 only, against strings of digits of any length: the start must not merge with what follows a letter
    step, log = ss.infer(["abc"] * 200 + ["1" * n for n in range(1, 60) for _ in range(5)])
    length3 = ss.likelihoods(["abc", "abcabc"], (step, log))
    assert length3[0] > length3[1]


def test_cut_tokens_are_still_running():
    """Tokens longer than the tree is deep give no ends at its bottom: their automaton has no bound on lengths."""
    step, log = ss.infer(["a" * 500] * 300 + ["a1" * 40] * 300)
    ends = np.exp(log[:-1, ss.END])
    assert ends.max() < 0.2
    assert ss.likelihoods(["a" * 300], (step, log))[0] > -0.9


def test_many_spans_take_one_pass():
    import time

    text = "token=abcdefgh1 x9y8z7w6v5 " * 40_000
    spans = ss.base_spans(text)
    began = time.process_time()
    assert len(ss.tokens_of(text, spans)) == len(spans) == 40_000
    assert time.process_time() - began < 5
    overlapping = [(0, 30, "assign"), (5, 10, "access"), (12, 14, "hex"), (40, 60, "hex")]
    words = "a1" * 6 + " " * 3 + "b2" * 6 + " " * 3 + "c3" * 4 + " " * 12 + "d4" * 5
    assert ss.tokens_of(words, overlapping) == [(30, 38)]


def labelled_texts(n, seed):
    """Texts of words, names and numbers; a third holds a credential in an assignment, a tenth one of a format that no rule knows."""
    rng = random.Random(seed)
    draw = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    ordinary = [
        lambda: draw("aeioulnrst", rng.randint(2, 9)), lambda: draw("aeioulnrst", 5) + draw("0123456789", 2), lambda: f"{draw('aeioulnrst', 6)}-{draw('aeioulnrst', 7)}-{rng.randint(1, 99)}",
        lambda: f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: draw("0123456789", rng.randint(1, 7)), lambda: f"/usr/{draw('aeioulnrst', 4)}/{draw('aeioulnrst', 6)}{rng.randint(1, 9)}", lambda: "internationalisation",
        lambda: f"version_{rng.randint(1, 30)}_{draw('aeioulnrst', 5)}",
    ]
    unseen = [lambda: "ghx_" + draw(mixed, 36), lambda: draw(mixed, 20) + "-" + draw(mixed, 12), lambda: draw(mixed + "+/", 43) + "=", lambda: "sk-" + draw(mixed, 28)]
    out = []
    for i in range(n):
        words = [rng.choice(ordinary)() for _ in range(40)]
        if i % 3 == 0:
            words[7] = f"{rng.choice(['password', 'api_key', 'token'])}={draw(mixed, rng.choice([20, 24, 32, 40]))}"
        secret = rng.choice(unseen)() if i % 10 == 0 else None
        if secret:
            words[20] = secret
        text = " ".join(words)
        out.append((i, text, (text.index(secret), text.index(secret) + len(secret)) if secret else None))
    return out


def test_added_spans_on_a_labelled_split(spark):
    """Learned on one half; on the other, formats that no rule knows are found, and little else: switched off, nothing would be."""
    rows = labelled_texts(1200, 3)
    frame = lambda own: spark.createDataFrame([(i, t) for i, t, _ in own], "doc_id long, text string")
    automata = ss.learn(frame(rows[:600]))
    truth = {i: s for i, _, s in rows[600:]}
    found = ss.scan(frame(rows[600:]), automata).collect()
    added = {(r["doc_id"], s["start"], s["end"]) for r in found for s in r["secrets"] if s["kind"] == "format"}
    planted = {(i, *s) for i, s in truth.items() if s}
    recall, precision = len(added & planted) / len(planted), len(added & planted) / max(1, len(added))
    print(f"format spans: precision {precision:.3f}, recall {recall:.3f} of {len(planted)}")
    assert recall > 0.9 and precision > 0.9
    base = [s["score"] for r in found for s in r["secrets"] if s["kind"] == "assign"]
    assert len(base) == 200 and min(base) > ss.LEAST_SCORE / 2  # what the rules find is scored too
    assert not any(s["kind"] == "format" for r in ss.scan(frame(rows[600:]), None).collect() for s in r["secrets"])


def test_scan(spark, odd_docs, no_docs, passed_through):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["secrets"]] for r in ss.scan(docs, ss.learn(docs)).collect()}
    for i, t in enumerate(TEXTS):
        assert [x for x in got[i] if x[2] != "format"] == brute(t)
    out = ss.scan(odd_docs, ss.learn(odd_docs))
    passed_through(out, ("secrets",))
    assert ss.scan(no_docs, ss.learn(no_docs)).count() == 0 and ss.learn(no_docs) == {}
