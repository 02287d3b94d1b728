"""Quality rules with verdicts for hosts.

Rules are counted for every document; failures are summed by host (here a document's source), the failure rates of hosts are shrunk
towards the corpus with a beta prior that is fitted to all hosts' rates by moments, and a host takes all its documents with it where its
posterior lies above what the prior leads one to expect: see ``host_verdicts``.

DataFrame functions only; whole texts. A host is one row in a table of sums (pre-aggregated in each task), so it may hold any share of
the rows, and its verdict comes back by a join that Spark can broadcast or split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A host falls whose rate is surely (so many posterior deviations) above this multiple of the prior's mean, or above this rate.
MAX_RATIO, MAX_RATE, DEVIATIONS = 2.0, 0.5, 2.0
#: Documents that the prior may weigh, least and most; the most where hosts don't differ beyond chance.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(frames.WORD_CLASS), F.lit(0))


def _window_hashes(tokens: str) -> Column:
    """A 64-bit hash of each window of five words, in order."""
    return F.expr(
        f"CASE WHEN size({tokens}) >= {WINDOW} THEN transform(sequence(0, size({tokens}) - {WINDOW}), i -> xxhash64("
        + ", ".join(f"{tokens}[i + {k}]" for k in range(WINDOW))
        + ")) ELSE cast(array() AS array<bigint>) END"
    )


def _repeated_words(windows: str) -> Column:
    """Words that lie in a window that stands twice or more.

    Texts without a repeated window, nearly all, are told by a distinct count. Else windows are sorted with their places; the places of
    equal neighbours, sorted, cover five words each, less what the place before has covered.
    """
    return F.expr(f"""
        CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE aggregate(
          array_sort(aggregate(
            array(sort_array(transform({windows}, (h, i) -> named_struct('h', h, 'i', i)))),
            cast(array() AS array<int>),
            (_, s) -> filter(transform(s, (x, k) -> CASE WHEN (k > 0 AND s[k - 1].h = x.h) OR (k + 1 < size(s) AND s[k + 1].h = x.h) THEN x.i END), v -> v IS NOT NULL))),
          named_struct('n', 0L, 'last', -{WINDOW}),
          (acc, i) -> named_struct('n', acc.n + least({WINDOW}, i - acc.last), 'last', i),
          acc -> acc.n) END""")


def _counted(docs: DataFrame, text: str, without: tuple[str, ...], **more: Column) -> DataFrame:
    """row (the columns of ``docs`` but those that are ``without``), the counts, and what ``more`` names."""
    own = docs.select(frames.packed(docs, without).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[c.alias(k) for k, c in more.items()])
    own = own.withColumn("tokens", _tokens(F.col("text")))
    own = own.withColumn("windows", _window_hashes("tokens"))
    own = own.withColumn("lines", F.expr(r"filter(split(text, '\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"))
    return own.select(
        "row",
        *more,
        F.size("tokens").cast("long").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words("windows").alias("n_repeat_words"),
    )


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) added; columns of these names are replaced, others pass through."""
    return _counted(docs, text, COUNTS).select("row.*", *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def host_sums(rows: DataFrame) -> DataFrame:
    """host, n_docs, n_failed (staged) from rows of ``host`` and ``failed``."""
    return frames.staged(rows.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed")), "hosts")


def host_verdicts(hosts: DataFrame, max_ratio: float = MAX_RATIO, max_rate: float = MAX_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), host_kept, from ``host_sums``.

    The beta prior has the mean of hosts' raw rates, hosts weighing alike, and the variance of these rates less what chance alone gives
    (the mean of mean * (1 - mean) / documents); its strength, mean * (1 - mean) / variance - 1, is 1 to 1,000,000 documents, and the
    most where no variance is left, so hosts that differ by chance alone share one rate. A host's posterior rate is ``rate``; the host
    falls if that, less ``deviations`` standard deviations of the posterior, is above ``max_ratio`` times the prior's mean or above
    ``max_rate``, whichever is less. A null host is a host like any other; a host of one document is hardly ever sure to be bad.
    """
    raw = F.col("n_failed") / F.col("n_docs")
    mean, var, each = hosts.agg(F.avg(raw), F.var_pop(raw), F.avg(1 / F.col("n_docs"))).first()
    mean = mean or 0.0
    beyond = (var or 0.0) - mean * (1 - mean) * (each or 0.0)
    strength = min(max(mean * (1 - mean) / beyond - 1, LEAST_STRENGTH), MOST_STRENGTH) if beyond > 0 else MOST_STRENGTH
    n = F.col("n_docs") + F.lit(strength)
    rate = (F.col("n_failed") + F.lit(mean * strength)) / n
    surely = F.col("rate") - F.lit(deviations) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (n + 1))
    return hosts.withColumn("rate", rate).select("host", "n_docs", "n_failed", "rate", (surely <= F.lit(min(max_rate, max_ratio * mean))).alias("host_kept"))


def _verdicts(rows: DataFrame, hosts: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Adds host_rate and kept to rows of host and base_failed."""
    own = host_verdicts(hosts, **limits).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "host_kept")
    out = rows.join(own, F.col("host").eqNullSafe(F.col("_host")))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("_host", "host_kept")


def judged(docs: DataFrame, host: str = "source", text: str = "text", **limits: float) -> DataFrame:
    """``docs`` with the rule counts, ``base_failed``, ``host_rate`` and ``kept``.

    ``base_failed``: fewer than ten words, or more than a fifth of the words lie in five-word windows found twice or more in the text.
    ``kept``: the document hasn't failed, and neither has its host (see ``host_verdicts``, whose limits may be given). A null or empty
    text has no words and fails. Repeated rows count each; an empty table gives an empty table. Columns of the added names, in any case,
    are replaced; others pass through, whatever they are called.

    Two passes over the texts: the first keeps only the sums by host, so no text is written or moved.
    """
    added = (*COUNTS, "base_failed", "host_rate", "kept")
    counted = _counted(docs, text, added, host=F.col(host)).withColumn("base_failed", base_failed())
    hosts = host_sums(counted.select("host", F.col("base_failed").alias("failed")))
    return _verdicts(counted, hosts, limits).select("row.*", *added)


def with_verdicts(counted: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """``host_rate`` and ``kept`` added to rows of a host and ``base_failed`` (that is, to counts without their texts, which may be staged)."""
    own = counted.select(frames.packed(counted, ("base_failed", "host_rate", "kept")).alias("row"), F.col(host).alias("host"), "base_failed")
    hosts = host_sums(own.select("host", F.col("base_failed").alias("failed")))
    return _verdicts(own, hosts, limits).select("row.*", "base_failed", "host_rate", "kept")
