"""URL filters: rules first, then gradient-boosted trees on lexical features.

URLs that a rule fits have its verdict and are the labelled URLs; the trees learn from a bounded sample of them and judge the rest by
length, depth, digit ratio, entropy, counts of parameters, and statistics of suffixes (how often labelled URLs that share the host's
last one or two labels, or the path's ending, are blocked). The statistics count all labelled URLs, not the sample; a labelled URL's
own label is left out of the rates that the trees learn from.

DataFrame functions and the DataFrame-based trees of Spark ML only; no row is seen by Python.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs that the trees learn from, about: the bound of the sample.
SAMPLE_URLS = 20_000
TREES, DEPTH = 12, 4
#: URLs that a suffix is taken to have had before any was seen, at the overall rate.
PRIOR_URLS = 20.0
#: Suffixes that are broadcast, those with the most URLs, and characters of one (no host is longer). The others' rates come by a join.
MOST_SUFFIXES, SUFFIX_CHARS = 1 << 16, 255
SUFFIXES = {"last_label": "one", "last_labels": "two", "ending": "end"}
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params", "has_fragment", "one_rate", "one_seen", "two_rate", "two_seen", "end_rate", "end_seen"]


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (``host/path``) that fits, else null; of equally long ones the first given."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    out = F.lit(None).cast("string")
    for _, rule in reversed(ordered):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical(pages: DataFrame, url: str) -> DataFrame:
    """Adds the features that come from the URL alone, and the suffixes, as columns with a leading ``_``."""
    text = F.coalesce(F.col(url), F.lit(""))
    out = pages.withColumns({"_url": text, "_params": F.regexp_extract(text, r"\?([^#]*)", 1)})
    counts = F.expr("transform(array_distinct(split(_url, '')), c -> (length(_url) - length(replace(_url, c, ''))) / length(_url))")
    ending = F.when(F.col("path").endswith("/"), F.lit("/")).otherwise(F.concat(F.lit("."), F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)))
    return out.withColumns(
        {
            "_length": F.length("_url"),
            "_host_length": F.length("host"),
            "_path_length": F.length("path"),
            "_depth": F.regexp_count("path", F.lit("/[^/]")),
            "_labels": F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))),
            "_digit_ratio": F.when(F.length("_url") > 0, F.regexp_count("_url", F.lit("[0-9]")) / F.length("_url")).otherwise(0.0),
            "_entropy": F.when(F.length("_url") > 0, -F.aggregate(F.filter(counts, lambda p: p > 0), F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0),
            "_params": F.when(F.col("_params") == "", 0).otherwise(F.regexp_count("_params", F.lit("&")) + 1),
            "_has_fragment": F.contains("_url", F.lit("#")).cast("int"),
            "_last_label": F.substring_index("host", ".", -1),
            "_last_labels": F.substring_index("host", ".", -2),
            "_ending": ending,
        }
    ).drop("_url")


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """kind, suffix, bad, n: blocked and all labelled URLs by suffix, of all suffixes; staged."""
    kinds = F.explode(F.array(*[F.struct(F.lit(v).alias("kind"), F.col(f"_{k}").alias("suffix")) for k, v in SUFFIXES.items()])).alias("_s")
    sums = labelled.select(kinds, "_blocked").groupBy("_s.kind", "_s.suffix").agg(F.sum("_blocked").alias("bad"), F.count("*").alias("n"))
    return frames.staged(sums, "suffixes")


def parted(counts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The ``MOST_SUFFIXES`` short suffixes with the most URLs, to be broadcast, and all others; None if there are none."""
    short = F.length("suffix") <= SUFFIX_CHARS
    n, long = counts.agg(F.count("*"), F.count_if(~short)).first()
    if n <= MOST_SUFFIXES and not long:
        return counts, None
    common = frames.staged(counts.filter(short).orderBy(F.desc("n"), "kind", "suffix").limit(MOST_SUFFIXES), "common-suffixes")
    return common, counts.join(F.broadcast(common.select("kind", "suffix")), ["kind", "suffix"], "left_anti")


def overall_rate(labelled: DataFrame) -> float:
    """The share of blocked URLs among all labelled ones."""
    total = labelled.agg(F.sum("_blocked"), F.count("*")).first()
    return total[0] / total[1] if total[1] else 0.0


def with_suffix_rates(rows: DataFrame, counts: DataFrame, overall: float, own_label: bool = False) -> DataFrame:
    """Adds ``_{kind}_rate``, the share of blocked URLs with the row's suffix, drawn to ``overall``, and ``_{kind}_seen``, ln(1 + such URLs).

    The most common suffixes are broadcast, so rows stay where they are, however wide. Where there are more, rows with another suffix get its counts
    by their URL (see ``with_rare_counts``), and only these move. With ``own_label`` the rows are the counted URLs themselves, and each leaves its own label out: a rate that holds the answer would
    teach the trees to trust rates of rare suffixes more than the rates of unlabelled URLs deserve.
    """
    less, one = (F.col("_blocked"), F.lit(1)) if own_label else (F.lit(0), F.lit(0))
    common, rest = parted(counts)
    for name, kind in SUFFIXES.items():
        own = common.filter(F.col("kind") == kind).select(F.col("suffix").alias(f"_{name}"), F.struct("bad", "n").alias(f"_{kind}"))
        rows = rows.join(F.broadcast(own), f"_{name}", "left")
    if rest is not None:
        found = reduce(lambda a, kind: a & F.col(f"_{kind}").isNotNull(), SUFFIXES.values(), F.lit(True))
        rows = rows.filter(found).unionByName(with_rare_counts(rows.filter(~found), rest))
    for kind in SUFFIXES.values():
        bad, n = F.coalesce(F.col(f"_{kind}.bad") - less, F.lit(0)), F.coalesce(F.col(f"_{kind}.n") - one, F.lit(0))
        rows = rows.withColumns({f"_{kind}_rate": (bad + F.lit(overall * PRIOR_URLS)) / (n + F.lit(PRIOR_URLS)), f"_{kind}_seen": F.log1p(n)}).drop(f"_{kind}")
    return rows


def with_rare_counts(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """``rows`` with the counts that they lack (``_{kind}`` null) from ``rest``; null where no labelled URL has the suffix.

    Only pairs of URL and suffix are joined to the counts, each pair once; the counts go back to the rows by the URL.
    """
    rows = rows.withColumn("_key", F.coalesce("url", F.lit("")))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"_{k}").isNull(), F.struct(F.lit(k).alias("kind"), F.col(f"_{v}").alias("suffix"))) for v, k in SUFFIXES.items()]))
    pairs = rows.select("_key", F.explode(lacking).alias("_s")).select("_key", "_s.kind", "_s.suffix").distinct()
    joined = pairs.join(rest, ["kind", "suffix"]).groupBy("_key").agg(*[F.first(F.when(F.col("kind") == k, F.struct("bad", "n")), ignorenulls=True).alias(f"_rare_{k}") for k in SUFFIXES.values()])
    out = rows.join(joined, "_key", "left").withColumns({f"_{k}": F.coalesce(f"_{k}", f"_rare_{k}") for k in SUFFIXES.values()})
    return out.drop("_key", *[f"_rare_{k}" for k in SUFFIXES.values()])


def fit(labelled: DataFrame, most_urls: int = SAMPLE_URLS) -> GBTClassificationModel | None:
    """Trees from about ``most_urls`` of the labelled rows, chosen by a hash of the URL; None unless both verdicts occur among them."""
    n = labelled.count()
    if not n:
        return None
    at = F.xxhash64("url").cast("double") / 2.0**64 + 0.5
    sample = frames.staged(labelled.filter(at < most_urls / n).select(F.col("_blocked").cast("double").alias("label"), *[F.col(f"_{f}").cast("double").alias(f) for f in FEATURES]), "url-sample")
    model = None
    if sample.select("label").distinct().count() == 2:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.coalesce(4)).select("label", "features")
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(vectors)
    frames.discard(sample)
    return model


def judged(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and score (0 to 1, the trees' probability of block; null where a rule decides, or without trees).

    ``rules``: (verdict, host/path) pairs, a list of at most some thousands. A rule fits its host and all its subdomains where the
    path starts with the rule's; the longest wins. URLs without a rule get the trees' verdict, and all of them ``allow`` where the
    rules label too little to learn from (no URL, or one verdict only). A null url, or one without ``://``, has an empty host and path and
    is judged by its other features. Repeated rows are judged alike; an empty table gives an empty table. Columns of the new names are
    replaced; others pass through, whatever they are called.
    """
    packed = pages.select(frames.packed(pages, ("host", "path", "rule", "verdict", "score")).alias("row"), F.col(url).alias("url"))
    found = packed.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    found = found.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)]) if rules else F.create_map().cast("map<string,string>")
    found = lexical(found.withColumn("verdict", F.element_at(verdicts, F.col("rule"))), "url")
    labelled = found.filter(F.col("verdict").isNotNull()).withColumn("_blocked", (F.col("verdict") == BLOCK).cast("int")).drop("row")
    counts = suffix_counts(labelled)
    overall = overall_rate(labelled)
    model = fit(with_suffix_rates(labelled, counts, overall, own_label=True))
    if model is None:
        out = found.withColumns({"verdict": F.coalesce("verdict", F.lit(ALLOW)), "_score": F.lit(None).cast("double")})
    else:
        rated = with_suffix_rates(found, counts, overall).withColumns({f: F.col(f"_{f}").cast("double") for f in FEATURES})
        seen = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rated))
        score = F.when(F.col("rule").isNull(), vector_to_array("probability")[1])
        out = seen.withColumns({"verdict": F.coalesce("verdict", F.when(F.col("prediction") > 0, BLOCK).otherwise(ALLOW)), "_score": score})
    return out.select("row.*", "host", "path", "rule", "verdict", F.col("_score").alias("score"))
