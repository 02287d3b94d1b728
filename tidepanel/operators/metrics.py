"""Metrics of a score against a label, from counts by distinct score (see ``ranks`` for how they are put in order)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import ranks
from tidepanel.sources import files


def _labelled(scored: DataFrame, label: str, score: str, *keep: str) -> DataFrame:
    own = scored.select(F.col(label).cast("long").alias("y"), F.col(score).alias("score"), *keep)
    return own.filter("y IS NOT NULL AND score IS NOT NULL")


def _counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


def _curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """score, n, pos, seen, hits, total, positives: running counts from the highest score down, ties together."""
    names = {"n_upto": "seen", "pos_upto": "hits", "n_all": "total", "pos_all": "positives"}
    return ranks.running(_counts(_labelled(scored, label, score), "score"), "score", ["n", "pos"], descending=True).withColumnsRenamed(names)


def average_precision(scored: DataFrame, label: str = "churn", score: str = "score") -> DataFrame:
    """One row: pr_auc, the sum over distinct scores of recall gained times precision; baseline; lift."""
    c = _curve(scored, label, score)
    one = c.agg(F.sum(F.col("pos") / F.col("positives") * F.col("hits") / F.col("seen")).alias("pr_auc"), (F.max("positives") / F.max("total")).alias("baseline"))
    return one.withColumn("lift", F.col("pr_auc") / F.col("baseline"))


def roc_auc(scored: DataFrame, label: str = "churn", score: str = "score") -> DataFrame:
    """One row: roc_auc, the chance that a positive scores above a negative, ties a half."""
    c = _curve(scored, label, score)
    above = F.col("hits") - F.col("pos") + F.col("pos") / 2
    return c.agg((F.sum((F.col("n") - F.col("pos")) * above) / (F.max("positives") * (F.max("total") - F.max("positives")))).alias("roc_auc"))


def best_f1(scored: DataFrame, label: str = "churn", score: str = "score") -> DataFrame:
    """One row: threshold, f1, precision, recall at the greatest F1; of equal ones the lowest threshold."""
    c = _curve(scored, label, score)
    f1 = 2 * F.col("hits") / (F.col("seen") + F.col("positives"))
    best = c.select(f1.alias("f1"), (-F.col("score")).alias("_low"), "score", (F.col("hits") / F.col("seen")).alias("precision"), (F.col("hits") / F.col("positives")).alias("recall"))
    one = best.agg(F.max(F.struct("f1", "_low", "score", "precision", "recall")).alias("_b"))
    return one.select(F.col("_b.score").alias("threshold"), "_b.f1", "_b.precision", "_b.recall")


def brier(scored: DataFrame, label: str = "churn", score: str = "score") -> DataFrame:
    return scored.filter(f"{label} IS NOT NULL").agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def top_k(scored: DataFrame, label: str = "churn", score: str = "score", fractions: tuple[float, ...] = (0.01, 0.05, 0.10, 0.20), key: tuple[str, ...] = ("id", "t")) -> DataFrame:
    """fraction, n_accounts, hits, precision, recall, lift of the k = max(1, round(n * fraction)) highest scores, ties by key, and last negatives first.

    No row is ranked: whole scores are counted down to the one where k is reached, once for all fractions, then, of the rows of that score alone,
    whole values of the first key, and so on. What the driver holds is a boundary a fraction. Labels, scores and keys are staged in the shared
    folder while it counts, so what made them runs once.
    """
    spark, rows = scored.sparkSession, files.kept(_labelled(scored, label, score, *key), "ranked")
    n, positives = rows.agg(F.count("*"), F.sum("y")).first()
    want = {float(f): max(1, round(n * f)) for f in fractions} if n else {}
    hits, left = dict.fromkeys(want, 0), dict(want)
    inside = None
    for column in ("score", *key, "y"):
        if not left:
            break
        take = F.element_at(F.create_map(*[F.lit(x) for fk in left.items() for x in fk]), F.col("fraction"))
        order = column if column != "y" else "_y"
        if inside is None:
            placed = ranks.running(_counts(rows, "score"), "score", ["n", "pos"], descending=True).withColumn("fraction", F.explode(F.array(*map(F.lit, want))))
        else:
            placed = ranks.running(_counts(inside.withColumn("_y", F.col("y")), "fraction", order), order, ["n", "pos"], ("fraction",))
        placed = placed.withColumn("take", take)
        crossing = (F.col("n_upto") > F.col("take")) & (F.col("n_upto") - F.col("n") < F.col("take"))
        found = placed.groupBy("fraction").agg(F.sum(F.when(F.col("n_upto") <= F.col("take"), F.col("pos"))).alias("hits"), F.max(F.when(crossing, F.struct(F.col(order).alias("at"), (F.col("take") - F.col("n_upto") + F.col("n")).alias("left")))).alias("b")).collect()
        borders = {r["fraction"]: r["b"] for r in found if r["b"]}
        for r in found:
            hits[r["fraction"]] += r["hits"] or 0
        left = {f: b["left"] for f, b in borders.items()}
        if column == "y":
            for f, b in borders.items():
                hits[f] += b["at"] * b["left"]
        elif borders:
            kind = rows.schema[column].dataType.simpleString()
            edges = F.create_map(*[x for f, b in borders.items() for x in (F.lit(f), F.lit(b["at"]).cast(kind))])
            if inside is None:
                some = rows.filter(F.col(column).isin(*{b["at"] for b in borders.values()}))
                inside = some.withColumn("fraction", F.explode(F.array(*map(F.lit, borders))))
            inside = inside.filter(F.col(column) == F.element_at(edges, F.col("fraction")))
    files.release(rows)
    out = [(f, k, hits[f], hits[f] / k, hits[f] / positives if positives else None, hits[f] / k / (positives / n) if positives else None) for f, k in want.items()]
    return spark.createDataFrame(out, "fraction double, n_accounts long, hits long, precision double, recall double, lift double")


def evaluation(scored: DataFrame, label: str = "churn", score: str = "score") -> DataFrame:
    """One row: pr_auc, baseline, lift, roc_auc, brier, best_f1 and its threshold, all from one pass over the counts by score."""
    c = _curve(scored, label, score)
    f1 = 2 * F.col("hits") / (F.col("seen") + F.col("positives"))
    above = F.col("hits") - F.col("pos") + F.col("pos") / 2
    squares = F.col("pos") * F.pow(1 - F.col("score"), 2) + (F.col("n") - F.col("pos")) * F.pow(F.col("score"), 2)
    one = c.agg(
        F.sum(F.col("pos") / F.col("positives") * F.col("hits") / F.col("seen")).alias("pr_auc"), (F.max("positives") / F.max("total")).alias("baseline"),
        (F.sum((F.col("n") - F.col("pos")) * above) / (F.max("positives") * (F.max("total") - F.max("positives")))).alias("roc_auc"),
        (F.sum(squares) / F.max("total")).alias("brier"), F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("low"))).alias("_b"),
    )
    return one.select("pr_auc", "baseline", (F.col("pr_auc") / F.col("baseline")).alias("lift"), "roc_auc", "brier", F.col("_b.f1").alias("best_f1"), (-F.col("_b.low")).alias("threshold"))
