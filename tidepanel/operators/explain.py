"""Why a score is what it is: Shapley values of the trees, contributions, narratives.

For one leaf, a row's share in its value depends on each feature on the path in one of two ways: the row satisfies the feature's splits
or not, and the training rows that came that far satisfy them in a known share. Sums over the subsets of the features give the
path-dependent Shapley values; they are the coefficients of a product, taken for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import names as labels
from tidepanel.operators import ranks
from tidepanel.operators.learning import Artifact

TOP = 8


#: A leaf: its value, and of each feature on its path the number, the bins that lead there (from all), and the share of training rows that keep to them.
Leaf = tuple[float, list[tuple[int, np.ndarray, float]]]


def leaves(artifact: Artifact) -> list[Leaf]:
    """The leaves of all trees; shares are of Hessians, as the trees weigh rows."""
    out: list[Leaf] = []
    for tree in artifact.model.trees:
        todo: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = [(0, {})]
        while todo:
            node, path = todo.pop()
            if not tree.left[node]:
                out.append((tree.value[node], [(f, *own) for f, own in path.items()]))
                continue
            f = tree.feature[node]
            within, share = path.get(f, (np.ones(len(tree.table[node]), dtype=bool), 1.0))
            for child, goes in ((tree.left[node], tree.table[node]), (tree.right[node], ~tree.table[node])):
                todo.append((child, {**path, f: (within & goes, share * tree.cover[child] / max(tree.cover[node], 1e-300))}))
    return out


def shapley(bins: np.ndarray, own: list[Leaf]) -> tuple[np.ndarray, float]:
    """Values (rows x features) and the expected margin, from ``bins`` (features x rows): together they are each row's margin.

    For a leaf with m features on its path, the product of (share + inside * z) over the features has, as coefficients of z, the sums over
    subsets of a size; without one feature (divided out) they are weighed by how many orders put that feature after such a subset.
    """
    n = bins.shape[1]
    out, base = np.zeros((n, bins.shape[0])), 0.0
    for value, path in own:
        m = len(path)
        base += value * np.prod([p[2] for p in path])
        inside = [within[bins[f]].astype(float) for f, within, _ in path]
        shares = [max(p[2], 1e-12) for p in path]
        product = [np.ones(n)]
        for b, a in zip(shares, inside, strict=True):
            product = [b * (product[k] if k < len(product) else 0.0) + a * (product[k - 1] if k else 0.0) for k in range(len(product) + 1)]
        orders = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
        for (f, *_), b, a in zip(path, shares, inside, strict=True):
            rest, total = np.zeros(n), np.zeros(n)
            for k in range(m):
                rest = (product[k] - a * rest) / b
                total += orders[k] * rest
            out[:, f] += value * total * (a - b)
    return out, base


def contributions(rows: DataFrame, artifact: Artifact, top: int = TOP, known: Mapping[str, str] | None = None) -> DataFrame:
    """Adds base_margin and ``factors``: array of (feature, label, group, value, text, shap, direction), the ``top`` largest by absolute Shapley value, zeros left out.

    A number stands in ``value``, a category in ``text``. ``known``: labels of features, see ``names.label``. The trees are broadcast (their
    size is the model's); rows stream through with their features, nothing is shuffled.
    """
    names = artifact.model.features
    shared = rows.sparkSession.sparkContext.broadcast((artifact.model, leaves(artifact)))
    info = {n: (labels.label(n, known), labels.group(n)) for n in names}
    kind = "array<struct<feature:string,label:string,group:string,value:double,text:string,shap:double,direction:string>>"
    columns = [f"_x{i}" for i in range(len(names))]

    def explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, own = shared.value
        for pdf in batches:
            values = [pdf[c].to_numpy() for c in columns]
            phi, base = shapley(model.binned(values), own)
            order = np.argsort(-np.abs(phi), axis=1, kind="stable")[:, :top]
            factors = [[_factor(names[j], info[names[j]], values[j][i], j < len(model.edges), float(phi[i, j])) for j in order[i] if phi[i, j] != 0] for i in range(len(pdf))]
            yield pdf.drop(columns=columns).assign(base_margin=base, factors=factors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.select("*", *artifact.model.columns(rows)).mapInPandas(explained, f"{fields}, base_margin double, factors {kind}")


def _factor(name: str, info: tuple[str, str], value: object, number: bool, phi: float) -> dict:
    given = value is not None and value == value
    return {"feature": name, "label": info[0], "group": info[1], "value": float(value) if number and given else None, "text": str(value) if given and not number else None, "shap": phi, "direction": "up" if phi > 0 else "down"}


def mean_abs_shap(rows: DataFrame, artifact: Artifact, top: int = 25) -> DataFrame:
    """feature, mean_abs_shap: the mean absolute Shapley value over all ``rows``, of the ``top`` features. Each task sums its rows; the sums are shuffled."""
    names = artifact.model.features
    shared = rows.sparkSession.sparkContext.broadcast((artifact.model, leaves(artifact)))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, own = shared.value
        total, n = np.zeros(len(names)), 0
        for pdf in batches:
            if len(pdf):
                total += np.abs(shapley(model.binned([pdf[c].to_numpy() for c in pdf.columns]), own)[0]).sum(axis=0)
                n += len(pdf)
        if n:
            yield pd.DataFrame({"feature": names, "s": total, "n": n})

    seen = rows.select(*artifact.model.columns(rows))
    sums = seen.mapInPandas(summed, "feature string, s double, n long").groupBy("feature").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("feature", (F.col("s") / F.col("n")).alias("mean_abs_shap")).orderBy(F.desc("mean_abs_shap"), "feature").limit(top)


def with_percentiles(explained: DataFrame, rows: DataFrame, features: list[str], key: str = "id") -> DataFrame:
    """``explained`` with a percentile in every factor: where the account's value stands among all ``rows`` (ties at their mean rank), null without a value.

    Values are counted by feature, ranked (see ``ranks``) and joined to the factors that need them; factors keep their order.
    """
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    own = [f for f in features if dict(rows.dtypes).get(f) in numeric]
    counts = ranks.unpivoted(rows, own, "double").filter("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))
    placed = ranks.percentiles(counts, "value", ("feature",)).select("feature", "value", "percentile")
    single = explained.select(key, F.posexplode("factors").alias("place", "f")).select(key, "place", "f", F.col("f.feature").alias("feature"), F.col("f.value").alias("value"))
    joined = single.join(placed, ["feature", "value"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", F.col("f").withField("percentile", F.col("percentile")).alias("f")))).alias("_f"))
    kind = dict(explained.dtypes)["factors"].removesuffix(">>") + ",percentile:double>>"
    out = explained.drop("factors").join(joined, key, "left")
    return out.withColumn("factors", F.coalesce(F.transform("_f", lambda x: x["f"]), F.array().cast(kind))).drop("_f")


INTRO = {"alto": "High risk of leaving", "medio": "Medium risk of leaving", "bajo": "Low risk of leaving", "no_churn": "No marked signs of leaving"}
#: The percentiles from which a value is called far below, below, above and far above the others.
PLACES = (10, 30, 70, 90)


def _said(factor: Column) -> Column:
    """A factor's label with a small first letter, and its place among all accounts where that is known."""
    p = factor["percentile"]
    place = F.when(p <= PLACES[0], "far below the others").when(p <= PLACES[1], "below the others").when(p >= PLACES[3], "far above the others").when(p >= PLACES[2], "above the others").otherwise("like the others")
    name = F.concat(F.lower(F.substring(factor["label"], 1, 1)), F.substring(factor["label"], F.lit(2), F.length(factor["label"])))
    return F.concat(name, F.when(p.isNull(), F.lit("")).otherwise(F.concat(F.lit(" ("), place, F.lit(", percentile "), F.format_number(p, 0), F.lit(")"))))


def narrative(category: Column, probability: Column, revenue: Column, factors: Column, currency: str = "USD") -> Column:
    """Sentences in SQL: category and probability, revenue at stake, up to three factors that push and two that hold, each with its percentile."""
    head = F.concat(F.coalesce(F.create_map(*[F.lit(x) for kv in INTRO.items() for x in kv])[category], F.lit("Risk of leaving")), F.lit(": estimated probability "), F.format_number(probability * 100, 0), F.lit("%."))
    stake = F.when(revenue > 0, F.concat(F.lit(" Worth "), F.format_number(revenue, 0), F.lit(f" {currency} a month, "), F.format_number(probability * revenue, 0), F.lit(" at risk.")))

    def named(direction: str, most: int, lead: str) -> Column:
        own = F.slice(F.filter(factors, lambda f: f["direction"] == direction), 1, most)
        return F.when(F.size(own) > 0, F.concat(F.lit(lead), F.array_join(F.transform(own, _said), "; "), F.lit(".")))

    parts = [stake, named("up", 3, " What pushes it: "), F.when(category != "no_churn", named("down", 2, " What holds it: "))]
    return F.concat(head, *[F.coalesce(p, F.lit("")) for p in parts])


def rewritten(scored: DataFrame, writer: Callable[[dict], str | None], text: str = "narrative", category: str = "alto") -> DataFrame:
    """``scored`` where a caller's function writes the text of one category's rows, from the row as a dictionary; where it fails or gives nothing, the text stays.

    The function runs in tasks, for the few rows of that category alone.
    """
    few = scored.filter(F.col("risk_category") == category)

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for row in pdf.to_dict("records"):
                try:
                    texts.append(writer(row) or row[text])
                except Exception:  # a writer never stops a batch
                    texts.append(row[text])
            yield pdf.assign(**{text: texts})

    return few.mapInPandas(written, scored.schema).unionByName(scored.filter(~F.col("risk_category").eqNullSafe(category)))
