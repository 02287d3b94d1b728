"""Price lists: a YAML file by kind, item and market, and the same as rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import plan_codes
from tidepanel.operators import risk
from tidepanel.sources import files
from tidepanel.spec import MARKETS

Prices = Mapping[str, Mapping[str, float | None]]


@dataclass(frozen=True)
class PriceBook:
    """Prices of plans and modules by market; null is a price that isn't known."""

    plans: Prices = field(default_factory=dict)
    modules: Prices = field(default_factory=dict)
    currency: str = "USD"
    default_market: str = "int"

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PriceBook:
        """From a YAML file on any file system; a file that isn't there is an error, a part that isn't there is empty."""
        data = yaml.safe_load(files.read_text(spark, path)) or {}
        return cls(**{k: data[k] for k in ("plans", "modules", "currency", "default_market") if data.get(k)})

    @property
    def is_filled(self) -> bool:
        """Whether any price is known and above 0; without, all revenue is 0."""
        return plan_codes.is_filled(self.plans) or plan_codes.is_filled(self.modules)

    def rows(self, spark: SparkSession, markets: tuple[str, ...] = MARKETS) -> DataFrame:
        """kind, item, market, own (its price there), price (or that of the default market), for every item and market. A book has some hundred rows."""
        flat = [(kind, item, m, by.get(m)) for kind, part in (("plan", self.plans), ("module", self.modules)) for item, by in part.items() for m in dict.fromkeys((*markets, *by))]
        own = spark.createDataFrame([(k, i, m, None if p is None else float(p)) for k, i, m, p in flat], "kind string, item string, market string, own double")
        standard = own.filter(F.col("market") == self.default_market).select("kind", "item", F.col("own").alias("_standard"))
        return own.join(F.broadcast(standard), ["kind", "item"], "left").select("kind", "item", "market", "own", F.coalesce("own", "_standard").alias("price"))

    def priced(self, panel: DataFrame) -> DataFrame:
        """``panel`` with revenue, missing and items of its plan codes, and price_incomplete."""
        return risk.revenues(panel, dict(self.plans), dict(self.modules), self.default_market).withColumn("price_incomplete", F.size("missing") > 0)


def unpriced(panel: DataFrame, book: PriceBook) -> DataFrame:
    """kind, item, market, accounts: what plan codes of ``panel`` hold and the book has no price for, with the rows that need it."""
    codes = panel.filter("plan IS NOT NULL").groupBy("plan").agg(F.count("*").alias("accounts")).withColumn("p", plan_codes.parse(F.col("plan")))
    base = F.array(F.struct(F.lit("plan").alias("kind"), F.col("p.base").alias("item")))
    parts = F.concat(base, F.transform("p.modules", lambda m: F.struct(F.lit("module").alias("kind"), m.alias("item"))))
    market = F.coalesce("p.market", F.lit(book.default_market)).alias("market")
    needed = codes.select("accounts", market, F.explode(F.array_distinct(parts)).alias("i")).select("i.kind", "i.item", "market", "accounts").filter("item IS NOT NULL")
    needed = needed.groupBy("kind", "item", "market").agg(F.sum("accounts").alias("accounts"))
    known = book.rows(panel.sparkSession).filter("price IS NOT NULL").select("kind", "item", "market")
    return needed.join(F.broadcast(known), ["kind", "item", "market"], "left_anti")
