"""Plan codes as SQL expressions: base, modules, market; prices and revenue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.spec import MARKETS, MODULES, PLAN_RANK


def _of(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with ``value`` worked out once a row however often ``of`` names it."""
    return F.transform(F.array(value), of)[0]


def parse(code: Column) -> Column:
    """A struct of base, modules, market and unknown out of a code like ``adv-tbl-dv-mx``.

    Lower-cased, trimmed, split at hyphens, empty parts dropped. The last part is the market if it is one; the first of the rest the base
    if it is one; the others are modules or unknown, in order, repeats kept. A null or empty code has nothing.
    """
    parts = F.filter(F.split(F.lower(F.trim(F.coalesce(code, F.lit("")))), "-"), lambda x: F.trim(x) != "")

    def without_market(own: Column) -> Column:
        last = F.try_element_at(own, F.lit(-1))
        known = F.coalesce(F.array_contains(_of(MARKETS), last), F.lit(False))
        return F.struct(F.when(known, last).alias("market"), F.when(known, F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))).otherwise(own).alias("rest"))

    def without_base(own: Column) -> Column:
        first = F.try_element_at(own["rest"], F.lit(1))
        known = F.coalesce(F.array_contains(_of(tuple(PLAN_RANK)), first), F.lit(False))
        tail = F.when(known, F.slice(own["rest"], 2, F.greatest(F.size(own["rest"]), F.lit(1)))).otherwise(own["rest"])
        return F.struct(F.when(known, first).alias("base"), own["market"].alias("market"), tail.alias("tail"))

    def sorted_out(own: Column) -> Column:
        known = F.filter(own["tail"], lambda x: F.array_contains(_of(MODULES), x))
        unknown = F.filter(own["tail"], lambda x: ~F.array_contains(_of(MODULES), x))
        return F.struct(own["base"].alias("base"), known.alias("modules"), own["market"].alias("market"), unknown.alias("unknown"))

    return once(once(once(F.transform(parts, lambda x: F.trim(x)), without_market), without_base), sorted_out)


def rank(base: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PLAN_RANK.items() for x in kv])[base], F.lit(0))


def describe(plan: Column) -> Column:
    """``base + modules (market)`` in words; what is missing is left out."""
    modules = F.when(F.size(plan["modules"]) > 0, F.array_join(plan["modules"], " + "))
    body = F.concat_ws(" + ", plan["base"], modules)
    return F.when(plan["market"].isNull(), body).otherwise(F.concat(body, F.lit(" ("), plan["market"], F.lit(")")))


def _book(prices: dict[str, dict[str, float | None]]) -> Column:
    """item|market to price; prices that are null aren't in it."""
    rows = [x for item, by in prices.items() for market, price in by.items() if price is not None for x in (F.lit(f"{item}|{market}"), F.lit(float(price)))]
    return F.create_map(*rows) if rows else F.create_map().cast("map<string,double>")


def price(book: Column, item: Column, market: Column, default: str) -> Column:
    """The price of an item in a market, else in the default market, else null."""
    at = lambda m: F.try_element_at(book, F.concat(item, F.lit("|"), m))
    return F.coalesce(at(F.coalesce(market, F.lit(default))), at(F.lit(default)))


def revenue(plan: Column, plans: dict, modules: dict, default: str) -> Column:
    """A struct of revenue (sum of known prices, 2 decimals), missing (items without a price) and items (item, price) of a parsed plan."""
    base_book, module_book = _book(plans), _book(modules)

    def items(own: Column) -> Column:
        base = F.when(own["base"].isNotNull(), F.array(F.struct(own["base"].alias("item"), price(base_book, own["base"], own["market"], default).alias("price"))))
        rest = F.transform(own["modules"], lambda m: F.struct(m.alias("item"), price(module_book, m, own["market"], default).alias("price")))
        return F.when(base.isNotNull(), F.concat(base, rest)).otherwise(rest)

    def summed(own: Column) -> Column:
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + F.coalesce(x["price"], F.lit(0.0)))
        missing = F.transform(F.filter(own, lambda x: x["price"].isNull()), lambda x: x["item"])
        return F.struct(F.bround(total, 2).alias("revenue"), missing.alias("missing"), own.alias("items"))

    return once(once(plan, items), summed)


def is_filled(book: dict[str, dict[str, float | None]]) -> bool:
    return any(p for by in book.values() for p in by.values())
