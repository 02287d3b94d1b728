"""Tickets to accounts: a chain of routes by reliability, none overwriting one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCES = ("explicit", "company", "external_id", "user_map", "company_map")


def digits_as_long(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def _fill(rows: DataFrame, candidate: Column, name: str) -> DataFrame:
    """Sets account_id and source where there was none and the candidate isn't null."""
    return rows.withColumns({"source": F.when(F.col("account_id").isNull() & candidate.isNotNull(), F.lit(name)).otherwise(F.col("source")), "account_id": F.coalesce("account_id", candidate)})


#: Partitions' worth of rows without a key that a join spreads.
NULL_SALTS = 1024


def _looked_up(rows: DataFrame, key: Column, table: DataFrame, name: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a value of its column ``name``) for their key.

    Rows without a key match nothing, but would all be sent to one task: a salt, which is 0 for those with a key, spreads them. The other side's
    0 is computed from its key, as a literal would be taken out of what rows are partitioned by.
    """
    salt = F.when(key.isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(NULL_SALTS)) + 1).otherwise(F.lit(0)).cast("int")
    salted, own = rows.withColumns({"_key": key, "_salt": salt}), table.withColumn("_none", F.pmod(F.xxhash64(name), F.lit(1)).cast("int"))
    return salted.join(own, (F.col("_key") == F.col(name)) & (F.col("_salt") == F.col("_none")), "left").drop("_key", "_salt", "_none", name)


def _derived(rows: DataFrame, key: str) -> DataFrame:
    """_of, derived: values of ``key`` whose resolved tickets all have one account."""
    own = rows.filter(F.col(key).isNotNull() & F.col("account_id").isNotNull()).groupBy(key).agg(F.min("account_id").alias("derived"), F.max("account_id").alias("_most"))
    return own.filter("derived = _most").select(F.col(key).alias("_of"), "derived")


def attribute(tickets: DataFrame, companies: DataFrame | None = None, valid_ids: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Adds account_id and source to tickets with explicit_id, company_ref, external_id.

    In order: the explicit id; the companies table (company_ref, account_id) on the trimmed reference; an external id of digits that
    is a valid id (any, where no ids are given); the account to which all resolved tickets of the external id go; the same for the company
    reference, where tickets resolved one step before count. Null keys derive nothing. Of repeated references in ``companies`` the first by
    the column ``order`` counts, without it the least account.
    """
    out = tickets.withColumns({"account_id": F.col("explicit_id").cast("long"), "source": F.when(F.col("explicit_id").isNotNull(), F.lit("explicit")).cast("string")})
    if companies is not None:
        place = F.col(order) if order else F.col("account_id")
        first = companies.filter("account_id IS NOT NULL").groupBy(F.trim("company_ref").alias("_ref")).agg(F.min_by("account_id", F.struct(place, "account_id")).alias("_company"))
        out = _fill(_looked_up(out, F.trim("company_ref"), first, "_ref"), F.col("_company"), "company").drop("_company")
    own = digits_as_long(F.col("external_id"))
    if valid_ids is not None:
        known = valid_ids.select(F.col("id").cast("long").alias("_valid")).distinct().withColumn("_known", F.col("_valid"))
        out = _fill(_looked_up(out, own, known, "_valid"), F.col("_known"), "external_id").drop("_known")
    else:
        out = _fill(out, own, "external_id")
    for key, name in (("external_id", "user_map"), ("company_ref", "company_map")):
        out = _fill(_looked_up(out, F.col(key), _derived(out, key), "_of"), F.col("derived"), name).drop("derived")
    return out


def report(attributed: DataFrame) -> DataFrame:
    """source, tickets, pct; tickets without an account are ``unattributed``."""
    own = attributed.groupBy(F.coalesce("source", F.lit("unattributed")).alias("source")).agg(F.count("*").alias("tickets"))
    return own.withColumn("pct", F.col("tickets") * 100.0 / F.sum("tickets").over(Window.partitionBy()))


def sufficiency(attributed: DataFrame, low: int, high: int, floor: int = 5000) -> DataFrame:
    """One row: usable tickets (attributed, in the labelled periods), their accounts, and whether they suffice."""
    own = attributed.filter(F.col("account_id").isNotNull() & F.col("period").between(low, high))
    return own.agg(F.count("*").alias("usable"), F.count_distinct("account_id").alias("accounts")).withColumn("enough", F.col("usable") >= floor)


def cumulative_coverage(attributed: DataFrame) -> DataFrame:
    """source, share: of all tickets, those resolved by this route or one before it."""
    place = F.create_map(*[x for i, s in enumerate(SOURCES) for x in (F.lit(s), F.lit(i))])[F.col("source")]
    one = attributed.select(place.alias("p")).agg(*[F.avg(F.when(F.col("p") <= i, 1.0).otherwise(0.0)).alias(s) for i, s in enumerate(SOURCES)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("share")) for s in SOURCES])).alias("_r")).select("_r.*")


def key_stability(tickets: DataFrame, key: str, account: str = "account_id") -> DataFrame:
    """One row: keys, share with exactly one account, tickets a key."""
    own = tickets.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(account).alias("a"), F.count("*").alias("n"))
    return own.agg(F.count("*").alias("keys"), F.avg((F.col("a") == 1).cast("int")).alias("one_account_share"), F.avg("n").alias("tickets_a_key"))


def key_lengths(tickets: DataFrame, key: str) -> DataFrame:
    """length, tickets, numeric_share: how long the keys are, and how many of them are digits alone."""
    own = tickets.filter(F.col(key).isNotNull()).groupBy(F.length(key).alias("length"))
    return own.agg(F.count("*").alias("tickets"), F.avg(F.col(key).rlike("^[0-9]+$").cast("int")).alias("numeric_share"))


def one_key_share(tickets: DataFrame, holder: str, key: str) -> DataFrame:
    """One row: ``holder`` values (e-mails, say) that have a key, and the share of them with exactly one."""
    own = tickets.filter(F.col(holder).isNotNull() & F.col(key).isNotNull()).groupBy(holder).agg(F.count_distinct(key).alias("k"))
    return own.agg(F.count("*").alias("holders"), F.avg((F.col("k") == 1).cast("int")).alias("one_key_share"))


def rule_agreement(tickets: DataFrame, accounts: DataFrame, most_digits: int = 7) -> DataFrame:
    """rule, tickets, agree_share, against: how well heuristics for an external id hold where the explicit id is known.

    Rules: it has at most ``most_digits`` digits; it lies between 1 and the greatest account; it is an account (``accounts``: id).
    """
    number = digits_as_long(F.col("external_id"))
    known = accounts.select(F.col("id").cast("long").alias("_id")).distinct()
    own = tickets.filter("explicit_id IS NOT NULL").withColumn("_n", number).filter("_n IS NOT NULL").join(known, F.col("_n") == F.col("_id"), "left")
    greatest = accounts.agg(F.max(F.col("id").cast("long"))).scalar()
    rules = {"short": F.length("external_id") <= most_digits, "in range": F.col("_n").between(1, greatest), "an account": F.col("_id").isNotNull()}
    same = F.col("_n") == F.col("explicit_id")
    own = own.select(same.alias("same"), *[F.when(holds, F.lit(name)).alias(name) for name, holds in rules.items()])
    hits = own.select("same", F.explode(F.array(*rules)).alias("rule")).filter("rule IS NOT NULL")
    return hits.groupBy("rule").agg(F.count("*").alias("tickets"), F.avg(F.col("same").cast("int")).alias("agree_share"), F.count_if(~F.col("same")).alias("against"))


def rescued_by(attributed: DataFrame, key: str) -> DataFrame:
    """``key``, tickets, explicit, rescued, rescued_share: of tickets without an explicit id, how many another route resolves, by reason."""
    own = attributed.groupBy(key).agg(F.count("*").alias("tickets"), F.count_if(F.col("source") == "explicit").alias("explicit"), F.count_if(F.col("source").isNotNull() & (F.col("source") != "explicit")).alias("rescued"))
    return own.withColumn("rescued_share", F.col("rescued") / F.nullif(F.col("tickets") - F.col("explicit"), F.lit(0)))


def coverage_by(attributed: DataFrame, key: str, floor: int = 20) -> DataFrame:
    """``key``, tickets, covered_share for values with ``floor`` tickets or more."""
    own = attributed.groupBy(key).agg(F.count("*").alias("tickets"), F.avg(F.col("account_id").isNotNull().cast("int")).alias("covered_share"))
    return own.filter(F.col("tickets") >= floor)
