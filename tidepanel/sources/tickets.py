"""Support tickets and companies from exports with embedded JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.panel import period_of
from tidepanel.sources import quoted_csv

HEX24 = "^[0-9a-fA-F]{24}$"
#: Names under which an account id is looked for in a companies export, in this order; those of a product come as a parameter.
ID_NAMES = ("company_id", "external_id", "id_de_dash", "dash_id", "account_id")
SAMPLE = 50


def flattened(rows: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """ticket_id, created_at, period, company_ref, category, kind, state, external_id, email and the attributes (JSON field by new name).

    Broken JSON, or JSON that isn't an object, gives nulls.
    """
    have = set(rows.columns)
    col = lambda c: F.col(f"`{c}`") if c in have else F.lit(None).cast("string")
    field = lambda c, path: F.get_json_object(col(c), path)
    seconds = col("Created At").try_cast("double")
    return rows.select(
        col("Ticket ID").alias("ticket_id"),
        F.timestamp_seconds(seconds).alias("created_at"),
        period_of(seconds).alias("period"),
        col("Company ID").alias("company_ref"),
        col("Category").alias("category"),
        col("Channel").alias("channel"),
        field("Ticket Type", "$.name").alias("kind"),
        field("Ticket State", "$.category").alias("state"),
        field("Contacts", "$.contacts[0].external_id").alias("external_id"),
        field("Contacts", "$.contacts[0].email").alias("email"),
        *[field("Ticket Attributes", f"$['{name}']").alias(alias) for name, alias in attributes.items()],
    )


def load_tickets(spark: SparkSession, path: str, attributes: dict[str, str] | None = None) -> DataFrame:
    """The export at ``path``: quoted multi-line CSV, a byte order mark in the header allowed; columns that nobody asks for are never parsed.

    A file is read by as many tasks as it has blocks, see ``quoted_csv``.
    """
    return flattened(quoted_csv.read(spark, path), attributes or {"ID de dash": "explicit_id"})


def hex_share(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: of each column, the share of 24-digit hex among its first 50 values that aren't null."""
    parts = [df.select(F.col(f"`{n}`").cast("string").alias("v")).filter("v IS NOT NULL").limit(SAMPLE).agg(F.coalesce(F.avg(F.col("v").rlike(HEX24).cast("int")), F.lit(0.0)).alias("s")).select(F.lit(n).alias("column"), "s") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def find_reference(df: DataFrame) -> str | None:
    """The column of 24-digit hex references: ``id`` or ``company_ref`` if it looks like it, else the first that does (over 80 %)."""
    ordered = sorted(df.columns, key=lambda c: (c.lower().replace(" ", "_") not in ("id", "company_ref"), df.columns.index(c)))
    shares = {r["column"]: r["s"] for r in hex_share(df, ordered).collect()}
    return next((c for c in ordered if shares[c] > 0.8), None)


def id_shape(df: DataFrame, names: list[str]) -> DataFrame:
    """column, n, share: how many values are numbers, and the share of those that are whole and between 0 and a million; one pass for all columns."""
    stats: list[Column] = [F.count("*").alias("_rows")]
    for i, n in enumerate(names):
        v = F.col(f"`{n}`").cast("string").try_cast("double")
        stats += [F.count(v).alias(f"n{i}"), F.avg(F.when(v.isNotNull(), ((v > 0) & (v < 1_000_000) & (v % 1 == 0)).cast("int"))).alias(f"s{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("share"), F.col("_rows").alias("rows")) for i, n in enumerate(names)])).alias("_r")
    return df.agg(*stats).select(rows).select("_r.*")


def guess_id(df: DataFrame, exclude: set[str]) -> str | None:
    """The numeric column most like an account id: enough values (10 and a tenth), over 90 % of them ids; the first of the best."""
    names = [c for c in df.columns if c not in exclude]
    best, share = None, 0.9
    for r in id_shape(df, names).collect() if names else []:
        if r["n"] >= max(10, 0.1 * r["rows"]) and r["share"] > share:
            best, share = r["column"], r["share"]
    return best


def load_companies(spark: SparkSession, path: str, id_names: tuple[str, ...] = ()) -> DataFrame:
    """company_ref, account_id: found by name (``ID_NAMES``, then ``id_names``; case, blanks and hyphens don't matter) or by content; rows without an id go, of repeated references the first in the files stays."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    ref = find_reference(df)
    if ref is None:
        raise ValueError("no column of company references")
    plain = lambda n: n.lower().replace(" ", "_").replace("-", "_")
    named = {plain(c): c for c in df.columns}
    own = next((named[n] for n in (*ID_NAMES, *map(plain, id_names)) if n in named and named[n] != ref), None) or guess_id(df, {ref})
    if own is None:
        raise ValueError("no column of account ids")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = df.select(F.trim(F.col(f"`{ref}`")).alias("company_ref"), F.col(f"`{own}`").cast("string").try_cast("double").cast("long").alias("account_id"), place.alias("place"))
    return rows.filter("account_id IS NOT NULL").groupBy("company_ref").agg(F.min_by("account_id", "place").alias("account_id"))
