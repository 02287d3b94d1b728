"""Mixing sources to target weights with hash-threshold histograms.

Every source gets a budget of words. A document's whole-number part of target / size is taken for all documents of the source; for
the rest of the budget a source takes the documents whose hash lies below a threshold. The threshold is found without a sort: words
are summed by source and hash bucket, the bucket where the running sum passes the budget is the boundary, and only documents in
boundary buckets are summed again, by the next bits of their hash, until all bits are fixed. Decisions are one comparison a row.

DataFrame functions only. What a source needs is held in a table with one row a source, so a source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm import frames

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
HASH_BITS = 60
LEVEL_BITS = 10
#: Columns that ``mixed`` adds to a document.
ADDED = ("size", "source_size", "target", "copies")


def words(text: Column) -> Column:
    """Runs of characters outside ``[\\x20\\x09-\\x0D]``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(frames.WORD_CLASS)), F.lit(0)).cast("long")


def row_hash(key: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text: the same in every run, on any partitioning."""
    joined = F.concat_ws("\n", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """row (the columns of ``docs``, but those that ``mixed`` adds), source, size (the words of a document), hash."""
    row = frames.packed(docs, ADDED).alias("row")
    return docs.select(row, F.col(source).alias("source"), words(F.col(text)).alias("size"), row_hash(F.col(key), F.col(text)).alias("hash"))


def source_ranks(rows: DataFrame) -> DataFrame:
    """source, source_size, place: sources from 0 in code point order, null last; staged.

    The table has a row a source. It is put in order by a range partitioning and numbered by offsets of partitions, so no task holds
    it all; only the counts of partitions, bounded by their number, meet in one window.
    """
    last = F.col("source").isNull()
    own = rows.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(last, F.col("source"))
    ordered = frames.staged(own.sortWithinPartitions(last, "source").withColumn("_at", F.monotonically_increasing_id()), "source-order")
    placed = ordered.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = frames.staged(placed.join(before, "_part").select("source", "source_size", (F.col("_before") + F.col("_row")).alias("place")), "source-places")
    frames.discard(ordered)
    return out


def with_targets(sources: DataFrame, share: float, most_times: float, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target (staged): the level to which sources fill by weight, each to ``most_times`` its size at most.

    Full sources hand on their excess, so the level only rises from round to round, until no more sources are full; a round is one
    sum over the table of sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighted = frames.staged(sources.withColumns({"weight": weight, "most": F.col("source_size") * float(most_times)}), "sources")
    level, full = 0.0, -1
    while True:
        above = F.col("most") < F.col("weight") * F.lit(level)
        r = weighted.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(above, F.col("most"))).alias("spent"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("full")
        ).first()
        if not r["words"] or r["full"] == full:
            break
        if r["open"] is None:
            level = float("inf")
            break
        level, full = (r["words"] * share - (r["spent"] or 0.0)) / r["open"], r["full"]
    out = frames.staged(weighted.select("source", "source_size", F.least("most", F.col("weight") * F.lit(level)).alias("target")), "targets")
    frames.discard(weighted)
    return out


def _of_source(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``sources``; null is a source like any other. Spark broadcasts the table only below its size limit."""
    own = sources.withColumnRenamed("source", "_source")
    return rows.join(own, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _bounds(inside: DataFrame, left: DataFrame, bits: int) -> DataFrame:
    """source, below, left, inside, from rows of source, size and hash (of so many bits), and the words left by source: staged.

    ``below`` is the largest bound for which the words of hashes under it are no more than ``left``. Each level sums words by bucket of the
    next bits, inside the boundary bucket only; ``left`` becomes what is left for the boundary bucket, and ``inside`` the documents in it. A
    boundary bucket of one document decides as its further bits would, so levels end when no source has more than one there.
    """
    state = left.select("source", F.lit((1 << bits) - 1).alias("below"), "left", F.lit(0).cast("long").alias("inside"))
    old: list[DataFrame] = []
    top = bits - (bits % LEVEL_BITS or LEVEL_BITS)
    for shift in range(top, -1, -LEVEL_BITS):
        if shift < top:
            boundary = state.filter("inside > 1").select("source", F.shiftright("below", shift + LEVEL_BITS).alias("_bucket"))
            inside = _of_source(inside, boundary).filter(F.shiftright("hash", shift + LEVEL_BITS) == F.col("_bucket")).drop("_bucket")
            inside = frames.staged(inside, "mix-boundary")
            old.append(inside)
        summed = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        run = summed.withColumn("run", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        over = _of_source(run, state.select("source", "left")).filter(F.col("run") > F.col("left"))
        first = over.groupBy("source").agg(F.min(F.struct("bucket", (F.col("run") - F.col("words")).alias("before"), "docs")).alias("_first"))
        state = _of_source(state, first, "left").select(
            "source",
            F.coalesce(F.shiftleft("_first.bucket", shift), F.col("below")).alias("below"),
            (F.col("left") - F.coalesce(F.col("_first.before"), F.lit(0))).alias("left"),
            F.coalesce("_first.docs", F.lit(0)).alias("inside"),
        )
        state = frames.staged(state, "mix-level")
        old.append(state)
        if (state.agg(F.max("inside")).first()[0] or 0) <= 1:
            break
    frames.discard(*old[:-1])
    return state


def plan(rows: DataFrame, share: float = 1.5, most_times: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, whole, below, left, tied, from rows of source, size and hash.

    Documents of a source are taken ``whole`` times, and once more where their hash is under ``below``: the largest bound that keeps
    the source's words within its target. ``tied`` documents share the hash ``below``, if it is more than one, with ``left`` words for them.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    ranks = source_ranks(rows)
    targets = with_targets(ranks, share, most_times, weights)
    sources = targets.withColumn("whole", whole)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    state = _bounds(rows.select("source", "size", "hash"), sources.select("source", rest.alias("left")), HASH_BITS)
    found = _of_source(sources, state.select("source", "below", "left", F.col("inside").alias("tied")))
    # a source that whole copies fill has nothing left, also not for documents without words
    partial = rest > 0
    found = found.withColumns({"below": F.when(partial, F.col("below")).otherwise(F.lit(0)), "tied": F.when(partial, F.col("tied")).otherwise(F.lit(0))})
    out = frames.staged(found, "mix-plan")
    frames.discard(ranks, targets, state)
    return out


def decide(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds source_size, target and ``copies`` to rows of source, size and hash.

    Rows that share the hash at a source's bound (repeated rows) are numbered as they are staged, by partition and place, and a bound on
    that number is found in the same way: as many of them are taken as have room. They are alike, so which ones is no matter.
    """
    own, gone = _of_source(rows, found), ("whole", "below", "left", "tied", "hash")
    at_bound = (F.col("tied") > 1) & (F.col("hash") == F.col("below"))
    sure = own.withColumn("copies", F.col("whole") + (F.col("hash") < F.col("below")).cast("long"))
    if found.filter("tied > 1").isEmpty():
        return sure.drop(*gone)
    tied = frames.staged(own.filter(at_bound).withColumn("_at", F.monotonically_increasing_id()), "mix-tied")
    cut = _bounds(tied.select("source", "size", F.col("_at").alias("hash")), found.filter("tied > 1").select("source", "left"), 63)
    shared = _of_source(tied, cut.select("source", F.col("below").alias("_cut"))).withColumn("copies", F.col("whole") + (F.col("_at") < F.col("_cut")).cast("long"))
    return sure.filter(~at_bound).drop(*gone).unionByName(shared.drop(*gone, "_at", "_cut"))


def mixed(docs: DataFrame, share: float = 1.5, most_times: float = 2.0, weights: tuple[int, ...] = WEIGHTS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and copies, how often the mix takes the document (0 to ``most_times``).

    Sources weigh ``weights`` in turn by name, null last; together they get ``share`` of all words, none more than ``most_times`` its
    own words. A source's taken words miss its target by less than the document at its threshold. The hash is of id and text, so
    reruns agree; of rows equal in both, at the threshold, as many are taken as have room. A null text or one without words has size 0; a source without words has
    target 0; an empty table gives an empty table. Columns of the added names, in any case, are replaced; others pass through, whatever
    they are called.
    """
    rows = sized(docs, key, text, source)
    small = frames.staged(rows.select("source", "size", "hash"), "mix-rows")
    found = plan(small, share, most_times, weights)
    frames.discard(small)
    return decide(rows, found).select("row.*", *ADDED)
