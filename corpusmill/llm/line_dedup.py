"""Cross-site boilerplate lines: HyperLogLog spread for each line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Keys (16 bytes each) up to which a counted table of lines is broadcast.
BROADCAST_ROWS = 500_000
#: Lines are cut at LF; white space at either end does not tell lines apart.
EDGES = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(line: Column) -> list[Column]:
    """Two independent 64-bit hashes: 128 bits, so that equal keys are equal lines."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("second"), line).alias("k2")]


def _among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose (k1, k2) is in ``keys``: by a broadcast where the keys, counted first, are few, else by a shuffled semi-join."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, ["k1", "k2"], "left_semi")


def spread(docs: DataFrame, min_sites: int, lg_k: int = 10, band: float = 0.25) -> DataFrame:
    """(k1, k2, sites) of the lines on at least ``min_sites`` distinct sites; blank lines and null sites don't count.

    Each line's sites go into a HyperLogLog sketch; sketches merge on the map side first, so a line that a third of
    all rows hold reaches the reducer as one sketch from each task. Lines whose estimate is farther from the
    threshold than ``band`` (eight standard errors at lg_k 10) are settled by it; the lines in between get an exact
    distinct count over (line, site) pairs.
    """
    trimmed = F.btrim(F.col("line"), F.lit(EDGES))
    pairs = shared.columns_only(docs, "text", "source").filter(F.col("source").isNotNull()).select("source", F.explode(_lines(F.col("text"))).alias("line")).filter(F.length(trimmed) > 0).select("source", *_keys(trimmed))
    sketched = pairs.groupBy("k1", "k2").agg(F.hll_sketch_agg("source", F.lit(lg_k)).alias("sketch")).select("k1", "k2", F.hll_sketch_estimate("sketch").alias("estimate"))
    low, high = min(min_sites * (1 - band), min_sites - 2), max(min_sites * (1 + band), min_sites + 2)
    wide = shared.cut(sketched.filter(F.col("estimate") >= max(low, 1 if min_sites <= 1 else 2)))
    sure = wide.filter(F.col("estimate") > high).select("k1", "k2")
    near = wide.filter(F.col("estimate") <= high).select("k1", "k2")
    exact = _among(pairs, near).distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites)
    return sure.union(exact.select("k1", "k2"))


def dedup_lines(docs: DataFrame, min_sites: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, n_lines, n_dropped, text (null: null).

    Lines that stand on ``min_sites`` sites or more go from every document; others, blank ones too, stay in order.
    Whole texts are never shuffled by line: the table of boilerplate lines (joined by a broadcast only where Spark
    has measured it small) marks (document, places) pairs, and those alone go back to their documents, keyed by
    doc_id and text, so that repeated ids and null ids keep their own lines. An empty table gives no rows.
    """
    known = shared.cut(spread(docs, min_sites))
    base = shared.columns_only(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    placed = base.select("doc_id", "th", F.posexplode(_lines(F.col("text"))).alias("place", "line")).select("doc_id", "th", "place", *_keys(F.btrim("line", F.lit(EDGES))))
    hits = _among(placed, known).groupBy("doc_id", "th").agg(F.collect_set("place").alias("places")).withColumnRenamed("doc_id", "hit_id").withColumnRenamed("th", "hit_th")
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    # the lines are a column of their own, so that the lambda below looks one up and does not split the text again
    cutup = joined.withColumn("lines", _lines(F.col("text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    n_dropped = F.coalesce(F.size("places"), F.lit(0))
    return cutup.select(
        "doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.when(F.col("places").isNull(), 0).otherwise(n_dropped).cast("bigint").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )
