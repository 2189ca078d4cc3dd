"""Mixing sources to target weights by fitting each source's budget as a subset sum over exact lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: The exact part of a fit works on a remainder of so many words; where it leaves a gap, on the next of these.
EXACT_WORDS = (1 << 14, 1 << 16, 1 << 18)


def drawn(counts: list[int], part: float, start: float) -> list[int]:
    """How many documents of each size a systematic draw takes: of the documents in order of size, one every 1 / ``part``.

    So each document is drawn alike, whether or not others have its length; ``start`` (0 to 1) says where it begins.
    """
    ends = np.floor(np.cumsum(np.asarray(counts, np.float64)) * part + start)
    return np.minimum(np.diff(ends, prepend=np.floor(start)).astype(np.int64), counts).tolist()


def exact_fit(sizes: list[int], spare: list[int], left: int) -> tuple[list[int], int]:
    """How many of the ``spare`` documents of each size come nearest below ``left`` words, and by how many words they miss.

    A bounded-knapsack DP: for each reachable sum it holds the piece that first reached it (a size's spare documents
    are pieces of 1, 2, 4 ..., sizes in a scattered order, until ``left`` itself is reached).
    """
    taken = [0] * len(sizes)
    reached, first, pieces = np.zeros(left + 1, bool), np.full(left + 1, -1, np.int64), []
    reached[0] = True
    for i in sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: (sizes[i] * 2654435761 % (1 << 32), i)):
        most, part = min(spare[i], left // sizes[i]), 1
        while most > 0:
            n = min(part, most)
            w = n * sizes[i]
            fresh = reached[: left + 1 - w] & ~reached[w:]
            first[w:][fresh] = len(pieces)
            reached[w:] |= fresh
            pieces.append((i, n))
            most, part = most - n, part * 2
        if reached[left]:
            break
    at = int(np.flatnonzero(reached)[-1])
    missed = left - at
    while at:
        i, n = pieces[first[at]]
        taken[i] += n
        at -= n * sizes[i]
    return taken, missed


def fit_budget(sizes: list[int], counts: list[int], budget: int, start: float = 0.5) -> list[int]:
    """How many documents of each size (rising) to take so that the words come as near below ``budget`` as can be.

    All but the last words of the budget are a systematic draw, the remainder an exact fit on what it leaves. A
    remainder that can't be met is tried again larger. Where the whole budget is one, the fit is the best there is.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    budget, best = min(budget, total), ([0] * len(sizes), budget)
    if total <= 0:
        return best[0]
    for words in EXACT_WORDS:
        words = max(words, min(4 * sizes[-1], EXACT_WORDS[-1]))
        taken = drawn(counts, max(0, budget - words) / total, start)
        left = budget - sum(s * k for s, k in zip(sizes, taken, strict=True))
        for i in reversed(range(len(sizes))):  # a draw misses its aim by less than a largest document's size
            while left < 0 and taken[i]:
                taken[i], left = taken[i] - 1, left + sizes[i]
        more, missed = exact_fit(sizes, [c - k for c, k in zip(counts, taken, strict=True)], min(left, 4 * EXACT_WORDS[-1]))
        missed += left - min(left, 4 * EXACT_WORDS[-1])
        if missed < best[1]:
            best = [k + m for k, m in zip(taken, more, strict=True)], missed
        if not best[1] or words >= budget:
            break
    return best[0]


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    base = min(2, int(target // total)) if total else 0
    budget = 0 if base == 2 else int(round(target - base * total))
    taken = fit_budget(pdf["size"].tolist(), pdf["rows"].tolist(), budget, zlib.crc32(str(pdf["skey"].iloc[0]).encode()) / 2**32)
    return pd.DataFrame({"skey": pdf["skey"], "size": pdf["size"], "base": base, "quota": taken})


def targets(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to (skey, source, source_size): ``share`` of all sizes by weight, none above ``most`` times its size.

    Sources in code point order, null last, weigh ``weights`` in turn. The excess of those at their bound is
    reshared by weight until none is above: each turn is one sum over the table of sources (a row for each source),
    of which only two numbers reach the driver.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    table = shared.cut(shared.numbered(totals, [F.col("source").isNull(), F.col("source")]).withColumn("weight", turn).drop("place"))
    words = table.agg(F.sum("source_size")).first()[0] or 0
    bound, level, full = F.col("source_size") * most, 0.0, -1
    while True:
        over = bound <= F.col("weight") * level if full >= 0 else F.lit(False)
        row = table.agg(F.sum(F.when(over, bound).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count(F.when(over, 1))).first()
        if row[2] == full or not row[1]:
            break
        full, level = row[2], (share * words - row[0]) / row[1]
    return table.withColumn("target", F.least(bound, F.col("weight") * level).cast("double"))


def mix(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, repeats.

    A source whose target is r times its words or more has every document r times (0, 1 or 2); what is left of the
    target is fitted by ``fit_budget`` on the source's counts by exact length, and the documents of a length are
    taken by a seeded hash of doc_id and text, ranked in chunks (``shared.ranked``). Null texts have size 0; null
    sources are one source of their own; repeated rows count each; an empty table gives no rows.
    """
    shared.ship(docs.sparkSession)
    rows = shared.cut(
        shared.columns_only(docs, "doc_id", "text", "source").select(
            "doc_id", "source", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("skey"),
            F.coalesce(F.regexp_count("text", F.lit(shared.WORD)), F.lit(0)).cast("bigint").alias("size"),
            shared.order_hash(F.lit(seed), F.col("doc_id"), F.xxhash64("text")).alias("h"),
        )
    )
    counts = shared.cut(rows.groupBy("skey", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    totals = targets(counts.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, share).select("skey", "source_size", "target")
    quotas = counts.select("skey", "size", "rows").join(totals, "skey").groupBy("skey").applyInPandas(_fit, "skey string, size long, base int, quota long")
    placed = shared.ranked(rows.select("doc_id", "skey", "size", "h"), ["skey", "size"], "h", ["doc_id"])
    repeats = (F.col("base") + F.when(F.col("rank") < F.col("quota"), 1).otherwise(0)).cast("int")
    return placed.join(quotas, ["skey", "size"]).join(totals, "skey").select(
        "doc_id", "size", "source_size", "target", (repeats * F.col("size")).cast("bigint").alias("taken"), repeats.alias("repeats"), F.col("h")
    )


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it.

    Rows alike in doc_id and text are told apart by nothing, so their repeats are summed and dealt out evenly.
    """
    picks = mix(docs, seed).groupBy("h").agg(F.sum("repeats").alias("times"), F.count(F.lit(1)).alias("alike")).filter("times > 0")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), shared.order_hash(F.lit(seed), F.col("doc_id"), F.xxhash64("text")).alias("h")).join(picks, "h")
    single, several = held.filter("alike = 1"), held.filter("alike > 1")
    several = several.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy(F.xxhash64("row")))).withColumn("times", F.expr("times div alike + if(place <= times % alike, 1, 0)")).drop("place")
    return single.unionByName(several).filter("times > 0").select("row", F.explode(F.expr("sequence(1, cast(times as int))"))).select("row.*")
