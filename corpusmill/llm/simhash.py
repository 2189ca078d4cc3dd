"""SimHash near-duplicates by meeting in the middle: every fingerprint emits its half-radius ball, keys meet, links are verified."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Fingerprints in one task that emits balls, and rows of a partition where variants meet.
PER_TASK, PER_MEETING = 32_768, 1_000_000


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> list[int]:
    """XXH64 of every run of ``width`` words (ASCII white space apart, A-Z lowered), of the whole if it has fewer."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits, each 1 if it is set in over half of the shingles' hashes; 0 for no words."""
    return majority(shingle_hashes(text, width))


def majority(hashes: list[int]) -> int:
    """The bits set in over half of ``hashes``; 0 for none."""
    if not hashes:
        return 0
    values, ones = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for k in range(0, len(values), 16_384):  # little-endian bytes and bits: bit i of the hash is place i
        ones += np.unpackbits(values[k : k + 16_384], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes)))


def _print_batches(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            prints = [fingerprint(t or b"", width) for t in texts]
            fp = pa.array(np.array(prints, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), fp], names=["doc_id", "th", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, th, fp) of each row; th is a hash of the text, fp the fingerprint as a signed long; null has no words."""
    shared.ship(docs.sparkSession)
    return shared.columns_only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(_print_batches(width), "doc_id long, th long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks])


#: One bit: 64 masks. Two bits of the same half: 992; of three bits two always share a half.
ONE = [1 << i for i in range(64)]
TWO = [1 << a | 1 << b for h in (0, 32) for a, b in combinations(range(h, h + 32), 2)]


def links(prints: DataFrame, reach: int = 3) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp), enough to connect whatever ``reach`` (2 or 3) or fewer bits connect.

    Radius 3, so balls of radius 1 and 2 must meet, and parity tells who emits which. Fingerprints of even weight
    emit themselves and all variants by two bits of one half; those of odd weight emit all variants by one bit. An
    even and an odd fingerprint are 1 or 3 bits apart or farther than 3: for 1 bit the odd one's variant is the even
    one, for 3 bits two share a half, the even one flips these and the odd one the third. Equal parities are 2 bits
    apart or farther than 3: both emit one-bit variants. What meets at a variant is linked by the sum of its
    distances, at most 3, so no pair is built to be thrown away; a key's members (64 of one bit at most) are linked
    to its least one, not to each other. The final filter counts the bits again. Radius 2 needs no two-bit variants.
    """
    spread = [0, *TWO] if reach == 3 else [0]
    n = prints.count()
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = prints.select("fp").repartition(max(parts, n // PER_TASK), "fp")
    meet = max(parts, n * (len(spread) + 2 * len(ONE)) // 2 // PER_MEETING)
    # a row is the variant and the number of its mask, not the fingerprint itself: two bytes to tell, however many partitions part a ball
    emit = lambda df, masks: df.select("fp", F.posexplode(_masks(masks)).alias("code", "mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("key"), F.col("code").cast("smallint").alias("code")).repartition(meet, "key")
    origin = lambda masks: F.col("key").bitwiseXOR(F.element_at(_masks(masks), F.col("code") + 1))
    near = emit(source, ONE)
    hubs = near.groupBy("key").agg(F.min(origin(ONE)).alias("hub"), F.count(F.lit(1)).alias("members"))
    far = emit(source.filter(F.bit_count("fp") % 2 == 0), spread)
    across = far.join(hubs.select("key", "hub").hint("shuffle_hash"), "key").select(origin(spread).alias("a"), F.col("hub").alias("b"))
    along = near.join(hubs.filter("members > 1").select("key", "hub"), "key").select(origin(ONE).alias("a"), F.col("hub").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return across.unionByName(along).filter((apart > 0) & (apart <= reach)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node reachable. Alternating large and small stars.

    Each turn is two grouped minima and joins; hub nodes are summed on the map side. The table is cut into the
    shared folder every turn and compared with the last by its count and the sum of its hashes. It never grows, and
    its exchanges are fed by as many tasks as its rows fill.
    """
    pairs = shared.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        few = lambda df: shared.gathered(df, 2 * now[0])  # noqa: B023, E731  used within the turn
        pairs = few(pairs)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = few(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = shared.cut(few(lower.select("u", F.col("m").alias("v")).unionByName(rest)).distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, th, fp, fingerprint (16 hex digits), root, component_id.

    Texts without words, null ones too, have fingerprint zero and are linked like any other. Equal fingerprints
    meet once, by their least doc_id, before any ball is made: thousands of copies cost what one costs.
    component_id is the least doc_id (nulls aside) that links reach; root names the component itself, also where
    ids repeat or are null. An empty table gives no rows.
    """
    prints = shared.cut(fingerprints(docs, width))
    firsts = shared.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(firsts))
    rooted = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.select("fp", "root").join(heads, "root")
    return prints.join(known, "fp").select("doc_id", "th", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """The rows of ``docs`` without those that near-duplicate another: each component keeps its row of least doc_id.

    Where that id repeats, the row of least text hash stays, once. Ids and texts decide; other columns only come along.
    """
    return keep_least(docs, classes(docs, width))


def keep_least(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """Of the rows of ``docs``, one for each root of ``classed`` (root, doc_id, th): that of least doc_id, then text hash, then row hash."""
    found = classed.groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    pick = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n")).alias("p"))
    wanted = pick.select("root", F.col("p.doc_id").alias("d"), F.col("p.th").alias("t"), F.col("p.n").alias("n"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id_"), F.xxhash64("text").alias("th_"))
    hit = rows.join(wanted, F.col("doc_id_").eqNullSafe(F.col("d")) & (F.col("th_") == F.col("t")))
    several = hit.filter("n > 1").groupBy("root").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return hit.filter("n = 1").select("row.*").unionByName(several.select("row.*"))
