"""Near copies by the Jaccard similarity of five-word shingles: SimHash balls and MinHash bands propose pairs, shingle sets decide.

At similarity 0.8 two SimHash fingerprints of 64 bits differ by about 10, so a ball that met them would have millions of
variants. Balls of radius 1 link what 2 bits or fewer part, which joins the bulk of a group of copies; bands then find the rest.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, simhash

WIDTH = 5
#: Hashes of a signature, and those of a band. At similarity 0.8 a pair shares no band with probability (1 - 0.8^4)^24 = 3.2e-6.
HASHES, BAND = 96, 4
#: Hashes in which a pair must agree before its texts are compared; at 0.8 fewer agree with probability 4e-7.
AGREE = 56
#: Pairs of one text that a task compares with it.
PER_TEXT = 512

_random = np.random.default_rng(8)
_TIMES, _PLUS, _MIX = (_random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
_LONGS = [f"g{k}" for k in range(HASHES // 8)]
#: Bits of a parity sketch: a shingle flips one. Two sketches never differ in more bits than their sets in members.
PARITY = 1024
_FLIPS = [f"o{k}" for k in range(PARITY // 64)]


def parity(grams: np.ndarray) -> np.ndarray:
    """The PARITY bits, as longs, each flipped by the members of ``grams`` that fall on it."""
    at = ((grams * _MIX[0]) >> np.uint64(54)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    return np.unique(np.array(simhash.shingle_hashes(text, WIDTH), np.uint64))


def signature(grams: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES hash functions over ``grams``, which must not be empty."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), 1024):
        least = np.minimum(least, (grams[k : k + 1024, None] * _TIMES + _PLUS).min(axis=0))
    return least


def _sign_batches(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        names, sizes, bands, longs, prints = [], [], [], np.zeros((len(texts), len(_LONGS) + len(_FLIPS)), np.int64), []
        for k, text in enumerate(texts):
            hashes = simhash.shingle_hashes(text or b"", WIDTH)
            grams = np.unique(np.array(hashes, np.uint64))
            prints.append(simhash.majority(hashes))
            names.append(xxhash.xxh64_intdigest(grams.tobytes()))
            sizes.append(len(grams))
            if not len(grams):
                bands.append([])
                continue
            least = signature(grams)
            bands.append((least * _MIX).reshape(-1, BAND).sum(axis=1, dtype=np.uint64).view(np.int64).tolist())
            longs[k] = np.concatenate([((least * _MIX) >> np.uint64(56)).astype(np.uint8).view(np.int64), parity(grams)])
        s = pa.array(np.array(names, np.uint64).view(np.int64), pa.int64())
        columns = [batch.column("doc_id"), batch.column("th"), s, pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), *[pa.array(longs[:, j]) for j in range(longs.shape[1])]]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "s", "n", "fp", "bands", *_LONGS, *_FLIPS])


def _differing(a: Column, b: Column) -> Column:
    """In how many of their eight bytes two longs differ."""
    x = a.bitwiseXOR(b)
    for k, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, k).bitwiseAND(F.lit(mask)))
    return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def _near(a: str, b: str) -> Column:
    """Whether sizes and parities leave 0.8 open; a size below 0.8 of the other rules it out.

    At 0.8 the sets differ in a ninth of their members, n + m together, or fewer, and parities in no more bits; where
    that is many, flips meet: then the bound is what they leave, and six standard deviations (16 bits at most) more.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = (n + m) / 9.0
    flipped = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{o}").bitwiseXOR(F.col(f"{b}.{o}"))) for o in _FLIPS])
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (flipped <= F.least(most, PARITY / 2 * (1 - F.exp(-2 * most / PARITY)) + 96))


def _agree(a: str, b: str) -> Column:
    """Whether the signatures leave 0.8 open; they tell long texts apart, whose parities are full."""
    return reduce(lambda x, y: x + y, [_differing(F.col(f"{a}.{g}"), F.col(f"{b}.{g}")) for g in _LONGS]) <= HASHES - AGREE


def _compare_batches(batches):
    held: dict[int, np.ndarray] = {}  # texts that stand in many pairs are cut up once
    for batch in batches:
        good = []
        for a, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True):
            if a not in held:
                if len(held) >= 16:
                    held.clear()
                held[a] = shingles(text_a.encode())
            x, y = held[a], shingles(text_b.encode())
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(5 * both >= 4 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (s, text) have a similarity of 0.8 or more, by their whole shingle sets.

    A text that stands as ``a`` in many pairs is dealt to as many tasks as they fill.
    """
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_TEXT).cast("int").alias("fan"))
    dealt = pairs.join(fans, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("part"))
    left = fans.join(texts.withColumnRenamed("s", "a"), "a").select("a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"))
    full = dealt.join(texts.select(F.col("s").alias("b"), F.col("text").alias("text_b")), "b").join(left, ["a", "part"])
    return full.select("a", "b", "text_a", "text_b").mapInArrow(_compare_batches, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """(root, doc_id, th) of each row of ``docs`` (doc_id, text): rows of one root are connected by similarities of 0.8 or more.

    Rows of equal shingle sets are one from the start; those without words are alike. Sets whose SimHash prints are
    alike or linked (``simhash.links``, 2 bits) and sets that share a band are compared with the least of the print
    or band first, which joins large groups by as many pairs as they have members; what is then still apart within
    a band is compared pair by pair, by sketch, and by whole sets where the sketch leaves it open.
    """
    shared.ship(docs.sparkSession)
    rows = shared.columns_only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed = shared.cut(rows.mapInArrow(_sign_batches, "doc_id long, th long, s long, n long, fp long, bands array<long>, " + ", ".join(f"{g} long" for g in [*_LONGS, *_FLIPS])))
    body = F.struct("n", *_LONGS, *_FLIPS)
    sets = signed.groupBy("s").agg(F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.first(body).alias("x"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("p"))
    sets = shared.cut(sets)
    keyed = sets.select(F.explode("bands").alias("key"), "s").repartition("key")
    counts = keyed.groupBy("key").agg(F.min("s").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    held = shared.cut_small(keyed.join(counts, "key").select("key", "s", "hub"))
    prints = shared.cut(sets.filter(F.size("bands") > 0).groupBy("fp").agg(F.min("s").alias("hub")))
    balls = simhash.links(prints.select("fp"), 2)
    first_of = lambda fp, name: prints.select(F.col("fp").alias(fp), F.col("hub").alias(name))
    balls = balls.join(first_of("a", "x"), "a").join(first_of("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    alike = sets.filter(F.size("bands") > 0).select("fp", "s").join(prints, "fp").filter("s <> hub").select(F.col("hub").alias("a"), F.col("s").alias("b"))
    one = lambda name: sets.select(F.col("s").alias(name), F.col("x").alias(f"x_{name}"))
    stars = held.filter("s <> hub").select(F.col("hub").alias("a"), F.col("s").alias("b")).unionByName(balls).unionByName(alike).distinct()
    stars = shared.cut_small(stars.join(one("b"), "b").join(one("a"), "a").filter(_near("x_a", "x_b")).filter(_agree("x_a", "x_b")).select("a", "b"))
    first = shared.cut_small(confirmed(stars, _texts(rows, sets, stars)))
    roots = simhash.components(first).withColumnRenamed("node", "s")
    placed = held.select("key", "s").join(roots, "s", "left").withColumn("root", F.coalesce("root", "s"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    # flat columns: compared in place, without a structure around them, some 15 times as fast
    placed = placed.join(mixed, "key", "left_semi").join(sets.select("s", "x.n", *[f"x.{o}" for o in _FLIPS]), "s")
    met = (F.col("l.key") == F.col("r.key")) & (F.col("l.s") < F.col("r.s")) & (F.col("l.root") != F.col("r.root")) & _near("l", "r")
    rest = placed.alias("l").join(placed.alias("r"), met).select(F.col("l.s").alias("a"), F.col("r.s").alias("b")).distinct()
    rest = shared.cut_small(rest.join(stars, ["a", "b"], "left_anti"))
    rest = shared.cut_small(rest.join(one("b"), "b").join(one("a"), "a").filter(_agree("x_a", "x_b")).select("a", "b"))
    second = confirmed(rest, _texts(rows, sets, rest))
    roots = simhash.components(first.unionByName(second)).withColumnRenamed("node", "s")
    return signed.select("doc_id", "th", "s").join(roots, "s", "left").select(F.coalesce("root", "s").alias("root"), "doc_id", "th")


def _texts(rows: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s, text) of the sets that stand in ``pairs``, each from its row of least doc_id."""
    wanted = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct().join(sets.select("s", F.col("p.doc_id").alias("d"), F.col("p.th").alias("t")), "s")
    hit = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    return shared.cut_small(hit.select("s", "text").dropDuplicates(["s"]))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each of ``classes`` the row of least doc_id stays, as it was."""
    return simhash.keep_least(docs, classes(docs))
