"""Benchmark decontamination: a prefix-filtered join of rare shingles, then exact containment of whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: A shingle has three words, or as many as its window has. Benchmark text of one block: some 60 bytes a word are broadcast.
SHINGLE, BLOCK_BYTES = 3, 4 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_IS_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts: hashes, places in the lowered bytes, and the text each belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, n = _LOWER[data], len(offsets) - 1
        inside = _IS_WORD[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        first[cuts] = inside[cuts]
        self.starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.ends = np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.text, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        lengths = self.ends - self.starts
        self.hashes = np.zeros(0, np.uint64)
        if len(lengths):
            at = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _STEP)]))
            self.hashes = _mixed(np.add.reduceat(_VALUES[self.data[inside]] * powers[place], at) + lengths.astype(np.uint64))

    @classmethod
    def of_column(cls, column: pa.Array) -> Words:
        column = pc.fill_null(column, "")
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
        return cls(data, offsets - offsets[0])

    def runs(self, k: int) -> np.ndarray:
        """The hash of the k words from each place on; places too near the end of the batch are left out."""
        n = len(self.hashes) - k + 1
        h = np.zeros(max(n, 0), np.uint64)
        for j in range(k if n > 0 else 0):
            h = h * _STEP + self.hashes[j : j + n]
        return _mixed(h + np.uint64(k))

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each place on are of one text."""
        n = len(self.hashes) - k + 1
        return self.text[:n] == self.text[k - 1 :] if n > 0 else np.zeros(0, bool)

    def bytes(self, at: int, k: int) -> bytes:
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + k))


def _member(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in values, places in known, which is sorted) of the values that are known; a bit table passes few others."""
    table = np.zeros(1 << 20, bool)
    table[known >> np.uint64(44)] = True
    at = np.flatnonzero(table[values >> np.uint64(44)])
    where = np.searchsorted(known, values[at])
    where[where == len(known)] = 0
    good = known[where] == values[at] if len(known) else np.zeros(len(at), bool)
    return at[good], where[good]


class Block:
    """The distinct windows of some items, as arrays: about 60 bytes a word of theirs, here and in what is broadcast."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        w = self.words = Words.of_column(pa.array([t for _, t in items], pa.large_string()))
        self.names, owner = np.unique(np.array([i for i, _ in items], object), return_inverse=True)
        size = np.minimum(w.counts, width)
        many = np.where(w.counts > 0, w.counts - size + 1, 0)
        start = np.repeat(w.first[:-1], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        size, owner = np.repeat(size, many), np.repeat(owner, many)
        value = np.zeros(len(start), np.uint64)
        for k in np.unique(size):
            value[size == k] = w.runs(int(k))[start[size == k]]
        order = np.lexsort((owner, value, size))
        start, size, owner, value = start[order], size[order], owner[order], value[order]
        new = np.ones(len(start), bool)
        new[1:] = (size[1:] != size[:-1]) | (value[1:] != value[:-1])
        number = np.cumsum(new) - 1
        self.start, self.sizes, self.hashes = start[new], size[new], value[new]
        self._same(start, number)
        pair = np.ones(len(start), bool)
        pair[1:] = new[1:] | (owner[1:] != owner[:-1])
        self.owners, self.owner_ends = owner[pair], np.searchsorted(number[pair], np.arange(len(self.start) + 1))
        self.tables = {}
        self.keys = {s: keys for s in range(1, SHINGLE + 1) if len(keys := self.shingles(s))}

    def _same(self, start: np.ndarray, number: np.ndarray) -> None:
        """Raises if windows of equal hash differ in a word's hash or length."""
        w, lengths = self.words, self.words.ends - self.words.starts
        size, first = self.sizes[number], self.start[number]
        for j in range(int(size.max()) if len(size) else 0):
            own = size > j
            if (w.hashes[start[own] + j] != w.hashes[first[own] + j]).any() or (lengths[start[own] + j] != lengths[first[own] + j]).any():
                raise ValueError("two windows share a hash")

    def of_shingle(self, s: int) -> np.ndarray:
        """The windows that are filed under shingles of s words."""
        return np.flatnonzero(np.minimum(self.sizes, SHINGLE) == s)

    def shingles(self, s: int) -> np.ndarray:
        """The distinct hashes, in order, of the shingles of s words in the windows filed under such."""
        own, runs = self.of_shingle(s), self.words.runs(s)
        has = np.zeros(len(runs), bool)
        for at in range(int(self.sizes[own].max()) - s + 1 if len(own) else 0):
            has[self.start[own[self.sizes[own] - s >= at]] + at] = True
        return np.unique(runs[has])

    def file(self, seen: dict[int, np.ndarray]) -> None:
        """Files each window under its rarest shingle; seen: how often each of ``keys`` occurs in the corpus.

        Containment asks for every shingle of the window, so the rarest alone is the prefix.
        """
        for s, keys in self.keys.items():
            own, runs = self.of_shingle(s), self.words.runs(s)
            least, place = np.full(len(own), np.iinfo(np.int64).max), np.zeros(len(own), np.int64)
            value = np.zeros(len(own), np.uint64)
            for at in range(int(self.sizes[own].max()) - s + 1):
                has = np.flatnonzero(self.sizes[own] - s >= at)
                h = runs[self.start[own[has]] + at]
                n = seen[s][np.searchsorted(keys, h)]
                better = (n < least[has]) | ((n == least[has]) & (h < value[has]))
                least[has[better]], place[has[better]], value[has[better]] = n[better], at, h[better]
            order = np.argsort(value, kind="stable")
            known, first = np.unique(value[order], return_index=True)
            self.tables[s] = (known, np.append(first, len(order)), np.stack([place[order], own[order]], axis=1))
        self.keys = {}
        self.words.text = self.words.hashes = None  # what verifies a match is the words themselves

    def items(self, window: int) -> list[str]:
        return self.names[self.owners[self.owner_ends[window] : self.owner_ends[window + 1]]].tolist()

    def shingle_counts(self, w: Words) -> dict[int, np.ndarray]:
        counts = {}
        for s, keys in self.keys.items():
            at, where = _member(w.runs(s), keys)
            counts[s] = np.bincount(where[w.within(s)[at]], minlength=len(keys))
        return counts

    def occurrences(self, w: Words) -> Iterator[tuple[int, int]]:
        """(place, window) of every occurrence, verified word by word."""
        for s, (keys, first, entries) in self.tables.items():
            at, where = _member(w.runs(s), keys)
            n = first[where + 1] - first[where]
            pick = np.repeat(first[where], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start, number = np.repeat(at, n) - entries[pick, 0], entries[pick, 1]
            size = self.sizes[number]
            ok = (start >= 0) & (start + size <= len(w.hashes))  # the positional bound, then the length bound
            start, number, size = start[ok], number[ok], size[ok]
            ok = w.text[start] == w.text[start + size - 1] if len(start) else np.zeros(0, bool)
            start, number, size = start[ok], number[ok], size[ok]
            for k in np.unique(size):
                own = size == k
                a, b = start[own], number[own]
                h = np.zeros(len(a), np.uint64)
                for j in range(int(k)):
                    h = h * _STEP + w.hashes[a + j]
                for x, y in zip(*(z[_mixed(h + np.uint64(k)) == self.hashes[b]].tolist() for z in (a, b)), strict=True):
                    if w.bytes(x, int(k)) == self.words.bytes(int(self.start[y]), int(k)):
                        yield x, y


def _count_batches(index):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in (part for whole in batches for part in shared.slices(whole, "text")):
            for s, n in index.value.shingle_counts(Words.of_column(batch.column(0))).items():
                total[s] = total[s] + n if s in total else n
        for s, n in total.items():
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"s": pa.array(np.full(len(found), s), pa.int32()), "shingle": pa.array(found, pa.int32()), "n": pa.array(n[found], pa.int64())})

    return run


_SCANNED = "doc_id long, th long, n_words long, spans array<struct<a:long,b:long>>, items array<string>"
_SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _scan_batches(index):
    def run(batches):
        for batch in (part for whole in batches for part in shared.slices(whole, "text")):
            w, own = Words.of_column(batch.column("text")), index.value
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[set] = [set() for _ in range(batch.num_rows)]
            for at, number in own.occurrences(w):
                doc = int(w.text[at])
                items[doc].update(own.items(number))
                spans[doc].append((at - int(w.first[doc]), at - int(w.first[doc]) + int(own.sizes[number])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(w.counts, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in merged(x)] for x in spans], _SPAN), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=["doc_id", "th", "n_words", "spans", "items"],
            )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge_batches(batches):
    for pdf in batches:
        pdf["spans"] = [[{"a": a, "b": b} for a, b in merged([(x["a"], x["b"]) for x in s])] for s in pdf["spans"]]
        yield pdf


def indexes(texts: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> list:
    """A broadcast index for each block of the benchmark, its windows filed under the shingle rarest in ``texts``."""
    spark = texts.sparkSession
    items = shared.columns_only(benchmark, "item_id", "text").filter(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    out = []
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = Block([tuple(r) for r in part.toLocalIterator()], width)
        every = spark.sparkContext.broadcast(block)
        counted = texts.mapInArrow(_count_batches(every), "s int, shingle int, n long").groupBy("s", "shingle").agg(F.sum("n").alias("n")).toPandas()
        seen = {s: np.zeros(len(keys), np.int64) for s, keys in block.keys.items()}
        for s, rows in counted.groupby("s"):
            seen[int(s)][rows["shingle"].to_numpy()] = rows["n"].to_numpy()
        every.unpersist()
        block.file(seen)
        out.append(spark.sparkContext.broadcast(block))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, th (hash of the text), n_words, spans (disjoint spans of hit words), items.

    benchmark (item_id, text) is dealt into blocks of about ``block_bytes`` of text by a hash of the item; a block's
    windows are indexed and broadcast, so what is sent stays bounded however large the benchmark is. For each block
    a first pass counts the block's shingles in the whole corpus, and a second joins each window's rarest one. Null
    or wordless texts have no words and no hits; null items count under the id ''; rows of equal id and text are
    counted and given back as often as they came.
    """
    shared.ship(docs.sparkSession)
    texts = shared.columns_only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    scanned = [texts.mapInArrow(_scan_batches(rarest), _SCANNED) for rarest in indexes(texts.select("text"), benchmark, width, block_bytes)]
    blocks = len(scanned)
    if blocks == 1:
        return scanned[0]
    out = scanned[0]
    for more in scanned[1:]:
        out = out.unionByName(more)
    one = out.groupBy("doc_id", "th").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list(F.when(F.size("spans") > 0, F.col("spans")))).alias("spans"), F.array_distinct(F.flatten(F.collect_list(F.when(F.size("items") > 0, F.col("items"))))).alias("items"), (F.count(F.lit(1)) / blocks).cast("int").alias("times"))
    return one.select("doc_id", "th", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "times"))).drop("col").mapInPandas(_merge_batches, _SCANNED)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``; see ``scan``."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["b"] - x["a"])
    return scan(docs, benchmark, width).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def _clean_batches(index):
    def run(batches):
        for batch in (part for whole in batches for part in shared.slices(whole, "text")):
            w = Words.of_column(batch.column(1))
            clean = np.ones(batch.num_rows, bool)
            clean[[int(w.text[at]) for at, _ in index.value.occurrences(w)]] = False
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(clean))], names=["row"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark: each block's pass lets clean rows through, without a shuffle."""
    shared.ship(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    left = rows.select("row")
    for rarest in indexes(rows.select("text"), benchmark, width, block_bytes):
        left = left.select("row", F.col("row.text").alias("text")).mapInArrow(_clean_batches(rarest), left.schema)
    return left.select("row.*")
