"""Token ids in raw shards, with a minimal perfect hash from document key to place and a fingerprint for each key."""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

END_ID = 2
#: The file that names a folder's shards in order, each with the ids before it and the keys it spans.
MANIFEST = "manifest.jsonl"
#: Distinct words whose ids a worker holds before it starts over.
CACHE_WORDS = 500_000

# ---------------------------------------------------------------- encoding

#: Class of a code point below U+0240: letter, number, white space, other, as the vocabulary's split pattern has them.
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_CLASS = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _SPACE if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else _OTHER) for c in range(0x240)], np.uint8)


def word_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Byte places at which the split pattern of byte-level BPE begins a word, for UTF-8 of code points below U+0240.

    The pattern: contractions ('s 't 're 've 'm 'll 'd); runs of letters, of numbers or of others, each with one
    space before it; white space up to its last character before something else; the rest of white space. ``firsts``
    are the places where texts begin.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.uint16)
    wide = code >= 0xC0
    code[wide] = ((code[wide] & 0x1F) << 6) | (data[at[wide] + 1] & 0x3F)
    kind = _CLASS[code]
    n = len(at)
    begin = np.zeros(n + 3, bool)
    begin[np.searchsorted(at, firsts)] = True
    begin[n:] = True
    text_start = begin.copy()
    start = begin[:n].copy()
    before, inner = np.concatenate([[_OTHER], kind[:-1]]), ~text_start[:n]
    space = kind == _SPACE
    blank_before = np.concatenate([[False], code[:-1] == 32])
    start |= inner & ~space & (before != kind) & ~((before == _SPACE) & blank_before)
    following = np.concatenate([kind[1:], [_SPACE]])
    last_of_run = space & (following != _SPACE) & ~text_start[1 : n + 1]
    start |= inner & space & ((before != _SPACE) | last_of_run)
    quotes = np.flatnonzero((code == 39) & start)
    if len(quotes):
        padded = np.concatenate([code, np.zeros(3, np.uint16)])
        c1 = np.where(text_start[quotes + 1], 0, padded[quotes + 1])
        c2 = np.where(text_start[quotes + 1] | text_start[quotes + 2], 0, padded[quotes + 2])
        short = quotes[np.isin(c1, [ord(c) for c in "stmd"])]
        long = quotes[((c2 == ord("e")) & ((c1 == ord("r")) | (c1 == ord("v")))) | ((c1 == ord("l")) & (c2 == ord("l")))]
        start[short + 1] = False
        start[long + 1] = False
        start[short[short + 2 < n] + 2] = True
        start[long[long + 3 < n] + 3] = True
    return at[start]


class Encoder:
    """Encodes columns of texts: splits them by ``word_starts`` and asks the library once for each distinct word.

    Texts with code points of U+0240 or more, and those that hold the text of an added token, go to the library
    whole. Ids equal the library's for whole texts, as it is when loaded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.marks = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if t.content]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.first, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            found = [e.ids for e in self.library.encode_batch([w.decode() for w in part], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
            a, b = len(self.known), self.used
            while b + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while a + len(part) > len(self.first):
                self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
            self.flat[b : b + len(ids)] = ids
            self.first[a : a + len(part)], self.size[a : a + len(part)] = b + np.cumsum(sizes) - sizes, sizes
            self.known.update(zip(part, range(a, a + len(part)), strict=True))
            self.used = b + len(ids)

    def _fast(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        if not len(filled):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        starts = word_starts(data, filled)
        ends = np.concatenate([starts, [len(data)]]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        fresh = [w for w in distinct if w not in self.known]
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self._clear()
            fresh = distinct
        self._learn(fresh)
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        sizes = self.size[place]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.first[place] - total[:-1], sizes)]
        cuts = total[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _marked(self, data: bytes) -> list[list[int]]:
        """Where added tokens stand; one across two texts sends the first of them whole, which changes nothing."""
        found: list[list[int]] = []
        for mark in self.marks:
            at = data.find(mark)
            while at >= 0:
                found.append([at])
                at = data.find(mark, at + 1)
        return found

    def column(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none), without an end id."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        apart = [np.flatnonzero(data >= 0xC9), *self._marked(data.tobytes())]
        whole = np.unique(np.searchsorted(offsets, np.concatenate(apart), "right") - 1)
        if not len(whole):
            return self._fast(data, offsets)
        other = np.ones(len(column), bool)
        other[whole] = False
        out: list = [None] * len(column)
        for k in whole.tolist():
            out[k] = np.array(self.library.encode(column[k].as_py(), add_special_tokens=False).ids, np.uint32)
        rest = column.filter(pa.array(other))
        if len(rest):
            for k, ids in zip(np.flatnonzero(other).tolist(), self.column(rest), strict=True):
                out[k] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:  # a reused worker keeps it for its next task
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- the hash


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct keys to 0..n-1, without gaps: levels of bits, where a bit is set if one key alone falls on it.

    Keys that share a bit go on to the next level, half the size of what is left twice over; a key's number is the
    count of bits set before its own. About three bits a key, and one or two looks for most keys.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.before, at = levels, [], 0
        for bits in levels:
            ranks = np.concatenate([[0], np.cumsum(bits)]) + at
            self.before.append(ranks)
            at = int(ranks[-1])
        self.n = at

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.asarray(keys).astype(np.int64).view(np.uint64), []
        while len(left):
            size = max(2, 2 * len(left))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("the keys are not distinct")
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """A key's number; for a stranger some number or -1, which the fingerprint tells apart."""
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        for k, bits in enumerate(self.levels):
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                break
            at = (_mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.before[k][at[hit]]
        return out

    def pack(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(b)) + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> tuple[PerfectHash, int]:
        at, levels = 4, []
        for _ in range(struct.unpack_from("<I", data)[0]):
            n = struct.unpack_from("<Q", data, at)[0]
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at + 8), count=n).astype(bool))
            at += 8 + -(-n // 8)
        return cls(levels), at


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_mix(np.asarray(keys).astype(np.int64).view(np.uint64), 1 << 20) >> np.uint64(32)).astype(np.uint32)


# ---------------------------------------------------------------- shards
# NAME.ids: ids alone, little-endian, of 2 or 4 bytes as the vocabulary needs.
# NAME.mph: a JSON line (counts and width), then for each key in hash order its fingerprint (u4), first document (u4)
#   and number of documents (u4), each document's first id (u8, one more at the end), the keys in order (i8), the hash.


def pack_index(doc_ids: list, sizes: list[int], width: int) -> bytes:
    nulls = sum(d is None for d in doc_ids)
    ids = np.array(doc_ids[nulls:], np.int64)
    keys, first, count = np.unique(ids, return_index=True, return_counts=True)
    hashed = PerfectHash.build(keys)
    at, starts = hashed.numbers(keys), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    table = np.zeros(len(keys), [("print", "<u4"), ("first", "<u4"), ("count", "<u4")])
    table["print"][at], table["first"][at], table["count"][at] = _prints(keys), first + nulls, count
    head = json.dumps({"documents": len(doc_ids), "nulls": nulls, "keys": len(keys), "width": width}).encode() + b"\n"
    return head + table.tobytes() + starts.astype("<u8").tobytes() + keys.astype("<i8").tobytes() + hashed.pack()


class Shard:
    """Keyed access to one shard: ``find`` costs a few bit looks and one compare, however many documents there are."""

    def __init__(self, store, path: str):
        with store.open_input_file(path + ".mph") as f:
            data = f.read()
        self.store, self.path, end = store, path, data.index(b"\n") + 1
        self.head = json.loads(data[:end])
        n, docs = self.head["keys"], self.head["documents"]
        self.table = np.frombuffer(data, [("print", "<u4"), ("first", "<u4"), ("count", "<u4")], n, end)
        self.starts = np.frombuffer(data, "<u8", docs + 1, end + 12 * n).astype(np.int64)
        self.keys = np.frombuffer(data, "<i8", n, end + 12 * n + 8 * (docs + 1))
        self.hash, _ = PerfectHash.unpack(data[end + 12 * n + 8 * (docs + 1) + 8 * n :])

    def find(self, keys) -> list[tuple[int, int] | None]:
        """(first document, how many) of each key, or None where the fingerprint says it isn't here."""
        keys = np.asarray(keys, np.int64)
        at = self.hash.numbers(keys)
        good = at >= 0
        good[good] = self.table["print"][at[good]] == _prints(keys[good])
        return [(int(self.table["first"][i]), int(self.table["count"][i])) if g else None for i, g in zip(at.tolist(), good.tolist(), strict=True)]

    def holds(self, key: int) -> bool:
        """Whether the key found is the very one: a stranger's fingerprint of 32 bits may be another's."""
        at = int(np.searchsorted(self.keys, key))
        return at < len(self.keys) and int(self.keys[at]) == key

    def ids(self, handle, document: int) -> np.ndarray:
        a, b = self.starts[document : document + 2].tolist()
        handle.seek(a * self.head["width"])
        return np.frombuffer(handle.read((b - a) * self.head["width"]), f"<u{self.head['width']}").astype("<u4")


def _write_batches(folder: str, tokenizer: str, end_id: int, width: int):
    def run(batches):
        store, path = shared.open_store(folder)
        context, own = TaskContext.get(), encoder(tokenizer)
        name = f"{path}/shard-{context.partitionId():06d}-{context.taskAttemptId()}"  # each attempt has its own; the manifest names those that count
        out, docs, sizes = None, [], []
        for batch in batches:
            out = out or store.open_output_stream(name + ".ids")
            for part in shared.slices(batch, "text"):
                for ids in own.column(part.column("text")):
                    out.write(ids.astype(f"<u{width}").tobytes() + end_id.to_bytes(width, "little"))
                    sizes.append(len(ids) + 1)
            docs += batch.column("doc_id").to_pylist()
        if out is None:
            return
        out.close()
        with store.open_output_stream(name + ".mph") as f:
            f.write(pack_index(docs, sizes, width))
        known = [d for d in docs if d is not None]  # in ascending order, after the nulls
        yield pa.RecordBatch.from_pydict({"least": pa.array([known[0] if known else None], pa.int64()), "most": pa.array([known[-1] if known else None], pa.int64()), "nulls": pa.array([len(docs) - len(known)], pa.int64()), "shard": [name.rpartition("/")[2]], "part": pa.array([context.partitionId()], pa.int32()), "tokens": pa.array([sum(sizes)], pa.int64()), "documents": pa.array([len(docs)], pa.int64())})

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> list[tuple[str, int]]:
    """Writes ``docs`` (doc_id, text) in ascending doc_id order, nulls first; (shard, ids of all shards before it), in order.

    Texts are dealt by ranges of (doc_id, text hash), so neither one id nor a hot source makes a large task, and are
    encoded where they land: only texts are shuffled, once. A row for each shard reaches the driver.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    shared.ship(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).mkdirs(path)
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    rows = shared.columns_only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    ordered = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    made = ordered.mapInArrow(_write_batches(shared.normal_uri(folder), tokenizer, end_id, width), "least long, most long, nulls long, shard string, part int, tokens long, documents long").collect()
    out, at = [], 0
    for r in sorted(made, key=lambda r: r["part"]):
        out.append({"shard": r["shard"], "base": at, "least": r["least"], "most": r["most"], "nulls": r["nulls"]})
        at += r["tokens"]
    store, top = shared.open_store(shared.normal_uri(folder))
    with store.open_output_stream(f"{top}/{MANIFEST}") as f:
        f.write("".join(json.dumps(x) + "\n" for x in out).encode())
    return [(x["shard"], x["base"]) for x in out]


def manifest(folder: str) -> list[tuple[str, int]]:
    """What ``write_shards`` gave back, from the folder itself; files that it does not name are left by lost attempts."""
    return [(x["shard"], x["base"]) for x in _spans(folder)]


def _spans(folder: str) -> list[dict]:
    store, top = shared.open_store(shared.normal_uri(folder))
    with store.open_input_file(f"{top}/{MANIFEST}") as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def shards_of(keys: list, spans: list[dict]) -> list[range | list[int]]:
    """For each key the shards that may hold it, by two looks into the sorted spans: one as a rule, and each next to it whose span begins with the key that the one before ends with."""
    held = [k for k, x in enumerate(spans) if x["least"] is not None]
    least, most = (np.array([spans[k][c] for k in held], np.int64) for c in ("least", "most"))
    nulls = [k for k, x in enumerate(spans) if x["nulls"]]
    asked = np.array([0 if k is None else k for k in keys], np.int64)
    a, b = np.searchsorted(most, asked, "left"), np.searchsorted(least, asked, "right")
    return [nulls if key is None else held[i:j] for key, i, j in zip(keys, a.tolist(), b.tolist(), strict=True)]


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents of ``keys`` (doc_id) in a folder of shards, without reading any other.

    Each key goes to its shard by the manifest's spans (a row for each shard, sent to the tasks), there through the hash
    to its offset. Keys asked for more than once count once; one that stands on several rows gives each of them, also
    where they lie in two shards; null gives the documents without an id; one that is not there gives nothing.
    """
    spark, spans = keys.sparkSession, _spans(folder)
    shared.ship(spark)
    uri = shared.normal_uri(folder)

    def route(batches):
        for batch in batches:
            asked = batch.column("doc_id").to_pylist()
            rows = [(key, k) for key, of in zip(asked, shards_of(asked, spans), strict=True) for k in of]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())], ["doc_id", "shard"])

    def fetch(batches):
        store, path = shared.open_store(uri)
        shard, number = None, None
        for batch in batches:
            places, asked = batch.column("shard").to_numpy(), batch.column("doc_id").to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if places[a] != number:
                    number = int(places[a])
                    shard = Shard(store, f"{path}/{spans[number]['shard']}")
                own = [k for k in asked[a:b] if k is not None]
                wanted = [(key, hit[0] + i) for key, hit in zip(own, shard.find(own), strict=True) if hit and shard.holds(key) for i in range(hit[1])]
                wanted += [(None, i) for i in range(shard.head["nulls"])] if None in asked[a:b] else []
                with store.open_input_file(f"{path}/{spans[number]['shard']}.ids") as f:
                    for k in range(0, len(wanted), 256):
                        part = wanted[k : k + 256]
                        ids = [shard.ids(f, doc) for _, doc in part]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key for key, _ in part], pa.int64()), pa.array([spans[number]["base"] + int(shard.starts[doc]) for _, doc in part], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    own = shared.columns_only(keys, "doc_id").select(F.col("doc_id").cast("bigint")).distinct()
    routed = own.mapInArrow(route, "doc_id long, shard int").repartition("shard").sortWithinPartitions("shard")
    return routed.mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids array<long>")


def _read_batches(folder: str):
    def run(batches):
        store, path = shared.open_store(folder)
        for batch in batches:
            for name, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(store, f"{path}/{name}")
                found = shard.find(shard.keys)
                if None in found or sum(n for _, n in found) + shard.head["nulls"] != shard.head["documents"]:
                    raise OSError(f"the index of {name} does not fit its keys")
                wanted = [(None, k) for k in range(shard.head["nulls"])] + [(key, a + k) for key, (a, n) in zip(shard.keys.tolist(), found, strict=True) for k in range(n)]
                with store.open_input_file(f"{path}/{name}.ids") as f:
                    for k in range(0, len(wanted), 4096):
                        part = wanted[k : k + 4096]
                        crc = [zlib.crc32(shard.ids(f, doc).tobytes()) for _, doc in part]
                        places = np.array([doc for _, doc in part], np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key for key, _ in part], pa.int64()), pa.array(base + shard.starts[places]), pa.array(shard.starts[places + 1] - shard.starts[places]), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return run


def read_shards(spark: SparkSession, folder: str, shards: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each found through its shard's hash and read at its offset."""
    shared.ship(spark)
    table = spark.createDataFrame(shards, "shard string, base long")
    return table.repartition(max(1, len(shards)), "shard").mapInArrow(_read_batches(shared.normal_uri(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` and describes each document as read back from the files.

    Null and empty texts have the end id alone. Rows of one id follow each other, by a hash of the text; null ids
    come first and are found by place. An empty table writes nothing and gives no rows.
    """
    folder = folder or shared.new_folder(docs.sparkSession, "tokens")
    return read_shards(docs.sparkSession, folder, write_shards(docs, folder, tokenizer))
