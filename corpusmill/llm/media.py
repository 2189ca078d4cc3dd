"""Media columns: PNG members in ZIP archives, read by a data source that plans byte ranges and retries member by member."""

from __future__ import annotations

import contextlib
import hashlib
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import shared

#: Samples of a row of the picture; an archive is closed, and a byte range ends, at about these sizes.
WIDTH, ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64, 64 << 20, 16 << 20, 4 << 20
_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(text: bytes) -> bytes:
    """An 8-bit grey picture, 64 samples wide, of the text and its padding; a private chunk holds the length of the text."""
    payload = payload_of(text)
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"teXl", struct.pack(">Q", len(text))) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(payload, bytes of the text); every chunk's checksum is verified."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, parts, n, size = 8, [], 0, (0, 0)
    while at < len(media):
        length, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + length]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + length)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", data)
        elif kind == b"teXl":
            n = struct.unpack(">Q", data)[0]
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("only filter type 0 is written here")
    return rows[:, 1:].tobytes(), n


def features_of(payload: bytes) -> str:
    """Of all samples: mean, deviation, entropy in bits, and the mean step along a row."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    steps = np.abs(np.diff(x.reshape(-1, WIDTH).astype(np.int16), axis=1)).mean()
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={abs(-(share * np.log2(share)).sum()):.4f};step={steps:.4f}"


def _write_batches(folder: str, limit: int):
    def run(batches):
        store, path = shared.open_store(folder)
        part, roll, members, seen = TaskContext.get().partitionId(), 0, 0, 0
        attempt, out, zipped, name = TaskContext.get().taskAttemptId(), None, None, None

        def close():
            zipped.close()
            out.close()
            shared.publish(store, f"{path}/.{attempt}-{name}", f"{path}/{name}")

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                if out is None:
                    name = f"media-{part:06d}-{roll:04d}.zip"
                    out, roll, seen = store.open_output_stream(f"{path}/.{attempt}-{name}"), roll + 1, 0
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                media = encode_png(text or b"")
                zipped.writestr(zipfile.ZipInfo(f"{members:08d}/{'' if doc is None else doc}.png"), media)
                members, seen = members + 1, seen + len(media)
                if seen >= limit:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"members": pa.array([members], pa.int64())})

    return run


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Writes each row's text (null: empty) as a PNG into ZIP archives in ``folder``; the number of members."""
    spark = docs.sparkSession
    shared.ship(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).mkdirs(path)
    rows = shared.columns_only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_write_batches(shared.normal_uri(folder), archive_bytes), "members long").agg(F.sum("members")).first()[0] or 0


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        super().__init__(None)
        self.path, self.begin, self.end = path, begin, end


class ArchiveReader(DataSourceReader):
    """Plans from file sizes alone; each task reads an archive's directory and the members that begin in its range."""

    def __init__(self, folder: str, range_bytes: int, retries: int):
        self.folder, self.range_bytes, self.retries = folder, range_bytes, retries

    def partitions(self):
        from pyarrow import fs

        store, path = shared.open_store(self.folder)
        files = [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.base_name.endswith(".zip") and not f.base_name.startswith(".")]
        return [Range(f.path, a, min(a + self.range_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        store, _ = shared.open_store(self.folder)
        with store.open_input_file(partition.path) as f:
            members = [i for i in self._directory(store, partition.path, f) if partition.begin <= i.header_offset < partition.end]
            held, size = [], 0
            for info in members:
                media = self._member(store, partition.path, f, info)
                doc = info.filename.rpartition("/")[2][:-4]
                held.append((int(doc) if doc else None, partition.path.rpartition("/")[2], info.header_offset, media))
                size += len(media)
                if size >= BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    def _directory(self, store, path: str, f) -> list[zipfile.ZipInfo]:
        """The archive's members; after a failure read again, through a new handle."""
        for turn in range(self.retries + 1):
            try:
                with contextlib.nullcontext(f) if not turn else store.open_input_file(path) as handle:
                    return zipfile.ZipFile(handle).infolist()
            except OSError:
                if turn == self.retries:
                    raise
                time.sleep(0.05 * 2**turn)
        raise AssertionError

    def _member(self, store, path: str, f, info) -> bytes:
        """The member at its own offset, checked; after a failure it alone is read again, through a new handle."""
        for turn in range(self.retries + 1):
            try:
                with contextlib.nullcontext(f) if not turn else store.open_input_file(path) as handle:
                    handle.seek(info.header_offset)
                    head = handle.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise OSError(f"no member at {info.header_offset} of {path}")
                    name, extra = struct.unpack_from("<HH", head, 26)
                    handle.seek(info.header_offset + 30 + name + extra)
                    media = handle.read(info.file_size)
                    if len(media) != info.file_size or zlib.crc32(media) != info.CRC:
                        raise OSError(f"checksum of the member at {info.header_offset} of {path}")
                    return media
            except OSError:
                if turn == self.retries:
                    raise
                time.sleep(0.05 * 2**turn)
        raise AssertionError


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, archive, offset, media = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(archive, pa.string()), pa.array(offset, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "archive", "member_offset", "media"])


class MediaArchives(DataSource):
    """format("media_archives"): options folder, range_bytes, retries."""

    @classmethod
    def name(cls):
        return "media_archives"

    def schema(self):
        return "doc_id long, archive string, member_offset long, media binary"

    def reader(self, schema):
        o = self.options
        return ArchiveReader(o["folder"], int(o.get("range_bytes", RANGE_BYTES)), int(o.get("retries", 3)))


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, retries: int = 3) -> DataFrame:
    shared.ship(spark)
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("folder", shared.normal_uri(folder)).option("range_bytes", range_bytes).option("retries", retries).load()


_DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe_batches(batches):
    names = [x.split()[0] for x in _DESCRIBED.split(", ")]
    for batch in batches:
        rows = []
        for doc, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            payload, n = decode_png(media)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features_of(payload)))
        if rows:
            kinds = [pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def describe(media: DataFrame) -> DataFrame:
    """doc_id, media -> sizes, digests and features of what was stored, one row per member; a damaged member fails the task."""
    return media.select("doc_id", "media").mapInArrow(_describe_batches, _DESCRIBED)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores ``docs`` (doc_id, text) in archives and describes what is read back.

    Null texts are stored as empty ones: one row of zero samples. Equal texts give equal members. Repeated and null
    ids keep a member each, for members are found by offset. An empty table gives no rows.
    """
    folder = folder or shared.new_folder(docs.sparkSession, "media")
    write_archives(docs, folder)
    return describe(read_archives(docs.sparkSession, folder))
