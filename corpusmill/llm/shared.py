"""Folders that every executor shares, lineage cuts, code shipping and ranks inside hot groups."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words of a text: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and the master is local."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if not root and held.isDefined():
        root = held.get()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    if held.isEmpty():
        sc.setCheckpointDir(root)
        atexit.register(_remove_quietly, spark, sc._jsc.sc().getCheckpointDir().get())  # this session's own folder
    return root


def remove(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def _remove_quietly(spark: SparkSession, uri: str) -> None:
    try:
        remove(spark, uri)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def new_folder(spark: SparkSession, label: str) -> str:
    """The URI of a new folder below the shared one; it goes when the driver's Python ends."""
    uri = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, uri)
    return uri


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, held in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, rows: int, per_task: int = 200_000) -> DataFrame:
    """The same ``rows`` rows in no more partitions than they fill: an exchange leaves a file for each task that feeds it."""
    return df.coalesce(max(1, -(-rows // per_task)))


def cut_small(df: DataFrame) -> DataFrame:
    """``cut``, then ``gathered``: for tables that may be far smaller than what they are made from."""
    held = cut(df)
    return gathered(held, held.count())


def open_store(uri: str):
    """(file system, path) of a URI, through Arrow's file systems: local, HDFS, S3, GCS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def publish(store, made: str, name: str) -> None:
    """Gives a whole file its name. Where a task is run again the name may be taken, by the same bytes: then ``made`` goes."""
    from pyarrow import fs

    if store.get_file_info(name).type == fs.FileType.NotFound:
        store.move(made, name)
    else:
        store.delete_file(made)


def normal_uri(uri: str) -> str:
    """file:/x as file:///x, which Arrow asks for."""
    return "file:///" + uri[6:].lstrip("/") if uri.startswith("file:/") else uri


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusmill_shipped", False):
        return
    top, data = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(Path(top.name) / p.relative_to(top))), p.read_bytes())
    name = f"{top.name}-{hashlib.sha256(data.getvalue()).hexdigest()[:12]}.zip"
    folder = tempfile.mkdtemp(prefix="corpusmill-ship-")
    Path(folder, name).write_bytes(data.getvalue())
    sc.addPyFile(str(Path(folder, name)))
    sc._corpusmill_shipped = True


def slices(batch, column: str, most: int = 1 << 20):
    """The Arrow batch in runs of whole rows with about ``most`` bytes of text, so that work arrays stay small."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    runs = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def columns_only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns; any other, whatever its name, is left behind before work begins."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def bytes_of(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def order_hash(*parts: Column) -> Column:
    """A 60-bit number from an MD5 of the parts; null counts as the empty string."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("bigint")


def numbered(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """Adds ``out``, the row's place from 0 in ``order``; ties as they come. Sorted in ranges, by many tasks.

    Only the number of rows of each range reaches the driver: one for each partition.
    """
    pid, at = "_pid", "_at"
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(pid, F.spark_partition_id()).withColumn(at, F.expr("monotonically_increasing_id() & 8589934591")))
    before, starts = 0, {}
    for p, n in sorted((r[0], r[1]) for r in sorted_.groupBy(pid).agg(F.count(F.lit(1))).collect()):
        starts[p], before = before, before + n
    first = df.sparkSession.createDataFrame(list(starts.items()), f"{pid} int, _first long")
    return sorted_.join(F.broadcast(first), pid).withColumn(out, F.col("_first") + F.col(at)).drop(pid, at, "_first")


def ranked(df: DataFrame, keys: list[str], h: str, ties: list[str], out: str = "rank", share: int = 4, least: int = 256) -> DataFrame:
    """Adds ``out``, the row's place from 0 among the rows of equal ``keys`` (never null) by (h, ties).

    h is a 60-bit hash. A group that holds more than a ``share``-th of a shuffle partition's fair part of the rows is
    cut by the leading bits of h into as many chunks as it needs; chunk counts, summed first on the map side, give
    each chunk's first place, and only chunks are sorted. So a group with a third of all rows is ranked by many
    tasks. There are ``share`` groups of that size for each partition at most, so what is broadcast is that small.
    df is read three times: it should be cut.
    """
    n, bits, chunk, first = "_n", "_bits", "_chunk", "_first"
    sizes = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)))
    fair = (sizes.agg(F.sum(n)).first()[0] or 0) // (share * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most = max(least, fair)
    many = F.broadcast(sizes.filter(F.col(n) > most).select(*keys, F.ceil(F.log2(F.col(n) / most)).cast("int").alias(bits)))
    cutup = df.join(many, keys, "left").withColumn(chunk, F.when(F.col(bits).isNull(), F.lit(0).cast("bigint")).otherwise(F.expr(f"shiftright({h}, 60 - {bits})"))).drop(bits)
    counts = df.join(many, keys).withColumn(chunk, F.expr(f"shiftright({h}, 60 - {bits})")).groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counts.select(*keys, chunk, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first)))
    place = F.row_number().over(Window.partitionBy(*keys, chunk).orderBy(h, *ties)) - 1
    return cutup.withColumn(out, place).join(starts, [*keys, chunk], "left").withColumn(out, (F.col(out) + F.coalesce(F.col(first), F.lit(0))).cast("bigint")).drop(chunk, first)
