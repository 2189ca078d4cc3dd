"""Quality by compression: dictionaries of good and of bad text, and the calibrated difference of what they save."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: The bounds of a fit: labelled rows of each class (chosen by a hash over all labelled rows), and the bytes of a
#: text up to which it may teach. Scoring has no bound.
TRAIN_ROWS, TRAIN_BYTES = 1_500, 32_768
#: Texts are measured in pieces, so that a dictionary counts as much at the end of a long text as at its start.
PIECE, DICTIONARY_BYTES, LEVEL = 1_024, 112_640, 3


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    center: list[float]
    scale: list[float]
    prior: float
    _tools: tuple = field(default=(), repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_tools": ()}

    def tools(self) -> tuple:
        if not self._tools:
            make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            dicts = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in (self.good, self.bad)]
            for d in dicts:
                d.precompute_compress(level=LEVEL)
            self._tools = (make(dicts[0]), make(dicts[1]), zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False))
        return self._tools

    def features(self, text: bytes) -> list[float]:
        """The normalised difference, bad less good, and what a text's own repetition saves."""
        good, bad, plain = self.tools()
        g = b = p = 0
        for i in range(0, len(text), PIECE):
            piece = text[i : i + PIECE]
            g, b, p = g + len(good.compress(piece)), b + len(bad.compress(piece)), p + len(plain.compress(piece))
        d, own = (b - g) / max(b, g), p / len(text)
        return [d, own, g / len(text), d * abs(d), math.log(own + 0.02), d * math.log(len(text))]

    def score(self, text: bytes) -> float:
        if not text:
            return self.prior
        x = (np.array(self.features(text)) - self.center) / self.scale
        return float(1 / (1 + math.exp(-max(-40.0, min(40.0, self.weights[-1] + float(x @ np.array(self.weights[:-1])))))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, turns: int = 60) -> np.ndarray:
    x, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(good: list[bytes], bad: list[bytes], good_rate: float) -> Model:
    """Dictionaries from every other text of a class, the calibration (Platt's logistic) from the rest at the true class rates."""
    good, bad = [t for t in good if t], [t for t in bad if t]
    if not good or not bad:
        return Model(b"", b"", [0.0] * 7, [0.0] * 6, [1.0] * 6, good_rate)

    def dictionary(texts: list[bytes]) -> bytes:
        pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself
            return b"".join(pieces)[-DICTIONARY_BYTES:]

    model = Model(dictionary(good[::2]), dictionary(bad[::2]), [0.0] * 7, [0.0] * 6, [1.0] * 6, good_rate)
    kept = [(t, 1) for t in good[1::2] or good] + [(t, 0) for t in bad[1::2] or bad]
    x, y = np.array([model.features(t) for t, _ in kept]), np.array([label for _, label in kept], float)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weight = np.where(y == 1, good_rate / max(1, y.sum()), (1 - good_rate) / max(1, (1 - y).sum())) * len(y)
    model.center, model.scale = center.tolist(), scale.tolist()
    model.weights = _logistic((x - center) / scale, y, weight).tolist()
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Learns ``labels.quality`` (doc_id, quality) from rows whose crc32(doc_id) mod 5 is not 0.

    Of each class the ``rows`` ids of least hash among all labelled ids are looked up, by a broadcast of at most
    2 * rows ids. Of an id that stands on several rows the least text teaches. Null ids and labels teach nothing. Without both classes the score is the share of label 1 (0.5 if
    nothing is labelled).
    """
    marked = shared.columns_only(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    tally = {r[0]: r[1] for r in marked.groupBy("quality").agg(F.count(F.lit(1))).collect()}
    rate = tally.get(1, 0) / max(1, sum(tally.values())) if tally else 0.5
    chosen = [marked.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    texts = shared.columns_only(docs, "doc_id", "text").filter(F.octet_length("text").between(1, most_bytes))
    found = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    by = {q: [r[2].encode() for r in sorted((r for r in found if r[1] == q), key=lambda r: (r[0], r[2]))] for q in (0, 1)}
    return train(by[1], by[0], rate)


def _score_batches(model):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.value.score(t or b"") for t in texts], pa.float64())], names=[batch.schema.names[0], "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; null and empty texts score the share of label 1."""
    shared.ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    out = shared.columns_only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_score_batches(shipped), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be of label 1; columns as they were."""
    shared.ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    scored = rows.mapInArrow(_score_batches(shipped), T.StructType([rows.schema["row"]]).add("score", "double"))
    return scored.filter(F.col("score") >= threshold).select("row.*")
