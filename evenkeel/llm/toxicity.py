"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own rate (from its summed squared gradients) and an
L1 term that keeps most weights at zero. The steps follow each other, so the
model is fitted by one task on a sample of labelled rows whose size is a
parameter. Texts become hashed coordinates where they lie; only these travel. The weights are ``2 ** bits`` at most and few are not zero, so they
may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import cut
from evenkeel.llm.words import M1, M2, M3, WordHashes, mix, utf8

BITS, SAMPLE, EPOCHS = 20, 24_000, 5
ROOM = 32_000_000  # coordinates of the sample, 128 MB
ALPHA, BETA, L1, L2 = 4.0, 1.0, 6.0, 0.0
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str | None, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Distinct hashed words, word pairs and pairs with one word between them. Coordinate 0 is the bias."""
    h = hashes.of(utf8(text).translate(_FOLD).split())
    parts = [h * M1]
    if len(h) > 1:
        parts.append(mix(h[:-1] * M2 + h[1:]))
    if len(h) > 2:
        parts.append(mix(h[:-2] * M3 + h[2:]))
    f = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    return np.unique(np.append(f[f > 0], 0))


def _weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def steps(docs: Iterable[np.ndarray], y: np.ndarray, z: np.ndarray, n: np.ndarray, alpha=ALPHA, beta=BETA, l1=L1, l2=L2) -> None:
    """FTRL-proximal updates of ``z`` and ``n`` in place, one document at a time."""
    for x, t in zip(docs, y):
        zx, nx = z[x], n[x]
        w = _weights(zx, nx, alpha, beta, l1, l2)
        if x[0] == 0:  # the bias is not penalised
            w[0] = -zx[0] / ((beta + np.sqrt(nx[0])) / alpha)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - t
        if abs(g) < 1e-4:
            continue
        s = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
        z[x] = zx + g - s * w
        n[x] = nx + g * g


def _bags(docs: DataFrame, bits: int) -> DataFrame:
    """``docs(key, text, y, ...)`` with ``x``, the distinct coordinates as 32-bit numbers, in place of the text."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            x = [features(t.as_py(), hashes, bits).astype("<i4").tobytes() for t in b.column(1)]
            size = pa.array([len(v) // 4 for v in x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(x, pa.binary()), size], ["key", "y", "turn", "x", "size"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text", "y", "turn").mapInArrow(run, f"key {kind}, y int, turn long, x binary, size long")


def train(docs: DataFrame, bits: int = BITS, epochs: int = EPOCHS, sample: int = SAMPLE, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of the non-zero weights from ``docs(key, text, y, turn)``.

    Tasks hash the texts; the one task that fits gets coordinates alone, the first
    ``sample`` rows in order of ``turn`` that hold ``room`` of them at most, so its
    memory is bounded too.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z, n = np.zeros(1 << bits), np.zeros(1 << bits)
        pdf = pdf.sort_values(order)
        x, y = [np.frombuffer(v, "<i4") for v in pdf["x"]], pdf["y"].to_numpy()
        for epoch in range(epochs):
            turns = np.random.default_rng(epoch).permutation(len(x))
            steps((x[i] for i in turns), y[turns], z, n)
        w = _weights(z, n, ALPHA, BETA, L1, L2)
        w[0] = -z[0] / ((BETA + np.sqrt(n[0])) / ALPHA)
        at = np.flatnonzero(w)
        return pd.DataFrame({"k": [at.astype("<i4").tobytes()], "w": [w[at].astype("<f4").tobytes()]})

    order = ["turn", "key", "y", "hash"]
    bags = cut(_bags(docs, bits).withColumn("hash", F.xxhash64("x")).dropDuplicates(order), "bags")
    first = bags.select(*order, "size").orderBy(*order).limit(sample).collect()  # numbers of a bounded sample
    fill = np.searchsorted(np.cumsum([r["size"] for r in first]), room, side="right")
    if not fill:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    last = first[min(fill, len(first)) - 1]
    fits = bags.where(F.struct(*order) <= F.struct(*[F.lit(last[c]).cast(bags.schema[c].dataType) for c in order]))
    got = fits.select(F.lit(0).alias("one"), *order, "x").groupBy("one").applyInPandas(one, "k binary, w binary").collect()  # one row of bounded size
    return np.frombuffer(got[0]["k"], "<i4"), np.frombuffer(got[0]["w"], "<f4")


def score_toxicity(df: DataFrame, source: DataFrame, labels: DataFrame, train_where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE, room: int = ROOM, bits: int = BITS, nested: bool = False) -> DataFrame:
    """``id_col`` of each row of ``df`` with ``score`` and ``predicted``; with ``nested`` the whole row, as a struct ``row``.

    Learns from at most ``sample`` rows (those with the least hash of the id
    among rows of ``labels`` with a 0/1 label whose id fulfils ``train_where``,
    joined to their texts in ``source``, repeated rows once) that hold at most
    ``room`` coordinates together. Null and empty texts get the bias alone;
    without any training row all scores are 0.5. Repeated rows are scored
    alike; other columns are no input.
    """
    spark = df.sparkSession
    y = (labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("y")).where(F.col("key").isNotNull())
         .withColumnRenamed("key", id_col).where(train_where).withColumnRenamed(id_col, "key").withColumn("turn", F.xxhash64("key")).orderBy("turn", "key", "y").limit(sample))
    chosen = source.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(y), "key")  # at most ``sample`` rows of three numbers
    sent = spark.sparkContext.broadcast(train(chosen, bits, sample=sample, room=room))  # 2 ** bits weights at most
    first = T.StructField("row", df.schema) if nested else df.schema[id_col]
    shape = T.StructType([first, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    part = df.columns.index(text_col)

    def run(batches):
        full = np.zeros(1 << bits, np.float32)
        full[sent.value[0]] = sent.value[1]
        hashes = WordHashes()
        for b in batches:
            texts = b.column(0).field(part) if nested else b.column(1)  # inside the row, so that no text comes twice
            s = np.array([full[features(t.as_py(), hashes, bits)].sum(dtype=float) for t in texts], float)
            p = 1 / (1 + np.exp(-np.clip(s, -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [first.name, "score", "predicted"])

    return (df.select(F.struct("*").alias("row")) if nested else df.select(id_col, text_col)).mapInArrow(run, shape)
