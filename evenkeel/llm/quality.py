"""Quality scores by a regularised quadratic discriminant over document statistics.

Per class, means and covariances come from sums over all labelled training
rows (partial sums per task, then one small aggregate). Covariances shrink to
their diagonal; their Cholesky factors are kept in the model, and a score is
the logistic of the difference of the two Mahalanobis log-densities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import cut
from evenkeel.llm.words import WordHashes, utf8

NAMES = ("log_bytes", "upper", "digit", "space", "stop", "symbol", "bar", "high", "word_len", "word_sd", "distinct", "top_word", "line_len", "distinct_lines", "entropy", "ends")
_UPPER, _DIGIT, _SPACE, _STOP, _SYMBOL, _BAR = (np.frombuffer(x, np.uint8) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\v\f", b".,;:?", b"!#$%&*@^~<>{}[]=+_", b"|"))


def statistics(text: str | None, hashes: WordHashes) -> list[float]:
    """Transformed statistics of one text: logs of sizes, square roots of shares. An empty text gives zeros."""
    raw = utf8(text)
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    m = len(words)
    p = hist[hist > 0] / n
    if m:
        size = np.fromiter(map(len, words), np.int64, m)
        counts = np.unique(hashes.of(words), return_counts=True)[1]
        word_len, word_sd, distinct, top = float(size.mean()), float(size.std()), len(counts) / m, counts.max() / m
        ends = sum(w[-1] in b".!?" for w in words) / m
    else:
        word_len = word_sd = distinct = top = ends = 0.0
    share = lambda i: float(np.sqrt(hist[i].sum() / n))
    return [np.log1p(n), share(_UPPER), share(_DIGIT), share(_SPACE), share(_STOP), share(_SYMBOL), share(_BAR), float(np.sqrt(hist[128:].sum() / n)),
            np.log1p(word_len), np.log1p(word_sd), distinct**0.5, top**0.5, np.log1p(n / len(lines)), (len(set(lines)) / len(lines)) ** 0.5, float(-(p * np.log2(p)).sum()), ends**0.5]


def with_statistics(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and ``x`` (array of the statistics)."""
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            x = [statistics(t.as_py(), hashes) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return df.select(*keep, text_col).mapInArrow(run, f"{fields}, x array<double>")


@dataclass
class Discriminant:
    """Cached Cholesky factors, means and log-determinants of the two classes."""

    mean: np.ndarray
    factor: np.ndarray
    offset: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        d = [self.offset[c] - 0.5 * (np.linalg.solve(self.factor[c], (z - self.mean[c]).T) ** 2).sum(0) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -700, 700)))


CLIP = 6.0


def _sums(df: DataFrame, fn, size: int) -> dict:
    """Sum of ``fn(matrix)`` per class over ``df(y, x)``: a vector of ``size`` numbers for each task, then one aggregate."""

    def part(batches):
        acc = {}
        for pdf in batches:
            for y, g in pdf.groupby("y"):
                acc[int(y)] = acc.get(int(y), 0) + fn(np.array(g["x"].to_list(), float))
        for y, v in acc.items():
            yield pd.DataFrame({"y": y, "k": np.arange(size), "v": v})

    rows = df.mapInPandas(part, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()  # 2 * size numbers
    out: dict = {}
    for r in rows:
        out.setdefault(r["y"], np.zeros(size))[r["k"]] = r["v"]
    return out


def fit(train: DataFrame, shrink: float = 0.15, ridge: float = 1e-3) -> Discriminant | None:
    """Fit on ``train(y int, x array)`` with y 0 or 1; None without rows of both classes."""
    d = len(NAMES)
    first = _sums(train, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    if set(first) != {0, 1}:
        return None
    total = first[0] + first[1]
    centre = total[1 : d + 1] / total[0]
    scale = np.sqrt(np.maximum(total[d + 1 :] / total[0] - centre**2, 1e-12))
    scale[scale < 1e-6] = 1.0

    def second(x):
        z = np.clip((x - centre) / scale, -CLIP, CLIP)
        return np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])

    got = _sums(train, second, 1 + d + d * d)
    mean, factor, offset = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        n = got[c][0]
        mean[c] = got[c][1 : d + 1] / n
        cov = got[c][d + 1 :].reshape(d, d) / n - np.outer(mean[c], mean[c])
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.eye(d)
        factor[c] = np.linalg.cholesky(cov)
        offset[c] = np.log(n / total[0]) - np.log(np.diag(factor[c])).sum()
    return Discriminant(mean, factor, offset, centre, scale)


def score_quality(df: DataFrame, labels: DataFrame, train_where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, **options) -> DataFrame:
    """Per row of ``df``: ``doc_id, score, predicted``.

    Learns from all rows with a 0/1 label whose id fulfils ``train_where`` (over
    the id column); several labels of one id all count. Null and empty texts
    get the score of zero statistics; without both classes all scores are 0.5.
    Other columns are no input.
    """
    docs = cut(with_statistics(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"]), "stats")
    y = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(train_where)
    model = fit(docs.where(train_where).join(y, "doc_id").select("y", "x"), **options)

    def run(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            s = model.score(flat) if model is not None else np.full(len(flat), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
