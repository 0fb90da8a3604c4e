"""Multinomial logistic readout, fitted by Newton steps from sums over blocks of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Readout:
    """``weight`` (a row for each class), ``intercept`` and ``residual_sd`` by class, and the share of training rows told rightly."""

    classes: list
    weight: np.ndarray
    intercept: np.ndarray
    residual_sd: np.ndarray
    training_score: float


def softmax(eta: np.ndarray) -> np.ndarray:
    e = np.exp(eta - eta.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _rows(batches, classes: list):
    """Places of the labels and the vectors with a leading 1, batch by batch."""
    at = {c: i for i, c in enumerate(classes)}
    for b in batches:
        if b.num_rows:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            yield np.array([at[c] for c in b.column("y").to_pylist()]), np.hstack([np.ones((len(x), 1)), x])


def _added(df: DataFrame, fn) -> dict[str, np.ndarray]:
    """Arrays that ``fn`` makes of each partition, added up by name: what comes to the driver is as large as the model's second derivatives."""

    def run(batches):
        for k, v in fn(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.ravel()], pa.list_(pa.float64()))], ["k", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "v": [np.add.reduce(pdf["v"].to_list())]})

    got = df.mapInArrow(run, "k string, v array<double>").groupBy("k").applyInPandas(add, "k string, v array<double>").toArrow().to_pylist()
    return {r["k"]: np.array(r["v"]) for r in got}


def fit_readout(df: DataFrame, vector: str, label: str, strength: float = 1.0, steps: int = 50) -> Readout:
    """The weights that minimise the summed log loss plus ``|weight|^2 / (2 strength)``; intercepts are free.

    Rows without label or vector are left out; null components and vectors of
    several lengths are an error. With two classes the one decision of a
    two-class fit stands for both, with opposite signs. Each Newton step is a
    pass over the rows, in which tasks add up slopes and, for each pair of
    classes, curvatures; a step that does not lower the loss is halved. Labels
    are few: their distinct values come to the driver. Fewer than two are an error.
    """
    d = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.transform(vector, lambda c: c.cast("double")).alias("x"), F.col(label).alias("y")).persist()
    try:
        classes = sorted(r["y"] for r in d.select("y").distinct().collect())
        k = len(classes)
        if k < 2:
            raise ValueError("a readout needs two classes")
        shape = d.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b"), F.max(F.exists("x", lambda c: c.isNull()).cast("int")).alias("hole")).first()
        if shape["a"] != shape["b"] or shape["hole"]:
            raise ValueError("vectors differ in length or have null components")
        width = shape["a"] + 1
        ridge = 1 / (strength / 2 if k == 2 else strength)
        free = np.zeros((k, width))
        free[:, 1:] = ridge

        def slopes(w):
            def run(batches):
                loss, slope, curve = np.zeros(1), np.zeros((k, width)), {}
                for y, x in _rows(batches, classes):
                    eta = x @ w.T
                    p = softmax(eta)
                    loss += (np.log(np.exp(eta - eta.max(1, keepdims=True)).sum(1)) + eta.max(1) - eta[np.arange(len(y)), y]).sum()
                    slope += (p - np.eye(k)[y]).T @ x
                    for a in range(k):
                        for b in range(a + 1):
                            curve[f"{a},{b}"] = curve.get(f"{a},{b}", 0) + (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
                return {"loss": loss, "slope": slope} | curve
            return run

        w, step, part, least = np.zeros((k, width)), np.zeros((k, width)), 1.0, np.inf
        for _ in range(steps):
            tried = w + part * step
            got = _added(d, slopes(tried))
            loss = got["loss"][0] + (free * tried**2).sum() / 2
            if loss > least * (1 + 1e-13):
                part /= 2
                if part < 1e-6:
                    break
                continue
            w, least, part = tried, loss, 1.0
            slope = (got["slope"].reshape(k, width) + free * w).ravel()
            curve = np.zeros((k, width, k, width))
            for a in range(k):
                for b in range(a + 1):
                    curve[a, :, b, :] = got[f"{a},{b}"].reshape(width, width)
                    curve[b, :, a, :] = curve[a, :, b, :].T
            curve = curve.reshape(k * width, -1) + np.diag(free.ravel())
            level = np.zeros((k, width))
            level[:, 0] = 1  # intercepts that all move alike change nothing: their sum stays 0
            curve += np.outer(level, level) * max(1.0, np.trace(curve) / len(curve))
            step = -np.linalg.solve(curve, slope).reshape(k, width)
            if np.abs(step).max() < 1e-9 * (1 + np.abs(w).max()):
                break
        w = 2 * w if k == 2 else w

        def residuals(batches):
            s, q, n, hits = np.zeros(k), np.zeros(k), 0, 0
            for y, x in _rows(batches, classes):
                eta = x @ w.T
                r = np.eye(k)[y] - softmax(eta)
                s, q, n, hits = s + r.sum(0), q + (r * r).sum(0), n + len(y), hits + int((eta.argmax(1) == y).sum())
            return {"all": np.concatenate([s, q, [n, hits]])}

        t = _added(d, residuals)["all"]
        n = t[-2]
        sd = np.sqrt(np.maximum(t[k:2 * k] - t[:k] ** 2 / n, 0) / max(n - 1, 1))
        return Readout(classes, w[:, 1:], w[:, 0], np.maximum(sd, 1e-4), float(t[-1] / n))
    finally:
        d.unpersist()


def read_out(df: DataFrame, vector: str, model: Readout) -> DataFrame:
    """``df`` with ``probability`` (by class) and ``predicted`` (the class); both null where the vector is null."""

    @F.pandas_udf("array<double>")
    def chances(x: pd.Series) -> pd.Series:
        p = softmax(np.array(x.to_list(), float).reshape(len(x), -1) @ model.weight.T + model.intercept) if len(x) else []
        return pd.Series(list(p), dtype=object)

    there = F.col(vector).isNotNull()
    zero = F.array_repeat(F.lit(0.0), model.weight.shape[1])
    out = df.withColumn("probability", F.when(there, chances(F.when(there, F.transform(vector, lambda c: c.cast("double"))).otherwise(zero))))
    named = F.array(*map(F.lit, model.classes))
    best = F.array_position("probability", F.array_max("probability")).cast("int")
    return out.withColumn("predicted", F.when(there, F.element_at(named, best)))


def multinomial_readout(df: DataFrame, vector: str, label: str, strength: float = 1.0) -> DataFrame:
    """Class probabilities of a readout fitted on all rows."""
    return read_out(df, vector, fit_readout(df, vector, label, strength))
