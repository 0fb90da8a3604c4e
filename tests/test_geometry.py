"""Similarity of times, subspaces and inverses against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import linear


def test_similarity_moments_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6, 9))  # trial, time, feature
    x[3, 2] = 1.5  # constant: like no other
    rows = [(f"u{k % 3}", k, t, x[k, t].tolist()) for k in range(40) for t in range(6) if (k, t) != (7, 5)] + [("u0", 0, 9, None)]
    df = spark.createDataFrame(rows, "unit string, trial int, t int, v array<double>").repartition(7)
    got = {(r.unit, r.t, r.s): r for r in linear.similarity_moments(df, ["unit"], ["trial"], "t", "v").collect()}
    assert len(got) == 3 * 36
    for u in range(3):
        z = x[u::3] - x[u::3].mean(-1, keepdims=True)
        z /= np.maximum(np.linalg.norm(z, axis=-1, keepdims=True), 1e-8)
        c = np.einsum("btf,bsf->bts", z, z)
        if u == 7 % 3:
            c[7 // 3, 5, :] = c[7 // 3, :, 5] = np.nan
        for t in range(6):
            for s in range(6):
                r = got[f"u{u}", t, s]
                assert (r.mean, r.variance) == pytest.approx((np.nanmean(c[:, t, s]), np.nanvar(c[:, t, s])), abs=1e-12)
                assert r.n == np.isfinite(c[:, t, s]).sum()
    pooled = {(r.t, r.s): r for r in linear.pooled_cells(linear.similarity_moments(df, ["unit"], ["trial"], "t", "v")).collect()}
    m, v = (np.array([getattr(got[f"u{u}", 0, 1], k) for u in range(3)]) for k in ("mean", "variance"))
    assert pooled[0, 1].variance == pytest.approx((v + (m - m.mean()) ** 2).mean())
    twice = df.unionByName(df.where("trial = 1 and t = 1"))
    with pytest.raises(Exception, match="repeats a time"):
        linear.similarity_moments(twice, ["unit"], ["trial"], "t", "v").collect()
    assert linear.similarity_moments(df.limit(0), ["unit"], ["trial"], "t", "v").count() == 0


def test_similarity_rows_are_linear_in_times(spark):
    """No join of a trial with itself: operators hand on rows, cells come from tasks."""
    d = spark.range(6400).select((F.col("id") / 16).cast("int").alias("trial"), (F.col("id") % 16).alias("t"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    plan = linear.similarity_cells(d, ["trial"], "t", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_removed_subspace_is_orthogonal(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 12))
    bases = {"a": linear.random_basis(12, 3, "a"), "b": linear.random_basis(12, 1, "b"), "all": linear.random_basis(12, 12, "c")}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "i int, v array<float>")
    got = linear.without_subspace(df, "v", bases).collect()
    assert len(got) == 31 * 3
    for r in got:
        if r.i == 99:
            assert r.removed is None
            continue
        y, b = np.array(r.removed), bases[r.basis]
        assert np.abs(b @ y).max() < 1e-9 and np.allclose(x[r.i].astype(np.float32), y + b.T @ (b @ x[r.i].astype(np.float32)), atol=1e-6)
    assert np.array_equal(bases["a"], linear.random_basis(12, 3, "a")) and not np.allclose(bases["a"], linear.random_basis(12, 3, "d"))
    many = np.array([linear.random_basis(12, 1, str(i))[0] for i in range(400)])
    assert np.abs(many.mean(0)).max() < 0.1 and np.abs((many**2).mean(0) - 1 / 12).max() < 0.04  # no direction is preferred
    with pytest.raises(ValueError, match="orthonormal"):
        linear.without_subspace(df, "v", {"x": np.ones((1, 12))})


def test_whitening_and_back(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + 3
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "g int, i int, v array<double>")
    for k in (5, 2):
        model = linear.whitening(df, ["g"], "v", k)
        back = {r.i: np.array(r.restored) for r in linear.unwhitened(linear.whitened(df, model, ["g"], "v"), model, ["g"]).collect()}
        c = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:k]
        want = (x - x.mean(0)) @ c.T @ c + x.mean(0)
        assert all(np.allclose(back[i], want[i], atol=1e-6) for i in range(200))
