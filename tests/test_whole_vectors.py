"""Components behind a prefix count: the signal lies in the last ones alone."""

import numpy as np
import pytest

from evenkeel.operators import linear
from evenkeel.plans import catalogue, catalogue2, catalogue3  # noqa: F401


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 64))
    label = (x[:, 40] > 0).astype(int)
    x[:, 40] = 3 * np.sign(x[:, 40])
    x[:, 10] = 5 * x[:, 50] + 0.01 * x[:, 10]
    path = str(tmp_path_factory.mktemp("late"))
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, x, label


def run(spark, name, path):
    return catalogue.QUERIES[name](spark, path).collect()


def test_readout_and_ridge(spark, late):
    assert min(r.accuracy for r in run(spark, "multinomial_readout", late[0])) > 0.99
    assert min(r.r2 for r in run(spark, "ridge_readout", late[0])) > 0.9


def test_moments_and_whitening(spark, late):
    path, x, label = late
    got = run(spark, "gram_moments_full", path)
    assert len(got) == 2 * 64 * 65 // 2
    g = next(r.s for r in got if (r.label, r.i, r.j) == (1, 64, 50))
    assert abs(g - (x[label == 1, 63] * x[label == 1, 49]).sum()) < 1e-3
    w = {r.vec_id: r.w0 for r in run(spark, "pca_whitening", path)}
    for k in (0, 1):  # components 10 and 50 go together and lead
        at = np.flatnonzero(label == k)
        assert abs(np.corrcoef(x[at, 50], [w[i] for i in at])[0, 1]) > 0.95


def test_moments_of_odd_rows(spark):
    """Null groups are a group, null vectors are left out, null components add nothing, NaN stays."""
    rows = [(1, [1.0, 2.0]), (1, None), (1, [3.0, None]), (None, [5.0, 1.0]), (2, [float("nan"), 1.0])]
    got = {(r.g, r.i, r.j): r.s for r in linear.moments(spark.createDataFrame(rows, "g int, v array<double>"), ["g"], "v").collect()}
    assert len(got) == 18
    assert [got[1, i, j] for i, j in ((0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2))] == [2, 4, 10, 2, 2, 4]
    assert got[None, 2, 1] == 5 and np.isnan(got[2, 1, 0]) and got[2, 2, 2] == 1
    assert linear.moments(spark.createDataFrame([], "g int, v array<double>"), ["g"], "v").count() == 0
