"""Multinomial readout against a plain fit, and after a report in the same session."""

import numpy as np
import pytest

from evenkeel.operators import readout
from evenkeel.sources import files


def plain(x, y, k, strength):
    """Gradient steps with momentum over all rows."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w, v, penalty = np.zeros((k, z.shape[1])), 0, np.r_[0, np.ones(x.shape[1])] / strength
    rate = 1 / (np.linalg.norm(z, 2) ** 2 / 2 + 1 / strength)
    last = w
    for i in range(200_000):
        ahead = w + i / (i + 3) * (w - last)
        p = np.exp(ahead @ z.T)
        g = (p / p.sum(0) - np.eye(k)[y].T) @ z + penalty * ahead
        last, w = w, ahead - rate * g
        if np.abs(g).max() < 1e-9:
            break
    return w


@pytest.mark.parametrize("k", [2, 4])
def test_equals_a_plain_fit(spark, tmp_path, k):
    assert files.report(spark.range(5).toDF("a"), str(tmp_path / "csv")) == 5  # a report before a fit did no harm
    assert files.report(spark.createDataFrame([("a\nb",), (None,)], "t string"), str(tmp_path / "json"), "json") == 2
    rng = np.random.default_rng(k)
    y = rng.integers(0, k, 300)
    x = rng.normal(size=(300, 5)) + np.eye(5)[y] * 1.5
    names = ["d", "b", "a", "c"][:k]
    rows = [(names[c], r.tolist()) for c, r in zip(y, x)] + [(None, [0.0] * 5), ("a" if k > 2 else "b", None)]
    df = spark.createDataFrame(rows, "label string, v array<double>").repartition(5)
    m = readout.fit_readout(df, "v", "label", 2.0)
    assert m.classes == sorted(names)
    at = np.array([sorted(names).index(names[c]) for c in y])
    if k == 2:  # one decision with both signs
        w = plain(x, at, 2, 1.0)
        want = 1 / (1 + np.exp(-2 * (np.hstack([np.ones((300, 1)), x]) @ (w[1] - w[0]))))
        want = np.column_stack([1 - want, want])
    else:
        eta = np.hstack([np.ones((300, 1)), x]) @ plain(x, at, k, 2.0).T
        want = np.exp(eta) / np.exp(eta).sum(1, keepdims=True)
    got = readout.softmax(x @ m.weight.T + m.intercept)
    assert np.abs(got - want).max() < 1e-6
    assert np.allclose(m.residual_sd, np.maximum((np.eye(k)[at] - want).std(0, ddof=1), 1e-4), atol=1e-6)
    assert m.training_score == pytest.approx((want.argmax(1) == at).mean())
    scored = readout.read_out(df, "v", m).where("label is not null").collect()
    assert sum(r.v is None and r.probability is None and r.predicted is None for r in scored) == 1
    assert sum(r.v is not None and r.predicted == r.label for r in scored) == round(300 * m.training_score)


def test_parted_classes_and_errors(spark):
    df = spark.createDataFrame([(i % 3, [10.0 * (i % 3), 1.0]) for i in range(30)], "label int, v array<double>")
    m = readout.fit_readout(df, "v", "label", 1e6)
    assert m.training_score == 1 and (m.residual_sd >= 1e-4).all() and np.isfinite(m.weight).all()
    with pytest.raises(ValueError, match="two classes"):
        readout.fit_readout(df.where("label = 0"), "v", "label")
    with pytest.raises(ValueError, match="length"):
        readout.fit_readout(df.unionByName(spark.createDataFrame([(1, [1.0])], df.schema)), "v", "label")
