"""Block-wise draws against draws one by one, exact flips against enumeration, places in groups."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import numbering, resample


def test_exact_flips_equal_enumeration(spark):
    rng = np.random.default_rng(1)
    cases = {f"r{n}": rng.normal(0.2, 1, n) for n in (1, 2, 5, 11, 16)} | {"ties": np.array([1.0, 1, 1, 2, 2, -3, 0, 0]), "zero": np.zeros(5), "small": np.array([0.1, 0.2, -0.3, 0.3])}
    rows = [(g, float(v)) for g, x in cases.items() for v in x] + [("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for two in (False, True):
        got = {r.g: r for r in resample.exact_sign_flip(df, ["g"], "v", two).collect()}
        assert set(got) == set(cases)
        for g, x in cases.items():
            means = [round(abs(m) if two else m, 9) for m in ((x * s).mean() for s in itertools.product((-1, 1), repeat=len(x)))]
            goal = round(abs(x.mean()) if two else x.mean(), 9)
            assert got[g].p_value == pytest.approx(sum(m >= goal for m in means) / 2 ** len(x), abs=1e-12), (g, two)
            assert got[g].n_units == len(x)
    x = rng.normal(0.5, 1, 40)  # a large case agrees with draws
    p = resample.flips_at_least(x) / 2**40
    assert abs(p - np.mean([(x * s).mean() >= x.mean() for s in rng.choice([-1, 1], (20_000, 40))])) < 0.01
    many = spark.range(41).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="too many"):
        resample.exact_sign_flip(many, ["g"], "v").collect()


@pytest.mark.parametrize("held,slots,shares", [(1 << 20, 4096, 256), (7, 5, 3)])
def test_bootstrap_equals_draws_one_by_one(spark, monkeypatch, held, slots, shares):
    monkeypatch.setattr(resample, "HELD", held)
    monkeypatch.setattr(resample, "SLOTS", slots)
    monkeypatch.setattr(resample, "SHARES", shares)
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=23), "b": rng.normal(size=6), "one": np.array([2.5])}
    rows = [(g, f"u{i:03d}", None if (g, i) == ("a", 4) else float(v)) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, u string, v double").repartition(6)
    got = {r.g: r for r in resample.bootstrap_ci(df, ["g"], "v", "u", 300, 3).collect()}
    for g, x in groups.items():
        x = x.copy()
        if g == "a":
            x[4] = np.nan
        means = [np.nanmean([x[int(hashlib.sha256(f"3|{d}|{i}".encode()).hexdigest()[:8], 16) % len(x)] for i in range(len(x))]) for d in range(1, 301)]
        assert got[g].ci_low == pytest.approx(np.quantile(means, 0.025), abs=1e-9) and got[g].ci_high == pytest.approx(np.quantile(means, 0.975), abs=1e-9)


def test_flips_equal_draws_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [(g, u, float(v)) for g in "ab" for u, v in enumerate(rng.normal(0.1, 1, 30))] + [("a", 99, None), ("b", 3, 0.25)]
    df = spark.createDataFrame(rows, "g string, u int, v double")
    for two in (False, True):
        for r in resample.sign_flip(df, ["g"], "v", "u", 700, 7, two).collect():
            x = [(u, v) for g, u, v in rows if g == r.g and v is not None]
            size = (lambda m: round(abs(m), 9)) if two else (lambda m: round(m, 9))
            null = [sum(v if hashlib.sha256(f"7|{d}|{u}".encode()).hexdigest()[0] < "8" else -v for u, v in x) / len(x) for d in range(1, 701)]
            assert r.p_value == pytest.approx((1 + sum(size(m) >= size(r.mean) for m in null)) / 701) and r.n_units == len(x)


def test_places_in_groups(spark):
    rows = [("hot", i * 7919 % 1000) for i in range(1000)] + [("b", 5), ("b", 1), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "g string, o int").repartition(5)
    got = numbering.numbered_rows(df, ["g"], ["o"], size="n").collect()
    assert len(got) == len(rows) and {r.g: r.n for r in got} == {"hot": 1000, "b": 2, None: 2}
    for g in ("hot", "b", None):
        x = sorted((r.i, r.o) for r in got if r.g == g)
        assert [i for i, _ in x] == list(range(len(x))) and [o for _, o in x] == sorted(o for _, o in x)
    assert sorted(r.i for r in numbering.numbered_rows(df, [], ["o"]).collect()) == list(range(1004))
    assert numbering.numbered_rows(df.limit(0), ["g"], ["o"]).count() == 0
