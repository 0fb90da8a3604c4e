"""Means that lie on a bound don't depend on the order of the rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from evenkeel.functions.levels import steady_mean
from evenkeel.plans import catalogue, catalogue2  # noqa: F401


def test_mean_of_just_50_is_not_high(spark, tmp_path):
    values = [16.03, 95.72, 38.25]  # 150 in cents; added up as doubles some orders give more
    orders = list(itertools.permutations(values))
    assert len({sum(o) / 3 > 50 for o in orders}) == 2
    rows = [(u, k, v) for u, o in enumerate(orders) for k, v in [*(("on", v) for v in o), ("over", 50.01)]]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_type: r for r in catalogue.QUERIES["ranked_levels"](spark, str(tmp_path)).collect()}
    assert (got["on"].n_high, got["on"].mean, got["on"]["rank"]) == (0, 50.0, 1)
    assert (got["over"].n_high, got["over"].mean, got["over"]["rank"]) == (6, 50.01, 2)


def test_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    groups = {0: [1e-30, 2.5], 1: [1e300, 1e300], 2: [nan, 1.0], 3: [inf, 1.0], 4: [None, 4.0], 5: [None], 6: [9e19] * 9, 7: [0.1, 0.2, 0.3], 8: [-0.0]}
    d = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double").repartition(5)
    got = {r.g: r for r in d.groupBy("g").agg(steady_mean(F.col("v")).alias("m"), F.avg("v").alias("plain")).collect()}
    assert got[7].m == 0.6 / 3 and got[6].m == 9e19 and got[5].m is None and got[4].m == 4.0
    for g in (0, 1, 2, 3, 8):
        assert got[g].m == pytest.approx(got[g].plain, nan_ok=True)
