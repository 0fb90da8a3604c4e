"""Small literals with known answers, invariants, files, contracts and streams."""

import hashlib
import inspect
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenkeel.functions import levels as lv
from evenkeel.operators import compare, contracts, contrast, features, folds, linear, matching, predict, prep, resample
from evenkeel.sources import files
from evenkeel.streaming import ingest


def test_contrast_literal(spark):
    rows = [("d", u, f"{u}{s}", s, 0.2, 1.0 + s) for u in ("p1", "p2") for s in (0.0, 1.0)] + [("d", "p3", "x", 1.0, 0.2, 9.0), ("d", "p1", "y", 1.0, 0.31, 99.0)]
    df = spark.createDataFrame(rows, "dataset string, unit string, trial string, level double, t double, value double")
    got = contrast.primary_contrast(df, "1", "0", (0.15, 0.3)).collect()
    assert sorted((r.unit, r.contrast) for r in got) == [("p1", 1.0), ("p2", 1.0)]


def test_level_keys(spark):
    got = spark.createDataFrame([(None,), (" seen ",), ("1.0",), ("01",), ("1e0",), ("2.5",)], "x string").select(lv.level_key(F.col("x")).alias("k"), lv.strip_zero(F.col("x")).alias("s")).collect()
    assert [r.k for r in got] == ["<missing>", "seen", "1", "1", "1", "2.5"]
    assert [r.s for r in got] == [None, " seen ", "1", "01", "1e0", "2.5"]


def test_t_quantile_and_bayes():
    assert math.isclose(resample.t_quantile(0.975, 10), 2.228138852, rel_tol=1e-8)
    assert math.isclose(resample.t_quantile(0.05, 3), -2.353363435, rel_tol=1e-8)
    x = np.array([0.18, 0.22, 0.25, 0.27, 0.29, 0.31, 0.33, 0.35])
    assert resample.jzs_bayes_factor(8, x.mean(), x.std(ddof=1)) > 1 > resample.jzs_bayes_factor(8, -x.mean(), x.std(ddof=1))
    assert math.isnan(resample.jzs_bayes_factor(1, 1.0, 0.0))


def test_holm_skips_null(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", float("nan"))], "id string, p_value double").withColumn("f", F.lit(1))
    got = {r.id: r.p_holm for r in resample.holm(df, ["f"]).collect()}
    assert got["d"] is None and got["e"] is None
    assert [round(got[k], 6) for k in "abc"] == [0.03, 0.06, 0.06]


def test_runs_and_clusters(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 3, 4, 0, 5, 0, 2, 2])], "g int, t int, x int")
    got = sorted((r.start, r.stop, r.mass) for r in resample.runs_above(df, ["g"], "t", "x", 1).collect())
    assert got == [(1, 2, 7), (4, 4, 5), (6, 7, 4)]


def test_matching_bins(spark):
    rows = [(m, 0, b, 40 + 12 * i if b else 70, 100) for i, m in enumerate("abcde") for b in (0, 1)]
    perf = spark.createDataFrame(rows, "model string, replicate int, bin int, correct_count long, sample_count long").withColumn("rate", F.col("correct_count") / F.col("sample_count"))
    t = matching.matching_table(perf, "model", "bin", 0.7, 0.02)
    assert matching.matched_bin(t, "bin").first().matched_bin == 0
    assert matching.matched_bin(t.where("bin = 1"), "bin").first().matched_bin is None
    assert matching.stabilised_weights(perf, "model", "bin").where("weight_correct <= 0 or weight_wrong <= 0").isEmpty()
    assert contracts.reconcile(perf, F.col("rate"), F.col("correct_count"), F.col("sample_count")).isEmpty()


def test_artefact_literal(spark):
    rows = [("u", i, c, t, 200e-6 if (i, c, t) == (2, 0, 4) else 0.0) for i in range(4) for c in range(2) for t in range(20)]
    df = spark.createDataFrame(rows, "unit string, trial int, channel int, t int, v double")
    got = {r.trial: r.rejected for r in prep.artefact_scores(df, ["unit"], "trial", "channel", "v", 150e-6).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False}


def test_clock_alignment_literal(spark):
    b = spark.createDataFrame([("r", x) for x in (90.8655, 102.7939, 115.0844)], "rec string, t double")
    g = spark.createDataFrame([("r", x) for x in (18.245, 108.094, 120.0224, 132.3129, 900.0)], "rec string, t double")
    got = sorted((round(r.trigger, 4), r.ok) for r in prep.align_clocks(b, g, "rec").collect())
    assert got == [(108.094, True), (120.0224, True), (132.3129, True)]


def test_trigger_codes(spark):
    got = [r.c for r in spark.createDataFrame([("Stimulus/S 10",), ("Stimulus/S  74",), ("New Segment/",)], "x string").select(lv.trigger_code(F.col("x")).alias("c")).collect()]
    assert got == [10, 74, None]


def test_folds(spark):
    df = spark.createDataFrame([("d", "p", f"t{i}", "ab"[i % 2]) for i in range(100)], "dataset string, unit string, trial string, stratum string")
    f = folds.stratified_folds(df, ["dataset", "unit"], "stratum", "trial")
    sizes = {}
    for r in f.groupBy("stratum", "fold").count().collect():
        sizes.setdefault(r.stratum, []).append(r["count"])
    assert all(max(x) - min(x) <= 1 and len(x) == 5 for x in sizes.values())
    s = {r.split: r["count"] for r in folds.validation_split(f, ["dataset", "unit"], "trial", 2).groupBy("split").count().collect()}
    assert s == {"test": 20, "validation": 8, "train": 72}
    g = folds.group_splits(df.withColumn("g", F.col("trial")).select("g").limit(30), "g")
    assert g.where("split = 'test'").groupBy("g").count().where("count <> 1").isEmpty()


def test_features(spark):
    rows = [(i, c, t, float(i * 20 + c * 10 + t)) for i in range(3) for c in range(2) for t in range(10)]
    df = spark.createDataFrame(rows, "trial int, channel int, t int, v double")
    got = {r.trial: r for r in features.sensor_features(df, ["trial"], "channel", "v").collect()}
    x = np.arange(60).reshape(3, 2, 10)
    for i in range(3):
        assert math.isclose(got[i].erp_mean, x[i].mean()) and math.isclose(got[i].gfp, x[i].mean(1).std()) and math.isclose(got[i].power, (x[i] ** 2).mean())


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 10, 80)
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(y, s)], "g int, y int, s double")
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert math.isclose(folds.roc_auc(df, ["g"], "y", "s").first().auc, want)


def test_whitening_and_ridge(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6)) * 1e-6 + 5e-6
    y = x @ np.arange(6) * 1e6 + 2 + 0.01 * rng.standard_normal(300)
    df = spark.createDataFrame([(1, i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))], "g int, i int, x array<double>, y double")
    w = np.array([r.white for r in linear.whitened(df, linear.whitening(df, ["g"], "x", 4), ["g"], "x").collect()])
    assert np.allclose(w.mean(0), 0, atol=1e-5) and np.allclose(np.cov(w.T), np.eye(4), atol=1e-5)
    scaled = df.withColumn("x", F.transform("x", lambda c: c * 1e6))
    r = linear.ridge(scaled, ["g"], "x", "y", 1e-6).first()
    assert r.r2 > 0.999 and np.allclose(r.weights, np.arange(6), atol=0.05)


def test_matrices(spark):
    df = spark.createDataFrame([(1, 0, [[1.0, 2.0], [0.0, 1.0]]), (1, 1, [[1.0, 0.0], [3.0, 1.0]])], "trial int, t int, m array<array<double>>")
    assert linear.propagators(df, ["trial"], "t", "m", 2).first().propagator == [[1.0, 2.0], [3.0, 7.0]]
    d = spark.createDataFrame([(1, [[3.0, 0.0], [0.0, 4.0]])], "k int, m array<array<double>>")
    assert math.isclose(linear.geometry(d, ["k"], "m").first().gain, 12.5)


def test_contract_errors(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    one = spark.createDataFrame([(1, 2)], "k int, w int")
    with pytest.raises(contracts.ContractError, match="duplicate"):
        contracts.many_to_one(one, df, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.aligned(spark.createDataFrame([(2,)], "k int"), one, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["x"])
    with pytest.raises(contracts.ContractError):
        contracts.forbid_columns(df, {"v"})
    assert contracts.many_to_one(df, one, ["k"]).count() == 2


def test_nearest_prefers_the_earlier(spark):
    a = spark.createDataFrame([(1, 5.0), (1, 9.9), (2, 1.0)], "g int, t double")
    b = spark.createDataFrame([(1, 4.0, "x"), (1, 6.0, "y")], "g int, o double, k string")
    assert sorted((r.g, r.t, r.k) for r in prep.nearest(a, b, ["g"], "t", "o", "k").collect()) == [(1, 5.0, "x"), (1, 9.9, "y"), (2, 1.0, None)]


def test_equivalence(spark):
    df = spark.createDataFrame([("m", "a", x) for x in (-0.1, 0.1) * 200] + [("m", "b", 1.0 + x) for x in (-0.1, 0.1) * 5], "model string, metric string, v double")
    got = {r.metric: (r.equivalent, r.all_equivalent) for r in compare.equivalence(df, ["model"], "metric", "v", spark.createDataFrame([("a", 1.0), ("b", 1.0)], "metric string, scale double")).collect()}
    assert got == {"a": (True, False), "b": (False, False)}
    noisy = spark.createDataFrame([("m", "a", x) for x in (-3.0, 3.1) * 10], "model string, metric string, v double")  # its own noise gives it no margin
    assert not compare.equivalence(noisy, ["model"], "metric", "v", spark.createDataFrame([("a", 1.0)], "metric string, scale double")).first().equivalent
    assert compare.equivalence(noisy, ["model"], "metric", "v", spark.createDataFrame([("a", 100.0)], "metric string, scale double")).first().equivalent


def test_files(spark, tmp_path):
    for m, s in (("x", 1), ("y", 2)):
        (tmp_path / "runs" / m).mkdir(parents=True)
        (tmp_path / "runs" / m / f"seed-{s}.json").write_text(json.dumps({"cost": s, "tests": [{"p": 0.1, "n": 1}, {"p": 0.2, "n": 2}]}))
    root = str(tmp_path / "runs")
    runs = files.run_documents(spark, root, "cost long, tests array<struct<p: double, n: long>>", {"model": r"/(\w+)/seed", "seed": r"seed-(\d+)"})
    assert sorted((r.model, r.seed, r.cost) for r in runs.collect()) == [("x", "1", 1), ("y", "2", 2)]
    assert sorted(r.tests__n for r in files.flattened(runs, "tests").collect()) == [1, 1, 2, 2]
    before = files.inventory(spark, root)
    before = spark.createDataFrame(before.collect(), before.schema)
    assert contracts.manifest_diff(before, files.inventory(spark, root)).isEmpty()
    (tmp_path / "runs" / "x" / "seed-1.json").write_text(json.dumps({"cost": 3, "tests": []}))
    assert [r.problem for r in contracts.manifest_diff(before, files.inventory(spark, root)).collect()] == ["size"]
    assert files.profile(spark, root).first().files == 2
    (tmp_path / "t.tsv").write_text("id\tx\n1\t2\n\t\n")
    assert files.delimited(spark, str(tmp_path / "t.tsv"), "id int, x int").count() == 1
    assert files.report(spark.range(7).toDF("a"), str(tmp_path / "out")) == 7


def test_restartable_write(spark, tmp_path):
    path = str(tmp_path / "set")
    a = spark.createDataFrame([("d", "p1", 1), ("d", "p1", 2)], "dataset_id string, participant_id string, v int")
    b = a.unionByName(spark.createDataFrame([("d", "p2", 3)], a.schema))
    files.write_missing(a, path, ["dataset_id", "participant_id"])
    index = files.write_missing(b, path, ["dataset_id", "participant_id"])
    assert sorted((r.participant_id, r.n_rows) for r in index.collect()) == [("p1", 2), ("p2", 1)]
    roster = spark.createDataFrame([("p2",)], "participant_id string")
    assert files.partitioned_set(spark, path, roster).count() == 1
    assert files.recursive_parquet(spark, path).count() == 3


def test_pareto_front_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 400, (1500, 2)))]
    rows += [(9000 + i, a, b) for i, (_, a, b) in enumerate(rows[:300])] + [(9998, None, 1), (9999, 1, None)]
    beats = lambda p, q: None not in (*p[1:], *q[1:]) and p[1] <= q[1] and p[2] <= q[2] and p[1:] != q[1:]
    want = {q[0] for q in rows if not any(beats(p, q) for p in rows)}
    d = spark.createDataFrame(rows, "k int, a int, b int")
    assert {r.k for r in compare.pareto_front(d, ["a", "b"], "k").collect()} == want
    assert {r.k for r in compare.pareto_front(d, ["a", "b"], "k", 3).collect()} == want
    assert compare.pareto_front(d.limit(0), ["a", "b"], "k").count() == 0


def test_broken_write_is_replaced(spark, tmp_path):
    """A partition without a row in the index is written anew, null keys are kept, another configuration is an error."""
    path = str(tmp_path / "set")
    d = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    d.where("v = 1").write.partitionBy("k").parquet(path)  # half a partition, not sealed
    for _ in range(2):
        index = files.write_missing(d, path, ["k"], {"x": 1})
        assert sorted((str(r.k), r.n_rows) for r in index.collect()) == [("None", 1), ("a", 2)]
        assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        files.write_missing(d, path, ["k"], {"x": 2})


def test_tree_digest(spark, tmp_path):
    for name in ("a/x.csv", "b/x.csv"):
        (tmp_path / "t" / name).parent.mkdir(parents=True)
        (tmp_path / "t" / name).write_text("h,i\n1,2\n")
    root = str(tmp_path / "t")
    got = lambda r: files.tree_digest(files.inventory(spark, r), r).first()
    one = got(root)
    assert (one.n_files, one.size_bytes) == (2, 16)
    (tmp_path / "t").rename(tmp_path / "u")
    assert got(str(tmp_path / "u")).sha256 == one.sha256  # paths below the root count, not where it lies
    (tmp_path / "u/b/x.csv").write_text("h,i\n1,3\n")
    assert got(str(tmp_path / "u")).sha256 != one.sha256
    assert {r.header for r in files.headers(spark, str(tmp_path / "u")).collect()} == {"h,i"}


def test_ingest_twice(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    df = spark.range(20).withColumn("v", F.col("id") % 3)
    df.write.parquet(src)
    assert ingest.append_new(spark, src, df.schema, dst, ["id"], str(tmp_path / "c1")) == 20
    assert ingest.append_new(spark, src, df.schema, dst, ["id"], str(tmp_path / "c1")) == 20
    df.unionByName(spark.range(20, 25).withColumn("v", F.lit(0))).write.mode("append").parquet(src)
    assert ingest.append_new(spark, src, df.schema, dst, ["id"], str(tmp_path / "c2")) == 25


def test_trigger_windows_as_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    src, out = str(tmp_path / "log"), str(tmp_path / "out")
    e.orderBy("ts").coalesce(1).write.parquet(src)
    opens, hit = F.col("event_type") == "signup", F.col("event_type").isin("purchase", "error")
    s = spark.readStream.schema(e.schema).parquet(src)
    q = ingest.trigger_windows_stream(s, "user_id", "ts", opens, F.col("event_type"), hit).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    batch = prep.trigger_windows(e, ["user_id"], "ts", opens, hit, F.col("event_type"))
    want = {(r.user_id, r.window): (r.n_rows, r.first_code) for r in batch.collect()}
    got = {(r.user_id, r.window): (r.n_rows, r.first_code) for r in spark.read.parquet(out).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    last = {}
    for u, w in want:
        last[u] = max(last.get(u, 0), w)
    assert {k for k in want if k[1] < last[k[0]]} <= set(got)


def test_trigger_windows_over_several_batches(spark, tmp_path):
    """Rows of another key between a key's rows must not close its window; numbers go on after a window that timed out."""
    at = lambda m: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime()
    batches = [[(1, at(2), "signup"), (2, at(3), "view")], [(2, at(10), "view")], [(2, at(20), "view")], [(1, at(30), "purchase")], [(2, at(300), "view")], [(2, at(301), "view")], [(2, at(302), "view")],
               [(1, at(400), "signup")], [(1, at(401), "error")], [(1, at(402), "signup")], [(2, at(900), "view")], [(2, at(901), "view")]]
    shape = "user_id int, ts timestamp, event_type string"
    src, out = str(tmp_path / "log"), str(tmp_path / "out")
    opens, hit = F.col("event_type") == "signup", F.col("event_type").isin("purchase", "error")
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(shape).parquet(src)
        q = ingest.trigger_windows_stream(s, "user_id", "ts", opens, F.col("event_type"), hit).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination()
    got = {(r.user_id, r.window): (r.n_rows, r.first_code) for r in spark.read.parquet(out).collect()}
    e = spark.read.parquet(src)
    want = {(r.user_id, r.window): (r.n_rows, r.first_code) for r in prep.trigger_windows(e, ["user_id"], "ts", opens, hit, F.col("event_type")).collect()}
    assert got == want == {(1, 1): (2, "purchase"), (1, 2): (2, "error")}


def test_clusters_form_at_the_t_quantile_and_take_5000_draws(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9, 14)) + np.where((np.arange(14) > 3) & (np.arange(14) < 8), 1.1, 0.1)
    rows = [(g, f"u{u}", t, float(v)) for g, k in (("a", 9), ("b", 5)) for u in range(k) for t, v in enumerate(x[u]) if (u, t) != (2, 9)] + [("one", "u0", 0, 9.0)]
    got = resample.cluster_sign_flip(spark.createDataFrame(rows, "g string, unit string, t int, contrast double"), ["g"], "t").collect()

    def runs(v, limit):
        stat = [np.sqrt(len(c)) * c.mean() / c.std(ddof=1) for c in (c[~np.isnan(c)] for c in v.T)]
        out, start = [], None
        for i, y in enumerate([*stat, -np.inf]):
            if y >= limit and start is None:
                start = i
            elif y < limit and start is not None:
                out, start = [*out, (start, i - 1, sum(stat[start:i]))], None
        return out

    want = []
    for g, k, limit in (("a", 9, 2.896459448), ("b", 5, 3.746947388)):  # t(0.99) with 8 and 4 degrees of freedom
        v = x[:k].copy()
        v[2, 9] = np.nan
        sign = lambda d, u: 1.0 if hashlib.sha256(f"5|{d}|u{u}".encode()).hexdigest()[0] < "8" else -1.0
        top = [max((m for *_, m in runs(v * np.array([[sign(d, u)] for u in range(k)]), limit)), default=0.0) for d in range(1, 5001)]
        want += [(g, a, b, round(m, 6), round((1 + sum(round(y, 9) >= round(m, 9) for y in top)) / 5001, 9)) for a, b, m in runs(v, limit)]
    assert want and sorted((r.g, r.start, r.stop, round(r.mass, 6), round(r.p_value, 9)) for r in got) == sorted(want)
    assert {inspect.signature(f).parameters["n"].default for f in (resample.sign_flip, resample.cluster_sign_flip)} == {5000}
    assert inspect.signature(resample.bootstrap_ci).parameters["n"].default == 10_000


def test_incremental_auc_has_the_sign_flip_p_of_its_gains(spark):
    gains = [0.02, 0.03, -0.01, 0.04, 0.01]
    rows = [(i, f, 0.6 + (g if f == "more" else 0.0)) for i, g in enumerate(gains) for f in ("less", "more")]
    got = predict.incremental_auc(spark.createDataFrame(rows, "fold int, family string, auc double"), "less", "more").collect()
    null = [sum(g if hashlib.sha256(f"7|{d}|{i}".encode()).hexdigest()[0] < "8" else -g for i, g in enumerate(gains)) / 5 for d in range(1, 10_001)]
    p = (1 + sum(round(x, 9) >= round(sum(gains) / 5, 9) for x in null)) / 10_001
    assert len(got) == 5 and all(abs(r.p_value - p) < 1e-9 for r in got) and abs(p - 3 / 32) < 0.02  # three of 32 flips reach the mean
