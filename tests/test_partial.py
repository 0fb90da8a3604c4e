"""Decisions of windows in batch and stream, transfer, outcomes, baselines and the like against literals and brute force."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import compare, contracts, decisions, features, matching, prep
from evenkeel.streaming import ingest


def marks():
    kind = F.col("kind")
    return {"opening": kind == "open", "outcome": kind.startswith("out"), "code": kind, "invalid": kind == "bad", "interruption": kind == "cut"}


def brute_windows(rows):
    out, keys = set(), defaultdict(list)
    for k, t, kind in rows:
        keys[k].append((t, kind))
    for k, x in keys.items():
        number, window = 0, None

        def close():
            if window:
                hit = next(((t, c) for t, c in window if c and c.startswith("out")), (None, None))
                kinds = {c for _, c in window}
                out.add((k, number, window[0][0], len(window), *hit, "kept" if hit[1] else "invalid" if "bad" in kinds else "interrupted" if "cut" in kinds else "unresolved"))
        for t, kind in sorted(x, key=lambda r: r[0]):
            if kind == "open":
                close()
                number, window = number + 1, []
            if window is not None:
                window.append((t, kind))
        close()
    return out


def log(n, seed):
    rng = np.random.default_rng(seed)
    kinds = ["open", "out1", "out2", "bad", "cut", "x", None]
    return [(int(rng.integers(0, 6)), int(t), kinds[int(rng.choice(7, p=[0.25, 0.1, 0.1, 0.1, 0.1, 0.3, 0.05]))]) for t in rng.permutation(n * 3)[:n]]


def test_window_decisions_in_batch(spark):
    rows = log(400, 1)
    df = spark.createDataFrame(rows, "k int, t int, kind string")
    got = prep.window_decisions(df, ["k"], "t", **marks())
    assert {tuple(r) for r in got.collect()} == brute_windows(rows)
    assert {r.decision for r in got.collect()} == {"kept", "invalid", "interrupted", "unresolved"}
    cut = prep.excluded_windows(got).collect()
    assert len(cut) == sum(w[-1] == "interrupted" for w in brute_windows(rows)) and {r.reason for r in cut} == {"recording discontinuity before the outcome"}
    with pytest.raises(contracts.ContractError):
        prep.require_resolved(got)
    assert prep.require_resolved(got.where("decision <> 'unresolved'")).count() == sum(w[-1] == "kept" for w in brute_windows(rows))


def test_late_rows_give_the_windows_of_the_batch(spark, tmp_path):
    rows = log(300, 2)
    rng = np.random.default_rng(3)
    at = lambda t: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=int(t))).to_pydatetime()
    arrival = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 200))  # late by up to 200 minutes
    src, out, shape = str(tmp_path / "log"), str(tmp_path / "out"), "k int, at timestamp, kind string"
    q = None
    for part in [arrival[i:i + 75] for i in range(0, 300, 75)] + [[(None, 10**6, "end")]]:
        spark.createDataFrame([(k, at(t), kind) for k, t, kind in part], shape).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(shape).parquet(src)
        q = ingest.window_decisions_stream(s, "k", "at", delay="2000 minutes", **marks())
        q.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
    got = {(r.k, r.window, r.start, r.n_rows, r.outcome_at, r.first_code, r.decision) for r in spark.read.parquet(out).collect()}
    assert got == {(k, n, at(s), m, None if o is None else at(o), c, d) for k, n, s, m, o, c, d in brute_windows(rows)}


def test_references_leave_their_fold_out(spark):
    rng = np.random.default_rng(4)
    rows = [(c, f, m, float(rng.normal(3, 2))) for c in "ab" for f in range(4) for m in ("x", "y") for _ in range(int(rng.integers(1, 6)))] + [("a", 0, "x", None), ("one", 0, "x", 5.0), ("flat", 0, "x", 1.0), ("flat", 1, "x", 2.0), ("flat", 1, "x", 2.0)]
    df = spark.createDataFrame(rows, "contrast string, fold int, metric string, value double")
    got = {(r.contrast, r.metric, r.fold): (r.center, r.scale) for r in decisions.references(df, ["contrast"], fold="fold").collect()}
    for c in "ab":
        for m in ("x", "y"):
            for f in range(4):
                rest = [v for cc, ff, mm, v in rows if (cc, mm) == (c, m) and ff != f and v is not None]
                assert got[c, m, f] == pytest.approx((np.mean(rest), max(np.std(rest, ddof=1), 1e-4)))
    assert ("one", "x", 0) not in got and got["flat", "x", 0] == (2.0, 1e-4) and got["flat", "x", 1] == (1.0, None)
    whole = {(r.contrast, r.metric): (r.center, r.scale) for r in decisions.references(df, ["contrast"]).collect()}
    x = [v for cc, _, mm, v in rows if (cc, mm) == ("a", "x") and v is not None]
    assert whole["a", "x"] == pytest.approx((np.mean(x), np.std(x, ddof=1))) and whole["one", "x"] == (5.0, None)
    vectors = spark.createDataFrame([(1, 0, "x", 4.0), (1, 0, "y", 1.0), (2, 3, "x", 0.0), (2, 3, "y", 0.0)], "rep int, fold int, metric string, value double")
    t = {(r.rep, r.contrast): r for r in decisions.external_transfer(vectors, decisions.references(df.where("contrast in ('a', 'b')"), ["contrast"], fold="fold"), ["rep", "fold"], "contrast", fold="fold").collect()}
    c, s = (np.array([got["a", m, 0][i] for m in ("x", "y")]) for i in (0, 1))
    v = np.array([4.0, 1.0])
    assert (t[1, "a"].rms, t[1, "a"].cosine, t[1, "a"].magnitude) == pytest.approx((np.sqrt((((v - c) / s) ** 2).mean()), v @ c / np.sqrt(v @ v * (c @ c)), np.sqrt(v @ v / (c @ c))))
    assert t[2, "b"].cosine is None and t[2, "b"].magnitude == 0


def test_leave_one_out_by_sums(spark):
    ref = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 3.0), ("c", "m", None), ("b", "k", 9.0)], "src string, metric string, value double")
    df = spark.createDataFrame([("v", "m", 0.0), ("v", "k", 1.0)], "model string, metric string, value double")
    got = {r.held_out: r.rms for r in compare.leave_one_out(df, ref, "src", ["model"]).collect()}
    assert got["b"] == pytest.approx(1.0) and got["a"] == pytest.approx(np.sqrt((9 + 64) / 2)) and got["c"] == pytest.approx(np.sqrt((4 + 64) / 2))


def test_outcomes(spark):
    df = spark.createDataFrame([("d", "1.0"), ("d", " 0 "), ("d", "2"), ("e", "seen"), ("e", "unseen"), ("f", "1"), ("d", None)], "ds string, level string")
    shape = "dataset string, positive string, negative string"
    spec = lambda *rows: spark.createDataFrame(list(rows), shape)
    got = decisions.harmonised(df, spec(("d", "1", "0"), ("e", "seen", "unseen")), "ds", "level").collect()
    assert sorted((r.ds, r.level, r.outcome) for r in got) == [("d", " 0 ", 0), ("d", "1.0", 1), ("e", "seen", 1), ("e", "unseen", 0)]
    for bad in (spec(("d", "1", "0"), ("d", "2", "0")), spec(("d", "1", "1.0")), spec(("d", "1", None))):
        with pytest.raises(contracts.ContractError, match="ambiguous"):
            decisions.harmonised(df, bad, "ds", "level")
    for bad in (spec(("d", "1", "7")), spec(("g", "a", "b"))):
        with pytest.raises(contracts.ContractError, match="no row"):
            decisions.harmonised(df, bad, "ds", "level")


def test_coded_columns(spark):
    df = spark.createDataFrame([(1, "3", "b", None, True), (2, " 1e1 ", "a", None, False), (3, None, "", None, True), (4, "nan", "c", None, None)], "i int, n string, s string, e string, t boolean")
    got = {r.i: r.asDict() for r in features.coded(df, ["n", "s", "e", "t"]).collect()}
    assert set(got[1]) == {"i", "n", "e", "s__b", "s__c", "t__true"}
    assert [got[i]["n"] for i in (1, 2, 3, 4)] == [3.0, 10.0, None, None] and [got[i]["s__b"] for i in (1, 2, 3, 4)] == [1.0, 0.0, None, 0.0] and got[4]["t__true"] is None
    wide = spark.range(1001).select(F.concat(F.lit("x"), "id").alias("c"))
    with pytest.raises(ValueError, match="levels"):
        features.coded(wide, ["c"])
    assert features.coded(df.limit(0), ["n"]).columns == ["i", "s", "e", "t", "n"]


def test_baseline_and_weights(spark):
    rows = [("a", t, float(t), 1.0 if t < 3 else 2.0) for t in range(6)] + [("a", 1, float("nan"), None)]
    df = spark.createDataFrame(rows, "g string, t int, x double, y double")
    b = features.fit_baseline(df, ["g"], ["x"], F.col("t") < 3)
    assert [(r.center, r.scale) for r in b.collect()] == [(1.0, 1.0)]
    got = features.composite_index(df.where("x = 5"), features.fit_baseline(df, ["g"], ["x", "y"], F.lit(True)), ["g"], {"x": 3, "y": 1}).first()
    assert got["index"] == pytest.approx(0.75 * got.z_x + 0.25 * got.z_y)
    with pytest.raises(Exception, match="no baseline variance of y a"):
        features.fit_baseline(df, ["g"], ["y"], F.col("t") < 3).collect()
    for w in ({"x": -1.0, "y": 2.0}, {"x": 0.0}, {}):
        with pytest.raises(ValueError):
            features.composite_index(df, b, ["g"], w)


def test_channels_gates_and_tensors(spark):
    df = spark.createDataFrame([("u", 0, None), ("u", 0, float("nan")), ("u", 1, 2.0), ("v", 0, 1.0)], "u string, c int, x double")
    assert sorted((r.u, r.c, r.x) for r in prep.filled_channels(df, ["u"], "c", "x").collect()) == [("u", 0, 0.0), ("u", 0, 0.0), ("u", 1, 2.0), ("v", 0, 1.0)]
    with pytest.raises(Exception, match="partly missing channel u 1"):
        prep.filled_channels(df.unionByName(spark.createDataFrame([("u", 1, None)], df.schema)), ["u"], "c", "x").collect()
    perf = spark.createDataFrame([("m", 0, 61, 100), ("n", 0, 63, 100)], "model string, bin int, correct_count long, sample_count long")
    assert matching.matching_table(perf, "model", "bin", 0.6, 0.02).first().eligible  # 0.63 - 0.61 is a little more than 0.02
    t = spark.createDataFrame([(1, [1.0, 2.0], ["a", "b"]), (2, [], []), (3, None, None)], "k int, x array<double>, s array<string>")
    rows = features.exploded(t, ["k"], ["x", "s"])
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 1.0, "a"), (1, 1, 2.0, "b")]
    assert features.gathered(rows.orderBy(F.desc("t")), ["k"], ["x", "s"]).collect() == [(1, [1.0, 2.0], ["a", "b"])]
    with pytest.raises(Exception, match="differ in length"):
        features.exploded(spark.createDataFrame([(1, [1.0], ["a", "b"])], t.schema), ["k"], ["x", "s"]).collect()


def test_drops_and_first_values(spark):
    df = spark.createDataFrame([("h1", 1, 1, 1, 0), ("h1", 1, 1, 0, 0), ("h2", 1, 0, 0, 0), ("h3", 0, 1, 1, 1), ("h2", 1, 1, 1, None)], "head string, mask int, y int, a int, b int")
    r = features.accuracy_drop(df, [], "head", F.col("mask") == 1, F.col("y"), F.col("a"), F.col("b")).first()
    assert (r.baseline, r.ablated, r["drop"], r.n_heads) == (0.75, 0.25, 0.5, 2)
    g = spark.createDataFrame([(1, "h", 2, False), (1, "h", 1, True), (1, "h", 0, None), (2, "s", 1, None)], "k int, c string, o int, ok boolean")
    assert {r.k: (r.a, r.b) for r in decisions.pivot_first(g, ["k"], "c", {"h": "a", "s": "b"}, "ok", "o").collect()} == {1: (True, None), 2: (None, None)}
    assert decisions.pivot_first(g, ["k"], "c", {"h": "a"}, "ok").where("k = 1").first().a is False


def test_retention_scenarios(spark):
    rng = np.random.default_rng(5)
    rows = [(m, r, f, float(rng.normal(0.3, 1)), float(rng.normal(0, 1)), bool(rng.random() < 0.8), None if rng.random() < 0.1 else bool(rng.random() < 0.9)) for m in "ab" for r in range(8) for f in range(5)]
    df = spark.createDataFrame(rows, "m string, r int, f int, g double, s double, hp boolean, sp boolean").withColumn("bp", F.col("hp") & F.col("sp"))
    got = {(x.scenario, x.endpoint, x.m): x for x in compare.retention_tests(df, "m", "r", {"g": "hp", "s": "bp"}, flips=200, resamples=200).collect()}
    for name, gated, least in compare.SCENARIOS:
        for e, col, gate in (("g", 3, lambda x: x[5]), ("s", 4, lambda x: x[5] and x[6] is True)):
            for m in "ab":
                folds = defaultdict(list)
                for x in rows:
                    if x[0] == m and (not gated or gate(x)):
                        folds[x[1]].append(x[col])
                values = [np.mean(v) for v in folds.values() if len(v) >= least]
                x = got.get((name, e, m))
                if not values:
                    assert x is None
                    continue
                assert x.n_units == len(values) and x.mean == pytest.approx(np.mean(values)) and x.retained_folds == sum(len(v) for v in folds.values() if len(v) >= least)
                assert (x.sd is None) == (len(values) < 2) and 0 < x.p_value <= x.p_holm <= 1
    fails = {(x.m, x.condition): x.failed_runs for x in compare.retention_failures(df, "m", {"human": "hp", "sham": "sp"}).collect()}
    assert fails["a", "sham"] == sum(x[0] == "a" and x[6] is not True for x in rows)


def test_small_contracts(spark, tmp_path):
    from evenkeel.operators import contrast
    from evenkeel.sources import files

    keys = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    splits = spark.createDataFrame([(0, "a"), (0, "b"), (0, None), (1, "a"), (1, "a"), (1, "x"), (1, None)], "fold int, k string")
    assert sorted((r.fold, str(r.k), r.problem) for r in contracts.partition_faults(splits, keys, "k", ["fold"]).collect()) == [(1, "a", "repeated"), (1, "b", "missing"), (1, "x", "unexpected")]
    assert contracts.partition_faults(splits.where("fold = 0").drop("fold"), keys, "k", []).isEmpty()
    perf = spark.createDataFrame([("m", 0), ("m", 1), ("n", 0)], "m string, bin int")
    assert contracts.require_bins(perf.where("m = 'm'"), ["m"], "bin", [0, 1]).count() == 2
    with pytest.raises(contracts.ContractError, match="'n'"):
        contracts.require_bins(perf, ["m"], "bin", [0, 1])
    t = spark.createDataFrame([("u", 0.0), ("u", 1.0), ("u", 2.0), ("u", None)], "u string, t double")
    assert sorted((r.step, r.t) for r in prep.nearest_grid(t, ["u"], "t", [0.2, 1.5]).collect()) == [(0, 0.0), (1, 1.0)]
    with pytest.raises(Exception, match="no distinct times"):
        prep.nearest_grid(t, ["u"], "t", [0.1, 0.2]).collect()
    with pytest.raises(contracts.ContractError, match="no row"):
        contrast.in_window(t, 5, 6, required=True)
    (tmp_path / "bom.tsv").write_bytes("\ufeffid\tname\n1\té\n\t\n".encode())
    assert files.delimited(spark, str(tmp_path / "bom.tsv"), "id int, name string").collect() == [(1, "é")]
