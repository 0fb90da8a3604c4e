"""Queries over exact flips, similarity geometry, exact medians, exclusions, subspaces, baselines and transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions.levels import dot
from evenkeel.operators import compare, contracts, decisions, features, folds, linear, matching, prep, resample
from evenkeel.plans.catalogue import MATCH, PROFILE, SAMPLES, SQL, STAGE, facts, performance, profiles, query, rounded, samples, stages, table
from evenkeel.plans.catalogue4 import _tested, _tests_sql
from evenkeel.plans.tables import FACTS
from evenkeel.sources import files
from evenkeel.streaming import ingest


def _exact_sql(two_sided: bool) -> str:
    reach = "abs(a.s + b.s) >= abs(n * mean) - 0.5e-9 * n" if two_sided else "a.s + b.s >= n * mean - 0.5e-9 * n"
    half = "list_sum(list_transform(x, lambda v, i: CASE WHEN (k >> (i - 1)) % 2 = 1 THEN v ELSE -v END))"
    return f"""WITH {STAGE}, d AS (SELECT model, replicate, adapted - baseline AS v FROM sw WHERE adapted - baseline IS NOT NULL), l AS (SELECT model, list(v ORDER BY replicate) xs, count(*) n, avg(v) mean FROM d GROUP BY model),
a AS (SELECT model, {half} s FROM (SELECT model, xs[1:n // 2] AS x, unnest(range(0, (2 ** (n // 2))::BIGINT)) k FROM l)), b AS (SELECT model, {half} s FROM (SELECT model, xs[n // 2 + 1:] AS x, unnest(range(0, (2 ** (n - n // 2))::BIGINT)) k FROM l))
SELECT l.model, round(any_value(mean), 5) mean, any_value(n) n_units, round(count(*) FILTER (WHERE {reach}) / count(*), 9) p_value FROM l JOIN a ON a.model = l.model JOIN b ON b.model = l.model GROUP BY l.model"""


@query(_exact_sql(False))
def exact_sign_flip(spark, sf_dir):
    """All 2^n flips of every model's gains."""
    return rounded(rounded(resample.exact_sign_flip(stages(spark, sf_dir), ["model"], "total_gain"), "mean", digits=5), "p_value", digits=9)


@query(_exact_sql(True))
def exact_sign_flip_two_sided(spark, sf_dir):
    return rounded(rounded(resample.exact_sign_flip(stages(spark, sf_dir), ["model"], "total_gain", two_sided=True), "mean", digits=5), "p_value", digits=9)


SIMILAR = """v AS (SELECT vec_id // 16 AS trial, (vec_id // 16) % 5 AS unit, vec_id % 16 AS t, list_transform(embedding::DOUBLE[], lambda x: x - list_avg(embedding::DOUBLE[])) AS x FROM embeddings),
c AS (SELECT a.unit, a.t, b.t AS s, list_dot_product(a.x, b.x) / (greatest(sqrt(list_dot_product(a.x, a.x)), 1e-8) * greatest(sqrt(list_dot_product(b.x, b.x)), 1e-8)) AS c FROM v a JOIN v b ON a.trial = b.trial),
m AS (SELECT unit, t, s, avg(c) mean, var_pop(c) variance, count(*) n FROM c GROUP BY ALL)"""


def _similar(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("trial"), (F.floor(F.col("vec_id") / 16) % 5).alias("unit"), (F.col("vec_id") % 16).alias("t"), F.col("embedding").alias("x"))
    return linear.similarity_moments(d, ["unit"], ["trial"], "t", "x")


@query(f"WITH {SIMILAR} SELECT unit, t, s, round(mean, 6) mean, round(variance, 6) variance, n FROM m")
def unit_similarity(spark, sf_dir):
    """Similarity of times within trials of 16 vectors, by unit."""
    return rounded(_similar(spark, sf_dir), "mean", "variance")


@query(f"WITH {SIMILAR} SELECT t, s, round(avg(mean), 6) mean, round(avg(variance) + var_pop(mean), 6) variance, sum(n)::BIGINT n FROM m GROUP BY ALL")
def pooled_similarity(spark, sf_dir):
    """All units with one weight each."""
    return rounded(linear.pooled_cells(_similar(spark, sf_dir)), "mean", "variance")


@query(f"""WITH {SIMILAR}, p AS (SELECT unit < 2 AS side, t, s, avg(mean) mean, avg(variance) + var_pop(mean) variance FROM m GROUP BY ALL)
SELECT round(avg((a.mean - b.mean) ** 2) + 0.5 * avg((a.variance - b.variance) ** 2), 9) distance FROM p a JOIN p b ON a.side AND NOT b.side AND a.t = b.t AND a.s = b.s WHERE a.t <> a.s""")
def similarity_distance(spark, sf_dir):
    """Two units' pooled similarity against that of the other three."""
    m = _similar(spark, sf_dir)
    return rounded(linear.alignment_distance(linear.pooled_cells(m.where("unit < 2")), linear.pooled_cells(m.where("unit >= 2")), 0.5), "distance", digits=9)


def _basis_sql(rows) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in r) + "]" for r in rows) + "]::DOUBLE[][]"


BASES = {"targeted": linear.random_basis(64, 2, "targeted"), "random": linear.random_basis(64, 2, "random-0")}


@query("WITH b AS (" + " UNION ALL ".join(f"SELECT '{n}' AS basis, {_basis_sql(m)} AS rows" for n, m in BASES.items()) + """), v AS (SELECT vec_id, embedding::DOUBLE[] x FROM embeddings),
p AS (SELECT vec_id, basis, x, rows[1] r1, rows[2] r2, list_dot_product(x, rows[1]) k1, list_dot_product(x, rows[2]) k2 FROM v, b),
q AS (SELECT vec_id, basis, list_transform(range(1, 65), lambda i: x[i] - k1 * r1[i] - k2 * r2[i]) y FROM p)
SELECT vec_id, basis, round(sqrt(list_dot_product(y, y)), 6) AS length, round(y[1], 6) + 0.0 AS first, round(y[64], 6) + 0.0 AS last FROM q""")
def removed_subspace(spark, sf_dir):
    """Every vector without its part in a plane, a targeted and a random one."""
    r = linear.without_subspace(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x")), "x", BASES)
    y = F.col("removed")
    return r.select("vec_id", "basis", F.round(F.sqrt(dot(y, y)), 6).alias("length"), (F.round(y[0], 6) + F.lit(0.0)).alias("first"), (F.round(y[63], 6) + F.lit(0.0)).alias("last"))


@query("SELECT label, vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 4) AS power FROM embeddings")
def restored_vectors(spark, sf_dir):
    """Whitened by all components that vectors of 8 have, and back: the power of the whole vector, part by part."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))).alias("part", "x"))
    model = linear.whitening(d, ["part"], "x", 8)
    back = linear.unwhitened(linear.whitened(d, model, ["part"], "x"), model, ["part"])
    return back.groupBy("label", "vec_id").agg(F.round(F.sum(dot(F.col("restored"), F.col("restored"))), 4).alias("power"))


DECIDED = """WITH w AS (SELECT user_id, event_id, event_type, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS win FROM events),
g AS (SELECT user_id, win, min(event_id) st, count(*) n_rows, min(event_id) FILTER (WHERE event_type = 'purchase') oa, bool_or(event_type = 'error') bad, bool_or(event_type = 'view') cut FROM w WHERE win > 0 GROUP BY ALL)
SELECT g.user_id, win AS "window", st AS start, n_rows, oa AS outcome_at, e.event_type AS first_code, CASE WHEN oa IS NOT NULL THEN 'kept' WHEN bad THEN 'invalid' WHEN cut THEN 'interrupted' ELSE 'unresolved' END AS decision FROM g LEFT JOIN events e ON e.event_id = oa"""


def _marks():
    kind = F.col("event_type")
    return {"opening": kind == "signup", "outcome": kind == "purchase", "code": kind, "invalid": kind == "error", "interruption": kind == "view"}


@query(DECIDED)
def window_decisions(spark, sf_dir):
    """Every window between signups: kept, or why not."""
    return prep.window_decisions(table(spark, sf_dir, "events"), ["user_id"], "event_id", **_marks())


@query(DECIDED)
def streamed_late_windows(spark, sf_dir):
    """The same from a stream of five files in which rows come late by up to a seventh of the log; one row far ahead ends it, so that the last windows go out too."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    most = e.agg(F.max("event_id")).first()[0] or 0
    part = most // 5 + 1
    arrives = F.floor((F.col("event_id") + F.pmod(F.xxhash64("event_id"), F.lit(max(1, most // 7)))) / part)
    log = e.select("user_id", F.timestamp_micros(F.col("event_id") * 1_000_000).alias("at"), "event_type", arrives.alias("_file"))
    source, out = files.scratch(spark, "late-log"), files.scratch(spark, "late-windows")
    for k in range(7):
        log.where(F.col("_file") == k).drop("_file").orderBy(F.xxhash64("at")).coalesce(1).write.mode("append").parquet(source)
    end = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.timestamp_micros(F.lit(100 * (most + 10_000) * 1_000_000)).alias("at"), F.lit("end").alias("event_type"))
    end.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = ingest.window_decisions_stream(stream, "user_id", "at", delay=f"{2 * part} seconds", **_marks())
    found.writeStream.format("parquet").option("checkpointLocation", files.scratch(spark, "progress")).trigger(availableNow=True).start(out).awaitTermination()
    w = spark.read.schema(found.schema).parquet(out)
    return w.select("user_id", "window", F.unix_seconds("start").alias("start"), "n_rows", F.unix_seconds("outcome_at").alias("outcome_at"), "first_code", "decision")


OUTSIDE = f"""{PROFILE}, ext AS (UNPIVOT (SELECT l_linenumber % 2 AS side, l_suppkey AS unit, l_suppkey % 5 AS fold, avg(l_extendedprice) / 60000 gain, avg(l_discount) * 6 broadcast, avg(l_tax) * 6 persistence, avg(l_quantity) / 49 concentration FROM lineitem GROUP BY ALL) ON gain, broadcast, persistence, concentration INTO NAME metric VALUE value),
rf AS (SELECT f.fold, side, metric, avg(value) center, greatest(stddev_samp(value), 1e-4) scale FROM ext e JOIN (SELECT DISTINCT fold FROM ext) f ON f.fold <> e.fold GROUP BY ALL),
tr AS (SELECT model, replicate, p.replicate % 5 AS fold, side, sqrt(avg(((value - center) / scale) ** 2)) rms, sum(value * center) / sqrt(sum(value * value) * sum(center * center)) cosine, sqrt(sum(value * value)) / sqrt(sum(center * center)) magnitude, count(*) n_metrics
FROM prof p JOIN rf ON rf.metric = p.metric AND rf.fold = p.replicate % 5 GROUP BY ALL)"""


def _transfer(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ext = li.groupBy((F.col("l_linenumber") % 2).alias("side"), F.col("l_suppkey").alias("unit"), (F.col("l_suppkey") % 5).alias("fold")).agg(
        (F.avg("l_extendedprice") / 60000).alias("gain"), (F.avg("l_discount") * 6).alias("broadcast"), (F.avg("l_tax") * 6).alias("persistence"), (F.avg("l_quantity") / 49).alias("concentration"))
    ext = ext.unpivot(["side", "unit", "fold"], ["gain", "broadcast", "persistence", "concentration"], "metric", "value")
    reference = decisions.references(ext, ["side"], fold="fold")
    vectors = profiles(spark, sf_dir).withColumn("fold", F.col("replicate") % 5)
    return decisions.external_transfer(vectors, reference, ["model", "replicate", "fold"], "side", fold="fold")


@query(f"WITH {OUTSIDE} SELECT model, replicate, fold, side, round(rms, 5) rms, round(cosine, 6) cosine, round(magnitude, 6) magnitude, n_metrics FROM tr")
def external_transfer(spark, sf_dir):
    """Every model's profile against the references of another table, made without the profile's fold."""
    return rounded(rounded(_transfer(spark, sf_dir), "cosine", "magnitude"), "rms", digits=5)


@query(f"""WITH {OUTSIDE}, r AS (SELECT model, side, replicate, avg(rms) rms, avg(cosine) cosine, avg(magnitude) magnitude, count(*) n FROM tr GROUP BY ALL)
SELECT model, side, round(avg(rms), 5) mean_rms, round(stddev_samp(rms), 5) sd_rms, round(avg(cosine), 6) mean_cosine, round(avg(magnitude), 6) mean_magnitude, count(*) n_replicates, sum(n)::BIGINT n_folds FROM r GROUP BY ALL""")
def transfer_summary(spark, sf_dir):
    return rounded(rounded(decisions.stage_summary(_transfer(spark, sf_dir), "model", "replicate", "side"), "mean_cosine", "mean_magnitude"), "mean_rms", "sd_rms", digits=5)


RUNS = """run AS (SELECT l_returnflag AS model, l_suppkey % 20 AS replicate, l_orderkey % 5 AS fold, avg(l_extendedprice) FILTER (WHERE l_linenumber <= 2) / 1000 b, avg(l_extendedprice) FILTER (WHERE l_linenumber IN (3, 4)) / 1000 s, avg(l_extendedprice) FILTER (WHERE l_linenumber > 4) / 1000 a,
abs(avg(l_discount) FILTER (WHERE l_linenumber > 4) - avg(l_discount) FILTER (WHERE l_linenumber <= 2)) <= 0.01 AS ap, abs(avg(l_discount) FILTER (WHERE l_linenumber IN (3, 4)) - avg(l_discount) FILTER (WHERE l_linenumber <= 2)) <= 0.01 AS sp FROM lineitem GROUP BY ALL)"""
RETAINED = f"""{RUNS}, e AS (SELECT model, replicate, 'alignment_gain' AS endpoint, b - a AS value, coalesce(ap, false) AS passed FROM run UNION ALL SELECT model, replicate, 'specific_gain', s - a, coalesce(ap, false) AND coalesce(sp, false) FROM run),
d AS (SELECT scenario, endpoint, model, replicate AS unit, avg(value) AS value FROM e, (VALUES ('all_runs', false, 5), ('gated_folds', true, 3), ('complete_replicates', true, 5)) c(scenario, gated, least) WHERE value IS NOT NULL AND (passed OR NOT gated) GROUP BY scenario, endpoint, model, replicate, least HAVING count(*) >= least)"""


def _runs(spark, sf_dir):
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    part = {"b": n <= 2, "s": n.isin(3, 4), "a": n > 4}
    price = {k: F.avg(F.when(c, F.col("l_extendedprice"))) / 1000 for k, c in part.items()}
    cost = {k: F.avg(F.when(c, F.col("l_discount"))) for k, c in part.items()}
    return li.groupBy(F.col("l_returnflag").alias("model"), (F.col("l_suppkey") % 20).alias("replicate"), (F.col("l_orderkey") % 5).alias("fold")).agg(
        (price["b"] - price["a"]).alias("alignment_gain"), (price["s"] - price["a"]).alias("specific_gain"), (F.abs(cost["a"] - cost["b"]) <= 0.01).alias("adapted_passed"), (F.abs(cost["s"] - cost["b"]) <= 0.01).alias("sham_passed")).withColumn(
        "both_passed", F.coalesce("adapted_passed", F.lit(False)) & F.coalesce("sham_passed", F.lit(False)))


@query(f"WITH {RETAINED}, {_tests_sql('scenario, endpoint, model', family='scenario, endpoint')}")
def retention_tests(spark, sf_dir):
    """Both endpoints under three scenarios of keeping runs."""
    t = compare.retention_tests(_runs(spark, sf_dir), "model", "replicate", {"alignment_gain": "adapted_passed", "specific_gain": "both_passed"})
    return _tested(t.drop("retained_folds", "sd", "effect"))


@query(f"WITH {RETAINED} SELECT scenario, endpoint, model, count(*) n_replicates, round(stddev_samp(value), 5) sd, round(avg(value) / stddev_samp(value), 5) effect FROM d GROUP BY ALL")
def retention_effects(spark, sf_dir):
    t = compare.retention_tests(_runs(spark, sf_dir), "model", "replicate", {"alignment_gain": "adapted_passed", "specific_gain": "both_passed"}, flips=1, resamples=1)
    return rounded(t.select("scenario", "endpoint", "model", F.col("n_units").alias("n_replicates"), "sd", "effect"), "sd", "effect", digits=5)


@query(f"WITH {RUNS}, c AS (SELECT model, 'adapted' AS condition, ap AS passed FROM run UNION ALL SELECT model, 'sham', sp FROM run) SELECT model, condition, count(*) failed_runs FROM c WHERE NOT coalesce(passed, false) GROUP BY ALL")
def retention_failures(spark, sf_dir):
    return compare.retention_failures(_runs(spark, sf_dir), "model", {"adapted": "adapted_passed", "sham": "sham_passed"})


@query("""SELECT o_orderkey, try_cast(o_totalprice::VARCHAR AS DOUBLE) AS price, (o_orderstatus = 'O')::INT::DOUBLE AS status__O, (o_orderstatus = 'P')::INT::DOUBLE AS status__P FROM orders""")
def coded_columns(spark, sf_dir):
    """A column of numbers in text and one of levels found in the data."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderstatus").alias("status"))
    return features.coded(d, ["price", "status"])


@query(f"""WITH {FACTS}, b AS (SELECT dataset, avg(value) vm, stddev_samp(value) vs, avg(t) tm, stddev_samp(t) ts FROM facts WHERE t < 28800 GROUP BY ALL)
SELECT trial, round((value - vm) / vs, 6) z_value, round((t - tm) / ts, 6) z_t, round(0.75 * (value - vm) / vs + 0.25 * (t - tm) / ts, 6) AS "index" FROM facts JOIN b USING (dataset)""")
def composite_index(spark, sf_dir):
    """Two metrics by their data set's baseline before eight o'clock, weighted three to one."""
    d = facts(spark, sf_dir)
    baseline = features.fit_baseline(d, ["dataset"], ["value", "t"], F.col("t") < 28800)
    return rounded(features.composite_index(d, baseline, ["dataset"], {"value": 3.0, "t": 1.0}), "z_value", "z_t", "index").select("trial", "z_value", "z_t", "index")


@query(f"WITH {SAMPLES} SELECT unit, channel, count(v) n, round(sum(CASE WHEN unit = 3 AND channel = 2 THEN 0 ELSE v END), 3) total FROM smp GROUP BY ALL")
def filled_channels(spark, sf_dir):
    """A channel that one unit lacks is 0 there."""
    d = samples(spark, sf_dir).withColumn("v", F.when((F.col("unit") == 3) & (F.col("channel") == 2), F.lit(None)).otherwise(F.col("v")))
    return prep.filled_channels(d, ["unit"], "channel", "v").groupBy("unit", "channel").agg(F.count("v").alias("n"), F.round(F.sum("v"), 3).alias("total"))


@query("""WITH h AS (SELECT l_suppkey % 3 AS "repeat", l_linenumber AS head, avg(((l_quantity > 25) = (l_linestatus = 'F'))::INT) b, avg(((l_discount > 0.05) = (l_linestatus = 'F'))::INT) a FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT "repeat", round(avg(b), 6) baseline, round(avg(a), 6) ablated, count(*) n_heads, round(avg(b) - avg(a), 6) "drop" FROM h GROUP BY ALL""")
def accuracy_drop(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("repeat", F.col("l_suppkey") % 3)
    r = features.accuracy_drop(d, [], "l_linenumber", F.col("l_returnflag") != "N", F.col("l_linestatus") == "F", F.col("l_quantity") > 25, F.col("l_discount") > 0.05, "repeat")
    return rounded(r, "baseline", "ablated", "drop")


@query("SELECT vec_id, i::INTEGER AS t, round(embedding[i + 1]::DOUBLE, 6) x FROM embeddings, (SELECT unnest(range(0, 64)) i)")
def tensor_rows(spark, sf_dir):
    """Arrays to rows, back to arrays and to rows again."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("x"))
    back = features.gathered(features.exploded(d, ["vec_id"], ["x"]), ["vec_id"], ["x"])
    return features.exploded(back, ["vec_id"], ["x"])


@query(f"""WITH {SAMPLES}, c AS (SELECT unit, trial, channel, max(v) - min(v) p2p, avg(v) m1, avg(v ** 2) m2, avg(v ** 3) m3, avg(v ** 4) m4, count(v) n FROM smp GROUP BY ALL),
x AS (SELECT unit, trial, max(p2p) p2p, sum(n * (m2 - m1 ** 2)) / sum(n) va, sum(n * (m4 - 4 * m1 * m3 + 6 * m1 ** 2 * m2 - 3 * m1 ** 4)) / sum(n) f FROM c GROUP BY ALL), t AS (SELECT unit, trial, p2p, va AS variance, f / greatest(va * va, 1e-300) AS kurtosis FROM x WHERE va > 1e-6),
m AS (SELECT unit, quantile_cont(variance, 0.5) vm, quantile_cont(kurtosis, 0.5) km FROM t GROUP BY unit), a AS (SELECT t.unit, quantile_cont(abs(variance - vm), 0.5) vd, quantile_cont(abs(kurtosis - km), 0.5) kd FROM t JOIN m USING (unit) GROUP BY t.unit)
SELECT unit, trial, round(kurtosis, 5) kurtosis, p2p > 45 OR round(0.67449 * (variance - vm) / greatest(vd, 1e-12), 6) > 2.5 OR round(0.67449 * (kurtosis - km) / greatest(kd, 1e-12), 6) > 2.5 AS rejected FROM t JOIN m USING (unit) JOIN a USING (unit)""")
def artefact_rejection(spark, sf_dir):
    """Trials with some variance: kurtosis, and rejection by amplitude, variance or kurtosis as the operator decides."""
    s = samples(spark, sf_dir)
    moving = s.groupBy("unit", "trial", "channel").agg(F.var_pop("v").alias("p"), F.count("v").alias("n")).groupBy("unit", "trial").agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("va")).where("va > 1e-6")
    t = prep.artefact_scores(s.join(moving.select("unit", "trial"), ["unit", "trial"], "left_semi"), ["unit"], "trial", "channel", "v", 45.0, 2.5)
    return t.select("unit", "trial", F.round("kurtosis", 5).alias("kurtosis"), "rejected")


@query("""WITH l AS (SELECT n_regionkey AS region, string_agg(n_nationkey::VARCHAR || ',' || n_name || chr(10), '' ORDER BY n_nationkey) t FROM nation GROUP BY ALL)
SELECT region::VARCHAR AS region, strlen(t)::BIGINT size_bytes, sha256(t) sha256 FROM l""")
def file_digests(spark, sf_dir):
    """One text file a region: its size and digest as they lie in the store."""
    path = files.scratch(spark, "texts")
    lines = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("line"))
    lines.repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey").drop("n_nationkey").write.partitionBy("n_regionkey").text(path)
    found = files.inventory(spark, path).where(F.col("path").endswith(".txt"))
    return found.select(F.regexp_extract("path", "n_regionkey=([^/]+)", 1).alias("region"), "size_bytes", "sha256")


@query("SELECT user_id, event_type, count(*) n_rows FROM events GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return contracts.duplicate_keys(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 25")
def open_values(spark, sf_dir):
    """Rows whose logarithm is infinite, no number or null."""
    x = F.when(F.col("l_quantity") > 25, F.log(F.col("l_quantity") - 25)).when(F.col("l_quantity") == 25, F.lit(float("-inf"))).when(F.col("l_quantity") > 10, F.lit(float("nan")))
    return contracts.non_finite(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")), ["x"]).select("l_orderkey", "l_linenumber")


@query(f"WITH {MATCH} SELECT bin, round(spread, 6) spread, spread <= 0.02 + 1e-12 AS eligible FROM mt")
def accuracy_match_tight(spark, sf_dir):
    """A tolerance that some bins miss."""
    return rounded(matching.matching_table(performance(spark, sf_dir), "model", "bin", 0.5, 0.02).select("bin", "spread", "eligible"), "spread")


@query(SQL["leave_one_dataset_out"].replace(" cosine FROM prof", " cosine, round(avg((sign(value) = sign(r))::INT), 6) sign_agreement FROM prof"))
def leave_one_out_signs(spark, sf_dir):
    p = profiles(spark, sf_dir)
    ref = p.groupBy(F.col("model").alias("src"), "metric").agg(F.avg("value").alias("value"))
    return rounded(compare.leave_one_out(p, ref, "src", ["model"]), "rms", "cosine", "sign_agreement")


@query(f"""WITH {FACTS}, g AS (SELECT * FROM (VALUES (0, 21600.0), (1, 43200.0), (2, 64800.0)) v(step, requested)), r AS (SELECT dataset, step, requested, t, row_number() OVER (PARTITION BY dataset, step ORDER BY abs(t - requested), t) rn FROM facts, g)
SELECT dataset, step, requested::DOUBLE AS requested, t FROM r WHERE rn = 1""")
def nearest_grid(spark, sf_dir):
    """The sampled times nearest to six, twelve and eighteen o'clock."""
    return prep.nearest_grid(facts(spark, sf_dir), ["dataset"], "t", [21600.0, 43200.0, 64800.0])


@query(f"""WITH s AS ({SQL['group_splits']}), b AS (SELECT fold, source FROM s WHERE NOT (fold = 0 AND split = 'test') UNION ALL SELECT fold, source FROM s WHERE fold = 1 AND split = 'test'), n AS (SELECT fold, source, count(*) n FROM b GROUP BY ALL), e AS (SELECT f.fold, k.source FROM (SELECT DISTINCT fold FROM b) f, (SELECT DISTINCT source FROM s) k)
SELECT * FROM (SELECT fold, source, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS problem FROM e LEFT JOIN n USING (fold, source)) WHERE problem IS NOT NULL""")
def split_faults(spark, sf_dir):
    """Splits that were broken in two ways: one fold lacks its test groups, another has them twice."""
    d = table(spark, sf_dir, "documents").where("source is not null")
    s = folds.group_splits(d, "source")
    broken = s.where("not (fold = 0 and split = 'test')").unionByName(s.where("fold = 1 and split = 'test'"))
    return contracts.partition_faults(broken.select("fold", "source"), d.select("source"), "source", ["fold"])


@query("SELECT o_orderpriority, o_orderstatus AS tests__status, count(*) tests__n FROM orders GROUP BY ALL")
def nested_reports(spark, sf_dir):
    """Counts as one JSON document for each priority, written, read and flattened again."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    documents = files.documents_of(counts, ["o_orderpriority"], "tests")
    back = documents.select("o_orderpriority", F.from_json("document", "tests array<struct<status: string, n: bigint>>")["tests"].alias("tests"))
    return files.flattened(back, "tests")
