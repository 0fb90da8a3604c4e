"""More registered queries: predicates, joins, aggregates, sets, contracts, preparation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evenkeel.functions import levels as lv
from evenkeel.operators import compare, contracts, contrast, decisions, features, linear, matching, prep, resample
from evenkeel.plans.catalogue import PERF, PRIMARY, PROFILE, SQL, STAGE, contrasts, facts, performance, profiles, query, rounded, samples, signatures, stages, table
from evenkeel.plans.tables import FACTS, SIGNATURES


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' || l_returnflag || ' ' WHEN 2 THEN l_linenumber::DOUBLE::VARCHAR WHEN 3 THEN l_linenumber::VARCHAR ELSE (l_discount + 0.005)::VARCHAR END AS raw FROM lineitem)
SELECT raw, CASE WHEN raw IS NULL THEN '<missing>' WHEN floor(try_cast(trim(raw) AS DOUBLE)) = try_cast(trim(raw) AS DOUBLE) THEN try_cast(trim(raw) AS DOUBLE)::BIGINT::VARCHAR ELSE trim(raw) END AS level, regexp_replace(raw, '\\.0$', '') AS stripped, count(*) n FROM r GROUP BY ALL""")
def level_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    raw = F.when(k == 0, None).when(k == 1, F.concat(F.lit(" "), "l_returnflag", F.lit(" "))).when(k == 2, F.col("l_linenumber").cast("double").cast("string")).when(k == 3, F.col("l_linenumber").cast("string")).otherwise((F.col("l_discount") + 0.005).cast("string"))
    d = li.select(raw.alias("raw"))
    return d.select("raw", lv.level_key(F.col("raw")).alias("level"), lv.strip_zero(F.col("raw")).alias("stripped")).groupBy("raw", "level", "stripped").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FACTS} SELECT trial, level, value FROM facts WHERE t BETWEEN 3600 AND 7200 AND level IN ('purchase', 'error') AND dataset = 1")
def window_filter(spark, sf_dir):
    d = contrast.in_window(facts(spark, sf_dir), 3600.0, 7200.0)
    return d.where(F.col("level").isin("purchase", "error") & (F.col("dataset") == 1)).select("trial", "level", "value")


@query(f"""WITH {FACTS}, b AS (SELECT unit, avg(value) m, stddev_samp(value) s FROM facts WHERE t < 28800 GROUP BY unit) SELECT trial, round((value - m) / s, 6) z, round(0.75 * (value - m) / s + 0.25 * t / 86400, 6) AS idx FROM facts JOIN b USING (unit) WHERE s > 0""")
def baseline_index(spark, sf_dir):
    d = facts(spark, sf_dir)
    b = d.where("t < 28800").groupBy("unit").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where("s > 0")
    z = (F.col("value") - F.col("m")) / F.col("s")
    return d.join(b, "unit").select("trial", F.round(z, 6).alias("z"), F.round(0.75 * z + 0.25 * F.col("t") / 86400, 6).alias("idx"))


@query(f"WITH {FACTS} SELECT trial, (level = 'error')::INT::DOUBLE level__error, (level = 'purchase')::INT::DOUBLE level__purchase, (level = 'signup')::INT::DOUBLE level__signup, (level = 'view')::INT::DOUBLE level__view FROM facts")
def dummy_columns(spark, sf_dir):
    return features.dummies(facts(spark, sf_dir).select("trial", "level"), "level", ["click", "error", "purchase", "signup", "view"]).drop("level")


@query(f"WITH {FACTS}, o AS (SELECT unit, min(t) FILTER (WHERE level = 'signup') AS onset FROM facts GROUP BY unit), r AS (SELECT f.unit, trial, onset, row_number() OVER (PARTITION BY f.unit ORDER BY abs(t - onset) NULLS LAST, t, trial) rn FROM facts f JOIN o USING (unit)) SELECT unit, sum(CASE WHEN onset IS NOT NULL AND rn = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS impulses FROM r GROUP BY unit")
def impulse_column(spark, sf_dir):
    d = facts(spark, sf_dir)
    on = d.groupBy("unit").agg(F.min(F.when(F.col("level") == "signup", F.col("t"))).alias("onset"))
    return features.impulse(d.join(on, "unit"), ["unit"], "t", F.col("onset")).groupBy("unit").agg(F.sum("impulse").alias("impulses"))


@query("SELECT event_id, round(exp(-0.5 * ((hour(ts) - 0.0) / 11.5) ** 2 * (11.5 / (1.5 * 11.5)) ** 2), 6) basis_0, round(exp(-0.5 * ((hour(ts) - 11.5) / 17.25) ** 2), 6) basis_1, round(exp(-0.5 * ((hour(ts) - 23.0) / 17.25) ** 2), 6) basis_2 FROM events")
def time_basis(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.hour("ts").alias("h"))
    return rounded(features.time_basis(d, "h", 0.0, 23.0, 3).drop("h"), "basis_0", "basis_1", "basis_2")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN round(ln(l_quantity - 25), 6) END AS x FROM lineitem")
def finite_only(spark, sf_dir):
    raw = F.when(F.col("l_quantity") > 25, F.log(F.col("l_quantity") - 25)).when(F.col("l_quantity") == 25, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(lv.finite(raw), 6).alias("x"))


@query("SELECT url, TRY_CAST(nullif(regexp_extract(url, '/(\\d+)\\?', 1), '') AS INTEGER) AS number, regexp_extract(url, 'example\\.com/([a-z]+)', 1) AS part FROM pages")
def path_attributes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", r"/(\d+)\?", 1).try_cast("int").alias("number"), F.regexp_extract("url", r"example\.com/([a-z]+)", 1).alias("part"))


@query("SELECT TRY_CAST(nullif(regexp_extract('Stimulus/S ' || (event_id % 80)::VARCHAR, 'S\\s*(\\d+)\\s*$', 1), '') AS INTEGER) AS code, count(*) n FROM events GROUP BY ALL")
def trigger_codes(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(lv.trigger_code(F.concat(F.lit("Stimulus/S "), (F.col("event_id") % 80).cast("string"))).alias("code"))
    return d.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT substr(sha256(c_custkey::VARCHAR), 1, 12) AS who, concat_ws('::', c_mktsegment, c_nationkey::VARCHAR) AS stratum FROM customer")
def redacted_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(lv.redacted(F.col("c_custkey")).alias("who"), F.concat_ws("::", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("stratum"))


@query(f"""WITH {FACTS} SELECT dataset, unit, trial, CASE WHEN level = positive THEN 1 ELSE 0 END AS outcome FROM facts JOIN (VALUES (0, 'purchase', 'view'), (1, 'click', 'error'), (2, 'signup', 'view')) s(ds, positive, negative) ON ds = dataset WHERE level IN (positive, negative)""")
def harmonised_outcomes(spark, sf_dir):
    spec = spark.createDataFrame([(0, "purchase", "view"), (1, "click", "error"), (2, "signup", "view")], "dataset long, positive string, negative string")
    return decisions.harmonised(facts(spark, sf_dir), spec, "dataset", "level").select("dataset", "unit", "trial", "outcome")


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def many_to_one_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return contracts.many_to_one(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), o, ["l_orderkey"])


@query("SELECT doc_id, quality, toxic, lang FROM documents JOIN labels USING (doc_id)")
def one_to_one_join(spark, sf_dir):
    return contracts.one_to_one(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def roster_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").alias("o_custkey")
    o = table(spark, sf_dir, "orders").join(c.where("c_acctbal > 5000").select(key), "o_custkey", "left_semi")
    return o.join(c.where("c_mktsegment = 'BUILDING'").select(key), "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT l_partkey AS p_partkey, p_brand, count(*) n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def aligned_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return contracts.aligned(keys, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"])


@query(f"WITH {FACTS}, g AS (SELECT unit, floor(t / 3600) h FROM facts GROUP BY unit, h HAVING count(DISTINCT level) = 5) SELECT f.trial FROM facts f JOIN g ON f.unit = g.unit AND floor(f.t / 3600) = g.h")
def complete_groups(spark, sf_dir):
    d = facts(spark, sf_dir).withColumn("h", F.floor(F.col("t") / 3600))
    return contracts.complete_groups(d, ["unit", "h"], "level", 5).select("trial")


@query(f"WITH {PROFILE}, f AS (SELECT metric, replicate % 2 AS half, avg(value) v FROM prof GROUP BY ALL) SELECT a.metric, round(a.v - b.v, 6) AS difference FROM f a JOIN f b ON a.metric = b.metric AND a.half = 0 AND b.half = 1")
def aligned_difference(spark, sf_dir):
    f = profiles(spark, sf_dir).groupBy("metric", (F.col("replicate") % 2).alias("half")).agg(F.avg("value").alias("v"))
    a, b = f.where("half = 0").select("metric", F.col("v").alias("a")), f.where("half = 1").select("metric", F.col("v").alias("b"))
    return a.join(b, "metric").select("metric", F.round(F.col("a") - F.col("b"), 6).alias("difference"))


@query(f"WITH {STAGE}, c AS (SELECT model, avg(correct::INT) acc FROM sig GROUP BY model), g AS (SELECT model, avg(adapted - baseline) gain FROM sw GROUP BY model), n AS (SELECT model, count(*) rws FROM sig GROUP BY model) SELECT model, round(acc, 6) acc, round(gain, 5) gain, rws AS n_rows FROM c JOIN g USING (model) LEFT JOIN n USING (model)")
def evidence_matrix(spark, sf_dir):
    s = signatures(spark, sf_dir)
    acc = s.groupBy("model").agg(F.round(F.avg(F.col("correct").cast("int")), 6).alias("acc"))
    gain = stages(spark, sf_dir).groupBy("model").agg(F.round(F.avg("total_gain"), 5).alias("gain"))
    return acc.join(gain, "model").join(s.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows")), "model", "left")


@query(f"WITH {STAGE}, r AS (SELECT model AS ref, avg(baseline) b, avg(adapted) a, avg(sham) s FROM sw GROUP BY model) SELECT model, replicate, ref, round(sqrt(((adapted - a) ** 2 + (baseline - b) ** 2 + (sham - s) ** 2) / 3), 5) rms FROM sw, r")
def stage_reference_fan_out(spark, sf_dir):
    d = stages(spark, sf_dir).select("model", "replicate", "adapted", "baseline", "sham")
    ref = d.groupBy(F.col("model").alias("ref")).agg(F.avg("baseline").alias("b"), F.avg("adapted").alias("a"), F.avg("sham").alias("s"))
    ms = ((F.col("adapted") - F.col("a")) ** 2 + (F.col("baseline") - F.col("b")) ** 2 + (F.col("sham") - F.col("s")) ** 2) / 3
    return d.crossJoin(F.broadcast(ref)).select("model", "replicate", "ref", F.round(F.sqrt(ms), 5).alias("rms"))  # one row per model


@query(f"WITH {SIGNATURES} SELECT model, replicate, sum(correct::INT)::BIGINT n_correct, count(*) n, round(avg(gain), 5) gain, round(avg(concentration), 6) concentration FROM sig GROUP BY ALL")
def run_summary(spark, sf_dir):
    d = signatures(spark, sf_dir).groupBy("model", "replicate").agg(F.sum(F.col("correct").cast("bigint")).alias("n_correct"), F.count(F.lit(1)).alias("n"), F.round(F.avg("gain"), 5).alias("gain"), F.round(F.avg("concentration"), 6).alias("concentration"))
    return d


@query("SELECT l_returnflag, min(l_quantity) lo, quantile_cont(l_quantity, 0.5) med, quantile_cont(l_quantity, 0.75) p75, quantile_cont(l_quantity, 0.9) p90, quantile_cont(l_quantity, 0.95) p95, max(l_quantity) hi, sum((l_discount > 0.05)::INT)::BIGINT n_true, count(*) total FROM lineitem GROUP BY ALL")
def quantile_profile(spark, sf_dir):
    q = F.percentile("l_quantity", F.array(*[F.lit(x) for x in (0.5, 0.75, 0.9, 0.95)]))
    d = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").alias("lo"), q.alias("q"), F.max("l_quantity").alias("hi"), F.sum((F.col("l_discount") > 0.05).cast("bigint")).alias("n_true"), F.count(F.lit(1)).alias("total"))
    return d.select("l_returnflag", "lo", F.col("q")[0].alias("med"), F.col("q")[1].alias("p75"), F.col("q")[2].alias("p90"), F.col("q")[3].alias("p95"), "hi", "n_true", "total")


@query(f"WITH {PERF}, o AS (SELECT model, quantile_cont(rate, 0.5) obs FROM perf GROUP BY model) SELECT model, round(avg((rate <= obs)::INT), 6) percentile, round(quantile_cont(rate, 0.95), 6) p95, obs > quantile_cont(rate, 0.95) AS passed FROM perf JOIN o USING (model) GROUP BY model, obs")
def null_percentile(spark, sf_dir):
    p = performance(spark, sf_dir)
    o = p.groupBy("model").agg(F.percentile("rate", F.lit(0.5)).alias("obs"))
    d = p.join(o, "model").groupBy("model", "obs").agg(F.avg((F.col("rate") <= F.col("obs")).cast("int")).alias("percentile"), F.percentile("rate", F.lit(0.95)).alias("p95"))
    return d.select("model", F.round("percentile", 6).alias("percentile"), F.round("p95", 6).alias("p95"), (F.col("obs") > F.col("p95")).alias("passed"))


@query("SELECT col, val, count(*) n FROM (SELECT unnest([{'col': 'status', 'val': o_orderstatus}, {'col': 'priority', 'val': o_orderpriority}], recursive := true) FROM orders) GROUP BY ALL")
def value_counts(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return d.unpivot([], ["status", "priority"], "col", "val").groupBy("col", "val").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FACTS}, f AS (SELECT dataset, sum((level = 'error')::INT)::BIGINT failed, count(*) expected FROM facts GROUP BY ALL) SELECT dataset, failed, expected, round(failed / greatest(expected, 1), 6) AS fraction, failed / greatest(expected, 1) > 0.2 AS over_ceiling FROM f")
def failure_fraction(spark, sf_dir):
    f = facts(spark, sf_dir).groupBy("dataset").agg(F.sum((F.col("level") == "error").cast("bigint")).alias("failed"), F.count(F.lit(1)).alias("expected"))
    r = F.col("failed") / F.greatest("expected", F.lit(1))
    return f.select("dataset", "failed", "expected", F.round(r, 6).alias("fraction"), (r > 0.2).alias("over_ceiling"))


@query(f"WITH {PERF} SELECT model, sum((rate > 0.45)::INT)::BIGINT passed, sum((rate > 0.45)::INT) >= 100 AS enough FROM perf GROUP BY model")
def success_count(spark, sf_dir):
    d = performance(spark, sf_dir).groupBy("model").agg(F.sum((F.col("rate") > 0.45).cast("bigint")).alias("passed"))
    return d.withColumn("enough", F.col("passed") >= 100)


@query("SELECT c_mktsegment, coalesce(sum((c_acctbal >= 0)::INT), 0)::BIGINT included, coalesce(sum((c_acctbal < 0)::INT), 0)::BIGINT excluded FROM customer GROUP BY ALL")
def crosstab(spark, sf_dir):
    d = table(spark, sf_dir, "customer").withColumn("k", F.when(F.col("c_acctbal") >= 0, "included").otherwise("excluded"))
    return d.groupBy("c_mktsegment").pivot("k", ["included", "excluded"]).count().na.fill(0)


@query("SELECT o_custkey, count(*) n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def minimum_group_size(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")


@query("SELECT least(20, floor((l_quantity - 1) / (49.0 / 20)) + 1)::BIGINT AS bucket, count(*) n FROM lineitem GROUP BY ALL")
def histogram(spark, sf_dir):
    b = F.least(F.lit(20), F.width_bucket("l_quantity", F.lit(1.0), F.lit(50.0), F.lit(20)))
    return table(spark, sf_dir, "lineitem").groupBy(b.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events ORDER BY sha256('9|' || event_id::VARCHAR), event_id LIMIT 500")
def deterministic_sample(spark, sf_dir):
    """A sampling operator: the 500 rows that come first by hash."""
    return table(spark, sf_dir, "events").select("event_id").orderBy(F.sha2(F.concat(F.lit("9|"), F.col("event_id").cast("string")), 256), "event_id").limit(500)


@query(f"WITH {FACTS}, u AS (SELECT unit, avg((level = 'error')::INT) bad, count(*) n, avg((value > 100)::INT) big FROM facts GROUP BY unit) SELECT unit, concat_ws(';', CASE WHEN bad >= 0.15 THEN 'bad_channels' END, CASE WHEN big > 0.2 THEN 'components' END, CASE WHEN n < 50 THEN 'trials' END) AS reasons, NOT (bad >= 0.15 OR big > 0.2 OR n < 50) AS include FROM u")
def qc_decision(spark, sf_dir):
    u = facts(spark, sf_dir).groupBy("unit").agg(F.avg((F.col("level") == "error").cast("int")).alias("bad"), F.count(F.lit(1)).alias("n"), F.avg((F.col("value") > 100).cast("int")).alias("big"))
    return prep.qc_decision(u, [("bad_channels", F.col("bad") >= 0.15), ("components", F.col("big") > 0.2), ("trials", F.col("n") < 50)]).select("unit", "reasons", "include")


@query("WITH s AS (SELECT l_orderkey trial, l_linenumber t, l_quantity v, avg(l_quantity) OVER (PARTITION BY l_orderkey) m FROM lineitem) SELECT trial, round(sum(abs(v - m)), 4) s FROM s GROUP BY trial")
def average_reference(spark, sf_dir):
    d = prep.average_reference(samples(spark, sf_dir), ["trial"], "v")
    return d.groupBy("trial").agg(F.round(F.sum(F.abs("referenced")), 4).alias("s"))


@query("WITH b AS (SELECT l_orderkey trial, l_linenumber t, l_quantity v, avg(l_quantity) FILTER (WHERE l_linenumber <= 2) OVER (PARTITION BY l_orderkey) base FROM lineitem) SELECT trial, round(sum(v - base), 4) + 0.0 AS s FROM b GROUP BY trial")
def baseline_correction(spark, sf_dir):
    d = prep.baseline_corrected(samples(spark, sf_dir), ["trial"], "t", "v", 0, 2)
    return d.groupBy("trial").agg((F.round(F.sum("corrected"), 4) + F.lit(0.0)).alias("s"))


@query(f"WITH {FACTS} SELECT unit, floor(t * 0.0005)::BIGINT AS bucket, round(avg(value), 6) AS value, count(*) n FROM facts GROUP BY ALL")
def down_sampling(spark, sf_dir):
    return rounded(prep.down_sampled(facts(spark, sf_dir), ["unit"], "t", "value", 0.0005), "value")


@query("WITH c AS (SELECT l_suppkey AS ch, bool_and(l_quantity < 2) a, bool_or(l_quantity < 2) o FROM lineitem GROUP BY ALL) SELECT ch, CASE WHEN a THEN 'all' WHEN o THEN 'some' ELSE 'none' END AS missing FROM c")
def channel_missingness(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ch"), F.when(F.col("l_quantity") >= 2, F.col("l_quantity")).alias("v"))
    return prep.channel_missingness(d, ["ch"], "v")


@query("WITH q AS (SELECT quantile_cont(s_acctbal, 1/3) a, quantile_cont(s_acctbal, 2/3) b FROM supplier) SELECT s_suppkey, concat_ws('-', CASE WHEN s_acctbal <= a THEN 'posterior' WHEN s_acctbal <= b THEN 'central' ELSE 'anterior' END, CASE WHEN s_nationkey - 12 < 0 THEN 'left' ELSE 'right' END) AS region FROM supplier, q")
def channel_regions(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").withColumn("x", F.col("s_nationkey") - 12)
    return prep.region_of(d, "s_acctbal", "x").select("s_suppkey", "region")


@query("SELECT event_id, printf('%s-%04d', user_id::VARCHAR, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS trial_id FROM events")
def trial_ids(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    return prep.numbered(d, ["user_id"], ["event_id"], F.col("user_id").cast("string")).select("event_id", "trial_id")


@query("SELECT conv_id, turn, coalesce(sum(length(text)::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM conversations")
def time_offsets(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("double"))
    return prep.time_offsets(d, ["conv_id"], "turn", "n").select("conv_id", "turn", F.col("offset").alias("offs"))


@query("""WITH a AS (SELECT user_id, event_id AS a_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) p, count(*) OVER (PARTITION BY user_id) n FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, event_id AS b_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) p, count(*) OVER (PARTITION BY user_id) n FROM events WHERE event_type = 'view') SELECT a.user_id, a.p::INTEGER AS position, a_id, b_id FROM a JOIN b ON a.user_id = b.user_id AND a.p = b.p AND a.n = b.n""")
def positional_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("a_id"))
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("b_id"))
    return prep.paired_by_position(a, b, ["user_id"], ["a_id"], ["b_id"])


@query(f"WITH {PRIMARY} SELECT dataset, max_by(unit, (round(contrast, 9), -unit)) AS best, round(max(contrast), 6) contrast FROM pc GROUP BY dataset")
def best_candidate(spark, sf_dir):
    d = contrasts(spark, sf_dir).groupBy("dataset").agg(F.max_by("unit", F.struct(F.round("contrast", 9), -F.col("unit"))).alias("best"), F.max("contrast").alias("contrast"))
    return rounded(d, "contrast")


@query("(SELECT DISTINCT o_custkey AS k, 'ordered' AS how FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) UNION ALL (SELECT c_custkey, 'idle' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))")
def key_sets(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return o.intersect(c).withColumn("how", F.lit("ordered")).unionByName(c.exceptAll(o.distinct()).withColumn("how", F.lit("idle")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return contracts.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_mktsegment, max((c_acctbal > 9990)::INT)::BOOLEAN AS covered FROM customer GROUP BY ALL")
def level_coverage(spark, sf_dir):
    return contracts.included_by_level(table(spark, sf_dir, "customer"), "c_mktsegment", F.col("c_acctbal") > 9990)


@query(f"WITH {PERF} SELECT model, replicate, bin FROM perf WHERE sample_count <= 0 OR abs(round(rate, 2) - correct_count / sample_count) > 0.004")
def reconciliation(spark, sf_dir):
    p = performance(spark, sf_dir)
    return contracts.reconcile(p, F.round("rate", 2), F.col("correct_count"), F.col("sample_count"), 0.004).select("model", "replicate", "bin")


@query("SELECT p_partkey FROM part WHERE p_size IS NULL OR p_retailprice IS NULL")
def non_finite_rows(spark, sf_dir):
    return contracts.non_finite(table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_size", "p_retailprice"]).select("p_partkey")


@query("WITH a AS (SELECT c_name AS path, c_custkey AS size, sha256(c_name) AS h FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_name AS path, CASE WHEN c_custkey % 11 = 0 THEN c_custkey + 1 ELSE c_custkey END AS size, CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE sha256(c_name) END AS h FROM customer WHERE c_custkey % 5 <> 0) SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN a.size <> b.size THEN 'size' WHEN a.h <> b.h THEN 'sha256' END AS problem FROM a FULL JOIN b ON a.path = b.path) WHERE problem IS NOT NULL")
def manifest_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("path"), F.col("c_custkey").alias("size_bytes"), F.sha2("c_name", 256).alias("sha256"))
    a = c.where("size_bytes % 7 <> 0")
    b = c.where("size_bytes % 5 <> 0").select("path", F.when(F.col("size_bytes") % 11 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), F.when(F.col("size_bytes") % 13 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return contracts.manifest_diff(a, b)


@query("SELECT event_id, (props::JSON ->> 'k') AS props__k FROM events")
def flattened_json(spark, sf_dir):
    from evenkeel.sources.files import flattened

    d = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k string").alias("props"))
    return flattened(d, "props")


@query(f"WITH {FACTS}, h AS (SELECT unit, CASE WHEN t < 43200 THEN 'am' ELSE 'pm' END AS head, avg((value > 50)::INT) a FROM facts WHERE level <> 'signup' GROUP BY ALL) SELECT unit, round(avg(a), 6) accuracy, count(*) n_heads FROM h GROUP BY unit")
def masked_accuracy(spark, sf_dir):
    d = facts(spark, sf_dir).withColumn("head", F.when(F.col("t") < 43200, "am").otherwise("pm"))
    return rounded(features.masked_accuracy(d, ["unit"], "head", F.col("level") != "signup", F.col("value") > 50), "accuracy")


@query("WITH v AS (SELECT label, embedding::DOUBLE[] x FROM embeddings) SELECT label, i, j, round(sum(x[i] * x[j]), 4) + 0.0 AS s FROM v, (SELECT unnest(range(1, 9)) i), (SELECT unnest(range(1, 9)) j) WHERE j <= i GROUP BY ALL")
def gram_moments(spark, sf_dir):
    return _gram_moments(table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 8).alias("x")))


@query(SQL["gram_moments"].replace("range(1, 9)", "range(1, 65)"))
def gram_moments_full(spark, sf_dir):
    return _gram_moments(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("x")))


def _gram_moments(d):
    m = linear.moments(d, ["label"], "x").where("i > 0 and j > 0")
    return m.select("label", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.round("s", 4) + F.lit(0.0)).alias("s"))


@query()
def pca_whitening(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("x"))
    w = linear.whitened(d, linear.whitening(d, ["label"], "x", 4), ["label"], "x")
    return w.select("vec_id", *[F.round(F.col("white")[i], 4).alias(f"w{i}") for i in range(4)])


@query()
def ridge_readout(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("label", F.filter("embedding", lambda _, i: i != 10).alias("x"), F.col("embedding")[10].cast("double").alias("y"))  # all others predict it
    return rounded(linear.ridge(d, ["label"], "x", "y"), "intercept", "residual_sd", "r2")


def _matrices(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings")
    m = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.transform(F.slice("embedding", i * 3 + 1, 3), lambda x: x.cast("double")))
    return d.select((F.col("vec_id") % 50).alias("trial"), F.floor(F.col("vec_id") / 50).alias("t"), m.alias("m"))


@query("WITH e AS (SELECT vec_id % 50 AS trial, vec_id // 50 AS t, embedding::DOUBLE[] x FROM embeddings) SELECT trial, t, round(list_sum(list_transform(x[1:9], lambda v: v * v)) / 3, 6) AS gain FROM e")
def matrix_gain(spark, sf_dir):
    return linear.geometry(_matrices(spark, sf_dir), ["trial", "t"], "m").select("trial", "t", F.round("gain", 6).alias("gain"))


@query("""WITH e AS (SELECT vec_id % 50 AS trial, vec_id // 50 AS t, embedding::DOUBLE[] x FROM embeddings),
r AS (SELECT trial, t, x[1]**2 + x[2]**2 + x[3]**2 r0, x[4]**2 + x[5]**2 + x[6]**2 r1, x[7]**2 + x[8]**2 + x[9]**2 r2, x[1]**2 + x[4]**2 + x[7]**2 a, x[2]**2 + x[5]**2 + x[8]**2 b, x[3]**2 + x[6]**2 + x[9]**2 c,
 x[1]*x[2] + x[4]*x[5] + x[7]*x[8] ab, x[1]*x[3] + x[4]*x[6] + x[7]*x[9] ac, x[2]*x[3] + x[5]*x[6] + x[8]*x[9] bc FROM e),
q AS (SELECT *, (a + b + c) / 3 q FROM r), p AS (SELECT *, sqrt(((a - q)**2 + (b - q)**2 + (c - q)**2 + 2 * (ab**2 + ac**2 + bc**2)) / 6) p FROM q),
f AS (SELECT *, acos(greatest(-1.0, least(1.0, ((a - q) * ((b - q) * (c - q) - bc**2) - ab * (ab * (c - q) - bc * ac) + ac * (ab * bc - (b - q) * ac)) / (2 * p**3)))) / 3 f FROM p),
v AS (SELECT *, q + 2 * p * cos(f) e1, q + 2 * p * cos(f + 2 * pi() / 3) e3 FROM f), w AS (SELECT *, 3 * q - e1 - e3 e2 FROM v),
n AS (SELECT trial, t, 3 * q AS total, list_filter([e1, e2, e3], lambda y: y > 0) es, list_filter([r0, r1, r2], lambda y: y > 0) rs FROM w)
SELECT trial, t, round(total / 3, 6) gain, round(list_max(es) / total, 6) concentration, round(exp(-list_sum(list_transform(es, lambda y: y / total * ln(y / total)))), 6) effective_rank, round(-list_sum(list_transform(rs, lambda y: y / total * ln(y / total))) / ln(3), 6) broadcast FROM n""")
def matrix_geometry(spark, sf_dir):
    return rounded(linear.geometry(_matrices(spark, sf_dir), ["trial", "t"], "m"), "gain", "concentration", "effective_rank", "broadcast")


@query("""WITH e AS (SELECT vec_id % 50 AS trial, vec_id // 50 AS t, embedding::DOUBLE[] x FROM embeddings), c AS (SELECT trial, t, i, j, x[i * 3 + j + 1] v FROM e, (SELECT unnest(range(0, 3)) i), (SELECT unnest(range(0, 3)) j))
SELECT a.trial, a.t, b.i AS r, a.j AS c, round(sum(b.v * a.v), 6) v FROM c a JOIN c b ON a.trial = b.trial AND b.t = a.t + 1 AND a.i = b.j GROUP BY ALL""")
def ordered_propagators(spark, sf_dir):
    p = linear.propagators(_matrices(spark, sf_dir), ["trial"], "t", "m", 2)
    r = p.select("trial", "t", F.posexplode("propagator").alias("r", "row")).select("trial", "t", F.col("r").cast("long").alias("r"), F.posexplode("row").alias("c", "v"))
    return r.select("trial", "t", "r", F.col("c").cast("long").alias("c"), F.round("v", 6).alias("v"))


@query("WITH v AS (SELECT vec_id, (embedding::DOUBLE[])[1:8] a, (embedding::DOUBLE[])[9:16] b FROM embeddings) SELECT vec_id, round(list_dot_product(a, b) / list_dot_product(b, b), 6) AS k, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - list_dot_product(a, b) / list_dot_product(b, b) * z[2]))), 5) AS rest FROM v")
def removed_direction(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("a"), F.slice("embedding", 9, 8).alias("b"))
    r = linear.without_direction(d, "a", "b")
    return r.select("vec_id", F.round(lv.dot(F.col("a"), F.col("b")) / lv.dot(F.col("b"), F.col("b")), 6).alias("k"), F.round(F.aggregate(F.transform("removed", lambda x: F.abs(x)), F.lit(0.0), lambda s, x: s + x), 5).alias("rest"))


@query("""WITH g AS (SELECT l_suppkey % 5 AS i, l_partkey % 5 AS j, count(*) v FROM lineitem GROUP BY ALL), n AS (SELECT DISTINCT i AS n FROM g UNION SELECT DISTINCT j FROM g),
p AS (SELECT n, row_number() OVER (ORDER BY n) k FROM n), m AS (SELECT n AS m, row_number() OVER (ORDER BY sha256(concat_ws('|', '1', n::VARCHAR)), n) k FROM n), pm AS (SELECT n, m FROM p JOIN m USING (k)) SELECT a.m AS i, b.m AS j, v FROM g JOIN pm a ON a.n = g.i JOIN pm b ON b.n = g.j""")
def joint_permutation(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("i"), (F.col("l_partkey") % 5).alias("j")).agg(F.count(F.lit(1)).alias("v"))
    return linear.joint_permutation(g, "i", "j", "v")


@query()
def clock_alignment(spark, sf_dir):
    """Behaviour clocks derived from the trigger log: every user's purchases against all of the user's events, on a clock that drifts."""
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 % 10_000_000).alias("t"), "event_type")
    b = e.where("event_type = 'purchase'").select("user_id", ((F.col("t") - 17.25) / 1.00005).alias("t"))
    g = prep.align_clocks(b, e.where("event_type in ('purchase', 'error')"), "user_id")
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("slope"), 6).alias("slope"), F.bool_and("ok").alias("ok"))


@query(f"WITH {STAGE}, f AS (SELECT model, replicate, adapted - baseline AS contrast, draw, CASE WHEN substr(sha256(concat_ws('|', '7', draw::VARCHAR, replicate::VARCHAR)), 1, 1) < '8' THEN 1.0 ELSE -1.0 END sgn FROM sw, (SELECT unnest(range(1, 201)) AS draw) d), n AS (SELECT model, draw, avg(contrast * sgn) nul FROM f GROUP BY ALL), o AS (SELECT model, avg(adapted - baseline) mean, count(*) n_units FROM sw GROUP BY ALL), p AS (SELECT model, mean, n_units, (1 + sum((round(nul, 9) >= round(mean, 9))::INT)) / 201 AS p_value FROM n JOIN o USING (model) GROUP BY model, mean, n_units), h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, model) + 1) * p_value st FROM p) SELECT model, round(mean, 5) mean, n_units, round(p_value, 6) p_value, round(least(1.0, max(st) OVER (ORDER BY p_value, model ROWS UNBOUNDED PRECEDING)), 6) p_holm FROM h")
def stage_tests(spark, sf_dir):
    return _stage_tests(spark, sf_dir, 200)


@query(SQL["stage_tests"].replace("range(1, 201)", "range(1, 10001)").replace("/ 201", "/ 10001"))
def stage_tests_full(spark, sf_dir):
    return _stage_tests(spark, sf_dir, 10_000)


def _stage_tests(spark, sf_dir, n):
    d = stages(spark, sf_dir).withColumn("contrast", F.col("total_gain"))
    p = resample.sign_flip(d, ["model"], unit="replicate", n=n).withColumn("family", F.lit("gain"))
    return rounded(rounded(resample.holm(p, ["family"], key="model").drop("family"), "p_value", "p_holm"), "mean", digits=5)


@query(f"WITH {PROFILE}, m AS (SELECT model, replicate, avg(value) v FROM prof GROUP BY ALL), r AS (SELECT model, avg(v) mean, stddev_samp(v) sd, count(DISTINCT replicate) n, bool_and(v > 0) positive FROM m GROUP BY model) SELECT model, round(mean, 6) mean, round(sd, 6) sd, n, positive FROM r")
def model_roll_up(spark, sf_dir):
    m = profiles(spark, sf_dir).groupBy("model", "replicate").agg(F.avg("value").alias("v"))
    return rounded(m.groupBy("model").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.countDistinct("replicate").alias("n"), F.bool_and(F.col("v") > 0).alias("positive")), "mean", "sd")


@query(f"WITH {PROFILE}, s AS (SELECT metric, stddev_samp(value) sd FROM prof WHERE model = 'A' GROUP BY metric) SELECT model, replicate, metric, round(value / sd, 5) AS scaled FROM prof JOIN s USING (metric)")
def profile_scaling(spark, sf_dir):
    p = profiles(spark, sf_dir)
    s = p.where("model = 'A'").groupBy("metric").agg(F.stddev_samp("value").alias("sd"))
    return p.join(s, "metric").select("model", "replicate", "metric", F.round(F.col("value") / F.col("sd"), 5).alias("scaled"))


@query("WITH t AS (SELECT user_id, event_type, avg(value) m FROM events GROUP BY ALL) SELECT event_type, sum((m > 50)::INT)::BIGINT n_high, round(avg(m), 5) mean, rank FROM (SELECT *, dense_rank() OVER (ORDER BY event_type)::INTEGER AS rank FROM t) GROUP BY ALL")
def ranked_levels(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(lv.steady_mean(F.col("value")).alias("m"))  # a mean of just 50 is not high in any order of the rows
    g = t.groupBy("event_type").agg(F.sum((F.col("m") > 50).cast("bigint")).alias("n_high"), F.round(F.avg("m"), 5).alias("mean"))
    return g.withColumn("rank", F.dense_rank().over(Window.orderBy("event_type")))  # one row per level


@query("WITH p AS (SELECT l_suppkey % 10 AS k, '[' || round(avg(l_discount) - 0.05, 4)::VARCHAR || ', ' || round(avg(l_discount), 4)::VARCHAR || ']' AS ci FROM lineitem GROUP BY ALL) SELECT sum((TRY_CAST(regexp_extract(ci, '\\[([^,]*),', 1) AS DOUBLE) > 0)::INT)::BIGINT AS n_positive, count(*) n FROM p")
def positive_bounds(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("k")).agg(F.concat(F.lit("["), F.round(F.avg("l_discount") - 0.05, 4).cast("string"), F.lit(", "), F.round(F.avg("l_discount"), 4).cast("string"), F.lit("]")).alias("ci"))
    low = F.regexp_extract("ci", r"\[([^,]*),", 1).try_cast("double")
    return p.agg(F.sum((low > 0).cast("bigint")).alias("n_positive"), F.count(F.lit(1)).alias("n"))
