"""Queries over declared mappings, decisions, assembled features, stage geometry and replication."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import compare, decisions
from evenkeel.plans.catalogue import PROFILE, STAGE, profiles, query, rounded, stages
from evenkeel.plans.tables import SIGNATURES, signatures, table


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER - 1 AS trial, 'orders' AS dataset, o_totalprice AS value FROM orders""")
def mapped_columns(spark, sf_dir):
    mapping = {"trial": "__row_index__", "dataset": "__literal__:orders", "value": "o_totalprice"}
    return decisions.map_columns(table(spark, sf_dir, "orders"), mapping, ["o_custkey"], ["o_orderkey"])


@query("""SELECT event_id, round(value * CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.001 ELSE 0.000001 END, 9) AS volts FROM events""")
def scaled_units(spark, sf_dir):
    unit = decisions.lookup(F.col("event_id") % 3, {0: "V", 1: "mV", 2: "uV"})
    volts = decisions.to_base_unit(F.col("value"), unit, {"V": 1.0, "mV": 1e-3, "uV": 1e-6})
    return table(spark, sf_dir, "events").select("event_id", F.round(volts, 9).alias("volts"))


@query("""SELECT CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' END AS outcome, CASE l_linestatus WHEN 'F' THEN 'closed' ELSE 'other' END AS state, count(*) n FROM lineitem GROUP BY ALL""")
def decoded_codes(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(
        decisions.lookup(F.col("l_returnflag"), {"R": "returned", "A": "accepted"}).alias("outcome"), decisions.lookup(F.col("l_linestatus"), {"F": "closed"}, F.lit("other")).alias("state"))
    return d.groupBy("outcome", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) > 200000 AS passed FROM orders GROUP BY ALL)
SELECT o_custkey, bool_or(passed) FILTER (WHERE o_orderstatus = 'F') closed_gate_passed, bool_or(passed) FILTER (WHERE o_orderstatus = 'O') open_gate_passed FROM g GROUP BY ALL""")
def pivoted_gates(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg((F.max("o_totalprice") > 200_000).alias("passed"))
    return decisions.pivot_first(g, ["o_custkey"], "o_orderstatus", {"F": "closed_gate_passed", "O": "open_gate_passed"}, "passed")


@query("""WITH w AS (SELECT o_custkey AS k, avg(o_totalprice) gain__early FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), c AS (SELECT o_custkey AS k, max(o_totalprice) gfp__early FROM orders GROUP BY ALL), d AS (SELECT c_custkey AS k, c_nationkey AS nation FROM customer)
SELECT k, round(gfp__early, 6) gfp__early, round(gain__early, 6) gain__early, nation, nation AS outcome FROM c JOIN w USING (k) JOIN d USING (k)""")
def feature_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    windowed = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.round(F.avg("o_totalprice"), 6).alias("gain__early"))
    conventional = o.groupBy("k").agg(F.round(F.max("o_totalprice"), 6).alias("gfp__early"))
    conditions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    return decisions.feature_table(windowed, conventional, conditions, ["k"], "nation", o, "o_orderkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(l_discount) < 0.08)""")
def valid_trials(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    valid = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_discount").alias("top")).where("top < 0.08")
    return decisions.keep_valid(valid, ["o_orderkey"], table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))[0]


QC = """qc AS (SELECT l_suppkey AS unit, round(avg(l_discount), 9) > 0.0499 AND round(avg(l_tax), 9) < 0.0401 AS included, round(avg(l_discount), 9) <= 0.0499 AS a, round(avg(l_tax), 9) >= 0.0401 AS b FROM lineitem GROUP BY ALL),
dec AS (SELECT s_suppkey AS unit, s_nationkey AS nation, CASE WHEN s_acctbal <= 0 THEN false ELSE included END AS included, CASE WHEN s_acctbal <= 0 THEN 'source_inventory' WHEN NOT included THEN 'preprocessing_qc' END AS exclusion_stage,
CASE WHEN s_acctbal <= 0 THEN 'account' WHEN NOT included THEN concat_ws('; ', CASE WHEN a THEN 'discount' END, CASE WHEN b THEN 'tax' END) END AS reason FROM supplier LEFT JOIN qc ON unit = s_suppkey)"""


def _decisions(spark, sf_dir):
    roster = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), (F.col("s_acctbal") > 0).alias("include"), F.lit("account").alias("reason"))
    stats = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg((F.round(F.avg("l_discount"), 9) <= 0.0499).alias("a"), (F.round(F.avg("l_tax"), 9) >= 0.0401).alias("b"))
    qc = stats.select("unit", (~F.col("a") & ~F.col("b")).alias("included"), F.array_compact(F.array(F.when(F.col("a"), "discount"), F.when(F.col("b"), "tax"))).alias("deviations"))
    return decisions.qc_decisions(roster, qc, ["unit"])


@query(f"WITH {QC} SELECT unit, included, exclusion_stage, reason FROM dec")
def qc_decision_table(spark, sf_dir):
    return _decisions(spark, sf_dir)


@query(f"""WITH {QC} SELECT nation, count(*) acquired, count(*) FILTER (WHERE included) included, count(*) FILTER (WHERE exclusion_stage = 'source_inventory') at_source, count(*) FILTER (WHERE exclusion_stage = 'preprocessing_qc') at_qc, bool_or(included) AS ready FROM dec GROUP BY ALL""")
def qc_decision_counts(spark, sf_dir):
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("nation"))
    return decisions.qc_counts(_decisions(spark, sf_dir).join(nation, "unit"), ["nation"])


@query(f"""WITH {STAGE}, t AS (SELECT avg(gain) AS r FROM sig WHERE model = 'A'), x AS (SELECT model, baseline - r AS b, adapted - r AS a FROM sw, t)
SELECT model, round(avg(abs(b) - abs(a)), 6) improvement, count(abs(b) - abs(a)) n, round(avg((abs(b) - abs(a) > 0)::INT), 6) nearer FROM x GROUP BY ALL""")
def residual_improvement(spark, sf_dir):
    target = signatures(spark, sf_dir).where("model = 'A'").agg(F.avg("gain").alias("r"))
    wide = stages(spark, sf_dir).crossJoin(F.broadcast(target)).select("model", "replicate", *[(F.col(s) - F.col("r")).alias(s) for s in ("baseline", "adapted")])  # one row
    return rounded(decisions.residual_improvement(wide, ["model"], "baseline", "adapted"), "improvement", "nearer")


@query(f"""WITH {PROFILE}, m AS (SELECT model, metric, avg(value) v FROM prof GROUP BY ALL), s AS (SELECT metric, stddev_samp(value) scale FROM prof WHERE model = 'A' GROUP BY ALL), u AS (SELECT model, count(DISTINCT replicate) units FROM prof GROUP BY ALL)
SELECT m.model, round(sqrt(avg(((m.v - c.v) / scale) ** 2)), 6) distance, round(avg((sign(m.v) = sign(c.v))::INT), 6) same_direction, any_value(units) units
FROM m JOIN m c ON c.model = 'A' AND c.metric = m.metric JOIN s ON s.metric = m.metric JOIN u ON u.model = m.model GROUP BY m.model""")
def replication_table(spark, sf_dir):
    p = profiles(spark, sf_dir)
    scale = p.where("model = 'A'").groupBy("metric").agg(F.stddev_samp("value").alias("scale"))
    return rounded(decisions.replication(p, "model", "A", scale, "replicate"), "distance", "same_direction")


@query(f"""WITH {PROFILE}, h AS (SELECT replicate % 5 AS fold, metric, value FROM prof WHERE model = 'A'), f AS (SELECT DISTINCT fold FROM h), r AS (SELECT f.fold, h.metric, avg(value) AS reference FROM f JOIN h ON h.fold <> f.fold GROUP BY ALL),
x AS (SELECT model, replicate, p.metric, value, reference, r.fold FROM prof p JOIN r ON r.metric = p.metric AND r.fold = p.replicate % 5)
SELECT model, fold, round(sqrt(avg((value - reference) ** 2)), 6) rms, round(sum(value * reference) / sqrt(sum(value * value) * sum(reference * reference)), 6) cosine, round(sqrt(sum(value * value) / sum(reference * reference)), 6) magnitude FROM x GROUP BY ALL""")
def stage_geometry(spark, sf_dir):
    p = profiles(spark, sf_dir).withColumn("fold", F.col("replicate") % 5)
    reference = decisions.held_out_reference(p.where("model = 'A'"), "fold")
    return rounded(decisions.stage_geometry(decisions.stage_residuals(p, reference, "fold"), ["model", "fold"]), "rms", "cosine", "magnitude")


def _tests_sql(by: str, two_sided: bool = False, family: str | None = None, draws: int = 10_000) -> str:
    """Common table expressions and the select of paired tests over ``d(by, unit, value)``."""
    size = "round(abs(nul), 9) >= round(abs(mean), 9)" if two_sided else "round(nul, 9) >= round(mean, 9)"
    over = f"PARTITION BY {family}" if family else ""
    adjusted = f", round(least(1.0, max(step) OVER ({over} ORDER BY p_value, {by} ROWS UNBOUNDED PRECEDING)), 6) p_holm" if family else ""
    return f"""o AS (SELECT {by}, avg(value) mean, count(value) n_units FROM d GROUP BY ALL),
dr AS (SELECT unnest(range(1, {draws + 1})) AS draw),
nu AS (SELECT {by}, draw, avg(value * CASE WHEN substr(sha256(concat_ws('|', '7', draw::VARCHAR, unit::VARCHAR)), 1, 1) < '8' THEN 1.0 ELSE -1.0 END) nul FROM d, dr GROUP BY ALL),
p AS (SELECT {by}, mean, n_units, (1 + sum(({size})::INT)) / {draws + 1} AS p_value FROM nu JOIN o USING ({by}) GROUP BY {by}, mean, n_units),
r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS size FROM d),
s AS (SELECT {by}, draw, ('0x' || substr(sha256(concat_ws('|', '3', draw::VARCHAR, i::VARCHAR)), 1, 8))::BIGINT % size AS i FROM r, dr),
m AS (SELECT {by}, draw, avg(value) m FROM s JOIN r USING ({by}, i) GROUP BY ALL),
c AS (SELECT {by}, quantile_cont(m, 0.025) ci_low, quantile_cont(m, 0.975) ci_high FROM m GROUP BY ALL),
h AS (SELECT *, (count(*) OVER ({over}) - row_number() OVER ({over} ORDER BY p_value, {by}) + 1) * p_value step FROM p JOIN c USING ({by}))
SELECT {by}, round(mean, 5) mean, n_units, round(ci_low, 5) ci_low, round(ci_high, 5) ci_high, round(p_value, 6) p_value{adjusted} FROM h"""


def _tested(df):
    return rounded(rounded(df, "mean", "ci_low", "ci_high", digits=5), *[c for c in ("p_value", "p_holm") if c in df.columns])


@query(f"""WITH {STAGE}, w AS (SELECT model, replicate AS unit, adapted - baseline AS total_gain, sham - baseline AS sham_gain, adapted - sham AS specific_gain FROM sw),
d AS (UNPIVOT w ON total_gain, sham_gain, specific_gain INTO NAME endpoint VALUE value), {_tests_sql("endpoint, model", family="endpoint")}""")
def stage_gain_tests(spark, sf_dir):
    """All three gains of every model, adjusted within each gain."""
    long = stages(spark, sf_dir).unpivot(["model", "replicate"], ["total_gain", "sham_gain", "specific_gain"], "endpoint", "value")
    return _tested(compare.paired_tests(long, ["endpoint", "model"], "value", "replicate", ["endpoint"]))


@query(f"""WITH {SIGNATURES}, d AS (SELECT model, correct, replicate AS unit, avg(gain) FILTER (WHERE bin > 4) - avg(gain) FILTER (WHERE bin <= 2) AS value FROM sig GROUP BY ALL HAVING value IS NOT NULL), {_tests_sql("model, correct")}""")
def transfer_tests(spark, sf_dir):
    """Gain from the first to the last stage of every model in every evaluated contrast."""
    staged = signatures(spark, sf_dir).withColumn("stage", F.when(F.col("bin") <= 2, "baseline").when(F.col("bin") <= 4, "sham").otherwise("adapted"))
    change = compare.paired_change(staged, ["model", "correct", "replicate"], "stage", "gain", "adapted", "baseline")
    return _tested(compare.paired_tests(change, ["model", "correct"], "change", "replicate"))


@query(f"""WITH {SIGNATURES}, d AS (SELECT model, replicate AS unit, avg(concentration) FILTER (WHERE bin > 4) - avg(concentration) FILTER (WHERE bin <= 2) AS value FROM sig GROUP BY ALL HAVING value IS NOT NULL), {_tests_sql("model")}""")
def intervention_tests(spark, sf_dir):
    """Change of the intervention's specificity from the first to the last stage of every model."""
    staged = signatures(spark, sf_dir).withColumn("stage", F.when(F.col("bin") <= 2, "baseline").when(F.col("bin") <= 4, "sham").otherwise("adapted"))
    change = compare.paired_change(staged, ["model", "replicate"], "stage", "concentration", "adapted", "baseline")
    return _tested(compare.paired_tests(change, ["model"], "change", "replicate"))


@query(f"""WITH {PROFILE}, g AS (SELECT model, replicate, avg(value) v FROM prof GROUP BY ALL), d AS (SELECT a.model left_model, b.model right_model, replicate AS unit, a.v - b.v AS value FROM g a JOIN g b USING (replicate) WHERE a.model < b.model), {_tests_sql("left_model, right_model", two_sided=True)}""")
def pairwise_model_tests(spark, sf_dir):
    """Every pair of models over shared replicates, two-sided."""
    g = profiles(spark, sf_dir).groupBy("model", "replicate").agg(F.avg("value").alias("value"))
    d = compare.pair_differences(g, "model", "replicate", "value")
    return _tested(compare.paired_tests(d, ["left_model", "right_model"], "difference", "replicate", two_sided=True))
