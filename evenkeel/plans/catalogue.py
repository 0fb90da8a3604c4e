"""Registered queries over the given tables, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import levels as lv
from evenkeel.operators import compare, contracts, contrast, features, folds, linear, matching, prep, resample
from evenkeel.plans.tables import FACTS, METRICS, SIGNATURES, facts, signatures, table
from evenkeel.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


WINDOW = (6 * 3600.0, 18 * 3600.0)
PRIMARY = f"""{FACTS},
pt AS (SELECT dataset, unit, level, trial, avg(value) m FROM facts WHERE t BETWEEN 21600 AND 64800 AND level IN ('purchase', 'view') GROUP BY ALL),
pw AS (SELECT dataset, unit, avg(m) FILTER (WHERE level = 'purchase') positive, avg(m) FILTER (WHERE level = 'view') negative FROM pt GROUP BY ALL),
pc AS (SELECT dataset, unit, positive, negative, positive - negative AS contrast FROM pw WHERE positive IS NOT NULL AND negative IS NOT NULL)"""


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrast.primary_contrast(facts(spark, sf_dir), "purchase", "view", WINDOW)


@query(f"WITH {PRIMARY} SELECT dataset, unit, round(positive, 6) positive, round(negative, 6) negative, round(contrast, 6) contrast FROM pc")
def primary_contrast(spark, sf_dir):
    return rounded(contrasts(spark, sf_dir), "positive", "negative", "contrast")


FLIPS = "SELECT pc.*, d.draw, CASE WHEN substr(sha256(concat_ws('|', '7', d.draw::VARCHAR, unit::VARCHAR)), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS sgn FROM pc, (SELECT unnest(range(1, 501)) AS draw) d"


@query(f"""WITH {PRIMARY}, f AS ({FLIPS}), n AS (SELECT dataset, draw, avg(contrast * sgn) AS nul FROM f GROUP BY ALL), o AS (SELECT dataset, avg(contrast) mean, count(*) n_units FROM pc GROUP BY ALL)
SELECT dataset, round(mean, 6) mean, n_units, round((1 + sum((round(nul, 9) >= round(mean, 9))::INT)) / 501, 6) p_value FROM n JOIN o USING (dataset) GROUP BY dataset, mean, n_units""")
def sign_flip(spark, sf_dir):
    return rounded(resample.sign_flip(contrasts(spark, sf_dir), ["dataset"], n=500), "mean", "p_value")


@query(f"""WITH {PRIMARY}, f AS ({FLIPS}), n AS (SELECT dataset, draw, avg(contrast * sgn) AS nul FROM f GROUP BY ALL), o AS (SELECT dataset, avg(contrast) mean, count(*) n_units FROM pc GROUP BY ALL)
SELECT dataset, round(mean, 6) mean, n_units, round((1 + sum((round(abs(nul), 9) >= round(abs(mean), 9))::INT)) / 501, 6) p_value FROM n JOIN o USING (dataset) GROUP BY dataset, mean, n_units""")
def sign_flip_two_sided(spark, sf_dir):
    return rounded(resample.sign_flip(contrasts(spark, sf_dir), ["dataset"], n=500, two_sided=True), "mean", "p_value")


@query(f"""WITH {PRIMARY}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS size FROM pc),
s AS (SELECT dataset, draw, ('0x' || substr(sha256(concat_ws('|', '3', draw::VARCHAR, i::VARCHAR)), 1, 8))::BIGINT % size AS pick FROM r, (SELECT unnest(range(1, 201)) AS draw) d),
m AS (SELECT s.dataset, draw, avg(contrast) m FROM s JOIN r ON r.dataset = s.dataset AND r.i = s.pick GROUP BY ALL)
SELECT dataset, round(quantile_cont(m, 0.025), 6) ci_low, round(quantile_cont(m, 0.975), 6) ci_high FROM m GROUP BY dataset""")
def bootstrap_ci(spark, sf_dir):
    return rounded(resample.bootstrap_ci(contrasts(spark, sf_dir), ["dataset"], n=200), "ci_low", "ci_high")


@query(SQL["sign_flip"].replace("range(1, 501)", "range(1, 5001)").replace("/ 501", "/ 5001"))
def sign_flip_full(spark, sf_dir):
    return rounded(resample.sign_flip(contrasts(spark, sf_dir), ["dataset"]), "mean", "p_value")


@query(SQL["sign_flip_two_sided"].replace("range(1, 501)", "range(1, 5001)").replace("/ 501", "/ 5001"))
def sign_flip_two_sided_full(spark, sf_dir):
    return rounded(resample.sign_flip(contrasts(spark, sf_dir), ["dataset"], two_sided=True), "mean", "p_value")


@query(SQL["bootstrap_ci"].replace("range(1, 201)", "range(1, 10001)"))
def bootstrap_ci_full(spark, sf_dir):
    return rounded(resample.bootstrap_ci(contrasts(spark, sf_dir), ["dataset"]), "ci_low", "ci_high")


HOURS = f"{FACTS}, ft AS (SELECT *, floor(t / 3600)::BIGINT AS bin FROM facts), tc AS (SELECT dataset, unit, bin, avg(value) FILTER (WHERE level = 'purchase') - avg(value) FILTER (WHERE level = 'view') AS contrast FROM ft GROUP BY ALL HAVING contrast IS NOT NULL)"


def hourly(spark, sf_dir):
    return contrast.timecourse(facts(spark, sf_dir).withColumn("bin", F.floor(F.col("t") / 3600)), "purchase", "view", "bin")


@query(f"WITH {HOURS} SELECT dataset, unit, bin, round(contrast, 6) contrast FROM tc")
def contrast_timecourse(spark, sf_dir):
    return rounded(hourly(spark, sf_dir), "contrast")


@query(f"WITH {HOURS}, b AS (SELECT dataset, bin, avg(contrast) mean, stddev_samp(contrast) / sqrt(count(contrast)) sem, count(contrast) n FROM tc GROUP BY ALL) SELECT dataset, bin, round(mean, 6) mean, round(sem, 6) sem, n, round(mean - 1.96 * sem, 6) low, round(mean + 1.96 * sem, 6) high FROM b")
def timecourse_ci(spark, sf_dir):
    return rounded(contrast.mean_band(hourly(spark, sf_dir), ["dataset", "bin"]), "mean", "sem", "low", "high")


@query(f"WITH {HOURS} SELECT dataset, bin, round(avg(contrast) / (stddev_samp(contrast) / sqrt(count(contrast))), 6) t_stat, count(contrast) n FROM tc GROUP BY ALL")
def t_statistics(spark, sf_dir):
    return rounded(resample.t_statistic(hourly(spark, sf_dir), ["dataset", "bin"]), "t_stat")


RUNS = """q AS (SELECT {k}, bin, t_stat, (t_stat > 0.5)::INT AS onn FROM {src} WHERE t_stat IS NOT NULL), q2 AS (SELECT *, CASE WHEN onn = 1 AND coalesce(lag(onn) OVER (PARTITION BY {k} ORDER BY bin), 0) = 0 THEN 1 ELSE 0 END AS nw FROM q),
q3 AS (SELECT *, sum(nw) OVER (PARTITION BY {k} ORDER BY bin)::BIGINT AS run FROM q2), runs AS (SELECT {k}, run, min(bin) AS start, max(bin) AS stop, count(*) AS length, sum(t_stat) AS mass FROM q3 WHERE onn = 1 GROUP BY ALL)"""


@query(f"WITH {HOURS}, ts AS (SELECT dataset, bin, avg(contrast) / (stddev_samp(contrast) / sqrt(count(contrast))) t_stat FROM tc GROUP BY ALL), {RUNS.format(k='dataset', src='ts')} SELECT dataset, run, start, stop, length, round(mass, 6) mass FROM runs")
def runs_above_threshold(spark, sf_dir):
    d = resample.t_statistic(hourly(spark, sf_dir), ["dataset", "bin"]).where("t_stat is not null")
    return rounded(resample.runs_above(d, ["dataset"], "bin", "t_stat", 0.5), "mass")


@query()
def cluster_sign_flip(spark, sf_dir):
    """The statistic of every bin, as in the reference, and the cluster that it lies in, if any."""
    d = hourly(spark, sf_dir)
    c = resample.cluster_sign_flip(d, ["dataset"], "bin").withColumnRenamed("dataset", "_d")
    t = resample.t_statistic(d, ["dataset", "bin"]).where("t_stat is not null")
    return rounded(t.join(c, F.col("dataset").eqNullSafe(F.col("_d")) & F.col("bin").between(F.col("start"), F.col("stop")), "left").drop("_d"), "t_stat", "mass", "p_value")


@query(f"""WITH {HOURS}, p AS (SELECT dataset, bin, 1 / (1 + exp(avg(contrast) / 10)) AS p_value FROM tc GROUP BY ALL),
r AS (SELECT *, (count(*) OVER (PARTITION BY dataset) - row_number() OVER (PARTITION BY dataset ORDER BY p_value, bin) + 1) * p_value AS st FROM p)
SELECT dataset, bin, round(p_value, 6) p_value, round(least(1.0, max(st) OVER (PARTITION BY dataset ORDER BY p_value, bin ROWS UNBOUNDED PRECEDING)), 6) p_holm FROM r""")
def holm(spark, sf_dir):
    p = hourly(spark, sf_dir).groupBy("dataset", "bin").agg((1 / (1 + F.exp(F.avg("contrast") / 10))).alias("p_value"))
    return rounded(resample.holm(p, ["dataset"], key="bin"), "p_value", "p_holm")


# The 0.95 quantiles of Student's t for 1 to 64 degrees of freedom, for the SQL of up to 65 units.
T95 = [
    6.313751514675, 2.919985580354, 2.353363434802, 2.131846786327, 2.015048373333, 1.943180280515, 1.89457860509, 1.859548037531,
    1.833112932656, 1.812461122812, 1.795884818704, 1.782287555649, 1.770933395987, 1.761310135775, 1.753050355693, 1.745883676276,
    1.739606726075, 1.734063606618, 1.729132811521, 1.724718242921, 1.720742902812, 1.71714437438, 1.713871527747, 1.710882079909,
    1.708140761252, 1.705617919759, 1.703288445722, 1.701130934266, 1.699127026533, 1.697260886594, 1.695518782546, 1.693888748384,
    1.69236030903, 1.690924255187, 1.68957245778, 1.688297714117, 1.687093619596, 1.685954460167, 1.684875121711, 1.683851013336,
    1.682878002133, 1.681952357468, 1.681070703203, 1.680229976572, 1.679427392652, 1.678660413557, 1.677926721642, 1.677224196124,
    1.676550892617, 1.675905025163, 1.675284950425, 1.674689153726, 1.674116236703, 1.673564906352, 1.67303396529, 1.672522303076,
    1.672028888461, 1.671552762455, 1.671093032104, 1.670648864905, 1.670219483774, 1.669804162512, 1.669402221707, 1.669013025024,
]
HALF = f"coalesce(({T95})[n - 1], CASE WHEN n > 1 THEN NULL ELSE 0.0 END) * sem"


@query(f"""WITH {PRIMARY}, g AS (SELECT dataset, avg(contrast) mean, count(contrast) n, coalesce(stddev_samp(contrast) / sqrt(count(contrast)), 0.0) sem FROM pc GROUP BY dataset)
SELECT dataset, round(mean, 6) mean, n, round(sem, 6) sem, round(mean - {HALF}, 6) low, round(mean + {HALF}, 6) high FROM g""")
def t_interval(spark, sf_dir):
    return rounded(resample.t_interval(contrasts(spark, sf_dir), ["dataset"]), "mean", "sem", "low", "high")


@query()
def bayes_factors(spark, sf_dir):
    return rounded(resample.bayes_factors(contrasts(spark, sf_dir), ["dataset"]), "mean", "sd", "bayes_factor")


@query(f"""WITH {SIGNATURES}, z AS (SELECT model, replicate, correct, ln(greatest(gain, 1e-12)) gain, ln(greatest(1e-6, least(1 - 1e-6, broadcast)) / (1 - greatest(1e-6, least(1 - 1e-6, broadcast)))) broadcast,
atanh(sqrt(greatest(0.0, least(1 - 1e-6, persistence)))) persistence, ln(greatest(1e-6, least(1 - 1e-6, concentration)) / (1 - greatest(1e-6, least(1 - 1e-6, concentration)))) concentration FROM sig),
w AS (SELECT model, replicate, avg(gain) FILTER (WHERE correct) - avg(gain) FILTER (WHERE NOT correct) gain, avg(broadcast) FILTER (WHERE correct) - avg(broadcast) FILTER (WHERE NOT correct) broadcast,
avg(persistence) FILTER (WHERE correct) - avg(persistence) FILTER (WHERE NOT correct) persistence, avg(concentration) FILTER (WHERE correct) - avg(concentration) FILTER (WHERE NOT correct) concentration FROM z GROUP BY ALL)
SELECT model, replicate, metric, round(contrast, 6) contrast FROM (UNPIVOT w ON gain, broadcast, persistence, concentration INTO NAME metric VALUE contrast)""")
def four_metric_contrast(spark, sf_dir):
    return rounded(contrast.long_contrasts(transformed(spark, sf_dir), "true", "false", METRICS, ["model", "replicate"], level="correct"), "contrast")


def transformed(spark, sf_dir):
    s = signatures(spark, sf_dir)
    return s.withColumns({"gain": lv.log_gain(F.col("gain")), "broadcast": lv.logit(F.col("broadcast")), "persistence": lv.fisher_root(F.col("persistence")), "concentration": lv.logit(F.col("concentration"))})


SPECS = [("c0", 0, "purchase", "view", 0.0, 43200.0), ("c1", 0, "click", "error", 21600.0, 64800.0), ("c2", 1, "purchase", "error", 0.0, 86400.0), ("c3", 2, "signup", "view", 43200.0, 86400.0)]
SPEC_SQL = "specs(contrast_id, dataset, positive, negative, start, stop) AS (VALUES " + ", ".join(str(s) for s in SPECS) + ")"


@query(f"""WITH {FACTS}, {SPEC_SQL} SELECT * FROM (SELECT contrast_id, unit, round(avg(value) FILTER (WHERE level = positive) - avg(value) FILTER (WHERE level = negative), 6) contrast
FROM facts f JOIN specs s ON f.dataset = s.dataset AND t BETWEEN start AND stop GROUP BY ALL) WHERE contrast IS NOT NULL""")
def spec_contrasts(spark, sf_dir):
    specs = spark.createDataFrame(SPECS, "contrast_id string, dataset long, positive string, negative string, start double, stop double")
    return rounded(contrast.spec_contrasts(facts(spark, sf_dir), specs, ["unit"]), "contrast")


PERF = f"{SIGNATURES}, perf AS (SELECT model, replicate, bin, sum(correct::INT)::BIGINT correct_count, count(*) sample_count, sum(correct::INT) / count(*) rate FROM sig GROUP BY ALL)"


def performance(spark, sf_dir):
    return matching.performance_by_bin(signatures(spark, sf_dir), ["model", "replicate"], "bin", F.col("correct"))


@query(f"WITH {PERF} SELECT model, replicate, bin, correct_count, sample_count, round(rate, 6) rate FROM perf")
def performance_by_bin(spark, sf_dir):
    return rounded(performance(spark, sf_dir), "rate")


MATCH = f"{PERF}, pm AS (SELECT model, bin, sum(correct_count) / sum(sample_count) rate FROM perf GROUP BY ALL), mt AS (SELECT bin, avg(rate) grand_mean, max(rate) - min(rate) spread, count(*) n_models FROM pm GROUP BY ALL)"


@query(f"WITH {PERF} SELECT model, round(sum(correct_count) / sum(sample_count), 6) rate FROM perf GROUP BY model")
def pooled_rate(spark, sf_dir):
    return rounded(matching.pooled_rate(performance(spark, sf_dir), ["model"]), "rate")


@query(f"WITH {MATCH} SELECT bin, round(grand_mean, 6) grand_mean, round(spread, 6) spread, n_models, round(abs(grand_mean - 0.5), 6) distance, spread <= 0.99 AS eligible FROM mt")
def accuracy_match(spark, sf_dir):
    return rounded(matching.matching_table(performance(spark, sf_dir), "model", "bin", 0.5, 0.99), "grand_mean", "spread", "distance")


@query(f"WITH {MATCH} SELECT (SELECT bin FROM mt WHERE spread <= 0.99 ORDER BY round(abs(grand_mean - 0.5), 9), bin LIMIT 1) AS matched_bin")
def matched_bin(spark, sf_dir):
    return matching.matched_bin(matching.matching_table(performance(spark, sf_dir), "model", "bin", 0.5, 0.99), "bin")


IPW = f"{MATCH}, ow AS (SELECT model, bin, greatest(1e-4, least(1 - 1e-4, rate)) own FROM pm), iw AS (SELECT model, bin, avg(own) OVER (PARTITION BY bin) / own AS weight_correct, (1 - avg(own) OVER (PARTITION BY bin)) / (1 - own) AS weight_wrong FROM ow)"


@query(f"WITH {IPW} SELECT model, bin, round(weight_correct, 6) weight_correct, round(weight_wrong, 6) weight_wrong FROM iw")
def ipw_weights(spark, sf_dir):
    return rounded(matching.stabilised_weights(performance(spark, sf_dir), "model", "bin"), "weight_correct", "weight_wrong")


@query(f"""WITH {IPW}, j AS (SELECT s.model, replicate, correct, gain, CASE WHEN correct THEN weight_correct ELSE weight_wrong END w FROM sig s JOIN iw USING (model, bin)),
a AS (SELECT model, replicate, sum(w * gain) FILTER (WHERE correct) / sum(w) FILTER (WHERE correct) correct_mean, sum(w * gain) FILTER (WHERE NOT correct) / sum(w) FILTER (WHERE NOT correct) wrong_mean,
coalesce(sum(w) FILTER (WHERE correct), 0) x, coalesce(sum(w) FILTER (WHERE NOT correct), 0) y FROM j GROUP BY ALL)
SELECT model, replicate, round(correct_mean, 5) correct_mean, round(wrong_mean, 5) wrong_mean, round(correct_mean - wrong_mean, 5) contrast FROM a WHERE x > 0 AND y > 0""")
def weighted_contrast(spark, sf_dir):
    w = matching.stabilised_weights(performance(spark, sf_dir), "model", "bin")
    d = signatures(spark, sf_dir).join(w, ["model", "bin"]).withColumn("w", F.when(F.col("correct"), F.col("weight_correct")).otherwise(F.col("weight_wrong")))
    return rounded(matching.weighted_contrast(d, ["model", "replicate"], F.col("correct"), "gain", F.col("w")), "correct_mean", "wrong_mean", "contrast", digits=5)


@query(f"""WITH {SIGNATURES}, z AS (SELECT model, replicate, bin, (gain - avg(gain) OVER w) / greatest(stddev_samp(gain) OVER w, 1e-4) z FROM sig WINDOW w AS (PARTITION BY model, replicate))
SELECT model, replicate, bin, round(avg(z), 5) z_mean, round(max(z), 5) z_max FROM z GROUP BY ALL""")
def group_zscore(spark, sf_dir):
    z = matching.group_zscore(signatures(spark, sf_dir), ["model", "replicate"], "gain")
    return rounded(z.groupBy("model", "replicate", "bin").agg(F.avg("z").alias("z_mean"), F.max("z").alias("z_max")), "z_mean", "z_max", digits=5)


PROFILE = f"{SIGNATURES}, prof AS (UNPIVOT (SELECT model, replicate, avg(gain) / 50 gain, avg(broadcast) broadcast, avg(persistence) persistence, avg(concentration) concentration FROM sig GROUP BY ALL) ON gain, broadcast, persistence, concentration INTO NAME metric VALUE value), refp AS (SELECT metric, avg(value) AS r FROM prof WHERE model = 'A' GROUP BY ALL)"


def profiles(spark, sf_dir):
    p = signatures(spark, sf_dir).groupBy("model", "replicate").agg((F.avg("gain") / 50).alias("gain"), *[F.avg(m).alias(m) for m in METRICS[1:]])
    return p.unpivot(["model", "replicate"], METRICS, "metric", "value")


@query(f"""WITH {PROFILE}, d AS (SELECT model, sqrt(avg((value - r) ** 2)) rms, sum(value * r) / sqrt(sum(value * value) * sum(r * r)) cosine, sqrt(sum(value * value) / sum(r * r)) magnitude, avg((sign(value) = sign(r))::INT) sign_agreement FROM prof JOIN refp USING (metric) GROUP BY ALL)
SELECT model, round(rms, 6) rms, round(cosine, 6) cosine, round(magnitude, 6) magnitude, round(sign_agreement, 6) sign_agreement, row_number() OVER (ORDER BY round(rms, 9), model)::INTEGER AS rank FROM d""")
def model_distance_rank(spark, sf_dir):
    p = profiles(spark, sf_dir)
    ref = p.where("model = 'A'").groupBy("metric").agg(F.avg("value").alias("value"))
    return rounded(compare.profile_distance(p, ref, ["model"]), "rms", "cosine", "magnitude", "sign_agreement")


@query(f"""WITH {PROFILE}, g AS (SELECT model AS src, metric, avg(value) value FROM prof GROUP BY ALL), h AS (SELECT DISTINCT src AS held_out FROM g), o AS (SELECT held_out, metric, avg(value) r FROM h JOIN g ON held_out <> src GROUP BY ALL)
SELECT held_out, model, round(sqrt(avg((value - r) ** 2)), 6) rms, round(sum(value * r) / sqrt(sum(value ** 2) * sum(r ** 2)), 6) cosine FROM prof JOIN o USING (metric) GROUP BY ALL""")
def leave_one_dataset_out(spark, sf_dir):
    p = profiles(spark, sf_dir)
    ref = p.groupBy(F.col("model").alias("src"), "metric").agg(F.avg("value").alias("value"))
    return rounded(compare.leave_one_out(p, ref, "src", ["model"]), "rms", "cosine").drop("sign_agreement")


@query(f"""WITH {PROFILE}, sc AS (SELECT metric, stddev_samp(value) scale FROM prof WHERE model = 'A' GROUP BY ALL), z AS (SELECT p.model, p.metric, (p.value - b.value) / scale z FROM prof p JOIN prof b ON b.model = 'A' AND b.replicate = p.replicate AND b.metric = p.metric JOIN sc ON sc.metric = p.metric WHERE p.model <> 'A'),
g AS (SELECT model, metric, avg(z) mean, count(z) n, coalesce(stddev_samp(z) / sqrt(count(z)), 0.0) sem FROM z GROUP BY ALL), i AS (SELECT *, mean - {HALF} low, mean + {HALF} high FROM g), e AS (SELECT *, coalesce(low > -0.2 AND high < 0.2, false) equivalent FROM i)
SELECT model, metric, round(mean, 6) mean, n, round(sem, 6) sem, round(low, 6) low, round(high, 6) high, equivalent, bool_and(equivalent) OVER (PARTITION BY model) all_equivalent FROM e""")
def equivalence(spark, sf_dir):
    p = profiles(spark, sf_dir)
    base = p.where("model = 'A'").select("replicate", "metric", F.col("value").alias("base"))
    d = p.where("model <> 'A'").join(base, ["replicate", "metric"]).withColumn("difference", F.col("value") - F.col("base"))
    scale = p.where("model = 'A'").groupBy("metric").agg(F.stddev_samp("value").alias("scale"))
    return rounded(compare.equivalence(d, ["model"], "metric", "difference", scale), "mean", "sem", "low", "high")


@query(f"""WITH {PROFILE}, g AS (SELECT model, replicate, avg(value) value FROM prof GROUP BY ALL)
SELECT a.model left_model, b.model right_model, round(avg(a.value - b.value), 6) difference, count(*) n FROM g a JOIN g b ON a.replicate = b.replicate AND a.model < b.model GROUP BY ALL""")
def pairwise_models(spark, sf_dir):
    g = profiles(spark, sf_dir).groupBy("model", "replicate").agg(F.avg("value").alias("value"))
    return rounded(compare.pairwise(g, "model", "replicate", "value"), "difference")


STAGE = f"{SIGNATURES}, st AS (SELECT model, replicate, CASE WHEN bin <= 2 THEN 'baseline' WHEN bin <= 4 THEN 'sham' ELSE 'adapted' END AS stage, gain FROM sig), sw AS (SELECT model, replicate, avg(gain) FILTER (WHERE stage = 'adapted') adapted, avg(gain) FILTER (WHERE stage = 'baseline') baseline, avg(gain) FILTER (WHERE stage = 'sham') sham FROM st GROUP BY ALL)"


def stages(spark, sf_dir):
    d = signatures(spark, sf_dir).withColumn("stage", F.when(F.col("bin") <= 2, "baseline").when(F.col("bin") <= 4, "sham").otherwise("adapted"))
    return compare.stage_gains(d, ["model", "replicate"], "stage", "gain", [("total_gain", "adapted", "baseline"), ("sham_gain", "sham", "baseline"), ("specific_gain", "adapted", "sham")])


@query(f"WITH {STAGE} SELECT model, replicate, round(adapted, 5) adapted, round(baseline, 5) baseline, round(sham, 5) sham, round(adapted - baseline, 5) total_gain, round(sham - baseline, 5) sham_gain, round(adapted - sham, 5) specific_gain FROM sw")
def stage_gain(spark, sf_dir):
    return rounded(stages(spark, sf_dir), "adapted", "baseline", "sham", "total_gain", "sham_gain", "specific_gain", digits=5)


@query(f"WITH {STAGE} SELECT model, count(adapted - baseline) n, round(avg(adapted - baseline), 5) mean, round(stddev_samp(adapted - baseline), 5) sd, round(median(adapted - baseline), 5) median, round(quantile_cont(adapted - baseline, 0.75) - quantile_cont(adapted - baseline, 0.25), 5) iqr, round(avg(adapted - baseline) / stddev_samp(adapted - baseline), 5) effect FROM sw GROUP BY model")
def stage_summary(spark, sf_dir):
    return rounded(compare.summary(stages(spark, sf_dir), ["model"], "total_gain"), "mean", "sd", "median", "iqr", "effect", digits=5)


@query(f"""WITH {STAGE}, e AS (SELECT model, replicate, adapted - baseline AS contrast, scenario FROM sw, (VALUES ('all', -1e9), ('positive', 0.0), ('large', 1.0)) s(scenario, least_gain) WHERE adapted - baseline >= least_gain),
k AS (SELECT scenario, model, count(*) n, avg(contrast) mean FROM e GROUP BY ALL HAVING count(*) >= 3),
f AS (SELECT e.*, draw, CASE WHEN substr(sha256(concat_ws('|', '7', draw::VARCHAR, replicate::VARCHAR)), 1, 1) < '8' THEN 1.0 ELSE -1.0 END sgn FROM e JOIN k USING (scenario, model), (SELECT unnest(range(1, 101)) AS draw) d),
n AS (SELECT scenario, model, draw, avg(contrast * sgn) nul FROM f GROUP BY ALL)
SELECT scenario, model, n, round(mean, 5) mean, round((1 + sum((round(nul, 9) >= round(mean, 9))::INT)) / 101, 6) p_value FROM n JOIN k USING (scenario, model) GROUP BY scenario, model, n, mean""")
def retention_sensitivity(spark, sf_dir):
    return _retention(spark, sf_dir, 100)


@query(SQL["retention_sensitivity"].replace("range(1, 101)", "range(1, 10001)").replace("/ 101", "/ 10001"))
def retention_sensitivity_full(spark, sf_dir):
    return _retention(spark, sf_dir, 10_000)


def _retention(spark, sf_dir, n):
    cases = spark.createDataFrame([("all", -1e9), ("positive", 0.0), ("large", 1.0)], "scenario string, least_gain double")
    d = stages(spark, sf_dir).withColumn("contrast", F.col("total_gain")).join(F.broadcast(cases), F.col("total_gain") >= F.col("least_gain"))  # three rows
    full = d.groupBy("scenario", "model").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    p = resample.sign_flip(d.join(full.select("scenario", "model"), ["scenario", "model"], "left_semi"), ["scenario", "model"], unit="replicate", n=n)
    return rounded(rounded(p.withColumnRenamed("n_units", "n"), "p_value"), "mean", digits=5)


@query("""WITH t AS (SELECT user_id AS unit, event_type AS stratum, event_id AS trial FROM events),
o AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(concat(unit::VARCHAR, stratum, '17')), ''), lambda d: ('0x' || d)::BIGINT)), lambda a, d: (a * 16 + d) % 5) AS off FROM t)
SELECT unit, stratum, trial, (row_number() OVER (PARTITION BY unit, stratum ORDER BY sha256(concat(unit::VARCHAR, trial::VARCHAR, '17')), trial) - 1 + off) % 5 AS fold FROM o""")
def stratified_folds(spark, sf_dir):
    return folded(spark, sf_dir).withColumn("fold", F.col("fold").cast("long"))


def folded(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("stratum"), F.col("event_id").alias("trial"))
    return folds.stratified_folds(e, ["unit"], "stratum", "trial")


@query(SQL["stratified_folds"].replace("SELECT unit, stratum, trial, (row", ", f AS (SELECT unit, trial, (row").replace("FROM o", """FROM o), c AS (SELECT unit, trial, fold = 0 AS test, count(*) OVER (PARTITION BY unit, fold = 0) n, row_number() OVER (PARTITION BY unit, fold = 0 ORDER BY sha256(concat('validation17', trial::VARCHAR)), trial) r FROM f)
SELECT unit, trial, CASE WHEN test THEN 'test' WHEN r <= greatest(1, floor(n * 0.1)) THEN 'validation' ELSE 'train' END AS split FROM c"""))
def fold_split(spark, sf_dir):
    return folds.validation_split(folded(spark, sf_dir), ["unit"], "trial", 0).select("unit", "trial", "split")


@query("""WITH g AS (SELECT DISTINCT source AS k FROM documents WHERE source IS NOT NULL), o AS (SELECT k, (row_number() OVER (ORDER BY sha256(concat_ws('|', '17', k)), k) - 1) % 5 AS outr FROM g),
e AS (SELECT k, outr, unnest(range(0, 5)) AS fold FROM o), c AS (SELECT k, fold, outr = fold AS test, count(*) OVER (PARTITION BY fold, outr = fold) n, row_number() OVER (PARTITION BY fold, outr = fold ORDER BY sha256(concat_ws('|', '17', fold::VARCHAR, k)), k) r FROM e)
SELECT k AS source, fold::INTEGER AS fold, CASE WHEN test THEN 'test' WHEN r <= ceil(n * 0.2) THEN 'validation' ELSE 'train' END AS split FROM c""")
def group_splits(spark, sf_dir):
    return folds.group_splits(table(spark, sf_dir, "documents").where("source is not null"), "source")


@query(f"WITH {FACTS} SELECT unit, round(avg(value) FILTER (WHERE t BETWEEN 0 AND 28800), 6) value__early, round(avg(value) FILTER (WHERE t BETWEEN 28800 AND 57600), 6) value__middle FROM facts GROUP BY unit")
def windowed_features(spark, sf_dir):
    return rounded(features.windowed_features(facts(spark, sf_dir), ["unit"], ["value"], {"early": (0.0, 28800.0), "middle": (28800.0, 57600.0)}), "value__early", "value__middle")


SAMPLES = "smp AS (SELECT l_orderkey AS trial, l_suppkey % 5 AS channel, l_linenumber AS t, l_quantity AS v, l_suppkey % 7 AS unit FROM lineitem)"


def samples(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trial"), (F.col("l_suppkey") % 5).alias("channel"), F.col("l_linenumber").alias("t"), F.col("l_quantity").alias("v"), (F.col("l_suppkey") % 7).alias("unit"))


@query(f"WITH {SAMPLES}, c AS (SELECT trial, channel, avg(v) m, sum(v) s, sum(v * v) s2, count(v) n FROM smp GROUP BY ALL) SELECT trial, round(sum(s) / sum(n), 6) erp_mean, round(stddev_pop(m), 6) gfp, round(sum(s2) / sum(n), 6) power FROM c GROUP BY trial")
def sensor_features(spark, sf_dir):
    return rounded(features.sensor_features(samples(spark, sf_dir), ["trial"], "channel", "v"), "erp_mean", "gfp", "power")


@query(f"""WITH {SAMPLES}, c AS (SELECT unit, trial, channel, max(v) - min(v) p2p, max(abs(v)) mx, avg(v) m1, avg(v ** 2) m2, avg(v ** 3) m3, avg(v ** 4) m4, count(v) n FROM smp GROUP BY ALL),
t AS (SELECT unit, trial, max(p2p) peak_to_peak, max(mx) max_abs, sum(n * (m2 - m1 ** 2)) / sum(n) variance FROM c GROUP BY ALL),
m AS (SELECT *, quantile_cont(variance, 0.5) OVER (PARTITION BY unit) md FROM t), d AS (SELECT *, quantile_cont(abs(variance - md), 0.5) OVER (PARTITION BY unit) mad FROM m)
SELECT unit, trial, peak_to_peak, max_abs, round(variance, 4) variance, round(least(1000.0, 0.67449 * (variance - md) / greatest(mad, 1e-12)), 3) variance_z, peak_to_peak > 40 OR round(least(1000.0, 0.67449 * (variance - md) / greatest(mad, 1e-12)), 3) > 5 AS rejected FROM d""")
def artifact_rejection(spark, sf_dir):
    t = prep.artefact_scores(samples(spark, sf_dir), ["unit"], "trial", "channel", "v", 40.0)
    z = F.round(F.least(F.lit(1000.0), "variance_z"), 3)
    return t.select("unit", "trial", "peak_to_peak", "max_abs", F.round("variance", 4).alias("variance"), z.alias("variance_z"), ((F.col("peak_to_peak") > 40) | (z > 5)).alias("rejected"))


@query("""WITH w AS (SELECT user_id, event_id, event_type, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS win FROM events),
g AS (SELECT user_id, win, min(event_id) st, count(*) n_rows, min(event_id) FILTER (WHERE event_type IN ('purchase', 'error')) oa FROM w WHERE win > 0 GROUP BY ALL)
SELECT g.user_id, win AS "window", st AS start, n_rows, oa AS outcome_at, e.event_type AS first_code FROM g JOIN events e ON e.event_id = oa""")
def trigger_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return prep.trigger_windows(e, ["user_id"], "event_id", F.col("event_type") == "signup", F.col("event_type").isin("purchase", "error"), F.col("event_type"))


@query(f"""WITH {FACTS}, d AS (SELECT unit, trial, t, level, value FROM facts), o AS (SELECT unit, trial AS onset_trial, t AS onset FROM d WHERE level = 'signup')
SELECT o.unit, onset_trial, count(*) n_samples, round(sum(value), 4) total, round(min(t - onset), 6) first_at FROM o JOIN d ON o.unit = d.unit AND d.t BETWEEN onset - 300 AND onset + 900 GROUP BY ALL""")
def epoching(spark, sf_dir):
    d = facts(spark, sf_dir)
    ev = d.where("level = 'signup'").select("unit", F.col("trial").alias("onset_trial"), F.col("t").alias("onset"))
    j = prep.epochs(ev, d.select("unit", "t", "value"), ["unit"], "onset", "t", 300.0, 900.0)
    return j.groupBy("unit", "onset_trial").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.sum("value"), 4).alias("total"), F.round(F.min("relative"), 6).alias("first_at"))


@query(f"""WITH {FACTS}, a AS (SELECT unit, trial, t FROM facts WHERE level = 'purchase'), b AS (SELECT unit, t AS bt, min(trial) AS near FROM facts WHERE level = 'view' GROUP BY ALL)
SELECT a.unit, a.trial, t, min_by(near, (abs(bt - t), bt)) AS near, min(abs(bt - t)) AS gap FROM a JOIN b ON a.unit = b.unit GROUP BY ALL""")
def nearest_sample(spark, sf_dir):
    d = facts(spark, sf_dir)
    right = d.where("level = 'view'").groupBy("unit", F.col("t").alias("bt")).agg(F.min("trial").alias("near"))
    return prep.nearest(d.where("level = 'purchase'").select("unit", "t", "trial"), right, ["unit"], "t", "bt", "near").where("near is not null")


@query("""WITH p AS (SELECT conv_id, turn, list(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS path FROM conversations)
SELECT conv_id, turn, path[1]::INTEGER a, path[2]::INTEGER b, path[3]::INTEGER c FROM p WHERE len(path) = 3""")
def trajectory_windows(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    p = F.col("path")
    return features.trajectories(d, ["conv_id"], "turn", "n", 2).select("conv_id", "turn", p[0].alias("a"), p[1].alias("b"), p[2].alias("c"))


@query("SELECT conv_id, turn, (lead(length(text), 2) OVER (PARTITION BY conv_id ORDER BY turn) - length(text))::INTEGER AS change FROM conversations")
def lagged_change(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return features.lagged(d, ["conv_id"], "turn", "n", 2).select("conv_id", "turn", "change")


@query("""WITH d AS (SELECT conv_id, turn, length(text)::DOUBLE n, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::DOUBLE nx FROM conversations), e AS (SELECT conv_id % 10 AS g, n, nx FROM d WHERE nx IS NOT NULL)
SELECT g, round(avg((nx - (0.5 * n + 150)) ** 2), 4) model_mse, round(avg((nx - n) ** 2), 4) persistence_mse, round(1 - avg((nx - (0.5 * n + 150)) ** 2) / var_pop(nx), 6) r2, round(1 - avg((nx - (0.5 * n + 150)) ** 2) / avg((nx - n) ** 2), 6) gain FROM e GROUP BY g""")
def one_step_error(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("double")).withColumn("g", F.col("conv_id") % 10)
    out = features.one_step_error(d, ["g"], ["turn"], "n", 0.5 * F.col("n") + 150, within=["conv_id"])
    return rounded(rounded(out, "model_mse", "persistence_mse", digits=4), "r2", "gain")


@query("""WITH v AS (SELECT vec_id % 97 AS trial, vec_id // 97 AS t, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT a.t, b.t AS s, list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) AS c FROM v a JOIN v b ON a.trial = b.trial)
SELECT t, s, round(avg(c), 6) mean, round(var_pop(c), 6) variance, count(*) n FROM c GROUP BY ALL""")
def similarity_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 97).alias("trial"), F.floor(F.col("vec_id") / 97).alias("t"), F.col("embedding").alias("x"))
    return rounded(linear.similarity_cells(d, ["trial"], "t", "x"), "mean", "variance")


@query("""WITH d AS (SELECT source, quality::BIGINT AS y, length(text) AS s FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL), c AS (SELECT source, s, sum(y) p, count(*) n FROM d GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM c), g AS (SELECT source, sum(p * (b + (n + 1) / 2)) k, sum(p)::BIGINT n_pos, (sum(n) - sum(p))::BIGINT n_neg FROM r GROUP BY ALL)
SELECT source, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round((k - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) END AS auc FROM g""")
def auc(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").join(table(spark, sf_dir, "labels"), "doc_id").select("source", "quality", F.length("text").alias("s"))
    return rounded(folds.roc_auc(d, ["source"], "quality", "s"), "auc")


@query(f"""WITH {PERF}, g AS (SELECT m.model, r.replicate, b.bin FROM (SELECT DISTINCT model FROM perf) m, (SELECT DISTINCT replicate FROM perf) r, (SELECT unnest(range(0, 8))::INTEGER AS bin) b), o AS (SELECT DISTINCT model, replicate, bin FROM perf)
SELECT *, 'missing' AS problem FROM (SELECT * FROM g EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM o EXCEPT SELECT * FROM g)""")
def expected_grid(spark, sf_dir):
    p = performance(spark, sf_dir)
    return contracts.grid_gaps(p, [p.select("model").distinct(), p.select("replicate").distinct(), spark.range(8).select(F.col("id").cast("int").alias("bin"))])


@query(f"""WITH {PERF}, r AS (SELECT 'models' AS rule, count(DISTINCT model) = 3 AS ok FROM perf UNION ALL SELECT 'replicates', count(DISTINCT replicate) = 21 FROM perf UNION ALL SELECT 'rates', sum((rate < 0 OR rate > 1)::INT) = 0 FROM perf)
SELECT count(*) n_rules, sum((NOT ok)::INT)::BIGINT n_failed, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (WHERE NOT ok), '') failures, bool_and(ok) ready FROM r""")
def gate_report(spark, sf_dir):
    p = performance(spark, sf_dir)
    rule = lambda name, ok: p.agg(ok.alias("ok")).select(F.lit(name).alias("rule"), "ok")
    return contracts.gate_report([rule("models", F.countDistinct("model") == 3), rule("replicates", F.countDistinct("replicate") == 21), rule("rates", F.sum(((F.col("rate") < 0) | (F.col("rate") > 1)).cast("int")) == 0)])


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>.*?</a>')) AS a FROM pages), b AS (SELECT page_id, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(a, '(?is)>(.*)</a>$', 1), '<[^>]*>', '', 'g')) AS label FROM a)
SELECT page_id, href, label FROM b WHERE regexp_matches(href, '^/[a-z]')""")
def page_links(spark, sf_dir):
    return files.links(table(spark, sf_dir, "pages").select("page_id", "html"), keep="^/[a-z]")


@query("""WITH s AS (SELECT l_suppkey AS k, round(avg(l_discount), 6) cost, round(avg(l_tax), 6) err FROM lineitem GROUP BY ALL) SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.k <> a.k AND b.cost <= a.cost AND b.err <= a.err AND (b.cost < a.cost OR b.err < a.err))""")
def pareto_front(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_discount"), 6).alias("cost"), F.round(F.avg("l_tax"), 6).alias("err"))
    return compare.pareto_front(s, ["cost", "err"], "k")
