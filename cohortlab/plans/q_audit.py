"""Identifiability and data-quality audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortlab.operators import audit, prep, twogroup
from cohortlab.operators.evaluate import auc
from cohortlab.plans import views
from cohortlab.plans.q_prep import QMAP, _COEF, _LIN, _linear, _train, _transfer
from cohortlab.plans.q_stats import LABELLED, _POOLED
from cohortlab.plans.registry import query
from cohortlab.plans.sqltext import auc_sql, gram_rank_sql, midrank, norm_p, r, shape, t_p
from cohortlab.plans.views import then, with_views
from cohortlab.session import cut, settle


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


# event days with two outcome definitions: an error flag mixes within days, the day's parity does not
_DAYS = """days AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_event, day(ts) % 2 AS y_day FROM events)"""


def _days(spark, sf):
    e = views.table(spark, sf, "events")
    return e.select(F.to_date("ts").alias("day"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y_event"), (F.dayofmonth("ts") % 2).alias("y_day"))


def _nest_sql(source: str, batch: str, y: str, label: str) -> str:
    return f"""SELECT '{label}' AS batch_variable, count(*) AS n_batches, CAST(sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) AS BIGINT) AS n_mixed, CAST(sum(n) AS BIGINT) AS n_samples,
 sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) = 0 AND max(hi) <> min(lo) AS nested FROM (SELECT {batch} AS b, count(*) AS n, min({y}) AS lo, max({y}) AS hi FROM {source} WHERE {batch} IS NOT NULL GROUP BY 1)"""


_NEST = [("sample", "batch_mixed", "y", "batch_mixed"), ("sample", "batch_nested", "y", "batch_nested"), ("doc", "source", "y", "source"), ("days", "day", "y_event", "event_day"), ("days", "day", "y_day", "day_parity")]


def _tables(spark, sf):
    return {"sample": views.sample(spark, sf), "doc": views.doc(spark, sf), "days": _days(spark, sf)}


@query("nesting", "Q1 C13", f"{then('sample', 'doc')} {_DAYS} " + " UNION ALL ".join(_nest_sql(*n) for n in _NEST))
def nesting(spark, sf):
    t = _tables(spark, sf)
    return _union([audit.nesting(t[src], b, y).withColumn("batch_variable", F.lit(name)) for src, b, y, name in _NEST])


@query("design_rank", "Q2", f"{then('sample', 'doc')} {_DAYS}, ne AS (" + " UNION ALL ".join(_nest_sql(*n) for n in _NEST) + """)
SELECT batch_variable, n_samples, n_batches + 1 AS n_columns, n_batches + 1 - CASE WHEN n_mixed = 0 THEN 1 ELSE 0 END AS rank, n_mixed > 0 AS identifiable, n_batches = 2 AND nested AS outcome_equals_batch FROM ne""")
def design_rank(spark, sf):
    t = _tables(spark, sf)
    return _union([audit.design_rank(t[src], b, y).withColumn("batch_variable", F.lit(name)).select(
        "batch_variable", "n_samples", "n_columns", F.col("rank").cast("bigint").alias("rank"), "identifiable", "outcome_equals_batch") for src, b, y, name in _NEST])


_COVARIATES = ["y", "age", "CASE WHEN sex = 'male' THEN 1 ELSE 0 END"]
_MIXED = gram_rank_sql("sample", _COVARIATES + [f"CASE WHEN batch_mixed = 'b{i}' THEN 1 ELSE 0 END" for i in range(1, 5)], "mixed", "gm")
_NESTED = gram_rank_sql("sample", _COVARIATES + [f"CASE WHEN batch_nested = 'n{i}' THEN 1 ELSE 0 END" for i in range(1, 6)], "nested", "gn")


@query("gram_rank", "Q2", f"{then('sample')} {_MIXED[0]}, {_NESTED[0]} {_MIXED[1]} UNION ALL {_NESTED[1]}")
def gram_rank(spark, sf):
    """Outcome, age, sex and batch indicators together; the nested batches cost one rank."""
    s = views.sample(spark, sf)
    base = {"y": F.col("y"), "age": F.col("age"), "male": (F.col("sex") == "male")}
    mixed = {f"b{i}": (F.col("batch_mixed") == f"b{i}") for i in range(1, 5)}
    nested = {f"n{i}": (F.col("batch_nested") == f"n{i}") for i in range(1, 6)}
    return _union([audit.gram_rank(s, {**base, **extra}).withColumn("design", F.lit(n)) for n, extra in (("mixed", mixed), ("nested", nested))])


@query("identifiability_verdict", "Q3", f"""{then('sample')} {_DAYS}, ne AS ({_nest_sql('sample', 'batch_mixed', 'y', 'm')} UNION ALL {_nest_sql('sample', 'batch_nested', 'y', 'n')}),
v AS (SELECT bool_or(nested) FILTER (batch_variable = 'm') AS m, bool_or(nested) FILTER (batch_variable = 'n') AS n FROM ne)
SELECT 'scan' AS cohort, m AS instrument_nested, n AS deposition_nested, CASE WHEN m THEN 'NOT identifiable' WHEN n THEN 'identifiable (deposition block records submission, not measurement)' ELSE 'identifiable' END AS verdict FROM v
UNION ALL SELECT 'block', n, m, CASE WHEN n THEN 'NOT identifiable' WHEN m THEN 'identifiable (deposition block records submission, not measurement)' ELSE 'identifiable' END FROM v""")
def identifiability_verdict(spark, sf):
    s = views.sample(spark, sf)
    return audit.verdict(s, "batch_mixed", "batch_nested").withColumn("cohort", F.lit("scan")).unionByName(
        audit.verdict(s, "batch_nested", "batch_mixed").withColumn("cohort", F.lit("block")))


@query("id_ranges", "Q4 C10", f"""{then('doc')} x AS (SELECT doc_id, y FROM doc UNION ALL SELECT doc_id + 1000000 * y, y FROM doc), a AS (SELECT 'documents' AS cohort, doc_id AS n, y FROM doc UNION ALL SELECT 'blocks', doc_id + 100000000 * y, y FROM doc)
SELECT cohort, max(n) FILTER (y = 1) AS max1, min(n) FILTER (y = 1) AS min1, max(n) FILTER (y = 0) AS max0, min(n) FILTER (y = 0) AS min0,
 min(n) FILTER (y = 1) > max(n) FILTER (y = 0) OR min(n) FILTER (y = 0) > max(n) FILTER (y = 1) AS disjoint FROM a GROUP BY 1""")
def id_ranges(spark, sf):
    d = views.doc(spark, sf)
    blocks = d.withColumn("doc_id", F.col("doc_id") + 100000000 * F.col("y"))
    return audit.id_ranges(d, "doc_id").withColumn("cohort", F.lit("documents")).unionByName(audit.id_ranges(blocks, "doc_id").withColumn("cohort", F.lit("blocks")))


@query("metric_separation", "Q6 T2 T3 T5", f"""WITH lab AS (SELECT event_type AS feature, value, CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END AS y FROM events),
mom AS (SELECT feature, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, avg(value) FILTER (y = 1) AS m1, avg(value) FILTER (y = 0) AS m0, var_samp(value) FILTER (y = 1) AS v1, var_samp(value) FILTER (y = 0) AS v0 FROM lab GROUP BY 1),
t AS (SELECT *, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS wt, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS wdf FROM mom), au AS {auc_sql('lab', 'feature', 'value')}
SELECT t.feature AS metric, {r('m1')} AS mean1, {r('m0')} AS mean0, {r('(m1 - m0) / sqrt((v1 + v0) / 2e0)')} AS d_average, {r(t_p('wt', 'wdf'))} AS welch_p, {r('auc')} AS auc FROM t JOIN au ON t.feature = au.feature""")
def metric_separation(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("event_type").alias("metric"), "value", F.when(F.hour("ts") >= 12, 1).otherwise(0).alias("y"))
    t = twogroup.t_tests(e, ["metric"]).withColumn("d_average", twogroup.cohens_d_average())
    return shape(t.join(auc(e, ["metric"], "value").select("metric", "auc"), "metric"), ["metric"], ["mean1", "mean0", "d_average", "welch_p", "auc"])


@query("control_set_separation", "Q6", f"""{then('measure', 'sample')} {LABELLED}, cm AS (SELECT sample_id, y, avg(value) AS v FROM lab WHERE regexp_matches(feature, '^f0[0-9]$') GROUP BY 1, 2), au AS {auc_sql('cm', '', 'v')}
SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, {r('avg(v) FILTER (y = 1)')} AS mean1, {r('avg(v) FILTER (y = 0)')} AS mean0, {r('(SELECT auc FROM au)')} AS auc FROM cm""")
def control_set_separation(spark, sf):
    return shape(audit.control_separation(views.labelled(spark, sf), "^f0[0-9]$", "y"), ["n1", "n0"], ["mean1", "mean0", "auc"])


@query("control_ratio", "Q6", f"""{with_views('measure')} SELECT sample_id, {r("avg(value) FILTER (feature = 'f01') - avg(value) FILTER (feature = 'f02')")} AS log_ratio FROM measure GROUP BY 1""")
def control_ratio(spark, sf):
    return shape(audit.control_ratio(views.measure(spark, sf), "f01", "f02", ["sample_id"]), ["sample_id"], ["log_ratio"])


_PACK = """pk AS (SELECT sample_id, list(value ORDER BY feature) AS raw FROM letters GROUP BY 1)"""


def _unit_sql(source: str, value: str) -> str:
    return f"""ctr AS (SELECT sample_id, feature, {value} - avg({value}) OVER (PARTITION BY sample_id) AS c FROM {source}),
un AS (SELECT sample_id, feature, coalesce(c / nullif(sqrt(sum(c * c) OVER (PARTITION BY sample_id)), 0), 0e0) AS u FROM ctr)"""


@query("exact_duplicates", "Q7", f"""{then('letters')} {_PACK} SELECT sample_id, min(sample_id) OVER (PARTITION BY raw) AS first_id, count(*) OVER (PARTITION BY raw) AS copies FROM pk QUALIFY copies > 1""")
def exact_duplicates(spark, sf):
    return audit.exact_duplicates(views.letters(spark, sf))


@query("near_duplicates", "Q7 J9", f"""{then('letters')} {_PACK}, fo AS (SELECT min(sample_id) AS sample_id, count(*) AS copies FROM pk GROUP BY raw),
rk AS (SELECT l.sample_id, feature, {midrank('l.sample_id', 'value')} AS rk FROM letters l JOIN fo ON l.sample_id = fo.sample_id), {_unit_sql('rk', 'rk')},
pr AS (SELECT a.sample_id AS a, b.sample_id AS b, sum(a.u * b.u) AS rho FROM un a JOIN un b ON a.feature = b.feature AND a.sample_id <> b.sample_id GROUP BY 1, 2 HAVING sum(a.u * b.u) > 0.995),
bp AS (SELECT a, b, rho, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY round(rho, 12) DESC, b) AS rn FROM pr)
SELECT a AS sample_id, n_near, b AS nearest, {r('rho')} AS rho, copies FROM bp JOIN fo ON bp.a = fo.sample_id WHERE rn = 1""")
def near_duplicates(spark, sf):
    v = audit.sample_vectors(views.letters(spark, sf), on_ranks=True, names=views.LETTERS)
    return shape(audit.near_duplicates(v, 0.995), ["sample_id", "n_near", "nearest", "copies"], ["rho"])


@query("nearest_neighbour", "Q8 J9", f"""{then('letters')} {_unit_sql('letters', 'value')},
pr AS (SELECT a.sample_id AS a, b.sample_id AS b, sum(a.u * b.u) AS rho FROM un a JOIN un b ON a.feature = b.feature AND a.sample_id <> b.sample_id GROUP BY 1, 2)
SELECT a AS sample_id, b AS nearest, {r('rho')} AS rho FROM pr QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(rho, 12) DESC, b) = 1""")
def nearest_neighbour(spark, sf):
    return shape(audit.nearest_neighbour(audit.sample_vectors(views.letters(spark, sf), names=views.LETTERS)), ["sample_id", "nearest"], ["rho"])


@query("correlation_outliers", "Q12", f"""{then('letters')} {_unit_sql('letters', 'value')},
pr AS (SELECT a.sample_id AS a, b.sample_id AS b, sum(a.u * b.u) AS rho FROM un a JOIN un b ON a.feature = b.feature AND a.sample_id <> b.sample_id GROUP BY 1, 2),
me AS (SELECT a AS sample_id, avg(rho) AS m FROM pr GROUP BY 1) SELECT sample_id, {r('m')} AS mean_rho, m < (SELECT avg(m) - 3 * stddev_samp(m) FROM me) AS outlier FROM me""")
def correlation_outliers(spark, sf):
    return shape(audit.correlation_outliers(audit.sample_vectors(views.letters(spark, sf))), ["sample_id", "outlier"], ["mean_rho"])


@query("blocks_of_subject", "Q9 J9", f"""{with_views('sample')} SELECT subject, sex, count(*) FILTER (cohort = 'train') AS n_a, count(*) FILTER (cohort = 'transfer') AS n_b,
 min(sample_id) FILTER (cohort = 'train') AS first_a, min(sample_id) FILTER (cohort = 'transfer') AS first_b,
 min(y) FILTER (cohort = 'train') <> max(y) FILTER (cohort = 'transfer') OR max(y) FILTER (cohort = 'train') <> min(y) FILTER (cohort = 'transfer') AS conflict,
 count(*) FILTER (cohort = 'train') * count(*) FILTER (cohort = 'transfer') AS n_pairs FROM sample GROUP BY 1, 2 HAVING n_a > 0 AND n_b > 0""")
def blocks_of_subject(spark, sf):
    b = audit.blocks_of_subject(views.sample(spark, sf), "subject", "cohort", ("train", "transfer"), "sex")
    return b.select("subject", "sex", "n_a", "n_b", "first_a", "first_b", "conflict", "n_pairs")


@query("inferred_label_check", "Q10", f"""{then('measure', 'sample')} {LABELLED}, mm AS (SELECT sample_id, sex, avg(value) AS v FROM lab WHERE feature LIKE 'f1%' GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN v > (SELECT (min(v) + max(v)) / 2e0 FROM mm) THEN 'male' ELSE 'female' END AS inferred FROM mm) SELECT sample_id, sex, {r('v')} AS marker_mean, inferred, inferred = sex AS agree FROM c""")
def inferred_label_check(spark, sf):
    lab = views.labelled(spark, sf, ["sex"])
    markers = lab.select("feature").distinct().filter(F.col("feature").startswith("f1"))
    return shape(audit.inferred_label_check(lab, markers, "sex", "male", "female"), ["sample_id", "sex", "inferred", "agree"], ["marker_mean"])


@query("contradicted_subjects", "Q11", f"""{with_views('sample')} SELECT subject, count(*) AS n FROM sample GROUP BY 1 HAVING min(y) <> max(y)""")
def contradicted_subjects(spark, sf):
    return audit.contradicted_subjects(views.sample(spark, sf), "subject")


@query("sample_median_shift", "Q14", f"""{then('measure', 'sample')} {LABELLED}, md AS (SELECT sample_id, y, median(value) AS v FROM lab GROUP BY 1, 2), rs AS {auc_sql('md', '', 'v')},
tie AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT v, count(*) * 1e0 AS c FROM md GROUP BY 1)),
z AS (SELECT *, (greatest(u1, n1 * n0 - u1) - n1 * n0 / 2e0 - 0.5e0) / sqrt(n1 * n0 / 12e0 * ((n1 + n0 + 1) - t / ((n1 + n0) * (n1 + n0 - 1e0)))) AS z FROM rs, tie)
SELECT n1, n0, {r('u1')} AS u, {r('z')} AS z, {r('auc')} AS auc, {r(f"CASE WHEN z <= 0 THEN 1e0 ELSE {norm_p('z')} END")} AS p FROM z""")
def sample_median_shift(spark, sf):
    return shape(audit.sample_median_shift(views.labelled(spark, sf)), ["n1", "n0"], ["u", "z", "auc", "p"])


@query("location_shift", "Q15 J7", f"""{then('measure', 'sample')} {LABELLED}, {_COEF}, g AS (SELECT feature, avg(value) FILTER (cohort = 'train') AS tm, avg(value) FILTER (cohort <> 'train') AS om, stddev_samp(value) FILTER (cohort = 'train') AS ts, stddev_samp(value) FILTER (cohort <> 'train') AS os FROM lab GROUP BY 1)
SELECT g.feature, {r('tm')} AS train_mean, {r('om')} AS other_mean, {r('ts')} AS train_sd, {r('os')} AS other_sd, {r('(om - tm) / ts')} AS shift_sd, {r('w * (om - tm) / ts')} AS logit_shift FROM g JOIN co ON g.feature = co.feature""")
def location_shift(spark, sf):
    lab = views.labelled(spark, sf, ["cohort", "y"])
    mean_of = lambda g: F.avg(F.when(F.col("y") == g, F.col("value")))
    co = settle(_train(lab).groupBy("feature").agg((mean_of(1) - mean_of(0)).alias("coefficient")))
    return shape(audit.location_shift(lab, "cohort", "train", co), ["feature"], ["train_mean", "other_mean", "train_sd", "other_sd", "shift_sd", "logit_shift"])


@query("transform_audit", "Q16 V12", f"""{then('measure', 'sample')} {LABELLED}, {QMAP}, ab AS {auc_sql('qm', 'feature', 'value')}, af AS {auc_sql('qm', 'feature', 'mapped')},
rk AS (SELECT feature, {midrank('feature', 'value')} AS a, {midrank('feature', 'mapped')} AS b FROM qm), rr AS (SELECT feature, corr(a, b) AS rho FROM rk GROUP BY 1),
g AS (SELECT feature, avg(value) AS mb, avg(mapped) AS ma, stddev_samp(value) AS sb, stddev_samp(mapped) AS sa, median(value) AS db, median(mapped) AS da FROM qm GROUP BY 1)
SELECT g.feature, {r('mb')} AS mean_before, {r('ma')} AS mean_after, {r('sb')} AS sd_before, {r('sa')} AS sd_after, {r('db')} AS median_before, {r('da')} AS median_after, {r('ab.auc')} AS auc_before, {r('af.auc')} AS auc_after, {r('rho')} AS rank_correlation
FROM g JOIN ab ON g.feature = ab.feature JOIN af ON g.feature = af.feature JOIN rr ON g.feature = rr.feature""")
def transform_audit(spark, sf):
    lab = views.labelled(spark, sf, ["cohort", "y"])
    m = cut(prep.quantile_map(_transfer(lab).drop("cohort"), _train(lab)))
    return shape(audit.transform_audit(m, "value", "mapped"), ["feature"], [f"{c}_{t}" for c in ("mean", "sd", "median", "auc") for t in ("before", "after")] + ["rank_correlation"])


@query("confounder_check", "Q18 T5 V1 M13", f"""{then('sample')} m AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, avg(age) FILTER (y = 1) AS m1, avg(age) FILTER (y = 0) AS m0, var_samp(age) FILTER (y = 1) AS v1, var_samp(age) FILTER (y = 0) AS v0 FROM sample),
t AS (SELECT *, (m1 - m0) / sqrt({_POOLED} * (1e0 / n1 + 1e0 / n0)) AS st, (n1 + n0 - 2) * 1e0 AS sdf FROM m)
SELECT {r('m1')} AS mean1, {r('m0')} AS mean0, {r('st')} AS student_t, {r(t_p('st', 'sdf'))} AS student_p, {r('(SELECT auc FROM ' + auc_sql('sample', '', 'age') + ')')} AS auc FROM t""")
def confounder_check(spark, sf):
    s = views.sample(spark, sf)
    t = twogroup.t_tests(s, [], "age").withColumn("auc", auc(s, [], "age").select("auc").scalar())
    return shape(t, [], ["mean1", "mean0", "student_t", "student_p", "auc"])


@query("expected_values", "Q19", f"""WITH a AS (SELECT 'mean_balance' AS name, avg(c_acctbal) AS actual FROM customer UNION ALL SELECT 'n_customers', count(*) FROM customer UNION ALL SELECT 'max_size', max(p_size) FROM part),
e(name, expected, tol) AS (VALUES ('mean_balance', 0e0, 1e-6), ('n_customers', 1500e0, 1e-6), ('max_size', 50e0, 0.5e0), ('absent', 1e0, 1e-6))
SELECT e.name, expected, {r('actual')} AS actual, CASE WHEN actual IS NULL THEN 'MISSING' WHEN abs(actual - expected) < tol THEN 'PASS' ELSE 'FAIL' END AS status FROM e LEFT JOIN a ON e.name = a.name""")
def expected_values(spark, sf):
    c, p = views.table(spark, sf, "customer"), views.table(spark, sf, "part")
    actual = _union([c.agg(F.avg("c_acctbal").alias("actual")).withColumn("name", F.lit("mean_balance")),
                     c.agg(F.count(F.lit(1)).cast("double").alias("actual")).withColumn("name", F.lit("n_customers")),
                     p.agg(F.max("p_size").cast("double").alias("actual")).withColumn("name", F.lit("max_size"))])
    expected = spark.createDataFrame([("mean_balance", 0.0, 1e-6), ("n_customers", 1500.0, 1e-6), ("max_size", 50.0, 0.5), ("absent", 1.0, 1e-6)], "name string, expected double, tol double")
    return shape(audit.check_expected(actual, expected), ["name", "expected", "status"], ["actual"])


@query("stored_vs_recomputed", "Q20", f"""{_LIN} SELECT count(*) AS n, {r('corr(round(probability, 3), probability)')} AS correlation, {r('sqrt(avg(pow(round(probability, 3) - probability, 2)))')} AS rmse, {r('max(abs(round(probability, 3) - probability))')} AS max_abs_diff FROM pr""")
def stored_vs_recomputed(spark, sf):
    p = cut(_linear(spark, sf))
    return shape(audit.compare_scores(p.withColumn("probability", F.round("probability", 3)), p, "sample_id", "probability"), ["n"], ["correlation", "rmse", "max_abs_diff"])
