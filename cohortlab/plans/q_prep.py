"""Fit-and-apply preprocessing: training parameters, frozen on the transfer cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.functions.hashing import phash_sql
from cohortlab.operators import prep
from cohortlab.plans import views
from cohortlab.plans.q_stats import LABELLED
from cohortlab.plans.registry import query
from cohortlab.plans.sqltext import r, shape
from cohortlab.plans.views import then, with_views
from cohortlab.session import settle

_TR = "cohort = 'train'"


def _train(df):
    return df.filter(F.col("cohort") == "train")


def _transfer(df):
    return df.filter(F.col("cohort") == "transfer")


@query("variance_filter", "L1", f"""{then('measure', 'sample')} {LABELLED}, v AS (SELECT feature, var_samp(value) AS v FROM lab WHERE {_TR} GROUP BY 1)
SELECT feature, {r('v', 9)} AS variance FROM (SELECT *, row_number() OVER (ORDER BY v DESC, feature) AS rn, count(*) OVER () AS p FROM v) WHERE rn <= ceil(p * 0.25e0)""")
def variance_filter(spark, sf):
    return shape(prep.fit_variance_filter(_train(views.labelled(spark, sf, ["cohort"]))), ["feature"], ["variance"], 9)


@query("variance_rules", "L1", f"""{then('measure', 'sample')} {LABELLED}, v AS (SELECT feature, var_samp(value) AS v FROM lab WHERE {_TR} GROUP BY 1)
SELECT 'quantile' AS rule, feature FROM v WHERE v >= (SELECT quantile_cont(v, 0.75) FROM v) UNION ALL SELECT 'positive', feature FROM v WHERE v > 0
UNION ALL SELECT 'count', feature FROM (SELECT *, row_number() OVER (ORDER BY v DESC, feature) AS rn FROM v) WHERE rn <= 10""")
def variance_rules(spark, sf):
    t = _train(views.labelled(spark, sf, ["cohort"]))
    rules = [("quantile", 0.75), ("positive", 0.0), ("count", 10)]
    parts = [prep.fit_variance_filter(t, name, amount).select(F.lit(name).alias("rule"), "feature") for name, amount in rules]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SCALER = f"sc AS (SELECT feature, avg(value) AS mu, nullif(stddev_samp(value), 0) AS sd, nullif(stddev_pop(value), 0) AS sd0 FROM lab WHERE {_TR} GROUP BY 1)"


@query("standardise_transfer", "L2 J7", f"""{then('measure', 'sample')} {LABELLED}, {_SCALER}
SELECT sample_id, lab.feature, {r('(value - mu) / sd')} AS z, {r('(value - mu) / sd0')} AS z0 FROM lab JOIN sc ON lab.feature = sc.feature WHERE cohort = 'transfer'""")
def standardise_transfer(spark, sf):
    lab = views.labelled(spark, sf, ["cohort"])
    t = prep.apply_scaler(_transfer(lab), prep.fit_scaler(_train(lab)))
    t = prep.apply_scaler(t, prep.fit_scaler(_train(lab), ddof=0), out="z0")
    return shape(t, ["sample_id", "feature"], ["z", "z0"])


@query("cohort_zscore", "L2", f"""{then('measure', 'sample')} {LABELLED}, s AS (SELECT cohort, feature, avg(value) AS mu, nullif(stddev_samp(value), 0) AS sd FROM lab GROUP BY 1, 2)
SELECT sample_id, lab.feature, {r('(value - mu) / sd')} AS z FROM lab JOIN s ON lab.feature = s.feature AND lab.cohort = s.cohort""")
def cohort_zscore(spark, sf):
    return shape(prep.cohort_zscore(views.labelled(spark, sf, ["cohort"]), "cohort"), ["sample_id", "feature"], ["z"])


@query("mean_set_score", "L3", f"""{then('measure', 'sample')} {LABELLED}, {_SCALER}, z AS (SELECT sample_id, lab.feature, (value - mu) / sd AS z FROM lab JOIN sc ON lab.feature = sc.feature)
SELECT 'set_' || substr(feature, 2, 1) AS set_name, sample_id, {r('avg(z)')} AS score, count(z) AS n_features FROM z GROUP BY 1, 2""")
def mean_set_score(spark, sf):
    lab = views.labelled(spark, sf, ["cohort"])
    scaler = prep.fit_scaler(_train(lab))
    sets = scaler.select("feature").withColumn("set_name", F.concat(F.lit("set_"), F.substring("feature", 2, 1)))
    return shape(prep.mean_score(prep.apply_scaler(lab, scaler), sets), ["set_name", "sample_id", "n_features"], ["score"])


_COEF = f"co AS (SELECT feature, avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0) AS w FROM lab WHERE {_TR} GROUP BY 1)"
_LIN = f"""{then('measure', 'sample')} {LABELLED}, {_SCALER}, {_COEF},
li AS (SELECT sample_id, sum(w * (value - mu) / sd) + 0.1e0 AS score FROM lab JOIN sc ON lab.feature = sc.feature JOIN co ON lab.feature = co.feature GROUP BY 1),
pr AS (SELECT sample_id, score, 1e0 / (1e0 + exp(-score)) AS probability FROM li)"""


def _linear(spark, sf):
    lab = views.labelled(spark, sf, ["cohort", "y"])
    mean_of = lambda g: F.avg(F.when(F.col("y") == g, F.col("value")))
    co = settle(_train(lab).groupBy("feature").agg((mean_of(1) - mean_of(0)).alias("coefficient")))
    return prep.linear_score(prep.apply_scaler(lab, prep.fit_scaler(_train(lab))), co, 0.1)


@query("linear_score", "L4 J7", f"{_LIN} SELECT sample_id, {r('score')} AS score, {r('probability')} AS probability FROM pr")
def linear_score(spark, sf):
    return shape(_linear(spark, sf), ["sample_id"], ["score", "probability"])


@query("recover_intercept", "L4", f"{_LIN} SELECT {r('avg(ln(probability / (1e0 - probability)) - (score - 0.1e0))')} AS intercept FROM pr")
def recover_intercept(spark, sf):
    p = _linear(spark, sf).withColumn("score", F.col("score") - 0.1)
    return shape(prep.recover_intercept(p), [], ["intercept"])


def _line(where: str) -> str:
    return f"ln AS (SELECT feature, regr_slope(value, age) AS b, regr_intercept(value, age) AS a, avg(age) AS mu FROM lab WHERE {where} GROUP BY 1)"


@query("age_residual_frozen", "L5 T11 J7", f"""{then('measure', 'sample')} {LABELLED}, {_line(_TR)}
SELECT sample_id, lab.feature, {r('value - b * (age - mu)')} AS adjusted FROM lab JOIN ln ON lab.feature = ln.feature WHERE cohort = 'transfer'""")
def age_residual(spark, sf):
    lab = views.labelled(spark, sf, ["cohort", "age"])
    return shape(prep.apply_slope(_transfer(lab), prep.fit_line(_train(lab), "age"), "age"), ["sample_id", "feature"], ["adjusted"])


@query("control_residual", "L6", f"""{then('measure', 'sample')} {LABELLED}, {_line(_TR + ' AND y = 0')}
SELECT sample_id, lab.feature, {r('value - (a + b * age)')} AS adjusted FROM lab JOIN ln ON lab.feature = ln.feature""")
def control_residual(spark, sf):
    lab = views.labelled(spark, sf, ["cohort", "age", "y"])
    return shape(prep.apply_residual(lab, prep.fit_line(_train(lab).filter("y = 0"), "age"), "age"), ["sample_id", "feature"], ["adjusted"])


@query("all_sample_residual", "L10", f"""{then('measure', 'sample')} {LABELLED}, {_line('true')}
SELECT sample_id, lab.feature, {r('value - b * (age - mu)')} AS adjusted FROM lab JOIN ln ON lab.feature = ln.feature""")
def all_sample_residual(spark, sf):
    return shape(prep.remove_covariate(views.labelled(spark, sf, ["age"]), "age"), ["sample_id", "feature"], ["adjusted"])


@query("residual_score", "L7", f"""{then('doc')} s AS (SELECT doc_id, ln(words) AS w, ln(chars) AS c FROM doc), f AS (SELECT regr_slope(w, c) AS b, regr_intercept(w, c) AS a FROM s)
SELECT doc_id, {r('w - a - b * c')} AS residual FROM s, f""")
def residual_score(spark, sf):
    d = views.doc(spark, sf).select("doc_id", F.ln("words").alias("w"), F.ln("chars").alias("c"))
    return shape(prep.residual_score(d, "w", "c"), ["doc_id"], ["residual"])


QMAP = f"""t AS (SELECT sample_id, feature, value, y, row_number() OVER (PARTITION BY feature ORDER BY value, sample_id) - 1 AS i, count(*) OVER (PARTITION BY feature) AS nt FROM lab WHERE cohort = 'transfer'),
rf AS (SELECT feature, value AS ref, row_number() OVER (PARTITION BY feature ORDER BY value, sample_id) - 1 AS pos, count(*) OVER (PARTITION BY feature) AS nr FROM lab WHERE {_TR}),
nr AS (SELECT DISTINCT feature, nr FROM rf),
ps AS (SELECT t.*, greatest(0e0, least((i + 0.5e0) / nt * nr - 0.5e0, nr - 1e0)) AS pt, nr FROM t JOIN nr ON t.feature = nr.feature),
qm AS (SELECT ps.sample_id, ps.feature, ps.value, ps.y, a.ref + (pt - floor(pt)) * (b.ref - a.ref) AS mapped FROM ps JOIN rf a ON ps.feature = a.feature AND a.pos = CAST(floor(pt) AS BIGINT)
  JOIN rf b ON ps.feature = b.feature AND b.pos = least(CAST(floor(pt) AS BIGINT) + 1, ps.nr - 1))"""


@query("quantile_map", "L8", f"""{then('measure', 'sample')} {LABELLED}, {QMAP} SELECT sample_id, feature, {r('mapped')} AS mapped FROM qm""")
def quantile_map(spark, sf):
    lab = views.labelled(spark, sf, ["cohort"])
    return shape(prep.quantile_map(_transfer(lab).drop("cohort"), _train(lab)), ["sample_id", "feature"], ["mapped"])


@query("quantile_target", "L9", f"""{then('measure', 'sample')} {LABELLED}, tg AS (SELECT m AS target, row_number() OVER (ORDER BY m, feature) AS pos FROM (SELECT feature, avg(value) AS m FROM lab WHERE {_TR} GROUP BY 1)),
p AS (SELECT sample_id, feature, row_number() OVER (PARTITION BY sample_id ORDER BY value, feature) AS pos FROM lab)
SELECT sample_id, feature, {r('target')} AS normalised FROM p JOIN tg ON p.pos = tg.pos""")
def quantile_target(spark, sf):
    lab = views.labelled(spark, sf, ["cohort"])
    return shape(prep.apply_quantile_target(lab, prep.fit_quantile_target(_train(lab))), ["sample_id", "feature"], ["normalised"])


@query("batch_adjustment", "L11", f"""WITH RECURSIVE {views.SQL['measure']}, {views.SQL['sample']}, {LABELLED},
per AS (SELECT feature, batch_mixed AS batch, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM lab GROUP BY 1, 2),
gr AS (SELECT feature, sum(n * m) / sum(n) AS grand, sqrt(sum((n - 1) * v) / sum(n)) AS scale FROM per GROUP BY 1),
st AS (SELECT per.feature, batch, n * 1e0 AS n, grand, scale, (m - grand) / scale AS gh, v / (scale * scale) AS dh FROM per JOIN gr ON per.feature = gr.feature),
pr AS (SELECT batch, avg(gh) AS gb, var_samp(gh) AS t2, (2e0 * var_samp(dh) + pow(avg(dh), 2)) / var_samp(dh) AS a, (avg(dh) * var_samp(dh) + pow(avg(dh), 3)) / var_samp(dh) AS b FROM st GROUP BY 1),
it AS (SELECT st.feature, st.batch, n, grand, scale, gh, dh, gb, t2, a, b, gh AS g, dh AS d, 0 AS k FROM st JOIN pr ON st.batch = pr.batch
 UNION ALL SELECT feature, batch, n, grand, scale, gh, dh, gb, t2, a, b, (t2 * n * gh + d * gb) / (t2 * n + d),
  (0.5e0 * ((n - 1e0) * dh + n * pow(gh - (t2 * n * gh + d * gb) / (t2 * n + d), 2)) + b) / (n / 2e0 + a - 1e0), k + 1 FROM it WHERE k < 50)
SELECT sample_id, lab.feature, {r('((value - grand) / scale - g) / sqrt(d) * scale + grand')} AS adjusted FROM lab JOIN it ON lab.feature = it.feature AND lab.batch_mixed = it.batch WHERE k = 50""")
def batch_adjustment(spark, sf):
    out = prep.adjust_batches(views.measure(spark, sf), views.sample(spark, sf), "batch_mixed", "y")
    return shape(out, ["sample_id", "feature"], ["adjusted"])


@query("stratified_split", "L12", f"""{then('sample')} o AS (SELECT sample_id, y, row_number() OVER (PARTITION BY y ORDER BY {phash_sql('sample_id')}, sample_id) - 1 AS pos, count(*) OVER (PARTITION BY y) AS n FROM sample)
SELECT sample_id, y, CASE WHEN pos < ceil(n * 0.25e0) THEN 'test' ELSE 'train' END AS part FROM o""")
def stratified_split(spark, sf):
    return prep.stratified_split(views.sample(spark, sf).select("sample_id", "y")).select("sample_id", "y", "part")


@query("stratified_folds", "L13", f"""{then('sample')} rp AS (SELECT sample_id, y, CAST(unnest(range(0, 3)) AS INTEGER) AS rep FROM sample),
o AS (SELECT *, row_number() OVER (PARTITION BY rep, y ORDER BY {phash_sql('sample_id', 'rep')}, sample_id) - 1 AS pos FROM rp)
SELECT sample_id, y, rep, CAST(pos % 5 AS INTEGER) AS fold FROM o""")
def stratified_folds(spark, sf):
    return prep.stratified_folds(views.sample(spark, sf).select("sample_id", "y"), 5, 3).select("sample_id", "y", "rep", "fold")


@query("restrict_controls", "L14", f"""{with_views('sample')} SELECT sample_id, y, age FROM sample WHERE y = 1 OR age >= (SELECT min(age) FROM sample WHERE y = 1)""")
def restrict_controls(spark, sf):
    return prep.restrict_controls(views.sample(spark, sf)).select("sample_id", "y", "age")
