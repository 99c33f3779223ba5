"""Two-group tests, correlations, FDR, meta-analysis and descriptive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.functions.scalars import direction, effect_band, fold_change, heterogeneity_band, interpretable_log2_fc, log2_fold_change, rounded, same_sign
from cohortlab.operators import rollup, tables, twogroup
from cohortlab.operators.prep import adjust_batches
from cohortlab.operators.running import average_rank, with_descending_rank
from cohortlab.plans import views
from cohortlab.plans.registry import query
from cohortlab.plans.sqltext import auc_sql, chi2_p, digamma, midrank, norm_p, r, shape, t_p, trigamma
from cohortlab.plans.views import then, with_views

LABELLED = """lab AS (SELECT m.sample_id, m.feature, m.value, s.y, s.stage, s.sex, s.age, s.batch_mixed, s.batch_nested, s.cohort
  FROM measure m JOIN sample s ON m.sample_id = s.sample_id)"""

MOMENTS = """mom AS (SELECT feature, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0,
  avg(value) FILTER (y = 1) AS m1, avg(value) FILTER (y = 0) AS m0,
  var_samp(value) FILTER (y = 1) AS v1, var_samp(value) FILTER (y = 0) AS v0 FROM lab GROUP BY feature)"""

_POOLED = "((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)"

_MWU = f"""rs AS {auc_sql('lab', 'feature', 'value')},
tie AS (SELECT feature, sum(pow(c, 3) - c) AS t FROM (SELECT feature, value, count(*) * 1e0 AS c FROM lab GROUP BY 1, 2) GROUP BY 1),
mwu AS (SELECT rs.feature, n1, n0, u1, auc, (greatest(u1, n1 * n0 - u1) - n1 * n0 / 2e0 - 0.5e0)
   / sqrt(n1 * n0 / 12e0 * ((n1 + n0 + 1) - t / ((n1 + n0) * (n1 + n0 - 1e0)))) AS z FROM rs JOIN tie ON rs.feature = tie.feature)"""


@query("feature_screen", "T1 T3 T9 V1", f"""{then('measure', 'sample')} {LABELLED}, {MOMENTS}, {_MWU},
ps AS (SELECT *, CASE WHEN z <= 0 THEN 1e0 ELSE {norm_p('z')} END AS p FROM mwu),
ranked AS (SELECT *, count(*) OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM ps),
q AS (SELECT *, least(1e0, min(p * m / i) OVER (ORDER BY p DESC)) AS fdr FROM ranked)
SELECT q.feature, q.n1, q.n0, {r('m1')} AS mean1, {r('m0')} AS mean0, {r('(m1 - m0) / sqrt(pooled)')} AS d_pooled,
 {r('u1')} AS u, {r('auc')} AS auc, {r('z')} AS z, {r('p')} AS p, {r('fdr')} AS fdr FROM q JOIN (SELECT feature, m1, m0, {_POOLED} AS pooled FROM mom) mom ON q.feature = mom.feature""")
def feature_screen(spark, sf):
    lab = views.labelled(spark, sf)
    moments = twogroup.group_moments(lab, ["feature"]).withColumn("d_pooled", twogroup.cohens_d_pooled())
    mw = twogroup.mann_whitney(lab, ["feature"]).drop("n1", "n0")
    out = twogroup.adjust_fdr(mw.join(moments, "feature"))
    return shape(out, ["feature", "n1", "n0"], ["mean1", "mean0", "d_pooled", "u", "auc", "z", "p", "fdr"]).orderBy("fdr", "feature")


@query("effect_sizes", "T1 T2 C17 C18", f"""{then('measure', 'sample')} {LABELLED}, {MOMENTS},
d AS (SELECT feature, (m1 - m0) / sqrt({_POOLED}) AS dp, (m1 - m0) / sqrt((v1 + v0) / 2e0) AS da FROM mom)
SELECT feature, {r('dp')} AS d_pooled, {r('da')} AS d_average,
 CASE WHEN dp IS NULL THEN 'Not estimable' WHEN abs(dp) < 0.2 THEN 'Negligible' WHEN abs(dp) < 0.5 THEN 'Small' WHEN abs(dp) < 0.8 THEN 'Moderate' ELSE 'Large' END AS band,
 CASE WHEN dp > 0 THEN 'UP' WHEN dp < 0 THEN 'DOWN' WHEN dp = 0 THEN 'NO_CHANGE' END AS direction, sign(dp) = sign(da) AS agree FROM d""")
def effect_sizes(spark, sf):
    e = twogroup.effect_sizes(views.labelled(spark, sf), ["feature"])
    e = e.withColumn("band", effect_band("d_pooled")).withColumn("direction", direction("d_pooled")).withColumn("agree", same_sign("d_pooled", "d_average"))
    return shape(e, ["feature", "band", "direction", "agree"], ["d_pooled", "d_average"])


@query("t_tests", "T5", f"""{then('measure', 'sample')} {LABELLED}, {MOMENTS},
t AS (SELECT feature, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS wt,
 pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS wdf,
 (m1 - m0) / sqrt({_POOLED} * (1e0 / n1 + 1e0 / n0)) AS st, (n1 + n0 - 2) * 1e0 AS sdf FROM mom)
SELECT feature, {r('wt')} AS welch_t, {r('wdf', 4)} AS welch_df, {r(t_p('wt', 'wdf'))} AS welch_p, {r('st')} AS student_t, {r(t_p('st', 'sdf'))} AS student_p FROM t""")
def t_tests(spark, sf):
    t = twogroup.t_tests(views.labelled(spark, sf), ["feature"])
    return t.select("feature", rounded("welch_df", 4).alias("welch_df"), *[rounded(c).alias(c) for c in ("welch_t", "welch_p", "student_t", "student_p")])


@query("mann_whitney", "T3 T4 V1 W4", f"""{then('measure', 'sample')} {LABELLED}, {_MWU}
SELECT feature, n1, n0, {r('u1')} AS u, {r('z')} AS z, {r('auc')} AS auc, {r('1e0 - 2e0 * u1 / (n1 * n0)')} AS rank_biserial,
 {r(f"CASE WHEN z <= 0 THEN 1e0 ELSE {norm_p('z')} END")} AS p FROM mwu""")
def mann_whitney(spark, sf):
    return shape(twogroup.mann_whitney(views.labelled(spark, sf), ["feature"]), ["feature", "n1", "n0"], ["u", "z", "auc", "rank_biserial", "p"])


@query("kruskal_wallis", "T6", f"""{then('measure', 'sample')} {LABELLED},
rk AS (SELECT feature, stage, {midrank('feature', 'value')} AS rank FROM lab),
g AS (SELECT feature, stage, count(*) AS m, sum(rank) AS s FROM rk GROUP BY 1, 2),
t AS (SELECT feature, sum(pow(c, 3) - c) AS t FROM (SELECT feature, value, count(*) * 1e0 AS c FROM lab GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT g.feature, CAST(sum(m) AS BIGINT) AS n, count(*) AS k, (12e0 / (sum(m) * (sum(m) + 1e0)) * sum(s * s / m) - 3e0 * (sum(m) + 1)) / (1e0 - max(t) / (pow(sum(m), 3) - sum(m))) AS h
  FROM g JOIN t ON g.feature = t.feature GROUP BY 1)
SELECT feature, n, k, {r('h')} AS h, {r(chi2_p('h', 'k - 1'))} AS p FROM h""")
def kruskal_wallis(spark, sf):
    return shape(twogroup.kruskal_wallis(views.labelled(spark, sf, ["stage"]), ["feature"], "stage"), ["feature", "n", "k"], ["h", "p"])


@query("correlations", "T7", f"""{then('measure', 'sample')} {LABELLED},
rk AS (SELECT feature, value, age, stage, {midrank('feature', 'value')} AS rv, {midrank('feature', 'age')} AS ra FROM lab),
c AS (SELECT feature, count(*) AS n, corr(value, age) AS pe, corr(rv, ra) AS sp FROM rk GROUP BY 1)
SELECT feature, n, {r('pe')} AS pearson, {r('sp')} AS spearman, {r(t_p('pe * sqrt((n - 2) / (1e0 - pe * pe))', '(n - 2) * 1e0'))} AS pearson_p,
 {r(t_p('sp * sqrt((n - 2) / (1e0 - sp * sp))', '(n - 2) * 1e0'))} AS spearman_p FROM c""")
def correlations(spark, sf):
    c = twogroup.correlations(views.labelled(spark, sf, ["age"]), ["feature"], "value", "age")
    return shape(c, ["feature", "n"], ["pearson", "spearman", "pearson_p", "spearman_p"])


@query("stage_trend", "T7", f"""{then('measure', 'sample')} {LABELLED},
rk AS (SELECT feature, {midrank('feature', 'value')} AS rv, {midrank('feature', 'stage')} AS rs FROM lab)
SELECT feature, {r('corr(rv, rs)')} AS trend FROM rk GROUP BY 1""")
def stage_trend(spark, sf):
    c = twogroup.correlations(views.labelled(spark, sf, ["stage"]), ["feature"], "value", "stage")
    return c.select("feature", rounded("spearman").alias("trend"))


@query("kendall_tau", "T8", f"""WITH x AS (SELECT c_acctbal AS a, c_custkey % 97 AS b FROM customer),
p AS (SELECT sum(CASE WHEN (l.a < r.a AND l.b < r.b) THEN 1 ELSE 0 END) AS con, sum(CASE WHEN (l.a < r.a AND l.b > r.b) THEN 1 ELSE 0 END) AS dis,
 count(*) FILTER (l.a < r.a) AS nx, count(*) FILTER (l.b < r.b) AS ny FROM x l CROSS JOIN x r)
SELECT con * 1e0 AS concordant, dis * 1e0 AS discordant, {r('(con - dis) / sqrt(nx * 1e0 * ny)')} AS tau FROM p""")
def kendall_tau(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 97).alias("b"))
    return shape(twogroup.kendall_tau(c, "a", "b"), ["concordant", "discordant"], ["tau"])


@query("fdr_by_family", "T9 W7", f"""{then('measure', 'sample')} {LABELLED},
s AS (SELECT sex, feature, corr(value, y) AS rho, count(*) AS n FROM lab GROUP BY 1, 2),
p AS (SELECT sex, feature, {t_p('rho * sqrt((n - 2) / (1e0 - rho * rho))', '(n - 2) * 1e0')} AS p FROM s),
i AS (SELECT *, count(*) OVER (PARTITION BY sex ORDER BY p) AS i, count(*) OVER (PARTITION BY sex) AS m FROM p)
SELECT sex, feature, {r('p')} AS p, {r('least(1e0, min(p * m / i) OVER (PARTITION BY sex ORDER BY p DESC))')} AS fdr FROM i""")
def fdr_by_family(spark, sf):
    lab = views.labelled(spark, sf, ["y", "sex"])
    s = twogroup.slopes(lab, ["sex", "feature"], "y").select("sex", "feature", "p")
    return shape(twogroup.adjust_fdr(s, family=["sex"]), ["sex", "feature"], ["p", "fdr"])


@query("covariate_slopes", "T11", f"""{then('measure', 'sample')} {LABELLED},
s AS (SELECT feature, count(*) AS n, regr_slope(value, age) AS b, regr_intercept(value, age) AS a, regr_r2(value, age) AS r2 FROM lab GROUP BY 1)
SELECT feature, n, {r('b', 8)} AS slope, {r('a')} AS intercept, {r('r2')} AS r2, {r(t_p('sqrt(r2 * (n - 2) / (1e0 - r2))', '(n - 2) * 1e0'))} AS p FROM s""")
def covariate_slopes(spark, sf):
    s = twogroup.slopes(views.labelled(spark, sf, ["age"]), ["feature"], "age")
    return s.select("feature", "n", rounded("slope", 8).alias("slope"), *[rounded(c).alias(c) for c in ("intercept", "r2", "p")])


_META = """w AS (SELECT feature, d, 1e0 / ((n1 + n0) / (n1 * 1e0 * n0) + d * d / (2e0 * (n1 + n0))) AS w FROM effect WHERE n1 > 1 AND n0 > 1 AND d IS NOT NULL),
f AS (SELECT feature, count(*) AS k, sum(w) AS sw, sum(w * w) AS sw2, sum(w * d) / sum(w) AS fe, greatest(0e0, sum(w * d * d) - pow(sum(w * d), 2) / sum(w)) AS q,
  greatest(count(*) FILTER (d > 0), count(*) FILTER (d < 0)) * 1e0 / count(*) AS consistency FROM w GROUP BY 1),
t AS (SELECT *, CASE WHEN q > 0 THEN greatest(0e0, (q - (k - 1)) / q) * 100e0 ELSE 0e0 END AS i2, greatest(0e0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM f),
re AS (SELECT w.feature, sum(d / (1e0 / w + tau2)) / sum(1e0 / (1e0 / w + tau2)) AS re, sqrt(1e0 / sum(1e0 / (1e0 / w + tau2))) AS se FROM w JOIN t ON w.feature = t.feature GROUP BY 1)"""


@query("meta_analysis", "T13 C17", f"""{then('effect')} {_META}
SELECT t.feature, k, {r('fe')} AS fixed_effect, {r('sqrt(1e0 / sw)')} AS fixed_se, {r('q')} AS q, {r(chi2_p('q', 'k - 1'))} AS q_p, {r('i2')} AS i2, {r('tau2')} AS tau2,
 {r('re')} AS random_effect, {r('re - 1.96e0 * se')} AS random_low, {r('re + 1.96e0 * se')} AS random_high, {r(norm_p('re / se'))} AS random_p, {r('consistency')} AS consistency,
 CASE WHEN i2 < 25 THEN 'Low' WHEN i2 < 50 THEN 'Moderate' WHEN i2 < 75 THEN 'Substantial' ELSE 'High' END AS band
FROM t JOIN re ON t.feature = re.feature""")
def meta_analysis(spark, sf):
    m = twogroup.meta_analysis(views.effect(spark, sf)).withColumn("band", heterogeneity_band("i2"))
    return shape(m, ["feature", "k", "band"], ["fixed_effect", "fixed_se", "q", "q_p", "i2", "tau2", "random_effect", "random_low", "random_high", "random_p", "consistency"])


@query("direction_concordance", "T16 C18", f"""{then('effect')} ref AS (SELECT feature, d AS rd FROM effect WHERE dataset = 'BUILDING')
SELECT e.feature, count(*) AS n_datasets, count(*) FILTER (sign(d) = sign(rd)) AS n_concordant, {r('avg(CASE WHEN sign(d) = sign(rd) THEN 1e0 ELSE 0e0 END)')} AS share_concordant,
 {r('avg(d)')} AS mean_d, {r('min(d)')} AS min_d, {r('max(d)')} AS max_d, {r('max(rd)')} AS reference_d
FROM effect e JOIN ref ON e.feature = ref.feature WHERE dataset <> 'BUILDING' GROUP BY 1""")
def direction_concordance(spark, sf):
    c = twogroup.direction_concordance(views.effect(spark, sf), "BUILDING")
    return shape(c, ["feature", "n_datasets", "n_concordant"], ["share_concordant", "mean_d", "min_d", "max_d", "reference_d"])


@query("magnitude_retention", "T17 P2", f"""{with_views('effect')}
SELECT feature, {r("max(d) FILTER (dataset = 'BUILDING')")} AS train_d, {r("max(d) FILTER (dataset = 'MACHINERY')")} AS other_d,
 {r("abs(max(d) FILTER (dataset = 'MACHINERY')) / nullif(abs(max(d) FILTER (dataset = 'BUILDING')), 0)")} AS retention FROM effect GROUP BY 1""")
def magnitude_retention(spark, sf):
    return shape(twogroup.magnitude_retention(views.effect(spark, sf), "BUILDING", "MACHINERY"), ["feature"], ["train_d", "other_d", "retention"])


def _fisher_sql() -> str:
    lc = lambda n, k: f"(lgamma({n} + 1e0) - lgamma({k} + 1e0) - lgamma({n} - {k} + 1e0))"
    prob = f"exp({lc('(a + b)', 'CAST(i AS DOUBLE)')} + {lc('(c + d)', '(a + c - CAST(i AS DOUBLE))')} - {lc('(a + b + c + d)', '(a + c)')})"
    return f"""WITH t AS (SELECT count(*) FILTER (toxic = 1 AND lang = 'en') AS a, count(*) FILTER (toxic = 0 AND lang = 'en') AS b,
 count(*) FILTER (toxic = 1 AND lang = 'fr') AS c, count(*) FILTER (toxic = 0 AND lang = 'fr') AS d FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
g AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS i FROM t),
pr AS (SELECT *, {prob} AS pr FROM g)
SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d,
 {r('least(1e0, sum(pr) FILTER (pr <= (SELECT pr FROM pr WHERE i = a) * (1 + 1e-7)))')} AS p FROM pr"""


@query("fisher_exact", "T18", _fisher_sql())
def fisher_exact(spark, sf):
    d = views.doc(spark, sf).withColumn("flag", F.col("toxic") == 1)
    return shape(twogroup.fisher_exact(d, "flag", "lang", ("en", "fr")), ["a", "b", "c", "d"], ["p"])


_EBAYES = f"""lt AS (SELECT l.feature, l.value, b.quality AS y FROM letters l JOIN labels b ON l.sample_id = b.doc_id),
mo AS (SELECT feature, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, avg(value) FILTER (y = 1) AS m1, avg(value) FILTER (y = 0) AS m0,
 var_samp(value) FILTER (y = 1) AS v1, var_samp(value) FILTER (y = 0) AS v0 FROM lt GROUP BY 1),
sv AS (SELECT *, {_POOLED} AS s2, (n1 + n0 - 2) * 1e0 AS dof FROM mo),
ev AS (SELECT *, ln(s2) - {digamma('dof / 2e0')} + ln(dof / 2e0) AS e, {trigamma('dof / 2e0')} AS tg FROM sv WHERE s2 > 0),
pm AS (SELECT avg(e) AS me, var_samp(e) - avg(tg) AS x FROM ev),
bi AS (SELECT me, x, 1e-8 AS lo, 1e8 AS hi, 0 AS k FROM pm UNION ALL
 SELECT me, x, CASE WHEN {trigamma('sqrt(lo * hi)')} > x THEN sqrt(lo * hi) ELSE lo END, CASE WHEN {trigamma('sqrt(lo * hi)')} > x THEN hi ELSE sqrt(lo * hi) END, k + 1 FROM bi WHERE k < 90),
pr AS (SELECT CASE WHEN x > 0 THEN 2e0 * sqrt(lo * hi) END AS d0, CASE WHEN x > 0 THEN exp(me + {digamma('sqrt(lo * hi)')} - ln(sqrt(lo * hi))) ELSE exp(me) END AS s02 FROM bi WHERE k = 90),
po AS (SELECT ev.*, d0, s02, CASE WHEN d0 IS NULL THEN s02 ELSE (d0 * s02 + dof * s2) / (d0 + dof) END AS sp FROM ev, pr),
tt AS (SELECT *, (m1 - m0) / sqrt(sp * (1e0 / n1 + 1e0 / n0)) AS t FROM po),
pp AS (SELECT *, CASE WHEN d0 IS NULL THEN {norm_p('t')} ELSE {t_p('t', '(dof + d0)')} END AS p FROM tt),
ik AS (SELECT *, count(*) OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM pp)"""


@query("moderated_t", "T12 T9", f"""WITH RECURSIVE {views.SQL['letters']}, {_EBAYES} SELECT feature, n1, n0, {r('d0', 4)} AS d0, {r('s02', 4)} AS s02, {r('s2', 4)} AS s2, {r('sp', 4)} AS s2_post,
 {r('t', 5)} AS t, {r('p', 5)} AS p, {r('least(1e0, min(p * m / i) OVER (ORDER BY p DESC))', 5)} AS fdr FROM ik""")
def moderated_t(spark, sf):
    l, b = views.letters(spark, sf), views.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("y"))
    m = twogroup.adjust_fdr(twogroup.moderated_t(l.join(b, "sample_id")))
    return m.select("feature", "n1", "n0", *[rounded(c, 4).alias(c) for c in ("d0", "s02", "s2", "s2_post")], *[rounded(c, 5).alias(c) for c in ("t", "p", "fdr")])


@query("significant_after_moderation", "T12")
def significant_after_moderation(spark, sf):
    """Features below FDR 0.05 before and after batch adjustment of the same measurements."""
    s = views.sample(spark, sf).select("sample_id", "y", "batch_mixed")
    raw = views.labelled(spark, sf)
    adjusted = adjust_batches(views.measure(spark, sf), s, "batch_mixed").select("sample_id", "feature", F.col("adjusted").alias("value")).join(s, "sample_id")
    count = lambda df, name: twogroup.adjust_fdr(twogroup.moderated_t(df)).agg(F.count_if(F.col("fdr") < 0.05).alias("n_significant"), F.count(F.lit(1)).alias("n_features")).withColumn("stage", F.lit(name))
    return count(raw, "before").unionByName(count(adjusted, "after"))


@query("describe_groups", "G1", f"""{then('measure', 'sample')} {LABELLED}
SELECT feature, cohort, count(value) AS n, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS sd, {r('min(value)')} AS min, {r('max(value)')} AS max,
 {r('quantile_cont(value, 0.25)')} AS q25, {r('median(value)')} AS median, {r('quantile_cont(value, 0.75)')} AS q75 FROM lab GROUP BY 1, 2""")
def describe_groups(spark, sf):
    d = twogroup.describe(views.labelled(spark, sf, ["cohort"]), ["feature", "cohort"])
    return shape(d, ["feature", "cohort", "n"], ["mean", "sd", "min", "max", "q25", "median", "q75"])


@query("average_rank", "W4", f"""WITH x AS (SELECT l_returnflag, l_extendedprice, {midrank('l_returnflag', 'l_extendedprice')} AS rank FROM lineitem)
SELECT DISTINCT l_returnflag, l_extendedprice, rank FROM x""")
def avg_rank(spark, sf):
    li = views.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return average_rank(li, ["l_returnflag"], "l_extendedprice").select("l_returnflag", "l_extendedprice", "rank")


@query("effect_rank", "W2", f"""{with_views('effect')}
SELECT dataset, feature, {r('abs(d)')} AS abs_d, CASE WHEN d IS NOT NULL THEN rank() OVER (PARTITION BY dataset ORDER BY abs(d) DESC NULLS LAST) END AS rank FROM effect""")
def effect_rank(spark, sf):
    e = views.effect(spark, sf).withColumn("abs_d", F.abs("d"))
    return shape(with_descending_rank(e, ["dataset"], "abs_d"), ["dataset", "feature", "rank"], ["abs_d"])


_DATASETS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("mean_rank", "W3 P2", f"""{then('effect')}
rk AS (SELECT feature, rank() OVER (PARTITION BY dataset ORDER BY abs(d) DESC) AS rank FROM effect WHERE d IS NOT NULL),
m AS (SELECT feature, avg(rank) AS m, stddev_samp(rank) AS s FROM rk GROUP BY 1)
SELECT feature, {r('m')} AS mean_rank, {r('s')} AS sd_rank, rank() OVER (ORDER BY m) AS final_rank FROM m""")
def mean_rank(spark, sf):
    e = views.effect(spark, sf).withColumn("d", F.abs("d"))
    w = tables.pivot_wide(e, "feature", "dataset", "d", _DATASETS)
    return shape(twogroup.ranked_table(w, _DATASETS, "feature"), ["feature", "final_rank"], ["mean_rank", "sd_rank"])


_BULK = """wp AS (SELECT library, condition, cell_type, avg(gene_a) AS gene_a, avg(gene_b) AS gene_b FROM cells GROUP BY 1, 2, 3),
pb AS (SELECT library, condition, cell_type || '/' || gene AS test, a FROM (SELECT library, condition, cell_type, 'gene_a' AS gene, gene_a AS a FROM wp UNION ALL SELECT library, condition, cell_type, 'gene_b', gene_b FROM wp))"""


def _bulk(spark, sf):
    wide = views.cells(spark, sf).groupBy("library", "condition", "cell_type").agg(F.avg("gene_a").alias("gene_a"), F.avg("gene_b").alias("gene_b"))
    long = wide.unpivot(["library", "condition", "cell_type"], ["gene_a", "gene_b"], "gene", "value")
    return long.withColumn("test", F.concat_ws("/", "cell_type", "gene")).withColumn("y", F.when(F.col("condition") == "case", 1).otherwise(0))


@query("exact_permutation", "T10", f"""{then('cells')} {_BULK},
v AS (SELECT test, a, CASE WHEN condition = 'case' THEN 1 ELSE 0 END AS y, row_number() OVER (PARTITION BY test ORDER BY library) - 1 AS pos FROM pb),
n AS (SELECT test, count(*) AS n, CAST(sum(y) AS BIGINT) AS n1, avg(a) FILTER (y = 1) - avg(a) FILTER (y = 0) AS obs FROM v GROUP BY 1),
mask AS (SELECT test, n, n1, obs, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS k FROM n),
dif AS (SELECT m.test, m.n, m.n1, m.obs, m.k, avg(a) FILTER ((k >> pos) & 1 = 1) - avg(a) FILTER ((k >> pos) & 1 = 0) AS dd
 FROM mask m JOIN v ON m.test = v.test WHERE bit_count(m.k) = m.n1 GROUP BY 1, 2, 3, 4, 5)
SELECT test, CAST(max(n1) AS INTEGER) AS n1, CAST(max(n - n1) AS INTEGER) AS n0, count(*) AS n_splits, {r('max(obs)')} AS observed,
 {r('avg(CASE WHEN abs(dd) >= abs(obs) - 1e-12 THEN 1e0 ELSE 0e0 END)')} AS p_exact FROM dif GROUP BY 1""")
def exact_permutation(spark, sf):
    return shape(twogroup.exact_permutation(_bulk(spark, sf), ["test"]), ["test", "n1", "n0", "n_splits"], ["observed", "p_exact"])


@query("exact_rank_test", "T3", f"""{then('cells')} {_BULK},
v AS (SELECT test, {midrank('test', 'a')} AS a, CASE WHEN condition = 'case' THEN 1 ELSE 0 END AS y, row_number() OVER (PARTITION BY test ORDER BY library) - 1 AS pos FROM pb),
n AS (SELECT test, count(*) AS n, sum(y) AS n1, avg(a) FILTER (y = 1) - avg(a) FILTER (y = 0) AS obs FROM v GROUP BY 1),
mask AS (SELECT *, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS k FROM n),
dif AS (SELECT m.test, m.obs, m.k, avg(a) FILTER ((k >> pos) & 1 = 1) - avg(a) FILTER ((k >> pos) & 1 = 0) AS dd
 FROM mask m JOIN v ON m.test = v.test WHERE bit_count(m.k) = m.n1 GROUP BY 1, 2, 3)
SELECT test, {r('avg(CASE WHEN abs(dd) >= abs(obs) - 1e-12 THEN 1e0 ELSE 0e0 END)')} AS p_exact FROM dif GROUP BY 1""")
def exact_rank_test(spark, sf):
    return shape(twogroup.mann_whitney_exact(_bulk(spark, sf), ["test"]), ["test"], ["p_exact"])


@query("fold_change", "C19", f"""{then('cells')} g AS (SELECT cell_type, avg(gene_b) FILTER (condition = 'case') AS a, avg(gene_b) FILTER (condition = 'control') AS c FROM cells GROUP BY 1)
SELECT cell_type, {r('(a + 1e-6) / (c + 1e-6)')} AS fold_change, {r('log2((a + 1e-6) / (c + 1e-6))')} AS log2_fc, {r('CASE WHEN a > 0 AND c > 0 THEN log2(a / c) END')} AS interpretable FROM g""")
def fold_changes(spark, sf):
    mean_of = lambda g: F.avg(F.when(F.col("condition") == g, F.col("gene_b")))
    g = views.cells(spark, sf).groupBy("cell_type").agg(mean_of("case").alias("a"), mean_of("control").alias("c"))
    return g.select("cell_type", rounded(fold_change("a", "c")).alias("fold_change"), rounded(log2_fold_change("a", "c")).alias("log2_fc"), rounded(interpretable_log2_fc("a", "c")).alias("interpretable"))


@query("pseudobulk", "G7 P5", f"""{then('cells')} long AS (SELECT library, condition, cell_type, 'gene_a' AS feature, gene_a AS count FROM cells UNION ALL
 SELECT library, condition, cell_type, 'gene_b', gene_b FROM cells)
SELECT library, condition, cell_type, feature, count(*) AS n_cells, {r('sum(count)')} AS total_count, {r('avg(count)')} AS mean_expression, {r('median(count)')} AS median_expression,
 count(*) FILTER (count > 0) AS expressing_cells, {r('avg(CASE WHEN count > 0 THEN 1e0 ELSE 0e0 END)')} AS detection_fraction FROM long GROUP BY 1, 2, 3, 4""")
def pseudobulk(spark, sf):
    p = rollup.pseudobulk(views.cells(spark, sf), ["library", "condition", "cell_type"], ["gene_a", "gene_b"])
    return shape(p, ["library", "condition", "cell_type", "feature", "n_cells", "expressing_cells"], ["total_count", "mean_expression", "median_expression", "detection_fraction"])


@query("composition", "G8 J4", f"""{then('cells')} c AS (SELECT library, condition, cell_type, count(*) AS n FROM cells GROUP BY 1, 2, 3)
SELECT library, condition, cell_type, n, CAST(sum(n) OVER (PARTITION BY library, condition) AS BIGINT) AS library_total, {r('100e0 * n / sum(n) OVER (PARTITION BY library, condition)')} AS percent FROM c""")
def composition(spark, sf):
    return shape(rollup.composition(views.cells(spark, sf), ["library", "condition"], "cell_type"), ["library", "condition", "cell_type", "n", "library_total"], ["percent"])


@query("composition_expression_correlation", "J6 T7", f"""{then('cells')} c AS (SELECT library, condition, cell_type, count(*) AS n, avg(gene_a) AS a FROM cells GROUP BY 1, 2, 3),
p AS (SELECT *, 100e0 * n / sum(n) OVER (PARTITION BY library, condition) AS pct FROM c),
rk AS (SELECT *, {midrank('cell_type', 'pct')} AS rp, {midrank('cell_type', 'a')} AS ra FROM p)
SELECT cell_type, count(*) AS n, {r('corr(pct, a)')} AS pearson, {r('corr(rp, ra)')} AS spearman FROM rk GROUP BY 1""")
def composition_expression(spark, sf):
    c = views.cells(spark, sf)
    comp = rollup.composition(c, ["library", "condition"], "cell_type")
    expr = c.groupBy("library", "condition", "cell_type").agg(F.avg("gene_a").alias("a"))
    j = comp.join(expr, ["library", "condition", "cell_type"])
    return shape(twogroup.correlations(j, ["cell_type"], "percent", "a"), ["cell_type", "n"], ["pearson", "spearman"])


@query("best_probe", "W1", f"""{then('probe')} m AS (SELECT gene, probe, avg(value) AS mv FROM probe GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY mv DESC, probe) AS rn FROM m) SELECT gene, probe, {r('mv')} AS mean_value FROM b WHERE rn = 1""")
def best_probe(spark, sf):
    return shape(rollup.best_probe(views.probe(spark, sf)), ["gene", "probe"], ["mean_value"])


@query("probe_agreement", "W1", f"""{then('probe')} c AS (SELECT *, 'c' || CAST(sample_id % 3 AS VARCHAR) AS cohort FROM probe), m AS (SELECT cohort, gene, probe, avg(value) AS mv FROM c GROUP BY 1, 2, 3),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort, gene ORDER BY mv DESC, probe) AS rn FROM m) WHERE rn = 1)
SELECT x.gene, x.cohort AS first, y.cohort AS second, x.probe AS first_probe, y.probe AS second_probe, x.probe = y.probe AS same_probe, {r('x.mv')} AS first_mean, {r('y.mv')} AS second_mean FROM b x JOIN b y ON x.gene = y.gene AND x.cohort < y.cohort""")
def probe_agreement(spark, sf):
    p = views.probe(spark, sf).withColumn("cohort", F.concat(F.lit("c"), (F.col("sample_id") % 3).cast("string")))
    return shape(rollup.probe_agreement(p, "cohort"), ["gene", "first", "second", "first_probe", "second_probe", "same_probe"], ["first_mean", "second_mean"])


@query("collapsed_matrix", "W1 G6 J3", f"""{then('probe')} m AS (SELECT gene, probe, avg(value) AS mv FROM probe GROUP BY 1, 2),
b AS (SELECT gene, probe FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY mv DESC, probe) AS rn FROM m) WHERE rn = 1)
SELECT p.gene, p.sample_id, {r('avg(value)')} AS value FROM probe p JOIN b ON p.gene = b.gene AND p.probe = b.probe GROUP BY 1, 2""")
def collapsed_matrix(spark, sf):
    p = views.probe(spark, sf)
    kept = tables.keep_keys(p, rollup.best_probe(p).select("gene", "probe"), ["gene", "probe"])
    return shape(tables.mean_collapse(kept, ["gene", "sample_id"]), ["gene", "sample_id"], ["value"])
