"""Curves, thresholds, bootstrap and permutation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.functions.hashing import MODULUS, phash_sql
from cohortlab.functions.scalars import expit, rounded
from cohortlab.operators import evaluate, prep, resample, twogroup
from cohortlab.operators.models import union
from cohortlab.operators.tables import merge_left
from cohortlab.plans import views
from cohortlab.plans.q_prep import QMAP, _train, _transfer
from cohortlab.plans.q_stats import LABELLED, MOMENTS, _MWU
from cohortlab.plans.registry import query
from cohortlab.plans.sqltext import auc_sql, midrank, r, shape
from cohortlab.plans.views import then
from cohortlab.session import cut

SCORED = """sd AS (SELECT doc_id, y, toxic, lang, source, 1e0 / (1e0 + exp(-(ln(chars) - 6e0))) AS score, 1e0 / (1e0 + exp(-(ln(words) - 4e0))) AS score_b FROM doc)"""


def scored(spark, sf):
    return views.doc(spark, sf).select("doc_id", "y", "toxic", "lang", "source", expit(F.ln("chars") - 6.0).alias("score"), expit(F.ln("words") - 4.0).alias("score_b"))


def _curve_sql(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""ce AS (SELECT {k}score, CAST(sum(y) AS BIGINT) AS n1, CAST(sum(1 - y) AS BIGINT) AS n0 FROM sd GROUP BY {k}score),
cv AS (SELECT *, CAST(sum(n1) OVER ({part}ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n0) OVER ({part}ORDER BY score DESC) AS BIGINT) AS fp,
 CAST(sum(n1) OVER ({part.strip()}) AS BIGINT) AS p, CAST(sum(n0) OVER ({part.strip()}) AS BIGINT) AS n FROM ce)"""


@query("roc_auc", "V1", f"""{then('measure', 'sample')} {LABELLED} SELECT feature, n1, n0, {r('auc')} AS auc FROM {auc_sql('lab', 'feature', 'value')}""")
def roc_auc(spark, sf):
    return shape(evaluate.auc(views.labelled(spark, sf), ["feature"], "value"), ["feature", "n1", "n0"], ["auc"])


@query("roc_curve", "V3 W8", f"""{then('doc')} {SCORED}, {_curve_sql('')}
SELECT {r('score', 9)} AS threshold, tp, fp, {r('tp * 1e0 / p')} AS tpr, {r('fp * 1e0 / n')} AS fpr, {r('tp * 1e0 / (tp + fp)')} AS precision FROM cv""")
def roc_curve(spark, sf):
    c = evaluate.curve(scored(spark, sf), [])
    return c.select("tp", "fp", rounded("threshold", 9).alias("threshold"), *[rounded(x).alias(x) for x in ("tpr", "fpr", "precision")])


@query("average_precision", "V2 V3 W8", f"""{then('doc')} {SCORED}, {_curve_sql('lang')}
SELECT lang, {r('sum(n1 * 1e0 / p * tp / (tp + fp))')} AS average_precision, {r('sum(n0 * 1e0 / n * (2 * tp - n1) / (2e0 * p))')} AS roc_area FROM cv GROUP BY 1""")
def average_precision(spark, sf):
    return shape(evaluate.average_precision(scored(spark, sf), ["lang"]), ["lang"], ["average_precision", "roc_area"])


@query("probability_metrics", "V2", f"""{then('doc')} {SCORED} SELECT lang, {r('avg(pow(score - y, 2))')} AS brier, {r('avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1e0 ELSE 0e0 END)')} AS accuracy,
 {r('(avg(CASE WHEN score >= 0.5 THEN 1e0 ELSE 0e0 END) FILTER (y = 1) + avg(CASE WHEN score < 0.5 THEN 1e0 ELSE 0e0 END) FILTER (y = 0)) / 2e0')} AS balanced_accuracy, {r('avg(score)')} AS mean_probability, {r('avg(y)')} AS prevalence FROM sd GROUP BY 1""")
def probability_metrics(spark, sf):
    return shape(evaluate.probability_metrics(scored(spark, sf), ["lang"], "score"), ["lang"], ["brier", "accuracy", "balanced_accuracy", "mean_probability", "prevalence"])


@query("youden_threshold", "V4", f"""{then('doc')} {SCORED}, {_curve_sql('lang')},
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tp * n - fp * p DESC, score DESC) AS rn FROM cv) SELECT lang, {r('score', 9)} AS threshold, {r('tp * 1e0 / p - fp * 1e0 / n')} AS j FROM b WHERE rn = 1""")
def youden_threshold(spark, sf):
    y = evaluate.youden(scored(spark, sf), ["lang"])
    return y.select("lang", rounded("threshold", 9).alias("threshold"), rounded("j").alias("j"))


@query("locked_threshold", "V5 V4", f"""{then('doc')} {SCORED.replace('FROM doc)', "FROM doc), al AS (SELECT * FROM sd)")},
ce AS (SELECT score, CAST(sum(y) AS BIGINT) AS n1, CAST(sum(1 - y) AS BIGINT) AS n0 FROM al WHERE lang = 'en' GROUP BY 1),
cv AS (SELECT *, sum(n1) OVER (ORDER BY score DESC) AS tp, sum(n0) OVER (ORDER BY score DESC) AS fp, sum(n1) OVER () AS p, sum(n0) OVER () AS n FROM ce),
th AS (SELECT score AS t FROM cv ORDER BY tp * n - fp * p DESC, score DESC LIMIT 1),
c AS (SELECT lang, t, count(*) FILTER (score >= t AND y = 1) AS tp, count(*) FILTER (score >= t AND y = 0) AS fp, count(*) FILTER (score < t AND y = 1) AS fn, count(*) FILTER (score < t AND y = 0) AS tn FROM al, th GROUP BY 1, 2)
SELECT lang, {r('t', 9)} AS locked_threshold, tp, fp, fn, tn, {r('tp * 1e0 / nullif(tp + fn, 0)')} AS sensitivity, {r('tn * 1e0 / nullif(tn + fp, 0)')} AS specificity, {r('tp * 1e0 / nullif(tp + fp, 0)')} AS ppv,
 {r('tn * 1e0 / nullif(tn + fn, 0)')} AS npv, {r('2e0 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1 FROM c""")
def locked_threshold(spark, sf):
    s = scored(spark, sf)
    c = evaluate.locked_threshold(s.filter(F.col("lang") == "en"), s, ["lang"])
    return c.select("lang", rounded("locked_threshold", 9).alias("locked_threshold"), "tp", "fp", "fn", "tn", *[rounded(x).alias(x) for x in ("sensitivity", "specificity", "ppv", "npv", "f1")])


B = 100
# as many as the original analyses draw
FULL_B = 10000

_DRAW = f"""ps AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM sd), nn AS (SELECT count(*) AS n FROM sd),
dr AS (SELECT rep, {phash_sql('pos', 'rep')} % n AS hit, count(*) AS m FROM (SELECT pos, unnest(range(0, {B})) AS rep FROM ps), nn GROUP BY 1, 2),
bs AS (SELECT dr.rep, m, y, score, score_b FROM dr JOIN ps ON dr.hit = ps.pos),
lg AS (SELECT rep, 'score' AS model, m, y, score AS s FROM bs UNION ALL SELECT rep, 'score_b', m, y, score_b FROM bs)"""
_BAUC = """cl AS (SELECT rep, model, s, sum(m * y) AS n1, sum(m * (1 - y)) AS n0 FROM lg GROUP BY 1, 2, 3),
au AS (SELECT rep, model, CASE WHEN sum(n1) > 0 AND sum(n0) > 0 THEN sum(n1 * below) / (sum(n1) * 1e0 * sum(n0)) END AS auc
 FROM (SELECT *, sum(n0) OVER (PARTITION BY rep, model ORDER BY s) - n0 / 2e0 AS below FROM cl) GROUP BY 1, 2)"""
_BOOT = f"{then('doc')} {SCORED}, {_DRAW}, {_BAUC}"


@query("bootstrap_auc", "V8", f"""{_BOOT} SELECT model, count(auc) AS n_valid, {r('avg(auc)')} AS mean, {r('stddev_samp(auc)')} AS sd, {r('avg(CASE WHEN auc > 0.5 THEN 1e0 WHEN auc <= 0.5 THEN 0e0 END)')} AS share_above,
 {r('quantile_cont(auc, 0.025)')} AS low, {r('median(auc)')} AS median, {r('quantile_cont(auc, 0.975)')} AS high FROM au GROUP BY 1""")
def bootstrap_auc(spark, sf):
    return _bootstrap_auc(spark, sf, B)


_BAP = """cd AS (SELECT rep, model, s, sum(m * y) AS n1, sum(m) AS al FROM lg GROUP BY 1, 2, 3), ce AS (SELECT *, sum(n1) OVER w AS tp, sum(al) OVER w AS seen, sum(n1) OVER (PARTITION BY rep, model) AS pp, sum(al) OVER (PARTITION BY rep, model) AS nn FROM cd WINDOW w AS (PARTITION BY rep, model ORDER BY s DESC)),
ap AS (SELECT rep, model, sum(n1 * tp / (pp * 1e0 * seen)) AS ap FROM ce WHERE pp > 0 AND pp < nn GROUP BY 1, 2)"""


@query("bootstrap_precision", "V8 V2", f"""{_BOOT}, {_BAP} SELECT model, count(ap) AS n_valid, {r('avg(ap)')} AS mean, {r('stddev_samp(ap)')} AS sd, {r('quantile_cont(ap, 0.025)')} AS low, {r('median(ap)')} AS median, {r('quantile_cont(ap, 0.975)')} AS high FROM ap GROUP BY 1""")
def bootstrap_precision(spark, sf):
    """Limits of the average precision, beside those of the AUC."""
    a = resample.bootstrap_metrics(scored(spark, sf), "doc_id", ["score", "score_b"], B)
    return shape(resample.interval(a, ["model"], "average_precision"), ["model", "n_valid"], ["mean", "sd", "low", "median", "high"])


@query("bootstrap_redrawn_full", "V8 V2")
def bootstrap_redrawn_full(spark, sf):
    """10000 replicates, each drawn until both classes are in it: limits of AUC and average precision by language and model."""
    parts = []
    s = cut(scored(spark, sf))
    for lang in sorted(r["lang"] for r in s.select("lang").distinct().collect()):  # one name for each language
        a = resample.bootstrap_metrics(s.filter(F.col("lang") == lang), "doc_id", ["score", "score_b"], FULL_B, redraw=True)
        long = a.unpivot(["rep", "model"], ["auc", "average_precision"], "metric", "v")
        parts.append(resample.interval(long, ["model", "metric"], "v").withColumn("lang", F.lit(lang)))
    return shape(union(parts), ["lang", "model", "metric", "n_valid"], ["mean", "low", "high"])


@query("bootstrap_auc_full", "V8")
def bootstrap_auc_full(spark, sf):
    return _bootstrap_auc(spark, sf, FULL_B)


def _bootstrap_auc(spark, sf, replicates):
    a = resample.bootstrap_auc(scored(spark, sf), "doc_id", ["score", "score_b"], replicates)
    return shape(resample.interval(a, ["model"], "auc", 0.5), ["model", "n_valid"], ["mean", "sd", "share_above", "low", "median", "high"])


@query("bootstrap_auc_poisson", "V8", f"""{then('doc')} {SCORED}, u AS (SELECT *, {phash_sql('doc_id', 'rep')} / {MODULUS}e0 AS u FROM (SELECT *, unnest(range(0, {B})) AS rep FROM sd)),
lg AS (SELECT rep, 'score' AS model, y, score AS s, CASE {' '.join(f'WHEN u < {c!r} THEN {k}' for k, c in enumerate(resample.POISSON_CUTS))} ELSE {len(resample.POISSON_CUTS)} END AS m FROM u), {_BAUC}
SELECT rep, model, {r('auc')} AS auc FROM au""")
def bootstrap_auc_poisson(spark, sf):
    return _bootstrap_auc_poisson(spark, sf, B)


@query("bootstrap_auc_poisson_full", "V8")
def bootstrap_auc_poisson_full(spark, sf):
    return _bootstrap_auc_poisson(spark, sf, FULL_B)


def _bootstrap_auc_poisson(spark, sf, replicates):
    a = resample.bootstrap_auc(scored(spark, sf), "doc_id", ["score"], replicates, method="poisson")
    return a.select(F.col("rep").cast("bigint").alias("rep"), "model", rounded("auc").alias("auc"))


@query("paired_delta_auc", "V9", f"""{_BOOT}, de AS (SELECT a.rep, a.auc - b.auc AS delta FROM au a JOIN au b ON a.rep = b.rep WHERE a.model = 'score' AND b.model = 'score_b')
SELECT count(delta) AS n_valid, {r('avg(delta)')} AS mean, {r('avg(CASE WHEN delta > 0 THEN 1e0 ELSE 0e0 END)')} AS share_above, {r('quantile_cont(delta, 0.025)')} AS low, {r('quantile_cont(delta, 0.975)')} AS high FROM de WHERE delta IS NOT NULL""")
def paired_delta(spark, sf):
    return _paired_delta(spark, sf, B)


@query("paired_delta_auc_full", "V9")
def paired_delta_full(spark, sf):
    return _paired_delta(spark, sf, FULL_B)


def _paired_delta(spark, sf, replicates):
    a = resample.bootstrap_auc(scored(spark, sf), "doc_id", ["score", "score_b"], replicates)
    return shape(resample.interval(resample.paired_delta(a, "score", "score_b"), [], "delta", 0.0), ["n_valid"], ["mean", "share_above", "low", "high"])


@query("winner_share", "V9", f"""{_BOOT}, w AS (SELECT rep, model, row_number() OVER (PARTITION BY rep ORDER BY auc DESC, model) AS rn FROM au WHERE auc IS NOT NULL)
SELECT model, count(*) AS wins, {r('count(*) * 1e0 / sum(count(*)) OVER ()')} AS share FROM w WHERE rn = 1 GROUP BY 1""")
def winner_share(spark, sf):
    return _winner_share(spark, sf, B)


@query("winner_share_full", "V9")
def winner_share_full(spark, sf):
    return _winner_share(spark, sf, FULL_B)


def _winner_share(spark, sf, replicates):
    a = resample.bootstrap_auc(scored(spark, sf), "doc_id", ["score", "score_b"], replicates)
    return shape(resample.winner_share(a), ["model", "wins"], ["share"])


@query("permutation_null", "V10", f"""{then('doc')} {SCORED}, rk AS (SELECT doc_id, y, {midrank('', 'score')} AS rk FROM sd), sz AS (SELECT sum(y) AS n1, count(*) - sum(y) AS n0 FROM sd),
ob AS (SELECT (sum(rk) FILTER (y = 1) - max(n1) * (max(n1) + 1) / 2e0) / (max(n1) * 1e0 * max(n0)) AS obs FROM rk, sz),
pe AS (SELECT rep, rk, row_number() OVER (PARTITION BY rep ORDER BY {phash_sql('doc_id', 'rep')}, doc_id) AS pos FROM (SELECT *, unnest(range(0, {2 * B})) AS rep FROM rk)),
nl AS (SELECT rep, (sum(rk) - max(n1) * (max(n1) + 1) / 2e0) / (max(n1) * 1e0 * max(n0)) AS auc FROM pe, sz WHERE pos <= n1 GROUP BY 1)
SELECT {r('max(obs)')} AS observed, count(*) AS replicates, {r('avg(auc)')} AS null_mean, count(*) FILTER (abs(auc - 0.5e0) >= abs(obs - 0.5e0) - 1e-12) AS n_extreme,
 {r('(count(*) FILTER (abs(auc - 0.5e0) >= abs(obs - 0.5e0) - 1e-12) + 1) / (count(*) + 1e0)')} AS p FROM nl, ob""")
def permutation_null(spark, sf):
    return _permutation_null(spark, sf, 2 * B)


@query("permutation_null_full", "V10")
def permutation_null_full(spark, sf):
    return _permutation_null(spark, sf, FULL_B)


def _permutation_null(spark, sf, replicates):
    s = scored(spark, sf)
    null = resample.permutation_auc(s, "doc_id", replicates)
    return shape(resample.permutation_p(null, evaluate.auc(s, [])), ["replicates", "n_extreme"], ["observed", "null_mean", "p"])


@query("bootstrap_effect_size", "T2 V8", f"""{then('doc')} x AS (SELECT doc_id, y, ln(chars) AS v FROM doc), ps AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY y) AS n FROM x),
dr AS (SELECT y, rep, {phash_sql('pos', 'rep')} % n AS hit, count(*) AS m FROM (SELECT y, pos, n, unnest(range(0, {B})) AS rep FROM ps) GROUP BY 1, 2, 3),
bs AS (SELECT dr.rep, dr.y, m, v FROM dr JOIN ps ON dr.y = ps.y AND dr.hit = ps.pos),
mo AS (SELECT rep, y, sum(m) AS s, sum(m * v) AS x, sum(m * v * v) AS q FROM bs GROUP BY 1, 2),
d AS (SELECT a.rep, (a.x / a.s - b.x / b.s) / sqrt(((a.q - a.x * a.x / a.s) / (a.s - 1) + (b.q - b.x * b.x / b.s) / (b.s - 1)) / 2e0) AS d FROM mo a JOIN mo b ON a.rep = b.rep WHERE a.y = 1 AND b.y = 0)
SELECT count(d) AS n_valid, {r('avg(d)')} AS mean, {r('quantile_cont(d, 0.025)')} AS low, {r('quantile_cont(d, 0.975)')} AS high FROM d""")
def bootstrap_effect_size(spark, sf):
    return _bootstrap_effect_size(spark, sf, B)


@query("bootstrap_effect_size_full", "T2 V8")
def bootstrap_effect_size_full(spark, sf):
    return _bootstrap_effect_size(spark, sf, FULL_B)


def _bootstrap_effect_size(spark, sf, replicates):
    d = views.doc(spark, sf).select("doc_id", "y", F.ln("chars").alias("value"))
    return shape(resample.interval(resample.bootstrap_effect(d, "doc_id", replicates), [], "d"), ["n_valid"], ["mean", "low", "high"])


@query("fold_quality", "V11 L13", f"""{then('doc')} {SCORED}, rp AS (SELECT *, CAST(unnest(range(0, 4)) AS INTEGER) AS rep FROM sd),
fo AS (SELECT *, (row_number() OVER (PARTITION BY rep, y ORDER BY {phash_sql('doc_id', 'rep')}, doc_id) - 1) % 5 AS fold FROM rp), au AS {auc_sql('fo', 'rep, fold', 'score')}
SELECT count(*) AS n_folds, {r('avg(CASE WHEN auc < 0.5 THEN 1e0 ELSE 0e0 END)')} AS share_below_half, {r('avg(auc)')} AS mean, {r('stddev_samp(auc)')} AS sd, {r('median(auc)')} AS median, {r('quantile_cont(auc, 0.025)')} AS q025, {r('quantile_cont(auc, 0.975)')} AS q975 FROM au""")
def fold_quality(spark, sf):
    folds = prep.stratified_folds(scored(spark, sf), 5, 4, key="doc_id")
    return shape(evaluate.fold_quality(evaluate.auc(folds, ["rep", "fold"]), []), ["n_folds"], ["share_below_half", "mean", "sd", "median", "q025", "q975"])


@query("scheme_robustness", "V12 L8", f"""{then('measure', 'sample')} {LABELLED}, {QMAP},
st AS (SELECT feature, y, 'raw' AS scheme, value FROM qm UNION ALL SELECT feature, y, 'mapped', mapped FROM qm), au AS {auc_sql('st', 'scheme, feature', 'value')} SELECT scheme, feature, {r('auc')} AS auc FROM au""")
def scheme_robustness(spark, sf):
    lab = views.labelled(spark, sf, ["cohort", "y"])
    m = prep.quantile_map(_transfer(lab).drop("cohort"), _train(lab)).withColumnRenamed("value", "raw")
    long = m.unpivot(["feature", "y"], ["raw", "mapped"], "scheme", "value")
    return shape(evaluate.compare_schemes(long, "scheme"), ["scheme", "feature"], ["auc"])


@query("importance_concordance", "V13 J5 T8", f"""{then('measure', 'sample')} {LABELLED}, {MOMENTS}, {_MWU},
im AS (SELECT mom.feature, abs(m1 - m0) AS a, abs(auc - 0.5e0) AS b FROM mom JOIN mwu ON mom.feature = mwu.feature),
rk AS (SELECT *, {midrank('', 'a')} AS ra, {midrank('', 'b')} AS rb FROM im),
pr AS (SELECT count(*) FILTER (l.a < q.a AND l.b < q.b) AS con, count(*) FILTER (l.a < q.a AND l.b > q.b) AS dis, count(*) FILTER (l.a < q.a) AS nx, count(*) FILTER (l.b < q.b) AS ny FROM im l CROSS JOIN im q)
SELECT {r('max(con - dis) / sqrt(max(nx) * 1e0 * max(ny))')} AS tau, {r('(SELECT corr(ra, rb) FROM rk)')} AS spearman FROM pr""")
def importance_concordance(spark, sf):
    lab = views.labelled(spark, sf)
    m = twogroup.group_moments(lab, ["feature"]).select("feature", F.abs(F.col("mean1") - F.col("mean0")).alias("a"))
    u = evaluate.auc(lab, ["feature"], "value").select("feature", F.abs(F.col("auc") - 0.5).alias("b"))
    both = merge_left(m, [u], "feature")
    tau = twogroup.kendall_tau(both, "a", "b")
    rho = twogroup.correlations(both, [], "a", "b").select("spearman")
    return shape(tau.withColumn("spearman", rho.scalar()), [], ["tau", "spearman"])
