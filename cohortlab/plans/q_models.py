"""Logistic models with inference, MLlib fits, panels, ablations and stability."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from cohortlab.functions.hashing import phash_sql
from cohortlab.functions.scalars import logit, rounded
from cohortlab.operators import blockfit, evaluate, glm, models, prep, rollup, selection, treepaths, twogroup
from cohortlab.operators.tables import top_per_group
from cohortlab.plans import views
from cohortlab.plans.q_eval import SCORED, scored
from cohortlab.plans.q_prep import _SCALER, QMAP, _train, _transfer
from cohortlab.plans.q_stats import LABELLED
from cohortlab.plans.registry import query
from cohortlab.plans.sqltext import auc_sql, chi2_p, logistic_sql, norm_p, r, shape
from cohortlab.plans.views import then
from cohortlab.session import cut

_GD = "gd AS (SELECT doc_id, y, toxic, lang, 'all' AS model, ln(chars) AS lc, chars / words AS aw FROM doc)"


def _gd(spark, sf):
    return views.doc(spark, sf).select("doc_id", "y", "toxic", "lang", F.ln("chars").alias("lc"), (F.col("chars") / F.col("words")).alias("aw"))


# ---- logistic models with inference -------------------------------------

def _term_sql(i: int, name: str) -> str:
    return f"""SELECT '{name}' AS term, {r(f'b{i}', 5)} AS estimate, {r(f'sqrt(i{i})', 5)} AS se, {r(f'exp(b{i})', 5)} AS odds_ratio, {r(f'exp(b{i} - 1.96e0 * sqrt(i{i}))', 5)} AS or_low,
 {r(f'exp(b{i} + 1.96e0 * sqrt(i{i}))', 5)} AS or_high, {r(norm_p(f'b{i} / sqrt(i{i})'))} AS p FROM nt_fit"""


@query("logistic_inference", "T14", f"{then('doc')} {_GD}, {logistic_sql('gd', ['t.lc', 't.aw'])} " + " UNION ALL ".join(_term_sql(i, n) for i, n in enumerate(["intercept", "lc", "aw"]) if i))
def logistic_inference(spark, sf):
    fit = glm.fit_logistic(glm.design(_gd(spark, sf), ["lc", "aw"], F.lit("all")), 3)
    t = glm.coefficient_table(fit, ["intercept", "lc", "aw"]).filter("term <> 'intercept'")
    return t.select("term", rounded("p").alias("p"), *[rounded(c, 5).alias(c) for c in ("estimate", "se", "odds_ratio", "or_low", "or_high")])


@query("logistic_fit_summary", "T14", f"""{then('doc')} {_GD}, {logistic_sql('gd', ['t.lc', 't.aw'])}, q AS (SELECT avg(y) AS q, count(*) AS m FROM gd)
SELECT n, {r('log_lik', 5)} AS log_lik, {r('6e0 - 2e0 * log_lik', 5)} AS aic, {r('1e0 - log_lik / (m * (q * ln(q) + (1 - q) * ln(1 - q)))', 6)} AS mcfadden FROM nt_fit, q""")
def logistic_fit_summary(spark, sf):
    fit = glm.fit_logistic(glm.design(_gd(spark, sf), ["lc", "aw"], F.lit("all")), 3)
    return fit.select("n", rounded("log_lik", 5).alias("log_lik"), rounded("aic", 5).alias("aic"), rounded(1.0 - F.col("log_lik") / F.col("null_log_lik")).alias("mcfadden"))


@query("likelihood_ratio", "T15", f"""{then('doc')} {_GD}, {logistic_sql('gd', ['t.lc'], prefix='ba')}, {logistic_sql('gd', ['t.lc', 't.aw'], prefix='fu')},
x AS (SELECT 2e0 * (fu_fit.log_lik - ba_fit.log_lik) AS chi2 FROM fu_fit, ba_fit) SELECT {r('chi2', 5)} AS chi2, {r('2e0 - chi2', 5)} AS delta_aic, 1 AS df, {r(chi2_p('chi2', '1'))} AS p FROM x""")
def likelihood_ratio(spark, sf):
    d = cut(_gd(spark, sf))
    base = glm.fit_logistic(glm.design(d, ["lc"], F.lit("all")), 2)
    full = glm.fit_logistic(glm.design(d, ["lc", "aw"], F.lit("all")), 3)
    lr = glm.likelihood_ratio(base, full, 1)
    return lr.select("df", rounded("chi2", 5).alias("chi2"), rounded("delta_aic", 5).alias("delta_aic"), rounded("p").alias("p"))


@query("ridge_logistic", "M2", f"""{then('doc')} {_GD.replace("'all' AS model", "lang AS model")}, {logistic_sql('gd', ['t.lc', 't.aw'], l2=1.0)} SELECT model, {r('b0', 5)} AS b0, {r('b1', 5)} AS b1, {r('b2', 5)} AS b2 FROM nt_fit""")
def ridge_logistic(spark, sf):
    fit = glm.fit_logistic(glm.design(_gd(spark, sf), ["lc", "aw"], "lang"), 3, l2=1.0)
    return fit.select("model", *[rounded(F.col("beta")[i], 5).alias(f"b{i}") for i in range(3)])


_CAL = f"{then('doc')} {SCORED}, cd AS (SELECT *, lang AS model, ln(greatest(1e-6, least(1 - 1e-6, score)) / (1e0 - greatest(1e-6, least(1 - 1e-6, score)))) AS lp FROM sd)"


@query("calibration", "V6", f"""{_CAL}, {logistic_sql('cd', ['t.lp'], prefix='li')}, {logistic_sql('cd', [], offset='t.lp', prefix='of')}
SELECT li_fit.model AS lang, {r('li_fit.b0', 5)} AS intercept, {r('li_fit.b1', 5)} AS slope, {r('of_fit.b0', 5)} AS in_the_large FROM li_fit JOIN of_fit ON li_fit.model = of_fit.model""")
def calibration(spark, sf):
    return shape(glm.calibration(scored(spark, sf), "lang", "score"), ["lang"], ["intercept", "slope", "in_the_large"], 5)


@query("recalibration", "V7", f"""{_CAL}, tr AS (SELECT y, lp, 'm' AS model FROM cd WHERE lang = 'en'), {logistic_sql('tr', ['t.lp'])} SELECT doc_id, {r('1e0 / (1e0 + exp(-(b0 + b1 * lp)))')} AS probability FROM cd, nt_fit""")
def recalibration(spark, sf):
    s = scored(spark, sf).withColumn("lp", logit("score"))
    fit = glm.fit_recalibration(s.filter(F.col("lang") == "en"), "lp")
    return shape(glm.apply_recalibration(s, fit, "lp"), ["doc_id"], ["probability"])


def _spec_sql(source: str, specs: dict[str, list[str]], label: str = "y") -> str:
    """Chains for several specifications over one source, and a union of their linear predictors over table ev."""
    chains = ", ".join(logistic_sql(source, [f"t.{c}" for c in cols], prefix=f"s{i}", label=label) for i, cols in enumerate(specs.values()))
    preds = " UNION ALL ".join(
        f"SELECT '{n}' AS spec, ev.*, b0 + " + " + ".join(f"b{j + 1} * {c}" for j, c in enumerate(cols)) + f" AS eta FROM ev, s{i}_fit" for i, (n, cols) in enumerate(specs.items()))
    return f"{chains}, pd AS ({preds})"


_BASE = {"age": ["age"], "sex": ["male"], "age_sex": ["age", "male"]}


@query("demographic_baselines", "M13", f"""{then('sample')} ev AS (SELECT *, CASE WHEN sex = 'male' THEN 1e0 ELSE 0e0 END AS male FROM sample), tr AS (SELECT *, 'm' AS model FROM ev WHERE cohort = 'train'),
{_spec_sql('tr', _BASE)}, rd AS (SELECT spec, cohort, y, round(eta, 9) AS eta FROM pd) SELECT spec AS model, cohort, n1, n0, {r('auc')} AS auc FROM {auc_sql('rd', 'spec, cohort', 'eta')}""")
def demographic_baselines(spark, sf):
    s = views.sample(spark, sf).withColumn("male", (F.col("sex") == "male").cast("double"))
    fits, _, k = models.fit_specs(_train(s), _BASE, ["age", "male"])
    return _spec_auc(s, fits, k, _BASE, ["age", "male"], ["cohort"])


def _spec_auc(rows, fits, k, specs, columns, keys):
    marks = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), *[F.lit(1.0 if c in cols else 0.0).alias(f"m_{c}") for c in columns]) for n, cols in specs.items()]))
    x = rows.withColumn("_m", marks).select("y", *keys, F.col("_m.model").alias("model"), F.array(F.lit(1.0), *[F.col(c) * F.col(f"_m.m_{c}") for c in columns]).alias("x"))
    out = glm.score_rows(x, fits, k, ["y", *keys]).withColumn("score", F.round("score", 9))
    return shape(evaluate.auc(out, ["model", *keys]), ["model", *keys, "n1", "n0"], ["auc"])


_CONF = {"score": ["lc"], "confounder": ["aw"], "both": ["lc", "aw"]}


@query("confounder_adjusted", "M14", f"""{then('doc')} {_GD}, ev AS (SELECT doc_id, y, lang, lc, aw FROM gd), {_spec_sql('gd', _CONF)}, rd AS (SELECT spec, lang, y, round(eta, 9) AS eta FROM pd)
SELECT spec AS model, lang, n1, n0, {r('auc')} AS auc FROM {auc_sql('rd', 'spec, lang', 'eta')}""")
def confounder_adjusted(spark, sf):
    d = cut(_gd(spark, sf))
    fits, _, k = models.fit_specs(d, _CONF, ["lc", "aw"])
    return _spec_auc(d, fits, k, _CONF, ["lc", "aw"], ["lang"])


_NESTED = {"base": ["lc"], "full": ["lc", "aw"]}


@query("nested_model_auc", "T15 V1", f"""{then('doc')} {_GD}, ev AS (SELECT doc_id, y, lc, aw FROM gd), {_spec_sql('gd', _NESTED)}, rd AS (SELECT spec, y, round(eta, 9) AS eta FROM pd), au AS {auc_sql('rd', 'spec', 'eta')}
SELECT {r("max(auc) FILTER (spec = 'base')")} AS base_auc, {r("max(auc) FILTER (spec = 'full')")} AS full_auc, {r("max(auc) FILTER (spec = 'full') - max(auc) FILTER (spec = 'base')")} AS delta_auc FROM au""")
def nested_model_auc(spark, sf):
    d = cut(_gd(spark, sf))
    fits, scored, k = models.fit_specs(d, _NESTED, ["lc", "aw"])
    rows = glm.score_rows(scored, fits, k, ["y"]).withColumn("score", F.round("score", 9))
    return shape(models.nested_auc(rows, "base", "full"), [], ["base_auc", "full_auc", "delta_auc"])


def _ablation_sql() -> str:
    specs = {"lc": ["lc"], "aw": ["aw"], "lc+aw": ["lc", "aw"]}
    chains = ", ".join(logistic_sql("tr", [f"t.{c}" for c in cols], prefix=f"s{i}", l2=1.0) for i, cols in enumerate(specs.values()))
    preds = " UNION ALL ".join(f"SELECT '{n}' AS model, cohort, y, b0 + " + " + ".join(f"b{j + 1} * {c}" for j, c in enumerate(cols)) + f" AS eta FROM ev, s{i}_fit" for i, (n, cols) in enumerate(specs.items()))
    return f"""{then('doc')} gd AS (SELECT y, lang, ln(chars) AS lc, chars / words AS aw FROM doc), tr AS (SELECT *, 'm' AS model FROM gd WHERE lang = 'en'),
ev AS (SELECT *, CASE WHEN lang = 'en' THEN 'training' ELSE 'other' END AS cohort FROM gd), {chains}, pd AS ({preds}), au AS {auc_sql('pd', 'model, cohort', 'eta')}
SELECT a.model, a.cohort, {r('a.auc')} AS auc, {r('a.auc - f.auc')} AS delta_auc FROM au a JOIN au f ON a.cohort = f.cohort WHERE f.model = 'lc+aw'"""


@query("subset_ablation", "M11 L3", _ablation_sql())
def subset_ablation(spark, sf):
    d = cut(_gd(spark, sf))
    a = models.ablation(d.filter(F.col("lang") == "en"), {"other": d.filter(F.col("lang") != "en")}, ["lc", "aw"])
    return shape(a, ["model", "cohort"], ["auc", "delta_auc"])


_SUBSETS = ["f00", "f01", "f02", "f00+f01", "f00+f02", "f01+f02", "f00+f01+f02"]
_FIXED = f"""{then('measure', 'sample')} {LABELLED}, cz AS (SELECT cohort, feature, avg(value) AS mu, stddev_samp(value) AS sd FROM lab WHERE feature IN ('f00', 'f01', 'f02') GROUP BY 1, 2),
zz AS (SELECT lab.cohort, lab.sample_id, y, lab.feature, (value - mu) / sd AS z FROM lab JOIN cz ON lab.cohort = cz.cohort AND lab.feature = cz.feature),
fs AS ({' UNION ALL '.join(f"SELECT cohort, sample_id, y, '{s}' AS model, {s.count('+') + 1} AS n_features, (" + ' + '.join(f"max(z) FILTER (feature = '{f}')" for f in s.split('+')) + f") / {s.count('+') + 1} AS score FROM zz GROUP BY 1, 2, 3" for s in _SUBSETS)}),
fa AS (SELECT * FROM {auc_sql('fs', 'cohort, model, n_features', 'score')}),
fc AS (SELECT cohort, model, score, sum(y) AS p, count(*) AS m FROM fs GROUP BY 1, 2, 3), fr AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS al, sum(p) OVER (PARTITION BY cohort, model) AS pp FROM fc WINDOW w AS (PARTITION BY cohort, model ORDER BY score DESC)),
fp AS (SELECT cohort, model, sum(p * tp / (pp * 1e0 * al)) AS ap FROM fr GROUP BY 1, 2), ff AS (SELECT fa.*, ap FROM fa JOIN fp ON fa.cohort = fp.cohort AND fa.model = fp.model)
SELECT a.cohort, a.model, CAST(a.n_features AS INTEGER) AS n_features, {r('a.auc')} AS auc, {r('a.ap')} AS average_precision, {r('a.auc - b.auc')} AS delta_auc, {r('a.ap - b.ap')} AS delta_average_precision FROM ff a JOIN ff b ON a.cohort = b.cohort WHERE b.model = 'f00+f01+f02'"""


@query("fixed_score_ablation", "M11 L3", _FIXED)
def fixed_score_ablation(spark, sf):
    a = models.fixed_score_ablation(views.labelled(spark, sf, ["cohort", "y"]), ["f00", "f01", "f02"])
    return shape(a, ["cohort", "model", "n_features"], ["auc", "average_precision", "delta_auc", "delta_average_precision"])


@query("frozen_robustness", "V12 L8", f"""{then('measure', 'sample')} {LABELLED}, {_SCALER}, {QMAP}, tr AS (SELECT sample_id, y, 'm' AS model, max((value - mu) / sd0) FILTER (lab.feature = 'f00') AS x1, max((value - mu) / sd0) FILTER (lab.feature = 'f01') AS x2
 FROM lab JOIN sc ON lab.feature = sc.feature WHERE cohort = 'train' AND lab.feature IN ('f00', 'f01') GROUP BY 1, 2), {logistic_sql('tr', ['t.x1', 't.x2'], l2=1.0)},
ss AS (SELECT sample_id, y, feature, 'raw' AS scheme, value AS v FROM qm WHERE feature IN ('f00', 'f01') UNION ALL SELECT sample_id, y, feature, 'mapped', mapped FROM qm WHERE feature IN ('f00', 'f01')),
sx AS (SELECT scheme, sample_id, y, max((v - mu) / sd0) FILTER (ss.feature = 'f00') AS x1, max((v - mu) / sd0) FILTER (ss.feature = 'f01') AS x2 FROM ss JOIN sc ON ss.feature = sc.feature GROUP BY 1, 2, 3),
al AS (SELECT 'model' AS analysis, scheme, y, round(b0 + b1 * x1 + b2 * x2, 9) AS s FROM sx, nt_fit UNION ALL SELECT feature, scheme, y, v FROM ss), au AS {auc_sql('al', 'analysis, scheme', 's')}
SELECT analysis, {r("max(auc) FILTER (scheme = 'raw')")} AS auc_raw, {r("max(auc) FILTER (scheme = 'mapped')")} AS auc_mapped, {r("max(auc) FILTER (scheme = 'mapped') - max(auc) FILTER (scheme = 'raw')")} AS delta_mapped FROM au GROUP BY 1""")
def frozen_robustness(spark, sf):
    """One model frozen on training values, scored on raw and on mapped values of the other cohort."""
    lab = views.labelled(spark, sf, ["cohort", "y"])
    mapped = prep.quantile_map(_transfer(lab).drop("cohort"), _train(lab)).withColumnRenamed("value", "raw")
    out = models.frozen_on_schemes(_train(lab).drop("cohort"), mapped, ["f00", "f01"], ["raw", "mapped"])
    return shape(out, ["analysis"], ["auc_raw", "auc_mapped", "delta_mapped"])


@query("covariate_fold_auc", "Q18 M13", f"""{then('sample')} fo AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY {phash_sql('sample_id', '0')}, sample_id) - 1) % 5 AS fold FROM sample),
tr AS (SELECT h AS model, y, age FROM (SELECT *, unnest(range(0, 5)) AS h FROM fo) WHERE fold <> h), {logistic_sql('tr', ['t.age'], l2=1.0)},
pd AS (SELECT fold, y, round(b0 + b1 * age, 9) AS s FROM fo JOIN nt_fit ON fold = model) SELECT 0 AS rep, CAST(fold AS INTEGER) AS fold, n1, n0, {r('auc')} AS auc, {r('avg(auc) OVER ()')} AS mean_auc FROM {auc_sql('pd', 'fold', 's')}""")
def covariate_fold_auc(spark, sf):
    s = views.sample(spark, sf)
    a = cut(models.covariate_fold_auc(s, "age", prep.stratified_folds(s.select("sample_id", "y"), 5, 1)))
    return shape(a.withColumn("mean_auc", a.agg(F.avg("auc")).scalar()), ["rep", "fold", "n1", "n0"], ["auc", "mean_auc"])


@query("flagged_removal", "Q17 L13", f"""{then('doc')} first AS (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents),
g0 AS (SELECT doc.doc_id, y, ln(chars) AS lc, chars / words AS aw, rn FROM doc JOIN first ON doc.doc_id = first.doc_id),
gs AS (SELECT 'as_given' AS scheme, * FROM g0 UNION ALL SELECT 'flagged_removed', * FROM g0 WHERE rn = 1),
fo AS (SELECT *, (row_number() OVER (PARTITION BY scheme, y ORDER BY {phash_sql('doc_id', '0')}, doc_id) - 1) % 5 AS fold FROM gs),
tr AS (SELECT scheme || '|' || CAST(h AS VARCHAR) AS model, y, lc, aw FROM (SELECT *, unnest(range(0, 6)) AS h FROM fo) WHERE h = 5 OR fold <> h), {logistic_sql('tr', ['t.lc', 't.aw'])},
ap AS (SELECT scheme, 'apparent' AS kind, y, b0 + b1 * lc + b2 * aw AS eta FROM fo JOIN nt_fit ON model = scheme || '|5' UNION ALL SELECT scheme, 'cv5', y, 1e0 / (1e0 + exp(-(b0 + b1 * lc + b2 * aw))) FROM fo JOIN nt_fit ON model = scheme || '|' || CAST(fold AS VARCHAR)),
rd AS (SELECT scheme, kind, y, round(eta, 9) AS eta FROM ap) SELECT scheme, kind, n1, n0, {r('auc')} AS auc FROM {auc_sql('rd', 'scheme, kind', 'eta')}""")
def flagged_removal(spark, sf):
    """Apparent and five-fold AUC with and without the later copies of duplicated texts."""
    text = views.table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    first = text.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    d = _gd(spark, sf).join(text.join(first, "h"), "doc_id")
    both = d.withColumn("scheme", F.explode(F.array(F.lit("as_given"), F.lit("flagged_removed")))).filter((F.col("scheme") == "as_given") | (F.col("doc_id") == F.col("first_id")))
    both = cut(both.select("scheme", "doc_id", "y", "lc", "aw"))
    folds = models.union([prep.stratified_folds(both.filter(F.col("scheme") == s), 5, 1, key="doc_id") for s in ("as_given", "flagged_removed")])
    folds = cut(folds)
    held = F.explode(F.sequence(F.lit(0), F.lit(5)))
    train = folds.withColumn("held", held).filter((F.col("held") == 5) | (F.col("fold") != F.col("held")))
    fit = cut(glm.fit_logistic(glm.design(train, ["lc", "aw"], F.struct("scheme", "held")), 3))
    x = folds.withColumn("x", F.array(F.lit(1.0), "lc", "aw"))
    kinds = F.explode(F.array(F.struct(F.lit("apparent").alias("kind"), F.lit(5).alias("held")), F.struct(F.lit("cv5").alias("kind"), F.col("fold").alias("held"))))
    x = x.withColumn("_k", kinds).select("y", "x", F.col("_k.kind").alias("kind"), F.struct("scheme", F.col("_k.held").alias("held")).alias("model"))
    out = glm.score_rows(x, fit, 3, ["y", "kind"]).withColumn("scheme", F.col("model.scheme"))
    out = out.withColumn("eta", F.round(F.when(F.col("kind") == "apparent", F.col("score")).otherwise(F.col("probability")), 9))
    return shape(evaluate.auc(out, ["scheme", "kind"], "eta"), ["scheme", "kind", "n1", "n0"], ["auc"])


# ---- random panels -------------------------------------------------------

PANELS, SIZE = 12, 2
# as many as the original analyses draw
FULL_PANELS, FULL_SIZE = 1000, 3
_PANEL = f"""fn AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS f FROM (SELECT DISTINCT feature FROM measure)),
dw AS (SELECT feature, f, panel, {phash_sql('f', 'panel')} AS h FROM (SELECT *, unnest(range(0, {PANELS})) AS panel FROM fn)),
pn AS (SELECT panel, feature, rn - 1 AS slot FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY h, f) AS rn FROM dw) WHERE rn <= {SIZE}),
z AS (SELECT sample_id, y, cohort, lab.feature, (value - mu) / sd AS z FROM lab JOIN sc ON lab.feature = sc.feature),
pr AS (SELECT panel, sample_id, y, cohort, max(z) FILTER (slot = 0) AS x1, max(z) FILTER (slot = 1) AS x2 FROM z JOIN pn ON z.feature = pn.feature GROUP BY 1, 2, 3, 4)"""


def _z(spark, sf, cols=("cohort", "y")):
    lab = views.labelled(spark, sf, list(cols))
    return cut(prep.apply_scaler(lab, prep.fit_scaler(_train(lab))).drop("value"))


@query("panel_transfer_null", "M12", f"""{then('measure', 'sample')} {LABELLED}, {_SCALER}, {_PANEL}, tr AS (SELECT *, panel AS model FROM pr WHERE cohort = 'train'), {logistic_sql('tr', ['t.x1', 't.x2'], l2=1.0)},
pd AS (SELECT panel, y, b0 + b1 * x1 + b2 * x2 AS eta FROM pr JOIN nt_fit ON panel = model WHERE cohort = 'transfer') SELECT CAST(panel AS INTEGER) AS panel, {r('auc')} AS auc FROM {auc_sql('pd', 'panel', 'eta')}""")
def panel_transfer_null(spark, sf):
    return _panel_transfer(spark, sf, PANELS, SIZE)


@query("panel_transfer_null_full", "M12")
def panel_transfer_null_full(spark, sf):
    """1000 panels of three features: L1 fits (c = 0.3) on the training cohort, scored on the other."""
    rows, names = _raw_arrays(spark, sf)
    panels = selection.numbered_panels(models.random_panels(views.measure(spark, sf), FULL_PANELS, FULL_SIZE), names, FULL_SIZE)
    return shape(selection.panel_transfer(_train(rows), _transfer(rows), names, panels), ["panel"], ["auc"])


def _panel_transfer(spark, sf, n, size):
    z = _z(spark, sf)
    panels = cut(models.random_panels(z, n, size))
    return shape(models.panel_transfer(_train(z), _transfer(z), panels, size), ["panel"], ["auc"])


@query("panel_within_null", "M12 L13", f"""{then('measure', 'sample')} {LABELLED}, {_SCALER}, {_PANEL},
fo AS (SELECT sample_id, (row_number() OVER (PARTITION BY y ORDER BY {phash_sql('sample_id', '0')}, sample_id) - 1) % 5 AS fold FROM sample),
pf AS (SELECT pr.*, fold FROM pr JOIN fo ON pr.sample_id = fo.sample_id), tr AS (SELECT *, panel * 10 + h AS model FROM (SELECT *, unnest(range(0, 5)) AS h FROM pf) WHERE fold <> h), {logistic_sql('tr', ['t.x1', 't.x2'], l2=1.0)},
pd AS (SELECT panel, y, round(1e0 / (1e0 + exp(-(b0 + b1 * x1 + b2 * x2))), 12) AS p FROM pf JOIN nt_fit ON panel * 10 + fold = model), au AS {auc_sql('pd', 'panel', 'p')}
SELECT count(auc) AS n_panels, {r('avg(auc)', 5)} AS mean_auc, {r('stddev_samp(auc)', 5)} AS sd_auc, {r('avg(CASE WHEN auc >= 0.5 THEN 1e0 ELSE 0e0 END)')} AS share_at_least, {r('avg(CASE WHEN auc < 0.5 THEN 1e0 ELSE 0e0 END)')} AS percentile FROM au""")
def panel_within_null(spark, sf):
    return _panel_within(spark, sf, PANELS, SIZE)


@query("panel_within_null_full", "M12 L13")
def panel_within_null_full(spark, sf):
    """1000 panels of three features inside the transfer cohort: L1 fits (c = 0.3), every sample left out once."""
    rows, names = _raw_arrays(spark, sf)
    panels = selection.numbered_panels(models.random_panels(views.measure(spark, sf), FULL_PANELS, FULL_SIZE), names, FULL_SIZE)
    within = blockfit.leave_one_out(blockfit.pack(_transfer(rows), names), blockfit.Models.of(FULL_PANELS, c=0.3, columns=panels))
    return shape(models.panel_summary(cut(within.select("auc")), 0.5), ["n_panels"], ["mean_auc", "sd_auc", "share_at_least", "percentile"], 5)


def _panel_within(spark, sf, n, size):
    z = _z(spark, sf)
    folds = prep.stratified_folds(views.sample(spark, sf).select("sample_id", "y"), 5, 1)
    within = models.panel_within(z, folds, models.random_panels(z, n, size), size)
    s = models.panel_summary(within, 0.5)
    return s.select("n_panels", rounded("mean_auc", 5).alias("mean_auc"), rounded("sd_auc", 5).alias("sd_auc"), rounded("share_at_least").alias("share_at_least"), rounded("percentile").alias("percentile"))


@query("batch_classifier_shuffles", "M15 V10", f"""{then('measure', 'sample')} b0 AS (SELECT s.sample_id, CASE WHEN batch_mixed IN ('b0', 'b1') THEN 1 ELSE 0 END AS y, max(value) FILTER (feature = 'f00') AS x1, max(value) FILTER (feature = 'f01') AS x2 FROM sample s JOIN measure m ON s.sample_id = m.sample_id GROUP BY 1, 2),
b AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY {phash_sql('sample_id', '0')}, sample_id) - 1) % 5 AS fold FROM b0),
sh AS (SELECT rep, sample_id, x1, x2, fold, row_number() OVER (PARTITION BY rep ORDER BY {phash_sql('sample_id', 'rep')}, sample_id) AS pos FROM (SELECT *, unnest(range(0, 6)) AS rep FROM b)),
al AS (SELECT -1 AS rep, fold, y, x1, x2 FROM b UNION ALL SELECT rep, fold, CASE WHEN pos <= (SELECT sum(y) FROM b) THEN 1 ELSE 0 END, x1, x2 FROM sh),
tr AS (SELECT *, rep * 10 + h AS model FROM (SELECT *, unnest(range(0, 5)) AS h FROM al) WHERE fold <> h), {logistic_sql('tr', ['t.x1', 't.x2'], l2=1.0)},
pd AS (SELECT rep, y, 1e0 / (1e0 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM al JOIN nt_fit ON rep * 10 + fold = model) SELECT CAST(rep AS INTEGER) AS rep, {r('auc')} AS auc FROM {auc_sql('pd', 'rep', 'p')}""")
def batch_classifier_shuffles(spark, sf):
    m = views.labelled(spark, sf, ["batch_mixed"])
    pick = lambda f: F.max(F.when(F.col("feature") == f, F.col("value")))
    b = m.groupBy("sample_id", "batch_mixed").agg(pick("f00").alias("x1"), pick("f01").alias("x2"))
    b = cut(b.withColumn("y", F.col("batch_mixed").isin("b0", "b1").cast("int")).drop("batch_mixed"))
    folds = cut(prep.stratified_folds(b.select("sample_id", "y"), 5, 1))
    return shape(models.batch_classifier(b, "y", ["x1", "x2"], folds, 6), ["rep"], ["auc"])


SHUFFLES = 5000


@query("batch_classifier_shuffles_full", "M15 V10")
def batch_classifier_shuffles_full(spark, sf):
    """Batch labels predicted from the first five component scores with every sample left out once, and 5000 shuffles, as in the original analysis."""
    z = cut(prep.apply_scaler(views.labelled(spark, sf, ["batch_mixed"]), prep.fit_scaler(views.labelled(spark, sf, ["batch_mixed"]))).drop("value"))
    rows = cut(models.feature_arrays(z, ["sample_id", "batch_mixed"]))
    pcs = [f"PC{i}" for i in range(1, 6)]
    scores, _ = models.pca_scores(rows, ["sample_id", "batch_mixed"], len(pcs))
    b = scores.groupBy("sample_id", "batch_mixed").agg(*(F.max(F.when(F.col("pc") == pc, F.col("score"))).alias(pc) for pc in pcs))
    b = b.select("sample_id", F.col("batch_mixed").isin("b0", "b1").cast("int").alias("y"), F.array(*pcs).alias("x"))
    blocks = blockfit.pack(b, pcs, shuffles=SHUFFLES)
    every = blockfit.Models.of(SHUFFLES + 1, c=1.0, label=np.arange(-1, SHUFFLES))
    out = blockfit.leave_one_out(blocks, every, "l2")
    return shape(out.withColumn("rep", (F.col("grp") - 1).cast("int")), ["rep"], ["auc"])


# ---- MLlib fits (no SQL counterpart) ------------------------------------

def _arrays(spark, sf):
    z = _z(spark, sf)
    names = models.feature_names(z)
    return cut(models.feature_arrays(z, ["sample_id", "cohort", "y"])), names


def _raw_arrays(spark, sf, *cols):
    """Unscaled values by sample; what is scaled is scaled inside each model."""
    m = views.labelled(spark, sf, ["cohort", "y", *cols])
    names = models.feature_names(m)
    return cut(models.feature_arrays(m, ["sample_id", "cohort", "y", *cols], "value", names=names, fill=float("nan"))), names


def _one_lasso(spark, sf):
    rows, names = _raw_arrays(spark, sf)
    blocks = blockfit.pack(_train(rows), names)
    one = blockfit.Models.of(1, c=0.3)
    return rows, names, blocks, one, blockfit.fit(blocks, one)


@query("lasso_fit", "M1")
def lasso_fit(spark, sf):
    _, names, _, _, fits = _one_lasso(spark, sf)
    c = blockfit.coefficients(spark, fits, names).withColumn("selected", F.abs("coefficient") > 1e-10)
    return shape(c, ["feature", "selected"], ["coefficient"])


@query("lasso_transfer", "M1 V1 V2")
def lasso_transfer(spark, sf):
    rows, names, blocks, one, fits = _one_lasso(spark, sf)
    every = replace(blockfit.pack(rows, names), centre=blocks.centre)
    p = blockfit.scored(every, one, fits, "all").join(rows.select("sample_id", "cohort"), "sample_id")
    out = evaluate.auc(p, ["cohort"], "probability").join(evaluate.probability_metrics(p, ["cohort"]), "cohort")
    return shape(out, ["cohort", "n1", "n0"], ["auc", "brier", "accuracy"])


@query("forest_importance", "M3")
def forest_importance(spark, sf):
    rows, names = _arrays(spark, sf)
    return shape(models.importances(models.fit_forest(_train(rows)), names, spark), ["feature"], ["importance"], 4)


@query("boosting_importance", "M4")
def boosting_importance(spark, sf):
    rows, names = _arrays(spark, sf)
    return shape(models.importances(models.fit_boosting(_train(rows)), names, spark), ["feature"], ["importance"], 4)


@query("shapley_ranking", "M5 W5")
def shapley_ranking(spark, sf):
    """Path attributions of a forest of 500 trees, by class."""
    rows, names = _arrays(spark, sf)
    phi = treepaths.attributions(models.fit_forest(_train(rows)), rows, names, ["sample_id", "y"])
    return shape(models.attribution_ranking(phi, ["y"]), ["y", "feature"], ["mean_abs_phi"], 5)


@query("permutation_importance", "M5")
def permutation_importance(spark, sf):
    rows, names = _arrays(spark, sf)
    return shape(models.permutation_importance(models.fit_lr(_train(rows), False, 1.0), rows, names, "sample_id"), ["feature"], ["auc_loss"], 4)


@query("attribution_stability", "M6")
def attribution_stability(spark, sf):
    """How often a feature is among the top twenty path attributions over five folds, a forest of 300 trees of depth five each."""
    rows, names = _arrays(spark, sf)
    folds = prep.stratified_folds(rows.select("sample_id", "y"), 5, 1)
    data = cut(rows.join(folds.select("sample_id", "fold"), "sample_id"))

    def one(fold):
        phi = treepaths.attributions(models.fit_forest(data.filter(F.col("fold") != fold), trees=300, depth=5), data.filter(F.col("fold") == fold), names, ["sample_id"])
        return models.attribution_ranking(phi).withColumn("fold", F.lit(fold))

    per = cut(models.union(models.parallel(one, range(5))))
    top = top_per_group(per, ["fold"], [F.desc("mean_abs_phi"), F.col("feature")], 20)
    return top.groupBy("feature").agg(F.count(F.lit(1)).alias("n_folds"))


@query("pca_scores", "M7")
def pca_scores(spark, sf):
    rows, _ = _arrays(spark, sf)
    scores, _ = models.pca_scores(rows, ["sample_id"], 3)
    return shape(scores, ["sample_id", "pc"], ["score"], 4)


@query("pc_association", "Q13 M7 T3 T7")
def pc_association(spark, sf):
    rows, _ = _arrays(spark, sf)
    scores, _ = models.pca_scores(rows, ["sample_id", "y"], 5)
    scores = cut(scores)
    out = twogroup.mann_whitney(scores, ["pc"], "score").join(twogroup.correlations(scores, ["pc"], "score", "y").select("pc", "spearman"), "pc")
    return shape(out, ["pc", "n1", "n0"], ["auc", "p", "spearman"], 4)


# penalties and counts of the original analyses
GRID = [0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0]
RESAMPLES = 2000


@query("penalty_tuning", "M8")
def penalty_tuning(spark, sf):
    """Eight penalties over five folds, ten times."""
    rows, names = _raw_arrays(spark, sf)
    train = cut(_train(rows))
    folds = prep.stratified_folds(train.select("sample_id", "y"), 5, 10)
    return shape(selection.tune_penalty(train, names, folds, GRID, 5, 10), ["c", "n_folds"], ["mean_auc", "sd_auc", "mean_accuracy", "mean_selected"])


@query("nested_cv", "M9 L1 L6")
def nested_cv(spark, sf):
    """Five outer and five inner folds, fifty times, three penalties; residuals on age, top quarter by variance."""
    rows, names = _raw_arrays(spark, sf, "age")
    metrics, _ = selection.nested_cv(rows, names, [0.1, 0.3, 1.0], 5, 5, 50)
    return shape(metrics, ["rep", "fold", "c", "n_selected"], ["auc", "average_precision"])


@query("selection_stability", "M10 G9")
def selection_stability(spark, sf):
    rows, names = _raw_arrays(spark, sf)
    coefs = selection.lasso_stability(_train(rows), names, RESAMPLES)
    return shape(rollup.selection_summary(coefs, RESAMPLES), ["feature", "n_selected", "n_positive", "n_negative"], ["frequency", "sign_consistency", "mean_coefficient", "mean_abs_coefficient"])


@query("fold_selection_ladder", "M10 G9 G10")
def fold_selection_ladder(spark, sf):
    """Five folds ten times."""
    rows, names = _raw_arrays(spark, sf)
    train = cut(_train(rows))
    folds = prep.stratified_folds(train.select("sample_id", "y"), 5, 10)
    summary = rollup.selection_summary(selection.fold_stability(train, folds, names, 5, 10), 50)
    return rollup.threshold_ladder(summary, [0.5, 0.6, 0.7, 0.8, 0.9, 0.95])


_SIGN = f"""it AS (SELECT batch_mixed, feature, corr(value, y) AS w FROM lab GROUP BY 1, 2), ch AS (SELECT * FROM it WHERE abs(w) > 0.1),
su AS (SELECT feature, count(*) AS n_selected, count(*) / 5e0 AS frequency, count(*) FILTER (w > 0) AS n_positive, count(*) FILTER (w < 0) AS n_negative,
 greatest(count(*) FILTER (w > 0), count(*) FILTER (w < 0)) * 1e0 / count(*) AS sign_consistency, avg(w) AS mean_coefficient, stddev_samp(w) AS sd_coefficient, avg(abs(w)) AS mean_abs_coefficient FROM ch GROUP BY 1)"""


def _selection(spark, sf):
    lab = views.labelled(spark, sf, ["y", "batch_mixed"])
    coefs = lab.groupBy("batch_mixed", "feature").agg(F.corr("value", "y").alias("coefficient"))
    return rollup.selection_summary(coefs, 5, eps=0.1)


@query("selection_summary", "G9", f"""{then('measure', 'sample')} {LABELLED}, {_SIGN} SELECT feature, n_selected, n_positive, n_negative, {r('frequency')} AS frequency, {r('sign_consistency')} AS sign_consistency,
 {r('mean_coefficient')} AS mean_coefficient, {r('sd_coefficient')} AS sd_coefficient, {r('mean_abs_coefficient')} AS mean_abs_coefficient FROM su""")
def selection_summary(spark, sf):
    return shape(_selection(spark, sf), ["feature", "n_selected", "n_positive", "n_negative"], ["frequency", "sign_consistency", "mean_coefficient", "sd_coefficient", "mean_abs_coefficient"])


@query("threshold_ladder", "G10", f"""{then('measure', 'sample')} {LABELLED}, {_SIGN} SELECT t AS threshold, count(*) FILTER (frequency >= t) AS n_features FROM su CROSS JOIN (SELECT unnest([0.2e0, 0.4e0, 0.6e0, 0.8e0]) AS t) GROUP BY 1""")
def threshold_ladder(spark, sf):
    return rollup.threshold_ladder(_selection(spark, sf), [0.2, 0.4, 0.6, 0.8])
