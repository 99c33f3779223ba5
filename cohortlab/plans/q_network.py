"""Edge, term and text rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.functions import tails
from cohortlab.operators import network, twogroup
from cohortlab.operators.evaluate import auc
from cohortlab.plans import views
from cohortlab.plans.q_stats import LABELLED, MOMENTS, _MWU, _POOLED
from cohortlab.plans.registry import query
from cohortlab.plans.sqltext import norm_p, r, shape
from cohortlab.plans.views import then

_SEED_SQL = """seeds AS (SELECT n_name AS seed FROM nation WHERE n_regionkey = 2),
dir AS (SELECT a AS source, b AS target, score FROM edge UNION ALL SELECT b, a, score FROM edge),
tch AS (SELECT seed, target AS neighbour, score FROM dir JOIN seeds ON source = seed WHERE score >= 0.4)"""


def _seeds(spark, sf):
    return views.table(spark, sf, "nation").filter(F.col("n_regionkey") == 2).select(F.col("n_name").alias("seed"))


def _touching(spark, sf):
    return network.seed_edges(views.edge(spark, sf), _seeds(spark, sf), 0.4)


@query("seed_edges", "N1 J10", f"""{then('edge')} {_SEED_SQL} SELECT seed, neighbour, {r('score')} AS score FROM tch""")
def seed_edges(spark, sf):
    return shape(_touching(spark, sf), ["seed", "neighbour"], ["score"])


@query("edges_among_seeds", "N1", f"""{then('edge')} {_SEED_SQL} SELECT a, b, {r('score')} AS score FROM edge WHERE a IN (SELECT seed FROM seeds) AND b IN (SELECT seed FROM seeds)""")
def edges_among(spark, sf):
    return shape(network.edges_among(views.edge(spark, sf), _seeds(spark, sf)), ["a", "b"], ["score"])


@query("neighbour_summary", "N2 G4", f"""{then('edge')} {_SEED_SQL} SELECT neighbour, count(DISTINCT seed) AS n_seeds, {r('avg(score)')} AS mean_score, {r('max(score)')} AS max_score FROM tch WHERE neighbour NOT IN (SELECT seed FROM seeds) GROUP BY 1 HAVING count(DISTINCT seed) >= 2""")
def neighbour_summary(spark, sf):
    s = network.neighbour_summary(_touching(spark, sf), _seeds(spark, sf)).filter(F.col("n_seeds") >= 2)
    return shape(s, ["neighbour", "n_seeds"], ["mean_score", "max_score"])


@query("seed_degree", "N3", f"""{then('edge')} {_SEED_SQL} SELECT s.seed, count(DISTINCT neighbour) AS degree FROM (SELECT seed FROM seeds UNION ALL SELECT 'ABSENT') s LEFT JOIN tch ON s.seed = tch.seed GROUP BY 1""")
def seed_degree(spark, sf):
    absent = spark.range(1).select(F.lit("ABSENT").alias("seed"))
    return network.seed_degree(_touching(spark, sf), _seeds(spark, sf).union(absent))


@query("common_neighbours", "N3", f"""{then('edge')} {_SEED_SQL.replace('score >= 0.4', 'score >= 0.1')} SELECT neighbour FROM tch WHERE seed IN ('NATION_2', 'NATION_7') GROUP BY 1 HAVING count(DISTINCT seed) = (SELECT count(*) FROM seeds WHERE seed IN ('NATION_2', 'NATION_7'))""")
def common_neighbours(spark, sf):
    pair = _seeds(spark, sf).filter(F.col("seed").isin("NATION_2", "NATION_7"))
    return network.common_neighbours(network.seed_edges(views.edge(spark, sf), pair, 0.1), pair.count())


@query("common_neighbours_full", "N3")
def common_neighbours_full(spark, sf):
    """Neighbours of every seed."""
    seeds = _seeds(spark, sf)
    return network.common_neighbours(network.seed_edges(views.edge(spark, sf), seeds, 0.1), seeds.count())


# terms tested by region: seed = region name, term = market segment, p from a balance difference
_TERMS = f"""mo AS (SELECT r_name AS seed, c_mktsegment AS term, count(*) FILTER (c_acctbal > 4500) AS n1, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
pv AS (SELECT *, {norm_p('(n1 - n / 2e0) / sqrt(n / 4e0)')} AS p FROM mo),
ik AS (SELECT *, count(*) OVER (PARTITION BY seed ORDER BY p) AS i, count(*) OVER (PARTITION BY seed) AS m FROM pv),
tm AS (SELECT seed, term, n1, n, p, least(1e0, min(p * m / i) OVER (PARTITION BY seed ORDER BY p DESC)) AS fdr FROM ik)"""


def _terms(spark, sf):
    c = views.table(spark, sf, "customer").join(views.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        views.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = c.groupBy(F.col("r_name").alias("seed"), F.col("c_mktsegment").alias("term")).agg(F.count_if(F.col("c_acctbal") > 4500).alias("n1"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("p", tails.norm_p((F.col("n1") - F.col("n") / 2.0) / F.sqrt(F.col("n") / 4.0)))
    return twogroup.adjust_fdr(g, family=["seed"])


@query("significant_terms", "N4 W5 T9", f"""WITH {_TERMS}, rk AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY fdr, term) AS rn FROM tm WHERE fdr < 0.9) SELECT seed, term, {r('p')} AS p, {r('fdr')} AS fdr FROM rk WHERE rn <= 3""")
def significant_terms(spark, sf):
    return shape(network.significant_terms(_terms(spark, sf), "seed", limit=0.9, top=3), ["seed", "term"], ["p", "fdr"])


@query("module_evidence", "N5 C3 G4", f"""WITH {_TERMS}, md AS (SELECT *, CASE WHEN contains(lower(term), 'auto') OR contains(lower(term), 'mach') THEN 'engineering' WHEN contains(lower(term), 'furn') OR contains(lower(term), 'house') THEN 'home' END AS module FROM tm)
SELECT seed, module, {r('min(fdr)')} AS best_fdr, count(*) AS evidence_count, arg_min(term, (fdr, term)) AS representative_term FROM md WHERE module IS NOT NULL GROUP BY 1, 2""")
def module_evidence(spark, sf):
    rules = [("engineering", ["auto", "mach"]), ("home", ["furn", "house"])]
    return shape(network.module_evidence(_terms(spark, sf), rules, "seed", "term", "fdr"), ["seed", "module", "evidence_count", "representative_term"], ["best_fdr"])


def _ora_sql() -> str:
    lc = lambda n, k: f"(lgamma({n} + 1e0) - lgamma({k} + 1e0) - lgamma({n} - {k} + 1e0))"
    mass = f"exp({lc('CAST(ts AS DOUBLE)', 'CAST(i AS DOUBLE)')} + {lc('CAST(pool - ts AS DOUBLE)', 'CAST(ss - i AS DOUBLE)')} - {lc('CAST(pool AS DOUBLE)', 'CAST(ss AS DOUBLE)')})"
    return f"""WITH m AS (SELECT DISTINCT p_name AS term, p_brand AS member FROM part),
w AS (SELECT p_brand AS member FROM part GROUP BY 1 HAVING avg(p_retailprice) > (SELECT avg(p_retailprice) FROM part)), h AS (SELECT DISTINCT member FROM m WHERE member IN (SELECT member FROM w)),
c AS (SELECT term, count(*) AS ts, count(*) FILTER (member IN (SELECT member FROM h)) AS k, (SELECT count(DISTINCT member) FROM m) AS pool, (SELECT count(*) FROM h) AS ss FROM m GROUP BY 1),
g AS (SELECT *, unnest(range(greatest(k, ss + ts - pool, 0), least(ts, ss) + 1)) AS i FROM c), p AS (SELECT term, least(1e0, sum({mass})) AS p FROM g GROUP BY 1)
SELECT c.term, ts AS term_size, k AS overlap, pool AS pool_size, ss AS set_size, {r('k * 1e0 * (pool - ss - ts + k) / nullif((ss - k) * (ts - k), 0)')} AS odds_ratio, {r('p')} AS p FROM c JOIN p ON c.term = p.term"""


@query("over_representation", "N6 P6", _ora_sql())
def over_representation(spark, sf):
    p = views.table(spark, sf, "part")
    mean = p.groupBy(F.col("p_brand").alias("member")).agg(F.avg("p_retailprice").alias("v")).withColumn("_a", p.agg(F.avg("p_retailprice")).scalar())
    membership = p.select(F.col("p_name").alias("term"), F.col("p_brand").alias("member"))
    o = network.over_representation(mean.filter(F.col("v") > F.col("_a")).select("member"), membership)
    return shape(o, ["term", "term_size", "overlap", "pool_size", "set_size"], ["odds_ratio", "p"])


def _united_sql() -> str:
    lc = lambda n, k: f"(lgamma({n} + 1e0) - lgamma({k} + 1e0) - lgamma({n} - {k} + 1e0))"
    mass = f"exp({lc('CAST(ts AS DOUBLE)', 'CAST(i AS DOUBLE)')} + {lc('CAST(pool - ts AS DOUBLE)', 'CAST(ss - i AS DOUBLE)')} - {lc('CAST(pool AS DOUBLE)', 'CAST(ss AS DOUBLE)')})"
    return f"""{then('edge')} {_SEED_SQL}, na AS (SELECT n_name AS member, c_mktsegment AS term, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
mb AS (SELECT DISTINCT term, member FROM na WHERE v > (SELECT avg(c_acctbal) FROM customer)), pl AS (SELECT DISTINCT member FROM mb),
qs AS (SELECT seed, neighbour AS member FROM tch UNION SELECT seed, seed FROM tch), sz AS (SELECT seed, count(*) AS ns, count(pl.member) AS ss FROM qs LEFT JOIN pl ON qs.member = pl.member GROUP BY 1),
c AS (SELECT seed, term, count(*) AS k FROM qs JOIN mb ON qs.member = mb.member GROUP BY 1, 2),
f AS (SELECT c.*, ns, ss, (SELECT count(*) FROM pl) AS pool, (SELECT count(*) FROM mb x WHERE x.term = c.term) AS ts FROM c JOIN sz ON c.seed = sz.seed),
g AS (SELECT *, unnest(range(greatest(k, ss + ts - pool, 0), least(ts, ss) + 1)) AS i FROM f), pv AS (SELECT seed, term, k, ns, ss, ts, pool, least(1e0, sum({mass})) AS p FROM g GROUP BY ALL),
ik AS (SELECT *, count(*) OVER (PARTITION BY seed ORDER BY p) AS i, count(*) OVER (PARTITION BY seed) AS m FROM (SELECT * REPLACE (round(p, 9) AS p) FROM pv)), tm AS (SELECT *, least(1e0, min(p * m / i) OVER (PARTITION BY seed ORDER BY p DESC)) AS fdr FROM ik)
SELECT seed, term, ns AS neighbourhood_size, ss AS set_size, ts AS term_size, pool AS pool_size, k AS overlap, {r('p')} AS p, {r('fdr')} AS fdr, fdr < 0.05 AS significant FROM tm"""


@query("neighbourhood_terms", "N4 N6 T9", _united_sql())
def neighbourhood_terms(spark, sf):
    """Terms (market segments) over-represented among each seed's neighbours; a nation belongs to a segment where its balance is above the mean."""
    c, n = views.table(spark, sf, "customer"), views.table(spark, sf, "nation")
    balance = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("member"), F.col("c_mktsegment").alias("term")).agg(F.avg("c_acctbal").alias("v"))
    membership = balance.withColumn("_m", c.agg(F.avg("c_acctbal")).scalar()).filter("v > _m").select("term", "member")
    out = network.neighbourhood_terms(_touching(spark, sf), membership)
    return shape(out, ["seed", "term", "neighbourhood_size", "set_size", "term_size", "pool_size", "overlap", "significant"], ["p", "fdr"])


PATTERNS = {"email": r"[a-z0-9._]+@[a-z0-9.]+", "number_run": r"[0-9]{4,}", "licence": r"(?i)licen[cs]e"}


@query("pattern_lines", "N7", "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) "
       + " UNION ALL ".join(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, '{n}' AS pattern FROM l WHERE regexp_matches(line, '{rx}')" for n, rx in PATTERNS.items()))
def pattern_lines(spark, sf):
    return network.pattern_lines(views.table(spark, sf, "documents"), PATTERNS, "doc_id")


@query("pattern_counts", "N7 G2", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), h AS ("
       + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS pattern FROM l WHERE regexp_matches(line, '{rx}')" for n, rx in PATTERNS.items())
       + ") SELECT pattern, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM h GROUP BY 1")
def pattern_counts(spark, sf):
    hits = network.pattern_lines(views.table(spark, sf, "documents"), PATTERNS, "doc_id")
    return hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


STEPS = [(r"\b[0-9]+\b", "N"), (r"(N )+N", "N"), (r"[ ]{2,}", " ")]
_REPLACED = "regexp_replace(regexp_replace(regexp_replace(text, '\\b[0-9]+\\b', 'N', 'g'), '(N )+N', 'N', 'g'), '[ ]{2,}', ' ', 'g')"


@query("ordered_replacement", "N8", f"WITH x AS (SELECT doc_id, text, {_REPLACED} AS t2 FROM documents) SELECT doc_id, md5(t2) AS digest, t2 <> text AS changed FROM x")
def ordered_replacement(spark, sf):
    d = network.replace_in_order(views.table(spark, sf, "documents").select("doc_id", "text"), STEPS)
    return d.select("doc_id", F.md5(F.col("new_text").cast("binary")).alias("digest"), "changed")


@query("changed_lines", "N8", f"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS a, string_split({_REPLACED}, chr(10)) AS b FROM documents),
z AS (SELECT doc_id, generate_subscripts(a, 1) AS line_no, unnest(a) AS old_line, unnest(b) AS new_line FROM x) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, old_line, new_line FROM z WHERE old_line <> new_line""")
def changed_lines(spark, sf):
    d = network.replace_in_order(views.table(spark, sf, "documents").select("doc_id", "text"), STEPS)
    return network.changed_lines(d, "doc_id", "text", "new_text")


@query("claim_verdicts", "N9 C18", f"""{then('measure', 'sample')} {LABELLED}, {MOMENTS}, {_MWU},
j AS (SELECT mom.feature, auc, (m1 - m0) / sqrt(pl) AS d FROM (SELECT *, {_POOLED} AS pl FROM mom) mom JOIN mwu ON mom.feature = mwu.feature)
SELECT feature, {r('auc')} AS auc, {r('d')} AS d, CASE WHEN abs(d) >= 0.2 AND abs(auc - 0.5) >= 0.05 THEN 'SUPPORTED' WHEN abs(d) >= 0.1 THEN 'ATTENUATE' ELSE 'NOT SUPPORTED' END AS verdict FROM j""")
def claim_verdicts(spark, sf):
    lab = views.labelled(spark, sf)
    d = twogroup.effect_sizes(lab, ["feature"]).select("feature", F.col("d_pooled").alias("d"))
    m = d.join(auc(lab, ["feature"], "value").select("feature", "auc"), "feature")
    rules = [("abs(d) >= 0.2 AND abs(auc - 0.5) >= 0.05", "SUPPORTED"), ("abs(d) >= 0.1", "ATTENUATE")]
    return shape(network.claim_table(m, rules), ["feature", "verdict"], ["auc", "d"])
