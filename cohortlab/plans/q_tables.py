"""Curation, reshaping, joins, key audits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.functions import scalars as sc
from cohortlab.operators import tables
from cohortlab.operators.running import row_numbers
from cohortlab.plans import views
from cohortlab.plans.q_stats import LABELLED
from cohortlab.plans.registry import query
from cohortlab.plans.sqltext import r, shape
from cohortlab.plans.views import then, with_views


# ---- scalar functions ----------------------------------------------------

@query("clean_sample_ids", "C1 C10 C11 C12", """WITH raw AS (SELECT doc_id, 'S' || CAST(doc_id AS VARCHAR) || CASE WHEN lang = 'en' THEN '.CEL.gz' WHEN lang = 'fr' THEN '.cel' ELSE '_' || source || '_' || lang END AS raw_id FROM documents)
SELECT doc_id, trim(regexp_replace(split_part(raw_id, '_', 1), '(?i)\\.cel(\\.gz)?$', '')) AS sample_id, CAST(nullif(regexp_extract(trim(regexp_replace(split_part(raw_id, '_', 1), '(?i)\\.cel(\\.gz)?$', '')), '(\\d+)$', 1), '') AS BIGINT) AS number,
 CASE WHEN CAST(nullif(regexp_extract(trim(regexp_replace(split_part(raw_id, '_', 1), '(?i)\\.cel(\\.gz)?$', '')), '(\\d+)$', 1), '') AS BIGINT) < 500 THEN 'early' ELSE 'late' END AS block,
 concat_ws('_', raw_id, CAST(doc_id AS VARCHAR)) AS composite, CASE WHEN length(raw_id) - length(replace(raw_id, '_', '')) < 2 THEN raw_id ELSE split_part(raw_id, '_', -2) || '_' || split_part(raw_id, '_', -1) END AS library FROM raw""")
def clean_sample_ids(spark, sf):
    suffix = F.when(F.col("lang") == "en", ".CEL.gz").when(F.col("lang") == "fr", ".cel").otherwise(F.concat(F.lit("_"), "source", F.lit("_"), "lang"))
    d = views.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("S"), F.col("doc_id").cast("string"), suffix).alias("raw_id"))
    d = d.withColumn("sample_id", sc.clean_sample_id("raw_id"))
    return d.select("doc_id", "sample_id", sc.id_number("sample_id").alias("number"), sc.id_block("sample_id", 500, "early", "late").alias("block"),
                    sc.composite_key("raw_id", "doc_id").alias("composite"), sc.last_tokens("raw_id").alias("library"))


@query("extract_fields", "C2 C16", """SELECT page_id, coalesce(nullif(regexp_extract(url, '/(\\d+)\\?', 1), ''), nullif(regexp_extract(url, '/(\\d+)', 1), '')) AS number,
 lower(nullif(regexp_extract(url, '/([a-zA-Z]{2})/', 1), '')) AS lang, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') AS html_lang FROM pages WHERE regexp_matches(url, '^https?://') AND html IS NOT NULL""")
def extract_fields(spark, sf):
    p = views.table(spark, sf, "pages").filter(F.col("url").rlike("^https?://") & F.col("html").isNotNull())
    return p.select("page_id", sc.first_match("url", [r"/(\d+)\?", r"/(\d+)"]).alias("number"), F.lower(sc.first_match("url", ["/([a-zA-Z]{2})/"])).alias("lang"),
                    sc.first_match("html", ['lang="([a-z]+)"']).alias("html_lang"))


@query("keyword_category", "C3", """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') THEN 'fastener' WHEN contains(lower(p_name), 'widget') THEN 'widget' END AS category FROM part""")
def keyword_category(spark, sf):
    rules = [("fastener", ["ring", "bolt"]), ("widget", ["widget"])]
    return views.table(spark, sf, "part").select("p_partkey", sc.keyword_category("p_name", rules).alias("category"))


@query("map_labels", "C4", """SELECT o_orderpriority, o_orderstatus, CASE lower(trim(o_orderstatus)) WHEN 'f' THEN 0 WHEN 'p' THEN 1 WHEN 'o' THEN 2 END AS stage,
 coalesce(CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 1 WHEN '2-high' THEN 1 WHEN '5-low' THEN 0 END, -1) AS urgent, count(*) AS n FROM orders GROUP BY ALL""")
def map_labels(spark, sf):
    o = views.table(spark, sf, "orders").select(
        "o_orderpriority", "o_orderstatus", sc.map_label("o_orderstatus", {"F": 0, "P": 1, "O": 2}, strict=True).alias("stage"),
        F.coalesce(sc.map_label("o_orderpriority", {"1-URGENT": 1, "2-HIGH": 1, "5-LOW": 0}), F.lit(-1)).alias("urgent"))
    return o.groupBy(*o.columns).agg(F.count(F.lit(1)).alias("n"))


@query("parse_covariates", "C5 C6 C7", """WITH t AS (SELECT event_id, event_type, 'status: ' || upper(event_type) AS status, 'age: ' || json_extract_string(props, '$.k') || CASE WHEN event_type = 'click' THEN ' days' ELSE ' years' END AS age_text,
 CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'click' THEN 'inf' ELSE CAST(value AS VARCHAR) END AS number_text FROM events)
SELECT event_id, lower(trim(regexp_replace(trim(status), '(?i)^status:', ''))) AS status, CAST(nullif(regexp_extract(age_text, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS number,
 round(CASE WHEN contains(lower(age_text), 'day') THEN CAST(nullif(regexp_extract(age_text, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) / 365.25e0 ELSE CAST(nullif(regexp_extract(age_text, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) END, 6) AS years,
 CASE WHEN isfinite(TRY_CAST(number_text AS DOUBLE)) THEN TRY_CAST(number_text AS DOUBLE) END AS number_clean FROM t""")
def parse_covariates(spark, sf):
    e = views.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("status: "), F.upper("event_type")).alias("status"),
        F.concat(F.lit("age: "), F.get_json_object("props", "$.k"), F.when(F.col("event_type") == "click", " days").otherwise(" years")).alias("age_text"),
        F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "click", "inf").otherwise(F.col("value").cast("string")).alias("number_text"))
    return e.select("event_id", sc.strip_prefix("status", "status:").alias("status"), sc.number_in("age_text").alias("number"),
                    F.round(sc.years_from_text("age_text"), 6).alias("years"), sc.to_number("number_text").alias("number_clean"))


@query("parse_stamps", "C13", """WITH t AS (SELECT event_id, strftime(ts, '%m/%d/%y %H:%M:%S') AS stamp FROM events)
SELECT event_id, strftime(strptime(stamp, '%m/%d/%y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS at, CAST(CAST(strptime(stamp, '%m/%d/%y %H:%M:%S') AS DATE) AS VARCHAR) AS day, CAST(year(strptime(stamp, '%m/%d/%y %H:%M:%S')) AS INTEGER) AS year FROM t""")
def parse_stamps(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", F.date_format("ts", "MM/dd/yy HH:mm:ss").alias("stamp"))
    e = e.select("event_id", sc.parse_stamp("stamp").alias("at"))
    return e.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.to_date("at").cast("string").alias("day"), F.year("at").alias("year"))


@query("bounded_transforms", "C20", f"""WITH {views.SQL['doc']}, p AS (SELECT doc_id, 1e0 / (1e0 + exp(-(ln(chars) - 6e0))) AS p FROM doc)
SELECT doc_id, {r('greatest(0.05e0, least(0.95e0, p))')} AS clipped, {r('ln(greatest(1e-6, least(1 - 1e-6, p)) / (1e0 - greatest(1e-6, least(1 - 1e-6, p))))')} AS logit, {r('exp(p)')} AS odds FROM p""")
def bounded_transforms(spark, sf):
    d = views.doc(spark, sf).select("doc_id", sc.expit(F.ln("chars") - 6.0).alias("p"))
    return d.select("doc_id", sc.rounded(sc.clip("p", 0.05, 0.95)).alias("clipped"), sc.rounded(sc.logit("p")).alias("logit"), sc.rounded(F.exp("p")).alias("odds"))


@query("impute_median", "C8", f"""{then('measure', 'sample')} x AS (SELECT sample_id, feature, CASE WHEN value < -0.2 OR feature = 'f05' THEN NULL ELSE value END AS value FROM measure),
md AS (SELECT feature, median(value) AS md FROM x GROUP BY 1 HAVING count(value) > 0)
SELECT x.feature, x.sample_id, {r('coalesce(value, md)')} AS value FROM x JOIN md ON x.feature = md.feature""")
def impute_median(spark, sf):
    m = views.measure(spark, sf)
    gap = m.withColumn("value", F.when((F.col("value") < -0.2) | (F.col("feature") == "f05"), None).otherwise(F.col("value")))
    return shape(tables.impute_median(gap), ["feature", "sample_id"], ["value"])


@query("conditional_log2", "C15", f"""SELECT p_partkey, {r('CASE WHEN (SELECT max(p_retailprice) FROM part) > 50 THEN log2(p_retailprice + 1e0) ELSE p_retailprice END')} AS value FROM part""")
def conditional_log2(spark, sf):
    p = views.table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("value"))
    return shape(tables.log2_if_large(p), ["p_partkey"], ["value"])


@query("column_roles", "C14", f"""WITH s AS (SELECT avg(CASE WHEN starts_with(c_name, 'Customer#') THEN 1e0 ELSE 0e0 END) AS a, avg(CASE WHEN starts_with(c_mktsegment, 'Customer#') THEN 1e0 ELSE 0e0 END) AS b FROM customer)
SELECT 'c_name' AS column_name, {r('a')} AS id_share, false AS looks_like_outcome FROM s UNION ALL SELECT 'c_mktsegment', {r('b')}, true FROM s""")
def column_roles(spark, sf):
    roles = tables.string_roles(views.table(spark, sf, "customer"), "Customer#", "segment|diagnosis|status")
    return shape(roles, ["column_name", "looks_like_outcome"], ["id_share"])


# ---- reshape -------------------------------------------------------------

@query("pivot_effects", "P1 P2", f"""{then('effect')} w AS (SELECT feature, max(d) FILTER (dataset = 'AUTOMOBILE') AS automobile, max(d) FILTER (dataset = 'BUILDING') AS building,
 max(d) FILTER (dataset = 'FURNITURE') AS furniture, max(d) FILTER (dataset = 'HOUSEHOLD') AS household, max(d) FILTER (dataset = 'MACHINERY') AS machinery FROM effect GROUP BY 1)
SELECT feature, {', '.join(f'{r(c)} AS {c}' for c in ('automobile', 'building', 'furniture', 'household', 'machinery'))} FROM w""")
def pivot_effects(spark, sf):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    w = tables.pivot_wide(views.effect(spark, sf), "feature", "dataset", "d", names)
    return w.select("feature", *[sc.rounded(n).alias(n.lower()) for n in names])


@query("crosstab", "P3", f"""WITH {views.SQL['doc']} SELECT source, count(*) FILTER (y = 0) AS y_0, count(*) FILTER (y = 1) AS y_1 FROM doc GROUP BY 1""")
def crosstab(spark, sf):
    return tables.crosstab(views.doc(spark, sf), "source", "y", [0, 1])


@query("one_hot", "P4", """SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS event_type_error, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS event_type_purchase, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS event_type_signup,
 CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS event_type_view FROM events""")
def one_hot(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", "event_type")
    return tables.one_hot(e, "event_type", ["click", "error", "purchase", "signup", "view"]).drop("event_type")


@query("explode_members", "P6", """WITH c AS (SELECT p_type AS term, string_agg(DISTINCT p_brand, ', ') AS members, CAST(count(DISTINCT p_brand) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS overlap FROM part GROUP BY 1)
SELECT term, trim(unnest(string_split(members, ','))) AS member, CAST(split_part(overlap, '/', 1) AS BIGINT) AS k, CAST(split_part(overlap, '/', 2) AS BIGINT) AS n FROM c""")
def explode_members(spark, sf):
    p = views.table(spark, sf, "part")
    c = tables.joined_values(p, ["p_type"], "p_brand", "members", sep=", ").join(
        p.groupBy("p_type").agg(F.concat_ws("/", F.count_distinct("p_brand").cast("string"), F.count(F.lit(1)).cast("string")).alias("overlap")), "p_type")
    k, n = tables.split_fraction("overlap")
    return tables.explode_list(c.withColumn("k", k).withColumn("n", n), "members", "member").select(F.col("p_type").alias("term"), "member", "k", "n")


# ---- joins and sets ------------------------------------------------------

@query("align_samples", "J1", f"""{then('measure', 'sample')} {LABELLED} SELECT y, feature, count(*) AS n, {r('sum(value)', 5)} AS total FROM lab GROUP BY 1, 2""")
def align_samples(spark, sf):
    j = tables.align(views.measure(spark, sf), views.sample(spark, sf).select("sample_id", "y"))
    return shape(j.groupBy("y", "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), ["y", "feature", "n"], ["total"], 5)


@query("unmatched_ids", "J2", """SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def unmatched_ids(spark, sf):
    return tables.unmatched(views.table(spark, sf, "documents"), views.table(spark, sf, "labels"), "doc_id")


@query("keep_wanted", "J3", f"""WITH w AS (SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part))
SELECT l_returnflag, count(*) AS n, {r('sum(l_quantity)', 3)} AS quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM w) GROUP BY 1""")
def keep_wanted(spark, sf):
    p = views.table(spark, sf, "part").select("p_partkey", "p_retailprice")
    wanted = p.withColumn("_a", p.agg(F.avg("p_retailprice")).scalar()).filter(F.col("p_retailprice") > F.col("_a")).select(F.col("p_partkey").alias("l_partkey"))
    kept = tables.keep_keys(views.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_quantity"), wanted, "l_partkey")
    return shape(kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")), ["l_returnflag", "n"], ["quantity"], 3)


@query("evidence_merge", "J5", f"""WITH b AS (SELECT DISTINCT p_brand FROM part), a AS (SELECT p_brand, count(*) AS n_parts FROM part GROUP BY 1),
q AS (SELECT p_brand, avg(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1), s AS (SELECT p_brand, max(p_size) AS size FROM part WHERE p_type = 'ECONOMY' GROUP BY 1)
SELECT b.p_brand, n_parts, {r('q')} AS returned_quantity, size FROM b LEFT JOIN a ON b.p_brand = a.p_brand LEFT JOIN q ON b.p_brand = q.p_brand LEFT JOIN s ON b.p_brand = s.p_brand""")
def evidence_merge(spark, sf):
    p = views.table(spark, sf, "part")
    li = views.table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").groupBy("l_partkey").agg(F.sum("l_quantity").alias("s"), F.count(F.lit(1)).alias("c"))
    q = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg((F.sum("s") / F.sum("c")).alias("returned_quantity"))
    parts = [p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts")), q, p.filter(F.col("p_type") == "ECONOMY").groupBy("p_brand").agg(F.max("p_size").alias("size"))]
    return shape(tables.merge_left(p.select("p_brand").distinct(), parts, "p_brand"), ["p_brand", "n_parts", "size"], ["returned_quantity"])


@query("common_features", "J8 S2", """WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'N')
SELECT l_partkey AS feature FROM a INTERSECT SELECT l_partkey FROM b INTERSECT SELECT l_partkey FROM c""")
def common_features(spark, sf):
    li = views.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature"), "l_returnflag")
    return tables.common_features([li.filter(F.col("l_returnflag") == f).select("feature") for f in "ARN"])


@query("set_subtract", "S2", """SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def set_subtract(spark, sf):
    o = views.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return views.table(spark, sf, "customer").select("c_custkey").subtract(o)


@query("stacked_cohorts", "S1 W6", """WITH u AS (SELECT 'customer' AS dataset, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier)
SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY balance, id) - 1 AS row_id FROM u""")
def stacked_cohorts(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    u = tables.stack_cohorts({"customer": c, "supplier": s}, ["id"]).withColumn("_o", F.struct("balance", "id"))
    return row_numbers(u, ["dataset"], "_o", "row_id").select("dataset", "id", "balance", "segment", "row_id")


@query("date_stacking", "W6 C13", """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS level FROM events""")
def date_stacking(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", F.to_date("ts").cast("string").alias("day"), F.struct("ts", "event_id").alias("_o"))
    return row_numbers(e, ["day"], "_o", "level").select("event_id", "day", "level")


@query("deduplicate", "S4 G11", """WITH d AS (SELECT DISTINCT user_id, event_type FROM events) SELECT event_type, count(*) AS n_users FROM d GROUP BY 1""")
def deduplicate(spark, sf):
    return views.table(spark, sf, "events").select("user_id", "event_type").dropDuplicates().groupBy("event_type").agg(F.count(F.lit(1)).alias("n_users"))


@query("field_value_difference", "S3 Q5", f"""WITH {views.SQL['doc']}, x AS (SELECT y, 'source' AS field, coalesce(source, 'MISSING') AS value FROM doc UNION ALL SELECT y, 'lang', coalesce(lang, 'MISSING') FROM doc UNION ALL SELECT y, 'toxic', coalesce(CAST(toxic AS VARCHAR), 'MISSING') FROM doc),
s AS (SELECT field, value, max(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS b FROM x GROUP BY 1, 2)
SELECT field, CAST(sum(a) AS BIGINT) AS n_values_a, CAST(sum(b) AS BIGINT) AS n_values_b, CAST(sum(a * b) AS BIGINT) AS n_shared, min(a * b) = 0 AS differs FROM s GROUP BY 1""")
def field_value_difference(spark, sf):
    return tables.set_difference(views.doc(spark, sf), "y", (0, 1), ["source", "lang", "toxic"])


# ---- counts --------------------------------------------------------------

@query("value_counts", "G2 W5 C9", """SELECT coalesce(source, 'MISSING') AS source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10""")
def value_counts(spark, sf):
    d = views.table(spark, sf, "documents").select(sc.or_missing("source").alias("source"))
    return tables.value_counts(d, "source", 10)


@query("field_sizes", "G3 C9", """WITH j AS (SELECT source, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT source, 'lang' AS field, coalesce(lang, 'MISSING') AS value, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT source, 'quality', coalesce(CAST(quality AS VARCHAR), 'MISSING'), count(*) FROM j GROUP BY ALL
UNION ALL SELECT source, 'toxic', coalesce(CAST(toxic AS VARCHAR), 'MISSING'), count(*) FROM j GROUP BY ALL""")
def field_sizes(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", "source", "lang")
    j = d.join(views.table(spark, sf, "labels"), "doc_id", "left")
    return tables.field_sizes(j, "source", ["lang", "quality", "toxic"])


@query("group_extremes", "G4", f"""WITH e AS (SELECT event_type, count(DISTINCT user_id) AS n_users, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY 1),
f AS (SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn FROM events) WHERE rn = 1)
SELECT e.event_type, n_users, lo AS min_value, hi AS max_value, n, event_id AS first_event FROM e JOIN f ON e.event_type = f.event_type""")
def group_extremes(spark, sf):
    return views.table(spark, sf, "events").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("n_users"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("n"),
        F.min(F.struct("value", "event_id"))["event_id"].alias("first_event"))


@query("joined_values", "G5", """SELECT p_type, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS brands FROM part GROUP BY 1""")
def joined_values(spark, sf):
    return tables.joined_values(views.table(spark, sf, "part"), ["p_type"], "p_brand", "brands")


@query("mean_collapse", "G6", f"""SELECT l_partkey, l_suppkey, {r('avg(l_extendedprice)')} AS value FROM lineitem GROUP BY 1, 2""")
def mean_collapse(spark, sf):
    li = views.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("value"))
    return shape(tables.mean_collapse(li, ["l_partkey", "l_suppkey"]), ["l_partkey", "l_suppkey"], ["value"])


@query("subject_profile", "G11 Q11", f"""{with_views('sample')} SELECT subject, count(*) AS n_samples, count(DISTINCT batch_mixed) AS n_regions, count(DISTINCT y) AS n_classes, count(DISTINCT y) > 1 AS contradicted, count(DISTINCT batch_mixed) > 2 AS too_many_regions FROM sample GROUP BY 1""")
def subject_profile(spark, sf):
    return tables.subject_profile(views.sample(spark, sf), "subject", "batch_mixed", "y", 2)


@query("region_subjects", "G11", """WITH d AS (SELECT DISTINCT n_regionkey, c_mktsegment, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT n_regionkey, c_mktsegment, count(*) AS n FROM d GROUP BY 1, 2)
SELECT n, count(*) AS n_groups FROM s GROUP BY 1""")
def region_subjects(spark, sf):
    c = views.table(spark, sf, "customer").join(views.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    d = c.select("n_regionkey", "c_mktsegment", "c_nationkey").dropDuplicates()
    s = d.groupBy("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("n").agg(F.count(F.lit(1)).alias("n_groups"))


@query("missing_counts", "G12 J4", """WITH j AS (SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'doc_id' AS column_name, count(*) FILTER (doc_id IS NULL) AS n_missing FROM j UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM j UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM j UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM j""")
def missing_counts(spark, sf):
    j = views.table(spark, sf, "documents").select("doc_id", "lang").join(views.table(spark, sf, "labels"), "doc_id", "left")
    return tables.missing_counts(j, ["doc_id", "lang", "quality", "toxic"])


@query("complete_rows", "C16", """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('F', 'O') AND regexp_matches(o_orderpriority, '^[1-3]-') AND o_custkey IS NOT NULL GROUP BY 1""")
def complete_rows(spark, sf):
    o = views.table(spark, sf, "orders").filter(F.col("o_totalprice").between(1000, 200000) & F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").rlike("^[1-3]-"))
    return tables.drop_incomplete(o, ["o_custkey"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("top_per_group", "W5", f"""WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) SELECT p_brand, p_partkey, {r('p_retailprice', 2)} AS p_retailprice FROM r WHERE rn <= 3""")
def top_per_group(spark, sf):
    p = views.table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return shape(tables.top_per_group(p, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3), ["p_brand", "p_partkey"], ["p_retailprice"], 2)
