"""Readers over text files that Spark derives from the shared tables, sinks, and table catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortlab.plans import views
from cohortlab.plans.registry import query
from cohortlab.plans.sqltext import r, shape
from cohortlab.plans.views import with_views
from cohortlab.session import scratch_path
from cohortlab.sources import catalogue, text

FLAGS = ["A", "N", "R"]
NATIONS = [f"NATION_{i}" for i in range(25)]


def _written(spark, df, name, **options) -> str:
    path = scratch_path(spark, name)
    df.write.options(**options).text(path)
    return path


@query("read_table", "A1 A7", f"""SELECT p_partkey, p_name, p_brand, p_size, {r('p_retailprice', 4)} AS p_retailprice FROM part""")
def read_table(spark, sf):
    path = scratch_path(spark, "part")
    part = views.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    part.write.csv(path, header=True, sep="\t", compression="gzip")
    back = text.read_table(spark, path, part.schema, sep="\t", partitions=8)
    return shape(back, ["p_partkey", "p_name", "p_brand", "p_size"], ["p_retailprice"], 4)


_FLAG_SQL = f"""WITH s AS (SELECT p_partkey, f, sum(l_quantity) FILTER (l_returnflag = f) AS v FROM part CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS f) LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT 'p' || CAST(p_partkey AS VARCHAR) AS feature, f AS sample_id, {r('v', 3)} AS value FROM s"""


def _flag_matrix(spark, sf):
    """One line per part, one column per return flag; a missing cell is the text NA."""
    li = views.table(spark, sf, "lineitem").groupBy("l_partkey").agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f) for f in FLAGS])
    wide = views.table(spark, sf, "part").select("p_partkey").join(li, F.col("p_partkey") == F.col("l_partkey"), "left")
    cells = [F.coalesce(F.col(f).cast("string"), F.lit("NA")) for f in FLAGS]
    body = wide.select(F.concat_ws(",", F.concat(F.lit("p"), F.col("p_partkey").cast("string")), *cells).alias("value"))
    return spark.range(1).select(F.lit(',"A","N","R"').alias("value")).union(body)


@query("read_matrix_features", "A2 C7", _FLAG_SQL)
def read_matrix_features(spark, sf):
    long = text.read_matrix_long(spark, _written(spark, _flag_matrix(spark, sf), "flags"))
    return shape(long, ["sample_id", "feature"], ["value"], 3)


@query("read_matrix_samples", "A2 P1", f"{with_views('measure')} SELECT CAST(sample_id AS VARCHAR) AS sample_id, feature, {r('value')} AS value FROM measure")
def read_matrix_samples(spark, sf):
    e = views.table(spark, sf, "embeddings")
    body = e.select(F.concat_ws(",", F.col("vec_id").cast("string"), F.transform("embedding", lambda v: v.cast("double").cast("string"))).alias("value"))
    header = e.limit(1).select(F.concat_ws(",", F.lit("id"), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.format_string("f%02d", i))).alias("value"))
    long = text.read_matrix_long(spark, _written(spark, header.union(body), "vectors"), "samples_in_rows", header_key="id")
    return shape(long, ["sample_id", "feature"], ["value"])


@query("wide_to_long", "A2 P5", f"""SELECT p_partkey, 'p_size' AS feature, {r('CAST(p_size AS DOUBLE)')} AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', {r('p_retailprice')} FROM part UNION ALL SELECT p_partkey, 'p_type', NULL FROM part""")
def wide_to_long(spark, sf):
    return shape(text.widen_to_long(views.table(spark, sf, "part"), ["p_partkey"], ["p_size", "p_retailprice", "p_type"]), ["p_partkey", "feature"], ["value"])


def _blocks(spark, sf) -> str:
    d = views.table(spark, sf, "documents").select(
        F.concat(F.lit("^SAMPLE = D"), F.col("doc_id").cast("string"), F.lit("\n!Sample_title = doc = "), F.col("source"), F.lit(" | "), F.col("lang"),
                 F.lit("\n!Sample_char = lang: "), F.col("lang"), F.lit("\n!Sample_char = source: "), F.col("source"), F.lit("\n!Other_key = skip\n")).alias("value"))
    return _written(spark, d, "blocks", lineSep="\n")


_BLOCK_BASE = "SELECT 'D' || CAST(doc_id AS VARCHAR) AS sample_id, 'title' AS key, 'doc = ' || source || ' | ' || lang AS value FROM documents UNION ALL SELECT 'D' || CAST(doc_id AS VARCHAR), 'char', {v} FROM documents"


@query("read_blocks_join", "A3", _BLOCK_BASE.format(v="'lang: ' || lang || ' | source: ' || source"))
def read_blocks_join(spark, sf):
    return text.read_blocks(spark, _blocks(spark, sf), repeat="join")


@query("read_blocks_last", "A3", _BLOCK_BASE.format(v="'source: ' || source"))
def read_blocks_last(spark, sf):
    return text.read_blocks(spark, _blocks(spark, sf), repeat="last")


@query("read_blocks_list", "A3", """SELECT 'D' || CAST(doc_id AS VARCHAR) AS sample_id, 'title' AS key, 0 AS pos, 'doc = ' || source || ' | ' || lang AS value FROM documents
UNION ALL SELECT 'D' || CAST(doc_id AS VARCHAR), 'char', 0, 'lang: ' || lang FROM documents UNION ALL SELECT 'D' || CAST(doc_id AS VARCHAR), 'char', 1, 'source: ' || source FROM documents""")
def read_blocks_list(spark, sf):
    return text.read_blocks(spark, _blocks(spark, sf), repeat="list")


def _series(spark, sf) -> str:
    """Header rows over the nations as samples, then a table of parts by supplier nation."""
    n = views.table(spark, sf, "nation")
    cells = lambda c: F.concat_ws("\t", F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", c.alias("v")))), lambda s: F.concat(F.lit('"'), s["v"], F.lit('"'))))
    head = n.agg(*[cells(c).alias(k) for k, c in (
        ("title", F.col("n_name")), ("region", F.concat(F.lit("region: "), F.col("n_regionkey").cast("string"))), ("number", F.concat(F.lit("number: "), F.col("n_nationkey").cast("string"))))])
    rows = head.select(F.explode(F.array(
        F.concat(F.lit("!Sample_title\t"), "title"), F.concat(F.lit("!Sample_characteristics_ch1\t"), "region"), F.concat(F.lit("!Sample_characteristics_ch1\t"), "number"),
        F.lit("!Series_note\tnone"), F.lit("!series_matrix_table_begin"), F.concat(F.lit('"ID_REF"\t'), "title"), F.lit("!series_matrix_table_end"))).alias("value"))
    s = views.table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    li = views.table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").pivot("n_name", NATIONS).agg(F.sum("l_quantity"))
    body = li.select(F.concat_ws("\t", F.concat(F.lit('"p'), F.col("l_partkey").cast("string"), F.lit('"')), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in NATIONS]).alias("value"))
    return _written(spark, rows.union(body), "series")


@query("read_header_rows", "A4", "SELECT n_nationkey AS pos, n_name AS title, 'region: ' || CAST(n_regionkey AS VARCHAR) AS region, 'number: ' || CAST(n_nationkey AS VARCHAR) AS number FROM nation")
def read_header_rows(spark, sf):
    long = text.read_header_rows(spark, _series(spark, sf), content={"region": "region:", "number": "number:"})
    return text.header_table(long, ["title", "region", "number"])


_BLOCK_SQL = f"""WITH q AS (SELECT l_partkey, n_name, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT k.n_name AS sample_id, 'p' || CAST(k.l_partkey AS VARCHAR) AS feature, {r('v', 3)} AS value FROM (SELECT l_partkey, n_name FROM (SELECT DISTINCT l_partkey FROM lineitem) CROSS JOIN nation) k LEFT JOIN q ON k.l_partkey = q.l_partkey AND k.n_name = q.n_name"""


@query("read_table_block", "A5", _BLOCK_SQL)
def read_table_block(spark, sf):
    return shape(text.read_table_block(spark, _series(spark, sf)), ["sample_id", "feature"], ["value"], 3)


@query("read_wanted_rows", "A5 A6", f"""SELECT l_returnflag AS sample_id, p_type AS feature, {r('sum(l_quantity)', 3)} AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY 1, 2""")
def read_wanted_rows(spark, sf):
    """Wanted keys are the feature: other lines are dropped before they are split."""
    li = views.table(spark, sf, "lineitem").join(views.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    wide = li.groupBy("p_type").agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f) for f in FLAGS])
    body = wide.select(F.concat_ws(",", "p_type", *[F.col(f).cast("string") for f in FLAGS]).alias("value"))
    lines = spark.range(1).select(F.lit(',"A","N","R"').alias("value")).union(body)
    long = text.read_matrix_long(spark, _written(spark, lines, "types"), keys=["ECONOMY", "PROMO", "ABSENT"])
    return shape(long, ["sample_id", "feature"], ["value"], 3)


@query("written_tables", "A7", f"""WITH {views.SQL['effect']} SELECT f AS fmt, dataset, feature, n1, n0, {r('d')} AS d FROM effect CROSS JOIN (SELECT unnest(['csv', 'json', 'parquet']) AS f)""")
def written_tables(spark, sf):
    e = views.effect(spark, sf)
    parts = []
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(spark, fmt)
        text.write_table(e, path, fmt)
        reader = spark.read.schema(e.schema)
        back = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
        parts.append(back.withColumn("fmt", F.lit(fmt)))
    return shape(reduce(lambda a, b: a.unionByName(b), parts), ["fmt", "dataset", "feature", "n1", "n0"], ["d"])


ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
WANTED = ("text", "lang", "quality")
# fixed values: column count, wanted columns, outcome-like columns and role of every shared table
_PROFILE = {
    "region": (2, "", "", "OTHER"), "nation": (3, "", "", "OTHER"), "customer": (5, "", "", "OTHER"), "supplier": (4, "", "", "OTHER"), "part": (6, "", "", "OTHER"),
    "orders": (6, "", "o_orderstatus", "OTHER"), "lineitem": (11, "", "l_linestatus", "OTHER"), "events": (6, "", "", "OTHER"), "documents": (5, "text,lang", "", "EXPRESSION_FILE"),
    "embeddings": (3, "", "", "OTHER"), "pages": (3, "", "", "OTHER"), "benchmark": (2, "text", "", "EXPRESSION_FILE"), "labels": (3, "quality", "", "EXPRESSION_FILE"),
    "conversations": (4, "text", "", "EXPRESSION_FILE"),
}
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({n} AS BIGINT) AS n_columns, '{w}' AS wanted_found, '{o}' AS outcome_columns, '{role}' AS role FROM {t}" for t, (n, w, o, role) in _PROFILE.items())


def _profile(spark, sf):
    return catalogue.profile_tables({t: views.table(spark, sf, t) for t in ALL_TABLES}, WANTED)


@query("profile_tables", "A8", _PROFILE_SQL)
def profile_tables(spark, sf):
    return _profile(spark, sf)


@query("profile_summary", "A8", f"""WITH p AS ({_PROFILE_SQL}) SELECT role, count(*) AS n_tables, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) FILTER (wanted_found <> '') AS n_with_wanted FROM p GROUP BY 1""")
def profile_summary(spark, sf):
    return catalogue.profile_summary(_profile(spark, sf))


@query("collect_evidence", "A9 C16", """WITH e AS (SELECT upper(trim(p_type)) AS evidence_key, 'part' AS source_table, CAST(p_size AS DOUBLE) AS weight FROM part WHERE upper(trim(p_type)) IN ('ECONOMY', 'ERROR', 'EN')
UNION ALL SELECT upper(trim(event_type)), 'events', value FROM events WHERE upper(trim(event_type)) IN ('ECONOMY', 'ERROR', 'EN') UNION ALL SELECT upper(trim(lang)), 'documents', NULL FROM documents WHERE upper(trim(lang)) IN ('ECONOMY', 'ERROR', 'EN'))
SELECT evidence_key, source_table, count(*) AS n, count(weight) AS n_weighted FROM e GROUP BY 1, 2""")
def collect_evidence(spark, sf):
    tables = {
        "part": (views.table(spark, sf, "part").select("p_type", F.col("p_size").cast("double").alias("weight")), "p_type"),
        "events": (views.table(spark, sf, "events").select("event_type", F.col("value").alias("weight")), "event_type"),
        "documents": (views.table(spark, sf, "documents").select("doc_id", "lang"), "lang"),
    }
    e = catalogue.collect_evidence(tables, ["economy", " error", "en"])
    return e.groupBy("evidence_key", "source_table").agg(F.count(F.lit(1)).alias("n"), F.count("weight").alias("n_weighted"))
