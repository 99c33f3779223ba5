import gzip

import pytest

from cohortlab.functions import scalars as sc
from cohortlab.operators import network, tables
from cohortlab.sources import catalogue, text


def test_blocks_three_policies(spark, tmp_path):
    f = tmp_path / "family.soft"
    f.write_text("^DATABASE = X\n!Database_name = y\n^SAMPLE = S1\n!Sample_title = a = b | c: d\n!Sample_char = age: 70\n!Sample_char = sex: M\n^SAMPLE = S2\r\n!Sample_title = t\r\n")
    join = {(r.sample_id, r.key): r.value for r in text.read_blocks(spark, str(f), repeat="join").collect()}
    assert join == {("S1", "title"): "a = b | c: d", ("S1", "char"): "age: 70 | sex: M", ("S2", "title"): "t"}
    last = {(r.sample_id, r.key): r.value for r in text.read_blocks(spark, str(f), repeat="last").collect()}
    assert last["S1", "char"] == "sex: M"
    listed = text.read_blocks(spark, str(f), repeat="list").filter("key = 'char'").orderBy("pos").collect()
    assert [r.value for r in listed] == ["age: 70", "sex: M"]
    with pytest.raises(ValueError):
        text.read_blocks(spark, str(f), repeat="first")


def test_series_header_and_table(spark, tmp_path):
    f = tmp_path / "series.txt.gz"
    body = ('!Sample_title\t"one"\t"two"\n!Sample_characteristics_ch1\t"status: AD"\t"status: CTL"\n!Sample_characteristics_ch1\t"age: 85 days"\t"age: 70"\n'
            '!series_matrix_table_begin\n"ID_REF"\t"S1"\t"S2"\n"p1"\t1.5\tnull\n"p2"\tinf\t4\n!series_matrix_table_end\n')
    f.write_bytes(gzip.compress(body.encode()))
    long = text.read_header_rows(spark, str(f), content={"status": "status:", "age": "age:"})
    got = text.header_table(long, ["title", "status", "age"]).withColumn("years", sc.years_from_text("age")).orderBy("pos").collect()
    assert [(r.title, r.status) for r in got] == [("one", "status: AD"), ("two", "status: CTL")]
    assert got[0].years == pytest.approx(85 / 365.25) and got[1].years == 70
    cells = {(r.feature, r.sample_id): r.value for r in text.read_table_block(spark, str(f)).collect()}
    assert cells == {("p1", "S1"): 1.5, ("p1", "S2"): None, ("p2", "S1"): None, ("p2", "S2"): 4.0}
    assert {r.feature for r in text.read_table_block(spark, str(f), keys=["p2"]).collect()} == {"p2"}


def test_matrix_orientations_agree(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text(",S1,S2\ng1,1,x\ng2,3,4\n")
    b.write_text("id,g1,g2\nS1,1,3\nS2,x,4\n")
    left = text.read_matrix_long(spark, str(a))
    right = text.read_matrix_long(spark, str(b), "samples_in_rows", header_key="id")
    assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.collect()), key=str)
    assert left.filter("value IS NULL").count() == 1


def test_key_filter_comes_before_the_split(spark, tmp_path):
    a = tmp_path / "a.csv"
    a.write_text(",S1,S2\ng1,1,2\ng2,3,4\n")
    plan = text.read_matrix_long(spark, str(a), keys=["g1"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("substring_index")  # printed top-down: the filter is below the explode


def test_strict_alignment(spark):
    a = spark.createDataFrame([("x",), ("y",)], "sample_id string")
    b = spark.createDataFrame([("y",), ("z",)], "sample_id string")
    assert {tuple(r) for r in tables.unmatched(a, b, "sample_id").collect()} == {("x", "left_only"), ("z", "right_only")}
    tables.require_matched(a, a, "sample_id")
    with pytest.raises(ValueError):
        tables.require_matched(a, b, "sample_id")


def test_scalar_cleaning(spark):
    df = spark.createDataFrame([("S12_x_y_z.CEL", "S7.cel.GZ", "brain_77yrs_M", "brain_81_AD_F", "weird")], "a string, b string, c string, d string, e string")
    ages = [r"_(\d+)yrs_", r"_(\d+)_AD_"]
    r = df.select(sc.clean_sample_id("a"), sc.clean_sample_id("b"), sc.first_match("c", ages), sc.first_match("d", ages), sc.first_match("e", ages),
                  sc.last_tokens("a"), sc.map_label("e", {"ad": 1}), sc.id_number(sc.clean_sample_id("a"))).first()
    assert list(r) == ["S12", "S7", "77", "81", None, "y_z.CEL", None, 12]
    with pytest.raises(Exception, match="unknown label"):
        df.select(sc.map_label("e", {"ad": 1}, strict=True)).collect()


def test_number_cleaning(spark):
    df = spark.createDataFrame([("1.5",), ("inf",), ("NaN",), ("abc",), (None,)], "x string")
    assert [r[0] for r in df.select(sc.to_number("x")).collect()] == [1.5, None, None, None, None]


def test_conditional_log_only_on_large_values(spark):
    small = spark.createDataFrame([(3.0,), (12.0,)], "value double")
    assert [r.value for r in tables.log2_if_large(small).collect()] == [3.0, 12.0]
    assert tables.log2_if_large(spark.createDataFrame([(63.0,)], "value double")).first().value == 6.0


def test_catalogue_roles(spark):
    t = spark.createDataFrame([("S1", "AD", 1.0)], "id string, Diagnosis string, geneA double")
    got = {r.table_name: r for r in catalogue.profile_tables({"expr": t, "cohen_table": t, "clinical": t.drop("geneA")}, ["GENEA"]).collect()}
    assert {k: v.role for k, v in got.items()} == {"expr": "EXPRESSION_FILE", "cohen_table": "EFFECT_OR_DE_FILE", "clinical": "METADATA_FILE"}
    assert got["expr"].wanted_found == "geneA" and got["expr"].outcome_columns == "Diagnosis"


def test_seed_edges_without_or_join(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("c", "a", 0.5), ("b", "c", 0.8), ("d", "e", 0.99)], "a string, b string, score double")
    seeds = spark.createDataFrame([("a",), ("b",), ("x",)], "seed string")
    touching = network.seed_edges(edges, seeds, 0.4)
    assert {(r.seed, r.neighbour) for r in touching.collect()} == {("a", "b"), ("b", "a"), ("a", "c"), ("b", "c")}
    assert [(r.neighbour, r.n_seeds) for r in network.neighbour_summary(touching, seeds).collect()] == [("c", 2)]
    assert {r.seed: r.degree for r in network.seed_degree(touching, seeds).collect()} == {"a": 2, "b": 2, "x": 0}
    plan = touching._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lines_and_replacements(spark):
    d = spark.createDataFrame([(1, "a1\nb 22\nc"), (2, "none")], "id int, text string")
    hits = network.pattern_lines(d, {"digit": r"\d", "two": r"\d\d"}, "id").collect()
    assert {(r.id, r.line_no, r.pattern) for r in hits} == {(1, 1, "digit"), (1, 2, "digit"), (1, 2, "two")}
    out = network.replace_in_order(d, [(r"\d+", "N"), ("N", "M")])
    assert {r.id: r.changed for r in out.collect()} == {1: True, 2: False}
    assert [(r.line_no, r.old_line, r.new_line) for r in network.changed_lines(out, "id", "text", "new_text").orderBy("line_no").collect()] == [(1, "a1", "aM"), (2, "b 22", "b M")]


def test_each_file_has_its_own_header(spark, tmp_path):
    from cohortlab.sources import text

    (tmp_path / "one.csv").write_text("id|s1|s2\nf|1|2\n")
    (tmp_path / "two.csv").write_text("id|s3|s4\nf|3|4\n")
    got = {(r.sample_id, r.value) for r in text.read_matrix_long(spark, str(tmp_path), sep="|", header_key="id").collect()}
    assert got == {("s1", 1.0), ("s2", 2.0), ("s3", 3.0), ("s4", 4.0)}
