"""Commands over small files."""

from gaugewright import cli


def test_filter(spark, tmp_path):
    spark.createDataFrame([(1, 5), (1, 6), (2, 6), (3, 7)], "seq int, unit int").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([(5,)], "unit int").write.parquet(str(tmp_path / "b"))
    cli.main(["filter", "--candidates", str(tmp_path / "c"), "--baseline", str(tmp_path / "b"), "--unit", "unit", "--order", "seq", "--out", str(tmp_path / "o")], spark)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(1, 1, 1), (3, 1, 1)]


def test_reduce_puts_the_target_class_first(spark, tmp_path):
    (tmp_path / "d.csv").write_text("test_selector,added_lines,added_methods,added_branches,added_instructions\nT#a,99,10,10,999\nT#b,1,1,1,1\n")
    (tmp_path / "l.csv").write_text("test_selector,class_name,newly_covered_lines,upgraded_to_full_lines\nT#a,other.C,20-30,\nT#b,sample.Target$View,101-103,\n")
    cli.main(["reduce", "--deltas", str(tmp_path / "d.csv"), "--lines", str(tmp_path / "l.csv"), "--target", "sample.Target", "--top", "1", "--out", str(tmp_path / "o")], spark)
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    assert [(r["test_selector"], r["target_lines"], r["rank"]) for r in rows] == [("T#b", 3, 1)]


def test_compare_and_query(spark, tmp_path):
    for side, body in (("c", "assertTrue(a == b);"), ("r", "assertEquals(a, b);")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "T.java").write_text(f"class T {{ @Test public void testIt() {{ {body} }} }}")
    cli.main(["compare", "--candidate", str(tmp_path / "c"), "--reference", str(tmp_path / "r"), "--out", str(tmp_path / "o.csv")], spark)
    row = spark.read.option("header", True).csv(str(tmp_path / "o.csv")).first()
    assert row["file"] == "T.java" and float(row["assertion_conformance"]) == 0.5 and row["methods"] == "1"
    cli.main(["query", "--name", "rollup", "--tables", "/root/testdata/sf0.001", "--out", str(tmp_path / "q")], spark)
    assert spark.read.parquet(str(tmp_path / "q")).count() > 3
