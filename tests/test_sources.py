"""Readers and writers on small files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gaugewright.sources import readers, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_csv(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'repo,fqcn,n\na/b,"x,""y""",3\nc,d,bad\n')
    rows = readers.csv_rows(spark, path, "repo string, fqcn string, n int, extra double").collect()
    assert [tuple(r) for r in rows] == [("a/b", 'x,"y"', 3, None), ("c", "d", None, None)]
    assert readers.csv_rows(spark, str(tmp_path / "none.csv"), "a int", missing_is_empty=True).count() == 0
    with pytest.raises(ValueError):
        readers.require(readers.csv_rows(spark, path), "Name")


def test_deltas_and_selectors(spark, tmp_path):
    path = put(tmp_path / "d.csv", "test_selector,added_lines,added_methods,added_branches,added_instructions\na#b,1,2,x,4\nshort,1\nc#d,5,6,7,8\n")
    rows = readers.test_deltas(spark, path).collect()
    assert [tuple(r) for r in rows] == [("a#b", 1, 2, 0, 4, 1), ("c#d", 5, 6, 7, 8, 0)]
    path = put(tmp_path / "s.txt", "# note\n\n a.B#c \na.B\nx#y#z\n")
    assert [tuple(r) for r in readers.selectors(spark, path).collect()] == [("a.B", "c"), ("a.B", None), ("x#y", "z")]


def test_artifact_map(spark):
    rows = spark.createDataFrame([("r", "f", "one"), ("r", "f", "two"), ("q", "g", "")], "repo string, fqcn string, fatjar string").coalesce(1)
    assert {(r["repo"], r["path"]) for r in readers.artifact_map(rows).collect()} == {("r", "two"), ("q", None)}


XML = """<report><package name="a/b"><class name="a/b/C"/><sourcefile name="C.java"><line nr="3" mi="0" ci="2" mb="0" cb="0"/><line nr="4" mi="1" ci="0" mb="0" cb="0"/>
<counter type="LINE" missed="1" covered="1"/></sourcefile><sourcefile name="D.java"><line nr="1" mi="0" ci="1" mb="0" cb="0"/><counter type="BRANCH" missed="2" covered="3"/></sourcefile></package></report>"""


def test_coverage_reports(spark, tmp_path):
    path = put(tmp_path / "r.xml", XML)
    assert {tuple(r) for r in readers.coverage_xml_lines(spark, path).collect()} == {("a/b", "C.java", 3, True), ("a/b", "C.java", 4, False), ("a/b", "D.java", 1, True)}
    assert {tuple(r) for r in readers.coverage_xml_counters(spark, path).collect()} == {("a/b", "C.java", 1, 2, 0, 0), ("a/b", "D.java", 0, 0, 3, 5)}
    path = put(tmp_path / "r.csv", "GROUP,PACKAGE,CLASS,LINE_MISSED,LINE_COVERED,BRANCH_MISSED,BRANCH_COVERED\ng,a.b,C,1,2,3,4\ng,a.b,C.Inner,1,1,0,0\n")
    assert [tuple(r) for r in readers.coverage_csv(spark, path).collect()] == [("a.b.C", 3, 5, 4, 7)]
    path = put(tmp_path / "ids.txt", "0123456789abcdef 12 a/b/C\nshort a/b/C\n0123456789abcdee 1 a/b/D\n")
    assert [r[0] for r in readers.class_ids(spark, path, "a.b.C").collect()] == ["0123456789abcdef"]


def test_analysis_reports(spark, tmp_path):
    path = put(tmp_path / "p.xml", '<pmd><file name="x"><violation rule="A">t</violation><violation rule="A">t</violation><violation rule="B">t</violation></file></pmd>')
    assert {tuple(r) for r in readers.rule_violations(spark, path).collect()} == {("A", 2), ("B", 1)}
    path = put(tmp_path / "c.xml", '<pmd-cpd><duplication lines="5" tokens="9"><file/></duplication><duplication lines="7" tokens="9"><file/></duplication></pmd-cpd>')
    assert tuple(readers.duplicated_lines(spark, path).first()) == (2, 12)


def test_files_and_archives(spark, tmp_path):
    put(tmp_path / "src/b/T.java", "class T {}")
    put(tmp_path / "src/a/T.java", "class T {}")
    assert readers.source_files(spark, str(tmp_path / "src")).count() == 2
    bad = {"Latin": b"caf\xe9 x", "Cut": "a\u20ac".encode()[:-1], "Fine": "\ufffd \ufdd0\ufdd1 \u20ac".encode(), "Both": b"\xff" + "\ufffd\ufdd0\ufdd2".encode() + b"\xc3"}
    for name, content in bad.items():
        put(tmp_path / f"bad/{name}.java", content)
    got = {r["path"].rsplit("/", 1)[1][:-5]: r["text"] for r in readers.source_files(spark, str(tmp_path / "bad")).collect()}
    assert got == {name: content.decode("utf-8", "ignore") for name, content in bad.items()}
    names = spark.createDataFrame([("T.java",)], "name string")
    assert readers.files_by_name(spark, str(tmp_path / "src"), names).first()["path"].endswith("/a/T.java")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("A.class", b"\xca\xfe\xba\xbe\x00\x00\x00\x3d")
        z.writestr("x.txt", "x")
    put(tmp_path / "jars/a.jar", data.getvalue())
    put(tmp_path / "jars/b.jar", b"broken")
    assert {(r["entry"], r["major"]) for r in readers.archive_entries(spark, str(tmp_path / "jars")).collect()} == {("A.class", 61), ("x.txt", None)}


def test_build_files(spark):
    texts = ["<properties><maven.compiler.source>1.8</maven.compiler.source></properties>", "sourceCompatibility = JavaVersion.VERSION_17", "java-version: '21'", "nothing"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["v"] for r in rows.select("i", readers.java_version(F.col("t")).alias("v")).orderBy("i").collect()] == [8, 17, 21, None]
    pairs = {
        "<maven.compiler.source>1.8</maven.compiler.source><maven.compiler.release>17</maven.compiler.release>": ("1.8", "17"),
        "<compiler.source>11</compiler.source>": ("11", "11"),
        "<properties><compiler.target>9</compiler.target></properties><source>8</source>": ("8", "9"),
        "sourceCompatibility = 1.8\njava { toolchain { languageVersion = JavaLanguageVersion.of(17) } }": ("1.8", "17"),
        "<properties><java.version>${x}</java.version></properties>": ("${x}", "${x}"),
        "": (None, None),
    }
    found = spark.createDataFrame([(t,) for t in pairs], "t string").select("t", readers.java_versions(F.col("t")).alias("v")).collect()
    assert {r["t"]: tuple(r["v"]) for r in found} == pairs
    one = spark.createDataFrame([("<properties><a.b> 5 </a.b></properties>", "${a.b}"), ("", "7")], "t string, v string")
    assert [r[0] for r in one.select(readers.resolve_properties(F.col("t"), F.col("v"))).collect()] == ["5", "7"]


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, seq int, v string")
    sinks.write_upsert(rows((1, 1, "a"), (2, 2, "b")), path, ["k"], "seq")
    sinks.write_upsert(rows((2, 3, "c"), (3, 4, "d"), (3, 5, "e")), path, ["k"], "seq")
    assert sorted(tuple(r) for r in sinks.read_upserted(spark, path).collect()) == [(1, 1, "a"), (2, 2, "c"), (3, 4, "e")]
    csv = str(tmp_path / "c")
    sinks.write_csv(rows((1, 1, 'x,"y"')), csv)
    sinks.write_csv(rows((2, 2, "z")).select("v", "k", "seq"), csv, fresh=False)
    assert sorted((r["k"], r["v"]) for r in readers.csv_rows(spark, csv).collect()) == [("1", 'x,"y"'), ("2", "z")]
    with pytest.raises(ValueError):
        sinks.write_csv(spark.range(1), csv, fresh=False)
    sinks.split_by(rows((1, 1, "a"), (2, 1, "b")), "v", str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if "=" in p.name) == ["v=a", "v=b"]
    assert sinks.name_for("x/summary.csv", True) == "x/summary.includes.csv"
    left = spark.createDataFrame([(1,), (2,)], "k int")
    assert {tuple(r) for r in sinks.with_sentinel(left, spark.createDataFrame([(1, "p")], "k int, path string"), ["k"], "path").collect()} == {(1, "p"), (2, "FAIL")}
    sinks.write_text(left, "k", str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).count() == 2


def test_upserts_survive_a_lost_driver(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, seq int, v string")
    now = lambda: sorted(tuple(r) for r in sinks.read_upserted(spark, path).collect())
    sinks.write_upsert(rows((1, 1, "a"), (2, 2, "b")), path, ["k"], "seq", 4)
    before = sorted(p.name for p in (tmp_path / "t").iterdir())

    class Lost(Exception):
        pass

    real = sinks._hadoop

    def lost(spark, path):
        jvm, to, files = real(spark, path)

        class Files:
            def __getattr__(self, name):
                if name == "rename":
                    raise Lost  # data and pointer are written, the pointer is not in its place yet
                return getattr(files, name)

        return jvm, to, Files()

    monkeypatch.setattr(sinks, "_hadoop", lost)
    with pytest.raises(Lost):
        sinks.write_upsert(rows((2, 3, "c"), (3, 4, "d")), path, ["k"], "seq")
    monkeypatch.undo()
    assert now() == [(1, 1, "a"), (2, 2, "b")]
    sinks.write_upsert(rows((3, 4, "d")), path, ["k"], "seq")
    assert now() == [(1, 1, "a"), (2, 2, "b"), (3, 4, "d")]
    sinks.write_upsert(rows((2, 5, "e")), path, ["k"], "seq", 9)  # the table keeps its four buckets
    sinks.write_upsert(rows(), path, ["k"], "seq")
    assert now() == [(1, 1, "a"), (2, 2, "e"), (3, 4, "d")]
    names = [p.name for p in (tmp_path / "t").iterdir()]
    assert not [n for n in names if "staged" in n] and len([n for n in names if n.startswith("current")]) == 2 and before


def test_artifacts_go_by_file_and_line(spark, tmp_path):
    for name, lines in (("a.csv", ["r,C,one.jar"]), ("b.csv", ["r,C,two.jar", "r,C,three.jar"])):
        (tmp_path / name).write_text("repo,fqcn,fatjar\n" + "\n".join(lines) + "\n")
    assert readers.artifact_map(readers.csv_rows(spark, str(tmp_path))).first()["path"] == "three.jar"
    assert readers.csv_rows(spark, str(tmp_path), breaks_in_fields=False).count() == 3


def test_staged_columns_go_on(spark, tmp_path):
    """A run that is taken up again reads what was written and runs the rest."""
    rows = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    path = str(tmp_path / "s")
    first = {"c": F.col("a") + 1, "d": F.col("c") * 2}
    assert sorted(tuple(r) for r in sinks.staged(rows, first, path).collect()) == [(1, 2, 2, 4), (3, 4, 4, 8)]
    assert [p.name for p in (tmp_path / "s").iterdir()] == ["step-001"]
    broken = {"c": F.raise_error(F.lit("run again")).cast("int"), "d": F.raise_error(F.lit("run again")).cast("int"), "e": F.col("d") + F.col("b")}
    assert sorted(r["e"] for r in sinks.staged(rows, broken, path).collect()) == [6, 12]
