import io
import tarfile
import zipfile

import numpy as np
import pytest

from pairloom.sources import archives, files, sinks

GML = 'graph [ directed 0 node [ id 0 label "a b" value "x" ] node [ id 1 label "c" ] node [ id 2 ] edge [ source 1 target 0 ] edge [ source 0 target 1 ] edge [ source 2 target 2 ] ]'


def test_archives_and_formats(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("g/x.gml", GML)
        z.writestr("n.txt", "% c\n1 2\n\n3 4\n")
    with tarfile.open(tmp_path / "b.tar.bz2", "w:bz2") as t:
        data = b"% c\n5 6\n"
        info = tarfile.TarInfo("d/n.txt")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    np.save(tmp_path / "y.npy", np.arange(6.0, dtype=np.float32).reshape(3, 2))
    found = archives.members(spark, str(tmp_path))
    assert {r.member for r in found.collect()} == {"g/x.gml", "n.txt", "d/n.txt", "y.npy"}
    assert {r.value for r in archives.lines(found, "n.txt$", "%").collect()} == {"1 2", "3 4", "5 6"}
    nodes, edges = archives.gml_graph(spark, found)
    assert {(r.node, r.label) for r in nodes.collect()} == {(0, "x"), (1, "c"), (2, "")} and [(r.u, r.v) for r in edges.collect()] == [(0, 1)]
    assert [r.x for r in archives.npy_points(found).orderBy("id").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]


def test_arff_and_xlsx():
    names, rows = archives.arff("% c\n@RELATION r\n@ATTRIBUTE 'a b' NUMERIC\n@attribute c {x, y}\n@data\n1.5,'x'\n?,y\n")
    assert names == ["a b", "c"] and rows == [["1.5", "x"], [None, "y"]]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="u"><si><t>AT</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="u"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row></sheetData></w>')
    assert archives.xlsx(out.getvalue()) == [["AT", None, "2.5"]]


def test_members_become_edges_labels_and_tables(spark, tmp_path):
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="u"><si><t>AT</t></si><si><t>PE</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="u"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>1.5</v></c></row></sheetData></w>')
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/a.zip", "w") as z:
        z.writestr("edges.txt", "# c\n1 2\n2 1\n2 3\n9 9\n")
        z.writestr("labels.txt", "1 a\n2 b\n")
        z.writestr("x.content", "1\t0\t1\ta\n2\t1\t1\tb\n5\t0\t0\ta\n")
        z.writestr("x.cites", "1 2\n2 7\n5 5\n")
        z.writestr("t.arff", "@ATTRIBUTE p NUMERIC\n@ATTRIBUTE q {u}\n@DATA\n1,u\n?,u\n")
        z.writestr("t.xlsx", sheet.getvalue())
    np.savez(tmp_path / "in/z.npz", a=np.arange(4.0).reshape(2, 2), b=np.array([7.0, 8.0]))
    found = archives.members(spark, str(tmp_path / "in/a.zip"))
    edges = files.edges_of(archives.lines(found, "edges"))
    assert {tuple(r) for r in edges.collect()} == {(1, 2), (2, 3)}
    nodes, kept = files.labelled_graph(edges, files.node_labels(archives.lines(found, "labels")))
    assert nodes.count() == 2 and [tuple(r) for r in kept.collect()] == [(1, 2)]
    nodes, cites = files.read_citations(archives.lines(found, "content$"), archives.lines(found, "cites$"))
    assert {tuple(r) for r in nodes.collect()} == {(1, "a"), (2, "b"), (5, "a")} and [tuple(r) for r in cites.collect()] == [(1, 2)]
    rows = {(r.member, r.row): r.cells for r in archives.table_rows(found, "^t[.]").collect()}
    assert rows == {("t.arff", 0): {"p": "1", "q": "u"}, ("t.arff", 1): {"p": None, "q": "u"}, ("t.xlsx", 0): {"AT": "1.5"}}
    blob = spark.read.format("binaryFile").load(str(tmp_path / "in/z.npz")).selectExpr("path archive", "'z.npz' member", "content")
    assert {(r.name, r.id): r.x for r in archives.npz_arrays(blob).collect()} == {("a", 0): [0.0, 1.0], ("a", 1): [2.0, 3.0], ("b", 0): [7.0], ("b", 1): [8.0]}
    import hashlib

    good = hashlib.sha256((tmp_path / "in/z.npz").read_bytes()).hexdigest()
    (tmp_path / "m.json").write_text(f'[{{"name": "z.npz", "sha256": "{good.upper()}"}}, {{"name": "a.zip", "sha256": "00"}}, {{"name": "none"}}]')
    assert {r.name: r.ok for r in files.verified_files(spark, str(tmp_path / "in"), files.manifest(spark, str(tmp_path / "m.json"))).collect()} == {"z.npz": True, "a.zip": False, "none": False}


def test_sinks_that_keep_and_repair(spark, tmp_path):
    df = spark.createDataFrame([("a", "m", 1, "ok", 1.0), ("a", "m", 2, "error", None), (None, "m", 3, "ok", 2.0), ("a", "m", 1, "ok", 3.0)], "dataset string, method string, seed int, status string, v double")
    assert [r.seed for r in sinks.failures(df).collect()] == [2]
    assert {(r.seed, r.v) for r in sinks.repaired(df, ["dataset", "seed"]).collect()} == {(1, 3.0), (2, None)}
    assert sinks.clean_errors(df, str(tmp_path / "t"), str(tmp_path / "b")) == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3 and spark.read.parquet(str(tmp_path / "b")).count() == 4
    assert sinks.mode_path("/x/", "quick") == "/x/quick"
    with pytest.raises(ValueError):
        sinks.mode_path("/x", "other")
    made = []
    make = lambda: made.append(1) or df
    for _ in range(2):
        assert sinks.cached("k1", make, str(tmp_path), spark).count() == 4
    assert len(made) == 1
    named = spark.createDataFrame([("one", 1.0), ("two", 2.0)], "name string, v double")
    assert sinks.macros(named, "name", "v", "t").count() == 2
    with pytest.raises(Exception, match="named twice"):
        sinks.macros(named.union(named), "name", "v", "t").collect()
    maps = spark.createDataFrame([("e", "a", "m", 1, 5, [0.0, 1.0])], "experiment string, dataset string, method string, seed int, id long, y array<double>")
    sinks.save_maps(maps, str(tmp_path / "maps"))
    assert spark.read.parquet(str(tmp_path / "maps")).filter("dataset = 'a'").first().y == [0.0, 1.0]
