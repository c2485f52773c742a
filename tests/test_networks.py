import gzip

import numpy as np
import pytest
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pairloom.operators import graphs, solvers, temporal
from pairloom.plans import networks
from pairloom.plans.catalog import QUERIES
from pairloom.sources import files, sinks
from pairloom.streaming.snapshots import windowed_edges


def edges(spark, pairs):
    return spark.createDataFrame([tuple(sorted(p)) for p in pairs], "u long, v long")


def test_components_and_hops(spark):
    e = edges(spark, [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (100, 102)])
    assert {r.node for r in graphs.largest_component(e).collect()} == set(range(21))
    hops = {(r.source, r.node): r.hops for r in graphs.hop_distances(e, spark.createDataFrame([(0,), (102,)], "node long")).collect()}
    assert hops[0, 20] == 20 and hops[102, 100] == 1 and (0, 100) not in hops


def test_square_with_diagonals(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2), (1, 3)])
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)], "node long, x double, y double")
    c = graphs.crossings(e, at).collect()
    assert len(c) == 1 and abs(c[0].angle - 90) < 1e-9
    assert abs(graphs.angular_resolution(e, at).first()[0] - 45) < 1e-9
    assert abs(graphs.crossing_angle_deviation(graphs.crossings(e, at)).first()[0]) < 1e-9


def test_crossings_agree_with_brute_force(spark):
    rng = np.random.default_rng(0)
    p = rng.random((25, 2))
    pairs = {tuple(sorted(map(int, rng.choice(25, 2, replace=False)))) for _ in range(40)}
    turn = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    want = sum(not set(a) & set(b) and a < b and turn(p[a[0]], p[a[1]], p[b[0]]) * turn(p[a[0]], p[a[1]], p[b[1]]) < 0 and turn(p[b[0]], p[b[1]], p[a[0]]) * turn(p[b[0]], p[b[1]], p[a[1]]) < 0 for a in pairs for b in pairs)
    at = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "node long, x double, y double")
    assert graphs.crossings(edges(spark, pairs), at, cells=5).count() == want


def test_resistance_of_a_path_and_a_triangle(spark):
    d = {(r.i, r.j): r.d for r in graphs.resistance(edges(spark, [(0, 1), (1, 2), (2, 3), (1, 3)])).collect()}
    assert abs(d[0, 1] - 1) < 1e-9 and abs(d[1, 2] - 2 / 3) < 1e-9 and abs(d[0, 3] - 5 / 3) < 1e-9


def test_last_bin_is_half_open(spark):
    c = spark.createDataFrame([(0, 1, 2), (5, 2, 1), (10, 1, 2), (3, 4, 4)], "t long, i long, j long")
    assert {(r.bin, r.u, r.v, r.weight) for r in temporal.snapshots(c, 5).collect()} == {(0, 1, 2, 1), (1, 1, 2, 1)}
    assert temporal.snapshots(c.filter("t = 0"), 5).count() == 0


def test_turned_snapshots_are_stable(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 2))
    turn = np.array([[0.6, -0.8], [0.8, 0.6]])
    rows = [(t, i, float(x), float(y)) for t, m in ((1, a), (4, a @ turn + 3), (5, a * [1, -1])) for i, (x, y) in enumerate(m)]
    p = spark.createDataFrame(rows, "t int, node long, x double, y double")
    s = temporal.stability(p).collect()
    assert len(s) == 2 and all(r.stability < 1e-9 and r.n == 12 for r in s)
    assert tuple(temporal.mean_stability(p).first())[1] == 2
    assert tuple(temporal.mental_map(p, 3).first()) == (1.0, 2)


PATH = "t int, node long, x double, y double"


def test_smoothness_is_the_mean_square_of_second_differences(spark):
    # Node 1 moves 0, 1, 4: second difference 2; node 2 stands still; node 3 misses a snapshot.
    rows = [(0, 1, 0.0, 0.0), (1, 1, 1.0, 0.0), (2, 1, 4.0, 0.0), (0, 2, 5.0, 5.0), (1, 2, 5.0, 5.0), (2, 2, 5.0, 5.0), (0, 3, 9.0, 9.0)]
    assert tuple(temporal.smoothness(spark.createDataFrame(rows, PATH)).first()) == (2.0, 2)
    assert temporal.smoothness(spark.createDataFrame(rows[:2], PATH)).first().smoothness is None


def test_stability_divides_by_the_size_of_the_whole_snapshot(spark):
    # Nodes 1 and 2 move apart from 2 to 4: each is 1 off after alignment; node 3 counts in the size only.
    rows = [(0, 1, 0.0, 0.0), (0, 2, 2.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 4.0, 0.0), (1, 3, 0.0, 3.0)]
    size = (4 + 3 + 5) / 3
    got = temporal.stability(spark.createDataFrame(rows, PATH)).first()
    assert abs(got.stability - 1 / size) < 1e-12 and got.n == 2
    assert abs(temporal.mean_stability(spark.createDataFrame(rows, PATH)).first().stability - 1 / size) < 1e-12
    with pytest.raises(Exception, match="one place"):
        temporal.stability(spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0), (1, 1, 1.0, 1.0), (1, 2, 1.0, 1.0)], PATH)).collect()


def test_mental_map_and_overlap_need_enough_common_nodes(spark):
    # On a line 0, 1, 3, 7 the nearest of each are 1, 0, 1, 3 (by place 0-based 1, 0, 1, 2); then node 2 moves next to node 3.
    rows = [(0, i, float(x), 0.0) for i, x in enumerate((0, 1, 3, 7))] + [(1, i, float(x), 0.0) for i, x in enumerate((0, 1, 6, 7))] + [(2, 0, 0.0, 0.0)]
    p = spark.createDataFrame(rows, PATH)
    assert tuple(temporal.mental_map(p, 1).first()) == (0.75, 1)
    got = {(r.t, r.k): (r.jaccard, r.note) for r in temporal.overlap_by_k(p, [1, 5]).collect()}
    assert got == {(1, 1): (0.75, ""), (1, 5): (None, "too few common nodes"), (2, 1): (None, "too few common nodes"), (2, 5): (None, "too few common nodes")}
    assert tuple(temporal.lonely_transitions(p.unionByName(spark.createDataFrame([(3, 9, 0.0, 0.0)], PATH))).first()) == (3, 1)


def test_usable_snapshots_go_by_their_largest_component(spark):
    s = spark.createDataFrame([(0, 1, 2, 1), (0, 3, 4, 1), (1, 1, 2, 1), (1, 2, 3, 1), (4, 5, 6, 2), (4, 6, 7, 1), (4, 8, 9, 1)], "bin long, u long, v long, weight long")
    assert [tuple(r) for r in temporal.usable(s, 3).orderBy("bin").collect()] == [(1, 3, 0), (4, 3, 1)]
    with pytest.raises(ValueError, match="usable"):
        temporal.usable(s, 4)
    d = {(r.t, r.i, r.j): r.d for r in temporal.snapshot_distances(s, 3).collect()}
    assert d == {(0, 1, 2): 1, (0, 2, 3): 1, (0, 1, 3): 2, (1, 5, 6): 1, (1, 6, 7): 1, (1, 5, 7): 2}


def test_neighbours_kept_is_a_share_of_the_degree(spark):
    # A path 0-1-2-3 drawn in the order 0, 1, 3, 2: degrees 1, 2, 2, 1.
    e = edges(spark, [(0, 1), (1, 2), (2, 3)])
    at = {0: 0.0, 1: 1.0, 3: 2.5, 2: 5.0}
    pairs = spark.createDataFrame([(i, j, abs(at[i] - at[j])) for i in at for j in at if i < j], "i long, j long, d_lo double")
    # 0 keeps 1; 1 has near 0, 3 and keeps 0 of {0, 2}; 2 has near 3, 1 and keeps both; 3 has near 1, not 2.
    assert abs(graphs.neighbours_kept(e, pairs).first()[0] - (1 + 0.5 + 1 + 0) / 4) < 1e-12
    points = spark.createDataFrame([(i, [v, 0.0]) for i, v in at.items()], "id long, y array<double>")
    assert abs(graphs.neighbours_kept_of(e, points).first()[0] - (1 + 0.5 + 1 + 0) / 4) < 1e-12


def test_distances_of_a_disconnected_graph_are_an_error(spark):
    e = edges(spark, [(0, 1), (5, 6)])
    assert graphs.hop_distances(e, graphs.degrees(e).select("node")).count() == 8
    with pytest.raises(ValueError, match="components"):
        graphs.hop_distances(e, graphs.degrees(e).select("node"), connected=True)


def test_contacts_become_a_simple_graph(spark):
    c = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (1, 2)], "i long, j long")
    assert [tuple(r) for r in graphs.simple_graph(c).collect()] == [(1, 2, 3)]


def test_majorisation_recovers_a_plane(spark):
    y = np.random.default_rng(2).normal(size=(15, 2))
    rows = [("d", i, j, float(np.hypot(*(y[i] - y[j])))) for i in range(15) for j in range(i + 1, 15)]
    p = spark.createDataFrame(rows, "dataset string, i long, j long, d_hi double")
    assert solvers.fit_maps(p).first().stress < 1e-9
    assert all(r.scale_invariant < 1e-6 for r in solvers.alpha_search(p, [0.0, 1.0], 0.1).collect())
    assert solvers.sgd_maps(p).count() == 15


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "log.gz", "wt") as f:
        f.write("20 1 2 A B\n40 2\t3 B B\n\n")
    log = files.contact_log(spark, str(tmp_path / "log.gz"))
    assert [tuple(r) for r in log.orderBy("t").collect()] == [(20, 1, 2, "A", "B"), (40, 2, 3, "B", "B")]
    (tmp_path / "edges").write_text("# c\n1 2\n2 1\n3 3\n2 5\n")
    assert {tuple(r) for r in files.edge_list(spark, str(tmp_path / "edges")).collect()} == {(1, 2), (2, 5)}
    (tmp_path / "r.csv").write_text("dataset,auc\na,0.5\nb,NaN\n")
    schema = StructType([StructField("dataset", StringType()), StructField("auc", DoubleType())])
    assert [r.auc for r in files.results(spark, str(tmp_path / "r.csv"), schema).collect()] == [0.5, None]
    labels = spark.createDataFrame([(1, "A"), (2, "B")], "node long, label string")
    assert files.labelled(log.filter("t = 20"), labels).first().cj == "B"
    with pytest.raises(Exception, match="no label"):
        files.labelled(log, labels).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "ok"), ("b", 2, "error")], "dataset string, seed int, status string")
    grid = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "dataset string, seed int")
    assert sinks.finalize(df, grid, ["dataset", "seed"], str(tmp_path / "t")).endswith("_partial")
    assert not sinks.finalize(df, grid.limit(2), ["dataset", "seed"], str(tmp_path / "t")).endswith("_partial")
    sinks.append(df, str(tmp_path / "s"), ["dataset"])
    sinks.append(df, str(tmp_path / "s"), ["dataset"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
    with pytest.raises(Exception, match="dataset is null"):
        sinks.append(df.withColumn("dataset", __import__("pyspark").sql.functions.lit(None).cast("string")), str(tmp_path / "s"), ["dataset"])
    assert sinks.without(df, dataset=["a"]).count() == 1 and sinks.corrupted(df, ["seed"]).count() == 0
    with pytest.raises(ValueError):
        sinks.check_schema(df, ["dataset"])


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = [(f"2024-01-0{1 + k % 3} 10:00:00", k % 4, (k + 1) % 5) for k in range(40)]
    df = spark.createDataFrame(rows, "s string, i long, j long").selectExpr("cast(s as timestamp) ts", "i", "j")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_edges(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("snaps").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("snaps").collect())) == sorted(map(tuple, windowed_edges(df).collect()))


def test_hop_distances_have_no_bound(spark, monkeypatch):
    path = edges(spark, [(i, i + 1) for i in range(18)])
    monkeypatch.setattr(networks, "edges", lambda s, d: path)
    got = {(r.source, r.node): r.hops for r in QUERIES["gr01_hop_distances"](spark, "").collect()}
    assert got == {(i, j): abs(i - j) for i in range(19) for j in range(19)}


def test_hop_distances_raise_beyond_a_given_depth(spark):
    short, ends = edges(spark, [(0, 1), (1, 2), (2, 3)]), spark.createDataFrame([(0,)], "node long")
    assert graphs.hop_distances(short, ends, depth=3).count() == 4
    with pytest.raises(RuntimeError):
        graphs.hop_distances(short, ends, depth=2)
