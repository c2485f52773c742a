"""Graph operators over edge tables ``u < v`` and layouts: components, distances, crossings, angles."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fold_angle
from .geometry import nearest, ratio
from .lineage import cut_lineage
from .resistance import all_pairs


def knn_graph(points: DataFrame, k: int) -> DataFrame:
    """Undirected edges between points one of which is among the other's k nearest."""
    near = nearest(points, k)
    return near.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).distinct()


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_directions(edges).groupBy("u").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("u", "node")


def component_labels(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node, component``: the smallest node reachable. Labels spread along edges and jump to their label's label."""
    near = cut_lineage(both_directions(edges))
    labels = cut_lineage(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("component")).withColumnRenamed("u", "node"))
    for _ in range(rounds):
        spread = near.join(labels, near["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("c"))
        new = labels.join(spread, labels["node"] == spread["u"]).select("node", F.least("component", "c").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = cut_lineage(new.join(jump, "component").select("node", F.least("component", "up").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").filter("component <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("components didn't settle")


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes, that with the smallest label on ties."""
    labels = component_labels(edges)
    top = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(F.broadcast(top), "component").select("node")


def hop_distances(edges: DataFrame, sources: DataFrame, depth: int | None = None, connected: bool = False) -> DataFrame:
    """``source, node, hops`` by frontier: each round visits the neighbours that a source hasn't seen, until none is left.

    With ``depth`` it raises if a node farther away than that is reached, with ``connected`` if one can't be reached.
    """
    near = cut_lineage(both_directions(edges))
    if connected and (parts := component_labels(edges).select("component").distinct().limit(2).count()) > 1:
        raise ValueError(f"{parts} or more components: distances between them aren't defined")
    seen = cut_lineage(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")))
    for hop in count(1):
        frontier = seen.filter(F.col("hops") == hop - 1)
        found = frontier.join(near, frontier["node"] == near["u"]).select("source", F.col("v").alias("node")).distinct()
        new = found.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(hop))
        new = cut_lineage(new)
        if not new.limit(1).count():
            return seen
        if depth is not None and hop > depth:
            raise RuntimeError(f"nodes are more than {depth} hops apart")
        seen = cut_lineage(seen.unionByName(new))


def with_ends(edges: DataFrame, layout: DataFrame) -> DataFrame:
    a = layout.select(F.col("node").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = layout.select(F.col("node").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return edges.join(a, "u").join(b, "v")


def crossings(edges: DataFrame, layout: DataFrame, cells: int | None = None) -> DataFrame:
    """``u, v, u2, v2, angle`` of edge pairs that cross properly and share no end.

    Edges meet only in the grid cells that their bounding boxes touch, each pair in the first cell both have, so that
    the join is an equi-join by cell instead of all pairs of edges. Unless given, cells are about half as wide as the
    mean edge's box, so an edge touches a handful of them however many edges there are.
    """
    e = with_ends(edges, layout)
    if cells is None:
        s = e.agg(F.avg(F.greatest(F.abs(F.col("ux") - F.col("vx")), F.abs(F.col("uy") - F.col("vy")))), F.greatest(F.max("ux") - F.min("ux"), F.max("uy") - F.min("uy"))).first()
        cells = max(1, min(1 << 14, int(2 * s[1] / s[0]))) if s[0] else 1
    box = layout.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    e = e.crossJoin(F.broadcast(box))
    cell = lambda v, lo, hi: F.least(F.lit(cells - 1), F.floor(F.coalesce(ratio(v - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0)) * cells)).cast("int")
    e = e.select(
        "u", "v", "ux", "uy", "vx", "vy", cell(F.least("ux", "vx"), "x0", "x1").alias("a0"), cell(F.greatest("ux", "vx"), "x0", "x1").alias("a1"),
        cell(F.least("uy", "vy"), "y0", "y1").alias("b0"), cell(F.greatest("uy", "vy"), "y0", "y1").alias("b1"),
    )
    e = e.withColumn("ca", F.explode(F.sequence("a0", "a1"))).withColumn("cb", F.explode(F.sequence("b0", "b1")))
    f = e.select(*[F.col(c).alias(f"{c}2") if c not in ("ca", "cb") else F.col(c) for c in e.columns])
    first = (F.col("ca") == F.greatest("a0", "a02")) & (F.col("cb") == F.greatest("b0", "b02"))
    apart = (F.col("u") != F.col("u2")) & (F.col("u") != F.col("v2")) & (F.col("v") != F.col("u2")) & (F.col("v") != F.col("v2"))
    turn = lambda px, py, qx, qy, rx, ry: F.signum((F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px)))
    cross = (turn("ux", "uy", "vx", "vy", "ux2", "uy2") * turn("ux", "uy", "vx", "vy", "vx2", "vy2") < 0) & (turn("ux2", "uy2", "vx2", "vy2", "ux", "uy") * turn("ux2", "uy2", "vx2", "vy2", "vx", "vy") < 0)
    before = (F.col("u") < F.col("u2")) | ((F.col("u") == F.col("u2")) & (F.col("v") < F.col("v2")))
    j = e.join(f, ["ca", "cb"]).filter(before & first & apart & cross)
    way = lambda s: F.degrees(F.atan2(F.col(f"vy{s}") - F.col(f"uy{s}"), F.col(f"vx{s}") - F.col(f"ux{s}")))
    return j.select("u", "v", "u2", "v2", fold_angle(way("") - way("2")).alias("angle"))


def edge_length_spread(edges: DataFrame, layout: DataFrame) -> DataFrame:
    d = F.sqrt((F.col("ux") - F.col("vx")) ** 2 + (F.col("uy") - F.col("vy")) ** 2)
    return with_ends(edges, layout).agg(ratio(F.stddev_pop(d), F.avg(d)).alias("edge_length_cv"))


def angular_resolution(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """Mean over nodes of the smallest angle in degrees between neighbouring edges.

    Edges without length have no angle; nodes with fewer than two others are left out.
    """
    e = with_ends(both_directions(edges), layout).filter((F.col("ux") != F.col("vx")) | (F.col("uy") != F.col("vy")))
    a = e.select(F.col("u").alias("node"), F.pmod(F.degrees(F.atan2(F.col("vy") - F.col("uy"), F.col("vx") - F.col("ux"))), F.lit(360.0)).alias("a"))
    w = Window.partitionBy("node").orderBy("a")
    gap = F.coalesce(F.lead("a").over(w), F.min("a").over(Window.partitionBy("node")) + 360.0) - F.col("a")
    per = a.withColumn("gap", gap).groupBy("node").agg(F.min("gap").alias("g"), F.count(F.lit(1)).alias("k")).filter("k >= 2")
    return per.agg(F.avg("g").alias("angular_resolution"))


def crossing_angle_deviation(crossed: DataFrame) -> DataFrame:
    """Mean distance of the crossings' angles from a right one; NULL without crossings."""
    return crossed.agg(F.avg(F.abs(90.0 - F.col("angle"))).alias("angle_deviation"))


def neighbours_kept(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean over nodes of the share of their neighbours that are among as many nearest nodes of the map."""
    deg = degrees(edges)
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d_lo", "j"))
    both = pairs.select("i", "j", "d_lo").unionAll(pairs.select(F.col("j"), F.col("i"), "d_lo"))
    near = both.join(deg, both["i"] == deg["node"]).withColumn("rank", rank).filter("rank <= degree").select("i", "j", "degree")
    return _kept(edges, near)


def neighbours_kept_of(edges: DataFrame, points: DataFrame) -> DataFrame:
    """``neighbours_kept`` from ``id, y`` points: only as many nearest of a node as its degree are looked for, no table of pairs."""
    deg = cut_lineage(degrees(edges))
    most = deg.agg(F.max("degree")).first()[0] or 0
    y = points.join(deg, points["id"] == deg["node"], "left").select("id", F.col("y").alias("x"), "y", F.coalesce("degree", F.lit(0)).alias("label"))
    near = nearest(y, most, own=True).join(deg.withColumnRenamed("node", "i"), "i").select("i", "j", "degree")
    return _kept(edges, near)


def _kept(edges: DataFrame, near: DataFrame) -> DataFrame:
    adj = both_directions(edges).select(F.col("u").alias("i"), F.col("v").alias("j"), F.lit(1).alias("edge"))
    per = near.join(adj, ["i", "j"], "left").groupBy("i", "degree").agg(F.count("edge").alias("m"))
    return per.agg(F.avg(F.col("m") / F.col("degree")).alias("neighborhood_preservation"))


def simple_graph(contacts: DataFrame) -> DataFrame:
    """``u, v, weight`` of a log of contacts ``i, j``: each pair once, with its number; self contacts are left out."""
    return contacts.filter("i <> j").groupBy(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).agg(F.count(F.lit(1)).alias("weight"))


def resistance(edges: DataFrame) -> DataFrame:
    """``i, j, d`` resistance distances of all pairs of a connected graph's nodes, by columns of the Laplacian's pseudo-inverse."""
    return all_pairs(edges)
