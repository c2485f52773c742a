"""The driver's tables in the engine's model, as DataFrames and as DuckDB's common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as geo
from ..operators import graphs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, x`` (input), ``y`` (a planar map), ``z`` (another), ``label``."""
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x"), F.slice(x, 1, 2).alias("y"), F.slice(x, 3, 2).alias("z"), "label")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.pairs(points(spark, sf_dir))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.ranks(pairs(spark, sf_dir))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(F.col("id").alias("node"), F.col("y")[0].alias("x"), F.col("y")[1].alias("y"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.knn_graph(points(spark, sf_dir), 3)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run, dataset, method, seed, status, v, cost``: orders as runs, a nation as a data set, a priority as a method."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select(
        F.col("o_orderkey").alias("run"), F.col("n_name").alias("dataset"), F.col("o_orderpriority").alias("method"), (F.col("o_orderkey") % 10).alias("seed"),
        F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("status"), F.col("o_totalprice").alias("v"), F.col("c_acctbal").alias("cost"), F.col("n_regionkey").alias("region"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, i``: users with an event in a minute."""
    e = table(spark, sf_dir, "events").select(F.floor(F.unix_timestamp("ts") / 60).alias("m"), F.col("user_id").alias("i")).distinct()
    return e.select((F.col("m") * 60).alias("t"), "i")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, i, j``: users with an event in the same minute."""
    e = visits(spark, sf_dir)
    return e.join(e.select("t", F.col("i").alias("j")), "t").filter("i < j").select("t", "i", "j")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, node, x, y``: per day, each user's mean value and number of events."""
    e = table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("t"), F.col("user_id").alias("node"))
    return e.agg(F.avg("value").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))


POINTS = "points AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
PAIRS = POINTS + ", pairs AS (SELECT a.id i, b.id j, list_distance(a.x, b.x) d_hi, sqrt((a.x[1]-b.x[1])**2 + (a.x[2]-b.x[2])**2) d_lo, a.label ci, b.label cj FROM points a JOIN points b ON a.id < b.id)"
BOTH = PAIRS + ", both_ways AS (SELECT i, j, d_hi, d_lo, ci, cj FROM pairs UNION ALL SELECT j, i, d_hi, d_lo, cj, ci FROM pairs)"
RANKS = BOTH + ", ranks AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d_hi, j) r, row_number() OVER (PARTITION BY i ORDER BY d_lo, j) q FROM both_ways)"
EDGES = RANKS + ", edges AS (SELECT DISTINCT least(i, j) u, greatest(i, j) v FROM ranks WHERE r <= 3), layout AS (SELECT id AS node, x[1] AS px, x[2] AS py FROM points)"
RUNS = """runs AS (SELECT o_orderkey run, n_name dataset, o_orderpriority "method", o_orderkey % 10 seed, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'ok' END status,
 o_totalprice v, c_acctbal cost, n_regionkey region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
MEDIANS = RUNS + """, wide AS (SELECT dataset, "method", median(v) v FROM runs WHERE status = 'ok' AND v IS NOT NULL GROUP BY ALL)
, costs AS (SELECT dataset, "method", median(cost) v FROM runs WHERE status = 'ok' AND cost IS NOT NULL GROUP BY ALL)"""
CONTACTS = "e AS (SELECT DISTINCT floor(epoch(ts) / 60)::BIGINT m, user_id i FROM events), contacts AS (SELECT a.m * 60 t, a.i, b.i j FROM e a JOIN e b ON a.m = b.m AND a.i < b.i)"
POSITIONS = "positions AS (SELECT day(ts) t, user_id node, avg(value) x, count(*)::DOUBLE y FROM events GROUP BY ALL)"
