"""Readers of contact logs, edge lists, result tables and rules; compressed text is read by Spark as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType


def contact_log(spark: SparkSession, path: str, order: str = "t i j") -> DataFrame:
    """``t, i, j`` (and the two groups of a five-column log) from white-space separated lines in the stated order."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "").select(parts.alias("p"))
    columns = [F.col("p")[k].cast("long").alias(n) for k, n in enumerate(order.split())]
    return lines.select(*columns, F.try_element_at("p", F.lit(4)).alias("ci"), F.try_element_at("p", F.lit(5)).alias("cj")).select("t", "i", "j", "ci", "cj")


def labelled(contacts: DataFrame, labels: DataFrame) -> DataFrame:
    """Contacts with the groups of both ends from ``node, label``; a node without a label is an error at run time."""
    a, b = labels.select(F.col("node").alias("i"), F.col("label").alias("ci")), labels.select(F.col("node").alias("j"), F.col("label").alias("cj"))
    joined = contacts.select("t", "i", "j").join(a, "i", "left").join(b, "j", "left")
    must = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("a node has no label")).cast("string")).alias(c)
    return joined.select("t", "i", "j", must("ci"), must("cj"))


def edge_list(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """``u < v`` edges of a white-space separated list: comments, loops and repeats are left out."""
    return edges_of(spark.read.text(path), comment)


def edges_of(lines: DataFrame, comment: str = "#") -> DataFrame:
    """``u < v`` edges of ``value`` lines, as of a file or of an archive's member."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    e = lines.filter(~F.trim("value").startswith(comment) & (F.trim("value") != ""))
    e = e.select(parts[0].cast("long").alias("a"), parts[1].cast("long").alias("b")).filter("a <> b")
    return e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def citation_graph(content: DataFrame, cites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node, label`` and the edges ``u, v`` both of whose ends are known."""
    nodes = content.select("node", "label")
    known = nodes.select("node")
    e = cites.join(known, cites["u"] == known["node"], "left_semi").join(known, cites["v"] == known["node"], "left_semi")
    return nodes, e.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def node_labels(lines: DataFrame, comment: str = "#") -> DataFrame:
    """``node, label`` of white-space separated lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.filter(~F.trim("value").startswith(comment) & (F.trim("value") != "")).select(parts[0].cast("long").alias("node"), parts[1].alias("label"))


def labelled_graph(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node, label`` and the edges both of whose ends have a label."""
    return citation_graph(labels, edges)


def read_citations(content: DataFrame, cites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The citation graph of two sets of ``value`` lines: node, features and class by tabs, and pairs of nodes."""
    fields = F.split("value", "\t")
    nodes = content.filter(F.trim("value") != "").select(fields[0].cast("long").alias("node"), F.element_at(fields, -1).alias("label"))
    pair = F.split(F.trim("value"), r"\s+")
    return citation_graph(nodes, cites.filter(F.trim("value") != "").select(pair[0].cast("long").alias("u"), pair[1].cast("long").alias("v")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``name, url, sha256, bytes`` entries of JSON manifests, one array or one object a line."""
    return spark.read.schema("name string, url string, sha256 string, bytes long").option("multiLine", True).json(path)


def verified_files(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """``name, ok``: whether each file of a manifest is there with its digest; files come through Spark's binary reader."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return entries.join(found, "name", "left").select("name", F.coalesce(F.lower("sha256") == F.col("digest"), F.lit(False)).alias("ok"))


def results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A results CSV by an explicit schema; NaN becomes NULL and a file without the columns is an error."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if isinstance(f.dataType, DoubleType) else F.col(c) for f in schema for c in [f.name]])


def rule(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "rule")
