"""Members of zip and tar archives, and the GML, ARFF, XLSX and npy formats: files come through Spark's binary reader, so
any store that Spark opens will do; a file is one row and must fit a task."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unpack(name: str, content: bytes) -> list[tuple[str, bytes]]:
    """Members of a zip or (compressed) tar archive; any other file is its own member."""
    if zipfile.is_zipfile(io.BytesIO(content)) and not name.endswith(".xlsx"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            return [(m.name, t.extractfile(m).read()) for m in t if m.isfile()]
    except tarfile.ReadError:
        return [(name.rsplit("/", 1)[-1], content)]


def members(spark: SparkSession, path: str) -> DataFrame:
    """``archive, member, content`` of the archives under ``path``."""

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0), b.column(1)):
                for name, data in unpack(p.as_py(), c.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([p.as_py()]), pa.array([name]), pa.array([data], pa.binary())], names=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, content binary")


def lines(found: DataFrame, pattern: str, comment: str | None = None) -> DataFrame:
    """``value`` lines of the members whose name matches; comment lines and empty ones are left out."""
    v = found.filter(F.col("member").rlike(pattern)).select(F.explode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("value")).filter(F.trim("value") != "")
    return v.filter(~F.trim("value").startswith(comment)) if comment else v


def gml(text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    """Nodes (id, label or value) and edges of a GML graph."""
    tokens = re.findall(r'"[^"]*"|\[|\]|[^\s\[\]"]+', text)
    nodes, edges, k = [], [], 0

    def block():
        nonlocal k
        out: dict = {}
        while k < len(tokens) and tokens[k] != "]":
            key = tokens[k].lower()
            k += 1
            if tokens[k] == "[":
                k += 1
                inner = block()
                k += 1
                if key == "node":
                    nodes.append((int(inner["id"]), str(inner.get("value", inner.get("label", "")))))
                elif key == "edge":
                    edges.append((int(inner["source"]), int(inner["target"])))
            else:
                out[key] = tokens[k].strip('"')
                k += 1
        return out

    block()
    return nodes, edges


def arff(text: str) -> tuple[list[str], list[list[str | None]]]:
    """Attribute names and rows of a dense ARFF file; ``?`` is a null."""
    names, rows, data = [], [], False
    for line in text.splitlines():
        s = line.strip()
        if not s or s.startswith("%"):
            continue
        if data:
            rows.append([None if v.strip() == "?" else v.strip().strip("'\"") for v in s.split(",")])
        elif s.lower().startswith("@attribute"):
            names.append(re.match(r"@\w+\s+('[^']*'|\"[^\"]*\"|\S+)", s)[1].strip("'\""))
        elif s.lower().startswith("@data"):
            data = True
    return names, rows


def xlsx(content: bytes, sheet: int = 1) -> list[list[str | None]]:
    """Cell texts of a sheet, by its shared strings; missing cells are null."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    rows = []
    for row in (e for e in root.iter() if tag(e) == "row"):
        cells: dict[int, str | None] = {}
        for c in (e for e in row if tag(e) == "c"):
            letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            text = "".join(v.text or "" for v in c.iter() if tag(v) in ("v", "t"))
            cells[at - 1] = shared[int(text)] if c.get("t") == "s" else text or None
        rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows


def table_rows(found: DataFrame, pattern: str) -> DataFrame:
    """``member, row, cells`` of ARFF and XLSX members: cells are a map of column names to texts.

    An ARFF member names its columns; the first row of a sheet does.
    """

    def run(batches):
        for b in batches:
            for m, c in zip(b.column(0).to_pylist(), b.column(1)):
                if m.endswith(".xlsx"):
                    rows = xlsx(c.as_py())
                    names, rows = ([str(x) for x in rows[0]], rows[1:]) if rows else ([], [])
                else:
                    names, rows = arff(c.as_py().decode())
                cells = [[(n, v) for n, v in zip(names, r)] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(cells, pa.map_(pa.string(), pa.string()))], names=["member", "row", "cells"])

    return found.filter(F.col("member").rlike(pattern)).select("member", "content").mapInArrow(run, "member string, row long, cells map<string,string>")


def npz_arrays(found: DataFrame) -> DataFrame:
    """``member, name, id, x`` of the one- and two-dimensional arrays of npz members."""

    def run(batches):
        for b in batches:
            for m, c in zip(b.column(0).to_pylist(), b.column(1)):
                with np.load(io.BytesIO(c.as_py()), allow_pickle=False) as z:
                    for name in z.files:
                        a = np.atleast_2d(z[name].astype(np.float64).T).T
                        yield pa.RecordBatch.from_arrays([pa.array([m] * len(a)), pa.array([name] * len(a)), pa.array(np.arange(len(a))), pa.array(a.tolist(), pa.list_(pa.float64()))], names=["member", "name", "id", "x"])

    return found.filter(F.col("member").endswith(".npz")).select("member", "content").mapInArrow(run, "member string, name string, id long, x array<double>")


def npy_points(found: DataFrame) -> DataFrame:
    """``member, id, x`` of two-dimensional npy arrays."""

    def run(batches):
        for b in batches:
            for m, c in zip(b.column(0), b.column(1)):
                a = np.load(io.BytesIO(c.as_py()), allow_pickle=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([m.as_py()] * len(a)), pa.array(np.arange(len(a))), pa.array(a.tolist(), pa.list_(pa.float64()))], names=["member", "id", "x"])

    return found.filter(F.col("member").endswith(".npy")).select("member", "content").mapInArrow(run, "member string, id long, x array<double>")


def gml_graph(spark: SparkSession, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``member, node, label`` and the simple edges ``member, u, v`` of GML members."""

    def run(batches):
        for b in batches:
            for m, c in zip(b.column(0), b.column(1)):
                nodes, edges = gml(c.as_py().decode())
                rows = [("n", i, None, v) for i, v in nodes] + [("e", *e, None) for e in edges]
                cols = list(zip(*rows)) or [()] * 4
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([m.as_py()] * len(rows)), *(pa.array(x, t) for x, t in zip(cols, kinds))], names=["member", "kind", "a", "b", "label"])

    both = found.filter(F.col("member").endswith(".gml")).select("member", "content").mapInArrow(run, "member string, kind string, a long, b long, label string")
    nodes = both.filter("kind = 'n'").select("member", F.col("a").alias("node"), "label")
    return nodes, both.filter("kind = 'e' and a <> b").select("member", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
