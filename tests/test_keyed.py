"""Keyed table: whole writes, retries, writes that are killed, fail in a task, or meet another."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairloom.sources import keyed

ROOT = Path(__file__).parent.parent


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, s string, v double").repartition(3)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_keys_once_over_overlapping_writes_and_retries(spark, tmp_path):
    p = str(tmp_path / "t")
    first = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (2, "a", None), (2, "a", 3.0)]
    keyed.append(table(spark, first), p, ["k", "s"], "one")
    want = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", None)]
    assert content(keyed.read(spark, p)) == sorted(want, key=str)
    again = keyed.append(table(spark, [(9, "z", 0.0)]), p, ["k", "s"], "one")  # a name that is known
    assert content(again) == sorted(want, key=str)
    more = keyed.append(table(spark, [(1, "a", 7.0), (3, "c", 4.0)]).select("v", "s", "k"), p, ["k", "s"], "two")
    assert content(more) == sorted([*want, (3, "c", 4.0)], key=str)
    over = keyed.append(table(spark, [(5, "x", 5.0)]), p, ["k", "s"], "three", overwrite=True)
    assert content(over) == [(5, "x", 5.0)]
    assert keyed.swept(spark, p) > 0 and keyed.swept(spark, p) == 0 and content(keyed.read(spark, p)) == [(5, "x", 5.0)]


def test_a_task_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    p = str(tmp_path / "t")
    keyed.append(table(spark, [(1, "a", 1.0)]), p, ["k"], "one")
    bad = spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("s"), F.when(F.col("id") == 150, F.raise_error(F.lit("broken")).cast("double")).otherwise(1.0).alias("v"))
    with pytest.raises(Exception, match="broken"):
        keyed.append(bad, p, ["k"], "two")
    with pytest.raises(Exception, match="k is null"):
        keyed.append(table(spark, [(None, "a", 1.0), (4, "a", 1.0)]), p, ["k"], "three")
    assert content(keyed.read(spark, p)) == [(1, "a", 1.0)]
    good = keyed.append(spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("s"), F.lit(2.0).alias("v")), p, ["k"], "two")
    assert good.count() == 200 and good.select("k").distinct().count() == 200


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from pairloom.sources import keyed
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
def stop(self, messages):
    os._exit(3)  # all tasks have written, the manifest hasn't
if sys.argv[2] == "kill":
    keyed._Writer.commit = stop
    keyed._Writer.abort = lambda self, messages: None  # a driver that is killed clears nothing up
try:
    keyed.append(spark.range(100).selectExpr("id AS k", "'x' AS s", "1D AS v"), sys.argv[1], ["k"], "one")
except Exception:
    os._exit(9)
os._exit(0)
"""


def test_a_killed_and_repeated_write_leaves_each_key_once(spark, tmp_path):
    p = str(tmp_path / "t")
    run = lambda how: subprocess.run([sys.executable, "-c", KILLED, p, how], cwd=ROOT, capture_output=True, timeout=120).returncode
    assert run("kill") == 9
    left = len(list((tmp_path / "t/files").glob("*.parquet")))
    assert left > 0
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, p)
    assert run("go") == 0 and run("go") == 0
    got = keyed.read(spark, p)
    assert got.count() == 100 and got.select("k").distinct().count() == 100
    assert keyed.swept(spark, p) >= left and keyed.read(spark, p).count() == 100


def test_a_write_in_between_is_noticed(spark, tmp_path):
    """A writer planned on the first manifest commits after the second."""
    p = str(tmp_path / "t")
    df = keyed.append(table(spark, [(1, "a", 1.0)]), p, ["k"], "one")
    late = keyed._Writer({"path": p, "write": "three", "base": "1"}, df.schema, False)
    message = late.write(iter(table(spark, [(3, "a", 1.0)]).toArrow().to_batches()))
    keyed.append(table(spark, [(2, "a", 1.0)]), p, ["k"], "two")
    with pytest.raises(RuntimeError, match="written meanwhile"):
        late.commit([message])
    assert content(keyed.read(spark, p)) == [(1, "a", 1.0), (2, "a", 1.0)]
    assert not (tmp_path / "t/files" / message.name).exists()
    known = keyed._Writer({"path": p, "write": "two", "base": "1"}, df.schema, False)  # its first commit was taken for lost
    known.commit([known.write(iter(table(spark, [(2, "a", 1.0)]).toArrow().to_batches()))])
    assert content(keyed.read(spark, p)) == [(1, "a", 1.0), (2, "a", 1.0)]


def test_columns_and_empty_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, p)
    assert content(keyed.append(table(spark, []), p, ["k"], "none")) == []
    keyed.append(table(spark, [(1, None, None)]), p, ["k"], "one")
    with pytest.raises(ValueError, match="differ"):
        keyed.append(table(spark, [(2, "a", 1.0)]).withColumn("more", F.lit(1)), p, ["k"], "two")
    only = keyed.append(spark.createDataFrame([(1,), (1,), (2,)], "k long"), str(tmp_path / "u"), ["k"], "one")
    assert content(only) == [(1,), (2,)]
    assert json.loads((tmp_path / "t/manifests/000000000002.json").read_text())["writes"] == ["none", "one"]
