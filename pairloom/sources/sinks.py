"""Sinks: keyed appends, guarded overwrites, clean-ups and the trace of a finished run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_schema(df: DataFrame, wanted: list[str]) -> None:
    """Missing or additional columns are an error before anything is written."""
    if gap := set(wanted) ^ set(df.columns):
        raise ValueError(f"columns differ: {sorted(gap)}")


def append(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends rows; a null key is an error in the job that writes."""
    for k in keys:
        df = df.withColumn(k, F.coalesce(F.col(k), F.raise_error(F.lit(f"{k} is null")).cast(df.schema[k].dataType)))
    df.write.mode("append").parquet(path)


def finalize(df: DataFrame, expected: DataFrame, keys: list[str], path: str) -> str:
    """Overwrites ``path`` if every expected key is covered, else writes beside it; gives the path written."""
    missing = expected.select(*keys).join(df.select(*keys).distinct(), keys, "left_anti").count()
    target = path if not missing else f"{path}_partial"
    df.write.mode("overwrite").parquet(target)
    return target


def without(df: DataFrame, **values: list) -> DataFrame:
    """Removes rows that match every given column, any of a column's values."""
    hit = F.lit(bool(values))
    for c, v in values.items():
        hit = hit & F.coalesce(F.col(c).isin(v), F.lit(False))
    return df.filter(~hit)


def corrupted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a null key."""
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(k).isNull()
    return df.filter(bad)


def done(df: DataFrame) -> DataFrame:
    """Rows by status."""
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def trajectories(embeddings: DataFrame) -> DataFrame:
    """``dataset, t, node, x, y`` from one row per snapshot with arrays of nodes and positions."""
    e = embeddings.select("dataset", "t", F.posexplode("positions").alias("k", "p"), "nodes")
    return e.select("dataset", "t", F.element_at("nodes", F.col("k") + 1).alias("node"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def disjoint_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both; a key that both have is an error when the rows are read."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys)
    mixed = F.min("_side").over(w) != F.max("_side").over(w)
    return both.withColumn("_mixed", F.when(mixed, F.raise_error(F.lit(f"both tables have a key of {keys}")).cast("boolean")).otherwise(F.lit(False))).filter(~F.col("_mixed")).drop("_side", "_mixed")


def save_maps(maps: DataFrame, path: str) -> None:
    """Appends ``experiment, dataset, method, seed, id, y`` rows, in a folder an experiment and data set."""
    maps.write.mode("append").partitionBy("experiment", "dataset").parquet(path)


def failures(df: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` failed rows by dataset, method and seed, as a finished run's trace lists them."""
    return df.filter("status <> 'ok'").orderBy("dataset", "method", "seed").limit(n)


def clean_errors(df: DataFrame, path: str, backup: str) -> int:
    """Writes the whole table to ``backup``, then the rows without an error to ``path``; gives how many went."""
    df.write.mode("errorifexists").parquet(backup)
    whole = df.sparkSession.read.parquet(backup)
    kept = whole.filter(F.coalesce(F.col("status") != "error", F.lit(True)))
    kept.write.mode("overwrite").parquet(path)
    return whole.count() - kept.count()


def repaired(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are all there; of rows with equal keys the last by all columns stays."""
    whole = df.dropna("any", subset=keys)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in df.columns if c not in keys] or [F.lit(0)]))
    return whole.withColumn("_p", last).filter("_p = 1").drop("_p")


#: Modes of a run, each with a folder of its own. Fixed values.
MODES = ("full", "quick", "smoke")


def mode_path(base: str, mode: str) -> str:
    """The folder of a mode below ``base``; an unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return f"{base.rstrip('/')}/{mode}"


def cached(key: str, make, base: str, spark) -> DataFrame:
    """The table that ``make()`` gives, written once under the key of its content and read again from then on."""
    path = f"{base.rstrip('/')}/{key}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def macros(df: DataFrame, name: str, value: str, source: str) -> DataFrame:
    """``name, value, source`` lines of a report's numbers; a name that comes twice is an error when they are read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(name))
    once = F.when(n == 1, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("number named twice: "), F.col(name))).cast("string"))
    return df.select(once.alias("name"), F.col(value).alias("value"), F.lit(source).alias("source"))
