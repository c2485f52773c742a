"""Tables written out between the rounds of a loop, so that plans stay short and lost executors cost one round."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_AT_EXIT: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """This application's folder in the shared checkpoint folder; a local one only on a local master. It goes with the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pairloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/loops-{spark.sparkContext.applicationId}"
    if path not in _AT_EXIT:
        _AT_EXIT.add(path)
        atexit.register(_quietly, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the JVM may be gone by now  # noqa: BLE001
        pass


def scratch(spark: SparkSession) -> str:
    """A new path in this application's shared folder, for a table of a query's own."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes a round of a fix-point loop to the shared checkpoint folder and reads it back."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loop_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that ``cut_lineage`` wrote and that no later plan reads; others stay as they are."""
    for df in tables:
        if path := getattr(df, "_loop_path", None):
            _delete(df.sparkSession, path)
