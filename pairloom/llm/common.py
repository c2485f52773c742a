"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one Arrow batch handed to Python: bounds a worker's memory where texts are long. A longer text is a batch alone.
BATCH_BYTES = 16 << 20

#: Rows that one task should number or repeat.
TASK_ROWS = 100_000

_AT_EXIT: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark's own reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches, unless they are bounded more tightly already.

    Plans are lazy, so the bound has to stay for when they run. No result depends on it, and rows aren't limited.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    try:
        tight = 0 < int(now) <= BATCH_BYTES
    except (TypeError, ValueError):
        tight = False
    if not tight:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: one of this application's own in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local master; on a cluster it is an error. What is left of the folder
    is deleted when the driver ends.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pairloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/pairloom-{context.applicationId}"
    if path not in _AT_EXIT:
        _AT_EXIT.add(path)
        atexit.register(_delete_quietly, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the JVM may be gone by now  # noqa: BLE001
        pass


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage: what follows survives lost executors without computing ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that no later plan reads."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            _delete(df.sparkSession, name.rsplit("/", 1)[0])


#: Rows of a slim table that may be broadcast: about 100 MB as a hashed relation.
BROADCAST_ROWS = 2_000_000


def small_side(df: DataFrame) -> DataFrame:
    """``df``, a staged table of a few numbers a row, to be broadcast if its rows are few enough to be, by their count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def partitions_for(spark: SparkSession, amount: int, each: int) -> int:
    """Partitions that hold about ``each`` of ``amount``, not fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def chunks(n: Column | str, first: Column, most: int = TASK_ROWS) -> Column:
    """``[first, last]`` ranges of at most ``most`` that cover ``n`` numbers from ``first`` on; none where ``n`` is 0."""
    n = F.col(n) if isinstance(n, str) else n
    starts = F.when(n > 0, F.sequence(first, first + n - 1, F.lit(most).cast("long")))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + most - 1, first + n - 1).alias("last")))


def repeated(rows: DataFrame, n: str, name: str, first: Column | None = None, most: int = TASK_ROWS) -> DataFrame:
    """Each row ``n`` times, numbered in ``name`` from ``first`` (0) on; rows without a number of times go.

    A row that comes very often is cut into ranges first, and these are dealt to all tasks.
    """
    first = F.lit(0).cast("long") if first is None else first
    held = free_name(rows, "_range")
    cut = rows.withColumn(held, first)
    number = lambda lo, hi: F.explode(F.sequence(lo, hi))
    few = cut.filter(F.col(n).between(1, most)).withColumn(name, number(F.col(held), F.col(held) + F.col(n) - 1)).drop(held)
    many = cut.filter(F.col(n) > most).withColumn(held, F.explode(chunks(n, F.col(held), most)))
    many = many.repartition(F.xxhash64(F.col(f"{held}.first"), F.col(n))).withColumn(name, number(F.col(f"{held}.first"), F.col(f"{held}.last"))).drop(held)
    return few.unionByName(many)


def text_bytes(col: Column | str) -> Column:
    """UTF-8 bytes of a text; a null text counts as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.encode(F.coalesce(c, F.lit("")), "UTF-8")


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
