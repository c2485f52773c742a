"""A table of keyed rows whose every write is whole or not there at all.

Tasks write files under names of their own; a write counts from the moment its manifest, a list of files, takes its place.
Readers follow the last manifest, so files of tasks that failed, of attempts made twice and of drivers that were killed are
never read; ``swept`` deletes them. A write has a name, and a name that a manifest holds already changes nothing, so a retry
is safe at any time; rows whose key is in the table already are left out. One writer at a time is meant: a second that
committed in between is noticed by the manifest's number, and the later write fails without a trace.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "keyed_table"


@dataclass
class _File(WriterCommitMessage):
    name: str
    rows: int


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """A folder's file system; a path without a scheme is one of the machine's own file system, shared or not."""
    fs, root = pafs.FileSystem.from_uri(path)
    return fs, root.rstrip("/")


def _latest(fs: pafs.FileSystem, root: str) -> dict:
    """The last manifest: its number, the schema, the files and the names of the writes; number 0 without one."""
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/manifests", allow_not_found=True)) if f.base_name.endswith(".json")]
    if not found:
        return {"number": 0, "schema": None, "files": [], "writes": []}
    with fs.open_input_stream(max(found)) as f:
        return json.loads(f.read())


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.write_name, self.base = options["path"], options["write"], int(options["base"])
        self.schema, self.overwrite = schema.json(), overwrite

    def write(self, iterator) -> _File:
        """Streams one task's rows to one file; the name is new in every attempt."""
        fs, root = _place(self.path)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                out = out or pq.ParquetWriter(f"{root}/files/{name}", batch.schema, filesystem=fs)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out:
                out.close()
        return _File(name if rows else "", rows)

    def commit(self, messages) -> None:
        fs, root = _place(self.path)
        last = _latest(fs, root)
        if self.write_name in last["writes"]:
            return self.abort(messages)
        target = f"{root}/manifests/{self.base + 1:012d}.json"
        if last["number"] != self.base or fs.get_file_info(target).type != pafs.FileType.NotFound:
            self.abort(messages)
            raise RuntimeError(f"the table was written meanwhile: manifest {last['number']} instead of {self.base}")
        files = [] if self.overwrite else last["files"]
        new = {"number": self.base + 1, "schema": self.schema, "files": files + sorted(m.name for m in messages if m and m.rows), "writes": last["writes"] + [self.write_name]}
        beside = f"{root}/manifests/{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(beside) as f:
            f.write(json.dumps(new).encode())
        fs.move(beside, target)  # the one step by which the write takes effect

    def abort(self, messages) -> None:
        fs, root = _place(self.path)
        for m in messages:
            if m and m.rows:
                fs.delete_file(f"{root}/files/{m.name}")


class KeyedTable(DataSource):
    """The writing side; reading is Spark's own Parquet reader over the files of the last manifest."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema, overwrite)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last manifest; filters and columns reach the files. A table never written is an error."""
    fs, root = _place(path)
    last = _latest(fs, root)
    if last["schema"] is None:
        raise FileNotFoundError(f"no keyed table at {path}")
    schema = StructType.fromJson(json.loads(last["schema"]))
    if not last["files"]:
        return spark.createDataFrame([], schema)
    base = path if ":" in path else f"file://{path}"  # the place that ``_place`` means, whatever Spark's default file system
    return spark.read.schema(schema).parquet(*[f"{base.rstrip('/')}/files/{f}" for f in last["files"]])


def append(df: DataFrame, path: str, keys: list[str], write: str, overwrite: bool = False) -> DataFrame:
    """Adds those rows whose key isn't in the table yet, all of them or none, and gives the table as it is then.

    Of rows of one key the first by all other columns stays, nulls first; a null in a key is an error, before anything is
    visible. Columns must be those of the table, in any order. A ``write`` that the table knows changes nothing. With
    ``overwrite`` the rows take the place of all others. Columns that can't be ordered, such as maps, are an error.
    """
    spark = df.sparkSession
    fs, root = _place(path)
    last = _latest(fs, root)
    if write in last["writes"]:
        return read(spark, path)
    for part in ("files", "manifests"):
        fs.create_dir(f"{root}/{part}", recursive=True)
    if last["schema"]:
        columns = StructType.fromJson(json.loads(last["schema"])).names
        if gap := set(columns) ^ set(df.columns):
            raise ValueError(f"columns differ: {sorted(gap)}")
        df = df.select(*columns)
    types = {f.name: f.dataType for f in df.schema}
    for k in keys:
        df = df.withColumn(k, F.coalesce(F.col(k), F.raise_error(F.lit(f"{k} is null")).cast(types[k])))
    others = [c for c in df.columns if c not in keys]
    # One row a key by a mergeable minimum: rows of a hot key are reduced before they meet.
    if others:
        df = df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row")).select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])
    else:
        df = df.distinct()
    if last["files"] and not overwrite:
        df = df.join(read(spark, path).select(*keys), keys, "left_anti").select(*df.columns)
    spark.dataSource.register(KeyedTable)
    df.write.format(FORMAT).mode("overwrite" if overwrite else "append").options(path=path, write=write, base=last["number"]).save()
    return read(spark, path)


def swept(spark: SparkSession, path: str) -> int:
    """Deletes files and manifests that the last manifest doesn't need, gives how many; no write or read may be under way."""
    fs, root = _place(path)
    last = _latest(fs, root)
    needed = {*last["files"], f"{last['number']:012d}.json"}
    gone = [f.path for part in ("files", "manifests") for f in fs.get_file_info(pafs.FileSelector(f"{root}/{part}", allow_not_found=True)) if f.base_name not in needed]
    for p in gone:
        fs.delete_file(p)
    return len(gone)
