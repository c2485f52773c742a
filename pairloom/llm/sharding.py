"""Jump consistent hashing of stable keys to shards.

The shard of a row follows from its key and the number of shards alone: no ring table, no state. When one shard is
appended, a row either stays or moves into the new shard; about 1/(n+1) of the rows move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TASK_ROWS, free_name, repeated, staged, text_bytes

#: The multiplier of the published linear congruential step (Lamping and Veach, 2014). Fixed value.
STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys, all keys at a time; about ln(shards) rounds."""
    state = keys.astype(np.uint64, copy=True)
    at = np.full(len(state), -1, dtype=np.int64)
    nxt = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = nxt[live]
        state[live] = state[live] * np.uint64(STEP) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[nxt[live] < shards]
    return at


def stable_key(id_col: Column) -> Column:
    """A key of 60 bits from the id's text, the same in every engine and run; a null id counts as the text 'null'."""
    text = F.coalesce(id_col.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("long")


def jump_column(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def to_shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return to_shard(key)


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with its shard in the column ``name`` (underscores are added if that name is taken); no shuffle.

    Rows with equal ids, null ids included, share a shard. An empty table gives an empty table.
    """
    return docs.withColumn(free_name(docs, name), jump_column(stable_key(F.col(id_col)), shards))


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Writes ``docs`` as one folder per shard; a shard is cut into files of at most ``rows_per_file`` rows."""
    out = assign_shards(docs, shards, id_col, "shard")
    out.write.option("maxRecordsPerFile", rows_per_file).partitionBy(out.columns[-1]).parquet(path)


def _numbered(rows: DataFrame, keys: list[str], mark: str, n: str, total: int, rows_per_range: int) -> DataFrame:
    """``rows`` with ``_first``: within ``keys`` the number of rows before it, each row standing for ``n``.

    Ranges of ``mark``, a hash of the whole row, hold about ``rows_per_range`` rows each; places within a range come from a
    window, those of earlier ranges are counted beforehand. Different rows of one hot key part by their marks.
    """
    ranges = max(1, -(-total // rows_per_range))
    dealt = rows.withColumn("_part", F.floor((F.col(mark) / F.lit(2.0**64) + 0.5) * ranges).cast("long"))
    held = dealt.groupBy(*keys, "_part").agg(F.sum(n).alias("_held"))
    before = held.select(*keys, "_part", (F.sum("_held").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_held")).alias("_before"))
    near = Window.partitionBy(*keys, "_part").orderBy(mark, *[c for c in rows.columns if c not in (*keys, mark, n)])
    placed = dealt.withColumn("_upto", F.sum(n).over(near)).join(before, [*keys, "_part"])
    return placed.withColumn("_first", F.col("_before") + F.col("_upto") - F.col(n)).drop("_part", "_upto", "_before")


def slots(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = TASK_ROWS) -> DataFrame:
    """Every row's place: ``id, size, text_crc32, law, shard, slot, grown_shard``, by the law ``key``.

    ``size`` is the text's UTF-8 bytes plus 16 (a null text has no bytes). ``slot`` counts from 0 without gaps in each
    shard, in the order of a hash of (id, size, crc32). Equal rows (same id, size and crc32) are counted before the
    shuffle and get consecutive slots; texts are read once.
    """
    raw = text_bytes(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = staged(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("key", stable_key(F.col("doc_id"))), "shard-rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    rows = rows.withColumn("shard", jump_column(F.col("key"), shards)).withColumn("grown_shard", jump_column(F.col("key"), shards + 1))
    rows = rows.withColumn("mark", F.xxhash64("doc_id", "size", "text_crc32")).drop("key")
    placed = repeated(_numbered(rows, ["shard"], "mark", "n", total, shards * rows_per_range), "n", "slot", F.col("_first"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def sharded(docs: DataFrame, shards: int, id_col: str = "doc_id", rows_per_range: int = TASK_ROWS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (underscores are added if those names are taken), by the law ``key``.

    Rows that are equal in all columns are counted before they move and get consecutive slots.
    """
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    plain = [f"c{k}" for k in range(len(docs.columns))]
    key = f"c{docs.columns.index(id_col)}"
    rows = docs.toDF(*plain).groupBy(*plain).agg(F.count(F.lit(1)).alias("_n")).withColumn("_mark", F.xxhash64(*plain))
    rows = staged(rows.withColumn("_shard", jump_column(stable_key(F.col(key)), shards)), "shard-texts")
    total = rows.agg(F.sum("_n")).first()[0] or 0
    slim = _numbered(rows.select("_shard", "_mark", "_n"), ["_shard"], "_mark", "_n", total, shards * rows_per_range)
    whole = rows.join(slim.select("_shard", "_mark", "_first"), ["_shard", "_mark"])
    placed = repeated(whole, "_n", "_slot", F.col("_first"))
    return placed.select(*plain, "_shard", "_slot").toDF(*docs.columns, shard, slot)
