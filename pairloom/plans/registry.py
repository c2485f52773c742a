"""How a named query is registered, and the form results are given in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, ShortType

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def tidy(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show, and no negative zero; whole numbers as longs. Without
    ``digits`` doubles stay: they are rounded where they are made."""
    kinds = {f.name: f.dataType for f in df.schema}
    as_given = lambda c: (F.round(F.col(c), digits) + 0.0).alias(c) if isinstance(kinds[c], DoubleType) and digits is not None else F.col(c).cast("long").alias(c) if isinstance(kinds[c], IntegerType | ShortType) else F.col(c)
    return df.select(*[as_given(c) for c in df.columns])


def query(name: str, sql: str | None = None, digits: int | None = 6):
    """Registers ``f(spark, sf_dir)`` as a query, with its DuckDB SQL if that can express it."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir), digits)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep
