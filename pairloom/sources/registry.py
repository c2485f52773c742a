"""Named data sets: a registry of functions from a session to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOADERS: dict[str, Callable[..., DataFrame]] = {}


def dataset(name: str):
    """Registers a loader under a name; a name is taken once."""

    def keep(f):
        if name in _LOADERS:
            raise ValueError(f"{name} is registered already")
        _LOADERS[name] = f
        return f

    return keep


def names() -> list[str]:
    return sorted(_LOADERS)


def load(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in _LOADERS:
        raise KeyError(f"no data set {name!r}; there are {', '.join(names())}")
    return _LOADERS[name](spark, **options)
