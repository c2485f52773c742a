"""Point sets whose truth is known, as a table function that is joined laterally to a table of replicates.

A call gives one block of a replicate, at most ``BLOCK`` points, so that a replicate of any size is many tasks' work; what
all blocks of a replicate share, centres or a tree, follows from its seed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

BLOCK = 4096
SCENARIOS = ("centres", "tree", "sheet", "radii")
DEPTH, GROUPS = 3, 6


def tree_heights() -> list[float]:
    """Height at which points part whose paths first differ at a level; deeper is lower."""
    return [2.0**-level for level in range(DEPTH)]


def _block(scenario: str, n: int, seed: int, block: int):
    """``leaf, path, t, x`` of a block's points: group, branches from the root, true coordinates or radius, and the input."""
    ids = np.arange(block * BLOCK, min(n, (block + 1) * BLOCK))
    which = SCENARIOS.index(scenario)
    shared, own = np.random.default_rng([seed, which]), np.random.default_rng([seed, which, 1 + block])
    if scenario == "sheet":
        t = own.random((len(ids), 2)) * [2.0, 1.0]
        x = np.stack([np.sin(1.2 * t[:, 0]) / 1.2, t[:, 1], (1 - np.cos(1.2 * t[:, 0])) / 1.2], 1)
        return np.zeros(len(ids), int), np.zeros((len(ids), 0), int), t, x
    if scenario == "tree":
        leaf = ids % 2**DEPTH
        path = (leaf[:, None] >> np.arange(DEPTH)[::-1]) & 1
        x = 0.05 * own.normal(size=(len(ids), 4))
        for level in range(DEPTH):  # each node has a place of its own, nearer to its parent the deeper it lies
            places = shared.normal(size=(2 ** (level + 1), 4)) * tree_heights()[level]
            x += places[leaf >> (DEPTH - 1 - level)]
        return leaf, path, np.zeros((len(ids), 0)), x
    leaf = ids % GROUPS
    centres = shared.normal(scale=10.0, size=(GROUPS, 2))
    spread = np.full(GROUPS, 0.5) if scenario == "centres" else 0.2 * 1.5 ** np.arange(GROUPS)
    x = np.concatenate([centres[leaf], np.zeros((len(ids), 2))], 1) + spread[leaf, None] * own.normal(size=(len(ids), 4))
    return leaf, np.zeros((len(ids), 0), int), centres[leaf] if scenario == "centres" else spread[leaf, None], x


class _Scenario:
    @staticmethod
    def analyze(scenario: AnalyzeArgument, n: AnalyzeArgument, seed: AnalyzeArgument, block: AnalyzeArgument) -> AnalyzeResult:
        """An unknown scenario that is given as a constant is an error of the plan, not of a task."""
        if scenario.isConstantExpression and scenario.value not in SCENARIOS:
            raise ValueError(f"no scenario {scenario.value!r}; there are {', '.join(SCENARIOS)}")
        doubles = ArrayType(DoubleType())
        return AnalyzeResult(StructType([StructField("id", LongType()), StructField("leaf", IntegerType()), StructField("path", ArrayType(IntegerType())), StructField("t", doubles), StructField("x", doubles)]))

    def eval(self, scenario, n, seed, block):
        if scenario not in SCENARIOS:
            raise ValueError(f"no scenario {scenario!r}; there are {', '.join(SCENARIOS)}")
        leaf, path, t, x = _block(scenario, int(n), int(seed), int(block))
        for k in range(len(leaf)):
            yield block * BLOCK + k, int(leaf[k]), path[k].tolist(), t[k].tolist(), x[k].tolist()


def scenario_points(replicates: DataFrame) -> DataFrame:
    """``replicate, scenario, n, id, leaf, path, t, x`` of all points of ``replicate, scenario, n, seed`` rows.

    Ids run from 0 to n - 1; a replicate of no points has no row; ``seed`` is 0 or more. Other columns are left aside.
    """
    points = udtf(_Scenario)
    blocks = replicates.select("replicate", "scenario", F.col("n").cast("long").alias("n"), F.col("seed").cast("long").alias("seed")).filter("n > 0")
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))))
    blocks = blocks.repartition("replicate", "block")
    call = points(F.col("scenario").outer(), F.col("n").outer(), F.col("seed").outer(), F.col("block").outer())
    return blocks.lateralJoin(call).select("replicate", "scenario", "n", "id", "leaf", "path", "t", "x")
