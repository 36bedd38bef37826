"""Scope filters, coverage guards and small set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope_rows(available: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Available rows in the wanted scope, plus the wanted keys that are missing."""
    keys = list(keys)
    found = available.join(wanted.select(*keys), keys, "left_semi").withColumn("missing", F.lit(False))
    absent = wanted.select(*keys).distinct().join(available, keys, "left_anti").withColumn("missing", F.lit(True))
    return found.unionByName(absent, allowMissingColumns=True)


def require_scope(available: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The scoped rows; raises when a wanted key is missing."""
    keys = list(keys)
    absent = wanted.select(*keys).distinct().join(available, keys, "left_anti").take(1)
    if absent:
        raise ValueError(f"Requested rows are missing, for example {absent[0].asDict()}")
    return available.join(wanted.select(*keys), keys, "left_semi")


def coverage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys the two sides do not share one to one: (keys, problem). Both sides
    are counted in one aggregation instead of two joins."""
    keys = list(keys)
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counted = sides.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    problem = (
        F.when(F.col("n_left") == 0, F.lit("missing_left"))
        .when(F.col("n_right") == 0, F.lit("missing_right"))
        .when((F.col("n_left") > 1) | (F.col("n_right") > 1), F.lit("duplicate"))
    )
    return counted.withColumn("problem", problem).filter("problem IS NOT NULL").select(
        *keys, "problem", "n_left", "n_right"
    )


def require_coverage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    bad = coverage(left, right, keys).take(1)
    if bad:
        raise ValueError(f"Row coverage differs, for example {bad[0].asDict()}")
