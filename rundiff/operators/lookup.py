"""Joins whose both sides grow with the input.

The planner knows the size of a table from its files. Where a row grows to many lines, or many rows fit a small file, that
says little, and a side that does not fit the driver would be broadcast. These joins sort both sides instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)``, never by broadcast."""
    return left.join(right.hint("merge"), on, how)


def look_up(df: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df.join(found, keys, "left")`` by merge. ``keys[0]`` is a text; rows where it is NULL find nothing and are dealt out, not put in one task."""
    first, *rest = keys
    right = found.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    spread = F.coalesce(F.col(first), F.concat(F.lit("\0"), F.xxhash64(*[F.col(c) for c in df.columns]).cast("string")))
    same = (F.col("_spread") == F.col(f"_r_{first}")) & F.col(first).isNotNull()
    for k in rest:
        same = same & (F.col(k) == F.col(f"_r_{k}"))
    joined = merge_join(df.withColumn("_spread", spread), right, same, "left")
    return joined.select(*[F.col(k) for k in keys], *[F.col(c) for c in df.columns if c not in keys], *[F.col(c) for c in found.columns if c not in keys])
