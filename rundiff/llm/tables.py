"""How the queries of this package read the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column has, for the names of helper columns."""
    prefix = "_h"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def only(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in columns])


def row_struct(key: Column, text: Column) -> Column:
    """What tells rows apart, in the order of their keys, nulls last: never null, equal for rows with equal key and text."""
    return F.struct(key.isNull().alias("missing"), key.alias("key"), F.xxhash64(text).alias("text"))
