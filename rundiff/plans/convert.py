"""Split a table, write its parts as CSV and JSON, and list what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rundiff.functions.text import safe_value_name
from rundiff.operators.split import row_part_name, section_part_name, split_table
from rundiff.session import cut_lineage
from rundiff.sinks.json import file_key, json_record
from rundiff.sinks.parts import part_key, write_parts, written_manifest

# The columns that tell parts apart, per split method.
PART_COLUMNS = {
    "rows": "part_id",
    "size": "part_id",
    "column": "group_value",
    "hierarchical": "section_id",
    "brute_force": "section_id",
}
_HELPERS = ["part_id", "rows_per_part", "group_value", "group_name", "section_id", "heading"]


def split_parts(df: DataFrame, method: str = "rows", **options) -> DataFrame:
    """A split table with ``part``, a folder name that is different for each part, and ``file`` where there are files."""
    parts = split_table(df, method, **options)
    parts = parts.withColumn("part", part_key(F.col(PART_COLUMNS[method])))
    return parts.withColumn("file", file_key(F.col("file_id"))) if "file_id" in df.columns else parts


def part_records(parts: DataFrame) -> DataFrame:
    """Rows of a split table as JSON records with their file, part and position."""
    where = [c for c in ("file", "part") if c in parts.columns]
    data = [c for c in parts.columns if c not in {*where, *_HELPERS, "file_id", "row_idx"}]
    return parts.select(*where, "row_idx", json_record(data).alias("record"))


def _file_name(method: str, prefix: str) -> Column:
    """The name a part would have as one file."""
    if method == "column":
        value = F.coalesce(F.nullif(F.min("group_value"), F.lit("")), F.lit("empty"))
        return F.concat(F.lit(f"{prefix}_"), safe_value_name(value), F.lit(".csv"))
    if method in ("hierarchical", "brute_force"):
        return section_part_name(prefix, F.min("section_id"), F.min("heading"), method)
    return row_part_name(prefix, F.min("part_id"), F.min("row_idx") + 1, F.max("row_idx") + 1)


def split_and_convert(
    df: DataFrame, folder: str, method: str = "rows", convert: bool = True, prefix: str = "split", **options
) -> DataFrame:
    """Split, write CSV parts (and JSON records per part), and return the manifest of the parts.

    A part is one folder below ``csv`` (and ``json``), by file and by the number or the value that
    defines it, never by a shortened name. The manifest numbers the parts of a file from 1 in the order of their
    first rows and has the safe file name of each.
    """
    parts = cut_lineage(split_parts(df, method, **options))
    where = [c for c in ("file", "part") if c in parts.columns]
    data = parts.drop("file_id", *[c for c in _HELPERS if c not in df.columns])
    write_parts(data, where, f"{folder}/csv")
    if convert:
        records = part_records(parts).hint("rebalance", *where).sortWithinPartitions(*where, "row_idx")
        records.select(*where, F.col("record").alias("value")).write.mode("overwrite").partitionBy(*where).text(
            f"{folder}/json"
        )
    names = parts.groupBy(*where).agg(_file_name(method, prefix).alias("filename"), F.min("row_idx").alias("_first"))
    manifest = written_manifest(data, where, f"{folder}/csv").drop("filename").join(names, where)
    number = F.row_number().over(Window.partitionBy(*[c for c in where if c == "file"]).orderBy("_first"))
    return manifest.withColumn("part_no", number).drop("_first")
