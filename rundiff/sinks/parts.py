"""Split parts written as CSV, and the manifest of what was written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rundiff.functions.numbers import rounded

_LONGEST_KEY = 60  # characters of a value that names a folder; a longer one is named by its hash


def part_key(value: Column) -> Column:
    """A folder name for a value: different for different values, also for NULL and for the empty text."""
    text = value.cast("string")
    coded = F.translate(F.replace(F.replace(F.url_encode(text), F.lit("_"), F.lit("%5F")), F.lit("*"), F.lit("%2A")), "%", "_")
    hashed = F.concat(F.lit("h"), F.sha2(text.cast("binary"), 256))
    return F.when(value.isNull(), "n").when(F.length(text) > _LONGEST_KEY, hashed).otherwise(F.concat(F.lit("v"), coded))


def write_parts(parts: DataFrame, part_columns: Sequence[str], folder: str, order: str = "row_idx") -> None:
    """One folder per part with CSV files that carry the header, rows in order.

    The rebalance hint groups a part into few files, and lets adaptive execution split a
    part that is too large for one task.
    """
    order_columns = [order] if order in parts.columns else []
    placed = parts.hint("rebalance", *part_columns).sortWithinPartitions(*part_columns, *order_columns)
    placed.drop(*order_columns).write.mode("overwrite").partitionBy(*part_columns).option("header", True).csv(folder)


def written_sizes(spark: SparkSession, folder: str, part_columns: Sequence[str]) -> DataFrame:
    """Bytes and files per written part, from the file index; no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder)
    parts = [F.regexp_extract("path", f"/{c}=([^/]*)/", 1).alias(c) for c in part_columns]
    sized = listed.select("path", "length", *parts)
    place = F.regexp_replace(F.min("path"), "/[^/]*$", "")
    return sized.groupBy(*part_columns).agg(F.sum("length").alias("file_size_bytes"), F.count("*").alias("files"), place.alias("file_path"))


def written_manifest(parts: DataFrame, part_columns: Sequence[str], folder: str, filename: Column | None = None) -> DataFrame:
    """Every written part: its columns, file name, path, bytes, MB, rows and columns.

    Rows are counted in the split table, so text with line breaks and rows of NULL count as what
    they are; bytes are those of the files. ``filename`` may use ``row_count``, ``first_row`` and ``last_row``.
    """
    data = [c for c in parts.columns if c not in {*part_columns, "row_idx"}]
    counts = parts.groupBy(*part_columns).agg(
        F.count("*").alias("row_count"), (F.min("row_idx") + 1).alias("first_row"), (F.max("row_idx") + 1).alias("last_row")
    )
    sizes = written_sizes(parts.sparkSession, folder, part_columns)
    same = [counts[c].cast("string") == sizes[c] for c in part_columns]
    joined = counts.join(sizes, same).drop(*[sizes[c] for c in part_columns])
    name = filename if filename is not None else F.substring_index("file_path", "/", -1)
    return joined.select(
        *part_columns,
        name.alias("filename"),
        "file_path",
        "file_size_bytes",
        rounded(F.col("file_size_bytes") / (1024 * 1024)).alias("file_size_mb"),
        "row_count",
        "first_row",
        "last_row",
        F.lit(len(data)).alias("column_count"),
    )


def manifest_totals(manifest: DataFrame, original_file: str) -> DataFrame:
    """One row over a manifest: parts, rows and bytes."""
    sizes = [F.sum("file_size_bytes").alias("total_bytes")] if "file_size_bytes" in manifest.columns else []
    return manifest.agg(
        F.lit(original_file).alias("original_file"),
        F.count("*").alias("total_split_files"),
        F.sum("row_count").alias("total_rows"),
        *sizes,
    )
