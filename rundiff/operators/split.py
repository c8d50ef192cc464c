"""Table splits: by row count, size, column value and section; table profiling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rundiff.functions.numbers import rounded
from rundiff.functions.text import first_field, is_heading, safe_section_name, safe_value_name, strip
from rundiff.operators.ordered import BLOCK_ROWS, Running, dense_index, running
from rundiff.session import cut_lineage

# Defaults of the split methods.
DEFAULT_ROWS = 100
DEFAULT_MAX_MB = 10.0

# Recommended rows per part for tables of up to so many rows.
RECOMMENDED_ROWS = [(1_000, 100), (10_000, 500), (100_000, 1000)]
RECOMMENDED_ROWS_LARGE = 2000
SMALL_TABLE_ROWS = 100
SMALL_TABLE_PARTS = 5


def split_by_rows(df: DataFrame, rows_per_part: int = DEFAULT_ROWS) -> DataFrame:
    """Add ``part_id``: contiguous parts of ``rows_per_part`` rows, from 0."""
    if rows_per_part < 1:
        raise ValueError("rows_per_part must be positive")
    return df.withColumn("part_id", F.floor(F.col("row_idx") / F.lit(rows_per_part)))


def split_by_value(df: DataFrame, column: str) -> DataFrame:
    """Add ``group_value`` and the path-safe ``group_name``; NULL is a group of its own."""
    if column not in df.columns:
        raise ValueError(f"column not found: {column}")
    value = F.col(f"`{column}`").cast("string")
    return df.withColumn("group_value", value).withColumn("group_name", safe_value_name(value))


def rows_within_size(row_count: Column, total_bytes: Column, max_bytes: Column) -> Column:
    """Rows that fit ``max_bytes`` at the average row size, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.floor(max_bytes / (total_bytes / row_count)))


def split_by_size(
    df: DataFrame,
    sizes: DataFrame | None = None,
    max_mb: float = DEFAULT_MAX_MB,
    keys: Sequence[str] = (),
    row_bytes: Column | None = None,
) -> DataFrame:
    """Add ``rows_per_part`` and ``part_id`` so that an average part stays within ``max_mb``.

    ``sizes`` holds the keys, ``row_count`` and ``total_bytes`` per file; without it the
    bytes are summed from ``row_bytes``. Rows of a large file stay where they are when
    the one-row-per-file table is broadcast by size; without keys the numbers come in as
    scalar subqueries and nothing moves.
    """
    if sizes is None:
        if row_bytes is None:
            raise ValueError("pass sizes or row_bytes")
        sizes = df.groupBy(*keys).agg(F.count("*").alias("row_count"), F.sum(row_bytes).alias("total_bytes"))
    per_part = rows_within_size(F.col("row_count"), F.col("total_bytes"), F.lit(max_mb * 1024 * 1024))
    sizes = sizes.select(*keys, per_part.alias("rows_per_part"))
    sized = df.join(sizes, list(keys)) if keys else df.withColumn("rows_per_part", sizes.scalar())
    return sized.withColumn("part_id", F.floor(F.col("row_idx") / F.col("rows_per_part")))


def split_by_sections(
    df: DataFrame,
    column: str,
    keys: Sequence[str] = (),
    variant: str = "line",
    heading: Column | None = None,
    pos: str = "row_idx",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``section_id`` (from 1) and ``heading``; rows before the first heading go.

    ``variant='table'`` looks at ``column`` as a parsed first column; ``'line'`` takes
    ``column`` as a raw CSV line. A ``heading`` condition replaces the rule.
    """
    value = F.col(f"`{column}`")
    if heading is None:
        value = first_field(value) if variant == "line" else value
        heading = is_heading(value, variant)
    flagged = df.withColumn("_value", value).withColumn("_opens", heading)
    specs = [
        Running("section_id", "sum", F.when(F.col("_opens"), 1).otherwise(0).cast("long")),
        Running("_title", "max", F.when(F.col("_opens"), F.struct(F.col(pos), F.col("_value")))),
    ]
    sections = running(flagged, keys, pos, specs, block_rows).where("section_id > 0")
    return sections.withColumn("heading", F.col("_title._value")).drop("_value", "_opens", "_title")


def split_lines_by_sections(lines: DataFrame, keys: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sections of raw CSV lines ``row_idx, line``; lines are stripped, blank ones go."""
    stripped = lines.withColumn("line", strip(F.col("line"))).where("line <> ''")
    return split_by_sections(stripped, "line", keys, "line", block_rows=block_rows)


def sections_matched(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sections of two files with the same heading and occurrence number, by their ids.

    Input: the results of ``split_by_sections`` on both files.
    """

    def numbered(df: DataFrame) -> DataFrame:
        # one row per section, written as the numbering reads it twice
        starts = cut_lineage(df.groupBy(*keys, "section_id", "heading").agg(F.count("*").alias("rows")))
        return dense_index(starts, [*keys, "heading"], "section_id", "occurrence")

    left = numbered(a).withColumnsRenamed({"section_id": "section_a", "rows": "rows_a"})
    right = numbered(b).withColumnsRenamed({"section_id": "section_b", "rows": "rows_b"})
    return left.join(right, [*keys, "heading", "occurrence"], "full")


def choose_section(df: DataFrame, section_id: int) -> DataFrame:
    """Rows of one section."""
    return df.where(F.col("section_id") == section_id)


def split_table(df: DataFrame, method: str = "rows", **options) -> DataFrame:
    """Split by a method name: ``rows, size, column, hierarchical`` or ``brute_force``."""
    methods: dict[str, Callable[..., DataFrame]] = {
        "rows": split_by_rows,
        "size": split_by_size,
        "column": split_by_value,
        "hierarchical": lambda d, column=None, **o: split_by_sections(d, column or d.columns[0], variant="table", **o),
        "brute_force": split_lines_by_sections,
    }
    if method not in methods:
        raise ValueError(f"unsupported split method: {method}")
    return methods[method](df, **options)


def part_manifest(parts: DataFrame, part_columns: Sequence[str], row_bytes: Column | None = None) -> DataFrame:
    """One row per part: rows, columns, first and last row, and bytes when known."""
    columns = [c for c in parts.columns if c not in {*part_columns, "row_idx"}]
    aggregates = [
        F.count("*").alias("row_count"),
        F.lit(len(columns)).alias("column_count"),
        (F.min("row_idx") + 1).alias("first_row"),
        (F.max("row_idx") + 1).alias("last_row"),
    ]
    if row_bytes is not None:
        aggregates.append(F.sum(row_bytes).alias("file_size_bytes"))
    manifest = parts.groupBy(*part_columns).agg(*aggregates)
    if row_bytes is not None:
        manifest = manifest.withColumn("file_size_mb", rounded(F.col("file_size_bytes") / (1024 * 1024)))
    return manifest


def row_part_name(prefix: str, part_id: Column, first_row: Column, last_row: Column) -> Column:
    """File name of a row part, 1-based in part and rows."""
    return F.format_string(f"{prefix}_part_%03d_rows_%d_to_%d.csv", part_id + 1, first_row, last_row)


def section_part_name(prefix: str, section_id: Column, heading: Column, method: str = "brute_force") -> Column:
    """File name of a section part."""
    return F.concat(F.format_string(f"{prefix}_{method}_%03d_", section_id), safe_section_name(heading), F.lit(".csv"))


def recommended_rows(total_rows: Column) -> Column:
    """Recommended rows per part for a table of so many rows."""
    few = F.greatest(F.lit(1), F.floor(total_rows / SMALL_TABLE_PARTS))
    rows = F.when(total_rows <= SMALL_TABLE_ROWS, few)
    for limit, size in RECOMMENDED_ROWS:
        rows = rows.when(total_rows <= limit, size)
    return rows.otherwise(RECOMMENDED_ROWS_LARGE).cast("long")


def estimated_parts(total_rows: Column, rows_per_part: Column) -> Column:
    """Full parts of the recommended size, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.floor(total_rows / rows_per_part))


def table_profile(df: DataFrame, keys: Sequence[str] = (), row_bytes: Column | None = None) -> DataFrame:
    """Rows, columns and split advice per file, with bytes when ``row_bytes`` is given."""
    data = [c for c in df.columns if c not in {*keys, "row_idx"}]
    sizes = [] if row_bytes is None else [F.coalesce(F.sum(row_bytes), F.lit(0)).alias("file_size_bytes")]
    profile = df.groupBy(*keys).agg(F.count("*").alias("total_rows"), *sizes)
    profile = (
        profile.withColumn("total_columns", F.lit(len(data)))
        .withColumn("recommended_rows_per_file", recommended_rows(F.col("total_rows")))
        .withColumn("estimated_output_files", estimated_parts(F.col("total_rows"), F.col("recommended_rows_per_file")))
    )
    if row_bytes is not None:
        profile = profile.withColumn("file_size_mb", rounded(F.col("file_size_bytes") / (1024 * 1024)))
    return profile


def column_profile(df: DataFrame) -> DataFrame:
    """Names and types of the columns, from the schema alone."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")


def preview(df: DataFrame, rows: int = 10, order: str = "row_idx") -> DataFrame:
    """First rows in file order."""
    return df.orderBy(order).limit(rows)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column."""
    return df.select(column).distinct()
