"""Keyed diff of two profiler runs on (function, call depth)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rundiff.functions import profile, scores

# How many conflicts a display, and the two severity lists, show.
DISPLAY_LIMIT = 50
SEVERITY_LIMITS = {"high": 20, "medium": 30}


@dataclass(frozen=True)
class ProfileColumns:
    """Columns of a profiler export by role, and the form of its timings."""

    name: str | None
    total_time: str | None
    cpu_time: str | None
    hits: str | None
    has_percentage: bool
    time_unit: str


def column_roles(columns: Sequence[str]) -> dict[str, str]:
    """Profiler columns by role, from their headings; the last match of a role counts."""
    roles: dict[str, str] = {}
    for column in columns:
        title = column.lower()
        if "total time" in title:
            roles["cpu_time" if "cpu" in title else "total_time"] = column
        elif "hits" in title:
            roles["hits"] = column
        elif "name" in title:
            roles["name"] = column
    return roles


def detect_columns(df: DataFrame, order: str = "row_idx") -> ProfileColumns:
    """Profiler columns and the form of their timings, judged by the first row."""
    roles = column_roles(df.columns)
    sample = ""
    if "total_time" in roles:
        first = df.orderBy(order).select(F.col(f"`{roles['total_time']}`").cast("string")).head(1)
        sample = (first[0][0] or "") if first else ""
    unit = "s" if " s" in sample and "ms" not in sample else "ms"
    return ProfileColumns(
        *(roles.get(r) for r in ("name", "total_time", "cpu_time", "hits")),
        has_percentage="%" in sample,
        time_unit=unit,
    )


def profile_rows(df: DataFrame, keys: Sequence[str] = (), order: str = "row_idx") -> DataFrame:
    """Project a profiler table onto ``name, total_time, cpu_time, hits`` text columns."""
    roles = column_roles(df.columns)
    if not {"name", "total_time"} <= set(roles):
        raise ValueError("no Name or Total Time column")
    cells = [
        (F.col(f"`{roles[r]}`").cast("string") if r in roles else F.lit(None).cast("string")).alias(r)
        for r in ("name", "total_time", "cpu_time", "hits")
    ]
    return df.select(*keys, order, *cells)


def last_per_call(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Last row of every (function, call depth), JDK-internal calls left out.

    Grouped by the raw name first: that pass holds only numbers per group, so it is a
    hash aggregation that shrinks a hot name before the shuffle. The few spellings of
    one name are then folded together.
    """
    by_name = (
        rows.where(~profile.is_jdk_internal(F.col("name")))
        .groupBy(*keys, "name")
        .agg(
            F.max("row_idx").alias("row_idx"),
            F.max_by(profile.timing_ms(F.col("total_time")), "row_idx").alias("time_ms"),
        )
    )
    return (
        by_name.groupBy(
            *keys,
            profile.function_name(F.col("name")).alias("function_name"),
            profile.stack_level(F.col("name")).alias("stack_level"),
        )
        .agg(F.max_by(F.struct("row_idx", "time_ms", "name"), "row_idx").alias("_last"))
        .select(*keys, "function_name", "stack_level", "_last.row_idx", "_last.time_ms", "_last.name")
    )


def compare_calls(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Conflicts between two runs, one row per differing (function, call depth).

    A call in one run only is a ``content_diff``; a call in both is a ``time_diff`` when
    its time changed significantly and is left out otherwise. Input columns: ``row_idx,
    name, total_time`` and the keys.
    """
    on = [*keys, "function_name", "stack_level"]
    left, right = last_per_call(a, keys).alias("a"), last_per_call(b, keys).alias("b")
    joined = left.join(right, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on], "full")
    one_sided = F.col("a.row_idx").isNull() | F.col("b.row_idx").isNull()
    kind = scores.conflict_type(one_sided, scores.is_significant(F.col("a.time_ms"), F.col("b.time_ms")))
    found = joined.select(
        *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in on],
        (F.least("a.row_idx", "b.row_idx") + 1).alias("line_number"),
        F.coalesce("a.name", F.lit("")).alias("file_a_content"),
        F.coalesce("b.name", F.lit("")).alias("file_b_content"),
        F.col("a.time_ms").alias("file_a_time"),
        F.col("b.time_ms").alias("file_b_time"),
        (F.col("b.time_ms") - F.col("a.time_ms")).alias("time_delta"),
        kind.alias("conflict_type"),
    )
    return found.where(F.col("conflict_type").isNotNull()).withColumn(
        "severity", scores.severity(F.col("time_delta"))
    )


def added_calls(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Calls of ``b`` that ``a`` does not have (swap the arguments for removed calls)."""
    on = [*keys, "function_name", "stack_level"]
    return last_per_call(b, keys).join(last_per_call(a, keys).select(*on), on, "left_anti")


def conflict_order() -> list:
    """By line number; ties by name and depth."""
    return [F.col("line_number"), F.col("function_name"), F.col("stack_level")]


def conflict_totals(conflicts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by type and severity, a summary sentence and two flags."""
    counts = conflicts.groupBy(*keys).agg(
        F.count("*").alias("total_conflicts"),
        *[F.count_if(F.col("conflict_type") == t).alias(t) for t in ("content_diff", "time_diff", "both")],
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")],
    )
    total = F.col("total_conflicts")
    sentence = F.concat(
        *[F.lit("Found "), total, F.lit(" conflicts: "), F.col("content_diff"), F.lit(" content differences, ")],
        *[F.col("time_diff"), F.lit(" timing differences, "), F.col("both"), F.lit(" both")],
    )
    identical = F.lit("No conflicts found - files are identical")
    return counts.select(
        "*",
        F.when(total == 0, identical).otherwise(sentence).alias("summary"),
        (total > 0).alias("has_differences"),
        (total > DISPLAY_LIMIT).alias("has_more"),
    )


def display_rows(conflicts: DataFrame, limit: int = DISPLAY_LIMIT, keys: Sequence[str] = ()) -> DataFrame:
    """First conflicts (per key) in line order with their times as text."""

    def content(c: str):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(not present)")).alias(c)

    if keys:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*conflict_order()))
        first = conflicts.withColumn("_rank", rank).where(F.col("_rank") <= limit)
    else:
        first = conflicts.orderBy(*conflict_order()).limit(limit)
    return (
        first.select(
            *keys,
            "line_number",
            "function_name",
            "stack_level",
            content("file_a_content"),
            content("file_b_content"),
            scores.ms_text(F.col("file_a_time")).alias("file_a_time"),
            scores.ms_text(F.col("file_b_time")).alias("file_b_time"),
            scores.ms_text(F.col("time_delta"), signed=True).alias("time_delta"),
            "conflict_type",
            "severity",
        )
    )


def first_by_severity(conflicts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The first high and medium conflicts, ranked; low ones are never listed.

    The constant rank bound lets each task keep only its own first rows before the
    shuffle, so the two severities do not become two hot groups.
    """
    ranked = conflicts.where(F.col("severity").isin(*SEVERITY_LIMITS)).withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys, "severity").orderBy(*conflict_order()))
    )
    kept = ranked.where(F.col("rank") <= max(SEVERITY_LIMITS.values()))
    limit = F
    for name, rows in SEVERITY_LIMITS.items():
        limit = limit.when(F.col("severity") == name, rows)
    return kept.where(F.col("rank") <= limit)
