"""Scores and labels of timing differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rundiff.functions.numbers import fixed

INFINITY = float("inf")


def is_significant(a_ms: Column, b_ms: Column) -> Column:
    """Both times known and apart by more than 1 ms and more than 5 % of the first."""
    limit = F.greatest(F.lit(1.0), F.abs(a_ms) * 0.05)
    return F.coalesce(F.abs(b_ms - a_ms) > limit, F.lit(False))


def conflict_type(content_differs: Column, time_differs: Column) -> Column:
    """``both``, ``content_diff`` or ``time_diff``; NULL when nothing differs."""
    return (
        F.when(content_differs & time_differs, "both")
        .when(content_differs, "content_diff")
        .when(time_differs, "time_diff")
    )


def severity(delta_ms: Column) -> Column:
    """``high`` above a second, ``medium`` above 100 ms or without times, else ``low``."""
    return (
        F.when(delta_ms.isNull() | ((F.abs(delta_ms) > 100) & (F.abs(delta_ms) <= 1000)), "medium")
        .when(F.abs(delta_ms) > 1000, "high")
        .otherwise("low")
    )


def regression_factor(a_ms: Column, b_ms: Column) -> Column:
    """``b/a``; 0 for a removed function and infinity for an added one (NULL side)."""
    return (
        F.when(b_ms.isNull(), F.lit(0.0))
        .when(a_ms.isNull() | (a_ms <= 0), F.lit(INFINITY))
        .otherwise(F.try_divide(b_ms, a_ms))
    )


def impact(a_ms: Column, b_ms: Column) -> Column:
    """Weight of a change: the difference, scaled up by how far the factor is from 1."""
    scale = F.greatest(F.lit(1.0), F.abs(regression_factor(a_ms, b_ms) - 1))
    return F.when(b_ms.isNull(), a_ms).when(a_ms.isNull(), b_ms * 2).otherwise(F.abs(b_ms - a_ms) * scale)


def percent_change(a_ms: Column, b_ms: Column) -> Column:
    """Change in percent of the first value, 0 when that is not positive."""
    return F.when(a_ms > 0, F.try_divide(b_ms - a_ms, a_ms) * 100).otherwise(F.lit(0.0))


def ms_text(ms: Column, signed: bool = False) -> Column:
    """``12.34 ms``, or ``N/A`` for a missing value."""
    return F.coalesce(F.concat(fixed(ms, 2, signed), F.lit(" ms")), F.lit("N/A"))


def change_label(delta_ms: Column, factor: Column) -> Column:
    """How much slower or faster a hotspot got, in words."""
    delta = F.concat(fixed(delta_ms, 1), F.lit("ms ("))
    return (
        F.when(delta_ms > 0, F.concat(F.lit("+"), delta, fixed(factor, 1), F.lit("x slower)")))
        .when(
            (delta_ms < 0) & (factor > 0),
            F.concat(delta, fixed(F.try_divide(F.lit(1.0), factor), 1), F.lit("x faster)")),
        )
        .when(delta_ms < 0, F.concat(delta, F.lit("optimized)")))
        .otherwise("no change")
    )


def location_label(class_name: Column, method_name: Column, line_number: Column) -> Column:
    """``Class.method(Class.java:line)``, without the bracket when the line is unknown."""
    call = F.concat_ws(".", class_name, method_name)
    known = line_number.isNotNull() & (line_number != "unknown")
    return F.when(known, F.concat(call, F.lit("("), class_name, F.lit(".java:"), line_number, F.lit(")"))).otherwise(
        call
    )
