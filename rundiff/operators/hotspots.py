"""Hotspots: functions whose time changed inside a range of differing rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rundiff.functions import profile, scores
from rundiff.functions.advice import recommendation

# List lengths of the report and the smallest change that counts.
TOP_HOTSPOTS = 10
TOP_RECOMMENDATIONS = 5
MIN_CHANGE = 0.01
MIN_ONE_SIDED_MS = 0.1


def _slowest_per_function(ranged: DataFrame, side: str, group: list[str], legacy: bool) -> DataFrame:
    # max of a struct aggregates map-side, so a function that fills a range stays cheap;
    # the negated row keeps the first row among equal times
    name = F.col(f"{side}.name")
    time = F.coalesce(profile.timing_ms(F.col(f"{side}.total_time"), legacy), F.lit(0.0))
    return (
        ranged.where(F.col(side).isNotNull() & ~profile.is_jdk_internal(name))
        .select(*group, "row_idx", time.alias("ms"), profile.frame_parts(name, legacy).alias("frame"), name.alias("call"))
        .where("ms > 0")
        .groupBy(*group, F.concat_ws(".", "frame.class_name", "frame.method_name").alias("function_key"))
        .agg(F.max(F.struct("ms", (-F.col("row_idx")).alias("_neg_row"), "frame", "call")).alias("best"))
    )


def find_hotspots(ranged: DataFrame, keys: Sequence[str] = (), legacy: bool = False) -> DataFrame:
    """One row per changed function and range, from the typed rows of ``with_ranges``.

    The row structs ``a`` and ``b`` need ``name`` and ``total_time``; without them there
    are no hotspots. ``legacy`` reads timings and names the narrow way.
    """
    fields = set(ranged.schema["a"].dataType.names) & set(ranged.schema["b"].dataType.names)
    if not {"name", "total_time"} <= fields:
        raise ValueError("hotspots need the columns name and total_time on both sides")
    group = [*keys, "range_start"]
    on = [*group, "function_key"]
    a = _slowest_per_function(ranged, "a", group, legacy).alias("a")
    b = _slowest_per_function(ranged, "b", group, legacy).alias("b")
    joined = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on], "full")

    ms_a, ms_b = F.col("a.best.ms"), F.col("b.best.ms")
    frame = F.coalesce("a.best.frame", "b.best.frame")
    both = ms_a.isNotNull() & ms_b.isNotNull()
    changed = (F.abs(ms_b - ms_a) > MIN_CHANGE) | (F.abs(F.try_divide(ms_b - ms_a, ms_a)) > MIN_CHANGE)
    worth = F.when(both, changed).otherwise(F.coalesce(ms_a, ms_b) > MIN_ONE_SIDED_MS)
    line = F.when(both, F.coalesce(frame["line_number"], F.lit("unknown"))).otherwise(frame["line_number"])
    spots = joined.where(worth).select(
        *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in on],
        F.concat_ws(":", F.coalesce("a.function_key", "b.function_key"), frame["line_number"]).alias("function_name"),
        frame["class_name"].alias("class_name"),
        frame["method_name"].alias("method_name"),
        line.alias("line_number"),
        F.coalesce(ms_a, F.lit(0.0)).alias("file_a_time"),
        F.coalesce(ms_b, F.lit(0.0)).alias("file_b_time"),
        (F.coalesce(ms_b, F.lit(0.0)) - F.coalesce(ms_a, F.lit(0.0))).alias("time_delta"),
        scores.regression_factor(ms_a, ms_b).alias("regression_factor"),
        F.coalesce("a.best.call", F.lit("[Function added]")).alias("raw_line_a"),
        F.coalesce("b.best.call", F.lit("[Function removed]")).alias("raw_line_b"),
        scores.impact(ms_a, ms_b).alias("impact_score"),
    )
    return spots.drop("function_key")


def with_row_range(spots: DataFrame, ranges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add the ``Rows s-e`` label of the range each hotspot lies in."""
    label = F.concat(F.lit("Rows "), F.col("start_row"), F.lit("-"), F.col("end_row")).alias("row_range")
    labels = ranges.select(*keys, (F.col("start_row") - 1).alias("range_start"), label)
    return spots.join(labels, [*keys, "range_start"], "left")


def impact_order() -> list:
    """Highest impact first; ties by name and range."""
    return [F.col("impact_score").desc(), F.col("function_name"), F.col("range_start")]


def top_hotspots(spots: DataFrame, n: int = TOP_HOTSPOTS, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` hotspots with the highest impact (per key), ranked and labelled."""
    return _ranked(spots, n, keys).select(
        "rank",
        *spots.columns,
        scores.change_label(F.col("time_delta"), F.col("regression_factor")).alias("change"),
        scores.location_label(F.col("class_name"), F.col("method_name"), F.col("line_number")).alias("location"),
    )


def _ranked(spots: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by impact with their ``rank``; the bound on the rank lets each task keep only its own first rows."""
    best = spots if keys else spots.orderBy(*impact_order()).limit(n)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*impact_order())))
    return ranked.where(F.col("rank") <= n)


def recommendations(spots: DataFrame, n: int = TOP_RECOMMENDATIONS, keys: Sequence[str] = ()) -> DataFrame:
    """Advice for the ``n`` hotspots with the highest impact."""
    advice = recommendation(F.col("class_name"), F.col("method_name"), F.col("time_delta"))
    return top_hotspots(spots, n, keys).withColumn("recommendation", advice)


def remaining_hotspots(spots: DataFrame, n: int = TOP_HOTSPOTS, keys: Sequence[str] = ()) -> DataFrame:
    """How many hotspots lie beyond the first ``n`` (per key) and their range of impact.

    The counts come from one aggregation; the impact at rank ``n + 1`` is the smallest
    of the first ``n + 1``.
    """
    everything = spots.groupBy(*keys).agg(F.count("*").alias("total"), F.min("impact_score").alias("lowest"))
    head = _ranked(spots, n + 1, keys).groupBy(*keys).agg(F.min("impact_score").alias("next_impact"))
    both = everything.join(head, list(keys)) if keys else everything.withColumn("next_impact", head.scalar())
    return both.where(F.col("total") > n).select(
        *keys,
        (F.col("total") - n).alias("additional"),
        F.col("next_impact").alias("highest_impact"),
        F.col("lowest").alias("lowest_impact"),
    )
