"""Profiler cells: call names, timings, JDK packages and frame parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rundiff.functions.text import strip

# Package prefixes that count as JDK-internal.
JDK_PREFIXES = ["java.", "javax.", "sun.", "com.sun.", "jdk.internal.", "oracle.", "com.oracle."]

# Package text and the bucket it belongs to; the first hit wins.
JDK_BUCKETS = [
    ("java.lang.", "Lang"),
    ("java.util.", "Util"),
    ("java.awt.", "AWT"),
    ("java.io.", "IO"),
    ("java.net.", "Net"),
    ("javax.", "Extension"),
    ("sun.", "Sun"),
    ("jdk.internal.", "JDK"),
]
JDK_OTHER = "System"

# Words that mark a line as being about threads.
THREAD_WORDS = ["thread", "worker", "executor", "pool"]

# Timing, percentage and frame patterns.
TIME_PATTERN = r"(\d+\.?\d*)\s*(ms|s)"
MS_PATTERN = r"(\d+\.?\d*)\s*ms"
MS_PERCENT_PATTERN = r"(\d+\.?\d*)\s*ms\s*\((\d+\.?\d*)%\)"
FRAME_PATTERN = r"([a-zA-Z0-9._]+)\.([a-zA-Z0-9_<>$]+)\([^:]*:?(\d+)?\)"
PAIR_PATTERN = r"([a-zA-Z0-9_]+)\.([a-zA-Z0-9_<>$]+)"

_JDK_ALTERNATIVES = "|".join(p.replace(".", r"\.") for p in JDK_PREFIXES)


def _number(c: Column) -> Column:
    return c.try_cast("double")  # NULL for the empty text of a failed match


def stack_level(name: Column) -> Column:
    """Call depth: the number of leading spaces; 0 for a missing name."""
    return F.coalesce(F.length(name) - F.length(F.ltrim(name)), F.lit(0))


def function_name(name: Column) -> Column:
    """Name without its indentation; ``unknown`` for a missing or empty one."""
    return F.when(name.isNull() | (name == ""), "unknown").otherwise(strip(name))


def is_jdk_internal(name: Column) -> Column:
    """True when a name starts with a JDK package; false for a missing name."""
    return F.coalesce(F.lower(name).rlike(rf"^\s*({_JDK_ALTERNATIVES})"), F.lit(False))


def mentions_jdk(line: Column) -> Column:
    """True when a JDK package name occurs anywhere in a line, in any case."""
    return F.coalesce(line.rlike(rf"(?i)({_JDK_ALTERNATIVES})"), F.lit(False))


def jdk_bucket(line: Column) -> Column:
    """Short name of the JDK area a line mentions."""
    bucket = F
    for text, label in JDK_BUCKETS:
        bucket = bucket.when(line.contains(text), F.lit(label))
    return bucket.otherwise(F.lit(JDK_OTHER))


def timing_ms(text: Column, legacy: bool = False) -> Column:
    """Milliseconds in a timing cell such as ``131,697 ms (-0%)`` or ``2.5 s (100%)``.

    NULL when there is none. ``legacy`` reads milliseconds only, stops at a thousands
    comma and gives 0.0 when there is none.
    """
    if legacy:
        return F.coalesce(_number(F.regexp_extract(text, MS_PATTERN, 1)), F.lit(0.0))
    found = F.regexp_extract(F.translate(text, ",", ""), TIME_PATTERN, 0)
    return _number(F.rtrim(found, F.lit("ms \t"))) * F.when(found.endswith("ms"), 1.0).otherwise(1000.0)


def hit_count(text: Column) -> Column:
    """First whole number of a hits cell, 1.0 when there is none."""
    return F.coalesce(_number(F.regexp_extract(text, r"(\d+)", 1)), F.lit(1.0))


def percent_timing_ms(text: Column) -> Column:
    """Milliseconds of the first ``n ms (p%)`` in a line; signed percentages do not count."""
    return _number(F.regexp_extract(text, MS_PERCENT_PATTERN, 1))


def frame_parts(path: Column, legacy: bool = False) -> Column:
    """Struct ``class_name, method_name, line_number`` of a call name.

    A blank before the argument list is ignored, unless ``legacy``.
    """
    call = path if legacy else F.regexp_replace(path, r"\s+(?=\()", "")
    is_call, is_pair = call.rlike(FRAME_PATTERN), call.rlike(PAIR_PATTERN)
    line = F.when(is_call, F.nullif(F.regexp_extract(call, FRAME_PATTERN, 3), F.lit("")))
    full_class = F.regexp_extract(call, FRAME_PATTERN, 1)
    return F.struct(
        F.when(is_call, F.substring_index(full_class, ".", -1))
        .when(is_pair, F.regexp_extract(call, PAIR_PATTERN, 1))
        .otherwise(F.lit("Unknown"))
        .alias("class_name"),
        F.when(is_call, F.regexp_extract(call, FRAME_PATTERN, 2))
        .when(is_pair, F.regexp_extract(call, PAIR_PATTERN, 2))
        .otherwise(path)
        .alias("method_name"),
        line.alias("line_number"),
    )


def mentions_threads(line: Column) -> Column:
    """True when a line names a thread, worker, executor or pool."""
    return F.coalesce(F.lower(line).rlike("|".join(THREAD_WORDS)), F.lit(False))
