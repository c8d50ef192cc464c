"""Noise removal from profiler text: line classes, runs and value filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rundiff.functions.profile import JDK_BUCKETS, JDK_OTHER, mentions_jdk
from rundiff.functions.text import strip
from rundiff.operators.ordered import BLOCK_ROWS, Running, running

# Line classes, their patterns, and the words of the value filter.
ZERO_SELF_TIME = "SELF_TIME_ZERO"
JDK = "JAVA_INTERNAL_"
COMPILATION = "JVM_COMPILATION"
SIGNIFICANT = "SIGNIFICANT"
ZERO_SELF_TIME_PATTERN = r"Self time.*?0\.0 ms.*?0\.0 ms.*?1"
COMPILATION_WORDS = ["compiledmethod", "interpreter", "c1 compilation", "c2 compilation"]
COMPRESSED = "[COMPRESSED]"
LOW_VALUE_WORDS = [
    "0.0 ms (0%)",
    "compiled method",
    "interpreter",
    "vtable stub",
    "runtime stub",
    "deoptimization",
    "uncommon trap",
]
VALUE_WORDS = ["ms (", "%)", "hits", COMPRESSED]

# Classes by number; a number keeps the many comparisons below small.
CLASSES = [ZERO_SELF_TIME, COMPILATION, SIGNIFICANT, *[JDK + b for _, b in JDK_BUCKETS], JDK + JDK_OTHER]
_ZERO, _JVM, _SIGNIFICANT, _JDK = 0, 1, 2, 3


def _contains_any(c: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | c.contains(word)
    return found


def clean_line(line: Column) -> Column:
    """Line without outer whitespace and without the quotes around it."""
    return F.btrim(strip(line), F.lit('"'))


def class_code(line: Column) -> Column:
    """Number of the class of a clean line; the first rule that fits counts."""
    bucket = F
    for i, (text, _) in enumerate(JDK_BUCKETS):
        bucket = bucket.when(line.contains(text), F.lit(_JDK + i))
    return (
        F.when(line.rlike(ZERO_SELF_TIME_PATTERN), _ZERO)
        .when(mentions_jdk(line), bucket.otherwise(_JDK + len(JDK_BUCKETS)))
        .when(F.lower(line).rlike("|".join(COMPILATION_WORDS)), _JVM)
        .otherwise(_SIGNIFICANT)
    )


def class_name(code: Column) -> Column:
    """Name of a class number."""
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES]), code + 1)


def line_runs(
    lines: DataFrame,
    keys: Sequence[str] = (),
    pos: str = "line_no",
    column: str = "line",
    block_rows: int = BLOCK_ROWS,
    codes: Sequence[int] = tuple(range(len(CLASSES))),
) -> DataFrame:
    """Classify the lines and mark runs of one class; blank lines are dropped.

    Adds ``class_code`` and ``run_after``, the last position of any other class, which
    is the same for all lines of a run and for no other run. The set of classes is
    fixed, so one pass with a running maximum per class gives it; ``codes`` limits it to
    some classes and leaves ``run_after`` NULL for the others.
    """
    cleaned = lines.withColumn(column, clean_line(F.col(column))).where(F.col(column) != "")
    classed = cleaned.withColumn("class_code", class_code(F.col(column)))
    code = F.col("class_code")
    specs = [Running(f"_not_{i}", "max", F.when(code != i, F.col(pos))) for i in codes]
    marked = running(classed, keys, pos, specs, block_rows)
    run_after = F
    for i in codes:
        run_after = run_after.when(code == i, F.coalesce(f"_not_{i}", F.lit(-1)))
    return marked.select(*classed.columns, run_after.alias("run_after"))


def run_sizes(runs: DataFrame, keys: Sequence[str] = (), pos: str = "line_no") -> DataFrame:
    """One row per run: class, first position and number of lines."""
    sizes = runs.groupBy(*keys, "run_after", "class_code").agg(
        F.min(pos).alias("first_line"), F.count("*").alias("line_count")
    )
    return sizes.withColumn("line_class", class_name(F.col("class_code"))).drop("class_code")


def compress_runs(
    runs: DataFrame, keys: Sequence[str] = (), pos: str = "line_no", column: str = "line"
) -> DataFrame:
    """Replace noise runs by markers; JDK runs go, significant lines stay.

    Significant lines pass straight through. A noise run needs only its size and its
    first and last line, as at most two of its lines survive, so even a run that is most
    of the data is folded by a map-side aggregation.
    """
    kept = runs.where(F.col("class_code") == _SIGNIFICANT).select(*keys, pos, column)
    entry = F.struct(F.col(pos), F.col(column))
    folded = (
        runs.where(F.col("class_code") < _SIGNIFICANT)
        .groupBy(*keys, "run_after", "class_code")
        .agg(F.count("*").alias("_n"), F.min(entry).alias("_first"), F.max(entry).alias("_last"))
    )
    n = F.col("_n").cast("string")
    zero = F.concat(F.lit(f"{COMPRESSED} "), n, F.lit("x repeated 'Self time, 0.0 ms' entries (noise removed)"))
    jvm = F.concat(F.lit(f"{COMPRESSED} "), n, F.lit("x JVM compilation entries (system internals)"))
    marker = F.when((F.col("class_code") == _ZERO) & (F.col("_n") >= 3), zero).when(
        (F.col("class_code") == _JVM) & (F.col("_n") >= 2), jvm
    )
    survivors = F.when(marker.isNotNull(), F.array(F.struct(F.col(f"_first.{pos}").alias(pos), marker.alias(column))))
    survivors = survivors.otherwise(F.array_distinct(F.array("_first", "_last")))
    noise = folded.select(*keys, F.explode(survivors).alias("_e")).select(*keys, f"_e.{pos}", f"_e.{column}")
    return kept.unionByName(noise)


def value_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Keep the lines that carry a measured value or a marker."""
    line = F.col(column)
    low = _contains_any(F.lower(line), LOW_VALUE_WORDS) & ~line.contains(COMPRESSED)
    return lines.where(~low & _contains_any(line, VALUE_WORDS))


def reduce_noise(
    lines: DataFrame, keys: Sequence[str] = (), pos: str = "line_no", column: str = "line", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All three passes: classify, compress runs, filter by value."""
    runs = line_runs(lines, keys, pos, column, block_rows, codes=(_ZERO, _JVM))
    return value_lines(compress_runs(runs, keys, pos, column), column)


def compression_ratio(raw_size: Column, reduced_size: Column) -> Column:
    """Percent saved by the reduction; NULL for no input."""
    return 100 - F.try_divide(reduced_size.cast("double"), raw_size.cast("double")) * 100
