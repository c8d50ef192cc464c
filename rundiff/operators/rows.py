"""Positional diff of two tables, ranges of differing rows and line pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rundiff.functions.profile import mentions_threads, percent_timing_ms
from rundiff.functions.scores import percent_change
from rundiff.functions.text import render_row, strip
from rundiff.operators.ordered import BLOCK_ROWS, Running, running
from rundiff.session import cut_lineage

RANGE_TYPE = "data_mismatch"
DIGEST_ROWS = 4096  # rows of one digest


def trimmed_header(df: DataFrame) -> DataFrame:
    """The same rows under column names without outer whitespace."""
    return df.toDF(*[c.strip() for c in df.columns])


def common_columns(a: DataFrame, b: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns both tables have, in the order of the first."""
    return [c for c in a.columns if c in b.columns and c not in exclude]


def _differs(columns: Sequence[str]) -> Column:
    one_sided = F.col("a.row_idx").isNull() | F.col("b.row_idx").isNull()
    unequal = one_sided
    for c in columns:
        left, right = strip(F.col(f"a.{c}").cast("string")), strip(F.col(f"b.{c}").cast("string"))
        unequal = unequal | ~left.eqNullSafe(right)
    return unequal


def pair_rows(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Put the rows of two tables side by side by their ``row_idx``.

    Both sides need a dense ``row_idx`` starting at 0 within ``keys`` (one key value per
    file pair). Compared as trimmed text; two missing values are equal. Returns the
    keys, ``row_idx``, ``differs``, the two rows as structs ``a`` and ``b`` (NULL on a side
    that has ended) and as text. Tables without a common column give no rows.
    """
    keys = list(keys)
    a, b = trimmed_header(a), trimmed_header(b)
    if columns is None:
        columns = common_columns(a, b, [*keys, "row_idx"])
    if not columns:
        a, b = a.where(F.lit(False)), b.where(F.lit(False))
    on = [*keys, "row_idx"]
    joined = a.alias("a").join(b.alias("b"), on=[F.col(f"a.{k}") == F.col(f"b.{k}") for k in on], how="full")
    side = {
        s: F.when(F.col(f"{s}.row_idx").isNotNull(), F.struct(*[F.col(f"{s}.{c}") for c in df.columns]))
        for s, df in (("a", a), ("b", b))
    }
    text = {
        s: F.coalesce(
            F.when(F.col(f"{s}.row_idx").isNotNull(), render_row(F.col(f"{s}.row_idx"), columns, s)),
            F.concat(
                F.lit("Row "),
                F.coalesce(F.col("a.row_idx"), F.col("b.row_idx")) + 1,
                F.lit(f": [FILE {s.upper()} ENDS]"),
            ),
        )
        for s in ("a", "b")
    }
    return joined.select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in on],
        _differs(columns).alias("differs"),
        side["a"].alias("a"),
        side["b"].alias("b"),
        text["a"].alias("a_line"),
        text["b"].alias("b_line"),
    )


def differing_blocks(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], block_rows: int = DIGEST_ROWS) -> DataFrame:
    """``keys, block``: the blocks of ``block_rows`` rows that are not the same on both sides.

    The digest of a block is the exclusive or of two 64-bit hashes of its rows, each with its number, over both sides:
    rows that agree cancel out. Rows are folded before the shuffle, so it moves a row per block, whatever the size of
    the tables. A file pair of which one file has no rows at all has no blocks.
    """
    keys = list(keys)

    def hashed(df: DataFrame, side: int) -> DataFrame:
        cells = [strip(F.col(f"`{c}`").cast("string")) for c in columns]
        parts = [F.col("row_idx"), *[p for c in cells for p in (c.isNull(), c)]]
        block = F.floor(F.col("row_idx") / block_rows).alias("block")
        return df.select(*keys, block, F.lit(side).alias("_side"), F.xxhash64(*parts).alias("_x"), F.xxhash64(F.lit("second"), *parts).alias("_y"))

    both = hashed(a, 1).union(hashed(b, 2))
    sides = F.max((F.col("_side") == 1).cast("int")) + F.max((F.col("_side") == 2).cast("int")) * 2
    blocks = cut_lineage(both.groupBy(*keys, "block").agg(F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y"), sides.alias("_sides")))
    # the first block tells whether both files have rows
    paired = blocks.where("block = 0 AND _sides = 3").select(*keys, F.lit(True).alias("_paired"))
    changed = blocks.where("_x <> 0 OR _y <> 0").select(*keys, "block")
    return changed.join(paired, keys, "left_semi") if keys else changed.where(F.lit(not paired.isEmpty()))


def differing_rows(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None, digest_rows: int = DIGEST_ROWS) -> DataFrame:
    """The row pairs that differ, as ``pair_rows`` gives them: only blocks of rows that differ are paired."""
    a, b = trimmed_header(a), trimmed_header(b)
    if columns is None:
        columns = common_columns(a, b, [*keys, "row_idx"])
    if columns:
        blocks = cut_lineage(differing_blocks(a, b, keys, columns, digest_rows))
        block = F.floor(F.col("row_idx") / digest_rows)
        a, b = (df.withColumn("block", block).join(blocks, [*keys, "block"], "left_semi").select(df.columns) for df in (a, b))
    return pair_rows(a, b, keys, columns).where("differs")


def with_ranges(differing: DataFrame, keys: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Give each differing row the first row of its range, which identifies the range.

    Along a range the row number and the count of differing rows up to it grow alike, so their difference is the same
    for all its rows and tells it from other ranges. Only rows that differ are written.
    """
    numbered = running(cut_lineage(differing.drop("differs")), keys, "row_idx", [Running("_n", "sum", F.lit(1).cast("long"))], block_rows)
    numbered = numbered.withColumn("_range", F.col("row_idx") - F.col("_n")).drop("_n")
    starts = numbered.groupBy(*keys, "_range").agg(F.min("row_idx").alias("range_start"))
    return numbered.join(starts, [*keys, "_range"]).drop("_range")


def conflict_ranges(ranged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per range of consecutive differing rows, 1-based and inclusive."""
    ends = ranged.groupBy(*keys, "range_start").agg(F.max("row_idx").alias("_last"), F.count("*").alias("row_count"))
    start, end = F.col("range_start") + 1, F.col("_last") + 1
    return ends.select(
        *keys,
        start.alias("start_row"),
        end.alias("end_row"),
        "row_count",
        F.lit(RANGE_TYPE).alias("conflict_type"),
        F.concat(F.lit("Conflicting data found in rows "), start, F.lit(" to "), end).alias("description"),
    )


def line_changes(ranged: DataFrame) -> DataFrame:
    """Line pairs that differ as text, with their timing, name and thread changes.

    Adds ``function_a/b`` (text before the first comma), ``time_a/b``, ``delta``,
    ``delta_percent`` and the flags ``timing_change``, ``function_change``,
    ``thread_change``.
    """
    a, b = F.col("a_line"), F.col("b_line")
    def name(line: Column) -> Column:
        before_comma = F.btrim(F.substring_index(line, ",", 1), F.lit(' "'))
        return F.when(F.instr(line, ",") > 0, before_comma).otherwise(strip(line))

    timed = (
        ranged.where(strip(a) != strip(b))
        .withColumn("function_a", name(a))
        .withColumn("function_b", name(b))
        .withColumn("time_a", percent_timing_ms(a))
        .withColumn("time_b", percent_timing_ms(b))
    )
    delta = F.col("time_b") - F.col("time_a")
    return (
        timed.withColumn("delta", delta)
        .withColumn("delta_percent", F.when(delta.isNotNull(), percent_change(F.col("time_a"), F.col("time_b"))))
        .withColumn("timing_change", F.coalesce(F.abs("delta") > 0.1, F.lit(False)))
        .withColumn("function_change", F.col("function_a") != F.col("function_b"))
        .withColumn("thread_change", mentions_threads(a) | mentions_threads(b))
    )


def change_counts(changes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many line pairs changed in timing, function and threads."""
    return changes.groupBy(*keys).agg(
        F.count_if("timing_change").alias("timing_changes"),
        F.count_if("function_change").alias("function_changes"),
        F.count_if("thread_change").alias("thread_changes"),
    )
