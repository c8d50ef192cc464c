"""Ordered operators that scale past one partition per sequence.

A running total over a file needs the rows of that file in order. Partitioning the
window by file alone would put a file that holds a third of the data into one task, so
everything here works in two levels: windows run inside fixed-width blocks of the
position column, and only one summary row per block is combined across blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rundiff.operators.lookup import merge_join
from rundiff.session import cut_lineage

BLOCK_ROWS = 1 << 20

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` of ``value`` over all rows up to the current one.

    ``reverse`` runs from the end; ``exclusive`` leaves the current row out.
    """

    out: str
    how: str
    value: Column
    reverse: bool = False
    exclusive: bool = False


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    specs: Sequence[Running],
    block_rows: int = BLOCK_ROWS,
    height: int = 2,
    keep_block: str | None = None,
) -> DataFrame:
    """Add running aggregates along ``pos`` within ``keys``, which must not be NULL.

    ``pos`` is a whole number, unique within ``keys``; it need not be dense. One task
    handles at most ``block_rows`` rows of a key on each level: rows, block totals, totals
    of blocks of blocks, and so on. ``height`` levels hold positions up to
    ``block_rows ** height``; two are enough for 2**40 rows of a key. The block totals are aggregated before their shuffle, and their join
    reuses the partitioning and sort order of the block windows. ``df`` is read twice,
    so give it a materialised input when it is costly. ``keep_block`` names a column that keeps the block of a row: windows
    by ``keys`` and that column need no further shuffle.
    """
    keys = list(keys)
    block = "_block" if "_block" not in df.columns else f"_block{height}"
    blocked = df.withColumn(block, F.floor(F.col(pos) / F.lit(block_rows)))
    totals = blocked.groupBy(*keys, block).agg(*[_AGG[s.how](s.value).alias(f"_t_{s.out}") for s in specs])

    if height > 2:
        above = [Running(f"_c_{s.out}", s.how, F.col(f"_t_{s.out}"), s.reverse, True) for s in specs]
        carried = running(cut_lineage(totals), keys, block, above, block_rows, height - 1)
        carried = carried.select(*keys, block, *[f"_c_{s.out}" for s in specs])
    else:
        across = []
        for s in specs:
            by_block = F.col(block).desc() if s.reverse else F.col(block)
            before = Window.partitionBy(*keys).orderBy(by_block).rowsBetween(Window.unboundedPreceding, -1)
            across.append(_AGG[s.how](F.col(f"_t_{s.out}")).over(before).alias(f"_c_{s.out}"))
        carried = totals.select(*keys, block, *across)

    inside = []
    for s in specs:
        by_row = F.col(pos).desc() if s.reverse else F.col(pos)
        last = -1 if s.exclusive else Window.currentRow
        frame = Window.partitionBy(*keys, block).orderBy(by_row).rowsBetween(Window.unboundedPreceding, last)
        inside.append(_AGG[s.how](s.value).over(frame).alias(f"_w_{s.out}"))

    joined = merge_join(blocked.select("*", *inside), carried, [*keys, block], "left")
    kept = [F.col(block).alias(keep_block)] if keep_block else []
    return joined.select(*[F.col(c) for c in df.columns], *kept, *[_combine(s).alias(s.out) for s in specs])


def _combine(s: Running) -> Column:
    carried, here = F.col(f"_c_{s.out}"), F.col(f"_w_{s.out}")
    if s.how == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(here, F.lit(0))
    return (F.greatest if s.how == "max" else F.least)(carried, here)  # both skip NULL


def dense_index(
    df: DataFrame, keys: Sequence[str], pos: str, out: str = "row_idx", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Number the rows 0, 1, 2, … within ``keys`` in the order of ``pos``."""
    numbered = running(df, keys, pos, [Running(out, "sum", F.lit(1).cast("long"))], block_rows)
    return numbered.withColumn(out, F.col(out) - 1)


def list_pieces(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Sequence[str],
    piece_rows: int,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Collect ``values`` per key into ordered arrays of at most ``piece_rows`` entries.

    A small group gives one row with ``piece_no`` 0; a huge group gives many rows
    instead of one array that no task could hold.
    """
    numbered = dense_index(df, keys, pos, "_n", block_rows)
    piece = F.floor(F.col("_n") / F.lit(piece_rows)).alias("piece_no")
    entry = F.struct(F.col("_n"), *[F.col(v) for v in values])
    grouped = numbered.groupBy(*keys, piece).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    arrays = [F.col(f"_e.{v}").alias(v) for v in values]  # a field of an array of structs is an array
    return grouped.select(*keys, "piece_no", *arrays)
