"""Comparison pipelines: row diff, run diff, chunked conflict text and the fast summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rundiff.functions import scores
from rundiff.functions.numbers import fixed
from rundiff.operators import hotspots, noise, packing, rows, runs
from rundiff.operators.ordered import BLOCK_ROWS, dense_index, list_pieces
from rundiff.session import cut_lineage

# List lengths of the summary, and the rule between two conflict sections.
TOP_TIMING, TOP_FUNCTIONS, TOP_THREADS = 20, 15, 10
SECTION_RULE = "=" * 80

# A range of n rows gets 16 positions per row, enough for its 2n lines and 11 frame lines.
_WIDTH = 16


@dataclass(frozen=True)
class RowComparison:
    """Result of ``compare_rows``: typed row pairs that differ, and their ranges."""

    pairs: DataFrame
    ranges: DataFrame
    keys: tuple[str, ...]


def compare_rows(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    block_rows: int = BLOCK_ROWS,
    reuse: bool = False,
    digest_rows: int = rows.DIGEST_ROWS,
) -> RowComparison:
    """Positional comparison of two tables with a dense ``row_idx``.

    Blocks of rows are compared by digest first; only those that differ are paired, and only rows that differ are
    written. The tables are read twice, so number their rows cheaply, as a file scan does.
    ``reuse`` writes the differing rows to the checkpoint folder, so that several reports
    on them do not compare the tables again.
    """
    pairs = rows.with_ranges(rows.differing_rows(a, b, keys, columns, digest_rows), keys, block_rows)
    pairs = cut_lineage(pairs) if reuse else pairs
    return RowComparison(pairs, rows.conflict_ranges(pairs, keys), tuple(keys))


def comparison_summary(ranges: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """One row: file names, number of ranges and whether anything differs."""
    return ranges.agg(
        F.lit(file_a).alias("file_a_name"),
        F.lit(file_b).alias("file_b_name"),
        F.count("*").alias("conflict_count"),
        (F.count("*") > 0).alias("has_differences"),
        F.current_timestamp().alias("analysis_timestamp"),
    )


def range_sections(result: RowComparison, piece_rows: int = 10_000) -> DataFrame:
    """Lines of both sides per range, as ordered arrays of bounded length."""
    return list_pieces(result.pairs, [*result.keys, "range_start"], "row_idx", ["a_line", "b_line"], piece_rows)


def export_conflicts(result: RowComparison, folder: str) -> None:
    """Write ranges and their sections as JSON lines."""
    result.ranges.write.mode("overwrite").json(f"{folder}/ranges")
    range_sections(result).write.mode("overwrite").json(f"{folder}/sections")


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keyed comparison of two profiler tables with ``row_idx``, in line order."""
    conflicts = runs.compare_calls(runs.profile_rows(a, keys), runs.profile_rows(b, keys), keys)
    return conflicts.orderBy(*keys, *runs.conflict_order())


def _joined(lines: DataFrame, keys: Sequence[str], out: str = "text") -> DataFrame:
    """Ordered lines ``pos, line`` of a short report as one text per key."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy(*keys).agg(F.array_join(listed.getField("line"), "\n").alias(out))


def conflict_export_text(conflicts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Conflicts as text: totals, then the first high and the first medium ones."""
    totals = runs.conflict_totals(conflicts, keys)
    head = F.array(
        F.lit("=== LINE-BY-LINE COMPARISON CONFLICTS ==="),
        F.concat(F.lit("Total conflicts: "), F.col("total_conflicts")),
        F.concat(F.lit("High severity: "), F.col("high")),
        F.concat(F.lit("Medium severity: "), F.col("medium")),
        F.lit(""),
    )
    heading = F.array_join(head, "\n")
    high_title = F.when(F.col("high") > 0, "HIGH SEVERITY CONFLICTS (>1000ms difference):")
    medium_title = F.when(F.col("medium") > 0, "MEDIUM SEVERITY CONFLICTS:")
    titles = totals.select(
        *keys,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit(0).alias("pos"), heading.alias("line")),
                    F.struct(F.lit(100).alias("pos"), high_title.alias("line")),
                    F.struct(F.lit(200).alias("pos"), medium_title.alias("line")),
                ),
                lambda x: x["line"].isNotNull(),
            )
        ).alias("_x"),
    ).select(*keys, "_x.pos", "_x.line")
    delta = scores.ms_text(F.col("time_delta"), signed=True)
    is_high = F.col("severity") == "high"
    change = F.when(F.col("time_delta").isNotNull(), F.concat(F.lit("  Time change: "), delta))
    block = F.array(
        F.concat(F.lit("Line "), F.col("line_number"), F.lit(": "), F.col("function_name")),
        F.when(is_high, F.concat(F.lit("  File A: "), F.col("file_a_content"))),
        F.when(is_high, F.concat(F.lit("  File B: "), F.col("file_b_content"))),
        F.coalesce(change, F.lit("  Content difference detected")),
        F.lit(""),
    )
    listed = runs.first_by_severity(conflicts, keys).select(
        *keys,
        (F.when(is_high, 100).otherwise(200) + F.col("rank")).alias("pos"),
        F.array_join(block, "\n").alias("line"),
    )
    return _joined(titles.unionByName(listed), keys)


def _comparison_lines(result: RowComparison, file_a: str, file_b: str, block_rows: int) -> DataFrame:
    """All text lines of a comparison in order: ``keys, pos, line``."""
    keys = list(result.keys)
    group = [*keys, "range_start", "side"]
    both = F.explode(
        F.array(
            F.struct(F.lit("a").alias("side"), F.col("a_line").alias("line")),
            F.struct(F.lit("b").alias("side"), F.col("b_line").alias("line")),
        )
    )
    raw = result.pairs.select(*keys, "range_start", "row_idx", both.alias("_s"))
    raw = raw.select(*keys, "range_start", "row_idx", "_s.side", "_s.line")
    reduced = noise.reduce_noise(raw, group, "row_idx", "line", block_rows)

    frame = dense_index(result.ranges, keys, "start_row", "range_no", block_rows).select(
        *keys,
        (F.col("start_row") - 1).alias("range_start"),
        F.col("row_count").alias("n"),
        F.concat(
            F.lit("CONFLICT RANGE #"), F.col("range_no") + 1, F.lit(" (Rows "), F.col("start_row"), F.lit("-"),
            F.col("end_row"), F.lit("):"),
        ).alias("title"),
        "conflict_type",
        "description",
    )
    kept = reduced.groupBy(*keys, "range_start").agg(
        *[F.max(F.col("side") == s).alias(f"has_{s}") for s in ("a", "b")]
    )
    framed = frame.join(kept, [*keys, "range_start"], "left")

    def at(offset: Column, line: Column) -> Column:
        return F.struct((F.col("range_start") * _WIDTH + offset).alias("pos"), line.alias("line"))

    n = F.col("n")
    parts = [
        at(F.lit(0), F.lit("")),
        at(F.lit(1), F.col("title")),
        at(F.lit(2), F.lit("")),
        at(F.lit(3), F.lit(f"File A ({file_a}):")),
        at(F.lit(4), F.when(~F.coalesce("has_a", F.lit(False)), "")),
        at(n + 4, F.lit("")),
        at(n + 5, F.lit(f"File B ({file_b}):")),
        at(n + 6, F.when(~F.coalesce("has_b", F.lit(False)), "")),
        at(n * 2 + 6, F.lit("")),
        at(n * 2 + 7, F.concat(F.lit("Conflict Type: "), F.col("conflict_type"))),
        at(n * 2 + 8, F.concat(F.lit("Description: "), F.col("description"))),
        at(n * 2 + 9, F.lit(SECTION_RULE)),
        at(n * 2 + 10, F.lit("")),
    ]
    frames = framed.select(*keys, F.explode(F.array(*parts)).alias("_x")).select(*keys, "_x.pos", "_x.line")
    sized = reduced.join(frame.select(*keys, "range_start", "n"), [*keys, "range_start"])
    offset = F.col("row_idx") - F.col("range_start") + F.when(F.col("side") == "a", 4).otherwise(n + 6)
    body = sized.select(*keys, (F.col("range_start") * _WIDTH + offset).alias("pos"), "line")
    return frames.where("line is not null").unionByName(body)


def prepare_chunks(
    result: RowComparison,
    file_a: str,
    file_b: str,
    max_chunk_size: int = packing.COMPARISON_CHUNK,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Noise-reduced conflict text in size-bounded chunks: ``keys, chunk_no, text, …``."""
    lines = cut_lineage(_comparison_lines(result, file_a, file_b, block_rows))
    chunked = packing.chunk_lines(lines, result.keys, "pos", "line", max_chunk_size)
    return packing.chunk_texts(chunked, result.keys, "pos", "line")


def compression(result: RowComparison, chunks: DataFrame) -> DataFrame:
    """Characters before and after the reduction, and percent saved, per file pair."""
    keys = list(result.keys)
    per_range = result.pairs.groupBy(*keys, "range_start").agg(
        (F.sum(F.length("a_line") + F.length("b_line") + 2) - 2).alias("size")
    )
    raw = per_range.groupBy(*keys).agg(F.sum("size").alias("raw_chars"))
    reduced = chunks.groupBy(*keys).agg((F.sum(F.col("char_count") + 1) - 1).alias("reduced_chars"))
    joined = raw.join(reduced, keys) if keys else raw.withColumn("reduced_chars", reduced.scalar())
    return joined.withColumn(
        "compression_percent", noise.compression_ratio(F.col("raw_chars"), F.col("reduced_chars"))
    )


def _first(df: DataFrame, n: int, order: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """The first ``n`` rows (per key) with their ``rank``."""
    if not keys:
        df = df.orderBy(*order).limit(n)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def top_changes(result: RowComparison) -> DataFrame:
    """The largest timing and the first function and thread changes, ranked per kind."""
    keys = list(result.keys)
    changes = rows.line_changes(result.pairs)
    numbered = dense_index(result.ranges, keys, "start_row", "range_no").select(
        *keys, (F.col("start_row") - 1).alias("range_start"), (F.col("range_no") + 1).alias("range_no")
    )
    in_order = [F.col("range_start"), F.col("row_idx")]
    kinds = [
        ("timing", TOP_TIMING, [F.abs("delta").desc(), *in_order]),
        ("function", TOP_FUNCTIONS, in_order),
        ("thread", TOP_THREADS, in_order),
    ]
    listed = [
        _first(changes.where(f"{kind}_change"), n, order, keys).withColumn("kind", F.lit(kind))
        for kind, n, order in kinds
    ]
    top = listed[0].unionByName(listed[1]).unionByName(listed[2])
    wanted = ["range_start", "row_idx", "function_a", "function_b", "time_a", "time_b", "delta", "delta_percent"]
    return top.select(*keys, "kind", "rank", *wanted).join(numbered, [*keys, "range_start"])


def fast_summary(result: RowComparison, file_a: str, file_b: str) -> DataFrame:
    """Structured summary text per file pair: counts and the top changes of each kind."""
    keys = list(result.keys)
    counts = rows.change_counts(rows.line_changes(result.pairs), keys)
    totals = result.ranges.groupBy(*keys).agg(F.count("*").alias("conflicts"))
    counts = counts.join(totals, keys) if keys else counts.withColumn("conflicts", totals.scalar())

    def more(total: str, shown: int, kind: str) -> Column:
        text = F.concat(F.lit("... and "), F.col(total) - shown, F.lit(f" more {kind} changes"))
        return F.when(F.col(total) > shown, text)

    entries = [
        (0, F.lit("# STRUCTURED DIFF SUMMARY\n\n## Files Compared:")),
        (1, F.lit(f"- File A: {file_a}\n- File B: {file_b}\n\n## Conflict Statistics:")),
        (2, F.concat(F.lit("- Total conflicts: "), F.col("conflicts"))),
        (3, F.concat(F.lit("- Timing changes detected: "), F.col("timing_changes"))),
        (4, F.concat(F.lit("- Function changes detected: "), F.col("function_changes"))),
        (5, F.concat(F.lit("- Thread-related changes: "), F.col("thread_changes"))),
        (6, F.lit("\n## Major Timing Changes (>0.1ms difference):")),
        (199, more("timing_changes", TOP_TIMING, "timing")),
        (200, F.lit("\n## Function Changes:")),
        (299, more("function_changes", TOP_FUNCTIONS, "function")),
        (300, F.lit("\n## Thread-Related Changes:")),
        (399, more("thread_changes", TOP_THREADS, "thread")),
    ]
    frame = F.array(*[F.struct(F.lit(p).alias("pos"), t.alias("line")) for p, t in entries])
    fixed_lines = counts.select(*keys, F.explode(frame).alias("_x")).select(*keys, "_x.pos", "_x.line")
    arrow = F.lit(" → ")
    a, b = F.col("function_a"), F.col("function_b")
    timing = F.concat(
        *[F.lit("- "), a, F.lit(": "), fixed(F.col("time_a"), 2), F.lit("ms"), arrow, fixed(F.col("time_b"), 2)],
        *[F.lit("ms ("), fixed(F.col("delta"), 2, True), F.lit("ms, "), fixed(F.col("delta_percent"), 1, True)],
        F.lit("%)"),
    )
    place = F.concat(F.lit("- Range "), F.col("range_no"), F.lit(": "))
    line = (
        F.when(F.col("kind") == "timing", timing)
        .when(F.col("kind") == "function", F.concat(place, a, arrow, b))
        .otherwise(F.concat(place, F.lit("Thread behavior change: "), a, F.lit(" -> "), b))
    )
    base = F.when(F.col("kind") == "timing", 100).when(F.col("kind") == "function", 200).otherwise(300)
    changes = top_changes(result).select(*keys, (base + F.col("rank")).alias("pos"), line.alias("line"))
    return _joined(fixed_lines.where("line is not null").unionByName(changes), keys, "summary")


def hotspot_report(spots: DataFrame, n: int = hotspots.TOP_HOTSPOTS, keys: Sequence[str] = ()) -> DataFrame:
    """Report lines of the top hotspots in order: ``rank, headline, times, recommendation``."""
    best = hotspots.recommendations(spots, n, keys)
    a, b = fixed(F.col("file_a_time"), 1), fixed(F.col("file_b_time"), 1)
    factor = fixed(F.col("regression_factor"), 1)
    return best.select(
        "rank",
        F.concat(F.col("rank"), F.lit(". "), F.col("location"), F.lit(" "), F.col("change")).alias("headline"),
        F.concat(
            F.lit("File A: "), a, F.lit("ms → File B: "), b, F.lit("ms ("), factor, F.lit("x)")
        ).alias("times"),
        F.when(
            F.col("rank") <= hotspots.TOP_RECOMMENDATIONS,
            F.concat(F.col("function_name"), F.lit(": "), F.col("recommendation")),
        ).alias("recommendation"),
    )
