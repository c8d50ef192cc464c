"""Statements of source files that go on over several lines, from ``path, line_no, text``.

Whether a line starts inside a comment depends on all lines before it. Each line with a comment mark is a map from the
state at its start to the state at its end; maps are composed by running values in blocks of lines, and so is the
number of the statement that a line continues, so no task owns a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rundiff.operators.lookup import merge_join
from rundiff.operators.ordered import BLOCK_ROWS, Running, running
from rundiff.session import cut_lineage

# quoted texts, comments to the end of the line, and comments that end in the line, whichever starts first
_CLEARED = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|//.*|/\*.*?\*/"""
_ANNOTATION = r"@\w+(?:\.\w+)*(?:\s*\([^)]*\))?"


def _clear(text: Column) -> Column:
    return F.regexp_replace(text, _CLEARED, " ")


def _after_comment(text: Column) -> Column:
    """What follows the first end of a comment; empty without one."""
    end = F.instr(text, "*/")
    return F.when(end > 0, F.substr(text, end + 2)).otherwise("")


def with_comment_state(lines: DataFrame, out: str = "in_comment", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds whether each line starts inside a comment.

    Most lines leave the state as it is. A line with a mark sets it, or turns it round (``/*/`` opens a comment in
    code and ends one in a comment). The state after such a line is what the last setting line said, turned round as
    often as lines after it do. Texts in quotes do not go on over a line.
    """
    text = F.col("text")
    opens = lambda c: F.contains(_clear(c), F.lit("/*"))
    marks = lines.where(F.contains(text, F.lit("/*")) | F.contains(text, F.lit("*/")))
    marks = marks.select("path", "line_no", opens(text).alias("_code"), (~F.contains(text, F.lit("*/")) | opens(_after_comment(text))).alias("_comment"))
    turns = (F.col("_code") & ~F.col("_comment")).cast("int")
    marks = cut_lineage(running(cut_lineage(marks), ["path"], "line_no", [Running("_turns", "sum", turns)], block_rows))
    odd = F.col("_turns") % 2
    told = F.when(F.col("_code") == F.col("_comment"), F.col("line_no") * 2 + F.col("_code").cast("int").bitwiseXOR(odd.cast("int")))
    marks = running(marks, ["path"], "line_no", [Running("_set", "max", told)], block_rows)
    after = (F.coalesce(F.col("_set") % 2, F.lit(0)) + odd) % 2
    marks = cut_lineage(marks.select(F.col("path").alias("_p"), F.col("line_no").alias("_l"), (F.col("line_no") * 2 + after).alias("_after")))
    marked = merge_join(lines, marks, (F.col("path") == F.col("_p")) & (F.col("line_no") == F.col("_l")), "left").drop("_p", "_l")
    last = running(cut_lineage(marked), ["path"], "line_no", [Running("_last", "max", F.col("_after"), exclusive=True)], block_rows)
    return last.withColumn(out, F.coalesce(F.col("_last") % 2 == 1, F.lit(False))).drop("_after", "_last")


def code_lines(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``path, line_no, code``: the lines without comments, and with a space for every quoted text."""
    text = F.when(F.col("in_comment"), _after_comment(F.col("text"))).otherwise(F.col("text"))
    code = F.substring_index(_clear(text), "/*", 1)
    return with_comment_state(lines.select("path", "line_no", "text"), block_rows=block_rows).select("path", "line_no", code.alias("code"))


def long_statements(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``path, start_line, last_line, statement``: what stands between two of ``{};`` on more than one line.

    The statement ends with its ``{`` or ``;``; white space is squeezed, comments, quoted texts and annotations before
    it are left out. It starts on the line of its first other word. A statement is put together in one task.
    """
    code = F.col("code")
    ends = F.length(code) - F.length(F.translate(code, "{};", ""))
    counted = cut_lineage(code_lines(lines, block_rows).where(F.trim(code) != "").withColumn("_ends", ends.cast("long")))
    numbered = running(counted, ["path"], "line_no", [Running("_before", "sum", F.col("_ends"), exclusive=True)], block_rows)
    head = F.struct(F.col("_before").alias("no"), F.when(F.col("_ends") > 0, F.regexp_extract(code, r"^[^{};]*[{};]", 0)).otherwise(code).alias("part"))
    tail = F.struct((F.col("_before") + F.col("_ends")).alias("no"), F.when(F.col("_ends") > 0, F.regexp_extract(code, r"[^{};]*$", 0)).alias("part"))
    parts = numbered.select("path", "line_no", F.inline(F.array(head, tail)))
    parts = parts.withColumn("part", F.trim(F.regexp_replace("part", r"\s+", " ")))
    parts = parts.where((F.col("part") != "") & ~F.col("part").rlike(f"^(?:{_ANNOTATION}\\s*)+$"))
    whole = parts.groupBy("path", "no").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("last_line"), F.sort_array(F.collect_list(F.struct("line_no", "part"))).alias("_parts")
    )
    whole = whole.where("start_line < last_line")
    statement = F.regexp_replace(F.array_join(F.col("_parts.part"), " "), f"^(?:{_ANNOTATION}\\s*)+", "")
    return whole.select("path", "start_line", "last_line", statement.alias("statement")).where(F.col("statement").rlike(r"[{;]$"))
