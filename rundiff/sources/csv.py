"""CSV scans with the encoding and the record form found per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rundiff.functions.text import null_if_token
from rundiff.operators.ordered import Running, dense_index, running
from rundiff.session import cut_lineage
from rundiff.sources.files import with_row_index

# Text that stands for a missing value.
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


def probe_files(spark: SparkSession, paths: str | Sequence[str], glob: str = "*") -> DataFrame:
    """Encoding, record form and header per file: ``file_id, encoding, multi_line, blank_lines, header``.

    One scan by line, so files of any size are split over tasks. A line is never cut
    inside a UTF-8 character, hence a file is UTF-8 when each of its lines is. A line
    with an odd number of quotes means that a record may span lines.
    """
    scan = spark.read.option("pathGlobFilter", glob).text(paths)
    lines = scan.select(
        "value", F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("_at")
    ).withColumn("_id", F.monotonically_increasing_id())
    odd_quotes = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    return lines.groupBy("file_id").agg(
        F.when(F.bool_and(F.is_valid_utf8("value")), "UTF-8").otherwise("ISO-8859-1").alias("encoding"),
        F.bool_or(odd_quotes).alias("multi_line"),
        F.bool_or(F.trim(F.translate("value", "\r", "")) == "").alias("blank_lines"),
        F.min(F.when(F.col("_at") == 0, F.struct("_id", "value"))).getField("value").alias("header"),
    )


# One cell and the comma after it; nothing here gives back, so long cells take linear time.
_CELL = r'\G("(?:[^"]++|"")*+"[^,]*+|[^,]*+),'
_QUOTED = r'^"((?:[^"]++|"")*+)"([^,]*)$'


def split_cells(record: Column) -> Column:
    """Cells of one CSV record, quotes removed. A record with an open quote ends before that cell."""

    def cell(c: Column) -> Column:
        inner = F.replace(F.regexp_extract(c, _QUOTED, 1), F.lit('""'), F.lit('"'))
        return F.when(c.startswith('"'), F.concat(inner, F.regexp_extract(c, _QUOTED, 2))).otherwise(c)

    return F.transform(F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_CELL), F.lit(1)), cell)


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, '"', ""))


def csv_records(
    spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None, glob: str = "*"
) -> DataFrame:
    """Records of CSV files as text: ``file_id, n, record``; record 0 is the header, blank lines do not count.

    Files are read by line, so a file of any size and form is spread over tasks. Where a file has a
    line with an odd number of quotes, a record goes on until its quotes are even; a running
    sum of quotes finds the lines that start one.
    """
    probed = cut_lineage(probe_files(spark, paths, glob).select("file_id", "encoding", "multi_line", "blank_lines"))
    scan = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(paths)
    raw = with_row_index(scan).join(probed, "file_id")
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    if encoding is not None:
        text = F.decode(F.col("value").cast("binary"), encoding)
    else:
        text = F.when(F.col("encoding") == "UTF-8", F.col("value")).otherwise(latin)
    text = F.regexp_replace(F.when(F.col("row_idx") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text), "\r$", "")
    lines = raw.select("file_id", "row_idx", text.alias("line"), (F.col("multi_line") | F.col("blank_lines")).alias("_odd"))
    plain = lines.where(~F.col("_odd")).select("file_id", F.col("row_idx").alias("n"), F.col("line").alias("record"))

    other = lines.where("_odd").select("file_id", "row_idx", "line")
    before = running(other, ["file_id"], "row_idx", [Running("_before", "sum", _quotes(F.col("line")), exclusive=True)])
    starts = F.when(F.col("_before") % 2 == 0, 1).otherwise(0).cast("long")
    numbered = running(before, ["file_id"], "row_idx", [Running("_record", "sum", starts)])
    parts = F.sort_array(F.collect_list(F.struct("row_idx", "line")))
    joined = numbered.groupBy("file_id", "_record").agg(F.array_join(parts.getField("line"), "\n").alias("record"))
    kept = joined.where(F.trim("record") != "")
    return plain.unionByName(dense_index(kept, ["file_id"], "_record", "n").select("file_id", "n", "record"))


def csv_rows(
    spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None, glob: str = "*"
) -> DataFrame:
    """Data rows of CSV files with a header: ``file_id, row_idx, header, cells, problem``.

    ``problem`` says why a row cannot be read: more cells than the header, or an open quote. Files of
    different headers come in one DataFrame, so nothing depends on how many there are.
    """
    return rows_of_records(csv_records(spark, paths, encoding, glob))


def rows_of_records(records: DataFrame) -> DataFrame:
    """Data rows of the records of ``csv_records``, with the header of their file."""
    headers = csv_headers(records)
    cells = split_cells(F.col("record"))
    rows = records.where("n > 0").select("file_id", (F.col("n") - 1).alias("row_idx"), cells.alias("cells"), (_quotes(F.col("record")) % 2 == 1).alias("_open"))
    problem = F.when(F.col("_open"), F.lit("a quote is not closed")).when(
        F.size("cells") > F.size("header"),
        F.concat(F.lit("expected "), F.size("header"), F.lit(" cells in row "), F.col("row_idx") + 1, F.lit(", saw "), F.size("cells")),
    )
    return rows.join(headers, "file_id").select("file_id", "row_idx", "header", "cells", problem.alias("problem"))


def csv_headers(records: DataFrame) -> DataFrame:
    """Column names per file: ``file_id, header``."""
    return records.where("n = 0").select("file_id", split_cells(F.col("record")).alias("header"))


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    encoding: str | None = None,
    infer: bool = True,
    na_tokens: Sequence[str] = tuple(NA_TOKENS),
) -> DataFrame:
    """CSV files with a header, ``file_id`` and ``row_idx``; files are united by column name.

    Without an encoding, a file that is not UTF-8 is read as ISO-8859-1. ``infer=False``
    leaves every column as text. A row that does not fit its header is an error when it is read.
    The distinct headers come to the driver, as column names have to.
    """
    rows = csv_rows(spark, paths, encoding)
    seen = rows.select("header").distinct().collect() or csv_headers(csv_records(spark, paths, encoding)).select("header").distinct().collect()
    names = list(dict.fromkeys(name for r in sorted(tuple(r["header"]) for r in seen) for name in r))
    if not names:
        raise ValueError(f"no CSV file at {paths}")
    failed = F.raise_error(F.concat("file_id", F.lit(": "), "problem"))
    cells = F.when(F.col("problem").isNotNull(), failed.cast("array<string>")).otherwise(F.col("cells"))
    rows = rows.withColumn("cells", cells)

    def cell(name: str) -> Column:
        place = F.array_position("header", F.lit(name)).cast("int")
        value = F.when(place > 0, F.try_element_at("cells", F.nullif(place, F.lit(0))))
        return (null_if_token(value, na_tokens) if na_tokens else value).alias(name)

    table = rows.select("file_id", *[cell(name) for name in names], "row_idx")
    return infer_types(table, names) if infer else table


def cell_kinds(rows: DataFrame, na_tokens: Sequence[str] = tuple(NA_TOKENS)) -> DataFrame:
    """What each column of each file holds: ``file_id, kinds`` (column number to long, double, boolean or string)."""
    cells = rows.select("file_id", F.posexplode("cells").alias("column", "cell"))
    text = null_if_token(F.col("cell"), na_tokens)
    long, double, boolean = _tests(text)
    flags = cells.groupBy("file_id", "column").agg(F.every(long).alias("l"), F.every(double).alias("d"), F.every(boolean).alias("b"), F.count(text).alias("n"))
    kind = F.when(F.col("n") == 0, "double").when(F.col("b"), "boolean").when(F.col("l"), "long").when(F.col("d"), "double").otherwise("string")
    return flags.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("column", kind.alias("kind")))).alias("kinds"))


def _tests(text: Column) -> tuple[Column, Column, Column]:
    """Whether a missing or present value may be a long, a double, a boolean."""
    return (
        text.try_cast("long").isNotNull() & ~text.rlike(r"[.eE]") | text.isNull(),
        text.try_cast("double").isNotNull() & ~text.rlike(r"[dDfF]$") | text.isNull(),
        text.isin(*TRUE_TOKENS, *FALSE_TOKENS) | text.isNull(),
    )


def infer_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast text columns to long, double or boolean where every value allows it.

    One aggregation over the table decides; a column of missing values becomes double.
    """
    tests = []
    for i, c in enumerate(columns):
        text = F.col(f"`{c}`")
        tests += [F.every(t).alias(f"{k}{i}") for k, t in zip("ldb", _tests(text))]
        tests.append(F.count(text).alias(f"n{i}"))
    found = df.agg(*tests).head()
    cells = {}
    for i, c in enumerate(columns):
        text = F.col(f"`{c}`")
        if found[f"n{i}"] == 0:
            cells[c] = text.cast("double")
        elif found[f"b{i}"]:
            cells[c] = text.isin(*TRUE_TOKENS)
        elif found[f"l{i}"]:
            cells[c] = text.cast("long")
        elif found[f"d{i}"]:
            cells[c] = text.cast("double")
    return df.select(*[cells[c].alias(c) if c in cells else F.col(f"`{c}`") for c in df.columns])
