"""JSON envelopes of tables and files, and batch conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rundiff.functions.text import null_if_token
from rundiff.session import cut_lineage
from rundiff.sources.csv import NA_TOKENS, TRUE_TOKENS, cell_kinds, csv_headers, rows_of_records
from rundiff.sources.csv import csv_records as read_records
from rundiff.sources.files import list_files
from rundiff.sources.xml_events import read_xml_events, xml_json

_ROW_PIECES = 4096  # pieces of a document in one row of its parts


def json_value(c: Column) -> Column:
    """JSON text of one value, the empty string for a missing one."""
    listed = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNull(), F.lit('""')).otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def json_record(columns: Sequence[str]) -> Column:
    """JSON object of the given columns. Numbers stay numbers; a missing value is ``""``."""
    fields = [F.concat(json_value(F.lit(c)), F.lit(":"), json_value(F.col(f"`{c}`"))) for c in columns]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def csv_records(df: DataFrame) -> DataFrame:
    """One JSON record per row: ``file_id, row_idx, record``."""
    data = [c for c in df.columns if c not in ("file_id", "row_idx")]
    return df.select("file_id", "row_idx", json_record(data).alias("record"))


def csv_metadata(df: DataFrame) -> DataFrame:
    """Envelope metadata per file: source, number of records, columns, type."""
    data = [c for c in df.columns if c not in ("file_id", "row_idx")]
    return df.groupBy(F.col("file_id").alias("source_file")).agg(
        F.count("*").alias("total_records"),
        F.array(*[F.lit(c) for c in data]).alias("columns"),
        F.lit("csv").alias("file_type"),
    )


def envelope_lines(records: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Text lines ``file_id, pos, text`` that read as one JSON document per file.

    An opening line with the metadata (or none), one line per record, a closing line.
    Joined in the order of ``pos`` they are ``{"metadata": …, "data": […]}``; no document
    is ever held in one row. ``metadata`` needs ``source_file`` and ``total_records``.
    """
    body = records.select(
        "file_id",
        F.col("row_idx").alias("pos"),
        F.when(F.col("row_idx") == 0, F.col("record")).otherwise(F.concat(F.lit(","), F.col("record"))).alias("text"),
    )
    files = (
        records.select("file_id").distinct().withColumn("text", F.lit("["))
        if metadata is None
        else metadata.select(
            F.col("source_file").alias("file_id"),
            F.concat(F.lit('{"metadata":'), F.to_json(F.struct(*metadata.columns)), F.lit(',"data":[')).alias("text"),
        )
    )
    opening = files.select("file_id", F.lit(-1).cast("long").alias("pos"), "text")
    closing = files.select(
        "file_id", F.lit(2**62).alias("pos"), F.lit("]" if metadata is None else "]}").alias("text")
    )
    return opening.unionByName(body).unionByName(closing)


def file_key(name: Column) -> Column:
    """A file name as a folder name: reversible, and safe as it is in any path."""
    coded = F.replace(F.replace(F.url_encode(name), F.lit("_"), F.lit("%5F")), F.lit("*"), F.lit("%2A"))
    return F.translate(coded, "%", "_")


def file_of_key(key: Column) -> Column:
    """The file name that ``file_key`` made a folder name of."""
    return F.url_decode(F.translate(key, "_", "%"))


def write_envelopes(lines: DataFrame, folder: str) -> None:
    """Write envelope lines, one sub-folder ``file=<key>`` per file, its parts in document order.

    Ranges over (file, position) spread one large file over many tasks.
    """
    placed = lines.withColumn("file", file_key(F.col("file_id")))
    ordered = placed.repartitionByRange("file", "pos").sortWithinPartitions("file", "pos")
    ordered.select("file", "text").write.mode("overwrite").partitionBy("file").text(folder)


def row_records(rows: DataFrame, na_tokens: Sequence[str] = tuple(NA_TOKENS)) -> DataFrame:
    """JSON records of CSV rows ``file_id, row_idx, header, cells``, each file with the types of its own cells."""
    kinds = cut_lineage(cell_kinds(rows, na_tokens))

    def value(i: Column) -> Column:
        text = null_if_token(F.try_element_at("cells", (i + 1).cast("int")), na_tokens)
        kind = F.try_element_at("kinds", i)
        return (
            F.when(kind == "long", json_value(text.try_cast("long")))
            .when(kind == "double", json_value(text.try_cast("double")))
            .when(kind == "boolean", json_value(F.when(text.isNotNull(), text.isin(*TRUE_TOKENS))))
            .otherwise(json_value(text))
        )

    def field(name: Column, i: Column) -> Column:
        return F.concat(json_value(name), F.lit(":"), value(i))

    fields = F.array_join(F.transform("header", field), ",")
    record = F.concat(F.lit("{"), fields, F.lit("}")).alias("record")
    return rows.join(kinds, "file_id").select("file_id", "row_idx", record)


def xml_envelopes(df: DataFrame, root_element: str) -> DataFrame:
    """JSON envelope per XML row: metadata with the root element, and the nested data.

    ``file_id, document, well_formed``.
    """
    data = [c for c in df.columns if c not in ("file_id", "_corrupt_record")]
    well_formed = F.col("_corrupt_record").isNull() if "_corrupt_record" in df.columns else F.lit(True)
    meta = F.struct(
        F.col("file_id").alias("source_file"),
        F.lit("xml").alias("file_type"),
        F.lit(root_element).alias("root_element"),
    )
    nested = F.struct(F.struct(*[F.col(f"`{c}`") for c in data]).alias(root_element))
    document = F.to_json(F.struct(meta.alias("metadata"), nested.alias("data")))
    return df.select("file_id", document.alias("document"), well_formed.alias("well_formed"))


def convert_batch(
    spark: SparkSession, folder: str, out: str, glob: str = "*", metadata: bool = True, encoding: str | None = None
) -> DataFrame:
    """Convert all CSV and XML files of a folder and return a status row per file.

    ``filename, output, status, error``. Every listed file has one row, and on success one
    envelope in the sub-folder ``output`` of ``out``. A CSV file without a header, or with a row that
    does not fit it, and XML that does not parse fail; a header alone is an envelope without records.
    The types of a CSV file come from its own cells. File names stay distributed.
    """
    listed = cut_lineage(list_files(spark, folder, glob))
    kinds = {r["extension"] for r in listed.where("rejected is null").select("extension").distinct().collect()}
    name = F.url_decode(F.substring_index("file_id", "/", -1))
    done = spark.createDataFrame([], "file_name string, error string")
    if "csv" in kinds:
        done = done.unionByName(_convert_csv(spark, f"{folder}/{{*.[cC][sS][vV]}}", f"{out}/csv", glob, metadata, encoding))
    if "xml" in kinds:
        done = done.unionByName(_convert_xml(spark, f"{folder}/{{*.[xX][mM][lL]}}", f"{out}/xml", glob))
    nothing = F.when(F.col("extension") == "csv", "no columns to parse").otherwise("no element found")
    statuses = listed.join(done.withColumn("_seen", F.lit(True)), "file_name", "left")
    error = F.coalesce("rejected", "error", F.when(F.col("_seen").isNull(), nothing))
    return statuses.select(F.col("file_name").alias("filename"), "extension", error.alias("error")).select(
        "filename",
        F.when(F.col("error").isNull(), F.concat(F.col("extension"), F.lit("/file="), file_key(F.col("filename")))).alias("output"),
        F.when(F.col("error").isNull(), "Success").otherwise("Failed").alias("status"),
        "error",
    )


def _convert_csv(spark: SparkSession, paths: str, out: str, glob: str, metadata: bool, encoding: str | None) -> DataFrame:
    """Writes an envelope per CSV file whose rows all fit its header; ``file_name, error`` of every file with a header."""
    name = F.url_decode(F.substring_index("file_id", "/", -1))
    records = read_records(spark, paths, encoding, glob).withColumn("file_id", name)
    headers, rows = cut_lineage(csv_headers(records)), cut_lineage(rows_of_records(records))
    errors = rows.groupBy("file_id").agg(F.count("*").alias("total_records"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("row_idx"))).alias("error"))
    files = cut_lineage(headers.join(errors, "file_id", "left").withColumn("total_records", F.coalesce("total_records", F.lit(0))))
    good = files.where("error is null")
    body = row_records(rows.join(good.select("file_id"), "file_id", "left_semi"))
    opening = good.select(F.col("file_id").alias("source_file"), F.col("total_records").cast("long"), F.col("header").alias("columns"), F.lit("csv").alias("file_type"))
    lines = envelope_lines(body, opening) if metadata else _bare_lines(body, good)
    write_envelopes(lines, out)
    return files.select(F.col("file_id").alias("file_name"), "error")


def _bare_lines(records: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of documents without metadata, also of files without records."""
    lines = envelope_lines(records).where(F.col("pos").between(0, 2**62 - 1))
    ends = F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("pos"), F.lit("[").alias("text")), F.struct(F.lit(2**62).alias("pos"), F.lit("]").alias("text"))))
    return lines.unionByName(files.select("file_id", ends.alias("e")).select("file_id", "e.pos", "e.text"))


def _convert_xml(spark: SparkSession, paths: str, out: str, glob: str) -> DataFrame:
    """Writes an envelope per well-formed XML file; ``file_name, error`` of every file with anything in it.

    Pieces are sorted over all tasks by file and place, and a part holds its pieces in rows of bounded number.
    """
    name = F.url_decode(F.substring_index("file_id", "/", -1))
    events = read_xml_events(spark, paths, glob)
    metadata = F.to_json(F.struct(F.col("file_id").alias("source_file"), F.lit("xml").alias("file_type"), "root_element"))
    ends = F.array(
        F.struct(F.array(F.lit(-1).cast("long")).alias("path"), F.concat(F.lit('{"metadata":'), metadata, F.lit(',"data":{')).alias("text")),
        F.struct(F.array(F.lit((1 << 63) - 1)).alias("path"), F.lit("}}").alias("text")),
    )
    pieces = xml_json(events).select("file_id", "path", F.concat("lead", "body", "shut").alias("text"))
    pieces = pieces.unionByName(events.files.where("error is null").select("file_id", F.inline(ends)))
    ordered = pieces.repartitionByRange("file_id", "path").sortWithinPartitions("file_id", "path")
    ordered = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    glued = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "text"))), lambda p: p["text"]), "")
    rows = ordered.groupBy("file_id", F.floor(F.col("_at") / _ROW_PIECES).alias("_row")).agg(glued.alias("text"))
    placed = rows.withColumn("file", file_key(name)).repartitionByRange("file", "_row").sortWithinPartitions("file", "_row")
    placed.select("file", "text").write.mode("overwrite").partitionBy("file").text(out)
    return events.files.select(name.alias("file_name"), "error")


def status_counts(statuses: DataFrame) -> DataFrame:
    """Files by status."""
    return statuses.groupBy("status").agg(F.count("*").alias("files"))
