"""XML scans into nested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of attributes and of text next to them; all text stays text.
XML_OPTIONS = {"attributePrefix": "@", "valueTag": "#text", "inferSchema": "false"}


def read_xml(spark: SparkSession, paths: str | Sequence[str], row_tag: str, schema=None) -> DataFrame:
    """One nested row per ``row_tag`` element, with ``file_id``.

    For large files take the repeated element as the tag: the reader then splits a file
    between its elements. A row that cannot be parsed has ``_corrupt_record`` set.
    """
    reader = spark.read.format("xml").options(rowTag=row_tag, mode="PERMISSIVE", **XML_OPTIONS)
    if schema is not None:
        reader = reader.schema(schema)
    scan = reader.load(paths)
    return scan.select("*", F.col("_metadata.file_path").alias("file_id"))


def root_elements(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.xml") -> DataFrame:
    """Root element name per XML file: the first start tag."""
    scan = spark.read.option("pathGlobFilter", glob).text(paths)
    tag = F.regexp_extract("value", r"<([A-Za-z_][\w.:-]*)", 1)
    lines = scan.select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"),
        tag.alias("tag"),
    )
    first = F.min(F.when(F.col("tag") != "", F.struct("_at", "_id", "tag")))
    return lines.groupBy("file_id").agg(first.getField("tag").alias("root_element"))


def parse_xml(text: Column, schema: str) -> Column:
    """XML text of a column as a struct, under the same conventions."""
    return F.from_xml(text, schema, {**XML_OPTIONS, "mode": "PERMISSIVE"})
