"""Queries over splits, noise removal, chunks and conversions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rundiff.functions import text as tx
from rundiff.functions.numbers import rounded
from rundiff.operators import noise, packing, split
from rundiff.plans import compare, prompts
from rundiff.plans.convert import split_and_convert
from rundiff.session import shared_folder
from rundiff.sinks.json import convert_batch, csv_metadata, csv_records, envelope_lines
from rundiff.sources.csv import read_csv
from rundiff.sources.xml import parse_xml
from rundiff.sources.xml_events import read_xml_events, xml_json, xml_rows
from workload.diffs import SHAPE, _compared_whole, _pairs
from workload.inputs import CALLS, DOC_LINES, PROFILE_TEXT, RUN_ROWS, doc_lines, profile_text, table
from workload.registry import query

# Orders are numbered 0, 1, 2, … by their key, so the key is the row number.
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*_ORDERS, F.col("o_orderkey").alias("row_idx"))


@query(
    select="""SELECT part_id, count(*) AS row_count, 5 AS column_count, min(o_orderkey) + 1 AS first_row, max(o_orderkey) + 1 AS last_row,
  printf('orders_part_%03d_rows_%d_to_%d.csv', part_id + 1, min(o_orderkey) + 1, max(o_orderkey) + 1) AS filename
FROM (SELECT *, o_orderkey // 100 AS part_id FROM orders) GROUP BY part_id"""
)
def split_rows(spark, sf_dir):
    parts = split.split_table(_orders(spark, sf_dir), "rows", rows_per_part=100)
    manifest = split.part_manifest(parts, ["part_id"])
    name = split.row_part_name("orders", F.col("part_id"), F.col("first_row"), F.col("last_row"))
    return manifest.withColumn("filename", name)


@query(
    select="""SELECT o_orderpriority AS group_value, substr(translate(o_orderpriority, '/\\:', '___'), 1, 50) AS group_name,
  count(*) AS row_count, min(o_orderkey) + 1 AS first_row, max(o_orderkey) + 1 AS last_row FROM orders GROUP BY o_orderpriority"""
)
def split_column(spark, sf_dir):
    parts = split.split_table(_orders(spark, sf_dir), "column", column="o_orderpriority")
    return split.part_manifest(parts, ["group_value", "group_name"]).drop("column_count")


_ROW_BYTES = "octet_length(o_orderstatus) + octet_length(o_orderpriority) + 30"


@query(
    select="""SELECT part_id, rows_per_part, count(*) AS row_count FROM (
  SELECT o_orderkey // n AS part_id, n AS rows_per_part FROM orders, (SELECT greatest(1, CAST(floor(0.05 * 1024 * 1024 /
    (sum(octet_length(encode(o_orderstatus)) + octet_length(encode(o_orderpriority)) + 30) / count(*))) AS BIGINT)) AS n FROM orders)) GROUP BY part_id, rows_per_part"""
)
def split_size(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    parts = split.split_table(orders, "size", max_mb=0.05, row_bytes=F.expr(_ROW_BYTES))
    return parts.groupBy("part_id", "rows_per_part").agg(F.count("*").alias("row_count"))


HEADING = r"""(regexp_matches(regexp_replace(regexp_replace({v}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g'), '^\p{{Lu}}')
  AND trim({v}, E'"'' \t') <> 'Self time')"""
FIRST_FIELD = r"""CASE WHEN starts_with({l}, '"') THEN CASE WHEN regexp_matches({l}, '^"((?:[^"]|"")*)"(?:[^"]|$)')
    THEN replace(regexp_extract({l}, '^"((?:[^"]|"")*)"(?:[^"]|$)', 1), '""', '"') ELSE substr({l}, 2) END
  ELSE split_part({l}, ',', 1) END"""
STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query(
    DOC_LINES,
    select=f"""SELECT doc_id, line_no, field, {HEADING.format(v="field")} AS is_heading,
  regexp_matches({STRIP.format(c="line")}, '^\\p{{Lu}}') AS is_table_heading
FROM (SELECT *, {FIRST_FIELD.format(l="line")} AS field FROM doc_lines)""",
)
def heading_flags(spark, sf_dir):
    line = F.col("line")
    field = tx.first_field(line)
    return doc_lines(spark, sf_dir).select(
        "doc_id",
        "line_no",
        field.alias("field"),
        tx.is_heading(field).alias("is_heading"),
        tx.is_heading(line, "table").alias("is_table_heading"),
    )


def _sections(heading):
    return f"""
sections AS (SELECT * FROM (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_id
  FROM (SELECT *, {heading} AS opens FROM (SELECT doc_id, line_no, line, {FIRST_FIELD.format(l="line")} AS field
    FROM (SELECT doc_id, line_no, {STRIP.format(c="line")} AS line FROM doc_lines) WHERE line <> ''))) WHERE section_id > 0)"""


@query(
    DOC_LINES,
    _sections(HEADING.format(v="field")),
    select="""SELECT doc_id, section_id, max(field) FILTER (opens) AS heading, count(*) AS line_count, min(line_no) AS first_line,
  substr(regexp_replace(translate(max(field) FILTER (opens), '/\\:', '___'), '[^\\p{L}\\p{N}\\-_()\\[\\]]', '', 'g'), 1, 50) AS safe_name
FROM sections GROUP BY doc_id, section_id""",
)
def split_sections(spark, sf_dir):
    lines = doc_lines(spark, sf_dir).withColumnRenamed("line_no", "row_idx")
    sections = split.split_lines_by_sections(lines, ["doc_id"])
    return (
        sections.groupBy("doc_id", "section_id")
        .agg(F.max("heading").alias("heading"), F.count("*").alias("line_count"), F.min("row_idx").alias("first_line"))
        .withColumn("safe_name", tx.safe_section_name(F.col("heading")))
    )


@query(
    """
opened AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS section_id FROM events)""",
    select="""SELECT user_id, section_id, count(*) AS row_count, min(event_id) AS first_event, max(event_id) AS last_event
FROM opened WHERE section_id > 0 GROUP BY user_id, section_id""",
)
def split_event_sections(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    opens = F.col("event_type") == "signup"
    sections = split.split_by_sections(events, "event_type", ["user_id"], heading=opens, pos="event_id")
    return sections.groupBy("user_id", "section_id").agg(
        F.count("*").alias("row_count"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    )


@query(
    """
opened AS (SELECT *, sum(CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY event_id) AS section_id
  FROM (SELECT *, CASE WHEN user_id < (SELECT avg(user_id) FROM events) THEN 'A' ELSE 'B' END AS run FROM events)),
starts AS (SELECT run, section_id, max(event_type) FILTER (event_type IN ('signup', 'purchase')) AS heading, count(*) AS rows
  FROM opened WHERE section_id > 0 GROUP BY run, section_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run, heading ORDER BY section_id) - 1 AS occurrence FROM starts)""",
    select="""SELECT heading, occurrence, a.section_id AS section_a, a.rows AS rows_a, b.section_id AS section_b, b.rows AS rows_b
FROM (SELECT * FROM numbered WHERE run = 'A') a FULL JOIN (SELECT * FROM numbered WHERE run = 'B') b USING (heading, occurrence)""",
)
def sections_matched(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    middle = table(spark, sf_dir, "events").agg(F.avg("user_id")).scalar()
    opens = F.col("event_type").isin("signup", "purchase")
    low, high = events.where(F.col("user_id") < middle), events.where(F.col("user_id") >= middle)
    a, b = (split.split_by_sections(side, "event_type", heading=opens, pos="event_id") for side in (low, high))
    return split.sections_matched(a, b)


@query(
    select="""SELECT source, count(*) AS total_rows, sum(n_chars) AS file_size_bytes, 3 AS total_columns,
  CASE WHEN count(*) <= 100 THEN greatest(1, count(*) // 5) WHEN count(*) <= 1000 THEN 100 WHEN count(*) <= 10000 THEN 500
    WHEN count(*) <= 100000 THEN 1000 ELSE 2000 END AS recommended_rows_per_file,
  greatest(1, count(*) // CASE WHEN count(*) <= 100 THEN greatest(1, count(*) // 5) WHEN count(*) <= 1000 THEN 100 WHEN count(*) <= 10000 THEN 500
    WHEN count(*) <= 100000 THEN 1000 ELSE 2000 END) AS estimated_output_files,
  CAST(printf('%.2f', sum(n_chars) / 1048576.0) AS DOUBLE) AS file_size_mb FROM documents GROUP BY source"""
)
def table_profile(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars")
    return split.table_profile(documents, ["source"], F.col("n_chars"))


@query(
    select="""SELECT n, recommended_rows_per_file, greatest(1, n // recommended_rows_per_file) AS estimated_output_files FROM (
  SELECT o_orderkey AS n, CASE WHEN o_orderkey <= 100 THEN greatest(1, o_orderkey // 5) WHEN o_orderkey <= 1000 THEN 100
    WHEN o_orderkey <= 10000 THEN 500 WHEN o_orderkey <= 100000 THEN 1000 ELSE 2000 END AS recommended_rows_per_file FROM orders)"""
)
def recommended_split(spark, sf_dir):
    rows = split.recommended_rows(F.col("n"))
    counts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    return counts.withColumn("recommended_rows_per_file", rows).withColumn(
        "estimated_output_files", split.estimated_parts(F.col("n"), F.col("recommended_rows_per_file"))
    )


@query(
    select="""SELECT total_split_files, total_rows, total_bytes FROM (SELECT count(DISTINCT l_returnflag || l_linestatus) AS total_split_files,
  count(*) AS total_rows, CAST(sum(l_linenumber) AS BIGINT) AS total_bytes FROM lineitem)"""
)
def split_manifest(spark, sf_dir):
    from rundiff.sinks.parts import manifest_totals

    items = table(spark, sf_dir, "lineitem").withColumn("row_idx", F.col("l_orderkey"))
    manifest = split.part_manifest(items, ["l_returnflag", "l_linestatus"], F.col("l_linenumber"))
    return manifest_totals(manifest, "lineitem.csv").drop("original_file")


@query(select="SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderkey AS row_idx FROM orders) ORDER BY row_idx LIMIT 10")
def table_preview(spark, sf_dir):
    return split.preview(_orders(spark, sf_dir))


@query(select="SELECT DISTINCT c_mktsegment FROM customer")
def distinct_values(spark, sf_dir):
    return split.distinct_values(table(spark, sf_dir, "customer"), "c_mktsegment")


@query(
    select=r"""SELECT page_id, substr(translate(url, '/\:', '___'), 1, 50) AS value_name,
  substr(regexp_replace(translate(url, '/\:', '___'), '[^\p{L}\p{N}\-_()\[\]]', '', 'g'), 1, 50) AS section_name,
  nullif(nullif(split_part(url, '/', 4), ''), 'null') AS first_folder FROM pages"""
)
def safe_names(spark, sf_dir):
    url = F.col("url")
    folder = F.split_part(url, F.lit("/"), F.lit(4))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        tx.safe_value_name(url).alias("value_name"),
        tx.safe_section_name(url).alias("section_name"),
        tx.null_if_token(folder, ["", "null"]).alias("first_folder"),
    )


CLEAN = r"""regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g')"""
CLASSED = f"""
classed AS (SELECT file_id, line_no, line, CASE WHEN regexp_matches(line, 'Self time.*?0\\.0 ms.*?0\\.0 ms.*?1') THEN 'SELF_TIME_ZERO'
    WHEN regexp_matches(line, '(?i)(java\\.|javax\\.|sun\\.|com\\.sun\\.|jdk\\.internal\\.|oracle\\.|com\\.oracle\\.)') THEN 'JAVA_INTERNAL_' ||
      CASE WHEN contains(line, 'java.lang.') THEN 'Lang' WHEN contains(line, 'java.util.') THEN 'Util' WHEN contains(line, 'java.awt.') THEN 'AWT'
        WHEN contains(line, 'java.io.') THEN 'IO' WHEN contains(line, 'java.net.') THEN 'Net' WHEN contains(line, 'javax.') THEN 'Extension'
        WHEN contains(line, 'sun.') THEN 'Sun' WHEN contains(line, 'jdk.internal.') THEN 'JDK' ELSE 'System' END
    WHEN regexp_matches(lower(line), 'compiledmethod|interpreter|c1 compilation|c2 compilation') THEN 'JVM_COMPILATION'
    ELSE 'SIGNIFICANT' END AS line_class
  FROM (SELECT file_id, line_no, {CLEAN} AS line FROM profile_text) WHERE line <> ''),
runs AS (SELECT *, count(*) OVER w AS run_size, row_number() OVER (PARTITION BY file_id, line_class, grp ORDER BY line_no) AS nth,
    min(line_no) OVER w AS first_line
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - row_number() OVER (PARTITION BY file_id, line_class ORDER BY line_no) AS grp FROM classed)
  WINDOW w AS (PARTITION BY file_id, line_class, grp))"""
REDUCED = """
compressed AS (
  SELECT file_id, line_no, CASE WHEN line_class = 'SELF_TIME_ZERO' AND run_size >= 3
      THEN '[COMPRESSED] ' || run_size || 'x repeated ''Self time, 0.0 ms'' entries (noise removed)'
    WHEN line_class = 'JVM_COMPILATION' AND run_size >= 2 THEN '[COMPRESSED] ' || run_size || 'x JVM compilation entries (system internals)'
    ELSE line END AS line
  FROM runs WHERE line_class = 'SIGNIFICANT' OR (line_class = 'SELF_TIME_ZERO' AND (nth = 1 OR run_size < 3))
    OR (line_class = 'JVM_COMPILATION' AND nth = 1)),
reduced AS (SELECT * FROM compressed WHERE (contains(line, '[COMPRESSED]') OR NOT (contains(lower(line), '0.0 ms (0%)')
    OR regexp_matches(lower(line), 'compiled method|interpreter|vtable stub|runtime stub|deoptimization|uncommon trap')))
  AND (contains(line, 'ms (') OR contains(line, '%)') OR contains(line, 'hits') OR contains(line, '[COMPRESSED]')))"""


@query(
    PROFILE_TEXT,
    CLASSED,
    select="SELECT DISTINCT file_id, line_class, first_line, run_size AS line_count FROM runs",
)
def noise_runs(spark, sf_dir):
    runs = noise.line_runs(profile_text(spark, sf_dir), ["file_id"])
    return noise.run_sizes(runs, ["file_id"]).drop("run_after")


@query(PROFILE_TEXT, CLASSED, REDUCED, select="SELECT file_id, line_no, line FROM reduced")
def noise_reduced(spark, sf_dir):
    return noise.reduce_noise(profile_text(spark, sf_dir), ["file_id"])


@query(
    PROFILE_TEXT,
    CLASSED,
    REDUCED,
    select="""SELECT file_id, raw_chars, reduced_chars, CAST(printf('%.2f', 100 - reduced_chars / raw_chars * 100.0) AS DOUBLE) AS compression_percent
FROM (SELECT file_id, CAST(sum(length(line)) AS BIGINT) AS raw_chars FROM profile_text GROUP BY file_id)
JOIN (SELECT file_id, CAST(sum(length(line)) AS BIGINT) AS reduced_chars FROM reduced GROUP BY file_id) USING (file_id)""",
)
def compression_ratio(spark, sf_dir):
    raw = profile_text(spark, sf_dir)
    before = raw.groupBy("file_id").agg(F.sum(F.length("line")).alias("raw_chars"))
    reduced = noise.reduce_noise(raw, ["file_id"])
    after = reduced.groupBy("file_id").agg(F.sum(F.length("line")).alias("reduced_chars"))
    ratio = noise.compression_ratio(F.col("raw_chars"), F.col("reduced_chars"))
    return before.join(after, "file_id").withColumn("compression_percent", rounded(ratio))


CHUNK = 1000
CHUNKED = f"""
sized AS (SELECT doc_id, line_no, line, length(line) + 1 AS cost, sum(length(line) + 1) OVER (PARTITION BY doc_id) AS total FROM doc_lines),
packed AS (
  SELECT doc_id, line_no, cost AS fill, CAST(0 AS BIGINT) AS chunk_no FROM sized WHERE line_no = 0
  UNION ALL
  SELECT s.doc_id, s.line_no, CASE WHEN p.fill + s.cost > {CHUNK} AND s.total > {CHUNK + 1} THEN s.cost ELSE p.fill + s.cost END,
    CASE WHEN p.fill + s.cost > {CHUNK} AND s.total > {CHUNK + 1} THEN p.chunk_no + 1 ELSE p.chunk_no END
  FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.line_no = p.line_no + 1),
chunks AS (SELECT doc_id, chunk_no, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) AS line_count,
  length(string_agg(line, chr(10) ORDER BY line_no)) AS char_count FROM packed JOIN sized USING (doc_id, line_no) GROUP BY doc_id, chunk_no)"""


def _chunked(spark, sf_dir):
    return packing.chunk_lines(doc_lines(spark, sf_dir), ["doc_id"], max_chunk_size=CHUNK)


@query(DOC_LINES, CHUNKED, select="SELECT doc_id, line_no, chunk_no FROM packed", recursive=True)
def chunk_lines(spark, sf_dir):
    return _chunked(spark, sf_dir).select("doc_id", "line_no", "chunk_no")


@query(DOC_LINES, CHUNKED, select="SELECT * FROM chunks", recursive=True)
def chunk_texts(spark, sf_dir):
    return packing.chunk_texts(_chunked(spark, sf_dir), ["doc_id"])


@query(
    DOC_LINES,
    CHUNKED,
    select=f"""SELECT doc_id, chunk_no + 1 AS chunk_id, replace(replace(replace(replace('{prompts.COMPARISON}',
  '{{part}}', 'Part ' || (chunk_no + 1) || ' of ' || count(*) OVER (PARTITION BY doc_id)), '{{file_a}}', 'a.csv'), '{{file_b}}', 'b.csv'), '{{text}}', text) AS prompt
FROM chunks""",
    recursive=True,
)
def prompt_table(spark, sf_dir):
    chunks = chunk_texts(spark, sf_dir)
    return prompts.prompt_table(chunks, "comparison", ["doc_id"], file_a="a.csv", file_b="b.csv")


# The text of a comparison: its lines, reduced per range and side, in a frame, packed into chunks.
CONFLICT_TEXT = """
profile_text AS (SELECT range_start || '|' || side AS file_id, row_idx AS line_no, line FROM (
  SELECT range_start, row_idx, 'a' AS side, a_line AS line FROM ranged UNION ALL SELECT range_start, row_idx, 'b', b_line FROM ranged))"""
CONFLICT_LINES = f"""
kept AS (SELECT CAST(split_part(file_id, '|', 1) AS BIGINT) AS range_start, split_part(file_id, '|', 2) AS side, line_no AS row_idx, line FROM reduced),
framed AS (SELECT r.range_start, row_count AS n, range_start + 1 AS s, range_end + 1 AS e, row_number() OVER (ORDER BY range_start) AS no,
  EXISTS (SELECT 1 FROM kept k WHERE k.range_start = r.range_start AND side = 'a') AS has_a,
  EXISTS (SELECT 1 FROM kept k WHERE k.range_start = r.range_start AND side = 'b') AS has_b FROM ranges r),
placed AS (
  SELECT range_start, 0 AS place, '' AS line FROM framed
  UNION ALL SELECT range_start, 1, 'CONFLICT RANGE #' || no || ' (Rows ' || s || '-' || e || '):' FROM framed
  UNION ALL SELECT range_start, 2, '' FROM framed
  UNION ALL SELECT range_start, 3, 'File A (a.csv):' FROM framed
  UNION ALL SELECT range_start, 4, '' FROM framed WHERE NOT has_a
  UNION ALL SELECT k.range_start, row_idx - k.range_start + 4, line FROM kept k WHERE side = 'a'
  UNION ALL SELECT range_start, n + 4, '' FROM framed
  UNION ALL SELECT range_start, n + 5, 'File B (b.csv):' FROM framed
  UNION ALL SELECT range_start, n + 6, '' FROM framed WHERE NOT has_b
  UNION ALL SELECT k.range_start, row_idx - k.range_start + n + 6, line FROM kept k JOIN framed USING (range_start) WHERE side = 'b'
  UNION ALL SELECT range_start, 2 * n + 6, '' FROM framed
  UNION ALL SELECT range_start, 2 * n + 7, 'Conflict Type: data_mismatch' FROM framed
  UNION ALL SELECT range_start, 2 * n + 8, 'Description: Conflicting data found in rows ' || s || ' to ' || e FROM framed
  UNION ALL SELECT range_start, 2 * n + 9, '{compare.SECTION_RULE}' FROM framed
  UNION ALL SELECT range_start, 2 * n + 10, '' FROM framed),
doc_lines AS (SELECT 0 AS doc_id, row_number() OVER (ORDER BY range_start, place) - 1 AS line_no, line FROM placed)"""
CONFLICT_CHUNKED = CHUNKED.replace(str(CHUNK + 1), str(packing.COMPARISON_CHUNK + 1)).replace(f"> {CHUNK} ", f"> {packing.COMPARISON_CHUNK} ")
_CONFLICT = (CALLS, RUN_ROWS, _pairs([*SHAPE, "total_time"], "run_rows"), CONFLICT_TEXT, CLASSED, REDUCED, CONFLICT_LINES, CONFLICT_CHUNKED)


@query(*_CONFLICT, select="SELECT doc_id AS file_id, chunk_no, text, line_count, char_count FROM chunks", recursive=True)
def conflict_chunks(spark, sf_dir):
    result = _compared_whole(spark, sf_dir, [*SHAPE, "total_time"])
    return compare.prepare_chunks(result, "a.csv", "b.csv")


@query(
    *_CONFLICT,
    select="""SELECT 0 AS file_id, raw_chars, reduced_chars, 100 - reduced_chars / raw_chars * 100.0 AS compression_percent FROM
  (SELECT CAST(sum(size) AS BIGINT) AS raw_chars FROM (SELECT sum(length(a_line) + length(b_line) + 2) - 2 AS size FROM ranged GROUP BY range_start)),
  (SELECT CAST(sum(char_count + 1) - 1 AS BIGINT) AS reduced_chars FROM chunks)""",
    recursive=True,
)
def conflict_compression(spark, sf_dir):
    result = _compared_whole(spark, sf_dir, [*SHAPE, "total_time"])
    return compare.compression(result, compare.prepare_chunks(result, "a.csv", "b.csv"))


def _with_gaps(spark, sf_dir):
    return _orders(spark, sf_dir).select(
        F.lit("orders.csv").alias("file_id"),
        "row_idx",
        *_ORDERS[:2],
        F.expr("nullif(o_orderstatus, 'P') AS o_orderstatus"),
        *_ORDERS[3:],
    )


RECORD = """'{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || coalesce(nullif(o_orderstatus, 'P'), '')
  || '","o_totalprice":' || o_totalprice || ',"o_orderpriority":"' || o_orderpriority || '"}'"""


@query(select=f"SELECT 'orders.csv' AS file_id, o_orderkey AS row_idx, {RECORD} AS record FROM orders")
def json_records(spark, sf_dir):
    return csv_records(_with_gaps(spark, sf_dir))


@query(
    select=f"""SELECT 'orders.csv' AS file_id, o_orderkey AS pos, CASE WHEN o_orderkey = 0 THEN '' ELSE ',' END || {RECORD} AS text FROM orders
UNION ALL SELECT 'orders.csv', -1, '{{"metadata":{{"source_file":"orders.csv","total_records":' || count(*)
  || ',"columns":["o_orderkey","o_custkey","o_orderstatus","o_totalprice","o_orderpriority"],"file_type":"csv"}},"data":[' FROM orders
UNION ALL SELECT 'orders.csv', 4611686018427387904, ']}}'"""
)
def json_envelope(spark, sf_dir):
    orders = _with_gaps(spark, sf_dir)
    return envelope_lines(csv_records(orders), csv_metadata(orders))


@query(
    select="""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) AS price,
  CASE WHEN o_orderstatus = 'F' THEN 'EUR' ELSE 'USD' END AS currency, 2 AS tags, o_orderpriority AS last_tag FROM orders"""
)
def xml_nested(spark, sf_dir):
    xml = """concat('<order id="', o_orderkey, '"><status>', o_orderstatus, '</status><price currency="',
      CASE WHEN o_orderstatus = 'F' THEN 'EUR' ELSE 'USD' END, '">', cast(o_totalprice as decimal(12, 2)),
      '</price><tag>first</tag><tag>', o_orderpriority, '</tag></order>')"""
    schema = "`@id` string, status string, price struct<`@currency`: string, `#text`: string>, tag array<string>"
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", parse_xml(F.expr(xml), schema).alias("x"))
    return parsed.selectExpr(
        "o_orderkey",
        "x.`@id` AS id",
        "x.status AS status",
        "x.price.`#text` AS price",
        "x.price.`@currency` AS currency",
        "size(x.tag) AS tags",
        "element_at(x.tag, -1) AS last_tag",
    )


@query(
    select="""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) AS price,
  CASE WHEN o_orderstatus = 'F' THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS tags, o_orderpriority || '<&>' AS last_tag,
  'orders' AS root, CAST(NULL AS VARCHAR) AS error FROM orders"""
)
def xml_files(spark, sf_dir):
    """All orders through one XML file for each priority, with comments and literal texts, and back by their events."""
    lines = """concat('<order id="', o_orderkey, '">\n  <status>', o_orderstatus, '</status><price currency="', CASE WHEN o_orderstatus = 'F' THEN 'EUR' ELSE 'USD' END, '">',
      cast(o_totalprice as decimal(12, 2)), '</price>', CASE WHEN o_orderstatus = 'P' THEN '' ELSE '<tag>first</tag><!-- <tag> -->' END, '<tag><![CDATA[', o_orderpriority, '<&>]]></tag></order>')"""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderkey").cast("long").alias("at"), F.expr(lines).alias("text"))
    ends = F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.lit('<?xml version="1.0"?>\n<orders>').alias("text")), F.struct(F.lit(2**62).alias("at"), F.lit("</orders>").alias("text")))
    whole = orders.union(orders.select("p").distinct().select("p", F.inline(ends)))
    folder = f"{shared_folder(spark)}/rundiff-xml-{uuid.uuid4().hex}"
    whole.repartition("p").sortWithinPartitions("p", "at").select("p", "text").write.partitionBy("p").text(folder)
    events = read_xml_events(spark, f"{folder}/*/*.txt", "*")
    schema = "`@id` string, status string, price struct<`@currency`: string, `#text`: string>, tag string"
    rows = xml_rows(xml_json(events), 1).select("file_id", F.from_json("record", schema).alias("x"), F.get_json_object("record", "$.tag").alias("tag"))
    listed = F.from_json("tag", "array<string>")
    several = F.col("tag").startswith("[")
    return rows.join(events.files, "file_id").select(
        F.col("x.@id").cast("long").alias("o_orderkey"),
        F.col("x.@id").alias("id"),
        F.col("x.status").alias("status"),
        F.col("x.price.#text").alias("price"),
        F.col("x.price.@currency").alias("currency"),
        F.when(several, F.size(listed)).otherwise(1).alias("tags"),
        F.when(several, F.element_at(listed, -1)).otherwise(F.col("tag")).alias("last_tag"),
        F.col("root_element").alias("root"),
        "error",
    )


def _written(spark, df, name):
    """A table written as CSV to the shared folder, one folder per value of its column ``p``."""
    folder = f"{shared_folder(spark)}/rundiff-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy("p").option("header", True).option("escape", '"').csv(folder)
    return folder


@query(
    select="""SELECT o_orderpriority AS p, count(*) AS n, sum(o_orderkey) AS keys, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS VARCHAR) AS price,
  count(nullif(o_orderstatus, 'P')) AS known FROM orders GROUP BY o_orderpriority"""
)
def csv_scan(spark, sf_dir):
    orders = _with_gaps(spark, sf_dir).drop("file_id", "row_idx").withColumn("p", F.col("o_orderpriority"))
    read = read_csv(spark, f"{_written(spark, orders, 'scan')}/*/*.csv")
    return read.groupBy(F.col("o_orderpriority").alias("p")).agg(
        F.count("*").alias("n"),
        F.sum("o_orderkey").alias("keys"),
        F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("string").alias("price"),
        F.count("o_orderstatus").alias("known"),
    )


@query(
    DOC_LINES,
    select="""SELECT lang, count(*) AS records, count(DISTINCT doc_id) AS docs, sum(length(line)) AS chars,
  count(*) FILTER (line = '' OR line IN ('NA', 'None', 'null', 'nan', 'n/a', 'NULL', 'N/A', 'NaN')) AS missing
FROM doc_lines JOIN documents USING (doc_id) GROUP BY lang""",
)
def batch_convert(spark, sf_dir):
    """Every line of every document through CSV files with quotes, the batch conversion, and back from its envelopes."""
    langs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("p"))
    lines = doc_lines(spark, sf_dir).join(langs, "doc_id").select("doc_id", "line_no", "line", F.col("p").alias("lang"), "p")
    folder = _written(spark, lines, "batch")
    out = f"{folder}-json"
    converted = None
    for lang in sorted(r["p"] for r in langs.select("p").distinct().collect()):
        done = convert_batch(spark, f"{folder}/p={lang}", f"{out}/{lang}", "*.csv")
        converted = done if converted is None else converted.unionByName(done)
    failed = converted.where("status <> 'Success'").count()
    if failed:
        raise ValueError(f"{failed} files failed")
    text = spark.read.option("recursiveFileLookup", "true").text(f"{out}")
    record = F.regexp_replace("value", "^,", "")
    parsed = text.where(~F.col("value").startswith('{"metadata"') & (F.col("value") != "]}")).select(F.from_json(record, "doc_id long, line_no long, line string, lang string").alias("r"))
    blank = F.col("r.line") == ""
    return parsed.groupBy(F.col("r.lang").alias("lang")).agg(
        F.count("*").alias("records"), F.countDistinct("r.doc_id").alias("docs"), F.sum(F.length("r.line")).alias("chars"), F.count_if(blank).alias("missing")
    )


@query(
    select="""SELECT o_orderpriority AS p, count(*) AS row_count, min(o_orderkey) + 1 AS first_row, max(o_orderkey) + 1 AS last_row, 5 AS column_count,
  row_number() OVER (ORDER BY min(o_orderkey)) AS part_no, 'orders_' || substr(translate(o_orderpriority, '/\\:', '___'), 1, 50) || '.csv' AS filename,
  count(*) AS written FROM orders GROUP BY o_orderpriority"""
)
def split_written(spark, sf_dir):
    """Orders split by a value and written; rows counted again in the files."""
    folder = f"{shared_folder(spark)}/rundiff-parts-{uuid.uuid4().hex}"
    manifest = split_and_convert(_orders(spark, sf_dir), folder, "column", prefix="orders", column="o_orderpriority")
    back = spark.read.option("header", True).csv(f"{folder}/csv").groupBy("part").agg(F.count("*").alias("written"), F.min("o_orderpriority").alias("p"))
    return manifest.join(back, "part").select("p", "row_count", "first_row", "last_row", "column_count", "part_no", "filename", "written")


@query(
    select="""SELECT part_id + 1 AS part_no, count(*) AS records, sum(o_orderkey) AS keys, count(DISTINCT o_orderstatus) AS statuses
FROM (SELECT *, o_orderkey // 1000 AS part_id FROM orders) GROUP BY part_id"""
)
def split_converted(spark, sf_dir):
    """Orders split by rows and converted; the JSON records of each part read back."""
    folder = f"{shared_folder(spark)}/rundiff-parts-{uuid.uuid4().hex}"
    manifest = split_and_convert(_orders(spark, sf_dir), folder, "rows", rows_per_part=1000)
    read = spark.read.text(f"{folder}/json").select("part", F.from_json("value", "o_orderkey long, o_orderstatus string").alias("r"))
    found = read.groupBy("part").agg(F.count("*").alias("records"), F.sum("r.o_orderkey").alias("keys"), F.countDistinct("r.o_orderstatus").alias("statuses"))
    return manifest.select("part", "part_no").join(found, "part").drop("part")
