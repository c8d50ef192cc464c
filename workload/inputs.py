"""Inputs of the registered queries, derived from the given tables.

Each input is written twice: as a DataFrame and as a DuckDB common table expression with
the same columns, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rundiff.operators.lookup import merge_join
from rundiff.operators.methods import source_lines
from rundiff.operators.ordered import dense_index
from rundiff.operators.results import result_key
from rundiff.session import size_shuffles

RUN_SPLIT = "2024-01-16 00:00:00"
FILES_PER_TASK = 1 << 14
LINES_PER_TASK = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int, per_task: int, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` to tasks of about ``per_task`` of ``rows`` rows, as the files of a table say nothing of what a row grows to.

    The shuffles after it get as many partitions at least.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / per_task))
    size_shuffles(df.sparkSession, tasks)
    return df.repartition(tasks, key)


# Profiler calls from events: the first half of the month is run A, the second run B, and
# there is one file per hour of the day.
_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
_PLAIN = "cast(cast({v} as decimal(12, 2)) as string)"


def _number(v: str) -> str:
    return f"CASE WHEN {v} >= 999 THEN format_number({v}, 2) ELSE {_PLAIN.format(v=v)} END"


def calls(spark: SparkSession, sf_dir: str, run: str | None = None) -> DataFrame:
    """Calls of one run, picked by a filter that reaches the scan, or of both."""
    period = {None: "true", "A": f"ts < timestamp_ntz '{RUN_SPLIT}'", "B": f"ts >= timestamp_ntz '{RUN_SPLIT}'"}[run]
    events = table(spark, sf_dir, "events").where(period).selectExpr(
        "*", f"{_K} AS k", f"cast(floor({_K} / 25) as int) AS level", "cast(user_id as string) AS u"
    )
    return events.selectExpr(
        "event_id",
        f"CASE WHEN ts < timestamp_ntz '{RUN_SPLIT}' THEN 'A' ELSE 'B' END AS run",
        "hour(ts) AS file_id",
        """CASE event_type WHEN 'view' THEN 'AwtToolkit' WHEN 'click' THEN 'EventQueue' WHEN 'purchase' THEN 'SocketPool'
             WHEN 'signup' THEN 'Worker' ELSE 'java.util' END AS component""",
        "level",
        """concat(repeat(' ', level), CASE event_type
             WHEN 'view' THEN concat('com.app.ui.AwtToolkit', u, '.paint (AwtToolkit', u, '.java:17)')
             WHEN 'click' THEN concat('com.app.ui.EventQueue', u, '.dispatch ()')
             WHEN 'purchase' THEN concat('com.app.net.SocketPool', u, '.connection (SocketPool.java:', u, ')')
             WHEN 'signup' THEN concat('com.app.job.Worker', u, '.run ()')
             ELSE concat('java.util.Pool', u, '.get (Pool.java:5)') END) AS name""",
        f"""CASE WHEN event_type = 'purchase' THEN concat({_number("value")}, ' s (3%)')
             WHEN event_type = 'signup' AND value < 1 THEN 'n/a'
             ELSE concat({_number("(value * 10)")}, ' ms (5%)') END AS total_time""",
        f"concat({_number('value')}, ' ms (1%)') AS cpu_time",
        "cast(k as string) AS hits",
        "concat(cast(floor(value / 50) as string), '.5 ms (', level, '%)') AS timing",
    )


CALLS = f"""
calls AS (
  SELECT event_id,
    CASE WHEN ts < TIMESTAMP '{RUN_SPLIT}' THEN 'A' ELSE 'B' END AS run,
    CAST(hour(ts) AS INT) AS file_id,
    CASE event_type WHEN 'view' THEN 'AwtToolkit' WHEN 'click' THEN 'EventQueue' WHEN 'purchase' THEN 'SocketPool'
      WHEN 'signup' THEN 'Worker' ELSE 'java.util' END AS component,
    level,
    repeat(' ', level) || CASE event_type
      WHEN 'view' THEN 'com.app.ui.AwtToolkit' || user_id || '.paint (AwtToolkit' || user_id || '.java:17)'
      WHEN 'click' THEN 'com.app.ui.EventQueue' || user_id || '.dispatch ()'
      WHEN 'purchase' THEN 'com.app.net.SocketPool' || user_id || '.connection (SocketPool.java:' || user_id || ')'
      WHEN 'signup' THEN 'com.app.job.Worker' || user_id || '.run ()'
      ELSE 'java.util.Pool' || user_id || '.get (Pool.java:5)' END AS name,
    CASE WHEN event_type = 'purchase' THEN format('{{:,.2f}}', value) || ' s (3%)'
      WHEN event_type = 'signup' AND value < 1 THEN 'n/a'
      ELSE format('{{:,.2f}}', value * 10) || ' ms (5%)' END AS total_time,
    format('{{:,.2f}}', value) || ' ms (1%)' AS cpu_time,
    CAST(k AS VARCHAR) AS hits,
    CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) || '.5 ms (' || level || '%)' AS timing
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
          CAST(floor(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 25) AS INT) AS level FROM events))"""


def run_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs A and B as one file each. Event ids are dense, so row numbers are offsets."""
    sides = []
    for run in ("A", "B"):
        side = calls(spark, sf_dir, run)
        first = side.agg(F.min("event_id"))
        row_idx = (F.col("event_id") - first.scalar()).alias("row_idx")
        sides.append(side.drop("run", "file_id").select("*", F.lit(0).alias("file_id"), row_idx))
    return sides[0], sides[1]


def file_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs A and B with a file per hour, rows numbered within each file."""
    a, b = (dense_index(calls(spark, sf_dir, run).drop("run"), ["file_id"], "event_id") for run in ("A", "B"))
    return a, b


RUN_ROWS = """
run_rows AS (SELECT * REPLACE (0 AS file_id), event_id - min(event_id) OVER (PARTITION BY run) AS row_idx FROM calls)"""
FILE_ROWS = """
file_rows AS (SELECT *, row_number() OVER (PARTITION BY run, file_id ORDER BY event_id) - 1 AS row_idx FROM calls)"""

TIME_MS = r"""CASE WHEN regexp_extract(replace({c}, ',', ''), '(\d+\.?\d*)\s*(ms|s)', 2) = '' THEN NULL
  ELSE CAST(regexp_extract(replace({c}, ',', ''), '(\d+\.?\d*)\s*(ms|s)', 1) AS DOUBLE)
    * CASE WHEN regexp_extract(replace({c}, ',', ''), '(\d+\.?\d*)\s*(ms|s)', 2) = 's' THEN 1000 ELSE 1 END END"""
IS_JDK = r"regexp_matches(lower(trim({c})), '^(java\.|javax\.|sun\.|com\.sun\.|jdk\.internal\.|oracle\.|com\.oracle\.)')"


# Profiler text of each hour, with the kinds of noise that real exports have.
def profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = _number("value")
    return table(spark, sf_dir, "events").selectExpr(
        "hour(ts) AS file_id",
        "event_id AS line_no",
        f"""CASE event_type
             WHEN 'view' THEN '"Self time","0.0 ms (0%)","0.0 ms (0%)","1"'
             WHEN 'click' THEN concat('"CompiledMethod stub', user_id, '","', {value}, ' ms (1%)","1"')
             WHEN 'error' THEN concat('"java.', CASE WHEN value > 30 THEN 'util' ELSE 'io' END, '.Call","', {value}, ' ms (1%)"')
             WHEN 'signup' THEN CASE WHEN value < 5 THEN '   ' ELSE concat('  "com.app.Job', user_id, '","', {value}, ' s"  ') END
             ELSE concat('"com.app.Order', user_id, '","', {value}, ' ms (2%)","1"') END AS line""",
    )


PROFILE_TEXT = """
profile_text AS (
  SELECT CAST(hour(ts) AS INT) AS file_id, event_id AS line_no, CASE event_type
    WHEN 'view' THEN '"Self time","0.0 ms (0%)","0.0 ms (0%)","1"'
    WHEN 'click' THEN '"CompiledMethod stub' || user_id || '","' || format('{:,.2f}', value) || ' ms (1%)","1"'
    WHEN 'error' THEN '"java.' || CASE WHEN value > 30 THEN 'util' ELSE 'io' END || '.Call","' || format('{:,.2f}', value) || ' ms (1%)"'
    WHEN 'signup' THEN CASE WHEN value < 5 THEN '   ' ELSE '  "com.app.Job' || user_id || '","' || format('{:,.2f}', value) || ' s"  ' END
    ELSE '"com.app.Order' || user_id || '","' || format('{:,.2f}', value) || ' ms (2%)","1"' END AS line
  FROM events)"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents: ``doc_id, line_no, line``."""
    split = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    lines = table(spark, sf_dir, "documents").select("doc_id", split)
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


DOC_LINES = """
doc_lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


# Java sources, one file per part.
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    named = parts.selectExpr(
        """concat(CASE WHEN p_size <= 30 THEN 'src/main/java/' WHEN p_size <= 40 THEN 'modules/core/' ELSE '' END,
             'com/app/p', p_size, '/P', p_partkey, '.java') AS path""",
        "p_size",
        "p_partkey",
        "p_type",
    )
    return dealt(named, parts.count(), FILES_PER_TASK, "path").selectExpr(
        "path",
        r"""concat('package com.app.p', p_size, ';\nimport java.util.List;\n// made from part\n\npublic class P', p_partkey, ' {\n',
             CASE WHEN p_size > 3 THEN concat('    private int size = ', p_size, ';\n    public void m', p_size,
               '(int a, String b) throws Error {\n        if (a > 0) {\n            helper(a);\n        }\n        this.size = a;\n    }\n',
               CASE WHEN p_type = 'ECONOMY' THEN '' ELSE '    static int helper(int x) { return x; }\n' END,
               '    abstract void later(int q);\n') ELSE '' END,
             '}\n') AS content""",
    )


LONG_SOURCES = """
source_lines AS (SELECT path, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text FROM (
  SELECT 'com/app/p' || p_size || '/L' || p_partkey || '.java' AS path, string_split(replace(
    'package com.app.p' || p_size || ';|/* made from part|   int fake(int a,|       int b); */|public class L' || p_partkey || ' {|'
    || '    @Override|    public static int|        m' || p_size || '(|            int a' || repeat(', // one;|            int b', p_size % 4) || ')|'
    || CASE WHEN p_size % 3 = 0 THEN '        throws IOException,|            Error|' ELSE '' END || '    {|        call(a, ";",|            b);|        return a;|    }|'
    || '    int m' || p_size || '(int a) { return a; }|    void later(|        int q);|    void m' || p_size || '(long c,|        int d) {|    }|'
    || CASE WHEN p_size % 5 = 0 THEN '    void open(int a,|        int b) {|' ELSE '}|' END, '|', chr(10)), chr(10)) AS l FROM part))"""


def long_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of source files with declarations over one to six lines, overloads, comments and a last method without an end."""
    parts = table(spark, sf_dir, "part")
    named = parts.selectExpr("concat('com/app/p', p_size, '/L', p_partkey, '.java') AS path", "p_size", "p_partkey")
    files = dealt(named, parts.count(), FILES_PER_TASK, "path").selectExpr(
        "path",
        r"""concat('package com.app.p', p_size, ';\n/* made from part\n   int fake(int a,\n       int b); */\npublic class L', p_partkey, ' {\n',
             '    @Override\n    public static int\n        m', p_size, '(\n            int a', repeat(', // one;\n            int b', p_size % 4), ')\n',
             CASE WHEN p_size % 3 = 0 THEN '        throws IOException,\n            Error\n' ELSE '' END, '    {\n        call(a, ";",\n            b);\n        return a;\n    }\n',
             '    int m', p_size, '(int a) { return a; }\n    void later(\n        int q);\n    void m', p_size, '(long c,\n        int d) {\n    }\n',
             CASE WHEN p_size % 5 = 0 THEN '    void open(int a,\n        int b) {\n' ELSE '}\n' END) AS content""",
    )
    return source_lines(files)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lines ``path, line_no, text``."""
    return source_lines(source_files(spark, sf_dir))


SOURCES = """
source_files AS (
  SELECT CASE WHEN p_size <= 30 THEN 'src/main/java/' WHEN p_size <= 40 THEN 'modules/core/' ELSE '' END
      || 'com/app/p' || p_size || '/P' || p_partkey || '.java' AS path,
    'package com.app.p' || p_size || ';' || chr(10) || 'import java.util.List;' || chr(10) || '// made from part' || chr(10) || chr(10)
      || 'public class P' || p_partkey || ' {' || chr(10)
      || CASE WHEN p_size > 3 THEN
        '    private int size = ' || p_size || ';' || chr(10) || '    public void m' || p_size || '(int a, String b) throws Error {' || chr(10)
        || '        if (a > 0) {' || chr(10) || '            helper(a);' || chr(10) || '        }' || chr(10) || '        this.size = a;' || chr(10) || '    }' || chr(10)
        || CASE WHEN p_type = 'ECONOMY' THEN '' ELSE '    static int helper(int x) { return x; }' || chr(10) END
        || '    abstract void later(int q);' || chr(10) ELSE '' END
      || '}' || chr(10) AS content
  FROM part),
source_lines AS (SELECT path, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text
  FROM (SELECT path, string_split(content, chr(10)) AS l FROM source_files))"""


_TRACE_TEXT = """CASE form WHEN 0 THEN cls || '#m' || p_size
  WHEN 1 THEN cls || '.m' || p_size || '(P' || p_partkey || '.java:5)'
  WHEN 2 THEN 'at ' || cls || '.m' || p_size || '(P' || p_partkey || '.java:7)'
  WHEN 3 THEN cls || '.helper'
  WHEN 4 THEN 'src/main/java/com/app/p' || p_size || '/P' || p_partkey || '.java'
  WHEN 5 THEN 'P' || p_partkey
  ELSE cls || '$Inner#LATER[1]' END"""


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace line per line item, in a form that depends on its line number.

    Line items of one part give the same frames again and again, as real logs do.
    """
    items = table(spark, sf_dir, "lineitem")
    items = dealt(items.selectExpr("l_orderkey", "l_partkey AS p_partkey", "l_linenumber"), items.count(), LINES_PER_TASK, "p_partkey")
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_size", "concat('com.app.p', p_size, '.P', p_partkey) AS cls"
    )
    return merge_join(items, parts, "p_partkey").selectExpr(
        "l_orderkey AS file_id",
        "l_linenumber AS line_no",
        """CASE l_linenumber - 1 WHEN 0 THEN concat(cls, '#m', p_size)
             WHEN 1 THEN concat(cls, '.m', p_size, '(P', p_partkey, '.java:5)')
             WHEN 2 THEN concat('at ', cls, '.m', p_size, '(P', p_partkey, '.java:7)')
             WHEN 3 THEN concat(cls, '.helper')
             WHEN 4 THEN concat('src/main/java/com/app/p', p_size, '/P', p_partkey, '.java')
             WHEN 5 THEN concat('P', p_partkey)
             ELSE concat(cls, '$Inner#LATER[1]') END AS line""",
    )


TRACE_LINES = f"""
trace_lines AS (
  SELECT l_orderkey AS file_id, l_linenumber AS line_no, {_TRACE_TEXT} AS line
  FROM (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS form, p_partkey, p_size,
      'com.app.p' || p_size || '.P' || p_partkey AS cls FROM lineitem JOIN part ON l_partkey = p_partkey))"""


# Result table from events.
NOW = "2024-01-31 00:00:00"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        result_key(F.lit("repo"), F.concat(F.lit("com.app.U"), "user_id"), F.col("event_type")).alias("key"),
        F.expr("cast(event_id as string) AS data"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.expr("cast(regexp_extract(props, '([0-9]+)', 1) as bigint) AS access_count"),
        F.expr(
            "timestamp_micros(unix_micros(cast(ts as timestamp)) + cast(floor(value * 60000000) as bigint)) AS last_accessed"
        ),
        F.expr("CASE WHEN event_type IN ('view', 'click') THEN 'extracted_code' ELSE 'analysis_result' END AS entry_type"),
    )


RESULTS = """
results AS (SELECT substr(sha256('repo::com.app.U' || user_id || '::' || event_type), 1, 16) AS key,
  CAST(event_id AS VARCHAR) AS data, ts AS timestamp, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS access_count,
  make_timestamp(epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT)) AS last_accessed,
  CASE WHEN event_type IN ('view', 'click') THEN 'extracted_code' ELSE 'analysis_result' END AS entry_type FROM events)"""
