"""Queries over run and row comparisons, hotspots and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rundiff.functions import profile
from rundiff.functions.numbers import rounded
from rundiff.operators import hotspots as hs
from rundiff.operators import rows, runs
from rundiff.plans import compare
from workload.inputs import CALLS, FILE_ROWS, IS_JDK, RUN_ROWS, TIME_MS, calls, file_rows, run_rows
from workload.registry import query

TIME = TIME_MS.format(c="total_time")
NOT_JDK = "NOT " + IS_JDK.format(c="name")

LAST_CALLS = f"""
last_calls AS (
  SELECT run, trim(name) AS function_name, length(name) - length(ltrim(name)) AS stack_level,
    max(row_idx) AS row_idx, arg_max(name, row_idx) AS name, arg_max(struct_pack(ms := {TIME}), row_idx).ms AS time_ms
  FROM run_rows WHERE {NOT_JDK} GROUP BY ALL)"""
LAST_CALLS = LAST_CALLS.replace("GROUP BY ALL", "GROUP BY 1, 2, 3")

CONFLICTS = """
paired AS (
  SELECT coalesce(a.function_name, b.function_name) AS function_name, coalesce(a.stack_level, b.stack_level) AS stack_level,
    least(a.row_idx, b.row_idx) + 1 AS line_number, coalesce(a.name, '') AS file_a_content, coalesce(b.name, '') AS file_b_content,
    a.time_ms AS file_a_time, b.time_ms AS file_b_time, b.time_ms - a.time_ms AS time_delta,
    a.row_idx IS NULL OR b.row_idx IS NULL AS one_sided
  FROM (SELECT * FROM last_calls WHERE run = 'A') a FULL JOIN (SELECT * FROM last_calls WHERE run = 'B') b
    ON a.function_name = b.function_name AND a.stack_level = b.stack_level),
conflicts AS (
  SELECT * EXCLUDE one_sided, CASE WHEN one_sided THEN 'content_diff' ELSE 'time_diff' END AS conflict_type,
    CASE WHEN time_delta IS NULL THEN 'medium' WHEN abs(time_delta) > 1000 THEN 'high'
      WHEN abs(time_delta) > 100 THEN 'medium' ELSE 'low' END AS severity
  FROM paired WHERE one_sided OR abs(time_delta) > greatest(1.0, abs(file_a_time) * 0.05))"""
RUN_CTES = (CALLS, RUN_ROWS, LAST_CALLS, CONFLICTS)

_ROUND = "round(file_a_time, 4) AS file_a_time, round(file_b_time, 4) AS file_b_time, round(time_delta, 4) AS time_delta"


def _conflicts(spark, sf_dir):
    return runs.compare_calls(*run_rows(spark, sf_dir))


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 4) for c in columns})


@query(
    *RUN_CTES,
    select=f"""SELECT function_name, stack_level, line_number, file_a_content, file_b_content, {_ROUND}, conflict_type, severity
FROM conflicts ORDER BY line_number, function_name, stack_level""",
)
def compare_runs(spark, sf_dir):
    a, b = run_rows(spark, sf_dir)
    titles = {"name": "Name", "total_time": "Total Time", "cpu_time": "Total Time (CPU)", "hits": "Hits"}
    found = compare.compare_runs(*[t.select("row_idx", *titles).withColumnsRenamed(titles) for t in (a, b)])
    return _round(found, "file_a_time", "file_b_time", "time_delta")


@query(
    CALLS,
    RUN_ROWS,
    LAST_CALLS,
    select="""SELECT 'added' AS change, function_name, stack_level, row_idx, time_ms, name FROM last_calls b WHERE run = 'B' AND NOT EXISTS
  (SELECT 1 FROM last_calls a WHERE a.run = 'A' AND a.function_name = b.function_name AND a.stack_level = b.stack_level)
UNION ALL SELECT 'removed', function_name, stack_level, row_idx, time_ms, name FROM last_calls a WHERE run = 'A' AND NOT EXISTS
  (SELECT 1 FROM last_calls b WHERE b.run = 'B' AND a.function_name = b.function_name AND a.stack_level = b.stack_level)""",
)
def run_added_removed(spark, sf_dir):
    a, b = run_rows(spark, sf_dir)
    added = runs.added_calls(a, b).withColumn("change", F.lit("added"))
    removed = runs.added_calls(b, a).withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


@query(
    *RUN_CTES,
    select="""SELECT count(*) AS total_conflicts, count(*) FILTER (conflict_type = 'content_diff') AS content_diff,
  count(*) FILTER (conflict_type = 'time_diff') AS time_diff, count(*) FILTER (conflict_type = 'both') AS "both",
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low,
  'Found ' || count(*) || ' conflicts: ' || count(*) FILTER (conflict_type = 'content_diff') || ' content differences, '
    || count(*) FILTER (conflict_type = 'time_diff') || ' timing differences, 0 both' AS summary,
  count(*) > 0 AS has_differences, count(*) > 50 AS has_more FROM conflicts""",
)
def run_conflict_counts(spark, sf_dir):
    return runs.conflict_totals(_conflicts(spark, sf_dir))


@query(
    *RUN_CTES,
    select="""SELECT line_number, function_name, stack_level,
  CASE WHEN file_a_content = '' THEN '(not present)' ELSE file_a_content END AS file_a_content,
  CASE WHEN file_b_content = '' THEN '(not present)' ELSE file_b_content END AS file_b_content,
  coalesce(printf('%.2f', file_a_time) || ' ms', 'N/A') AS file_a_time,
  coalesce(printf('%.2f', file_b_time) || ' ms', 'N/A') AS file_b_time,
  coalesce(CASE WHEN time_delta >= 0 THEN '+' ELSE '' END || printf('%.2f', time_delta) || ' ms', 'N/A') AS time_delta,
  conflict_type, severity FROM conflicts ORDER BY line_number, function_name, stack_level LIMIT 50""",
)
def run_display(spark, sf_dir):
    return runs.display_rows(_conflicts(spark, sf_dir))


RANKED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY line_number, function_name, stack_level) AS rank
  FROM conflicts WHERE severity <> 'low'),
listed AS (SELECT * FROM ranked WHERE rank <= CASE severity WHEN 'high' THEN 20 ELSE 30 END)"""


@query(
    *RUN_CTES,
    RANKED,
    select="SELECT severity, rank, line_number, function_name, stack_level, round(time_delta, 4) AS time_delta FROM listed",
)
def run_severity_topn(spark, sf_dir):
    top = runs.first_by_severity(_conflicts(spark, sf_dir))
    return _round(top, "time_delta").select(
        "severity", "rank", "line_number", "function_name", "stack_level", "time_delta"
    )


@query(
    *RUN_CTES,
    RANKED,
    """
blocks AS (SELECT severity, rank, 'Line ' || line_number || ': ' || function_name || chr(10)
    || CASE severity WHEN 'high' THEN '  File A: ' || file_a_content || chr(10) || '  File B: ' || file_b_content || chr(10) ELSE '' END
    || coalesce('  Time change: ' || CASE WHEN time_delta >= 0 THEN '+' ELSE '' END || printf('%.2f', time_delta) || ' ms',
      '  Content difference detected') || chr(10) AS line FROM listed)""",
    select="""SELECT '=== LINE-BY-LINE COMPARISON CONFLICTS ===' || chr(10) || 'Total conflicts: ' || (SELECT count(*) FROM conflicts) || chr(10)
  || 'High severity: ' || (SELECT count(*) FROM conflicts WHERE severity = 'high') || chr(10)
  || 'Medium severity: ' || (SELECT count(*) FROM conflicts WHERE severity = 'medium') || chr(10)
  || coalesce((SELECT chr(10) || 'HIGH SEVERITY CONFLICTS (>1000ms difference):' || chr(10) || string_agg(line, chr(10) ORDER BY rank) FROM blocks WHERE severity = 'high'), '')
  || coalesce((SELECT chr(10) || 'MEDIUM SEVERITY CONFLICTS:' || chr(10) || string_agg(line, chr(10) ORDER BY rank) FROM blocks WHERE severity = 'medium'), '') AS text""",
)
def run_conflict_text(spark, sf_dir):
    return compare.conflict_export_text(_conflicts(spark, sf_dir))


FRAME = r"'([a-zA-Z0-9._]+)\.([a-zA-Z0-9_<>$]+)\([^:]*:?(\d+)?\)'"
PAIR = r"'([a-zA-Z0-9_]+)\.([a-zA-Z0-9_<>$]+)'"
CALL = r"regexp_replace(name, '\s+\(', '(')"


@query(
    CALLS,
    select=rf"""SELECT event_id, round({TIME}, 4) AS total_ms,
  CAST(coalesce(nullif(regexp_extract(total_time, '(\d+\.?\d*)\s*ms', 1), ''), '0') AS DOUBLE) AS legacy_ms,
  CAST(hits AS DOUBLE) AS hit_count, CAST(nullif(regexp_extract(total_time, '(\d+\.?\d*)\s*ms\s*\((\d+\.?\d*)%\)', 1), '') AS DOUBLE) AS percent_ms
FROM calls""",
)
def timing_values(spark, sf_dir):
    total = F.col("total_time")
    return calls(spark, sf_dir).select(
        "event_id",
        F.round(profile.timing_ms(total), 4).alias("total_ms"),
        profile.timing_ms(total, legacy=True).alias("legacy_ms"),
        profile.hit_count(F.col("hits")).alias("hit_count"),
        profile.percent_timing_ms(total).alias("percent_ms"),
    )


@query(
    CALLS,
    select=rf"""SELECT event_id, trim(name) AS function_name, length(name) - length(ltrim(name)) AS stack_level,
  {IS_JDK.format(c="name")} AS is_jdk, CASE WHEN contains(name, 'java.util.') THEN 'Util' ELSE 'System' END AS jdk_bucket,
  CASE WHEN regexp_matches({CALL}, {FRAME}) THEN list_last(string_split(regexp_extract({CALL}, {FRAME}, 1), '.'))
    ELSE regexp_extract({CALL}, {PAIR}, 1) END AS class_name,
  CASE WHEN regexp_matches({CALL}, {FRAME}) THEN regexp_extract({CALL}, {FRAME}, 2) ELSE regexp_extract({CALL}, {PAIR}, 2) END AS method_name,
  nullif(regexp_extract({CALL}, {FRAME}, 3), '') AS line_number,
  regexp_extract(name, {PAIR}, 1) AS legacy_class, regexp_extract(name, {PAIR}, 2) AS legacy_method
FROM calls""",
)
def function_names(spark, sf_dir):
    name = F.col("name")
    frame, legacy = profile.frame_parts(name), profile.frame_parts(name, legacy=True)
    return calls(spark, sf_dir).select(
        "event_id",
        profile.function_name(name).alias("function_name"),
        profile.stack_level(name).alias("stack_level"),
        profile.is_jdk_internal(name).alias("is_jdk"),
        profile.jdk_bucket(name).alias("jdk_bucket"),
        frame["class_name"].alias("class_name"),
        frame["method_name"].alias("method_name"),
        frame["line_number"].alias("line_number"),
        legacy["class_name"].alias("legacy_class"),
        legacy["method_name"].alias("legacy_method"),
    )


def _pairs(columns, source="file_rows"):
    lines = {
        s: " || ', ' || ".join(f"'{c}=' || {s}.{c}" for c in columns) for s in ("a", "b")
    }
    same = " AND ".join(f"trim(CAST(a.{c} AS VARCHAR)) = trim(CAST(b.{c} AS VARCHAR))" for c in columns)
    return f"""
pairs AS (
  SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.row_idx, b.row_idx) AS row_idx,
    NOT coalesce({same}, false) AS differs, a.name AS name_a, b.name AS name_b, a.total_time AS time_text_a, b.total_time AS time_text_b,
    'Row ' || (coalesce(a.row_idx, b.row_idx) + 1) || ': ' || coalesce({lines["a"]}, '[FILE A ENDS]') AS a_line,
    'Row ' || (coalesce(a.row_idx, b.row_idx) + 1) || ': ' || coalesce({lines["b"]}, '[FILE B ENDS]') AS b_line
  FROM (SELECT * FROM {source} WHERE run = 'A') a FULL JOIN (SELECT * FROM {source} WHERE run = 'B') b
    ON a.file_id = b.file_id AND a.row_idx = b.row_idx),
ranged AS (
  SELECT *, min(row_idx) OVER (PARTITION BY file_id, grp) AS range_start, max(row_idx) OVER (PARTITION BY file_id, grp) AS range_end,
    count(*) OVER (PARTITION BY file_id, grp) AS row_count
  FROM (SELECT *, row_idx - row_number() OVER (PARTITION BY file_id ORDER BY row_idx) AS grp FROM pairs WHERE differs
    AND file_id IN (SELECT file_id FROM {source} WHERE run = 'A') AND file_id IN (SELECT file_id FROM {source} WHERE run = 'B'))),
ranges AS (SELECT DISTINCT file_id, range_start, range_end, row_count FROM ranged)"""


SHAPE = ["component", "level"]
TIMED = ["component", "timing"]


def _compared(spark, sf_dir, columns):
    return compare.compare_rows(*file_rows(spark, sf_dir), keys=["file_id"], columns=columns)


def _compared_whole(spark, sf_dir, columns):
    """One pair of files that holds all rows, for the reports that use it repeatedly."""
    return compare.compare_rows(*run_rows(spark, sf_dir), keys=["file_id"], columns=columns, reuse=True)


@query(
    CALLS,
    FILE_ROWS,
    _pairs(SHAPE),
    select="""SELECT file_id, range_start + 1 AS start_row, range_end + 1 AS end_row, row_count, 'data_mismatch' AS conflict_type,
  'Conflicting data found in rows ' || (range_start + 1) || ' to ' || (range_end + 1) AS description FROM ranges""",
)
def row_diff_ranges(spark, sf_dir):
    return _compared(spark, sf_dir, SHAPE).ranges


@query(CALLS, FILE_ROWS, _pairs(SHAPE), select="SELECT file_id, row_idx, range_start, a_line, b_line FROM ranged")
def row_diff_pairs(spark, sf_dir):
    return _compared(spark, sf_dir, SHAPE).pairs.select("file_id", "row_idx", "range_start", "a_line", "b_line")


@query(
    CALLS,
    FILE_ROWS,
    _pairs(SHAPE),
    select="""SELECT file_id, range_start, CAST(0 AS BIGINT) AS piece_no, string_agg(a_line, chr(10) ORDER BY row_idx) AS file_a_section,
  string_agg(b_line, chr(10) ORDER BY row_idx) AS file_b_section FROM ranged GROUP BY file_id, range_start""",
)
def row_diff_sections(spark, sf_dir):
    sections = compare.range_sections(_compared(spark, sf_dir, SHAPE))
    return sections.select(
        "file_id",
        "range_start",
        "piece_no",
        F.array_join("a_line", "\n").alias("file_a_section"),
        F.array_join("b_line", "\n").alias("file_b_section"),
    )


PERCENT = r"CAST(nullif(regexp_extract({c}, '(\d+\.?\d*)\s*ms\s*\((\d+\.?\d*)%\)', 1), '') AS DOUBLE)"
CHANGES = f"""
changes AS (
  SELECT *, time_b - time_a AS delta, coalesce(abs(time_b - time_a) > 0.1, false) AS timing_change,
    CASE WHEN time_a > 0 THEN (time_b - time_a) / time_a * 100 ELSE 0 END AS delta_percent,
    function_a <> function_b AS function_change,
    regexp_matches(lower(a_line), 'thread|worker|executor|pool') OR regexp_matches(lower(b_line), 'thread|worker|executor|pool') AS thread_change
  FROM (SELECT file_id, row_idx, range_start, a_line, b_line,
      trim(split_part(a_line, ',', 1), ' "') AS function_a, trim(split_part(b_line, ',', 1), ' "') AS function_b,
      {PERCENT.format(c="a_line")} AS time_a, {PERCENT.format(c="b_line")} AS time_b FROM ranged WHERE trim(a_line) <> trim(b_line)))"""


@query(
    CALLS,
    FILE_ROWS,
    _pairs(TIMED),
    CHANGES,
    select="""SELECT file_id, count(*) FILTER (timing_change) AS timing_changes, count(*) FILTER (function_change) AS function_changes,
  count(*) FILTER (thread_change) AS thread_changes FROM changes GROUP BY file_id""",
)
def change_counts(spark, sf_dir):
    return rows.change_counts(rows.line_changes(_compared(spark, sf_dir, TIMED).pairs), ["file_id"])


TOP_CHANGES = """
numbered AS (SELECT file_id, range_start, row_number() OVER (PARTITION BY file_id ORDER BY range_start) AS range_no FROM ranges),
top_changes AS (
  SELECT *, 'timing' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY abs(delta) DESC, range_start, row_idx) AS rank
    FROM changes WHERE timing_change) WHERE rank <= 20
  UNION ALL SELECT *, 'function' FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY range_start, row_idx) AS rank
    FROM changes WHERE function_change) WHERE rank <= 15
  UNION ALL SELECT *, 'thread' FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY range_start, row_idx) AS rank
    FROM changes WHERE thread_change) WHERE rank <= 10)"""


@query(
    CALLS,
    RUN_ROWS,
    _pairs(TIMED, "run_rows"),
    CHANGES,
    TOP_CHANGES,
    select="""SELECT file_id, kind, rank, range_no, function_a, function_b, round(delta, 4) AS delta, round(delta_percent, 2) AS delta_percent
FROM top_changes JOIN numbered USING (file_id, range_start)""",
)
def top_changes(spark, sf_dir):
    top = compare.top_changes(_compared_whole(spark, sf_dir, TIMED))
    return top.select(
        "file_id",
        "kind",
        "rank",
        "range_no",
        "function_a",
        "function_b",
        F.round("delta", 4).alias("delta"),
        rounded(F.col("delta_percent")).alias("delta_percent"),
    )


@query(
    CALLS,
    RUN_ROWS,
    _pairs(TIMED, "run_rows"),
    CHANGES,
    TOP_CHANGES,
    """
lines AS (
  SELECT file_id, kind, rank, CASE kind
    WHEN 'timing' THEN '- ' || function_a || ': ' || printf('%.2f', time_a) || 'ms → ' || printf('%.2f', time_b) || 'ms ('
      || CASE WHEN delta >= 0 THEN '+' ELSE '' END || printf('%.2f', delta) || 'ms, '
      || CASE WHEN delta_percent >= 0 THEN '+' ELSE '' END || printf('%.1f', delta_percent) || '%)'
    WHEN 'function' THEN '- Range ' || range_no || ': ' || function_a || ' → ' || function_b
    ELSE '- Range ' || range_no || ': Thread behavior change: ' || function_a || ' -> ' || function_b END AS line
  FROM top_changes JOIN numbered USING (file_id, range_start)),
texts AS (SELECT file_id, string_agg(line, chr(10) ORDER BY rank) FILTER (kind = 'timing') AS timing,
  string_agg(line, chr(10) ORDER BY rank) FILTER (kind = 'function') AS function,
  string_agg(line, chr(10) ORDER BY rank) FILTER (kind = 'thread') AS thread FROM lines GROUP BY file_id),
counts AS (SELECT file_id, count(*) FILTER (timing_change) AS t, count(*) FILTER (function_change) AS f,
  count(*) FILTER (thread_change) AS h FROM changes GROUP BY file_id),
totals AS (SELECT file_id, count(*) AS n FROM ranges GROUP BY file_id)""",
    select="""SELECT file_id, concat_ws(chr(10), '# STRUCTURED DIFF SUMMARY' || chr(10) || chr(10) || '## Files Compared:',
  '- File A: a.csv' || chr(10) || '- File B: b.csv' || chr(10) || chr(10) || '## Conflict Statistics:',
  '- Total conflicts: ' || n, '- Timing changes detected: ' || t, '- Function changes detected: ' || f, '- Thread-related changes: ' || h,
  chr(10) || '## Major Timing Changes (>0.1ms difference):', timing, CASE WHEN t > 20 THEN '... and ' || (t - 20) || ' more timing changes' END,
  chr(10) || '## Function Changes:', function, CASE WHEN f > 15 THEN '... and ' || (f - 15) || ' more function changes' END,
  chr(10) || '## Thread-Related Changes:', thread, CASE WHEN h > 10 THEN '... and ' || (h - 10) || ' more thread changes' END) AS summary
FROM counts JOIN totals USING (file_id) LEFT JOIN texts USING (file_id)""",
)
def fast_summary(spark, sf_dir):
    return compare.fast_summary(_compared_whole(spark, sf_dir, TIMED), "a.csv", "b.csv")


def _side(s):
    return rf"""
best_{s} AS (SELECT file_id, range_start, class_name || '.' || method_name AS function_key, arg_max(struct_pack(c := class_name, m := method_name, l := line_number, n := name, t := ms),
    struct_pack(t := ms, r := -row_idx)) AS b
  FROM (SELECT *, CASE WHEN regexp_matches(call, {FRAME}) THEN list_last(string_split(regexp_extract(call, {FRAME}, 1), '.')) ELSE regexp_extract(call, {PAIR}, 1) END AS class_name,
      CASE WHEN regexp_matches(call, {FRAME}) THEN regexp_extract(call, {FRAME}, 2) ELSE regexp_extract(call, {PAIR}, 2) END AS method_name,
      nullif(regexp_extract(call, {FRAME}, 3), '') AS line_number
    FROM (SELECT file_id, range_start, row_idx, name_{s} AS name, regexp_replace(name_{s}, '\s+\(', '(') AS call, {TIME_MS.format(c="time_text_" + s)} AS ms
      FROM ranged WHERE name_{s} IS NOT NULL AND NOT {IS_JDK.format(c="name_" + s)}) WHERE ms > 0)
  GROUP BY 1, 2, 3)"""


HOTSPOTS = f"""{_side("a")},{_side("b")},
joined AS (
  SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.range_start, b.range_start) AS range_start,
    coalesce(a.function_key, b.function_key) AS k, a.b AS a, b.b AS b, a.b.t AS ta, b.b.t AS tb, coalesce(a.b, b.b) AS f
  FROM best_a a FULL JOIN best_b b ON a.file_id = b.file_id AND a.range_start = b.range_start AND a.function_key = b.function_key),
spots AS (
  SELECT file_id, range_start, concat_ws(':', k, f.l) AS function_name, f.c AS class_name, f.m AS method_name,
    CASE WHEN ta IS NOT NULL AND tb IS NOT NULL THEN coalesce(f.l, 'unknown') ELSE f.l END AS line_number,
    coalesce(ta, 0) AS file_a_time, coalesce(tb, 0) AS file_b_time, coalesce(tb, 0) - coalesce(ta, 0) AS time_delta,
    CASE WHEN tb IS NULL THEN 0 WHEN ta IS NULL THEN 'Infinity'::DOUBLE ELSE tb / ta END AS regression_factor,
    coalesce(a.n, '[Function added]') AS raw_line_a, coalesce(b.n, '[Function removed]') AS raw_line_b,
    CASE WHEN tb IS NULL THEN ta WHEN ta IS NULL THEN tb * 2 ELSE abs(tb - ta) * greatest(1.0, abs(tb / ta - 1)) END AS impact_score
  FROM joined WHERE CASE WHEN ta IS NOT NULL AND tb IS NOT NULL THEN abs(tb - ta) > 0.01 OR abs((tb - ta) / ta) > 0.01
    ELSE coalesce(ta, tb) > 0.1 END)"""
HOT_CTES = (CALLS, RUN_ROWS, _pairs(SHAPE, "run_rows"), HOTSPOTS)
_HOT_NUMBERS = ("file_a_time", "file_b_time", "time_delta", "regression_factor", "impact_score")
_HOT_ROUND = ", ".join(f"round({c}, 4) AS {c}" for c in _HOT_NUMBERS)


def _spots(spark, sf_dir):
    result = _compared_whole(spark, sf_dir, SHAPE)
    return hs.find_hotspots(result.pairs, ["file_id"]), result


@query(
    *HOT_CTES,
    select=f"""SELECT file_id, range_start, function_name, class_name, method_name, line_number, raw_line_a, raw_line_b, {_HOT_ROUND},
  'Rows ' || (range_start + 1) || '-' || (range_end + 1) AS row_range FROM spots JOIN ranges USING (file_id, range_start)""",
)
def hotspots(spark, sf_dir):
    spots, result = _spots(spark, sf_dir)
    return _round(hs.with_row_range(spots, result.ranges, ["file_id"]), *_HOT_NUMBERS)


ADVICE = """CASE
  WHEN c LIKE '%eventqueue%' AND m LIKE '%dispatch%' THEN CASE WHEN d > 50
    THEN 'Blocked by synchronized section → refactor lock granularity or use concurrent collections'
    ELSE 'Event processing overhead → batch events or optimize listener callbacks' END
  WHEN c LIKE '%awt%' OR c LIKE '%toolkit%' THEN CASE WHEN m LIKE '%eventloop%' OR m LIKE '%run%'
      THEN 'IO-bound → replace with async channel read/write or use NIO selectors'
    WHEN m LIKE '%paint%' OR m LIKE '%draw%' THEN 'Rendering bottleneck → optimize graphics operations or use double buffering'
    ELSE 'UI thread blocking → move heavy operations to background threads' END
  WHEN c LIKE '%io%' OR m LIKE '%stream%' OR m LIKE '%read%' OR m LIKE '%write%'
    THEN 'I/O bottleneck → implement async I/O with NIO channels or increase buffer sizes'
  WHEN c LIKE '%socket%' OR m LIKE '%network%' OR m LIKE '%connection%'
    THEN 'Network latency → implement connection pooling or use non-blocking sockets'
  WHEN m LIKE '%run%' AND d > 10 THEN 'Algorithmic hotspot in inner loop → cache results or avoid object creation inside loop'
  WHEN d > 100 THEN 'Significant performance regression → profile with JProfiler to identify exact bottleneck'
  WHEN d > 20 THEN 'Moderate regression → check for new synchronization blocks or algorithm changes'
  WHEN d > 0 THEN 'Minor regression → review recent code changes for unintended side effects'
  ELSE 'Performance improvement detected → validate correctness of optimizations' END"""
CHANGE = """CASE WHEN time_delta > 0 THEN '+' || printf('%.1f', time_delta) || 'ms ('
    || CASE WHEN isinf(regression_factor) THEN 'inf' ELSE printf('%.1f', regression_factor) END || 'x slower)'
  WHEN time_delta < 0 AND regression_factor > 0 THEN printf('%.1f', time_delta) || 'ms (' || printf('%.1f', 1 / regression_factor) || 'x faster)'
  WHEN time_delta < 0 THEN printf('%.1f', time_delta) || 'ms (optimized)' ELSE 'no change' END"""
LOCATION = """class_name || '.' || method_name || CASE WHEN line_number IS NOT NULL AND line_number <> 'unknown'
  THEN '(' || class_name || '.java:' || line_number || ')' ELSE '' END"""


@query(
    *HOT_CTES,
    select=f"""SELECT file_id, range_start, function_name, {LOCATION} AS location, {CHANGE} AS change, {ADVICE} AS recommendation
FROM (SELECT *, lower(class_name) AS c, lower(method_name) AS m, time_delta AS d FROM spots)""",
)
def hotspot_labels(spark, sf_dir):
    from rundiff.functions.advice import recommendation
    from rundiff.functions.scores import change_label, location_label

    spots, _ = _spots(spark, sf_dir)
    cls, method, delta = F.col("class_name"), F.col("method_name"), F.col("time_delta")
    return spots.select(
        "file_id",
        "range_start",
        "function_name",
        location_label(cls, method, F.col("line_number")).alias("location"),
        change_label(delta, F.col("regression_factor")).alias("change"),
        recommendation(cls, method, delta).alias("recommendation"),
    )


@query(
    *HOT_CTES,
    select=f"""SELECT row_number() OVER (ORDER BY impact_score DESC, function_name, range_start, file_id) AS rank, file_id, range_start,
  function_name, round(impact_score, 4) AS impact_score, {ADVICE} AS recommendation
FROM (SELECT *, lower(class_name) AS c, lower(method_name) AS m, time_delta AS d FROM spots)
ORDER BY impact_score DESC, function_name, range_start, file_id LIMIT 5""",
)
def hotspot_recommendations(spark, sf_dir):
    spots, _ = _spots(spark, sf_dir)
    top = hs.recommendations(spots, keys=["file_id"])
    return _round(top, "impact_score").select(
        "rank", "file_id", "range_start", "function_name", "impact_score", "recommendation"
    )


@query(
    *HOT_CTES,
    select=f"""SELECT rank, rank || '. ' || location || ' ' || change AS headline,
  'File A: ' || printf('%.1f', file_a_time) || 'ms → File B: ' || printf('%.1f', file_b_time) || 'ms ('
    || CASE WHEN isinf(regression_factor) THEN 'inf' ELSE printf('%.1f', regression_factor) END || 'x)' AS times,
  CASE WHEN rank <= 5 THEN function_name || ': ' || {ADVICE} END AS recommendation
FROM (SELECT *, lower(class_name) AS c, lower(method_name) AS m, time_delta AS d, {CHANGE} AS change, {LOCATION} AS location,
    row_number() OVER (ORDER BY impact_score DESC, function_name, range_start, file_id) AS rank FROM spots) WHERE rank <= 10""",
)
def hotspot_report(spark, sf_dir):
    spots, _ = _spots(spark, sf_dir)
    return compare.hotspot_report(spots, keys=["file_id"])


@query(
    *HOT_CTES,
    select="""SELECT count(*) - 10 AS additional, round(max(impact_score) FILTER (rank > 10), 4) AS highest_impact,
  round(min(impact_score), 4) AS lowest_impact FROM (SELECT *, row_number() OVER (ORDER BY impact_score DESC) AS rank FROM spots)
HAVING count(*) > 10""",
)
def hotspot_tail(spark, sf_dir):
    spots, _ = _spots(spark, sf_dir)
    return _round(hs.remaining_hotspots(spots), "highest_impact", "lowest_impact")


@query(
    CALLS,
    FILE_ROWS,
    _pairs(SHAPE),
    HOTSPOTS,
    select="""SELECT file_id, rank, range_start, function_name, round(impact_score, 4) AS impact_score, n - 10 AS additional FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY impact_score DESC, function_name, range_start) AS rank, count(*) OVER (PARTITION BY file_id) AS n FROM spots)
WHERE rank <= 10 AND n > 10""",
)
def hotspots_per_file(spark, sf_dir):
    result = _compared(spark, sf_dir, SHAPE)
    spots = hs.find_hotspots(result.pairs, ["file_id"])
    rest = hs.remaining_hotspots(spots, keys=["file_id"]).select("file_id", "additional")
    top = hs.top_hotspots(spots, keys=["file_id"]).join(rest, "file_id")
    return _round(top, "impact_score").select("file_id", "rank", "range_start", "function_name", "impact_score", "additional")
