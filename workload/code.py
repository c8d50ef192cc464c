"""Queries over trace lines, source files, methods and result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rundiff.operators import frames, methods, resolve, results
from rundiff.operators.lookup import look_up, merge_join
from rundiff.plans import traces
from rundiff.session import shared_folder
from workload import inputs
from workload.inputs import LONG_SOURCES, NOW, RESULTS, SOURCES, TRACE_LINES
from workload.registry import query

# Frames repeat in the trace lines; the parse queries report each distinct line with its count.
LINES = """
lines AS (SELECT line, count(*) AS n FROM trace_lines GROUP BY line)"""


def _lines(spark, sf_dir):
    return inputs.trace_lines(spark, sf_dir).groupBy("line").agg(F.count("*").alias("n"))


def _catalog(spark, sf_dir):
    return resolve.file_catalog(inputs.source_files(spark, sf_dir).select("path"))


def _index(spark, sf_dir, reuse=True):
    return methods.method_index(inputs.sources(spark, sf_dir), reuse=reuse)


_P = r"([a-zA-Z][a-zA-Z0-9_]*(?:\.[a-zA-Z][a-zA-Z0-9_]*)*?)\.([A-Z][a-zA-Z0-9_]*?)"
PLAIN = rf"""
plain AS (SELECT line, n, CASE
    WHEN regexp_matches(line, '^{_P}\.([a-zA-Z][a-zA-Z0-9_]*)\(([^:]+):(\d+)\)$') THEN 'with_line'
    WHEN regexp_matches(line, '^at\s+{_P}\.([a-zA-Z][a-zA-Z0-9_]*)\(([^:]+):(\d+)\)$') THEN 'at_format'
    WHEN regexp_matches(line, '^(?:.*?[/\\])?([a-zA-Z][a-zA-Z0-9_]*(?:[/\\][a-zA-Z][a-zA-Z0-9_]*)*)[/\\]([A-Z][a-zA-Z0-9_]*?)\.java$') THEN 'file_path_slash'
    WHEN regexp_matches(line, '^(?:([a-zA-Z][a-zA-Z0-9_]*(?:\.[a-zA-Z][a-zA-Z0-9_]*)*?)\.)?([A-Z][a-zA-Z0-9_]*?)$') THEN 'class_only'
    ELSE 'class_token' END AS pattern,
  regexp_extract(line, '(P\d+)', 1) AS class_name, regexp_extract(line, '(com[/.]app[/.]p\d+)', 1) AS package
  FROM lines)"""


@query(
    TRACE_LINES,
    LINES,
    PLAIN,
    select=rf"""SELECT *, coalesce(len(string_split(package_path, '/')) <= {frames.MAX_PACKAGE_DEPTH} AND regexp_matches(class_name, '^\p{{Lu}}')
  AND (method IS NULL OR regexp_matches(method, '^\p{{Ll}}')), false) AS valid
FROM (SELECT line, n, pattern, translate(package, '.', '/') AS package_path,
  CASE WHEN pattern = 'class_token' AND line LIKE '%#LATER%' THEN CASE WHEN length(class_name) >= 5 THEN class_name ELSE 'Inner' END ELSE class_name END AS class_name,
  CASE WHEN pattern IN ('with_line', 'at_format') THEN regexp_extract(line, '\.([a-z]\w*)\(', 1) END AS method,
  CASE WHEN pattern IN ('with_line', 'at_format') THEN CAST(regexp_extract(line, ':(\d+)\)', 1) AS INT) END AS line_number
  FROM plain)""",
)
def frame_plain(spark, sf_dir):
    parsed = frames.parse_lines(_lines(spark, sf_dir), "plain").withColumnRenamed("frame", "f")
    return parsed.select(
        "line",
        "n",
        "f.pattern",
        "f.package_path",
        "f.class_name",
        "f.method",
        "f.line_number",
        frames.is_valid_frame(F.col("f")).alias("valid"),
    )


REFERENCE = r"""
reference AS (SELECT line, n,
    CASE WHEN regexp_matches(text, '^.*[/\\].*\.java$') THEN regexp_extract(text, '([^/\\]*)\.java$', 1)
      WHEN regexp_matches(text, '^([\w.]+\$?[\w$]*)#([\w$][\w$]*)$') THEN regexp_extract(text, '^([\w.]+\$?[\w$]*)#', 1)
      WHEN regexp_matches(text, '^([\w.]+)\.(\w+)\([^)]*\)(?:\s*at\s*.*)?$') THEN regexp_extract(text, '^([\w.]+)\.(\w+)\(', 1)
      WHEN regexp_matches(text, '^[\w.]+$') THEN regexp_extract(text, '^(?:[a-z]\w*\.)*[A-Z]\w*', 0) ELSE text END AS class_fqn,
    CASE WHEN regexp_matches(text, '^.*[/\\].*\.java$') THEN NULL
      WHEN regexp_matches(text, '^([\w.]+\$?[\w$]*)#([\w$][\w$]*)$') THEN regexp_extract(text, '#(.*)$', 1)
      WHEN regexp_matches(text, '^([\w.]+)\.(\w+)\([^)]*\)(?:\s*at\s*.*)?$') THEN regexp_extract(text, '^([\w.]+)\.(\w+)\(', 2)
      WHEN regexp_matches(text, '^[\w.]+$') THEN nullif(regexp_extract(text, '[A-Z]\w*\.(.*)$', 1), '') END AS method,
    CASE WHEN regexp_matches(text, '^.*[/\\].*\.java$') THEN text END AS explicit_path,
    CASE WHEN regexp_matches(text, '^.*[/\\].*\.java$') THEN 'explicit_path'
      WHEN regexp_matches(text, '^([\w.]+\$?[\w$]*)#([\w$][\w$]*)$') THEN 'intellij_format'
      WHEN regexp_matches(text, '^([\w.]+)\.(\w+)\([^)]*\)(?:\s*at\s*.*)?$') THEN 'stack_frame'
      WHEN regexp_matches(text, '^[\w.]+$') THEN 'class_only' ELSE 'fallback' END AS pattern
  FROM (SELECT line, n, regexp_replace(line, '^(.+)\[.*\]$', '\1') AS text FROM lines))"""


@query(TRACE_LINES, LINES, REFERENCE, select="SELECT line, n, class_fqn, method, explicit_path, pattern FROM reference")
def frame_reference(spark, sf_dir):
    parsed = frames.parse_lines(_lines(spark, sf_dir), "reference").withColumnRenamed("frame", "f")
    return parsed.select("line", "n", "f.class_fqn", "f.method", "f.explicit_path", "f.pattern")


@query(
    TRACE_LINES,
    LINES,
    select=r"""SELECT line, n,
  CASE WHEN text LIKE '%/%.java' THEN regexp_extract(text, '([^/]*)\.java$', 1) WHEN contains(text, '#') THEN split_part(text, '#', 1)
    WHEN contains(text, '(') THEN regexp_extract(text, '^(.+)\.(\w+)\(', 1) WHEN contains(text, '.') THEN regexp_extract(text, '^(?:[a-z]\w*\.)*[A-Z]\w*', 0) ELSE text END AS class_fqn,
  CASE WHEN text LIKE '%/%.java' THEN NULL WHEN contains(text, '#') THEN split_part(text, '#', 2)
    WHEN contains(text, '(') THEN regexp_extract(text, '^(.+)\.(\w+)\(', 2) WHEN contains(text, '.') THEN regexp_extract(text, '[A-Z]\w*\.(.*)$', 1) END AS method,
  CASE WHEN text LIKE '%/%.java' THEN text END AS explicit_path
FROM (SELECT line, n, regexp_replace(line, '^(.+)\[.*\]$', '\1') AS text FROM lines)""",
)
def frame_tokens(spark, sf_dir):
    parsed = frames.parse_lines(_lines(spark, sf_dir), "tokens").withColumnRenamed("frame", "f")
    return parsed.select("line", "n", "f.class_fqn", "f.method", "f.explicit_path")


@query(
    TRACE_LINES,
    LINES,
    select=r"""SELECT line, n, valid, CASE WHEN valid THEN class_name END AS parsed_class,
  CASE WHEN valid AND contains(line, '#') THEN split_part(line, '#', 2) WHEN valid AND line LIKE '%.helper' THEN 'helper' END AS parsed_method,
  CASE WHEN valid THEN CASE WHEN contains(line, '.') THEN regexp_replace(translate(line, '.', '/'), '/P\d.*$', '') ELSE '' END END AS parsed_package,
  CASE WHEN valid THEN CASE WHEN contains(line, '#') THEN 'hash_format' WHEN contains(line, '.') THEN 'dot_format' ELSE 'class_only' END END AS parse_type,
  CASE WHEN valid THEN 'Successfully parsed class: ' || class_name ELSE 'Could not extract class name from input' END AS message
FROM (SELECT line, n, regexp_extract(line, '(P\d+)', 1) AS class_name,
  NOT (contains(line, '(') OR contains(line, '$') OR contains(line, '/')) AS valid FROM lines)""",
)
def frame_format_check(spark, sf_dir):
    return frames.format_check(_lines(spark, sf_dir))


@query(
    TRACE_LINES,
    LINES,
    REFERENCE,
    select=r"""SELECT line, n, CASE WHEN contains(class_fqn, '.') THEN translate(regexp_replace(class_fqn, '\.[^.]*$', ''), '.', '/') ELSE '' END AS package_path,
  list_last(string_split(class_fqn, '.')) AS class_name, method, list_last(string_split(class_fqn, '.')) || '.java' AS file_name FROM reference""",
)
def frame_converted(spark, sf_dir):
    parsed = frames.parse_lines(_lines(spark, sf_dir), "reference").withColumn("f", frames.as_plain_frame(F.col("frame")))
    return parsed.select("line", "n", "f.package_path", "f.class_name", "f.method", "f.file_name")


RESOLVED = r"""
wanted AS (SELECT DISTINCT class_fqn, explicit_path FROM reference),
keyed AS (SELECT *, translate(split_part(class_fqn, '$', 1), '.', '/') || '.java' AS k,
  list_last(string_split(split_part(class_fqn, '$', 1), '.')) || '.java' AS f FROM wanted),
resolved AS (
  SELECT w.class_fqn, w.explicit_path,
    CASE WHEN w.explicit_path IS NOT NULL THEN x.path ELSE coalesce(d.path, s.path, fz.path) END AS path,
    CASE WHEN w.explicit_path IS NOT NULL THEN CASE WHEN x.path IS NULL THEN 'explicit_path_not_found' ELSE 'explicit_path_relative' END
      WHEN d.path IS NOT NULL THEN 'exact_fqn' WHEN s.path IS NOT NULL THEN 'exact_fqn_with_src'
      WHEN fz.path IS NOT NULL THEN 'fuzzy_exact_case' ELSE 'not_found' END AS strategy,
    CASE WHEN w.explicit_path IS NULL AND d.path IS NULL AND s.path IS NULL THEN coalesce(fz.n, 0) ELSE 0 END AS candidate_count
  FROM keyed w LEFT JOIN source_files x ON x.path = w.explicit_path
    LEFT JOIN source_files d ON d.path = w.k LEFT JOIN source_files s ON s.path = 'src/main/java/' || w.k
    LEFT JOIN (SELECT list_last(string_split(path, '/')) AS f, count(*) AS n,
      arg_min(path, struct_pack(d := len(string_split(path, '/')), p := path)) AS path FROM source_files GROUP BY 1) fz ON fz.f = w.f)"""


@query(TRACE_LINES, LINES, REFERENCE, SOURCES, RESOLVED, select="SELECT * FROM resolved")
def frame_resolve(spark, sf_dir):
    parsed = frames.parse_lines(_lines(spark, sf_dir), "reference").select("frame.*")
    return resolve.resolve_frames(parsed, _catalog(spark, sf_dir))


@query(
    TRACE_LINES,
    LINES,
    SOURCES,
    select=r"""SELECT class_fqn, coalesce(d.path, fz.path) AS path, CASE WHEN d.path IS NOT NULL THEN 'exact_fqn' WHEN fz.path IS NOT NULL THEN 'fuzzy' END AS how_found
FROM (SELECT DISTINCT 'com.app.p' || p_size || '.P' || p_partkey AS class_fqn FROM part) w
LEFT JOIN source_files d ON d.path = translate(class_fqn, '.', '/') || '.java'
LEFT JOIN source_files fz ON list_last(string_split(fz.path, '/')) = list_last(string_split(class_fqn, '.')) || '.java'""",
)
def frame_token_walk(spark, sf_dir):
    names = inputs.table(spark, sf_dir, "part").selectExpr("concat('com.app.p', p_size, '.P', p_partkey) AS class_fqn")
    return resolve.by_token_walk(names, _catalog(spark, sf_dir))


@query(
    SOURCES,
    select=r"""SELECT package_path, file_name, max(path) AS path FROM (
  SELECT 'APP.p' || p_size AS package_path, 'P' || p_partkey || '.java' AS file_name, CASE WHEN p_size > 40 THEN 'app/p' || p_size || '/P' || p_partkey || '.java' END AS path FROM part
  UNION ALL SELECT 'com.app.p' || p_size, 'P' || p_partkey || '.java', CASE WHEN p_size > 40 THEN 'app/p' || p_size || '/P' || p_partkey || '.java' END FROM part) GROUP BY ALL""",
)
def frame_sequential(spark, sf_dir):
    part = inputs.table(spark, sf_dir, "part")
    upper = part.selectExpr("concat('APP.p', p_size) AS package_path", "concat('P', p_partkey, '.java') AS file_name")
    full = part.selectExpr("concat('com.app.p', p_size) AS package_path", "concat('P', p_partkey, '.java') AS file_name")
    below_com = inputs.source_files(spark, sf_dir).where("path LIKE 'com/%'").selectExpr("substring(path, 5) AS path")
    return resolve.by_sequential_path(upper.unionByName(full), resolve.file_catalog(below_com), "com")


@query(
    SOURCES,
    select=r"""SELECT 'legacy/app/p' || p_size AS package_path, 'P' || p_partkey || '.java' AS file_name, path, 2 AS tail_length, 1 AS match_count
FROM part JOIN source_files ON path LIKE '%/app/p' || p_size || '/P' || p_partkey || '.java'""",
)
def frame_path_suffix(spark, sf_dir):
    wanted = inputs.table(spark, sf_dir, "part").selectExpr(
        "concat('legacy/app/p', p_size) AS package_path", "concat('P', p_partkey, '.java') AS file_name"
    )
    return resolve.by_path_suffix(wanted, _catalog(spark, sf_dir))


@query(
    SOURCES,
    select="""SELECT 'x.P' || p_partkey AS class_fqn, path, 1 AS match_count FROM part JOIN source_files ON path LIKE '%/P' || p_partkey || '.java'""",
)
def frame_declaration(spark, sf_dir):
    wanted = inputs.table(spark, sf_dir, "part").selectExpr("concat('x.P', p_partkey) AS class_fqn")
    return resolve.by_declaration(wanted, _catalog(spark, sf_dir), inputs.sources(spark, sf_dir))


@query(
    SOURCES,
    select=r"""SELECT lower(list_last(string_split(path, '/'))) AS lower_name, path, len(string_split(path, '/')) - 1 AS depth FROM source_files""",
)
def frame_candidates(spark, sf_dir):
    wanted = inputs.table(spark, sf_dir, "part").selectExpr("concat('x.p', p_partkey, '$Y') AS class_fqn")
    return resolve.candidate_files(wanted, _catalog(spark, sf_dir))


ROOTS = r"""
dirs AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, count(*) AS n FROM source_files GROUP BY 1),
above AS (SELECT dir, n, array_to_string(list_slice(string_split(dir, '/'), 1, i), '/') AS folder
  FROM (SELECT *, unnest(range(0, len(string_split(dir, '/')) + 1)) AS i FROM dirs)),
folders AS (SELECT folder, sum(n) AS total_files, sum(CASE WHEN dir = folder THEN n ELSE 0 END) AS direct_files,
  bool_or(regexp_replace(dir, '/?[^/]+$', '') = folder AND dir <> folder) AS sub FROM above GROUP BY folder),
roots AS (SELECT folder, CAST(total_files AS BIGINT) AS total_files, CAST(direct_files AS BIGINT) AS direct_files,
  regexp_matches(folder, '(^|/)(src/main/java|src|java|main/java)$') AS known_pattern FROM folders
  WHERE regexp_matches(folder, '(^|/)(src/main/java|src|java|main/java)$') OR (direct_files > 0 AND (direct_files >= 2 OR total_files > 5 OR sub)))"""


@query(SOURCES, ROOTS, select="SELECT * FROM roots")
def source_roots(spark, sf_dir):
    return resolve.source_roots(_catalog(spark, sf_dir))


@query(
    SOURCES,
    ROOTS,
    select=r"""SELECT path, coalesce(root, '') AS source_root, ltrim(substr(dir, length(coalesce(root, '')) + 1), '/') AS package_path,
  CASE WHEN path LIKE 'src/%' THEN substr(path, 5) ELSE list_last(string_split(path, '/')) END AS display_path
FROM (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM source_files) f
LEFT JOIN (SELECT dir AS d, arg_max(folder, length(folder)) AS root FROM above JOIN roots USING (folder) GROUP BY dir) r ON r.d = f.dir""",
)
def source_packages(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    placed = resolve.package_of(catalog, resolve.source_roots(catalog))
    return placed.select(
        "path", "source_root", "package_path", resolve.display_path(F.col("path")).alias("display_path")
    )


_DECL = r"""'^(?:(?:public|private|protected|static|final|abstract|synchronized|native|strictfp|\s)+)?\s*(?:<[^>]+>\s+)?([a-zA-Z_][\w<>\[\],\s]*?)\s+([a-zA-Z_]\w*)\s*\(([^)]*)\)\s*(?:throws\s+[^{;]+)?\s*[{;]'"""
METHODS = rf"""
squeezed AS (SELECT *, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS s,
    length(text) - length(replace(text, '{{', '')) - (length(text) - length(replace(text, '}}', ''))) AS net FROM source_lines),
balanced AS (SELECT *, sum(net) OVER (PARTITION BY path ORDER BY line_no) AS balance, max(line_no) OVER (PARTITION BY path) AS last_line FROM squeezed),
declared AS (SELECT path, regexp_extract(s, {_DECL}, 2) AS name, regexp_extract(s, {_DECL}, 1) AS return_type, regexp_extract(s, {_DECL}, 3) AS args,
    line_no AS start_line, s AS signature, balance - net AS depth, last_line FROM balanced
  WHERE regexp_matches(s, {_DECL}) AND regexp_extract(s, {_DECL}, 2) NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'new')),
ends AS (SELECT d.path AS p, d.start_line AS l, min(b.line_no) AS e FROM declared d JOIN balanced b ON b.path = d.path AND b.line_no >= d.start_line AND b.balance <= d.depth GROUP BY 1, 2),
methods AS (SELECT path, name, return_type, args, start_line, signature, CASE WHEN signature LIKE '%;' THEN start_line ELSE coalesce(e, last_line) END AS end_line,
    signature LIKE '%;' OR e IS NOT NULL AS closed
  FROM declared LEFT JOIN ends ON p = path AND l = start_line)"""


@query(
    SOURCES,
    METHODS,
    select="""SELECT path, name, return_type, args AS parameters, start_line, end_line, closed, signature,
  concat_ws(',', CASE WHEN signature LIKE 'public %' THEN 'public' END, CASE WHEN signature LIKE 'static %' THEN 'static' END, CASE WHEN signature LIKE 'abstract %' THEN 'abstract' END) AS modifiers
FROM methods""",
)
def method_index(spark, sf_dir):
    index = methods.unique_methods(_index(spark, sf_dir, reuse=False))
    return index.withColumns(
        {"parameters": F.array_join("parameters", ", "), "modifiers": F.array_join("modifiers", ",")}
    )


# Declarations on one line, and those whose lines, from one after the end of a statement to another, put together declare a method.
LONG_METHODS = METHODS.replace("declared AS (", "declared_here AS (").split("ends AS (")[0] + rf"""
commented AS (SELECT *, coalesce(sum((contains(text, '/*'))::INT - (contains(text, '*/'))::INT) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0
    OR contains(text, '/*') AS remark FROM source_lines),
bare AS (SELECT path, line_no, trim(regexp_replace(regexp_replace(regexp_replace(text, '"[^"]*"', ' ', 'g'), '//.*', ''), '\s+', ' ', 'g')) AS code FROM commented WHERE NOT remark),
listed AS (SELECT *, row_number() OVER w AS i, lag(code) OVER w AS above FROM bare WHERE code <> '' AND NOT regexp_matches(code, '^@\w+$') WINDOW w AS (PARTITION BY path ORDER BY line_no)),
joined AS (SELECT a.path, a.line_no AS start_line, b.line_no AS last, (SELECT string_agg(code, ' ' ORDER BY line_no) FROM listed c WHERE c.path = a.path AND c.i BETWEEN a.i AND b.i) AS s
  FROM listed a JOIN listed b ON b.path = a.path AND b.i BETWEEN a.i + 1 AND a.i + 9 WHERE a.above IS NULL OR regexp_matches(a.above, '[{{}};]$')),
declared AS (SELECT path, name, return_type, args, start_line, signature, depth, last_line, start_line AS last FROM declared_here
  UNION ALL SELECT j.path, regexp_extract(s, {_DECL}, 2), regexp_extract(s, {_DECL}, 1), trim(regexp_extract(s, {_DECL}, 3)), start_line, s, b.balance - b.net, b.last_line, last
  FROM joined j JOIN (SELECT path, line_no, balance, net, last_line FROM balanced) b ON b.path = j.path AND b.line_no = j.start_line
  WHERE regexp_full_match(s, '[^{{}};]*[{{;]') AND regexp_matches(s, {_DECL})),
ends AS (SELECT d.path AS p, d.start_line AS l, min(b.line_no) AS e FROM declared d JOIN balanced b ON b.path = d.path AND b.line_no >= d.last AND b.balance <= d.depth GROUP BY 1, 2),
methods AS (SELECT path, name, return_type, args, start_line, signature, CASE WHEN signature LIKE '%;' THEN last ELSE coalesce(e, last_line) END AS end_line,
    signature LIKE '%;' OR e IS NOT NULL AS closed, last FROM declared LEFT JOIN ends ON p = path AND l = start_line)"""


@query(
    LONG_SOURCES,
    LONG_METHODS,
    select="""SELECT path, name, return_type, args AS parameters, start_line, end_line, closed, signature,
  concat_ws(',', CASE WHEN signature LIKE 'public %' THEN 'public' END, CASE WHEN signature LIKE '% static %' THEN 'static' END) AS modifiers
FROM methods""",
)
def method_multiline(spark, sf_dir):
    index = methods.method_index(inputs.long_sources(spark, sf_dir), long=True)
    return index.withColumns({"parameters": F.array_join("parameters", ", "), "modifiers": F.array_join("modifiers", ",")})


@query(
    LONG_SOURCES,
    LONG_METHODS,
    select=r"""SELECT path, name AS method, start_line, end_line, signature, start_line = min(start_line) OVER (PARTITION BY path, name) AS is_default,
  count(*) OVER (PARTITION BY path, name) AS candidates FROM methods WHERE name = 'm' || regexp_extract(path, '/p(\d+)/', 1)""",
)
def method_overloads(spark, sf_dir):
    index = methods.method_index(inputs.long_sources(spark, sf_dir), reuse=True, long=True)
    requests = index.select("path", F.concat(F.lit("m"), F.regexp_extract("path", "/p([0-9]+)/", 1)).alias("method")).distinct()
    found = methods.overloads(requests, index)
    counts = methods.find_methods(requests, index).select("path", "method", F.col("overloads").alias("candidates"))
    return merge_join(found, counts, ["path", "method"]).select("path", "method", "start_line", "end_line", "signature", "is_default", "candidates")


@query(
    SOURCES,
    METHODS,
    select="""SELECT path, piece_no, string_agg(name, ',' ORDER BY start_line) AS names, string_agg(start_line, ',' ORDER BY start_line) AS lines,
  string_agg(signature, ' | ' ORDER BY start_line) AS signatures, count(*) AS method_count
FROM (SELECT *, (row_number() OVER (PARTITION BY path ORDER BY start_line) - 1) // 10000 AS piece_no FROM methods) GROUP BY path, piece_no""",
)
def method_lists(spark, sf_dir):
    lists = methods.method_lists(_index(spark, sf_dir, reuse=False))
    return lists.select(
        "path",
        "piece_no",
        F.array_join("name", ",").alias("names"),
        F.array_join(F.col("line").cast("array<string>"), ",").alias("lines"),
        F.array_join("full_signature", " | ").alias("signatures"),
        F.col("method_count").cast("long").alias("method_count"),
    )


@query(
    SOURCES,
    METHODS,
    select="""SELECT path, name, start_line, piece_no, string_agg(text, chr(10) ORDER BY line_no) AS body
FROM (SELECT m.path, name, start_line, line_no, text, (line_no - start_line) // 10000 AS piece_no
  FROM methods m JOIN source_lines s ON s.path = m.path AND s.line_no BETWEEN start_line AND end_line) GROUP BY path, name, start_line, piece_no""",
)
def method_bodies(spark, sf_dir):
    return methods.method_bodies(methods.method_lines(_index(spark, sf_dir, reuse=False), inputs.sources(spark, sf_dir)))


REQUESTS = """
requests AS (SELECT path, unnest(['m' || split_part(regexp_extract(path, '/p(\\d+)/', 1), '/', 1), 'LATER', 'elpe', 'missing']) AS method FROM source_files)"""


@query(
    SOURCES,
    METHODS,
    REQUESTS,
    select="""SELECT path, method, CASE WHEN x IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'case_insensitive' WHEN p IS NOT NULL THEN 'contains' END AS match,
  coalesce(x, c, p) AS found_line, overloads FROM (
  SELECT r.path, r.method, min(start_line) FILTER (name = method) AS x, min(start_line) FILTER (lower(name) = lower(method)) AS c,
    min(start_line) FILTER (contains(lower(name), lower(method))) AS p, count(*) FILTER (name = method) AS overloads
  FROM requests r LEFT JOIN methods m ON m.path = r.path GROUP BY r.path, r.method)""",
)
def method_lookup(spark, sf_dir):
    requests = inputs.source_files(spark, sf_dir).selectExpr(
        "path",
        "explode(array(concat('m', regexp_extract(path, '/p([0-9]+)/', 1)), 'LATER', 'elpe', 'missing')) AS method",
    )
    found = methods.find_methods(requests, _index(spark, sf_dir))
    return found.select("path", "method", "match", F.col("found.line").alias("found_line"), "overloads")


DEPS = r"""
deps AS (SELECT DISTINCT path, name, start_line, dependency FROM (
    SELECT m.path, name, start_line, unnest(list_concat(regexp_extract_all(text, '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1),
      list_concat(regexp_extract_all(text, '\bthis\.([a-zA-Z_][a-zA-Z0-9_]*)', 1), regexp_extract_all(text, '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*[=;]', 1)))) AS dependency
    FROM methods m JOIN source_lines s ON s.path = m.path AND s.line_no BETWEEN start_line AND end_line)
  WHERE dependency NOT IN ('if', 'for', 'while', 'try', 'catch', 'return', 'new', 'super', 'this'))"""


def _deps(spark, sf_dir):
    index = _index(spark, sf_dir)
    return methods.dependencies(methods.method_lines(index, inputs.sources(spark, sf_dir))), index


@query(SOURCES, METHODS, DEPS, select="SELECT * FROM deps")
def method_dependencies(spark, sf_dir):
    return _deps(spark, sf_dir)[0]


@query(
    SOURCES,
    METHODS,
    DEPS,
    select="""SELECT d.path, d.name AS caller, d.start_line AS caller_line, dependency AS callee, m.start_line AS callee_line, m.end_line AS callee_end_line
FROM deps d JOIN methods m ON m.path = d.path AND m.name = dependency""",
)
def call_edges(spark, sf_dir):
    return methods.call_edges(*_deps(spark, sf_dir))


@query(
    SOURCES,
    select=r"""SELECT path, line_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, 'import' AS kind FROM source_lines WHERE line_no <= 2
UNION ALL SELECT path, line_no, regexp_replace(text, '^\s+|\s+$', '', 'g'), 'field' FROM source_lines WHERE text LIKE '    private int size%'
UNION ALL SELECT path, line_no, replace(text, ' {', ''), 'class' FROM source_lines WHERE text LIKE 'public class %'""",
)
def source_parts(spark, sf_dir):
    lines = inputs.sources(spark, sf_dir)
    classes = methods.class_declarations(lines).withColumnRenamed("declaration", "text")
    kinds = {"import": methods.imports(lines), "field": methods.class_fields(lines), "class": classes}
    tagged = [df.select("path", "line_no", "text", F.lit(kind).alias("kind")) for kind, df in kinds.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


CONTEXT = """
targets AS (SELECT * FROM methods),
context AS (
  SELECT DISTINCT t.path, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS start_line, 0 AS part, 0 AS part_line, s.line_no, regexp_replace(s.text, '^\\s+|\\s+$', '', 'g') AS text FROM targets t JOIN source_lines s ON s.path = t.path AND s.line_no <= 2
  UNION ALL SELECT DISTINCT t.path, NULL, NULL, 1, 0, s.line_no, replace(s.text, ' {', '') FROM targets t JOIN source_lines s ON s.path = t.path AND s.text LIKE 'public class %'
  UNION ALL SELECT DISTINCT t.path, NULL, NULL, 2, 0, s.line_no, regexp_replace(s.text, '^\\s+|\\s+$', '', 'g') FROM targets t JOIN source_lines s ON s.path = t.path AND s.text LIKE '    private int size%'
  UNION ALL SELECT t.path, t.name, t.start_line, 3, t.start_line, s.line_no, s.text FROM targets t JOIN source_lines s ON s.path = t.path AND s.line_no BETWEEN t.start_line AND t.end_line
  UNION ALL SELECT t.path, t.name, t.start_line, 4, m.start_line, s.line_no, s.text FROM targets t JOIN deps d ON d.path = t.path AND d.start_line = t.start_line
    JOIN methods m ON m.path = t.path AND m.name = d.dependency JOIN source_lines s ON s.path = t.path AND s.line_no BETWEEN m.start_line AND m.end_line)"""


@query(
    SOURCES,
    METHODS,
    DEPS,
    CONTEXT,
    select="SELECT * FROM context",
)
def method_context(spark, sf_dir):
    return _context(spark, sf_dir)


def _references(spark, sf_dir):
    index = _index(spark, sf_dir)
    return traces.context_references(index, index, inputs.sources(spark, sf_dir))


def _context(spark, sf_dir):
    return traces.context_text(_references(spark, sf_dir))


@query(
    SOURCES,
    METHODS,
    DEPS,
    CONTEXT,
    select="""SELECT path, name, start_line, CASE part WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 2 END AS chunk_no, count(*) AS lines, CAST(sum(length(text) + 1) AS BIGINT) AS char_count,
  CASE part WHEN 3 THEN 'target_method' WHEN 4 THEN 'dependent_methods' ELSE 'class_context' END AS type,
  CASE part WHEN 3 THEN 'Target method: ' || name WHEN 4 THEN 'Dependent methods (' || count(DISTINCT part_line) || ' methods)' ELSE 'Class context (imports and fields)' END AS description
FROM (SELECT * REPLACE (CASE WHEN part = 2 THEN 0 ELSE part END AS part) FROM context WHERE part <> 1) GROUP BY path, name, start_line, part""",
)
def code_chunks(spark, sf_dir):
    return traces.context_chunks(_references(spark, sf_dir))


@query(
    SOURCES,
    METHODS,
    DEPS,
    CONTEXT,
    select="""SELECT o.path, name, start_line, CAST(own + shared AS BIGINT) AS code_chars, own + shared > 16000 AS chunked
FROM (SELECT path, name, start_line, sum(length(text) + 1) AS own FROM context WHERE name IS NOT NULL GROUP BY ALL) o
JOIN (SELECT path, sum(length(text) + 1) AS shared FROM context WHERE name IS NULL GROUP BY path) s ON s.path = o.path""",
)
def code_size(spark, sf_dir):
    return traces.context_sizes(_references(spark, sf_dir))


ANSWERS = """
found AS (SELECT r.line, r.n, r.class_fqn, r.method, z.path, z.strategy, min(m.start_line) FILTER (m.name = r.method) AS x,
    min(m.start_line) FILTER (lower(m.name) = lower(r.method)) AS c, min(m.start_line) FILTER (contains(lower(m.name), lower(r.method))) AS p, count(m.name) AS k
  FROM reference r LEFT JOIN resolved z ON z.class_fqn = r.class_fqn AND z.explicit_path IS NOT DISTINCT FROM r.explicit_path
    LEFT JOIN methods m ON m.path = z.path GROUP BY ALL),
answers AS (SELECT *, CASE WHEN path IS NULL THEN 'file_not_found' WHEN method IS NOT NULL AND coalesce(x, c, p) IS NULL THEN 'method_not_found' END AS reason,
  CASE WHEN path IS NULL THEN 'error' WHEN coalesce(x, c, p) IS NOT NULL THEN 'specific_method' WHEN k > 0 THEN 'all_methods' ELSE 'full_file' END AS extraction_type FROM found)"""


@query(
    TRACE_LINES,
    LINES,
    REFERENCE,
    SOURCES,
    RESOLVED,
    METHODS,
    ANSWERS,
    select="""SELECT line, n, class_fqn, method, path, strategy, coalesce(x, c, p) AS start_line, reason, extraction_type,
  CASE WHEN reason IS NULL THEN 'success' ELSE 'failure' END AS status FROM answers""",
)
def trace_to_method(spark, sf_dir):
    resolved = traces.resolve_traces(_lines(spark, sf_dir), _catalog(spark, sf_dir), _index(spark, sf_dir))
    return resolved.select(
        "line", "n", "class_fqn", "method", "path", "strategy", "start_line", "reason", "extraction_type", "status"
    )


@query(
    SOURCES,
    METHODS,
    DEPS,
    CONTEXT,
    select="""SELECT path, name, start_line, CASE part WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 2 END AS chunk_no, CAST(0 AS BIGINT) AS piece_no,
  string_agg(text, chr(10) ORDER BY part_order, part_line, line_no) AS text
FROM (SELECT * REPLACE (CASE WHEN part = 2 THEN 0 ELSE part END AS part), part AS part_order FROM context WHERE part <> 1) GROUP BY path, name, start_line, part""",
)
def code_texts(spark, sf_dir):
    return traces.code_texts(_context(spark, sf_dir))


@query(
    TRACE_LINES,
    LINES,
    REFERENCE,
    SOURCES,
    RESOLVED,
    METHODS,
    select="""SELECT m.path, string_agg(DISTINCT m.name, ',' ORDER BY m.name) AS names, count(DISTINCT m.start_line) AS method_count
FROM (SELECT r.line, z.path, r.method, bool_or(contains(lower(m.name), lower(r.method))) AS hit
  FROM reference r JOIN resolved z ON z.class_fqn = r.class_fqn AND z.explicit_path IS NOT DISTINCT FROM r.explicit_path
    LEFT JOIN methods m ON m.path = z.path WHERE z.path IS NOT NULL GROUP BY ALL) t
JOIN methods m ON m.path = t.path WHERE t.method IS NULL OR NOT coalesce(t.hit, false) GROUP BY m.path""",
)
def trace_methods(spark, sf_dir):
    """Methods to choose from where a trace has no method or one that its file lacks."""
    index = _index(spark, sf_dir)
    resolved = traces.resolve_traces(_lines(spark, sf_dir), _catalog(spark, sf_dir), index)
    lists = traces.available_methods(resolved, index)
    names = lists.select("path", F.explode("name").alias("name")).groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))
    return merge_join(names, lists.groupBy("path").agg(F.sum("method_count").alias("method_count")), "path")


@query(
    TRACE_LINES,
    LINES,
    REFERENCE,
    SOURCES,
    RESOLVED,
    METHODS,
    """
found AS (SELECT r.line, r.n, r.method, z.path, bool_or(contains(lower(m.name), lower(r.method))) AS hit
  FROM reference r LEFT JOIN resolved z ON z.class_fqn = r.class_fqn AND z.explicit_path IS NOT DISTINCT FROM r.explicit_path
    LEFT JOIN methods m ON m.path = z.path GROUP BY ALL)""",
    select="""SELECT CAST(sum(n) AS BIGINT) AS total_traces, CAST(sum(n) FILTER (path IS NOT NULL AND (method IS NULL OR coalesce(hit, false))) AS BIGINT) AS successful_traces FROM found""",
)
def trace_totals(spark, sf_dir):
    # each distinct line once, with its count
    return traces.trace_totals(traces.resolve_traces(_lines(spark, sf_dir), _catalog(spark, sf_dir), _index(spark, sf_dir)), "n")


def _now():
    return F.lit(NOW).cast("timestamp")


NEWEST = """
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY timestamp DESC) AS rank FROM results) WHERE rank = 1)"""
VALID = f"timestamp >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY"
_TIMES = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, strftime(last_accessed, '%Y-%m-%d %H:%M:%S') AS last_accessed"


def _shown(df):
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("timestamp", "last_accessed")}
    return df.withColumns(times)


@query(RESULTS, NEWEST, select=f"SELECT key, data, {_TIMES}, access_count, entry_type FROM newest")
def result_newest(spark, sf_dir):
    return _shown(results.newest_per_key(inputs.results(spark, sf_dir)))


@query(
    RESULTS,
    NEWEST,
    select=f"SELECT key, data, {_TIMES}, access_count, entry_type FROM newest r WHERE {VALID} ORDER BY r.last_accessed DESC, key LIMIT 1000",
)
def result_retention(spark, sf_dir):
    newest = results.newest_per_key(inputs.results(spark, sf_dir))
    return _shown(results.retain(newest, _now()))


@query(
    RESULTS,
    select=f"""SELECT count(*) AS total_entries, count(*) FILTER (entry_type = 'extracted_code') AS extracted_code_entries,
  count(*) FILTER (entry_type = 'analysis_result') AS analysis_result_entries, CAST(sum(access_count) AS BIGINT) AS total_access_count,
  CAST(printf('%.2f', avg((epoch_us(TIMESTAMP '{NOW}') - epoch_us(timestamp)) / 3.6e9)) AS DOUBLE) AS average_age_hours FROM results""",
)
def result_stats(spark, sf_dir):
    return results.statistics(inputs.results(spark, sf_dir), _now())


@query(
    RESULTS,
    """
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY timestamp DESC) AS rank FROM results
  WHERE CAST(data AS BIGINT) % 2 = 0 OR CAST(data AS BIGINT) % 7 = 0) WHERE rank = 1)""",
    select=f"SELECT key, data, {_TIMES}, access_count, entry_type FROM newest WHERE {VALID}",
)
def result_upkeep(spark, sf_dir):
    """A stored result table after two rounds of new rows."""
    folder = f"{shared_folder(spark)}/rundiff-results-{uuid.uuid4().hex}"
    new, number = inputs.results(spark, sf_dir), F.col("data").cast("long")
    results.upkeep(folder, new.where(number % 2 == 0), _now())
    results.upkeep(folder, new.where((number % 7 == 0) & (number % 2 == 1)), _now())
    return _shown(results.stored_results(spark, folder, _now()))


# Asked for: every user's purchase and a kind of result that is never stored.
ASKED = """
asked AS (SELECT DISTINCT substr(sha256('repo::com.app.U' || user_id || '::' || k), 1, 16) AS key FROM events, (SELECT unnest(['purchase', 'refund']) AS k))"""


def _asked(spark, sf_dir):
    users = inputs.table(spark, sf_dir, "events").select("user_id").distinct()
    kinds = users.selectExpr("concat('com.app.U', user_id) AS cls", "explode(array('purchase', 'refund')) AS kind")
    return kinds.select(results.result_key(F.lit("repo"), F.col("cls"), F.col("kind")).alias("key"))


@query(RESULTS, NEWEST, ASKED, select=f"SELECT key FROM asked WHERE key NOT IN (SELECT key FROM newest WHERE {VALID})")
def result_todo(spark, sf_dir):
    stored = results.newest_per_key(inputs.results(spark, sf_dir))
    return results.missing_inputs(_asked(spark, sf_dir), stored, _now())


@query(
    RESULTS,
    NEWEST,
    ASKED,
    select=f"SELECT key, data, access_count + 1 AS access_count, entry_type FROM newest JOIN asked USING (key) WHERE {VALID}",
)
def result_reused(spark, sf_dir):
    stored = results.newest_per_key(inputs.results(spark, sf_dir))
    return results.reused_results(_asked(spark, sf_dir), stored, _now()).select(
        "key", "data", "access_count", "entry_type"
    )


@query(
    TRACE_LINES,
    LINES,
    REFERENCE,
    SOURCES,
    RESOLVED,
    METHODS,
    ANSWERS,
    select="""SELECT line, n, reason, CASE reason WHEN 'file_not_found' THEN 'Verify class name spelling|Check repository path|Provide explicit file path|Check if file exists in repository'
    WHEN 'method_not_found' THEN 'Check method name spelling|Choose from available methods|Verify the method exists in this class' END AS suggestions,
  CASE WHEN reason = 'file_not_found' THEN CASE WHEN a.explicit_path IS NOT NULL THEN a.explicit_path
    ELSE list_aggregate(list_transform(['', 'src/main/java/', 'src/test/java/', 'src/java/', 'src/', 'test/java/', 'tests/src/'], lambda d: d || translate(split_part(class_fqn, '$', 1), '.', '/') || '.java'), 'string_agg', '|') END END AS searched,
  CASE WHEN reason = 'method_not_found' THEN (SELECT string_agg(name, ',' ORDER BY start_line) FROM methods m WHERE m.path = a.path) END AS choices
FROM (SELECT DISTINCT a.*, r.explicit_path FROM answers a JOIN reference r USING (line)) a WHERE reason IS NOT NULL""",
)
def trace_failures(spark, sf_dir):
    """Lines without an answer, with what was tried and what to choose from; a third of the classes have no file."""
    lines, index = _lines(spark, sf_dir), _index(spark, sf_dir)
    lost = traces.resolve_traces(lines, _catalog(spark, sf_dir), index).where("reason is not null")
    choices = traces.available_methods(lost, index).where("piece_no = 0").select("path", F.array_join("name", ",").alias("choices"))
    missed = F.when(F.col("reason") == "method_not_found", F.col("choices"))
    return look_up(lost, choices, ["path"]).select(
        "line", "n", "reason", F.array_join("suggestions", "|").alias("suggestions"), F.array_join("searched_paths", "|").alias("searched"), missed.alias("choices")
    )


@query(
    TRACE_LINES,
    LINES,
    REFERENCE,
    SOURCES,
    RESOLVED,
    METHODS,
    ANSWERS,
    select="""SELECT CASE WHEN reason IS NULL THEN 'success' ELSE 'failure' END AS status, reason, extraction_type, a.explicit_path IS NOT NULL AS provided,
  count(*) AS traces, count(DISTINCT class_fqn) AS classes, count(a.method) AS methods
FROM (SELECT DISTINCT a.*, r.explicit_path FROM answers a JOIN reference r USING (line)) a GROUP BY 1, 2, 3, 4""",
)
def trace_export(spark, sf_dir):
    """Resolved lines written as nested JSON and read back."""
    folder = f"{shared_folder(spark)}/rundiff-traces-{uuid.uuid4().hex}"
    traces.export_traces(traces.resolve_traces(_lines(spark, sf_dir), _catalog(spark, sf_dir), _index(spark, sf_dir)), folder)
    schema = """stack_trace_info struct<class_fqn: string, method: string, file_path_provided: boolean, explicit_path: string>,
      analysis_result struct<status: string, reason: string, extraction_type: string>, exported_at timestamp"""
    read = spark.read.schema(schema).json(folder)
    keys = [F.col(f"analysis_result.{c}").alias(c) for c in ("status", "reason", "extraction_type")]
    return read.groupBy(*keys, F.col("stack_trace_info.file_path_provided").alias("provided")).agg(
        F.count("exported_at").alias("traces"), F.countDistinct("stack_trace_info.class_fqn").alias("classes"), F.count("stack_trace_info.method").alias("methods")
    )


@query(
    SOURCES,
    METHODS,
    DEPS,
    select="""SELECT d.path, d.name AS caller, d.start_line AS caller_line, dependency AS callee, m.start_line AS callee_line, m.end_line AS callee_end_line
FROM deps d JOIN methods m ON m.path = d.path AND m.name = dependency JOIN methods c ON c.path = d.path AND c.name = d.name AND c.start_line = d.start_line
JOIN (SELECT path, count(*) AS n FROM source_lines GROUP BY path) s ON s.path = d.path WHERE n <= 14 OR m.start_line BETWEEN c.start_line AND c.end_line""",
)
def near_calls(spark, sf_dir):
    deps, index = _deps(spark, sf_dir)
    sizes = methods.file_sizes(inputs.sources(spark, sf_dir))
    near = methods.near_edges(methods.call_edges(deps, index, first=True), index, sizes, large_file_lines=14, near_lines=0)
    return near.select("path", "caller", "caller_line", "callee", "callee_line", "callee_end_line")
