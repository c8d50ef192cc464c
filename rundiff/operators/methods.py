"""Method index over source lines ``path, line_no, text`` (``line_no`` from 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rundiff.functions.text import strip
from rundiff.operators.lookup import look_up as look_up_rows
from rundiff.operators.lookup import merge_join
from rundiff.operators.ordered import BLOCK_ROWS, Running, list_pieces, running
from rundiff.operators.statements import long_statements
from rundiff.session import cut_lineage

# The declaration pattern. Groups: return type, name, parameters.
METHOD_PATTERN = (
    r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|strictfp|\s)+)?\s*"
    r"(?:<[^>]+>\s+)?([a-zA-Z_][\w<>\[\],\s]*?)\s+([a-zA-Z_]\w*)\s*\(([^)]*)\)\s*(?:throws\s+[^{;]+)?\s*[{;]"
)
MODIFIERS = ["public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "strictfp"]
NOT_METHOD_NAMES = ["if", "for", "while", "switch", "catch", "return", "new"]
NOT_DEPENDENCIES = ["if", "for", "while", "try", "catch", "return", "new", "super", "this"]
CALL_PATTERNS = [
    r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
    r"\bthis\.([a-zA-Z_][a-zA-Z0-9_]*)",
    r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*[=;]",
]
FIELD_PATTERN = r"^\s*(private|protected|public)?\s+.*\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[=;].*$"
# What every such line holds: the pattern itself goes back and forth over other lines, at the cube of their indent.
FIELD_PART = r"\s[a-zA-Z_][a-zA-Z0-9_]*+\s*+[=;]"

# Limits for large files, where a caller asks for them, and for signatures in lists.
LARGE_FILE_LINES = 1000
NEAR_LINES = 50
SIGNATURE_CHARS = 100

PIECE_ROWS = 10_000
GRAM = 3  # characters of the runs that names are listed under
SPAN = 4096


def source_lines(files: DataFrame, content: str = "content", keys: Sequence[str] = ("path",)) -> DataFrame:
    """One row per line of whole-file texts, numbered from 1."""
    lines = F.posexplode(F.split(F.col(content), "\n")).alias("_i", "text")
    return files.select(*keys, lines).select(*keys, (F.col("_i") + 1).cast("long").alias("line_no"), "text")


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.translate(c, char, ""))


_DECLARED = ["name", "return_type", "parameters", "modifiers", "signature"]


def _declared_parts(squeezed: Column, text: Column) -> dict[str, Column]:
    """Name and other parts of the method that a squeezed text declares; the name is NULL where it declares none."""
    name = F.regexp_extract(squeezed, METHOD_PATTERN, 2)  # empty where the pattern does not match
    parameters = F.transform(F.split(F.regexp_extract(squeezed, METHOD_PATTERN, 3), ","), lambda p: F.trim(p))
    spaced = F.concat(F.lit(" "), text, F.lit(" "))
    modifiers = [F.when(F.contains(spaced, F.lit(f" {m} ")) | squeezed.startswith(m), F.lit(m)) for m in MODIFIERS]
    return {
        "name": F.when(~name.isin("", *NOT_METHOD_NAMES), name),
        "return_type": F.trim(F.regexp_extract(squeezed, METHOD_PATTERN, 1)),
        "parameters": F.filter(parameters, lambda p: p != ""),
        "modifiers": F.array_compact(F.array(*modifiers)),
        "signature": strip(text),
    }


def with_declarations(lines: DataFrame) -> DataFrame:
    """Add the parts of the method each line declares; all NULL on other lines.

    A line that calls ``name(…);`` after a word such as ``return`` looks like a
    declaration to the pattern and is taken for one. Whitespace is squeezed first, which
    keeps the pattern linear on long indents. Declarations over several lines are found
    by ``long_declarations``.
    """
    text = F.col("text")
    candidate = F.contains(text, F.lit("(")) & (F.contains(text, F.lit("{")) | F.contains(text, F.lit(";")))
    squeezed = F.when(candidate, F.regexp_replace(strip(text), r"\s+", " "))
    parts = _declared_parts(F.col("_s"), text)
    found = lines.withColumn("_s", squeezed).withColumn("name", parts.pop("name"))
    declared = F.col("name").isNotNull()
    return found.withColumns({c: F.when(declared, part) for c, part in parts.items()}).drop("_s")


def long_declarations(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Declarations that go on over several lines: ``path, start_line, last_line`` and the parts.

    ``last_line`` is the line with the ``{`` or ``;``; the signature is the whole declaration, squeezed, without
    comments and annotations.
    """
    found = long_statements(lines, block_rows).where(F.contains("statement", F.lit("(")))
    parts = _declared_parts(F.col("statement"), F.col("statement"))
    named = found.withColumn("name", parts.pop("name")).where("name is not null")
    return named.select("path", "start_line", "last_line", "name", *[part.alias(c) for c, part in parts.items()])


def declarations(lines: DataFrame) -> DataFrame:
    """The lines that declare a method: ``path, start_line`` and the parts."""
    found = with_declarations(lines).where("name is not null")
    return found.select("path", F.col("line_no").alias("start_line"), *_DECLARED)


def method_index(lines: DataFrame, block_rows: int = BLOCK_ROWS, reuse: bool = False, long: bool = False) -> DataFrame:
    """Declarations with their last line, found by brace balance.

    With ``long``, declarations over several lines are found too. Without, one has to end
    on its line, which spares two passes over the lines.

    A method ends on the first line, at or after the one with its opening brace, where
    the balance is back to what it was before the declaration. Such a line either is the
    one with the brace or crosses that depth downwards, so each crossing is listed once
    per depth and a reverse running minimum per (path, depth) finds the end of every
    method: no join of methods with the lines below them. Braces in strings and comments
    count. A declaration that ends in ``;`` ends there. An unclosed one ends with
    the file and has ``closed`` false.

    The declarations and brace lines, without other text, are written once to the
    checkpoint folder, as several branches read them. ``reuse`` writes the index itself
    too, for callers that join it more than once.
    """
    text = F.col("text")
    net = (_count(text, "{") - _count(text, "}")).cast("long")
    has_open = F.contains(text, F.lit("{"))
    specs = [
        Running("_balance", "sum", F.col("_net")),
        Running("_open", "min", F.when(has_open, F.col("line_no")), reverse=True),
        Running("_last", "max", F.col("line_no"), reverse=True),
    ]
    balanced = running(lines.withColumn("_net", net), ["path"], "line_no", specs, block_rows)
    declared = with_declarations(balanced).withColumn("_decl", F.col("line_no"))
    if long:
        more = long_declarations(lines, block_rows).select(
            F.col("path").alias("_lp"), F.col("start_line").alias("_ll"), F.col("last_line"), *[F.col(c).alias(f"_l{c}") for c in _DECLARED]
        )
        joined = merge_join(declared, more, (F.col("path") == F.col("_lp")) & (F.col("line_no") == F.col("_ll")), "left")
        own = F.col("name").isNotNull()
        parts = {c: F.when(own, F.col(c)).otherwise(F.col(f"_l{c}")) for c in _DECLARED}
        declared = joined.withColumns({"_decl": F.when(own, F.col("_decl")).otherwise(F.coalesce("last_line", "_decl")), **parts})
    kept = declared.where(F.col("name").isNotNull() | has_open | (F.col("_net") < 0))
    columns = ["path", "line_no", "_balance", "_net", "_open", "_last", "_decl", *_DECLARED, has_open.alias("_has_open")]
    marked = cut_lineage(kept.select(*columns))
    found = marked.where("name is not null").withColumnRenamed("line_no", "start_line")

    found = found.withColumn("_depth", F.col("_balance") - F.col("_net"))
    at_open = marked.where("_has_open").select(F.col("path").alias("_bp"), F.col("line_no").alias("_bl"), F.col("_balance").alias("_after"))
    found = merge_join(found, at_open, (F.col("path") == F.col("_bp")) & (F.col("_open") == F.col("_bl")), "left")
    one_line = F.col("signature").endswith(";")
    immediate = F.coalesce(F.col("_after") <= F.col("_depth"), F.lit(False))
    none = F.lit(None).cast("long")
    queries = found.where(~one_line & ~immediate).select(
        "path", F.col("_depth").alias("depth"), F.col("_open").alias("at"), none.alias("crossing")
    )
    down = F.sequence(F.col("_balance"), F.col("_balance") - F.col("_net") - 1)
    crossings = marked.where(F.col("_net") < 0).select(
        "path", F.explode(down).alias("depth"), F.col("line_no").alias("at"), F.col("line_no").alias("crossing")
    )
    events = queries.where("at is not null").unionByName(crossings)
    events = events.groupBy("path", "depth", "at").agg(F.max("crossing").alias("crossing"))
    next_down = Running("_end", "min", F.col("crossing"), reverse=True)
    following = running(events, ["path", "depth"], "at", [next_down], block_rows).select(
        F.col("path").alias("_p"), F.col("depth").alias("_d"), F.col("at").alias("_a"), "_end"
    )
    on = (F.col("path") == F.col("_p")) & (F.col("_depth") == F.col("_d")) & (F.col("_open") == F.col("_a"))
    end = F.when(one_line, F.col("_decl")).when(immediate, F.col("_open")).otherwise(F.col("_end"))
    index = merge_join(found, following, on, "left").select(
        "path",
        "name",
        "return_type",
        "parameters",
        "modifiers",
        "start_line",
        F.coalesce(end, F.col("_last")).alias("end_line"),
        end.isNotNull().alias("closed"),
        "signature",
    )
    return cut_lineage(index) if reuse else index


def unique_methods(methods: DataFrame) -> DataFrame:
    """One row per (path, name, line)."""
    return methods.dropDuplicates(["path", "name", "start_line"])


def method_lines(methods: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per method and line of its body, also for nested methods.

    The line range is exploded in two steps of bounded arrays and joined by equality.
    """
    spans = F.sequence(F.floor(F.col("start_line") / SPAN), F.floor(F.col("end_line") / SPAN))
    span = methods.select("path", "name", "start_line", "end_line", F.explode(spans).alias("_span"))
    low = F.greatest(F.col("start_line"), F.col("_span") * SPAN)
    high = F.least(F.col("end_line"), F.col("_span") * SPAN + SPAN - 1)
    numbered = span.select("path", "name", "start_line", F.explode(F.sequence(low, high)).alias("line_no"))
    return merge_join(numbered, lines.select("path", "line_no", "text"), ["path", "line_no"])


def method_bodies(body_lines: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Body text per method, in pieces of at most ``piece_rows`` lines."""
    pieces = list_pieces(body_lines, ["path", "name", "start_line"], "line_no", ["text"], piece_rows)
    return pieces.withColumn("body", F.array_join("text", "\n")).drop("text")


def method_lists(methods: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Methods per file in line order: names, lines, signatures whole and shortened, in pieces.

    Several declarations on one line cannot occur, so the line orders the list.
    """
    shown = methods.withColumns(
        {"full_signature": F.col("signature"), "signature": short_signature(F.col("signature"))}
    )
    listed = ["name", "line", "signature", "full_signature"]
    pieces = list_pieces(shown.withColumnRenamed("start_line", "line"), ["path"], "line", listed, piece_rows)
    return pieces.withColumn("method_count", F.size("name"))


def short_signature(signature: Column) -> Column:
    """A signature cut for lists."""
    cut = F.concat(F.substring(signature, 1, SIGNATURE_CHARS), F.lit("..."))
    return F.when(F.length(signature) > SIGNATURE_CHARS, cut).otherwise(signature)


def _grams(text: Column, size: Column | int) -> Column:
    """The distinct runs of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def _names_with_part(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``path, _part, _lower``: the names of a file that contain a part asked for there.

    Every name is listed once under each of its runs of ``GRAM`` characters, in files where something is asked. A
    part is looked up under the one of its runs that the fewest names of the file have, and what is found there is
    compared in full. Parts shorter than a run are listed under their own length, in files that ask for such.
    """
    size = F.least(F.length("_part"), F.lit(GRAM))
    sized = asked.withColumn("_size", size)
    held = merge_join(names, sized.select("path", "_size").distinct(), "path").where(F.length("_lower") >= F.col("_size"))
    postings = cut_lineage(held.select("path", "_lower", "_size", F.explode(_grams(F.col("_lower"), F.col("_size"))).alias("_gram")))
    counts = postings.groupBy("path", "_size", "_gram").agg(F.count("*").alias("_names"))
    wanted = sized.select("path", "_part", "_size", F.explode(_grams(F.col("_part"), F.col("_size"))).alias("_gram"))
    rarest = merge_join(wanted, counts, ["path", "_size", "_gram"], "left").groupBy("path", "_part", "_size").agg(
        F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r")
    )
    keyed = rarest.where("_r.n > 0").select("path", "_part", "_size", F.col("_r.gram").alias("_gram"))
    return merge_join(postings, keyed, ["path", "_size", "_gram"]).where(F.contains("_lower", F.col("_part"))).select("path", "_part", "_lower")


def find_methods(requests: DataFrame, methods: DataFrame) -> DataFrame:
    """Method of each (path, method) request: exact name, any case, then part of a name.

    Adds ``match`` (``exact``, ``case_insensitive``, ``contains`` or NULL), ``found`` (the
    first such method by line) and ``overloads`` (methods of exactly that name). Each
    level joins one row per key. Parts of names are looked up by their rarest gram.
    """
    wanted = requests.select("path", "method").where("path is not null and method is not null").distinct()
    # named _m so that the name column can serve as a key
    entry = F.struct(F.col("start_line").alias("line"), "name", "end_line", "signature").alias("_m")

    def first(df: DataFrame, key: Column, out: str) -> DataFrame:
        listed = df.select("path", key.alias("_key"), entry)
        return listed.groupBy("path", "_key").agg(F.min("_m").alias(out), F.count("*").alias(f"{out}_n"))

    def look_up(df: DataFrame, index: DataFrame, key: Column) -> DataFrame:
        return merge_join(df.withColumn("_key", key), index, ["path", "_key"], "left").drop("_key")

    lower = F.lower("method")
    exact = look_up(wanted, first(methods, F.col("name"), "_exact"), F.col("method"))
    cased = look_up(exact, first(methods, F.lower("name"), "_ci"), lower)

    asked = cut_lineage(cased.where(F.col("_ci").isNull()).select("path", lower.alias("_part")).distinct())
    candidates = _names_with_part(asked, methods.select("path", F.lower("name").alias("_lower")).distinct())
    listed = merge_join(methods.withColumn("_lower", F.lower("name")), candidates, ["path", "_lower"])
    found = look_up(cased, first(listed, F.col("_part"), "_part"), lower)

    best = F.coalesce("_exact", "_ci", "_part")
    matched = found.select(
        "path",
        "method",
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_ci").isNotNull(), "case_insensitive")
        .when(F.col("_part").isNotNull(), "contains")
        .alias("match"),
        best.alias("found"),
        F.coalesce("_exact_n", F.lit(0)).alias("overloads"),
    )
    return look_up_rows(requests, matched, ["path", "method"])


def overloads(requests: DataFrame, methods: DataFrame) -> DataFrame:
    """All methods of exactly the requested name, the first by line being the default."""
    named = methods.withColumnRenamed("name", "method")
    wanted = requests.select("path", "method").distinct()
    first = named.groupBy("path", "method").agg(F.min("start_line").alias("_first"))
    return (
        merge_join(merge_join(named, wanted, ["path", "method"], "left_semi"), first, ["path", "method"])
        .withColumn("is_default", F.col("start_line") == F.col("_first"))
        .drop("_first")
    )


def dependencies(body_lines: DataFrame) -> DataFrame:
    """Distinct words a method calls, assigns or refers to by ``this.``, minus keywords."""
    words = [F.regexp_extract_all("text", F.lit(p), 1) for p in CALL_PATTERNS]
    kept = F.array_except(F.flatten(F.array(*words)), F.array(*[F.lit(k) for k in NOT_DEPENDENCIES]))
    return body_lines.select("path", "name", "start_line", F.explode(kept).alias("dependency")).distinct()


def call_edges(deps: DataFrame, methods: DataFrame, first: bool = False) -> DataFrame:
    """Dependencies that are methods of the same file: caller, callee and callee lines.

    A name that several methods of the file have gives an edge to each of them; a method that is listed twice counts
    once. With ``first``, the callee is the first method of that name, so the join adds no rows.
    """
    callee = F.struct(F.col("start_line").alias("line"), F.col("end_line").alias("end"))
    named = methods.select("path", F.col("name").alias("dependency"), F.col("start_line").alias("_line"), callee.alias("_c"))
    keys = ["path", "dependency"] if first else ["path", "dependency", "_line"]
    defined = named.groupBy(*keys).agg(F.min("_c").alias("_c"))
    return merge_join(deps, defined, ["path", "dependency"]).select(
        "path",
        F.col("name").alias("caller"),
        F.col("start_line").alias("caller_line"),
        F.col("dependency").alias("callee"),
        F.col("_c.line").alias("callee_line"),
        F.col("_c.end").alias("callee_end_line"),
    )


def near_edges(
    edges: DataFrame,
    methods: DataFrame,
    file_sizes: DataFrame,
    large_file_lines: int = LARGE_FILE_LINES,
    near_lines: int = NEAR_LINES,
) -> DataFrame:
    """Edges to nearby callees only, in files of more than ``large_file_lines`` lines.

    Contexts keep all edges; this is for a caller that wants short ones.
    """
    ends = methods.select("path", F.col("name").alias("caller"), F.col("start_line").alias("caller_line"), "end_line")
    sized = merge_join(edges, ends.dropDuplicates(["path", "caller", "caller_line"]), ["path", "caller", "caller_line"])
    sized = merge_join(sized, file_sizes, "path")
    near = (F.col("callee_line") >= F.col("caller_line") - near_lines) & (
        F.col("callee_line") <= F.col("end_line") + near_lines
    )
    return sized.where((F.col("line_count") <= large_file_lines) | near).drop("line_count", "end_line")


def file_sizes(lines: DataFrame) -> DataFrame:
    """Number of lines per file."""
    return lines.groupBy("path").agg(F.count("*").alias("line_count"))


def imports(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Import and package lines before the first line of code."""
    line = strip(F.col("text"))
    wanted = line.startswith("import ") | line.startswith("package ")
    skipped = (line == "") | line.startswith("//") | line.startswith("/*")
    code = ~wanted & ~skipped & ~line.startswith("import") & ~line.startswith("package")
    seen = running(lines, ["path"], "line_no", [Running("_code", "max", code)], block_rows)
    return seen.where(~F.col("_code") & wanted).select("path", "line_no", line.alias("text"))


def class_declarations(lines: DataFrame) -> DataFrame:
    """First line that declares the class a file is named after, without its brace.

    A file without one gets ``public class <name>``.
    """
    stem = F.regexp_extract("path", r"([^/]*)\.java$", 1)
    line = strip(F.col("text"))
    # (?i).*class\s+Name.*\{ as plain text tests on squeezed lower-case text
    squeezed = F.regexp_replace(F.lower(line), r"class\s+", "class ")
    needle = F.concat(F.lit("class "), F.lower(stem))
    at = F.instr(squeezed, needle)
    declares = (at > 0) & (F.instr(F.substring(squeezed, at, F.length(squeezed)), "{") > 0)
    found = F.min(F.when(declares, F.struct("line_no", strip(F.translate(line, "{", "")).alias("text"))))
    return lines.groupBy("path").agg(found.alias("_d")).select(
        "path",
        F.col("_d.line_no").alias("line_no"),
        F.coalesce("_d.text", F.concat(F.lit("public class "), stem)).alias("declaration"),
    )


def class_fields(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Field lines between the first class line and the first public method after it."""
    line = strip(F.col("text"))
    class_line = F.contains(line, F.lit("class ")) & F.contains(line, F.lit("{"))
    field_like = F.col("text").rlike(FIELD_PART) & F.col("text").rlike(FIELD_PATTERN)
    flagged = (
        lines.withColumn("_class", class_line)
        .withColumn("_field", ~class_line & field_like & ~line.startswith("//"))
        .withColumn("_method", ~class_line & line.startswith("public ") & F.contains(line, F.lit("(")))
    )
    inside = running(flagged, ["path"], "line_no", [Running("_in", "max", F.col("_class"))], block_rows)
    inside = inside.where("_in")
    stops = F.col("_method") & ~F.col("_field")
    open_ = running(inside, ["path"], "line_no", [Running("_stop", "max", stops)], block_rows)
    return open_.where(F.col("_field") & ~F.col("_stop")).select("path", "line_no", line.alias("text"))
