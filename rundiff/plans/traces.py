"""Trace lines to methods: parse, find the file, find the method, and say why not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rundiff.operators import frames, methods, resolve
from rundiff.operators.lookup import look_up, merge_join
from rundiff.operators.ordered import list_pieces
from rundiff.session import cut_lineage

# Advice per failure reason.
SUGGESTIONS = {
    "parsing_failed": ["Check input format", "Verify repository path exists", "Try explicit file path"],
    "file_not_found": [
        "Verify class name spelling",
        "Check repository path",
        "Provide explicit file path",
        "Check if file exists in repository",
    ],
    "method_not_found": [
        "Check method name spelling",
        "Choose from available methods",
        "Verify the method exists in this class",
    ],
}
# Code size above which a context is split, in characters.
MAX_CONTEXT_CHARS = 4000 * 4


def _suggestions(reason: Column) -> Column:
    texts = F
    for name, advice in SUGGESTIONS.items():
        texts = texts.when(reason == name, F.array(*[F.lit(t) for t in advice]))
    return texts


def resolve_traces(
    lines: DataFrame,
    catalog: DataFrame,
    method_index: DataFrame,
    grammar: str = "reference",
    root: str = "",
    fall_back: bool = False,
) -> DataFrame:
    """Every trace line with its file, method, status and reason.

    Distinct lines are parsed, distinct frames resolved and distinct (file, method) pairs
    looked up, and the results joined back, so a line that is a third of the input is
    worked on once. ``fall_back`` reads a line that the grammar does not know with the
    path grammar.
    """
    if grammar not in ("reference", "tokens"):
        raise ValueError("grammar must be reference or tokens")
    parsed = frames.parse_lines(lines.select("line").distinct(), grammar)
    frame = F.col("frame")
    if fall_back:
        other = frames.parse_lines(lines.select("line").distinct(), "path").select("line", F.col("frame").alias("_o"))
        package = F.nullif(F.translate(F.col("_o.package_path"), "/", "."), F.lit(""))
        from_path = F.struct(
            F.concat_ws(".", package, "_o.class_name").alias("class_fqn"),
            F.col("_o.method").alias("method"),
            F.lit(False).alias("file_path_provided"),
            F.lit(None).cast("string").alias("explicit_path"),
            F.col("_o.parse_type").alias("pattern"),
        )
        usable = (frame["pattern"] == "fallback") & F.col("_o").isNotNull()
        parsed = merge_join(parsed, other, "line", "left").withColumn("frame", F.when(usable, from_path).otherwise(frame))
    flat = cut_lineage(
        parsed.select(
            "line",
            "parsed",
            frame["class_fqn"].alias("class_fqn"),
            frame["method"].alias("method"),
            frame["explicit_path"].alias("explicit_path"),
            frame["pattern"].alias("pattern"),
        )
    )
    distinct = flat.where("parsed").select("class_fqn", "method", "explicit_path").distinct()
    files = resolve.resolve_frames(distinct, catalog, root).withColumnsRenamed(
        {"class_fqn": "_c", "explicit_path": "_e"}
    )
    same_frame = (F.col("class_fqn") == F.col("_c")) & F.col("explicit_path").eqNullSafe(F.col("_e"))
    # the distinct frames with their files are few; the look-up reads them several times
    located = cut_lineage(merge_join(distinct, files, same_frame).drop("_c", "_e"))
    found = methods.find_methods(located, method_index)
    per_file = method_index.groupBy("path").agg(F.count("*").alias("method_count"))
    answers = look_up(found, per_file, ["path"]).select(
        F.col("class_fqn").alias("_c"),
        F.col("method").alias("_m"),
        F.col("explicit_path").alias("_e"),
        *["path", "strategy", "candidate_count", "match", "overloads"],
        F.col("found.name").alias("found_method"),
        F.col("found.line").alias("start_line"),
        F.col("found.end_line").alias("end_line"),
        F.col("found.signature").alias("signature"),
        F.coalesce("method_count", F.lit(0)).alias("method_count"),
    )
    same = (
        (F.col("class_fqn") == F.col("_c"))
        & F.col("method").eqNullSafe(F.col("_m"))
        & F.col("explicit_path").eqNullSafe(F.col("_e"))
    )
    per_line = merge_join(flat, answers, same, "left").drop("_c", "_m", "_e")
    missed = F.col("method").isNotNull() & F.col("match").isNull()
    reason = (
        F.when(~F.col("parsed"), "parsing_failed")
        .when(F.col("path").isNull(), "file_not_found")
        .when(missed, "method_not_found")
    )
    kind = (
        F.when(F.col("path").isNull(), "error")
        .when(F.col("match").isNotNull(), "specific_method")
        .when(F.col("method_count") > 0, "all_methods")
        .otherwise("full_file")
    )
    per_line = (
        per_line.withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason").isNull(), "success").otherwise("failure"))
        .withColumn("extraction_type", kind)
    )
    tried = resolve.searched_paths(F.col("class_fqn"), F.col("explicit_path"))
    return (
        merge_join(lines, per_line, "line", "left")
        .withColumn("reason", F.when(F.col("line").isNull(), "parsing_failed").otherwise(F.col("reason")))
        .fillna({"status": "failure", "extraction_type": "error", "parsed": False})
        .withColumn("display_path", resolve.display_path(F.col("path")))
        .withColumn("suggestions", _suggestions(F.col("reason")))
        .withColumn("searched_paths", F.when(F.col("reason") == "file_not_found", tried))
    )


def trace_totals(resolved: DataFrame, times: str | None = None) -> DataFrame:
    """Lines and successes. ``times`` names a column that says how often a line occurs, for distinct lines."""
    n = F.lit(1) if times is None else F.col(times)
    succeeded = F.when(F.col("status") == "success", n).otherwise(0)
    total, good = (F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in (n, succeeded))
    return resolved.agg(total.alias("total_traces"), good.alias("successful_traces"))


def export_traces(resolved: DataFrame, folder: str) -> None:
    """Write the resolved lines as JSON with the parsed frame nested."""
    nested = resolved.select(
        F.struct(
            "class_fqn",
            "method",
            F.col("explicit_path").isNotNull().alias("file_path_provided"),
            "explicit_path",
        ).alias("stack_trace_info"),
        F.struct(
            "status",
            "reason",
            "extraction_type",
            "display_path",
            F.concat_ws("-", "start_line", "end_line").alias("method_lines"),
            F.col("signature").alias("method_signature"),
        ).alias("analysis_result"),
        F.current_timestamp().alias("exported_at"),
    )
    nested.write.mode("overwrite").json(folder)


@dataclass(frozen=True)
class CodeContext:
    """Code around methods, by reference: bodies are named, not copied.

    ``shared``: path, part, line_no, text of imports (0), class (1) and fields (2), once per file. ``bodies``: path, name,
    start_line, body, lines, chars; equal bodies have the same ``body``. ``texts``: body, offset, text, one copy of
    each. ``edges``: path, name, start_line of a method, and part, body_name, part_line of a body in its context: its
    own (3) and those of the methods of its file that it uses (4).
    """

    shared: DataFrame
    bodies: DataFrame
    texts: DataFrame
    edges: DataFrame


_METHOD = ["path", "name", "start_line"]


def context_references(targets: DataFrame, method_index: DataFrame, lines: DataFrame) -> CodeContext:
    """The code around each target method ``path, name, start_line``; rows are linear in lines and calls.

    A body is told by its number of lines and two 64-bit hashes of its lines with their places.
    """
    wanted = targets.select(*_METHOD).distinct()
    # read by several branches, so the lines of the files that matter are written once
    own = cut_lineage(merge_join(lines, wanted.select("path").distinct(), "path", "left_semi"))
    classes = methods.class_declarations(own).select(
        "path", F.coalesce("line_no", F.lit(0)).alias("line_no"), F.col("declaration").alias("text")
    )
    shared = (
        methods.imports(own).withColumn("part", F.lit(0))
        .unionByName(classes.withColumn("part", F.lit(1)))
        .unionByName(methods.class_fields(own).withColumn("part", F.lit(2)))
    )
    index = merge_join(method_index, wanted.select("path").distinct(), "path", "left_semi")
    body_lines = cut_lineage(methods.method_lines(index, own).withColumn("offset", F.col("line_no") - F.col("start_line")))
    hashes = [F.hex(F.bit_xor(F.xxhash64(F.lit(seed), "offset", "text"))) for seed in (1, 2)]
    bodies = cut_lineage(
        body_lines.groupBy(*_METHOD).agg(
            F.concat_ws(":", F.count("*"), *hashes).alias("body"), F.count("*").alias("lines"), F.sum(F.length("text") + 1).alias("chars")
        )
    )
    first = bodies.groupBy("body").agg(F.min(F.struct(*_METHOD)).alias("_first")).select("body", "_first.*")
    texts = merge_join(body_lines, first, _METHOD).select("body", "offset", "text")
    calling = merge_join(body_lines, wanted, _METHOD, "left_semi").select(*_METHOD, "text")
    used = methods.call_edges(methods.dependencies(calling), index, first=True)
    calls = used.select(
        "path", F.col("caller").alias("name"), F.col("caller_line").alias("start_line"), F.lit(4).alias("part"), F.col("callee").alias("body_name"), F.col("callee_line").alias("part_line")
    )
    selves = wanted.select(*_METHOD, F.lit(3).alias("part"), F.col("name").alias("body_name"), F.col("start_line").alias("part_line"))
    return CodeContext(shared.select("path", "part", "line_no", "text"), bodies, texts, cut_lineage(selves.unionByName(calls)))


def _with_bodies(context: CodeContext) -> DataFrame:
    named = context.bodies.select("path", F.col("name").alias("body_name"), F.col("start_line").alias("part_line"), "body", "lines", "chars")
    return merge_join(context.edges, named, ["path", "body_name", "part_line"])


def context_text(context: CodeContext) -> DataFrame:
    """The lines of all contexts: ``path, name, start_line, part, part_line, line_no, text``; bodies are copied here only.

    The shared parts are listed once per file, with NULL ``name`` and ``start_line``.
    """
    columns = [*_METHOD, "part", "part_line", "line_no", "text"]
    none = {"name": F.lit(None).cast("string"), "start_line": F.lit(None).cast("long"), "part_line": F.lit(0).cast("long")}
    copied = _with_bodies(context).join(context.texts, "body").withColumn("line_no", F.col("part_line") + F.col("offset"))
    return context.shared.withColumns(none).select(*columns).unionByName(copied.select(*columns))


def context_lines(targets: DataFrame, method_index: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of code around each target method, in reading order.

    ``targets``: ``path, name, start_line`` of methods. Parts: imports (0), class (1),
    fields (2), the method (3), the methods of its file that it uses (4). The first three
    are the same for all targets of a file and listed once, with NULL ``name`` and
    ``start_line``. Files of any size count whole. Result: ``path, name, start_line, part, part_line, line_no, text``.
    """
    return context_text(context_references(targets, method_index, lines))


def _chunk_totals(context: CodeContext) -> DataFrame:
    """Lines, characters and methods of each chunk, from bodies and shared lines, without copying any."""
    kind = F.when(F.col("part") == 3, 0).otherwise(1).alias("chunk_no")
    own = _with_bodies(context).groupBy(*_METHOD, kind).agg(
        F.sum("lines").alias("lines"), F.sum("chars").alias("char_count"), F.count_distinct("part_line").alias("_members")
    )
    shared = context.shared.where("part <> 1").groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.length("text") + 1).alias("char_count"))
    shared = shared.withColumns({"name": F.lit(None).cast("string"), "start_line": F.lit(None).cast("long"), "chunk_no": F.lit(2), "_members": F.lit(1).cast("long")})
    return own.unionByName(shared)


def context_chunks(context: CodeContext) -> DataFrame:
    """``code_chunks`` of contexts by reference."""
    return _described(_chunk_totals(context))


def context_sizes(context: CodeContext) -> DataFrame:
    """``needs_chunking`` of contexts by reference."""
    own = _with_bodies(context).groupBy(*_METHOD).agg(F.sum("chars").alias("_own"))
    return _sized(own, context.shared)


def code_chunks(context: DataFrame) -> DataFrame:
    """Context by kind of code: the method, the methods it uses, the class of the file.

    ``path, name, start_line, chunk_no, lines, char_count, type, description``; the code
    itself comes from ``code_texts``.
    """
    return _described(
        context.where("part <> 1")
        .withColumn("chunk_no", F.when(F.col("part") == 3, 0).when(F.col("part") == 4, 1).otherwise(2))
        .groupBy("path", "name", "start_line", "chunk_no")
        .agg(
            F.count("*").alias("lines"),
            F.sum(F.length("text") + 1).alias("char_count"),
            F.count_distinct("part_line").alias("_members"),
        )
    )


def _described(counted: DataFrame) -> DataFrame:
    kind = F.col("chunk_no")
    label = F.when(kind == 0, "target_method").when(kind == 1, "dependent_methods").otherwise("class_context")
    description = (
        F.when(kind == 0, F.concat(F.lit("Target method: "), F.col("name")))
        .when(kind == 1, F.concat(F.lit("Dependent methods ("), F.col("_members"), F.lit(" methods)")))
        .otherwise("Class context (imports and fields)")
    )
    return counted.withColumns({"type": label, "description": description}).drop("_members")


def code_texts(context: DataFrame, piece_rows: int = methods.PIECE_ROWS) -> DataFrame:
    """The code of each chunk of ``code_chunks`` in reading order, in pieces of at most ``piece_rows`` lines.

    ``path, name, start_line, chunk_no, piece_no, text``. Shared chunks have NULL ``name`` and ``start_line``.
    """
    chunk = F.when(F.col("part") == 3, 0).when(F.col("part") == 4, 1).otherwise(2)
    # parts in order, then methods by their first line, then lines
    place = F.col("part").cast("long") * F.lit(1 << 58) + F.col("part_line") * F.lit(1 << 29) + F.col("line_no")
    numbered = context.where("part <> 1").select(
        "path", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("start_line", F.lit(-1)).alias("start_line"), chunk.alias("chunk_no"), place.alias("_pos"), "text"
    )
    pieces = list_pieces(numbered, ["path", "name", "start_line", "chunk_no"], "_pos", ["text"], piece_rows)
    return pieces.select(
        "path",
        F.nullif("name", F.lit("")).alias("name"),
        F.nullif("start_line", F.lit(-1)).alias("start_line"),
        "chunk_no",
        "piece_no",
        F.array_join("text", "\n").alias("text"),
    )


def available_methods(resolved: DataFrame, method_index: DataFrame) -> DataFrame:
    """The methods to choose from where a trace names none or one that does not exist: ``path, piece_no, name, line, signature, …``.

    One list per file, in pieces, for the files of the lines that ``resolve_traces`` marks
    ``method_not_found`` or ``all_methods``.
    """
    asked = resolved.where((F.col("reason") == "method_not_found") | (F.col("extraction_type") == "all_methods"))
    return methods.method_lists(merge_join(method_index, asked.select("path").distinct(), "path", "left_semi"))


def candidate_paths(resolved: DataFrame, catalog: DataFrame) -> DataFrame:
    """The files that share the name of a class whose file was not found: ``class_fqn, lower_name, path, depth``."""
    lost = resolved.where("reason = 'file_not_found' AND class_fqn IS NOT NULL").select("class_fqn").distinct()
    files = resolve.candidate_files(lost, catalog)
    name = F.lower(F.concat(F.substring_index(F.substring_index("class_fqn", "$", 1), ".", -1), F.lit(".java")))
    return merge_join(lost.withColumn("lower_name", name), files, "lower_name").select("class_fqn", "lower_name", "path", "depth")


def needs_chunking(context: DataFrame) -> DataFrame:
    """Code size per target, with the shared parts, and whether it exceeds one piece."""
    own = context.where("name is not null").groupBy(*_METHOD).agg(F.sum(F.length("text") + 1).alias("_own"))
    return _sized(own, context.where("name is null"))


def _sized(own: DataFrame, shared_lines: DataFrame) -> DataFrame:
    shared = shared_lines.groupBy("path").agg(F.sum(F.length("text") + 1).alias("_shared"))
    chars = F.col("_own") + F.coalesce("_shared", F.lit(0))
    total = merge_join(own, shared, "path", "left").withColumn("code_chars", chars)
    return total.drop("_own", "_shared").withColumn("chunked", F.col("code_chars") > MAX_CONTEXT_CHARS)
