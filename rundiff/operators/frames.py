"""Stack-trace lines parsed by four grammars, each one an ordered list of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rundiff.functions.text import strip

# Prefixes dropped from a frame line, and directories that hold no package part.
LINE_PREFIXES = ["File: ", "Class: ", "Method: ", "Stack: ", "Error in: ", "Exception at: "]
NON_PACKAGE_DIRS = ["src", "main", "java", "test", "resources", "scala", "kotlin"]
MAX_PACKAGE_DEPTH = 15

# Name shapes shared by the patterns below.
_PACKAGE = r"([a-zA-Z][a-zA-Z0-9_]*(?:\.[a-zA-Z][a-zA-Z0-9_]*)*?)"
_CLASS = r"([A-Z][a-zA-Z0-9_]*?)"
_METHOD = r"([a-zA-Z][a-zA-Z0-9_]*)"

# The plain grammar, first match wins. Groups: package, class, method, file, line.
PLAIN_PATTERNS = {
    "standard": rf"^{_PACKAGE}\.{_CLASS}\.{_METHOD}\(\)$",
    "with_line": rf"^{_PACKAGE}\.{_CLASS}\.{_METHOD}\(([^:]+):(\d+)\)$",
    "at_format": rf"^at\s+{_PACKAGE}\.{_CLASS}\.{_METHOD}\(([^:]+):(\d+)\)$",
    "at_simple": rf"^at\s+{_PACKAGE}\.{_CLASS}\.{_METHOD}\(\)$",
    "file_path_slash": rf"^(?:.*?[/\\])?([a-zA-Z][a-zA-Z0-9_]*(?:[/\\][a-zA-Z][a-zA-Z0-9_]*)*)[/\\]{_CLASS}\.java$",
    "file_path_dot": rf"^(?:.*[/\\])?{_PACKAGE}\.{_CLASS}\.java$",
    "class_only": rf"^(?:{_PACKAGE}\.)?{_CLASS}$",
    "mixed_format": rf"^([a-zA-Z][a-zA-Z0-9_]*(?:[/\\.][a-zA-Z][a-zA-Z0-9_]*)*)[/\\.]{_CLASS}(?:\.java)?$",
}
CLASS_TOKEN = r"([A-Z][a-zA-Z0-9_]*)"

# The reference grammar (class#method, frame, class), first match wins.
EXPLICIT_PATH = r"^.*[/\\].*\.java$"
REFERENCE_PATTERNS = {
    "intellij_format": r"(?U)^([\w.]+\$?[\w$]*)#([\w$][\w$]*)$",
    "stack_frame": r"(?U)^([\w.]+)\.(\w+)\([^)]*\)(?:\s*at\s*.*)?$",
    "class_only": r"(?U)^([\w.]+\$?[\w$]*)$",
}
BRACKET_SUFFIX = r"^(.+)\[.*\]$"

# The token grammar.
TOKEN_HASH = r"^([^#]+)#(.+)$"
TOKEN_FRAME = r"(?U)^(.+)\.(\w+)\([^)]*\)(?:\s*at\s*.*)?$"
TOKEN_IS_CLASS = r"^[A-Z][a-zA-Z0-9_]*(\$[A-Z][a-zA-Z0-9_]*)*$"
TOKEN_IS_METHOD = r"^[a-z][a-zA-Z0-9_]*$|^.*\(\)$"

# The path grammar, first match wins; groups named by the second entry.
PATH_PATTERNS = {
    "hash_format": (r"^([a-zA-Z][a-zA-Z0-9_.]*?)\.([A-Z][a-zA-Z0-9_]*?)#([a-zA-Z_][a-zA-Z0-9_]*)$", "pcm"),
    "traditional_parens": (
        r"^([a-zA-Z][a-zA-Z0-9_.]*?)\.([A-Z][a-zA-Z0-9_]*?)\.([a-zA-Z_][a-zA-Z0-9_]*)\(\)$",
        "pcm",
    ),
    "dot_format": (r"^([a-zA-Z][a-zA-Z0-9_.]*?)\.([A-Z][a-zA-Z0-9_]*?)\.([a-zA-Z_][a-zA-Z0-9_]*)$", "pcm"),
    "package_class": (r"^([a-zA-Z][a-zA-Z0-9_.]*?)\.([A-Z][a-zA-Z0-9_]*)$", "pc"),
    "file_path_method": (r"^([a-zA-Z0-9_/\\]+?/)([A-Z][a-zA-Z0-9_]*?)#([a-zA-Z_][a-zA-Z0-9_]*)$", "dcm"),
    "file_path": (r"^([a-zA-Z0-9_/\\]+?/)([A-Z][a-zA-Z0-9_]*)$", "dc"),
    "class_java_method": (r"^([A-Z][a-zA-Z0-9_]*)\.java#([a-zA-Z_][a-zA-Z0-9_]*)$", "cm"),
    "class_java": (r"^([A-Z][a-zA-Z0-9_]*)\.java$", "c"),
    "class_method": (r"^([A-Z][a-zA-Z0-9_]*?)#([a-zA-Z_][a-zA-Z0-9_]*)$", "cm"),
    "class_only": (r"^([A-Z][a-zA-Z0-9_]*)$", "c"),
}


def clean_frame(line: Column) -> Column:
    """Frame text without whitespace, quotes, backslashes (unless ``at …``) and a known prefix."""
    text = strip(line)
    text = F.when(text.rlike("^[\"']"), strip(F.regexp_replace(text, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2"))).otherwise(text)
    text = F.when(text.startswith("at "), text).otherwise(F.translate(text, "\\", "/"))
    return strip(F.regexp_replace(text, f"^(?:{'|'.join(LINE_PREFIXES)})", ""))


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, pattern, i)


def _frame(package: Column, class_name: Column, method=None, file=None, line=None, pattern: str = "") -> Column:
    none = F.lit(None).cast("string")
    package = F.coalesce(package, F.lit(""))
    return F.struct(
        F.translate(package, ".", "/").alias("package_path"),
        class_name.alias("class_name"),
        (none if method is None else method).alias("method"),
        F.when(package == "", class_name).otherwise(F.concat_ws(".", package, class_name)).alias("full_class_path"),
        (F.concat(class_name, F.lit(".java")) if file is None else file).alias("file_name"),
        (none if line is None else line).try_cast("int").alias("line_number"),
        F.lit(pattern).alias("pattern"),
    )


def plain_frame(text: Column) -> Column:
    """Plain grammar: frames, ``at`` frames, paths and class names; NULL if nothing fits.

    Takes the text of ``clean_frame``. Struct ``package_path, class_name, method,
    full_class_path, file_name, line_number, pattern``. ``method`` is NULL when the line
    names none.
    """
    structural = rf"(?i)^(?:.*/)?(?:{'|'.join(NON_PACKAGE_DIRS)})(?=/|$)/?"
    cases = []
    for name, pattern in PLAIN_PATTERNS.items():
        first, second, third = (_group(text, pattern, i) for i in (1, 2, 3))
        if name in ("standard", "at_simple"):
            frame = _frame(first, second, third, pattern=name)
        elif name in ("with_line", "at_format"):
            frame = _frame(first, second, third, _group(text, pattern, 4), _group(text, pattern, 5), name)
        elif name in ("file_path_slash", "mixed_format"):
            package = F.regexp_replace(F.translate(first, "\\", "/"), structural, "")
            frame = _frame(F.translate(package, "/", "."), second, pattern=name)
        else:
            frame = _frame(first, second, pattern=name)
        cases.append(F.when(text.rlike(pattern), frame))
    return F.when(text != "", F.coalesce(*cases, _fallback_suffix(text), _fallback_token(text)))


def _fallback_suffix(text: Column) -> Column:
    # anything ending in .java whose last path part looks like a class
    stem = F.regexp_replace(text, r"\.java$", "")
    slashed = F.instr(stem, "/") > 0
    class_name = F.when(slashed, F.substring_index(stem, "/", -1)).otherwise(F.substring_index(stem, ".", -1))
    before = F.substring(stem, F.lit(1), F.greatest(F.length(stem) - F.length(class_name) - 1, F.lit(0)))
    package = F.when(slashed, F.translate(before, "/", ".")).otherwise(before)
    looks_right = text.endswith(".java") & class_name.rlike(r"^\p{Lu}[\p{L}\p{N}_$]*$")
    return F.when(looks_right, _frame(package, class_name, pattern="java_suffix"))


def _fallback_token(text: Column) -> Column:
    # the longest capitalised word, with the package-like words before it
    tokens = F.regexp_extract_all(text, F.lit(CLASS_TOKEN), 1)
    longest = F.aggregate(
        tokens, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best)
    )
    before = F.split(strip(F.substring(text, F.lit(1), F.instr(text, longest) - 1)), r"[/\\.]")
    package = F.array_join(F.filter(before, lambda p: p.rlike(r"^\p{Ll}[\p{L}\p{N}]*$")), ".")
    return F.when(F.size(tokens) > 0, _frame(package, longest, pattern="class_token"))


def is_valid_frame(frame: Column) -> Column:
    """Sensible package depth, class in upper case, method (if any) in lower case."""
    depth = F.size(F.split(frame["package_path"], "/"))
    method = frame["method"]
    return F.coalesce(
        (depth <= MAX_PACKAGE_DEPTH)
        & frame["class_name"].rlike(r"^\p{Lu}")
        & (method.isNull() | method.rlike(r"^\p{Ll}")),
        F.lit(False),
    )


def _reference(class_fqn: Column, method: Column, path: Column, pattern: Column) -> Column:
    return F.struct(
        class_fqn.alias("class_fqn"),
        method.alias("method"),
        path.isNotNull().alias("file_path_provided"),
        path.alias("explicit_path"),
        pattern.alias("pattern"),
    )


def _none() -> Column:
    return F.lit(None).cast("string")


def _path_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.java$", "")


def clean_reference(line: Column) -> Column:
    """Frame text without whitespace and without a trailing ``[…]``."""
    text = strip(line)
    return F.when(text.endswith("]"), F.regexp_replace(text, BRACKET_SUFFIX, "$1")).otherwise(text)


def reference_frame(text: Column, split_dotted: bool = True) -> Column:
    """Reference grammar: path, ``Class#method``, ``Class.method(…)``, else a class.

    Takes the text of ``clean_reference``. Struct ``class_fqn, method,
    file_path_provided, explicit_path, pattern``. With ``split_dotted`` a bare dotted
    name is split into class and method by its capitalised token.
    """
    stem = F.substring_index(_path_stem(text), "$", 1)
    hashed, framed, bare = (REFERENCE_PATTERNS[n] for n in ("intellij_format", "stack_frame", "class_only"))
    dotted = _split_dotted(text)
    plain_class = dotted["class_fqn"] if split_dotted else text
    plain_method = dotted["method"] if split_dotted else _none()
    return (
        F.when(text.rlike(EXPLICIT_PATH), _reference(stem, _none(), text, F.lit("explicit_path")))
        .when(
            text.rlike(hashed),
            _reference(_group(text, hashed, 1), _group(text, hashed, 2), _none(), F.lit("intellij_format")),
        )
        .when(
            text.rlike(framed),
            _reference(_group(text, framed, 1), _group(text, framed, 2), _none(), F.lit("stack_frame")),
        )
        .when(text.rlike(bare), _reference(plain_class, plain_method, _none(), F.lit("class_only")))
        .when(text.isNotNull(), _reference(text, _none(), _none(), F.lit("fallback")))
    )


def _split_dotted(text: Column) -> Column:
    """Class and method of a dotted name: the first class-like token ends the class."""
    tokens = F.split(text, r"\.")
    at = F.array_position(F.transform(tokens, lambda t: t.rlike(TOKEN_IS_CLASS)), F.lit(True)).cast("int")
    size = F.size(tokens)
    last = F.element_at(tokens, -1)

    def bare(method: Column) -> Column:
        return F.regexp_replace(method, r"^(.+)\(\)$", "$1")

    rest = F.array_join(F.slice(tokens, at + 1, size), ".")
    guess_method = (at == 0) & (size > 1) & last.rlike(TOKEN_IS_METHOD)
    class_fqn = (
        F.when(size < 2, text)
        .when(at > 0, F.array_join(F.slice(tokens, 1, at), "."))
        .when(guess_method, F.array_join(F.slice(tokens, 1, size - 1), "."))
        .otherwise(text)
    )
    method = F.when((size > 1) & (at > 0) & (at < size), bare(rest)).when(guess_method, bare(last))
    return F.struct(class_fqn.alias("class_fqn"), method.alias("method"))


def clean_tokens(line: Column) -> Column:
    """``clean_reference`` with forward slashes."""
    return clean_reference(F.translate(line, "\\", "/"))


def token_frame(text: Column) -> Column:
    """Token grammar: path, ``#``, frame, else dotted tokens. Same struct as ``reference_frame``.

    Takes the text of ``clean_tokens``.
    """
    dotted = _split_dotted(text)
    return (
        F.when(text.rlike(EXPLICIT_PATH), _reference(_path_stem(text), _none(), text, F.lit("explicit_path")))
        .when(
            text.rlike(TOKEN_HASH),
            _reference(_group(text, TOKEN_HASH, 1), _group(text, TOKEN_HASH, 2), _none(), F.lit("intellij_format")),
        )
        .when(
            text.rlike(TOKEN_FRAME),
            _reference(_group(text, TOKEN_FRAME, 1), _group(text, TOKEN_FRAME, 2), _none(), F.lit("stack_frame")),
        )
        .when(text.isNotNull(), _reference(dotted["class_fqn"], dotted["method"], _none(), F.lit("dot_notation")))
    )


def clean_path(line: Column) -> Column:
    """Frame text without whitespace and quotes."""
    return F.btrim(strip(line), F.lit("\"'"))


def path_frame(text: Column) -> Column:
    """Path grammar: struct ``package_path, class_name, method, parse_type``.

    Takes the text of ``clean_path``. Nothing fits: empty package and class,
    ``parse_type`` is ``no_match``.
    """
    parsed = F
    for name, (pattern, roles) in PATH_PATTERNS.items():
        part = {role: _group(text, pattern, i + 1) for i, role in enumerate(roles)}
        package = F.lit("")
        if "p" in part:
            package = F.translate(part["p"], ".", "/")
        elif "d" in part:
            package = F.regexp_replace(part["d"], "/+$", "")
        found = F.struct(
            package.alias("package_path"),
            part["c"].alias("class_name"),
            part.get("m", _none()).alias("method"),
            F.lit(name).alias("parse_type"),
        )
        parsed = parsed.when(text.rlike(pattern), found)
    return parsed.otherwise(
        F.struct(
            F.lit("").alias("package_path"),
            F.lit("").alias("class_name"),
            _none().alias("method"),
            F.lit("no_match").alias("parse_type"),
        )
    )


def format_check(lines: DataFrame, column: str = "line") -> DataFrame:
    """Whether the path grammar understands each line, and its parts."""
    parsed = lines.withColumn("_text", clean_path(F.col(column))).withColumn("_frame", path_frame(F.col("_text")))
    frame = F.col("_frame")
    valid = frame["class_name"] != ""
    return parsed.select(
        *lines.columns,
        valid.alias("valid"),
        F.when(valid, frame["class_name"]).alias("parsed_class"),
        F.when(valid, frame["method"]).alias("parsed_method"),
        F.when(valid, frame["package_path"]).alias("parsed_package"),
        F.when(valid, frame["parse_type"]).alias("parse_type"),
        F.when(valid, F.concat(F.lit("Successfully parsed class: "), frame["class_name"]))
        .otherwise("Could not extract class name from input")
        .alias("message"),
    )


def as_plain_frame(reference: Column) -> Column:
    """A frame of the reference or token grammar as a record of the plain grammar."""
    fqn = reference["class_fqn"]
    class_name = F.substring_index(fqn, ".", -1)
    package = F.when(F.instr(fqn, ".") > 0, F.regexp_replace(fqn, r"\.[^.]*$", "")).otherwise(F.lit(""))
    return F.when(fqn.isNotNull(), _frame(package, class_name, reference["method"], pattern="converted"))


_GRAMMARS = {
    "plain": (clean_frame, plain_frame),
    "reference": (clean_reference, reference_frame),
    "tokens": (clean_tokens, token_frame),
    "path": (clean_path, path_frame),
}


def parse_lines(lines: DataFrame, grammar: str = "reference", column: str = "line") -> DataFrame:
    """Add ``frame`` and ``parsed``; lines that do not parse stay, with a NULL frame.

    The text is cleaned in a step of its own, as every pattern reads it.
    """
    clean, frame = _GRAMMARS[grammar]
    parsed = lines.withColumn("_text", clean(F.col(column))).withColumn("frame", frame(F.col("_text")))
    if grammar == "path":
        parsed = parsed.withColumn("frame", F.when(F.col("frame.class_name") != "", F.col("frame")))
    elif grammar != "plain":
        parsed = parsed.withColumn("frame", F.when(F.col("_text") != "", F.col("frame")))
    return parsed.withColumn("parsed", F.col("frame").isNotNull()).drop("_text")
