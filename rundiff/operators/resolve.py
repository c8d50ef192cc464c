"""Parsed frames to source files, by joins against a catalog of file paths.

The catalog has one row per file with its ``path`` relative to the root. Every lookup
first reduces the catalog to one best file per key with a map-side aggregation, so each
join finds at most one row per frame: a file name that is a third of the catalog never
multiplies rows. Frames are made distinct before they are resolved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rundiff.operators.frames import TOKEN_IS_CLASS
from rundiff.operators.lookup import look_up, merge_join

# Source folders tried for a class path, in order.
SOURCE_DIRS = ["src/main/java", "src/test/java", "src/java", "src", "test/java", "tests/src"]
# Source folders a root search recognises; * stands for one folder.
ROOT_PATTERNS = [
    "src/main/java",
    "src/java",
    "src",
    "java",
    "main/java",
    "source/java",
    "sources",
    "src/impl/*/src",
    "src/test/java",
    "src/test",
    "test/java",
    "tests/src",
    "src/main/resources",
    "impl/*/src",
]
# Folders after which a display path starts, and sizes that make a folder a source root.
DISPLAY_DIRS = ["src", "java", "main", "test", "tests"]
MANY_FILES = 5
DIRECT_FILES = 2


def file_catalog(paths: DataFrame, path: str = "path") -> DataFrame:
    """Catalog columns of relative paths: ``path, dir, file_name, depth``."""
    p = F.col(path)
    name = F.substring_index(p, "/", -1)
    folder = F.substring(p, F.lit(1), F.greatest(F.length(p) - F.length(name) - 1, F.lit(0)))
    return paths.select(
        p.alias("path"),
        folder.alias("dir"),
        name.alias("file_name"),
        (F.length(p) - F.length(F.translate(p, "/", ""))).alias("depth"),
    )


def _best(catalog: DataFrame, key: Column, rank: Sequence[Column], out: str) -> DataFrame:
    """One file per key: the lowest rank, then the shallowest, then the first by name."""
    order = F.struct(*rank, F.col("depth"), F.col("path"))
    best = catalog.groupBy(key.alias("_key")).agg(F.min(order).alias("_b"), F.count("*").alias(f"{out}_count"))
    return best.where("_key is not null").select("_key", F.col("_b").alias(out), f"{out}_count")


def _find(frames: DataFrame, key: Column, best: DataFrame) -> DataFrame:
    return look_up(frames.withColumn("_key", key), best, ["_key"]).drop("_key")


def by_class_path(frames: DataFrame, catalog: DataFrame, fqn: str = "class_fqn", out: str = "exact") -> DataFrame:
    """Package folders plus ``Class.java``, at the root or below a known source folder.

    Inner classes look for the file of the outer class. ``out`` is NULL or a struct with
    ``place`` (0 at the root, else the number of the source folder) and ``path``.
    """
    places = [F.struct(F.lit(0).alias("place"), F.col("path").alias("key"))]
    for i, folder in enumerate(SOURCE_DIRS, 1):
        below = F.substring(F.col("path"), len(folder) + 2, 2147483647)
        places.append(
            F.when(F.col("path").startswith(f"{folder}/"), F.struct(F.lit(i).alias("place"), below.alias("key")))
        )
    keyed = catalog.select("*", F.explode(F.array_compact(F.array(*places))).alias("_p"))
    best = _best(keyed, F.col("_p.key"), [F.col("_p.place").alias("place")], out)
    key = F.concat(F.translate(F.substring_index(fqn, "$", 1), ".", "/"), F.lit(".java"))
    return _find(frames, key, best)


def by_file_name(frames: DataFrame, catalog: DataFrame, fqn: str = "class_fqn") -> DataFrame:
    """Any file named after the class, exact case first, at any depth.

    Adds ``fuzzy`` (exact case) and ``fuzzy_ci`` (any case) with their candidate counts.
    """
    name = F.concat(F.substring_index(F.substring_index(fqn, "$", 1), ".", -1), F.lit(".java"))
    exact = _find(frames, name, _best(catalog, F.col("file_name"), [], "fuzzy"))
    return _find(exact, F.lower(name), _best(catalog, F.lower("file_name"), [], "fuzzy_ci"))


def candidate_files(frames: DataFrame, catalog: DataFrame, fqn: str = "class_fqn") -> DataFrame:
    """All files that share a frame's file name in any case, one row per name and file.

    Keyed by name, not by frame, so the result is never larger than the catalog.
    """
    name = F.lower(F.concat(F.substring_index(F.substring_index(fqn, "$", 1), ".", -1), F.lit(".java")))
    wanted = frames.select(name.alias("lower_name")).distinct()
    named = catalog.withColumn("lower_name", F.lower("file_name"))
    return merge_join(named, wanted, "lower_name", "left_semi").select("lower_name", "path", "depth")


def by_explicit_path(frames: DataFrame, catalog: DataFrame, root: str = "", path: str = "explicit_path") -> DataFrame:
    """The path given in the line, absolute below ``root`` or relative to it."""
    given = F.translate(F.col(path), "\\", "/")
    prefix = root.rstrip("/") + "/"
    absolute = F.lit(bool(root)) & given.startswith(prefix)
    relative = F.when(absolute, F.substring(given, len(prefix) + 1, 2147483647)).otherwise(given)
    found = _find(frames, relative, _best(catalog, F.col("path"), [], "explicit"))
    return found.withColumn("explicit_absolute", absolute)


def resolve_frames(frames: DataFrame, catalog: DataFrame, root: str = "") -> DataFrame:
    """Distinct frames with the file found and how: ``path, strategy, candidate_count``.

    ``frames`` needs ``class_fqn`` and ``explicit_path``. A given path is the only
    strategy when there is one; else the class path, then the file name.
    """
    wanted = frames.select("class_fqn", "explicit_path").distinct()
    found = by_explicit_path(by_file_name(by_class_path(wanted, catalog), catalog), catalog, root)
    given = F.col("explicit_path").isNotNull()
    exact, fuzzy, fuzzy_ci = (F.col(c) for c in ("exact", "fuzzy", "fuzzy_ci"))
    strategy = (
        F.when(given & F.col("explicit").isNull(), "explicit_path_not_found")
        .when(given & F.col("explicit_absolute"), "explicit_path_absolute")
        .when(given, "explicit_path_relative")
        .when(exact["place"] == 0, "exact_fqn")
        .when(exact.isNotNull(), "exact_fqn_with_src")
        .when(fuzzy.isNotNull(), "fuzzy_exact_case")
        .when(fuzzy_ci.isNotNull(), "fuzzy_case_insensitive")
        .otherwise("not_found")
    )
    path = F.when(given, F.col("explicit.path")).otherwise(F.coalesce(exact["path"], fuzzy["path"], fuzzy_ci["path"]))
    searched_by_name = ~given & exact.isNull()
    return found.select(
        "class_fqn",
        "explicit_path",
        path.alias("path"),
        strategy.alias("strategy"),
        F.when(searched_by_name, F.coalesce("fuzzy_ci_count", F.lit(0))).otherwise(F.lit(0)).alias("candidate_count"),
    )


def searched_paths(class_fqn: Column, explicit_path: Column) -> Column:
    """The relative paths that were tried for a frame."""
    key = F.concat(F.translate(F.substring_index(class_fqn, "$", 1), ".", "/"), F.lit(".java"))
    tried = F.array(key, *[F.concat(F.lit(f"{d}/"), key) for d in SOURCE_DIRS])
    return F.when(explicit_path.isNotNull(), F.array(explicit_path)).otherwise(tried)


def by_sequential_path(frames: DataFrame, catalog: DataFrame, root_name: str) -> DataFrame:
    """Follow the package folders from the root, each in its own or in lower case.

    The first package part is skipped when the root folder already has that name. Adds
    ``path`` (NULL if none). ``frames`` needs ``package_path`` with ``/`` or ``.`` and
    ``file_name``.
    """
    parts = F.filter(F.split("package_path", "[/.]"), lambda p: p != "")
    skips = F.lower(F.element_at(parts, 1)) == root_name.lower()
    parts = F.when((F.size(parts) > 0) & skips, F.slice(parts, 2, F.size(parts))).otherwise(parts)
    wanted = frames.select("package_path", "file_name").distinct().withColumn("_parts", parts)
    key = F.concat_ws("/", F.array_join(F.transform("_parts", F.lower), "/"), "file_name")
    key = F.regexp_replace(key, "^/", "")
    folders = F.filter(F.split("dir", "/"), lambda p: p != "")
    files = catalog.select(
        F.concat_ws("/", F.nullif(F.lower("dir"), F.lit("")), "file_name").alias("_key"),
        folders.alias("_folders"),
        F.col("path").alias("_path"),
    )
    # 0 where a folder has the part's own case, 1 where it is the lower-case form
    fit = F.zip_with("_parts", "_folders", lambda p, d: F.when(p == d, 0).when(F.lower(p) == d, 1))
    matched = (
        merge_join(wanted.withColumn("_k", key), files, F.col("_k") == F.col("_key"))
        .withColumn("_fit", fit)
        .where(~F.exists("_fit", lambda x: x.isNull()))
        .groupBy("package_path", "file_name")
        .agg(F.min(F.struct("_fit", "_path")).alias("_b"))
        .select("package_path", "file_name", F.col("_b._path").alias("path"))
    )
    return merge_join(frames, matched, ["package_path", "file_name"], "left")


def by_token_walk(frames: DataFrame, catalog: DataFrame, fqn: str = "class_fqn") -> DataFrame:
    """Walk the tokens of a class name: folders first, a file at each class-like token.

    Falls back on the file name like ``by_file_name``. Adds ``path`` and ``how_found``
    (``exact_fqn``, ``fuzzy``, ``case_insensitive`` or NULL).
    """
    tokens = F.split(fqn, r"\.")

    def is_class(token: Column) -> Column:
        return token.rlike(TOKEN_IS_CLASS)

    numbered = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    wanted = frames.select(fqn).distinct()
    steps = wanted.select(fqn, F.explode(F.filter(numbered, lambda x: is_class(x["t"]))).alias("_x"))
    folders = F.filter(F.slice(tokens, 1, F.col("_x.i") + 1), lambda t: ~is_class(t))
    tried = F.concat_ws("/", F.array_join(folders, "/"), F.concat(F.col("_x.t"), F.lit(".java")))
    steps = steps.select(fqn, F.col("_x.i").alias("_step"), F.regexp_replace(tried, "^/", "").alias("_k"))
    hits = merge_join(steps, catalog.select(F.col("path").alias("_path")), F.col("_k") == F.col("_path"))
    first = hits.groupBy(fqn).agg(F.min(F.struct("_step", "_path")).alias("_walk"))
    found = by_file_name(merge_join(wanted, first, fqn, "left"), catalog, fqn)
    walked = F.col("_walk._path")
    resolved = found.select(
        fqn,
        F.coalesce(walked, F.col("fuzzy.path"), F.col("fuzzy_ci.path")).alias("path"),
        F.when(walked.isNotNull(), "exact_fqn")
        .when(F.col("fuzzy").isNotNull(), "fuzzy")
        .when(F.col("fuzzy_ci").isNotNull(), "case_insensitive")
        .alias("how_found"),
    )
    return merge_join(frames, resolved, fqn, "left")


def by_path_suffix(frames: DataFrame, catalog: DataFrame) -> DataFrame:
    """The file whose path ends in the longest tail of the package path.

    ``frames`` needs ``package_path`` and ``file_name``. Adds ``path``, ``tail_length``
    and ``match_count``. Tails are exploded on both sides and reduced to one file per
    tail, so the join is one to one.
    """

    def tails(folder: Column) -> Column:
        parts = F.split(folder, "/")
        lengths = F.sequence(F.lit(1), F.size(parts))
        return F.transform(lengths, lambda n: F.array_join(F.slice(parts, -n, n), "/"))

    keyed = catalog.where("dir <> ''").select("*", F.explode(tails(F.col("dir"))).alias("_tail"))
    best = _best(keyed, F.concat_ws("/", "_tail", "file_name"), [], "_match")
    wanted = frames.select("package_path", "file_name").distinct()
    probes = wanted.where("package_path <> ''").select("*", F.explode(tails(F.col("package_path"))).alias("_tail"))
    hits = _find(probes, F.concat_ws("/", "_tail", "file_name"), best).where("_match is not null")
    length = F.size(F.split("_tail", "/"))
    longest = hits.groupBy("package_path", "file_name").agg(
        F.max(F.struct(length.alias("n"), F.col("_match.path").alias("path"), F.col("_match_count").alias("c"))).alias("_b")
    )
    longest = longest.select(
        "package_path",
        "file_name",
        F.col("_b.path").alias("path"),
        F.col("_b.n").alias("tail_length"),
        F.col("_b.c").alias("match_count"),
    )
    return merge_join(frames, longest, ["package_path", "file_name"], "left")


def declared_files(catalog: DataFrame, source_lines: DataFrame) -> DataFrame:
    """Files that declare a class or interface of their own name, on any line."""
    stem = F.regexp_extract("path", r"([^/]*)\.java$", 1)
    declares = F.col("text").contains(F.concat(F.lit("class "), stem)) | F.col("text").contains(
        F.concat(F.lit("interface "), stem)
    )
    declaring = source_lines.where(declares).select("path").distinct()
    return merge_join(catalog, declaring, "path", "left_semi")


def by_declaration(frames: DataFrame, catalog: DataFrame, source_lines: DataFrame, fqn: str = "class_fqn") -> DataFrame:
    """Files named after the class that also declare it; adds ``path`` and ``match_count``."""
    best = _best(declared_files(catalog, source_lines), F.col("file_name"), [], "_match")
    name = F.concat(F.substring_index(fqn, ".", -1), F.lit(".java"))
    found = _find(frames, name, best)
    return found.withColumn("path", F.col("_match.path")).withColumnRenamed("_match_count", "match_count").drop("_match")


def source_roots(catalog: DataFrame) -> DataFrame:
    """Folders that look like Java source roots, with their file counts.

    A known source folder with a file anywhere below it; or a folder that holds a file
    itself and has two files, more than five below it, or a direct subfolder with files.
    """
    java = catalog.where(F.col("file_name").endswith(".java"))
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    is_child = (F.regexp_replace("dir", "/?[^/]+$", "") == F.col("folder")) & (F.col("dir") != F.col("folder"))
    counts = (
        java.groupBy("dir")
        .agg(F.count("*").alias("n"))  # one row per folder before the explode
        .select("n", "dir", F.explode(ancestors).alias("folder"))
        .groupBy("folder")
        .agg(
            F.sum("n").alias("total_files"),
            F.sum(F.when(F.col("dir") == F.col("folder"), F.col("n")).otherwise(0)).alias("direct_files"),
            F.max(is_child).alias("_sub"),
        )
    )
    known = "|".join(p.replace("*", "[^/]+") for p in ROOT_PATTERNS)
    is_known = F.col("folder").rlike(f"(^|/)({known})$")
    significant = (F.col("direct_files") > 0) & (
        (F.col("direct_files") >= DIRECT_FILES) | (F.col("total_files") > MANY_FILES) | F.col("_sub")
    )
    return counts.where(is_known | significant).select(
        "folder", "total_files", "direct_files", is_known.alias("known_pattern")
    )


def package_of(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Add ``source_root`` (the longest root above a file, else empty) and ``package_path``."""
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = files.select("dir").distinct().select("dir", F.explode(ancestors).alias("folder"))
    rooted = (
        folders.join(roots.select("folder"), "folder")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("folder").alias("n"), "folder")).alias("_r"))
        .select("dir", F.col("_r.folder").alias("source_root"))
    )
    root = F.coalesce("source_root", F.lit(""))
    below = F.regexp_replace(F.substring(F.col("dir"), F.length(root) + 1, F.length("dir")), "^/", "")
    return files.join(rooted, "dir", "left").select(
        *files.columns, root.alias("source_root"), below.alias("package_path")
    )


def display_path(path: Column) -> Column:
    """Path after its first source-like folder, or the file name alone."""
    folders = "|".join(DISPLAY_DIRS)
    after = F.regexp_extract(F.translate(path, "\\", "/"), rf"^(?:.*?/)??(?:{folders})/(.+)$", 1)
    return F.coalesce(F.nullif(after, F.lit("")), F.regexp_extract(path, r"([^/\\]*)$", 1))
