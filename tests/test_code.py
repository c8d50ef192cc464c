import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rundiff.operators import frames, methods, resolve, results, statements
from rundiff.plans import traces


def parsed(spark, lines, grammar):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return [r.frame for r in frames.parse_lines(df, grammar).orderBy("i").collect()]


def test_plain_grammar(spark):
    lines = [
        "chs.common.styles.PinListDecorationStyle.refreshDecorations()",
        "at com.example.service.DataProcessor.processData(DataProcessor.java:45)",
        "at com.example.service.DataProcessor.processData()",
        "java.util.ArrayList.get(ArrayList.java:434)",
        "src/main/java/com/example/service/MyService.java",
        "C:\\project\\src\\main\\java\\chs\\common\\attr\\AVFDTest.java",
        "com.example.Thing.java",
        "AttributeValidatorFactoryDescriptionTest",
        "chs/common.Foo",
        "File: Foo.java",
        "'com.example.TestClass'",
        "9some weird/thing com.foo.BarService stuff!",
        "lower.case.only",
        "",
    ]
    got = [f and (f.package_path, f.class_name, f.method, f.line_number, f.pattern) for f in parsed(spark, lines, "plain")]
    assert got == [
        ("chs/common/styles", "PinListDecorationStyle", "refreshDecorations", None, "standard"),
        ("com/example/service", "DataProcessor", "processData", 45, "at_format"),
        ("com/example/service", "DataProcessor", "processData", None, "at_simple"),
        ("java/util", "ArrayList", "get", 434, "with_line"),
        ("com/example/service", "MyService", None, None, "file_path_slash"),
        ("chs/common/attr", "AVFDTest", None, None, "file_path_slash"),
        ("com/example", "Thing", None, None, "file_path_dot"),
        ("", "AttributeValidatorFactoryDescriptionTest", None, None, "class_only"),
        ("chs/common", "Foo", None, None, "mixed_format"),
        ("", "Foo", None, None, "java_suffix"),
        ("com/example", "TestClass", None, None, "class_only"),
        ("foo", "BarService", None, None, "class_token"),
        None,
        None,
    ]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    valid = frames.parse_lines(df, "plain").select(frames.is_valid_frame(F.col("frame"))).collect()
    assert [v[0] for v in valid] == [True] * 12 + [False] * 2


def test_reference_and_token_grammars(spark):
    lines = [
        "chs.common.attr.X#testY",
        "com.example.Test#testMethod[1]",
        "com.example.Outer$Inner#method",
        "com.foo.Bar.method(File.java:123)",
        "src/main/java/com/example/service/MyService.java",
        "C:\\path\\to\\TestClass.java",
        "a.B.m",
        "a.B",
        "Solo",
        "lower.only",
        "some words",
    ]
    got = [(f.class_fqn, f.method, f.explicit_path) for f in parsed(spark, lines, "reference")]
    assert got == [
        ("chs.common.attr.X", "testY", None),
        ("com.example.Test", "testMethod", None),
        ("com.example.Outer$Inner", "method", None),
        ("com.foo.Bar", "method", None),
        ("MyService", None, lines[4]),
        ("TestClass", None, lines[5]),
        ("a.B", "m", None),
        ("a.B", None, None),
        ("Solo", None, None),
        ("lower", "only", None),
        ("some words", None, None),
    ]
    tokens = [(f.class_fqn, f.method) for f in parsed(spark, lines, "tokens")]
    assert tokens[:4] == [x[:2] for x in got[:4]] and tokens[6:10] == [x[:2] for x in got[6:10]]
    assert parsed(spark, ["a.B.c.d"], "tokens")[0].method == "c.d"
    df = spark.createDataFrame([("a.b.C#m",)], "line string")
    plain = frames.parse_lines(df).select(frames.as_plain_frame(F.col("frame")).alias("p")).head().p
    assert (plain.package_path, plain.class_name, plain.file_name, plain.method) == ("a/b", "C", "C.java", "m")


def test_path_grammar(spark):
    lines = ["p.C#m", "p.q.C.m()", "p.q.C.m", "p.C", "p/q/C#m", "p/q/C", "C.java#m", "C.java", "C#m", "C", "'p.C'", "x y"]
    got = [f and (f.package_path, f.class_name, f.method, f.parse_type) for f in parsed(spark, lines, "path")]
    assert got == [
        ("p", "C", "m", "hash_format"),
        ("p/q", "C", "m", "traditional_parens"),
        ("p/q", "C", "m", "dot_format"),
        ("p", "C", None, "package_class"),
        ("p/q", "C", "m", "file_path_method"),
        ("p/q", "C", None, "file_path"),
        ("", "C", "m", "class_java_method"),
        ("", "C", None, "class_java"),
        ("", "C", "m", "class_method"),
        ("", "C", None, "class_only"),
        ("p", "C", None, "package_class"),
        None,
    ]


PATHS = [
    "src/main/java/com/example/TestClass.java",
    "src/test/java/com/example/TestClassTest.java",
    "other/path/AnotherClass.java",
    "other/Path/anotherclass.java",
    "a/b/C.java",
    "a/b/D.java",
    "a/c/X.java",
]


@pytest.fixture
def catalog(spark):
    return resolve.file_catalog(spark.createDataFrame([(p,) for p in PATHS], "path string"))


def test_file_resolution(spark, catalog):
    cases = {
        ("com.example.TestClass", None): (PATHS[0], "exact_fqn_with_src"),
        ("com.example.TestClassTest", None): (PATHS[1], "exact_fqn_with_src"),
        ("AnotherClass", None): (PATHS[2], "fuzzy_exact_case"),
        ("ANOTHERCLASS", None): (PATHS[3], "fuzzy_case_insensitive"),
        ("NonExistent", None): (None, "not_found"),
        ("a.b.C$In", None): (PATHS[4], "exact_fqn"),
        ("X", "a/c/X.java"): (PATHS[6], "explicit_path_relative"),
        ("X", "/root/a/c/X.java"): (PATHS[6], "explicit_path_absolute"),
        ("X", "nope/X.java"): (None, "explicit_path_not_found"),
    }
    wanted = spark.createDataFrame(list(cases) * 2, "class_fqn string, explicit_path string")
    got = {(r.class_fqn, r.explicit_path): (r.path, r.strategy) for r in resolve.resolve_frames(wanted, catalog, "/root").collect()}
    assert got == cases
    walked = {r.class_fqn: (r.path, r.how_found) for r in resolve.by_token_walk(wanted, catalog).collect()}
    assert walked["a.b.C$In"] == (PATHS[4], "fuzzy") and walked["NonExistent"] == (None, None)
    packages = spark.createDataFrame([("a.b", "C.java"), ("A.b", "C.java"), ("b", "C.java")], "package_path string, file_name string")
    found = {r.package_path: r.path for r in resolve.by_sequential_path(packages, catalog, "repo").collect()}
    assert found == {"a.b": PATHS[4], "A.b": PATHS[4], "b": None}
    suffix = resolve.by_path_suffix(packages.select(F.lit("z/b").alias("package_path"), "file_name").limit(1), catalog).head()
    assert (suffix.path, suffix.tail_length) == (PATHS[4], 1)


def test_source_roots(spark, catalog):
    roots = {r.folder: r.known_pattern for r in resolve.source_roots(catalog).collect()}
    assert roots == {"src": True, "src/main/java": True, "src/test": True, "src/test/java": True, "a/b": False}
    placed = {r.path: r.package_path for r in resolve.package_of(catalog, resolve.source_roots(catalog)).collect()}
    assert placed[PATHS[0]] == "com/example" and placed[PATHS[6]] == "a/c"


JAVA = """package com.example;
import java.util.List;
// note

public class TestClass {
    private int count = 0;
    public TestClass(int a) {
        this.count = a;
    }
    public static void main(String[] args) throws IOException {
        if (args.length > 0) {
            helper(1, 2);
        } else { run(); }
    }
    abstract int weird(Map<String, Integer> x);
    private List<String> helper(int a,  final String b) { return names; }
    int late(int z) // comment
    {
        return other(z);
    }
    void decl(); // trailing
}
class Other {
  void unclosed() {
    int x = 1;"""
PATTERN = re.compile(methods.METHOD_PATTERN)


def method_ends(text):
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        match = PATTERN.match(line)
        if not match or match.group(2) in methods.NOT_METHOD_NAMES:
            continue
        balance, seen, end = 0, False, None
        for j in range(i, len(lines)):
            balance += lines[j].count("{") - lines[j].count("}")
            seen |= "{" in lines[j]
            if line.strip().endswith(";") or (seen and balance <= 0):
                end = j + 1
                break
        out.append((match.group(2), i + 1, end or len(lines), end is not None))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_method_ends_equal_brute_force(spark, block):
    random.seed(5)
    pieces = ["void a%d() {", "}", "{", "x();", "int b%d(int q);", "public void c%d(String s) { y(); }", "} else {",
              "int d%d(); // t", "}}", "  if (x) {", "static int e%d(){ {"]
    sources = {"src/main/java/com/example/TestClass.java": JAVA}
    for k in range(15):
        size = random.choice([3, 40, 120])
        sources[f"f/R{k}.java"] = "\n".join(random.choice(pieces).replace("%d", str(i)) for i in range(size))
    lines = methods.source_lines(spark.createDataFrame(list(sources.items()), "path string, content string"))
    got = {}
    for r in methods.method_index(lines, block).collect():
        got.setdefault(r.path, []).append((r.name, r.start_line, r.end_line, r.closed))
    for path, text in sources.items():
        assert sorted(got.get(path, [])) == method_ends(text), path


@pytest.fixture(scope="module")
def java(spark):
    path = "src/main/java/com/example/TestClass.java"
    lines = methods.source_lines(spark.createDataFrame([(path, JAVA), ("a/Empty.java", "class Empty {\n}")], "path string, content string"))
    return path, lines, methods.method_index(lines, reuse=True)


def test_method_parts_and_lookup(spark, java):
    path, lines, index = java
    found = {r.start_line: r for r in index.collect()}
    main = found[10]
    assert (main.name, main.return_type, main.parameters, main.modifiers) == ("main", "void", ["String[] args"], ["public", "static"])
    assert found[16].parameters == ["int a", "final String b"]
    asked = ["main", "MAIN", "elp", "zzz", None]
    requests = spark.createDataFrame([(path, m) for m in asked], "path string, method string")
    got = {r.method: (r.match, r.found and r.found.name) for r in methods.find_methods(requests, index).collect()}
    assert got == {"main": ("exact", "main"), "MAIN": ("case_insensitive", "main"), "elp": ("contains", "helper"), "zzz": (None, None), None: (None, None)}
    assert methods.overloads(requests, index).where("is_default").count() == 1
    body = methods.method_lines(index, lines)
    edges = {(r.caller, r.callee) for r in methods.call_edges(methods.dependencies(body), index).collect()}
    assert ("main", "helper") in edges and ("main", "run") not in edges
    text = methods.method_bodies(body).where("name = 'main'").head().body
    assert text.split("\n")[0].strip().startswith("public static void main") and text.endswith("    }")
    pieces = methods.method_bodies(body, 2).where("name = 'main'").orderBy("piece_no").collect()
    assert "\n".join(p.body for p in pieces) == text and len(pieces) == 3
    listed = methods.method_lists(index).where(F.col("path") == path).head()
    assert listed.line == sorted(listed.line) and listed.method_count == len(listed.name)


def test_calls_reach_every_method_of_a_name(spark):
    text = "class A {\n    void run() {\n        put(1);\n        run();\n    }\n    void put(int a) {\n        put(a, 2);\n    }\n    void put(int a, int b) { }\n}"
    files = spark.createDataFrame([("A.java", text), ("B.java", "class B {\n    void put() { }\n}")], "path string, content string")
    lines = methods.source_lines(files)
    index = methods.method_index(lines, reuse=True).where("return_type = 'void'")
    deps = methods.dependencies(methods.method_lines(index, lines))
    columns = ["path", "caller", "caller_line", "callee", "callee_line", "callee_end_line"]
    puts = [("put", 6, 8), ("put", 9, 9)]
    want = {("A.java", *c, *p) for c in (("run", 2), ("put", 6), ("put", 9)) for p in puts} | {("A.java", "run", 2, "run", 2, 5), ("B.java", "put", 2, "put", 2, 2)}
    assert sorted(tuple(r) for r in methods.call_edges(deps, index).select(columns).collect()) == sorted(want)
    # a method that is listed twice is one
    assert sorted(tuple(r) for r in methods.call_edges(deps, index.unionByName(index)).select(columns).collect()) == sorted(want)
    firsts = {(r.caller, r.caller_line, r.callee_line) for r in methods.call_edges(deps, index, first=True).where("path = 'A.java'").collect()}
    assert firsts == {("run", 2, 6), ("run", 2, 2), ("put", 6, 6), ("put", 9, 6)}


def test_class_parts(spark, java):
    path, lines, _ = java
    assert [r.text for r in methods.imports(lines, 3).where(F.col("path") == path).orderBy("line_no").collect()] == ["package com.example;", "import java.util.List;"]
    declared = {r.path: r.declaration for r in methods.class_declarations(lines).collect()}
    assert declared == {path: "public class TestClass", "a/Empty.java": "class Empty"}
    assert [r.text for r in methods.class_fields(lines, 4).collect()] == ["private int count = 0;"]


@pytest.mark.parametrize("fall_back", [False, True])
def test_traces_end_to_end(spark, java, fall_back):
    path, lines, index = java
    catalog = resolve.file_catalog(lines.select("path").distinct())
    given = ["com.example.TestClass#main", "com.example.TestClass#main", "com.example.TestClass", "com.example.TestClass#nope",
             "no.Such#x", "a/Empty.java", "", None, "com/example/TestClass#helper"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "line_no int, line string")
    out = traces.resolve_traces(df, catalog, index, fall_back=fall_back)
    got = [(r.status, r.reason, r.extraction_type) for r in out.orderBy("line_no").collect()]
    last = ("success", None, "specific_method") if fall_back else ("failure", "file_not_found", "error")
    assert got == [
        ("success", None, "specific_method"),
        ("success", None, "specific_method"),
        ("success", None, "all_methods"),
        ("failure", "method_not_found", "all_methods"),
        ("failure", "file_not_found", "error"),
        ("success", None, "full_file"),
        ("failure", "parsing_failed", "error"),
        ("failure", "parsing_failed", "error"),
        last,
    ]
    missing = out.where("line_no = 4").head()
    assert missing.searched_paths[:2] == ["no/Such.java", "src/main/java/no/Such.java"] and len(missing.suggestions) == 4
    assert traces.trace_totals(out).head().total_traces == 9
    context = traces.context_lines(index.where("name = 'main'"), index, lines)
    parts = [r.part for r in context.orderBy("part", "part_line", "line_no").collect()]
    assert parts == [0, 0, 1, 2, 3, 3, 3, 3, 3, 4, 4, 4, 4, 4, 4]  # main itself counts, as its own name is called
    chunks = {r.type: r.description for r in traces.code_chunks(context).collect()}
    assert chunks == {"target_method": "Target method: main", "dependent_methods": "Dependent methods (2 methods)", "class_context": "Class context (imports and fields)"}
    shared = context.where("name is null").select("part").distinct().count()
    assert shared == 3
    assert not traces.needs_chunking(context).head().chunked


def test_trace_export(spark, java, tmp_path):
    path, lines, index = java
    df = spark.createDataFrame([("com.example.TestClass#main",)], "line string")
    out = traces.resolve_traces(df, resolve.file_catalog(lines.select("path").distinct()), index)
    traces.export_traces(out, str(tmp_path / "t"))
    row = spark.read.json(str(tmp_path / "t")).head()
    assert row.stack_trace_info.method == "main" and row.analysis_result.method_lines == "10-14"


def test_results(spark):
    now = datetime(2024, 1, 31)
    rows = [
        ("a", "old", now - timedelta(days=9), 1, now - timedelta(hours=5), "extracted_code"),
        ("a", "new", now - timedelta(days=1), 2, now - timedelta(hours=4), "extracted_code"),
        ("b", "x", now - timedelta(days=8), 3, now - timedelta(hours=3), "analysis_result"),
        ("c", "y", now - timedelta(days=7), 4, now - timedelta(hours=2), "analysis_result"),
    ]
    schema = "key string, data string, timestamp timestamp, access_count long, last_accessed timestamp, entry_type string"
    table, at = spark.createDataFrame(rows, schema), F.lit(now)
    newest = results.newest_per_key(table.where("data <> 'new'"), table.where("data = 'new'"))
    assert {r.key: r.data for r in newest.collect()} == {"a": "new", "b": "x", "c": "y"}
    assert [r.key for r in results.retain(newest, at).collect()] == ["c", "a"]
    assert [r.key for r in results.retain(newest, at, max_entries=1).collect()] == ["c"]
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "key string")
    assert sorted(r.key for r in results.missing_inputs(asked, newest, at).collect()) == ["b", "z"]
    assert [(r.key, r.access_count) for r in results.reused_results(asked, newest, at).collect()] == [("a", 4)]
    stats = results.statistics(newest, at).head()
    assert (stats.total_entries, stats.total_access_count, stats.average_age_hours) == (3, 9, 128.0)
    assert results.statistics(newest.limit(0), at).head().average_age_hours == 0.0
    import hashlib

    key = results.result_key(F.lit("r"), F.lit("a.B"), F.lit(None).cast("string"))
    assert spark.range(1).select(key).head()[0] == hashlib.sha256(b"r::a.B::unknown").hexdigest()[:16]


def lexed(text):
    """{line: whether it starts in a comment} and the code without comments and quoted texts, by a plain automaton."""
    states, code, inside = {}, {}, False
    for n, line in enumerate(text.split("\n"), 1):
        states[n], out, i = inside, "", 0
        while i < len(line):
            two = line[i : i + 2]
            quoted = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')""", line[i:])
            if inside:
                inside, i = two != "*/", i + (2 if two == "*/" else 1)
            elif quoted:
                out, i = out + " ", i + quoted.end()
            elif two == "//":
                break
            elif two == "/*":
                out, inside, i = out + " ", True, i + 2
            else:
                out, i = out + line[i], i + 1
        code[n] = out
    return states, code


def long_statements(code):
    """(start, last, statement) of statements over several lines, word by word."""
    out, part = [], []
    for n, line in sorted(code.items()):
        for piece in re.findall(r"[^{};]*[{};]|[^{};]+", line):
            piece = " ".join(piece.split())
            if piece and not re.fullmatch(r"(?:@\w+(?:\.\w+)*(?:\s*\([^)]*\))?\s*)+", piece):
                part.append((n, piece))
            if piece and piece[-1] in "{};":
                if part and part[0][0] < part[-1][0] and piece[-1] != "}":
                    out.append((part[0][0], part[-1][0], " ".join(p for _, p in part)))
                part = []
    return out


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_statements_over_lines_equal_an_automaton(spark, block):
    rng = random.Random(17)
    marks = ["/*", "*/", "/*/", "//", '"', "'", "\\", "{", "}", ";", "a", "int b", "(", ")", " ", " ", "@X ", "f(c,"]
    files = {f"f{i}": "\n".join("".join(rng.choices(marks, k=rng.randint(0, 6))) for _ in range(rng.randint(1, 25))) for i in range(120)}
    files["empty"], files["one"] = "", "void f(\nint a)\n{"
    lines = methods.source_lines(spark.createDataFrame(list(files.items()), "path string, content string"))
    states, found = {p: {} for p in files}, {p: [] for p in files}
    for r in statements.with_comment_state(lines, block_rows=block).collect():
        states[r.path][r.line_no] = r.in_comment
    for r in statements.long_statements(lines, block).collect():
        found[r.path].append((r.start_line, r.last_line, r.statement))
    for path, text in files.items():
        expected, code = lexed(text)
        assert states[path] == expected, text
        assert sorted(found[path]) == [(a, b, re.sub(r"^(?:@\w+(?:\.\w+)*(?:\s*\([^)]*\))?\s*)+", "", s)) for a, b, s in long_statements(code)], text


def test_declarations_over_lines(spark):
    text = """class A {
  @Deprecated
  public <T> Map<String,
      T> both(int a, /* b;
      */ List<T> c)
      throws X,
        Y
  {
    if (a
      > 0) { go(a,
      c); }
  }
  void one() { }
  int open(
"""
    lines = methods.source_lines(spark.createDataFrame([("A.java", text)], "path string, content string"))
    got = {r.name: r for r in methods.method_index(lines, 4, long=True).collect()}
    assert set(got) == {"both", "one"} and got["one"].start_line == got["one"].end_line == 13
    both = got["both"]
    assert (both.start_line, both.end_line, both.closed, both.parameters, both.modifiers) == (3, 12, True, ["int a", "List<T> c"], ["public"])


def test_parts_of_names(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abAB", k=rng.randint(1, 9))) for _ in range(80)]
    index = [(f"f{i % 3}", name, i + 1, i + 1, f"void {name}();") for i, name in enumerate(names)]
    asked = [(f"f{rng.randrange(4)}", "".join(rng.choices("abAB", k=rng.randint(1, 6)))) for _ in range(120)] + [("f0", "zzz"), ("f1", "")]
    methods_df = spark.createDataFrame(index, "path string, name string, start_line long, end_line long, signature string")
    got = {(r.path, r.method): r.found and r.found.line for r in methods.find_methods(spark.createDataFrame(asked, "path string, method string"), methods_df).collect()}
    for path, part in asked:
        own = [(n, line) for p, n, line, _, _ in index if p == path]
        for fits in (lambda n: n == part, lambda n: n.lower() == part.lower(), lambda n: part.lower() in n.lower()):
            lines = [line for n, line in own if fits(n)]
            if lines:
                break
        assert got[path, part] == (min(lines) if lines else None), (path, part)


def test_upkeep_rewrites_touched_buckets_only(spark, tmp_path):
    folder, now = str(tmp_path / "results"), F.lit(datetime(2024, 1, 30))
    row = lambda key, day, data: (key, data, datetime(2024, 1, day), 1, datetime(2024, 1, day), "extracted_code")
    schema = "key string, data string, timestamp timestamp, access_count long, last_accessed timestamp, entry_type string"
    first = [row(f"k{i}", 29, "a") for i in range(40)] + [row("old", 2, "a")]
    results.upkeep(folder, spark.createDataFrame(first, schema), now, buckets=16)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "results").glob("bucket=*/*.parquet")}
    touched = results.upkeep(folder, spark.createDataFrame([row("k3", 30, "b"), row("k3", 28, "c"), row("k4", 1, "d"), row("new", 1, "e")], schema), now, buckets=16)
    assert 0 < len(touched) <= 3
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "results").glob("bucket=*/*.parquet")}
    assert all(after.get(p) == t for p, t in before.items() if int(p.parent.name.split("=")[1]) not in touched)
    got = {r.key: r.data for r in results.stored_results(spark, folder, now).collect()}
    assert got == {f"k{i}": "b" if i == 3 else "a" for i in range(40)}
