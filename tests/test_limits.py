"""No size of a file, a path or a document changes what is found."""

import itertools

import pytest
from pyspark.sql import functions as F

from rundiff.operators import methods, packing, resolve
from rundiff.plans import traces
from rundiff.session import shared_folder


def test_chunk_numbers_over_several_blocks(spark):
    texts = ["x" * (i * 7 % 23) for i in range(40)]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc int, line_no long, line string")
    got = packing.chunk_lines(lines, ["doc"], max_chunk_size=30, block_lines=16, fan_out=2).orderBy("line_no").collect()
    expected, fill, number = [], 0, 0
    for t in texts:
        if fill and fill + len(t) + 1 > 30:
            fill, number = 0, number + 1
        fill += len(t) + 1
        expected.append(number)
    assert [r.chunk_no for r in got] == expected


def source(n, top=0):
    body = ["// licence"] * top + ["package a;", "import b.C;", "public class Big {", "  private int size = 1;"]
    body += ["  public int first(int x) {", "    int y = last(x);", "  }"]
    body += ["  // filler"] * n
    return [*body, "  public int last(int x) {", "    return x;", "  }", "}"]


def test_context_in_a_large_file(spark):
    text = source(1500, top=200)
    lines = spark.createDataFrame([("a/Big.java", i + 1, t) for i, t in enumerate(text)], "path string, line_no long, text string")
    index = methods.method_index(lines, reuse=True)
    target = index.where("name = 'first'")
    rows = traces.context_lines(target, index, lines).collect()
    parts = {r.part: r.text for r in rows}
    assert set(parts) == {0, 1, 2, 3, 4}
    assert any("public int last" in r.text for r in rows if r.part == 4)
    assert any("private int size" in r.text for r in rows if r.part == 2)


def test_deep_paths(spark):
    path = "/".join(f"d{i}" for i in range(12)) + "/Deep.java"
    catalog = resolve.file_catalog(spark.createDataFrame([(path,)], "path string"))
    frames = spark.createDataFrame([("x.y.Deep", None)], "class_fqn string, explicit_path string")
    assert resolve.resolve_frames(frames, catalog).head()["path"] == path
    assert resolve.candidate_files(frames, catalog).count() == 1


def test_class_below_a_long_comment(spark):
    lines = spark.createDataFrame([("a/Low.java", i + 1, "// x") for i in range(80)] + [("a/Low.java", 81, "class Low {")], "path string, line_no long, text string")
    catalog = resolve.file_catalog(spark.createDataFrame([("a/Low.java",)], "path string"))
    assert resolve.declared_files(catalog, lines).count() == 1


def test_signatures_stay_whole(spark):
    long = "public void go(" + ", ".join(f"int p{i}" for i in range(40)) + ") { }"
    lines = spark.createDataFrame([("A.java", 1, long)], "path string, line_no long, text string")
    row = methods.method_lists(methods.method_index(lines)).head()
    assert row.full_signature == [long] and row.signature[0].endswith("...")


def test_parts_of_names(spark):
    names = ["loadUserData", "userLoader", "saveAll", "reload"]
    index = spark.createDataFrame(
        [("A.java", n, i * 10, i * 10 + 5, f"void {n}() {{") for i, n in enumerate(names)], "path string, name string, start_line long, end_line long, signature string"
    )
    asked = ["load", "USER", "all", "x", "loaduserdata", "dUserD"]
    requests = spark.createDataFrame([("A.java", m) for m in asked], "path string, method string")
    got = {r.method: (r.match, r.found and r.found["name"]) for r in methods.find_methods(requests, index).collect()}
    for m in asked:
        whole = [n for n in names if n.lower() == m.lower()]
        part = [n for n in names if m.lower() in n.lower()]
        assert got[m] == (("case_insensitive", whole[0]) if whole else ("contains", part[0]) if part else (None, None))


def test_intermediate_folder_is_asked_for(spark):
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://https://host"):
        with pytest.raises(RuntimeError):
            shared_folder(Session(master))


def test_top_lists_per_key(spark):
    from rundiff.operators import hotspots

    rows = [(k, f"f{i}", i, float(i * (k + 1)), "C", "m", "1", 2.0, 1.5) for k, i in itertools.product(range(3), range(6))]
    spots = spark.createDataFrame(rows, "file_id int, function_name string, range_start long, impact_score double, class_name string, method_name string, line_number string, time_delta double, regression_factor double")
    top = hotspots.top_hotspots(spots, 2, ["file_id"]).orderBy("file_id", "rank").collect()
    assert [(r.file_id, r["rank"], r.function_name) for r in top] == [(k, n + 1, f"f{5 - n}") for k in range(3) for n in range(2)]
    rest = hotspots.remaining_hotspots(spots, 2, ["file_id"]).orderBy("file_id").collect()
    assert [(r.file_id, r.additional, r.highest_impact) for r in rest] == [(k, 4, 3.0 * (k + 1)) for k in range(3)]
