import random

import pytest

from rundiff.operators import hotspots, rows, runs
from rundiff.plans import compare

COLUMNS = "Component string, CPU_Time long, Memory_MB long, Status string, row_idx long"
A = [
    ("Common-Cleaner", 1500, 120, "Running", 0),
    ("  Sub-process 1", 400, 45, "Complete", 1),
    ("  Sub-process 2", 600, 55, "Complete", 2),
    ("RMI Scheduler (0)", 2000, 180, "Running", 3),
    ("  Background Task", 800, 90, "Complete", 4),
]
B = [
    ("Common-Cleaner", 1600, 125, "Running", 0),
    ("  Sub-process 1", 400, 45, "Complete", 1),
    ("  Sub-process 2", 650, 58, "Error", 2),
    ("RMI Scheduler (0)", 2100, 185, "Running", 3),
    ("  Background Task", 800, 90, "Complete", 4),
]


def ranges_of(spark, a, b, schema=COLUMNS, **options):
    result = compare.compare_rows(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), **options)
    return [(r.start_row, r.end_row) for r in result.ranges.orderBy("start_row").collect()], result


@pytest.mark.parametrize("block", [1 << 20, 2])
def test_row_ranges(spark, block):
    found, result = ranges_of(spark, A, B, block_rows=block)
    assert found == [(1, 1), (3, 4)]
    lines = [r.a_line for r in result.pairs.orderBy("row_idx").collect()]
    assert lines[0] == "Row 1: Component=Common-Cleaner, CPU_Time=1500, Memory_MB=120, Status=Running"
    section = compare.range_sections(result).where("range_start = 2").head()
    assert len(section.a_line) == 2 and section.b_line[1].startswith("Row 4: ")


def test_rows_beyond_the_shorter_file(spark):
    found, result = ranges_of(spark, A, B[:3])
    assert found == [(1, 1), (3, 5)]
    assert [r.b_line for r in result.pairs.orderBy("row_idx").collect()][-1] == "Row 5: [FILE B ENDS]"


def test_equal_empty_and_unrelated_tables(spark):
    assert ranges_of(spark, A, A)[0] == []
    assert ranges_of(spark, A, [])[0] == []
    a = spark.createDataFrame([(1, 0)], "x int, row_idx long")
    b = spark.createDataFrame([(1, 0)], "y int, row_idx long")
    assert compare.compare_rows(a, b).ranges.count() == 0


def test_missing_values_are_equal_and_headers_trimmed(spark):
    a = spark.createDataFrame([(None, 0), (" v ", 1)], "` x` string, row_idx long")
    b = spark.createDataFrame([(None, 0), ("v", 1)], "x string, row_idx long")
    assert compare.compare_rows(a, b).ranges.count() == 0


def test_row_ranges_equal_brute_force(spark):
    random.seed(7)
    a = [("f", random.randint(0, 2), i) for i in range(200)] + [("g", 1, i) for i in range(3)] + [("h", 1, 0)]
    b = [("f", random.randint(0, 2), i) for i in range(230)] + [("g", 1, i) for i in range(3)]
    left = spark.createDataFrame(a, "file string, v int, row_idx long")
    right = spark.createDataFrame(b, "file string, v int, row_idx long")
    result = compare.compare_rows(left, right, ["file"], block_rows=16)
    got = sorted((r.file, r.start_row, r.end_row) for r in result.ranges.collect())
    va, vb = [x[1] for x in a if x[0] == "f"], [x[1] for x in b if x[0] == "f"]
    expected, start = [], None
    for i in range(231):
        differs = i < 230 and (i >= 200 or va[i] != vb[i])
        if differs and start is None:
            start = i
        if not differs and start is not None:
            expected.append(("f", start + 1, i))
            start = None
    assert got == expected


PROFILE = "Name string, `Total Time` string, `Total Time (CPU)` string, Hits string, row_idx long"


def profile(spark, rows_):
    return spark.createDataFrame([(n, t, t, "1", i) for i, (n, t) in enumerate(rows_)], PROFILE)


def test_run_conflicts(spark):
    a = profile(
        spark,
        [("m1", "10.0 ms"), ("m2", "10.0 ms"), ("m3", "1000 ms"), ("m4", "1000 ms"), ("m5", "0.0 ms"), ("onlyA", "5 ms"),
         ("m6", "5 ms"), ("dup", "1 ms"), ("java.util.X", "1 ms"), ("dup", "100 ms"), ("  m1", "1 ms")],
    )
    b = profile(
        spark,
        [("m1", "10.9 ms"), ("m2", "11.5 ms"), ("m3", "1040 ms"), ("m4", "1200 ms"), ("m5", "1.5 s"), ("m6", "?"),
         ("onlyB ", None), ("dup", "300 ms"), ("java.lang.Y", "9 ms"), ("  m1", "1 ms")],
    )
    got = {(r.function_name, r.stack_level): r for r in compare.compare_runs(a, b).collect()}
    assert set(got) == {("m2", 0), ("m4", 0), ("m5", 0), ("onlyA", 0), ("onlyB", 0), ("dup", 0)}
    assert (got["m2", 0].conflict_type, got["m2", 0].time_delta, got["m2", 0].severity) == ("time_diff", 1.5, "low")
    assert got["m4", 0].severity == "medium" and got["m5", 0].severity == "high"
    assert (got["onlyA", 0].conflict_type, got["onlyA", 0].severity, got["onlyA", 0].time_delta) == ("content_diff", "medium", None)
    assert got["onlyB", 0].file_b_content == "onlyB " and got["onlyB", 0].line_number == 7
    assert got["dup", 0].line_number == 8 and got["dup", 0].file_a_time == 100.0
    totals = runs.conflict_totals(compare.compare_runs(a, b)).head()
    assert totals.summary == "Found 6 conflicts: 2 content differences, 4 timing differences, 0 both"
    none = runs.conflict_totals(compare.compare_runs(a, a)).head()
    assert none.total_conflicts == 0 and none.summary.startswith("No conflicts")


def test_run_diff_mirrors(spark):
    random.seed(3)
    make = lambda: profile(spark, [(" " * random.randint(0, 2) + f"f{random.randint(0, 40)}", f"{random.randint(0, 99)} ms") for _ in range(80)])
    a, b = make(), make()
    one = {(r.function_name, r.stack_level): r for r in compare.compare_runs(a, b).collect()}
    two = {(r.function_name, r.stack_level): r for r in compare.compare_runs(b, a).collect()}
    # significance depends on the first time, so mirror only the one-sided calls exactly
    sided = lambda d: {k for k, r in d.items() if r.conflict_type == "content_diff"}
    assert sided(one) == sided(two)
    for k in set(one) & set(two):
        assert one[k].time_delta == (None if two[k].time_delta is None else -two[k].time_delta)


def test_column_detection(spark):
    df = profile(spark, [("m", "131,697 ms (-0%)")])
    found = runs.detect_columns(df)
    assert (found.name, found.total_time, found.cpu_time, found.hits) == ("Name", "Total Time", "Total Time (CPU)", "Hits")
    assert found.has_percentage and found.time_unit == "ms"
    assert runs.detect_columns(profile(spark, [("m", "2 s")])).time_unit == "s"
    with pytest.raises(ValueError):
        runs.profile_rows(spark.createDataFrame([(1, 0)], "x int, row_idx long"))


def test_hotspots(spark):
    schema = "name string, total_time string, row_idx long"
    calls_a = [("p.A.m1", "50 ms"), ("p.A.m2", "10 ms"), ("p.A.m3", "30 ms"), ("p.A.gone", "8 ms"), ("x", "0 ms"), ("java.util.X.y", "9 ms")]
    calls_b = [("p.A.m3", "45 ms"), ("p.A.m1", "100 ms"), ("p.A.m2", "30 ms"), ("p.A.new", "8 ms"), ("p.A.tiny", "0.1 ms"), ("p.A.m1", "1 ms")]
    a, b = ([(f"{n} ()", t, i) for i, (n, t) in enumerate(c)] for c in (calls_a, calls_b))
    result = compare.compare_rows(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    spots = hotspots.find_hotspots(result.pairs)
    got = [(r.function_name, r.time_delta, r.regression_factor, r.impact_score) for r in spots.orderBy(*hotspots.impact_order()).collect()]
    assert got == [
        ("A.m1", 50.0, 2.0, 50.0),
        ("A.m2", 20.0, 3.0, 40.0),
        ("A.new", 8.0, float("inf"), 16.0),
        ("A.m3", 15.0, 1.5, 15.0),
        ("A.gone", -8.0, 0.0, 8.0),
    ]
    tail = hotspots.remaining_hotspots(spots, 2).head()
    assert (tail.additional, tail.highest_impact, tail.lowest_impact) == (3, 16.0, 8.0)
    assert hotspots.remaining_hotspots(spots, 5).count() == 0
    with pytest.raises(ValueError):
        hotspots.find_hotspots(compare.compare_rows(spark.createDataFrame(A, COLUMNS), spark.createDataFrame(B, COLUMNS)).pairs)


def test_line_changes(spark):
    schema = "f string, t string, row_idx long"
    a = spark.createDataFrame([("pool", "10 ms (5%)", 0), ("x", "1 ms (1%)", 1)], schema)
    b = spark.createDataFrame([("pool", "15 ms (5%)", 0), ("y", "1 ms (1%)", 1)], schema)
    changes = rows.line_changes(compare.compare_rows(a, b).pairs).orderBy("row_idx").collect()
    assert [(c.timing_change, c.function_change, c.thread_change) for c in changes] == [(True, False, True), (False, True, False)]
    assert changes[0].delta == 5.0 and changes[0].delta_percent == 50.0


def test_conflict_chunks_equal_brute_force(spark):
    random.seed(11)
    kinds = ["Self time, 0.0 ms (0%), 0.0 ms (0%), 1", "java.util.X, 5 ms (1%)", "com.app.X, 5 ms (1%)", "interpreter, 3 ms (2%)", "quiet"]
    a = [(random.choice(kinds), i) for i in range(300)]
    b = [(random.choice(kinds), i) for i in range(310)]
    result = compare.compare_rows(*(spark.createDataFrame(x, "t string, row_idx long") for x in (a, b)), block_rows=32)
    chunks = compare.prepare_chunks(result, "a", "b", max_chunk_size=700, block_rows=64).orderBy("chunk_no").collect()

    def reduced(lines):
        kept, i = [], 0
        while i < len(lines):
            kind = "z" if "Self time" in lines[i] else "j" if "java." in lines[i] else "c" if "interpreter" in lines[i] else "s"
            same = lambda l: ("z" if "Self time" in l else "j" if "java." in l else "c" if "interpreter" in l else "s") == kind  # noqa: E731, E741, B023
            j = i
            while j < len(lines) and same(lines[j]):
                j += 1
            group = lines[i:j]
            if kind == "z":
                kept += [f"[COMPRESSED] {len(group)}x repeated 'Self time, 0.0 ms' entries (noise removed)"] if len(group) >= 3 else group
            elif kind == "c":
                kept += [f"[COMPRESSED] {len(group)}x JVM compilation entries (system internals)"] if len(group) >= 2 else group
            elif kind == "s":
                kept += group
            i = j
        return [
            x for x in kept
            if ("[COMPRESSED]" in x or not any(w in x.lower() for w in ("0.0 ms (0%)", "interpreter")))
            and any(w in x for w in ("ms (", "%)", "hits", "[COMPRESSED]"))
        ]

    sections, raw = [], 0
    pairs = {r.row_idx: r for r in result.pairs.collect()}
    for no, r in enumerate(result.ranges.orderBy("start_row").collect(), 1):
        rows_ = [pairs[i] for i in range(r.start_row - 1, r.end_row)]
        left, right = [p.a_line for p in rows_], [p.b_line for p in rows_]
        raw += len("\n".join(left)) + len("\n".join(right))
        sections.append(
            f"\nCONFLICT RANGE #{no} (Rows {r.start_row}-{r.end_row}):\n\nFile A (a):\n" + "\n".join(reduced(left))
            + "\n\nFile B (b):\n" + "\n".join(reduced(right))
            + f"\n\nConflict Type: {r.conflict_type}\nDescription: {r.description}\n{'=' * 80}\n"
        )
    text = "\n".join(sections)
    assert "\n".join(c.text for c in chunks) == text
    assert all(len(c.text) < 700 for c in chunks) and len(chunks) > 3
    saved = compare.compression(result, compare.prepare_chunks(result, "a", "b", 700, 64)).head()
    assert (saved.raw_chars, saved.reduced_chars) == (raw, len(text))


def test_summary_and_export(spark, tmp_path):
    _, result = ranges_of(spark, A, B)
    summary = compare.comparison_summary(result.ranges, "a.csv", "b.csv").head()
    assert summary.conflict_count == 2 and summary.has_differences
    compare.export_conflicts(result, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "ranges")).count() == 2
    text = compare.fast_summary(result, "a.csv", "b.csv").head().summary
    assert "- Total conflicts: 2" in text and text.startswith("# STRUCTURED DIFF SUMMARY")
