import random

import pytest
from pyspark.sql import functions as F

from rundiff.functions import advice, numbers, profile, scores, text


def apply(spark, values, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_timing_text(spark):
    cells = ["131,697 ms (-0%)", "0.0 ms (0%)", "1,234.56 ms (+15%)", "2.5 s (100%)", "1500", None, "", "-3 ms"]
    assert apply(spark, cells, profile.timing_ms) == [131697.0, 0.0, 1234.56, 2500.0, None, None, None, 3.0]
    legacy = apply(spark, ["131,697 ms (-0%)", "2.5 s", None], lambda c: profile.timing_ms(c, legacy=True))
    assert legacy == [697.0, 0.0, 0.0]
    assert apply(spark, ["12", "x 7 y", "none", None], profile.hit_count) == [12.0, 7.0, 1.0, 1.0]
    percent = apply(spark, ["a 1.5 ms (3%), 2 ms (4%)", "1 ms (-0%)", "1 ms (+15%)"], profile.percent_timing_ms)
    assert percent == [1.5, None, None]


def test_names_and_levels(spark):
    names = ["Common-Cleaner", " jdk.internal.X.run ()", "  a.b ()  ", "    Self time", None, "", "   "]
    assert apply(spark, names, profile.stack_level) == [0, 1, 2, 4, 0, 0, 3]
    expected = ["Common-Cleaner", "jdk.internal.X.run ()", "a.b ()", "Self time", "unknown", "unknown", ""]
    assert apply(spark, names, profile.function_name) == expected


@pytest.mark.parametrize(
    "name, internal",
    [
        ("java.awt.EventQueue.dispatch", True),
        ("javax.swing.JComponent.paint", True),
        ("java.security.AccessController", True),
        ("sun.security.Provider", True),
        ("com.sun.internal.Thing", True),
        ("jdk.internal.misc.X", True),
        ("oracle.jdbc.Driver", True),
        ("com.oracle.graal.Y", True),
        ("  JAVA.Util.List", True),
        ("com.mycompany.java.util.X", False),
        ("org.springframework.boot.X", False),
        ("chs.caf.Frame", False),
        ("net.sf.ehcache.Cache", False),
        ("javaxx.Thing", False),
        ("", False),
        (None, False),
    ],
)
def test_jdk_names(spark, name, internal):
    assert apply(spark, [name], profile.is_jdk_internal) == [internal]


def test_jdk_text(spark):
    lines = ["a java.util.x", "x SUN.y", "samsun.z", "plain"]
    assert apply(spark, lines, profile.mentions_jdk) == [True, True, True, False]
    assert apply(spark, lines, profile.jdk_bucket) == ["Util", "System", "Sun", "System"]


def test_frame_parts(spark):
    calls = ["java.awt.EventQueue.dispatch(EventQueue.java:101)", "a.b.C.m ()", "C.m", "nothing"]
    parts = [tuple(r) for r in apply(spark, calls, profile.frame_parts)]
    assert parts == [("EventQueue", "dispatch", "101"), ("C", "m", None), ("C", "m", None), ("Unknown", "nothing", None)]
    legacy = apply(spark, ["a.b.C.m ()"], lambda c: profile.frame_parts(c, legacy=True))
    assert tuple(legacy[0]) == ("a", "b", None)


def test_first_field_and_headings(spark):
    lines = ['"a ""q"" b",2', '"  x', "y,z", "", '"abc""d', '"a"""', None]
    assert apply(spark, lines, text.first_field) == ['a "q" b', "  x", "y", "", 'abc""d', 'a"', ""]
    values = ["Common", " Sub", "\tSub", "Self time", "'Quoted'", "éa", "Éa", "", None, "9x"]
    line = [True, False, False, False, True, False, True, False, False, False]
    assert apply(spark, values, text.is_heading) == line
    table = apply(spark, values, lambda c: text.is_heading(c, "table"))
    assert table == [True, True, True, True, False, False, True, False, False, False]
    with pytest.raises(ValueError):
        text.is_heading(F.lit("x"), "other")


def test_safe_names(spark):
    assert apply(spark, ["a/b\\c:d" + "x" * 60], text.safe_value_name) == ["a_b_c_d" + "x" * 43]
    assert apply(spark, ['RMI "x" (0)/[y] é!'], text.safe_section_name) == ["RMIx(0)_[y]é"]


def test_scores(spark):
    df = spark.createDataFrame(
        [(10.0, 10.9), (10.0, 11.5), (1000.0, 1040.0), (1000.0, 1200.0), (0.0, 1500.0), (5.0, None), (None, 5.0)],
        "a double, b double",
    )
    a, b = F.col("a"), F.col("b")
    rows = df.select(scores.is_significant(a, b), scores.severity(b - a), scores.regression_factor(a, b)).collect()
    assert [r[0] for r in rows] == [False, True, False, True, True, False, False]
    assert [r[1] for r in rows] == ["low", "low", "low", "medium", "high", "medium", "medium"]
    assert rows[5][2] == 0.0 and rows[6][2] == float("inf") and rows[3][2] == 1.2
    impact = [r[0] for r in df.select(scores.impact(a, b)).collect()]
    assert impact[5] == 5.0 and impact[6] == 10.0 and impact[3] == 200.0


def test_change_labels(spark):
    df = spark.createDataFrame([(20.0, 3.0), (-5.0, 0.5), (-8.0, 0.0), (0.0, 1.0), (8.0, float("inf"))], "d double, f double")
    labels = [r[0] for r in df.select(scores.change_label(F.col("d"), F.col("f"))).collect()]
    assert labels == ["+20.0ms (3.0x slower)", "-5.0ms (2.0x faster)", "-8.0ms (optimized)", "no change", "+8.0ms (infx slower)"]


def test_fixed_point_text_equals_python(spark):
    random.seed(1)
    values = [0.25, 1.25, 2.675, 12.35, 0.125, -0.04, 0.0, float("inf"), 1e14, 0.005]
    values += [random.randint(-9999, 9999) / 8 for _ in range(500)]
    values += [round(random.uniform(-1e4, 1e4), random.choice([1, 2, 3, 4])) for _ in range(2000)]
    one = apply(spark, values, lambda c: numbers.fixed(c, 1), "double")
    two = apply(spark, values, lambda c: numbers.fixed(c, 2, signed=True), "double")
    assert one == [f"{v:.1f}" for v in values]
    assert two == [f"{v:+.2f}" for v in values]


def test_advice_precedence(spark):
    df = spark.createDataFrame(
        [
            ("EventQueue", "dispatchEvent", 60.0),
            ("EventQueue", "dispatchEvent", 10.0),
            ("AwtToolkit", "paint", 1.0),
            ("AwtToolkit", "x", 1.0),
            ("SocketIo", "x", 1.0),
            ("Broker", "x", 500.0),
            ("Job", "run", 11.0),
            ("Job", "run", 5.0),
            ("Job", "x", -1.0),
            ("Job", "x", 150.0),
        ],
        "c string, m string, d double",
    )
    texts = [r[0] for r in df.select(advice.recommendation(F.col("c"), F.col("m"), F.col("d"))).collect()]
    starts = ["Blocked", "Event processing", "Rendering", "UI thread", "I/O", "Message", "Algorithmic", "Minor", "Performance imp", "Significant"]
    assert all(t.startswith(s) for t, s in zip(texts, starts, strict=True)), texts
