"""Joins and tasks that stay in bounds where a small file holds many rows or rows that grow to many lines."""

import glob
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from rundiff.operators import methods, resolve
from rundiff.operators.lookup import look_up
from rundiff.operators.ordered import Running, running
from rundiff.session import shared_folder
from rundiff.sources import xml_events
from workload import QUERIES, inputs


def _parts(spark, folder, n):
    parts = spark.range(n).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "'b' AS p_brand", "'ECONOMY' AS p_type", "cast(id % 50 + 1 AS int) AS p_size", "1.0D AS p_retailprice")
    parts.coalesce(1).write.parquet(f"{folder}/part.parquet")


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_no_side_of_source_joins_is_broadcast(spark, tmp_path, capsys):
    _parts(spark, tmp_path, 200)
    for name in ("frame_path_suffix", "method_bodies", "call_edges", "method_dependencies", "near_calls"):
        # what is planned from file sizes; small sides that are known at run time may still be broadcast
        assert "Broadcast" not in _plan(QUERIES[name](spark, str(tmp_path)), capsys), name


def test_shuffles_grow_with_the_input(spark, tmp_path, monkeypatch):
    """Lines dealt to many tasks are not put into fewer by the shuffles and scans after it, nor put together up to 64 MB."""
    _parts(spark, tmp_path, 300)
    monkeypatch.setattr(inputs, "FILES_PER_TASK", 10)
    names = ["spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.enabled"]
    before = {c: spark.conf.get(c, None) for c in names}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        lines = inputs.sources(spark, str(tmp_path))
        assert lines.groupBy("line_no").count().rdd.getNumPartitions() >= 30
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
        inputs.sources(spark, str(tmp_path))
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16k"
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_no_side_of_a_resolution_is_broadcast(spark, capsys):
    named = spark.createDataFrame([("a.B", None), ("c.D", "x/D.java")], "class_fqn string, explicit_path string")
    catalog = resolve.file_catalog(spark.createDataFrame([("a/B.java",), ("x/D.java",)], "path string"))
    found = resolve.resolve_frames(named, catalog)
    assert "Broadcast" not in _plan(found, capsys)
    assert {(r.class_fqn, r.path, r.strategy) for r in found.collect()} == {("a.B", "a/B.java", "exact_fqn"), ("c.D", "x/D.java", "explicit_path_relative")}


def test_look_up_is_a_left_join(spark):
    asked = spark.createDataFrame([("a", 1, "p"), ("a", 1, "p"), (None, 1, "q"), (None, 2, "r"), ("b", None, "s"), ("c", 3, "t")], "k string, i int, v string")
    found = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), (None, 1, 30), ("c", 3, 40), ("c", 3, 41)], "k string, i int, w int")
    got, want = look_up(asked, found, ["k", "i"]), asked.join(found, ["k", "i"], "left")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_without_a_key_are_dealt_out(spark, capsys):
    asked, found = spark.range(8).selectExpr("if(id > 5, 'a', NULL) AS k", "id"), spark.createDataFrame([("a", 1)], "k string, w int")
    # what the exchange deals by is the key, or else a number of the row
    assert "xxhash64" in _plan(look_up(asked, found, ["k"]), capsys)


def test_inputs_are_dealt_to_tasks_by_rows(spark, tmp_path, monkeypatch):
    _parts(spark, tmp_path, 200)
    monkeypatch.setattr(inputs, "FILES_PER_TASK", 10, raising=False)
    for lines in (inputs.sources(spark, str(tmp_path)), inputs.long_sources(spark, str(tmp_path))):
        per_task = lines.select("path", F.spark_partition_id().alias("task")).distinct().groupBy("task").count().collect()
        assert len(per_task) >= 15 and max(r["count"] for r in per_task) <= 40


def test_trace_lines_are_dealt_to_tasks_by_rows(spark, tmp_path, monkeypatch):
    _parts(spark, tmp_path, 200)
    spark.range(2000).selectExpr("id AS l_orderkey", "id % 200 AS l_partkey", "cast(id % 7 + 1 AS int) AS l_linenumber").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(inputs, "LINES_PER_TASK", 100, raising=False)
    per_task = inputs.trace_lines(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in per_task) == 2000 and len(per_task) >= 15 and max(r["count"] for r in per_task) <= 300


def test_field_lines(spark):
    texts = ["    int a;", "a = 1;", "  x y(z);", "private int b = 2;", "public  final int  c\t=", " int é d ;", "  return;", "\tint e1 ;x", " a b\r= c", "  (a) ;", " _ _;", "public static f;", "privat g h;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.f for r in df.select("t", (F.col("t").rlike(methods.FIELD_PART) & F.col("t").rlike(methods.FIELD_PATTERN)).alias("f")).collect()}
    assert got == {r.t: r.f for r in df.select("t", F.col("t").rlike(methods.FIELD_PATTERN).alias("f")).collect()}
    assert any(got.values()) and not all(got.values())
    # the cube of this indent is 1.6 * 10 ** 13 steps
    wide = spark.createDataFrame([("p/A.java", 1, "class A {"), ("p/A.java", 2, " " * 25_000 + "call(x)"), ("p/A.java", 3, "  int a;")], "path string, line_no long, text string")
    assert [r.text for r in methods.class_fields(wide).collect()] == ["int a;"]


def test_a_language_is_written_by_several_tasks(spark, tmp_path):
    rows = [(i, f"text {i}", "en") for i in range(40)]
    for _ in range(4):
        spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.mode("append").option("parquet.block.size", 1024).parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        before = set(glob.glob(f"{re.sub('^file:', '', shared_folder(spark))}/rundiff-listing-*"))
        got = {r.extension: (r.files, r.bytes) for r in QUERIES["listing"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (folder,) = set(glob.glob(f"{re.sub('^file:', '', shared_folder(spark))}/rundiff-listing-*")) - before
    assert got == {"txt": (1, 4 * sum(len(t) + 1 for _, t, _ in rows)), "csv": (1, None), "json": (1, None)}
    assert len(glob.glob(f"{folder}/texts/lang=en/*.txt")) == 4


def test_a_window_by_kept_blocks_needs_no_shuffle(spark, capsys):
    rows = spark.range(100).selectExpr("id % 3 AS k", "id AS pos", "id % 7 AS v")
    summed = running(rows, ["k"], "pos", [Running("total", "sum", F.col("v"))], 16, keep_block="b")
    more = summed.withColumn("here", F.sum("total").over(Window.partitionBy("k", "b").orderBy("pos")))
    assert _plan(more, capsys).count("Exchange hashpartitioning") == _plan(summed, capsys).count("Exchange hashpartitioning")
    assert {(r.k, r.pos): r.total for r in summed.collect()} == {(i % 3, i): sum(j % 7 for j in range(i + 1) if j % 3 == i % 3) for i in range(100)}


def test_texts_of_xml_are_written_few_times(spark, tmp_path, monkeypatch):
    text = "<r>\n" + "".join(f"  <o id='{i}'>\n<s>F</s> a <!-- <t> --><t><![CDATA[{i}<&>]]></t>b</o>\n" for i in range(40)) + "</r>"
    for name in ("a.xml", "b.xml"):
        (tmp_path / name).write_text(text)
    written, cut = [], xml_events.cut_lineage
    monkeypatch.setattr(xml_events, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    whole = xml_events.read_xml_events(spark, str(tmp_path))
    # the pieces, the tags with what follows them, the tags with their owners, the elements
    assert sum("piece" in c or "text" in c for c in written) <= 4
    in_blocks = xml_events.read_xml_events(spark, str(tmp_path), block_rows=8)
    assert sorted(map(str, whole.elements.collect())) == sorted(map(str, in_blocks.elements.collect()))
    assert {(r.tag, r.text) for r in whole.elements.where("pos < 12 AND file_id LIKE '%a.xml'").collect()} == {("r", None), ("o", "a b"), ("s", "F"), ("t", "0<&>"), ("s", "F")}
    assert [r.error for r in whole.files.collect()] == [None, None]


def test_a_tag_is_matched_once(spark, tmp_path, monkeypatch, capsys):
    """Long lists of attributes cost one match of the tag, not one for each thing that is asked of it."""
    (tmp_path / "a.xml").write_bytes(b"<r\n a = '1>&amp;' b=\"/\" ><s  \xff='\xe2\x82' >\xff t\xe2\x82 &lt;</s\n><t/ ><t k='x=\"y\"'/></r>".replace(b"/ >", b" />"))
    plans, cut = [], xml_events.cut_lineage
    monkeypatch.setattr(xml_events, "cut_lineage", lambda df: plans.append(_plan(df, capsys)) or cut(df))
    found = xml_events.read_xml_events(spark, str(tmp_path))
    assert max(p.count(", ^(/") + p.count("(?s)^") for p in plans) == 1
    odd = "\ufffd"
    want = [("r", [("a", "1>&"), ("b", "/")], None), ("s", [(odd, odd)], f"{odd} t{odd} <"), ("t", [], None), ("t", [("k", 'x="y"')], None)]
    assert [(r.tag, [tuple(a) for a in r.attributes], r.text) for r in found.elements.orderBy("pos").collect()] == want
    assert [r.error for r in found.files.collect()] == [None]


def test_json_texts_equal_to_json(spark):
    texts = ["", "a", "a b<&>'/", 'q"q', "b\\b", "t\tn\nr\r", "\x00\x1f\x7f", "é\u2028😀\ufeff", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").union(spark.sql("SELECT cast(unhex('61FFE28262') AS string)"))
    rows = df.select(xml_events._json(F.col("t")).alias("a"), F.to_json(F.array("t")).alias("b")).collect()
    assert len(rows) == len(texts) + 1 and all(f"[{r.a}]" == r.b for r in rows)
