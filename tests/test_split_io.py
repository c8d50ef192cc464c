import json
import random
from xml.parsers import expat

import pytest
from pyspark.sql import functions as F

from rundiff.operators import automaton, noise, split
from rundiff.plans.convert import split_and_convert
from rundiff.plans.prompts import prompt_table
from rundiff.sinks.json import convert_batch, csv_metadata, csv_records, envelope_lines, file_of_key, status_counts
from rundiff.sinks.parts import manifest_totals, write_parts
from rundiff.sources import csv, files, xml, xml_events


@pytest.fixture
def employees(spark):
    rows = [(i, f"Person {i}", 20 + i % 50, f"City_{i % 10}", ["HR", "IT", "Ops", "Law", "Fin"][i % 5], i) for i in range(100)]
    return spark.createDataFrame(rows, "ID long, Name string, Age long, City string, Department string, row_idx long")


def test_row_parts(spark, employees):
    parts = split.split_table(employees, "rows", rows_per_part=25)
    manifest = split.part_manifest(parts, ["part_id"]).orderBy("part_id").collect()
    assert [(m.row_count, m.column_count, m.first_row, m.last_row) for m in manifest] == [
        (25, 5, 1, 25), (25, 5, 26, 50), (25, 5, 51, 75), (25, 5, 76, 100)
    ]
    name = split.row_part_name("split", F.lit(0), F.lit(1), F.lit(25))
    assert spark.range(1).select(name).head()[0] == "split_part_001_rows_1_to_25.csv"
    assert parts.drop("part_id").exceptAll(employees).count() == 0
    short = split.part_manifest(split.split_by_rows(employees, 30), ["part_id"]).collect()
    assert sorted(m.row_count for m in short) == [10, 30, 30, 30]


def test_value_parts_and_errors(spark, employees):
    parts = split.split_table(employees, "column", column="Department")
    assert sorted(r["count"] for r in parts.groupBy("group_name").count().collect()) == [20] * 5
    with_null = employees.withColumn("Department", F.expr("nullif(Department, 'HR')"))
    assert split.split_by_value(with_null, "Department").where("group_value is null").count() == 20
    for bad in (lambda: split.split_by_value(employees, "Nope"), lambda: split.split_table(employees, "zigzag"),
                lambda: split.split_by_rows(employees, 0)):
        with pytest.raises(ValueError):
            bad()


def test_size_parts(spark, employees):
    size = F.lit(1024)
    parts = split.split_table(employees, "size", max_mb=0.01, row_bytes=size)
    assert parts.select("rows_per_part").distinct().collect()[0][0] == 10
    assert parts.select("part_id").distinct().count() == 10
    assert split.split_by_size(employees, max_mb=0.0001, row_bytes=size).head().rows_per_part == 1
    assert split.split_by_size(employees.limit(0), row_bytes=size).count() == 0


def test_table_profile(spark, employees):
    fifty = split.table_profile(employees.limit(50)).head()
    assert (fifty.total_rows, fifty.total_columns, fifty.recommended_rows_per_file, fifty.estimated_output_files) == (50, 5, 10, 5)
    empty = split.table_profile(employees.limit(0)).head()
    assert (empty.total_rows, empty.recommended_rows_per_file, empty.estimated_output_files) == (0, 1, 1)
    counts = {0: 1, 4: 1, 100: 20, 101: 100, 1000: 100, 1001: 500, 10000: 500, 10001: 1000, 100000: 1000, 100001: 2000}
    df = spark.createDataFrame([(n,) for n in counts], "n long")
    assert {r.n: r.r for r in df.select("n", split.recommended_rows(F.col("n")).alias("r")).collect()} == counts
    assert [r.column_name for r in split.column_profile(employees).orderBy("position").collect()][:2] == ["ID", "Name"]
    assert [r.ID for r in split.preview(employees, 3).collect()] == [0, 1, 2]


@pytest.mark.parametrize("block", [1 << 20, 2])
def test_sections(spark, block):
    names = ["Common-Cleaner", "  Sub-process 1", "  Sub-process 2", "RMI Scheduler (0)", "  Background Task"]
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "Name string, row_idx long")
    assert split.split_by_sections(table, "Name", variant="table", block_rows=block).select("section_id").distinct().count() == 5
    quoted = table.select(F.concat(F.lit('"'), "Name", F.lit('",1')).alias("line"), "row_idx")
    sections = split.split_lines_by_sections(quoted, block_rows=block)
    got = {r.row_idx: (r.section_id, r.heading) for r in sections.collect()}
    assert got == {0: (1, "Common-Cleaner"), 1: (1, "Common-Cleaner"), 2: (1, "Common-Cleaner"), 3: (2, "RMI Scheduler (0)"), 4: (2, "RMI Scheduler (0)")}
    bare = split.split_lines_by_sections(table.select(F.concat("Name", F.lit(",1")).alias("line"), "row_idx"), block_rows=block)
    assert bare.select("section_id").distinct().count() == 5
    early = spark.createDataFrame([("low", 0), ("   ", 1), ("Up", 2)], "line string, row_idx long")
    assert [r.row_idx for r in split.split_lines_by_sections(early).collect()] == [2]
    assert split.choose_section(sections, 2).count() == 2


def test_noise(spark):
    zero = "Self time, 0.0 ms (0%), 0.0 ms (0%), 1"

    def reduced(lines, block=1 << 20):
        df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
        return [r.line for r in noise.reduce_noise(df, block_rows=block).orderBy("line_no").collect()]

    assert reduced([zero] * 4) == ["[COMPRESSED] 4x repeated 'Self time, 0.0 ms' entries (noise removed)"]
    assert reduced([zero, "", zero, " ", zero], block=2) == ["[COMPRESSED] 3x repeated 'Self time, 0.0 ms' entries (noise removed)"]
    assert reduced([zero] * 2) == []
    assert reduced(["java.util.X, 5 ms (1%)", "com.app.X, 5 ms (1%)", "com.app.Y, 10.0 ms (0%)", "nothing"]) == ["com.app.X, 5 ms (1%)"]
    assert reduced(["c1 compilation a, 1 ms (2%)"] * 2) == ["[COMPRESSED] 2x JVM compilation entries (system internals)"]
    df = spark.createDataFrame([(i, zero) for i in range(2)], "line_no long, line string")
    assert noise.compress_runs(noise.line_runs(df)).count() == 2


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_csv_rows_keep_file_order_over_splits(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 10)):
        write(tmp_path / f"{name}.csv", "Name,V\n" + "".join(f'"  row {i}",{i}\n' for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = csv.read_csv(spark, str(tmp_path))
        assert df.where("row_idx <> V").count() == 0
        assert df.count() == 3010 and df.where("V = 7").head().Name == "  row 7"
        lines = files.read_csv_lines(spark, str(tmp_path / "a.csv"))
        assert lines.where(F.col("line") != F.concat(F.lit('"  row '), "row_idx", F.lit('",'), "row_idx")).count() == 0
        assert lines.select("header").distinct().head()[0] == "Name,V"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_encodings_quotes_and_types(spark, tmp_path):
    write(tmp_path / "utf.csv", "\ufeffName,Age,Ok,Price,Note\nJosé,25,True,1.5,NA\nZoë,,False,2,x\n")
    write(tmp_path / "latin.csv", "Name,Age,Ok,Price,Note\nFrançois,30,True,3,São Paulo\n", "latin-1")
    write(tmp_path / "multi.csv", 'Name,Age,Ok,Price,Note\n"Two\nlines",1,True,4,"say ""hi"", now"\n')
    probed = {r.file_id.rsplit("/", 1)[1]: r for r in csv.probe_files(spark, str(tmp_path)).collect()}
    assert probed["utf.csv"].encoding == "UTF-8" and probed["latin.csv"].encoding == "ISO-8859-1"
    assert probed["multi.csv"].multi_line and not probed["utf.csv"].multi_line
    df = csv.read_csv(spark, str(tmp_path))
    types = dict(df.dtypes)
    assert (types["Age"], types["Ok"], types["Price"], types["Note"]) == ("bigint", "boolean", "double", "string")
    rows = {r.Name: r for r in df.collect()}
    assert set(rows) == {"José", "Zoë", "François", "Two\nlines"}
    assert rows["José"].Note is None and rows["Zoë"].Age is None and rows["Two\nlines"].Note == 'say "hi", now'
    assert dict(csv.read_csv(spark, str(tmp_path / "utf.csv"), infer=False).dtypes)["Age"] == "string"


def test_json_envelope(spark, tmp_path):
    write(tmp_path / "p.csv", 'Name,Age,City\nA,25,"x ""y"""\nB,30,\nC,35,z\n')
    df = csv.read_csv(spark, str(tmp_path))
    lines = envelope_lines(csv_records(df), csv_metadata(df)).orderBy("pos").collect()
    document = json.loads("".join(r.text for r in lines))
    assert document["metadata"]["total_records"] == 3 and document["metadata"]["columns"] == ["Name", "Age", "City"]
    assert document["data"][0] == {"Name": "A", "Age": 25, "City": 'x "y"'} and document["data"][1]["City"] == ""
    bare = "".join(r.text for r in envelope_lines(csv_records(df)).orderBy("pos").collect())
    assert len(json.loads(bare)) == 3


XML = """<?xml version="1.0"?>
<employees><employee id="1"><name>Ann</name><age>30</age></employee><employee id="2"><name>Bo</name><age>40</age></employee></employees>"""


def test_xml(spark, tmp_path):
    write(tmp_path / "e.xml", XML)
    assert xml.root_elements(spark, str(tmp_path)).head().root_element == "employees"
    root = xml.read_xml(spark, str(tmp_path), "employees").head()
    assert [e.name for e in root.employee] == ["Ann", "Bo"] and root.employee[0]["@id"] == "1"
    rows = xml.read_xml(spark, str(tmp_path), "employee").orderBy("@id").collect()
    assert [r.age for r in rows] == ["30", "40"]


def test_batch_conversion(spark, tmp_path):
    write(tmp_path / "in" / "a.csv", "X,Y\n1,2\n")
    write(tmp_path / "in" / "b.CSV", "Q\nv\n")
    write(tmp_path / "in" / "c.xml", XML)
    write(tmp_path / "in" / "bad.xml", "<employees><employee></employees>")
    write(tmp_path / "in" / "d.txt", "no")
    status = convert_batch(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r.filename: (r.status, r.error) for r in status.collect()}
    assert got["a.csv"] == ("Success", None) and got["b.CSV"] == ("Success", None) and got["c.xml"] == ("Success", None)
    assert got["bad.xml"][0] == "Failed" and got["d.txt"] == ("Failed", "Unsupported file type: .txt")
    assert {r.status: r.files for r in status_counts(status).collect()} == {"Success": 3, "Failed": 2}
    texts = ["".join(p.read_text() for p in sorted(f.glob("part-*"))) for f in (tmp_path / "out").glob("csv/file=*")]
    documents = [json.loads(t) for t in texts]
    assert sorted(d["metadata"]["total_records"] for d in documents) == [1, 1]
    assert {"X": 1, "Y": 2} in [d["data"][0] for d in documents]
    written = json.loads(spark.read.text(str(tmp_path / "out" / "xml")).head()[0])
    assert written["metadata"]["root_element"] == "employees"
    assert written["data"]["employees"]["employee"][1]["name"] == "Bo"


def test_batch_conversion_of_odd_files(spark, tmp_path):
    files_in = {
        "typed.csv": "Name,Age\nA,25\n",
        "texts.csv": "Name,Age\nB,old\n",
        "ragged.csv": "Name,Age\nz,1,EXTRA\n",
        "short.csv": "Name,Age,City\nq\n",
        "head.csv": "Name,Age\n",
        "empty.csv": "",
        "open.csv": 'Name,Age\n"x,1\n',
        "a b_c.csv": 'K,V\n\n"two\nlines, ""q""",NA\n\nx,True\n',
        "none.xml": "",
    }
    for name, text in files_in.items():
        write(tmp_path / "in" / name, text)
    status = {r.filename: r for r in convert_batch(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert set(status) == set(files_in)
    good = {name for name, r in status.items() if r.status == "Success"}
    assert good == {"typed.csv", "texts.csv", "short.csv", "head.csv", "a b_c.csv"}
    assert "saw 3" in status["ragged.csv"].error and status["empty.csv"].error == "no columns to parse"
    data = {}
    for name in good:
        folder = tmp_path / "out" / status[name].output
        data[name] = json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))
    assert len({r.output for r in status.values() if r.output}) == len(good)
    assert data["typed.csv"]["data"] == [{"Name": "A", "Age": 25}] and data["texts.csv"]["data"] == [{"Name": "B", "Age": "old"}]
    assert data["short.csv"]["data"] == [{"Name": "q", "Age": "", "City": ""}]
    assert data["head.csv"] == {"metadata": {"source_file": "head.csv", "total_records": 0, "columns": ["Name", "Age"], "file_type": "csv"}, "data": []}
    assert data["a b_c.csv"]["data"] == [{"K": 'two\nlines, "q"', "V": ""}, {"K": "x", "V": True}]
    assert {r.filename: spark.range(1).select(file_of_key(F.lit(r.output.split("=")[1]))).head()[0] for r in status.values() if r.output} == {n: n for n in good}


def test_written_parts_and_manifest(spark, employees, tmp_path):
    manifest = split_and_convert(employees, str(tmp_path / "out"), "rows", rows_per_part=30).collect()
    assert sorted(m.row_count for m in manifest) == [10, 30, 30, 30]
    assert all(m.column_count == 5 and m.file_size_bytes > 0 for m in manifest)
    assert sorted((m.part_no, m.filename) for m in manifest)[0] == (1, "split_part_001_rows_1_to_30.csv")
    totals = manifest_totals(spark.createDataFrame(manifest), "x.csv").head()
    assert (totals.total_split_files, totals.total_rows) == (4, 100)
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "csv" / "part=v0"))
    assert [r.ID for r in back.collect()] == [str(i) for i in range(30)]
    records = spark.read.text(str(tmp_path / "out" / "json" / "part=v3"))
    assert json.loads(records.head().value)["ID"] == 90
    write_parts(split.split_by_value(employees, "Department").drop("group_value"), ["group_name"], str(tmp_path / "v"))
    assert spark.read.option("header", True).csv(str(tmp_path / "v" / "group_name=IT")).count() == 20


def test_parts_of_values_and_files_stay_apart(spark, tmp_path):
    """Values that share a shortened name, NULL and the empty text, and equal values of two files are parts of their own."""
    long = "x" * 50
    values = [long + "1", long + "2", "a/b", "a_b", None, "", "line\nbreak", "y" * 300]
    rows = [(f, v, None if v is None else "t\nu", i) for f in ("f1", "f2") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "file_id string, k string, text string, row_idx long")
    manifest = split_and_convert(df, str(tmp_path / "out"), "column", column="k").collect()
    assert len(manifest) == 2 * len(values) and all(m.row_count == 1 and m.file_size_bytes > 0 for m in manifest)
    assert sorted((m.file, m.part_no) for m in manifest) == [(f, n + 1) for f in ("f1", "f2") for n in range(len(values))]
    assert len({m.file_path for m in manifest}) == len(manifest)
    records = spark.read.text(str(tmp_path / "out" / "json")).select("value").collect()
    assert sorted(json.loads(r.value)["k"] for r in records) == sorted((v or "") for v in values for _ in range(2))


def test_listing_sources_and_traces(spark, tmp_path):
    write(tmp_path / "src" / "main" / "java" / "a b" / "T.java", "class T {\n  int x = 1;\n}\n")
    write(tmp_path / "t.log", "a.B#c\n\n  at x.Y.z()\r\n")
    listed = files.list_files(spark, str(tmp_path)).collect()
    assert [(r.file_name, r.extension, r.rejected) for r in listed] == [("t.log", "log", "Unsupported file type: .log")]
    got = [(r.path, r.line_no, r.text) for r in files.read_sources(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [("src/main/java/a b/T.java", 1, "class T {"), ("src/main/java/a b/T.java", 2, "  int x = 1;"), ("src/main/java/a b/T.java", 3, "}")]
    lines = files.read_trace_lines(spark, str(tmp_path / "t.log")).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in lines] == [(1, "a.B#c"), (3, "  at x.Y.z()")]


def test_prompts(spark):
    chunks = spark.createDataFrame([(0, "one"), (1, "two {x}")], "chunk_no long, text string")
    rows = prompt_table(chunks, "custom", file_a="a", file_b="b", question="why?").orderBy("chunk_id").collect()
    assert rows[1].chunk_id == 2 and "two {x}" in rows[1].prompt and rows[0].prompt.endswith("Question: why?")
    assert "Part 2 of 2" in prompt_table(chunks, "{part}: {text}").orderBy("chunk_id").collect()[1].prompt
    with pytest.raises(ValueError):
        prompt_table(chunks, "custom", file_a="a", file_b="b")


def plain_xml(text):
    """What an XML text is in JSON, by a streaming parser; None if it is not well-formed."""
    stack, root = [], {}

    def start(tag, attributes):
        stack.append((tag, {f"@{k}": v for k, v in attributes.items()}, []))

    def end(tag):
        _, item, texts = stack.pop()
        text = "".join(texts).strip(" \t\n\r")
        value = {**item, **({"#text": text} if text else {})} if item else text or None
        into = stack[-1][1] if stack else root
        into.setdefault(tag, []).append(value) if isinstance(into.get(tag, []), Several) else into.update({tag: value if tag not in into else Several([into[tag], value])})

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda t: stack[-1][2].append(t)
    try:
        parser.Parse(text, True)
    except expat.ExpatError:
        return None
    return root


class Several(list):
    """Elements of one tag."""


XML_FILES = {
    "plain.xml": XML,
    "mixed.xml": "<a>one <b/> two<c>\n x </c> three  </a>",
    "order.xml": "<r><a>1</a><b>2</b><a>3</a><c><a k='1'/><d/><a/></c><b/></r>",
    "refs.xml": "<r a='&lt;&quot;x&gt;y&#33;' b=\"it's\">&amp;lt; &#x1F600;&#233; \\ \"q\"</r>",
    "cdata.xml": "<?xml version='1.0'?><!-- <x> --><r><![CDATA[<y a='1'> & ]]]]><![CDATA[>]]><!-- a > b <z/> --><s>t<![CDATA[]]></s></r><!-- end -->",
    "pi.xml": "<r><?p <q> ?>k<?p?></r>\n",
    "many.xml": "<r>" + "".join(f"<i n='{i}'>{'v' * (i % 3)}<!-- <i> --></i>\n" for i in range(400)) + "</r>",
    "deep.xml": "<d>" * 5 + "x" + "</d>" * 5,
    "bom.xml": "\ufeff<r/>",
    "crossed.xml": "<a><b></a></b>",
    "open.xml": "<a><b></b>",
    "two.xml": "<a/><b/>",
    "text.xml": "<a/>x",
    "before.xml": "x<a/>",
    "twice.xml": "<a k='1' k='2'/>",
    "unclosed.xml": "<a><!-- </a>",
    "entity.xml": "<a>&nope;</a>",
    "tag.xml": "<a b=1></a>",
    "stray.xml": "<a></a></a>",
}


@pytest.mark.parametrize("split", [None, 2048])
def test_xml_events(spark, tmp_path, split):
    for name, text in XML_FILES.items():
        write(tmp_path / "in" / name, text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        events = xml_events.read_xml_events(spark, str(tmp_path / "in"), block_rows=64 if split else 1 << 20)
        pieces = xml_events.xml_json(events).orderBy("file_id", "path").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    name = lambda r: r.file_id.rsplit("/", 1)[1]
    texts = {}
    for r in pieces:
        texts[name(r)] = texts.get(name(r), "{") + r.lead + r.body + r.shut
    expected = {n: plain_xml(t) for n, t in XML_FILES.items()}
    assert {name(r) for r in events.files.collect() if r.error} == {n for n, e in expected.items() if e is None}
    assert {n: json.loads(t + "}") for n, t in texts.items()} == {n: e for n, e in expected.items() if e is not None}
    assert {n: list(json.loads(t + "}")) for n, t in texts.items()} == {n: list(e) for n, e in expected.items() if e is not None}


def test_xml_rows(spark, tmp_path):
    write(tmp_path / "o.xml", XML_FILES["order.xml"])
    pieces = xml_events.xml_json(xml_events.read_xml_events(spark, str(tmp_path)))
    got = [json.loads(r.record) for r in xml_events.xml_rows(pieces, 1).orderBy("pos").collect()]
    assert got == ["1", "2", "3", {"a": [{"@k": "1"}, None], "d": None}, None]


def test_states_along_long_sequences(spark):
    rng = random.Random(5)
    rows = [(k, i, [rng.randrange(3) for _ in range(3)]) for k in "ab" for i in range(rng.choice([1, 90]))]
    got = automaton.with_state(spark.createDataFrame(rows, "k string, i long, m array<int>"), ["k"], "i", "m", 3, width=4)
    state = {}
    found = {(r.k, r.i): r.state for r in got.collect()}
    for k, i, m in rows:
        assert found[k, i] == state.get(k, 0)
        state[k] = m[state.get(k, 0)]
