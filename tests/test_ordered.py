import random

import pytest
from pyspark.sql import functions as F

from rundiff.operators.ordered import Running, dense_index, list_pieces, running
from rundiff.operators.packing import chunk_lines, chunk_texts


@pytest.fixture(scope="module")
def documents():
    random.seed(1)
    docs = {
        d: ["x" * random.choice([0, 1, 2, 3, 7, 20 if d % 2 else 4]) for _ in range(random.choice([1, 2, 5, 300, 997]))]
        for d in range(8)
    }
    docs[100] = ["aaaa", "bb", "cccccccccc", "d", "e"]
    docs[101] = ["aaa", "bbbb"]  # eight characters: fits a limit of 8 without its last newline
    return docs


@pytest.fixture(scope="module")
def lines(spark, documents):
    rows = [(d, i, line) for d, ls in documents.items() for i, line in enumerate(ls)]
    return spark.createDataFrame(rows, "doc long, line_no long, line string").repartition(5).cache()


@pytest.mark.parametrize("block", [1 << 20, 5, 1])
def test_running_values(lines, documents, block):
    size = F.length("line").cast("long")
    specs = [
        Running("total", "sum", size),
        Running("largest", "max", F.struct(size.alias("n"), "line_no")),
        Running("next_long", "min", F.when(size > 3, F.col("line_no")), reverse=True),
        Running("previous", "max", F.struct("line_no", size.alias("n")), exclusive=True),
    ]
    got = {(r.doc, r.line_no): r for r in running(lines, ["doc"], "line_no", specs, block).collect()}
    for doc, texts in documents.items():
        total = 0
        for i, line in enumerate(texts):
            total += len(line)
            row = got[doc, i]
            assert row.total == total
            assert tuple(row.largest) == max((len(t), j) for j, t in enumerate(texts[: i + 1]))
            assert row.next_long == next((j for j in range(i, len(texts)) if len(texts[j]) > 3), None)
            assert (tuple(row.previous) if row.previous else None) == ((i - 1, len(texts[i - 1])) if i else None)


def test_dense_index_of_gapped_positions(spark):
    df = spark.createDataFrame([("a", 5), ("a", 90), ("a", 17), ("b", 3)], "k string, p long")
    got = {(r.k, r.p): r.row_idx for r in dense_index(df, ["k"], "p", block_rows=10).collect()}
    assert got == {("a", 5): 0, ("a", 17): 1, ("a", 90): 2, ("b", 3): 0}


def test_list_pieces_are_ordered_and_whole(spark):
    df = spark.range(25).selectExpr("id % 2 AS k", "id AS p", "cast(id as string) AS v")
    rows = list_pieces(df, ["k"], "p", ["v"], 5, block_rows=4).orderBy("k", "piece_no").collect()
    assert max(len(r.v) for r in rows) == 5
    assert [v for r in rows if r.k == 0 for v in r.v] == [str(i) for i in range(0, 25, 2)]


def greedy(texts, limit):
    if len("\n".join(texts)) <= limit:
        return [0] * len(texts)
    out, chunk, size, count = [], 0, 0, 0
    for line in texts:
        cost = len(line) + 1
        if size + cost > limit and count:
            chunk, size, count = chunk + 1, cost, 1
        else:
            size, count = size + cost, count + 1
        out.append(chunk)
    return out


@pytest.mark.parametrize("limit, block, fan", [(8, 1 << 18, 256), (8, 4, 2), (8, 7, 3), (30, 10, 4), (50, 3, 2), (8, 1, 2)])
def test_packing_equals_greedy(lines, documents, limit, block, fan):
    got = {}
    for r in chunk_lines(lines, ["doc"], max_chunk_size=limit, block_lines=block, fan_out=fan).collect():
        got.setdefault(r.doc, {})[r.line_no] = r.chunk_no
    for doc, texts in documents.items():
        assert [got[doc][i] for i in range(len(texts))] == greedy(texts, limit), doc


def test_packing_without_keys(lines, documents):
    one = lines.where("doc = 3").drop("doc")
    got = chunk_lines(one, max_chunk_size=9, block_lines=5, fan_out=2).orderBy("line_no").collect()
    assert [r.chunk_no for r in got] == greedy(documents[3], 9)


def test_chunks_rejoin_to_the_text(lines, documents):
    chunks = chunk_texts(chunk_lines(lines, ["doc"], max_chunk_size=30), ["doc"]).orderBy("chunk_no").collect()
    for doc, texts in documents.items():
        assert "\n".join(c.text for c in chunks if c.doc == doc) == "\n".join(texts)
    assert all(c.char_count < 30 or c.line_count == 1 for c in chunks)


def test_task_functions_do_not_need_the_package():
    import subprocess
    import sys

    from pyspark import cloudpickle

    from rundiff.operators import packing

    functions = [packing._describe_block(8), packing._compose_group(8, 2), packing._enter_children(8)]
    functions += [packing._renamed(f, ["k"]) for f in functions] + [packing._number_lines(8)]
    code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read()); assert 'rundiff' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(functions), check=True, cwd="/")


@pytest.mark.parametrize("height", [2, 3, 5])
def test_running_values_over_several_levels(spark, height):
    """Blocks of three rows, so that the totals of blocks have blocks of their own."""
    rng = random.Random(height)
    rows = [(k, i, rng.choice([None, rng.randint(-9, 9)])) for k in "ab" for i in sorted(rng.sample(range(3**height if height > 2 else 9), 9))]
    specs = [
        Running("total", "sum", F.col("v")),
        Running("before", "sum", F.col("v"), exclusive=True),
        Running("high", "max", F.col("v"), exclusive=True),
        Running("low", "min", F.col("v"), reverse=True),
    ]
    got = {(r.k, r.i): (r.total, r.before, r.high, r.low) for r in running(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], "i", specs, 3, height).collect()}
    for k, i, v in rows:
        upto = [x for kk, j, x in rows if kk == k and j <= i and x is not None]
        past = [x for kk, j, x in rows if kk == k and j < i and x is not None]
        rest = [x for kk, j, x in rows if kk == k and j >= i and x is not None]
        assert got[k, i] == (sum(upto), sum(past), max(past, default=None), min(rest, default=None))
