"""The registered queries over the smallest tables, against SQL or plain Python."""

import hashlib
import os
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from rundiff.llm import queries as q
from tests.llm import plain
from tools.check import rows_of

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{FOLDER}/{file}')")
    return connection


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_against_sql(spark, duck, name):
    df = q.QUERIES[name](spark, FOLDER)
    result = duck.execute(q.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_personal_data(spark, texts):
    rows = {r.doc_id: r for r in q.op2_pii(spark, FOLDER).collect()}
    assert rows.keys() == texts.keys()
    for key, text in texts.items():
        spans = plain.pii(text)
        assert rows[key].base_sha256 == hashlib.sha256(plain.told(spans).encode()).hexdigest()
        assert [rows[key][f"n_{k}"] for k in plain.KINDS] == [sum(s[0] == k for s in spans) for k in plain.KINDS]
        assert set(plain.told(spans).split(",")) <= set(rows[key].spans.split(","))


def test_secrets(spark, texts):
    rows = {r.doc_id: r for r in q.op3_secret_scan(spark, FOLDER).collect()}
    assert rows.keys() == texts.keys()
    for key, text in texts.items():
        spans = plain.secrets(text)
        assert rows[key].base_sha256 == hashlib.sha256(plain.told(spans).encode()).hexdigest()
        assert [rows[key][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q.tokenizer_path())
    rows = q.op4_best_fit_packing(spark, FOLDER).collect()
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for key, text in texts.items():
        assert sorted(got[key]) == plain.pieces([*tokenizer.encode(text, add_special_tokens=False).ids, 1])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 4096) * 1.02 + 1


def test_repeated_passages(spark, texts):
    """Every run of 51 words that two documents share is covered; nothing else is found but fuzzy copies."""
    words = {k: plain.words(t) for k, t in texts.items()}
    where = defaultdict(set)
    for key, w in words.items():
        for i in range(len(w) - 50):
            where[tuple(w[i : i + 51])].add(key)
    got = defaultdict(set)
    for r in q.op5_repeated_passages(spark, FOLDER).collect():
        assert r.partner_id != r.doc_id and r.n_words >= 51
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
        mine, theirs = words[r.doc_id][r.start_word : r.end_word], set(words[r.partner_id])
        assert sum(w in theirs for w in mine) >= 0.7 * len(mine)
    for key, w in words.items():
        for i in range(len(w) - 50):
            if len(where[tuple(w[i : i + 51])]) > 1:
                assert set(range(i, i + 51)) <= got[key]


def test_language(spark, texts):
    rows = q.op7_language(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.kept == (bool(plain.words(texts[r.doc_id]))) for r in rows)
    assert sum(r.language == r.declared for r in rows) >= 0.98 * len(rows)


def test_mix(spark, texts):
    rows = q.op8_source_mix(spark, FOLDER).collect()
    again = q.op8_source_mix(spark, FOLDER).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source").collect()}
    order = sorted(set(sources.values()))
    size = defaultdict(int)
    for key, text in texts.items():
        size[sources[key]] += len(plain.words(text))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # share, cut off what is above, share the rest again
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * size[s] if s in capped else left * weight[s] / total for s in order}
        above = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not above:
            break
        capped |= above
    taken = defaultdict(int)
    for r in rows:
        assert r.size == len(plain.words(texts[r.doc_id])) and r.source_size == size[sources[r.doc_id]]
        assert abs(r.target - target[sources[r.doc_id]]) < 1e-6
        assert r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        taken[sources[r.doc_id]] += r.taken
    for s in order:
        assert taken[s] <= target[s] + 1e-6
        assert target[s] - taken[s] <= 0.1 * target[s]


def test_nearest_neighbours(spark):
    rows = q.op9_nearest_neighbours(spark, FOLDER).collect()
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in table}
    got = defaultdict(list)
    for r in rows:
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {k for k in x if k % 100 == 0}
    hits = 0
    for key, answers in got.items():
        every = sorted((float(np.sqrt(((x[key] - v) ** 2).sum())), k) for k, v in x.items() if k != key)[:10]
        assert [a[0] for a in sorted(answers)] == list(range(1, 11))
        hits += len({k for _, k in every} & {a[1] for a in answers})
        assert all(abs(a[2] - np.sqrt(((x[key] - x[a[1]]) ** 2).sum())) < 1e-12 for a in answers)
    assert hits >= 0.9 * 10 * len(got)
