"""The pipeline on the smallest tables: the parts that have one right answer against plain Python."""

import random
import re

import corpus_pipeline
from rundiff.session import cut_lineage
from tests.llm import plain
from tests.llm.test_operators import ODD, documents, sentence

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = docs.collect()
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        kept[name] = docs.collect()
    assert {r.doc_id for r in kept["language"]} == {r.doc_id for r in first if plain.words(r.text)}

    sets = [(r.doc_id, plain.shingle_set(r.text)) for r in kept["language"]]
    roots = plain.components(sets, plain.similar)
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted({r if s else k for (k, s), r in zip(sets, roots)})

    texts = {r.doc_id: r.text for r in kept["near_duplicates"]}
    assert {r.doc_id for r in kept["personal_data"]} == set(texts)
    for r in kept["personal_data"]:
        assert not plain.pii(r.text) and r.n_chars == len(r.text)
        assert bool(plain.pii(texts[r.doc_id])) == bool(re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text))

    clean, counts = {r.doc_id: r for r in kept["personal_data"]}, {}
    for r in kept["mix"]:
        assert r == clean[r.doc_id]
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 3

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sum(r.piece == 0 for r in packed) == len(kept["mix"])
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert "sequence_id" in rows.columns and rows.count() > 0


def odd_documents(spark):
    rng = random.Random(8)
    rows = list(ODD) + [(100 + i, f"{sentence(rng, 40)} mail a{i}@b.org", "en", rng.choice(["a", None])) for i in range(30)]
    rows += [(200, rows[-1][1], "en", "a"), (129, rows[-1][1], "en", "a"), (300, sentence(rng, 9000), "en", "c"), (None, sentence(rng, 30), "en", None), (301, sentence(rng, 30), None, "a")]
    return documents(spark, rows)


def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        rows = docs.collect()
        assert all((r.rid, r.component_id) == ("x", "x") for r in rows)
        if name == "language":
            assert all(plain.words(r.text) for r in rows)
        if name == "near_duplicates":
            assert len({(r.doc_id, r.text) for r in rows}) == len(rows) < n
            assert 200 not in {r.doc_id for r in rows}
        if name == "personal_data":
            assert not any("@" in r.text for r in rows) and all(r.n_chars == len(r.text) for r in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sum(r.piece == 0 for r in packed) == docs.count()


def test_stages_on_no_rows(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, FOLDER))
        assert docs.count() == 0
