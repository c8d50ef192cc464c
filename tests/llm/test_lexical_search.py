"""Ranked search against plain Python, on odd rows, with blocks, bundles and passes forced small."""

import math
import random
import re
from collections import Counter

from rundiff.llm import lexical_search
from tests.llm.test_operators import ODD, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, best):
    found = [(key, Counter(terms(text))) for key, text in docs if terms(text)]
    n_docs, words = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in found:
            m = 100 - 90 + (90 * c.total() * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores, key=lambda s: s[:3])[:best])]
    return sorted(out, key=str)


def fixture():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "the", "THE", "é", "x_y", "a-b", "漢字"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, [1 + 300 // (i + 1) for i in range(len(words))], k=n))
    rows = list(ODD) + [(100 + i, text(rng.choice([1, 3, 20, 60])), "en", "s") for i in range(150)]
    rows += [(400, text(30000), "en", "s"), (500, "w59 é", "en", "s"), (500, "w59 é", "en", "s"), (300, "w59 é", "en", "s"), (None, "w59 é", None, None)]
    items = [(i, text(rng.choice([1, 4, 30]))) for i in range(40)]
    items += [(7, "w59"), (7, "w59"), (None, "the w1 w2"), (50, ""), (51, None), (52, "- !"), (53, "nowhere else"), (54, text(400))]
    return rows, items


def test_ranked_search(spark, monkeypatch):
    rows, items = fixture()
    asked = spark.createDataFrame(items, "item_id long, text string")
    for clash in ("id", "bundle", "slot", "term", "score", "rank"):
        asked = asked.withColumn(clash, asked.text)
    expected = plain_search([(k, t) for k, t, _, _ in rows], items, 10)
    df = documents(spark, rows)
    got = lexical_search.ranked_search(df, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == expected
    monkeypatch.setattr(lexical_search, "_BLOCK_DOCS", 9)
    monkeypatch.setattr(lexical_search, "_BUNDLE_ITEMS", 5)
    monkeypatch.setattr(lexical_search, "_PASS_TERMS", 70)
    got = lexical_search.ranked_search(df.repartition(3), asked.repartition(2)).collect()
    assert sorted(map(tuple, got), key=str) == expected


def test_ranked_search_of_nothing(spark):
    rows, items = fixture()
    asked = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, rows)
    for a, b in ((df.limit(0), asked), (df, asked.limit(0)), (df, asked.where("item_id = 53")), (df.where("text = ''"), asked)):
        got = lexical_search.ranked_search(a, b)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]
