"""Online packing: the choice of levels against brute force, and every piece against the tokenizer."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rundiff.llm import byte_tokens, online_packing
from rundiff.llm import queries as q
from tests.llm.test_operators import ODD, documents, sentence
from tests.llm.test_queries import FOLDER


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.byte_tokenizer_path())


def ids_of(tokenizer, text, end=1):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def check(rows, docs, tokenizer, capacity):
    """Every id of every (key, text) once, in windows without gaps; returns the fills of the windows."""
    windows, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    expected = defaultdict(list)
    for key, text in docs:
        expected[key].append(np.array(ids_of(tokenizer, text), dtype="<u4"))
    assert parts.keys() == expected.keys()
    for key, texts in expected.items():
        if len(texts) > 1:  # rows that repeat a key: only the sum can be told
            assert sum(p[1] for p in parts[key]) == sum(map(len, texts))
            continue
        at, ids = 0, texts[0]
        for start, length, crc, total in sorted(parts[key]):
            assert (start, total) == (at, len(ids)) and zlib.crc32(ids[at : at + length].tobytes()) == crc
            at += length
        assert at == len(ids)
    fills = []
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and not at & (at - 1)
        fills.append(at)
    return fills


def test_levels_take_the_least_sum_of_squares():
    rng = random.Random(4)
    levels = online_packing.Levels(64)
    for _ in range(3000):
        size = rng.choice([1, 2, 5, 20, 33, 40, 63, rng.randint(1, 63)])
        before = levels.counts.copy()
        offers = {}
        for level in range(0, 64 - size + 1):
            if level == 0 or before[level]:
                after = before.copy()
                after[level] -= level > 0
                if level + size < 64:
                    after[level + size] += 1
                offers[level] = int((after**2).sum())
        level = levels.choose(size)
        assert offers[level] == min(offers.values()) and level == max(x for x in offers if offers[x] == offers[level])
        full = levels.place(("k", 0, size, b"1234" * size, size), size)
        assert (full is not None) == (level + size == 64) and (not full or sum(p[2] for p in full) == 64)
        assert [len(w) for w in levels.windows] == levels.counts.tolist()
        assert levels.tokens == sum(p[2] for ws in levels.windows for w in ws for p in w)
    open_tokens = levels.tokens
    drained = [sum(p[2] for p in w) for w in levels.drain()]
    assert sum(drained) == open_tokens and all(not n & (n - 1) and n <= 64 for n in drained)
    assert levels.tokens == 0 and not levels.counts.any()


def test_byte_tokens_equal_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(byte_tokens, "_STRETCH", 60)
    rng = random.Random(2)
    encode = byte_tokens.encoder(q.byte_tokenizer_path())
    letters = ["a", "b", " ", " ", "  ", "\n", "\t", "'s", "1", ".", "é", "ß", "\x1c", "\x85", "\xa0", "漢", "😀", "é", "<|endoftext|>"]
    texts = ["".join(rng.choices(letters, [6] * 12 + [1] * 7, k=rng.randint(0, 300))) for _ in range(400)]
    texts += ["x" * 3000, " " * 3000, "a" + "\n" * 1200 + "b", "ab " * 2000, ""]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_online_packing_of_odd_rows(spark, tokenizer):
    rng = random.Random(9)
    docs = [(10 + i, sentence(rng, rng.choice([1, 3, 30, 200]))) for i in range(300)]
    docs += [(400, sentence(rng, 9000)), (401, "<|endoftext|> x"), (402, "z" * 5000)]
    rows = [*ODD, *[(k, t, "en", "s") for k, t in docs]]
    df = documents(spark, rows).repartition(3, "n_chars")
    for open_tokens in (online_packing._OPEN_TOKENS, 500):
        got = online_packing.pack_online(df, q.byte_tokenizer_path(), capacity=256, open_tokens=open_tokens).collect()
        check(got, [(k, t) for k, t, _, _ in rows], tokenizer, 256)


def test_online_packing_of_no_rows(spark):
    df = documents(spark, ODD).limit(0)
    assert online_packing.pack_online(df, q.byte_tokenizer_path()).collect() == []


def test_online_packing_query(spark, tokenizer):
    rows = q.op11_online_packing(spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    fills = check(rows, [tuple(d) for d in docs], tokenizer, 2048)
    assert sum(f == 2048 for f in fills) >= sum(fills) // 2048 * 0.95  # few short sequences
    whole = sum(r.start == 0 and r.length == r.doc_tokens for r in rows if r.doc_tokens < 2048)
    assert whole >= 0.6 * sum(1 for d in {r.doc_id: r.doc_tokens for r in rows}.values() if d < 2048)  # most uncut, though the stream is short
