"""Operators on small fixtures with odd rows: nulls, empty and very long texts, ties, repeats, clashing names."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rundiff.llm import arrays, language, mixing, neighbours, ngram_join, passages, pii, secret_scan, seq_packing, tokens, vector_dedup, warc
from rundiff.llm.graph import components
from rundiff.llm.queries import tokenizer_path
from tests.llm import plain

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents with helper names of the operators as extra columns."""
    full = [(k, t, lang, source, len(t) if t is not None else None) for k, t, lang, source in rows]
    df = spark.createDataFrame(full, DOC)
    for clash in ("id", "token", "size", "component_id", "rid", "row_key", "spans", "_key", "_h", "copies"):
        df = df.withColumn(clash, F.lit("x"))
    return df


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, share):
    return " ".join("zz" if rng.random() < share else w for w in text.split())


ODD = [(1, "", "en", "a"), (2, None, None, None), (None, None, "en", "a"), (3, " \t\n", "en", "a"), (4, "one", "en", None), (4, "one", "en", None), (None, "one", "en", "b")]


def test_words_of_long_and_odd_texts(monkeypatch):
    monkeypatch.setattr(arrays, "_PART", 50)
    rng = random.Random(3)
    rows = ["".join(rng.choice("ab é\t\n\x0b\x1cA ") for _ in range(rng.choice([0, 5, 30, 200, 400]))) for _ in range(200)]
    rows += ["x" * 200, None, " " * 120, "y" * 49 + " z", "é" * 40 + " " + "q" * 130]
    got, seen = dict(arrays.row_words(pa.chunked_array([rows]))), {}
    for i, row in enumerate(rows):
        expected = plain.words(row)
        assert len(expected) == len(got[i])
        for word, value in zip(expected, got[i].tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(None, 3), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    linked = {frozenset(e) for e in edges}
    expected = plain.components([(n, n) for n in nodes], lambda x, y: frozenset((x, y)) in linked)
    assert got == dict(zip(nodes, expected))


def near_copies():
    rng = random.Random(7)
    rows, key = list(ODD), 10
    for family in range(12):
        base = sentence(rng, rng.choice([6, 20, 60, 200]))
        for _ in range(rng.choice([1, 3, 25])):
            rows.append((key, edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.2])), "en", f"s{family % 4}"))
            key += 1
    shared = sentence(rng, 80)  # a passage in many otherwise different texts
    rows += [(key + i, f"{shared} {sentence(rng, rng.randint(0, 40))}", "en", "s1") for i in range(60)]
    rows.append((key + 60, sentence(rng, 30000), "en", "s2"))
    return rows


def test_ngram_join(spark):
    rows = near_copies()
    got = ngram_join.ngram_jaccard_join(documents(spark, rows)).collect()
    sets = [(k, plain.shingle_set(t)) for k, t, _, _ in rows]
    roots = [k if not s else r for (k, s), r in zip(sets, plain.components(sets, plain.similar))]
    expected = sorted(((k, len(s), r) for (k, s), r in zip(sets, roots)), key=str)
    assert sorted(map(tuple, got), key=str) == expected


def test_ngram_join_keeps_one_of_each(spark):
    rows = near_copies()
    df = documents(spark, rows)
    left = ngram_join.keep_one_of_each(df)
    assert left.columns == df.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in left.collect())
    distinct = list(dict.fromkeys((k, t) for k, t, _, _ in rows))
    order = {k: i for i, k in enumerate(sorted(range(len(distinct)), key=lambda i: (distinct[i][0] is None, distinct[i][0] or 0, i)))}
    items = [(order[i], plain.shingle_set(t)) for i, (_, t) in enumerate(distinct)]
    roots = plain.components(items, plain.similar)
    assert got == sorted((str(k), str(t)) for (k, t), (o, s), r in zip(distinct, items, roots) if not s or o == r)


def card(rng, n):
    digits = [rng.randint(0, 9) for _ in range(n - 1)]
    last = next(x for x in range(10) if plain.luhn("".join(map(str, [*digits, x]))))
    return "".join(map(str, [*digits, last]))


def test_personal_data_formats(spark):
    rng = random.Random(5)
    alphabets = ["ab.@-_ %+1", "0123456789 -", "1.2.3 25.", "+1 ()-.23456", "é😀a@b.c 1"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(150)]
    texts += [f"x{rng.choice(' -a,')}{rng.choice(['', ' ', '-', '  ']).join(card(rng, n))}{rng.choice(['', ' ', ' 7'])}" for n in range(14, 22) for _ in range(12)]
    texts += [None, "", "a@b.c_x@d.e", "😀 a@b.co 😀 +1 234 567 89", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 000.0.0.0"]
    texts += ["a" * 50000, "a@" + "b." * 30000 + "c", "1" * 50000, "1." * 20000, "+1 " + "2 " * 20000 + "x"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "q@w.e", None, None), (3, texts[3], "en", "s")]
    got = sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find_pii(documents(spark, rows)).collect())
    expected = []
    for key, text, _, _ in rows:
        spans = plain.pii(text)
        expected.append((str(key), hashlib.sha256(plain.told(spans).encode()).hexdigest(), *[sum(s[0] == k for s in spans) for k in plain.KINDS]))
    assert got == sorted(expected)


def test_personal_data_contexts(spark):
    """A context that surrounds many addresses finds what has another format; one that surrounds few does not."""
    rows = [(i, f"please write to user{i}@mail{i}.example.org for any help today", "en", "s") for i in range(8)]
    rows += [(100, "please write to bob7(at)mail.example.org for any help today", "en", "s"), (101, "nothing to see in room 12a of the house", "en", "s")]
    got = {r.doc_id: r for r in pii.find_pii(documents(spark, rows)).collect()}
    assert got[100].spans == "like_email:16:40" and got[100].n_email == 0 and got[100].n_added == 1
    assert got[101].spans == "" and got[3].n_added == 0
    clean = {r.doc_id: r.text for r in pii.redact_pii(documents(spark, rows)).collect()}
    assert clean[100] == "please write to [EMAIL] for any help today" and clean[101] == rows[-1][1]


def test_personal_data_contexts_of_neighbours(spark):
    """Context words may be other identifiers, longer than any limit, and beyond a match in the same word."""
    long = "w" * 100
    rows = [(i, f"tel 061{i}345678 +31 6{i}5 555 01{i}0 fax 06{i}1 end", "en", "s") for i in range(8)]
    rows += [(100, "tel 0612345678 0698765432 fax 0611 end", "en", "s"), (101, "nothing 12a here", "en", "s")]
    rows += [(200 + i, f"x {long}a b{i}@c.de {long}b (d{i}@e.fr,f{i}@g.hi) y", "en", "s") for i in range(4)]
    rows += [(300, f"x {long}a bob(at)0 {long}b y", "en", "s"), (301, f"x {long}c tim(at)0 {long}d y", "en", "s")]
    got = {r.doc_id: r for r in pii.find_pii(documents(spark, rows)).collect()}
    assert "like_phone:15:25" in got[100].spans.split(",") and got[101].spans == ""
    assert got[300].spans == "like_email:104:112" and got[301].spans == ""
    df = documents(spark, [(1, "é 1.1.1.1,2.2.2.2 a@b.cd-a@b.ce  +1 234 567 89\tq7 z", "en", "s")])
    told = {(r.kind, r.start): sorted(r.patterns) for r in pii._occurrences(pii._scan(df, "doc_id", "text")).collect()}
    assert told["ip", 2] == told["ip", 10] == ["both é a@b.cd-a@b.ce", "right a@b.cd-a@b.ce +0"]
    assert told["phone", 33] == ["both a@b.cd-a@b.ce q0", "left 0.0.0.0,0.0.0.0 a@b.cd-a@b.ce", "right q0 z"]
    assert told["word", 47] == ["both 00 z", "left 000 00"]


def test_redaction(spark):
    rng = random.Random(2)
    rows = [*ODD, (7, "é x@y.zz 😀 +1 234 567 8901 10.0.0.1", "en", "s"), (7, "é x@y.zz 😀 +1 234 567 8901 10.0.0.1", "en", "s"), (8, f"+{card(rng, 16)} {card(rng, 16)}", "en", "s")]
    df = documents(spark, rows)
    out = pii.redact_pii(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    expected = []
    for key, text, _, _ in rows:
        merged = []
        for start, end, kind in sorted((a, -b, k) for k, a, b in plain.pii(text)):
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], -end)
            else:
                merged.append([start, -end, kind])
        made, at = "", 0
        for start, end, kind in merged:
            made, at = made + text[at:start] + f"[{kind.upper()}]", end
        expected.append((str(key), str(text if not merged else made + text[at:])))
    assert got == sorted(expected)


def test_secret_formats(spark):
    rng = random.Random(4)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    upper, hexa, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "abcXYZ019+/"
    texts = [f"x AKIA{key(16, upper)} y é {key(rng.randint(20, 40), hexa)} z" for _ in range(40)]
    texts += [f'{w}{s}"{key(rng.randint(3, 20), mixed)}' for w in ("Password", "APIKEY", "api_key", "toKen", "ſecret", "secret'") for s in (" = ", ":", " ", "=")]
    texts += [None, "", "secret" + " " * 50000, "a1" * 30000, "AKIA" * 9, *[sentence(rng, 30) + f" {key(24, 'ghijk12')} " for _ in range(20)]]
    texts.append(f"lone {key(8, hexa)}-{key(32, hexa)}")
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "token=abcdef1", None, None)]
    got = sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secret_scan.scan_secrets(documents(spark, rows)).collect())
    expected = []
    for k, text, _, _ in rows:
        spans = plain.secrets(text)
        expected.append((str(k), hashlib.sha256(plain.told(spans).encode()).hexdigest(), *[sum(s[0] == n for s in spans) for n in ("assign", "access", "hex")]))
    assert got == sorted(expected)


def test_short_and_long_runs_are_scored(spark):
    """Runs as short as labelled values are scored; the background counts all runs, long ones too."""
    rng = random.Random(16)
    made = lambda: "Q7" + "".join(rng.choice("GHIJKLMNOPQRSTUVWXYZ") for _ in range(6))
    rows = [(i, f"{sentence(rng, 30)} password: {made()} {sentence(rng, 30)} plainwords to h264 mp3play2 follow", "en", "s") for i in range(60)]
    rows += [(100 + i, f"plainwords then {made()} and others", "en", "s") for i in range(5)] + [(200, "a1" * 500, "en", "s")]
    df = documents(spark, rows)
    got = {r.doc_id: r for r in secret_scan.scan_secrets(df).collect()}
    assert all(got[100 + i].spans == "like_assign:16:24" for i in range(5))
    assert all(got[k].n_added == 0 for k in (*range(60), 200))
    _, background = secret_scan.fit_models(df.select("doc_id", "text"))
    runs = [v for _, t, _, _ in rows for *_, v in secret_scan.find_candidates(t, secret_scan.find_base(t))]
    assert background.freq[0]["a"] == sum(c in "abcdef" for v in runs for c in v) and background.entered[0] == 1 + sum(map(len, runs))


def test_inferred_automata():
    """States merge to a small automaton that tells its format from others."""
    rng = random.Random(6)
    values = ["sk-" + "".join(rng.choice("0123456789") for _ in range(12)) + "-" + "".join(rng.choice("ABCDEF") for _ in range(6)) for _ in range(300)]
    automaton, least = secret_scan.fit(values)
    reached, todo = {0}, [0]
    while todo:
        for child in automaton.go[todo.pop()].values():
            if child not in reached:
                reached.add(child)
                todo.append(child)
    assert len(reached) < 40
    alike = "sk-" + "".join(rng.choice("0123456789") for _ in range(12)) + "-ABCABC"
    other = "".join(rng.choice("ghijklmn0123") for _ in range(22))
    assert automaton.score(secret_scan.symbols(alike)) >= least - 0.3
    assert automaton.score(secret_scan.symbols(other)) < least - 1


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    encode, whole = tokens.new_encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    odd = ["it's WE'LL I’m don't 'TIS a\x1cb !\x1d! x²½Ⅷ 12a ΣΑΣ İstanbul ŉx ǅ é é <|endoftext|>x c​d 中文字 😀😀 \u0085x", "", "   ", "ÀÉ×÷ß''s''re", "Ÿ K Å"]
    for text in odd:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "lengths",
    [[7, 300, 900, 1500, 2049, 4095, 4096] * 300, [2049] * 50, [1], [4096] * 3, [1366] * 1000, [random.Random(i).randint(1, 3000) for i in range(20000)]],
)
def test_packing_plan(lengths):
    histogram = {x: lengths.count(x) for x in set(lengths)}
    runs = seq_packing.plan_packing(histogram, 4096)
    back = {}
    for many, taken in runs:
        assert many > 0 and sum(x * n for x, n in taken) <= 4096
        for x, n in taken:
            back[x] = back.get(x, 0) + many * n
    assert back == histogram
    # no sequence holds two pieces above half the capacity, or three above a third of it
    least = max(sum(x > 2048 for x in lengths), -(-sum(3 * x > 4096 for x in lengths) // 2), -(-sum(lengths) // 4096))
    assert sum(many for many, _ in runs) <= 1.03 * least


def test_knapsack():
    rng = random.Random(9)
    for _ in range(20):
        sizes, prices = [rng.randint(3, 30) for _ in range(5)], [rng.random() for _ in range(5)]
        best = [0.0] * 61
        for c in range(1, 61):
            best[c] = max([best[c - 1]] + [best[c - s] + p for s, p in zip(sizes, prices) if s <= c])
        config = seq_packing.knapsack(sizes, prices, 60)
        assert sum(sizes[k] * n for k, n in config.items()) <= 60
        assert abs(sum(prices[k] * n for k, n in config.items()) - best[60]) < 1e-9


def test_packing_odd_rows(spark):
    rows = [*ODD, (9, "word " * 9000, "en", "s")]
    got = seq_packing.pack_documents(documents(spark, rows), tokenizer_path()).collect()
    assert sorted(str(r.doc_id) for r in got if r.piece == 0) == sorted(str(r[0]) for r in rows)
    assert [r.length for r in sorted((r for r in got if r.doc_id == 9), key=lambda r: r.piece)] == [4096, 4096, 809]
    assert {(r.length, r.ids_crc32) for r in got if r.doc_id in (1, 2, 3)} == {plain.pieces([1])[0][2:]}


def test_fuzzy_passages(spark):
    rng = random.Random(8)
    passage, base = sentence(rng, 70), sentence(rng, 120)
    fuzzy = " ".join(w if i % 25 != 12 else "qq" for i, w in enumerate(passage.split()))
    rows = [*ODD, (20, f"{sentence(rng, 90)} {passage} {sentence(rng, 10)}", "en", "s"), (21, f"{sentence(rng, 30)} {fuzzy}", "en", "s")]
    rows += [(22, sentence(rng, 300), "en", "s"), (23, base, "en", "s"), (24, base, "en", "s"), (25, sentence(rng, 49) + " tail", "en", "s")]
    rows.append((25, rows[-1][1], "en", "s"))  # equal, but of 50 words
    short = sentence(rng, 50)  # not over 50 words
    rows += [(26, f"{short} {sentence(rng, 60)}", "en", "s"), (27, f"{sentence(rng, 60)} {short}", "en", "s")]
    got = {(r.doc_id, r.start_word, r.end_word, r.partner_id) for r in passages.repeated_passages(documents(spark, rows)).collect()}
    assert got == {(20, 90, 160, 21), (21, 30, 100, 20), (23, 0, 120, 24), (24, 0, 120, 23)}


def test_chains_are_best():
    """The score of the best chain equals that of a quadratic search."""
    rng = random.Random(10)
    for _ in range(50):
        pieces = np.array([[rng.randrange(120), rng.randrange(120), rng.randint(8, 20)] for _ in range(12)])
        chain = max(passages.chains(pieces, 0.1, 1000), key=lambda c: len(c))
        for i, j in zip(chain, chain[1:]):
            assert (pieces[i, :2] + pieces[i, 2] <= pieces[j, :2]).all()

        def total(c):
            part = pieces[c]
            gaps = (part[1:, :2] - part[:-1, :2] - part[:-1, 2:]).sum() if len(c) > 1 else 0
            return part[:, 2].sum() - 0.1 * gaps

        best = {}
        for i in sorted(range(12), key=lambda i: pieces[i, 1]):
            before = [best[j] - 0.1 * (pieces[i, :2] - pieces[j, :2] - pieces[j, 2]).sum() for j in best if (pieces[j, :2] + pieces[j, 2] <= pieces[i, :2]).all()]
            best[i] = pieces[i, 2] + max([0, *before])
        assert abs(max(map(total, passages.chains(pieces, 0.1, 1000))) - max(best.values())) < 1e-9


def test_chains_after_a_long_piece():
    """A piece too far back does not hide a nearer one, whatever its score."""
    pieces = np.array([[0, 0, 2000], [3000, 5000, 26], [3029, 5029, 26]])
    assert sorted(passages.chains(pieces)) == [[0], [1, 2]]
    rng = random.Random(11)
    for _ in range(50):
        pieces = np.array([[rng.randrange(300), rng.randrange(300), rng.randint(4, 90)] for _ in range(14)])
        best = {}
        for i in np.argsort(pieces[:, 1], kind="stable"):
            gaps = {j: pieces[i, :2] - pieces[j, :2] - pieces[j, 2] for j in best}
            best[i] = pieces[i, 2] + max([0, *[best[j] - 0.1 * g.sum() for j, g in gaps.items() if (g >= 0).all() and (g <= 40).all()]])
        totals = []
        for c in passages.chains(pieces, 0.1, 40):
            gaps = pieces[c][1:, :2] - pieces[c][:-1, :2] - pieces[c][:-1, 2:]
            assert (gaps >= 0).all() and (gaps <= 40).all()
            totals.append(pieces[c][:, 2].sum() - 0.1 * gaps.sum())
        assert abs(max(totals) - max(best.values())) < 1e-9


@pytest.mark.parametrize("every", [5, 6, 7, 9, 10, 12])
def test_passages_with_many_edits(spark, every):
    """Passages with an edit every few words are all found, as by brute force over the planted pairs."""
    rng = random.Random(every)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    rows = [*ODD]
    for i in range(40):
        passage = words(60 + i)
        edit = [w if j % every != every // 2 else ("qq" if i % 2 else f"{w} qq") for j, w in enumerate(passage)]
        rows.append((100 + i, " ".join(words(30) + passage + words(20)), "en", "s"))
        rows.append((200 + i, " ".join(words(10) + edit + words(40)), "en", "s"))
    got = {r.doc_id: r for r in passages.repeated_passages(documents(spark, rows)).collect()}
    for i in range(40):
        for key, other, at in ((100 + i, 200 + i, 30), (200 + i, 100 + i, 10)):
            assert got[key].partner_id == other
            assert abs(got[key].start_word - at) <= every and got[key].n_words >= 60 + i - 2 * every


def test_alignment_keeps_a_passage_with_a_bad_start():
    """A gap that brings the start below the identity does not end a passage that has it as a whole."""
    x = np.arange(100, dtype=np.uint32)
    y = np.r_[np.arange(4), np.arange(900, 906), np.arange(10, 16), np.arange(910, 913), np.arange(19, 59), np.arange(800, 830)].astype(np.uint32)
    assert passages.align(x, y, np.array([[0, 0, 4], [10, 10, 6], [19, 19, 40]])) == [(0, 59, 0, 59, 50)]


def test_passages_of_common_lines(spark):
    """A passage of lines that other documents hold alone, and one that a document holds twice."""
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    lines = [words(10) for _ in range(8)]
    whole = sum(lines, [])
    rows = [(1, " ".join(words(40) + whole + words(30)), "en", "s"), (2, " ".join(words(15) + whole + words(50)), "en", "s")]
    for i, line in enumerate(lines):  # enough that some have smaller keys and some come in between
        rows += [(100 + 20 * i + j, " ".join(words(25) + line + words(25)), "en", "s") for j in range(20)]
    got = {(r.doc_id, r.start_word, r.end_word, r.partner_id) for r in passages.repeated_passages(documents(spark, rows)).collect()}
    assert got == {(1, 40, 120, 2), (2, 15, 95, 1)}
    for seed in range(6):
        passage, twice = words(60), words(20)
        rows = [(1, " ".join(words(20) + passage + twice + passage + words(10)), "en", "s"), (2, " ".join(words(30) + passage + words(30)), "en", "s")]
        got = {(r.doc_id, r.start_word, r.end_word, r.partner_id) for r in passages.repeated_passages(documents(spark, rows)).collect()}
        assert got == {(1, 20, 80, 2), (1, 100, 160, 2), (2, 30, 90, 1)}


def test_passages_of_lines_in_other_order(spark):
    """Passages of common lines, a word that differs after each: no two documents but the pair hold a whole one."""
    rng = random.Random(13)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    lines, rows, pairs = [words(5) for _ in range(30)], [], []
    for i in range(12):
        chosen = rng.sample(lines, 14)
        sides = [sum((line + words(1) for line in chosen), []) for _ in range(2)]
        rows += [(10 * i + j, " ".join(words(8 + j) + side + words(12)), "en", "s") for j, side in enumerate(sides)]
        pairs.append((10 * i, 10 * i + 1))
    for i, line in enumerate(lines):
        rows += [(1000 + 30 * i + j, " ".join(words(20) + line + words(30)), "en", "s") for j in range(30)]
    got = {(r.doc_id, r.partner_id): (r.start_word, r.end_word) for r in passages.repeated_passages(documents(spark, rows)).collect()}
    assert set(got) == {x for a, b in pairs for x in ((a, b), (b, a))}
    for a, b in pairs:
        for key, other, at in ((a, b, 8), (b, a, 9)):
            assert got[key, other][0] <= at and got[key, other][1] >= at + 83


def test_places_of_a_frequent_seed_all_meet(monkeypatch):
    """Cut into blocks and chunks, each two places of a seed still meet once."""
    pa = pytest.importorskip("pyarrow")
    texts = [np.arange(i * 100, i * 100 + 20, dtype=np.uint64) for i in range(1, 40)]
    for t in texts:
        t[5:9] = [1, 2, 3, 4]
    send = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))])], names=["text"])
    monkeypatch.setattr(passages.arrays, "row_words", lambda column: enumerate(texts))
    monkeypatch.setattr(passages, "_BLOCK_PLACES", 7)
    monkeypatch.setattr(passages, "_CHUNK_PAIRS", 10)
    blobs = sorted((x.to_pylist()[0] for x in passages._send_seeds(8, 4)([send])), key=lambda x: x["bucket"])
    tiles = list(passages._tiles([pa.RecordBatch.from_pylist(blobs, schema=pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))]))
    got = [(r["a"], r["b"], tuple(np.frombuffer(r["places"], np.uint32))) for x in passages._join_seeds(tiles) for r in x.to_pylist()]
    keys = sorted(int(passages._sequence_key(t).view(np.int64)) for t in texts)
    assert sorted(got) == [(a, b, (5, 5, 3)) for i, a in enumerate(keys) for b in keys[i + 1 :]]


@pytest.mark.parametrize("split", ["128m", "150"])
def test_warc_with_records_inside_payloads(spark, split):
    fake = "\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "u", "a" * 200), (2, "u", "a" * 200), (3, None, None), (4, "x" + fake, "b" + fake + "c" + fake * 3), (5, "u", "WARC/1.0\r\n"), (6, "u", "é" * 60)]
    rows += [(None, "u", "é" * 60), (7, "u", "\r\nWARC/1.0"), (8, "u", rows[3][2]), (8, "u", rows[3][2]), (9, "u", ""), (10, "u", fake[:-30]), (11, "z", "\r\n" * 70), (12, "u", "b" * 99), (13, "u", "b" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.archive_pages(pages).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    first = {4: 4, 8: 4, 1: 1, 2: 1, 6: 6, None: 6}
    expected = []
    for key, _, html in rows:
        body = (html or "").encode()
        again = key in first and first[key] != key
        expected.append((key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[key] if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_language_evidence(spark):
    """Text decides where it is clear, host and markup where it is not; noise is rejected."""
    rng = random.Random(11)
    say = lambda syllables, n: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(n))
    a, b = ["the", "ing", "and", "sh"], ["ción", "que", "llo", "za"]
    rows = [(300 + i, say(a, 40), "en", "h.one.org") for i in range(30)] + [(100 + i, say(b, 40), "es", "h.two.org") for i in range(30)]
    rows += [(200, say(b, 60), "en", "h.one.org"), (201, "xq", None, "h.two.org"), (202, "xq", "en", "h.one.org"), (203, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(300)), None, None), *ODD]
    out = language.identify_language(documents(spark, rows)).collect()
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    assert len(out) == len(rows)
    assert all(got[300 + i].language == "en" and got[100 + i].language == "es" for i in range(30))
    assert (got[200].language, got[201].language, got[202].language) == ("es", "es", "en")
    assert not got[203].kept and not got[1].kept and not got[2].kept and not got[3].kept
    left = language.keep_identified(documents(spark, rows))
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in out if r.kept)


def test_many_languages_and_long_texts(spark, monkeypatch):
    """Each of 70 declared languages is found, and one that has long texts only."""
    monkeypatch.setattr(language, "LONGEST_SAMPLE", 300)
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllables = [["".join(rng.choice(letters) for _ in range(3)) for _ in range(6)] for _ in range(70)]
    say = lambda i, n: " ".join("".join(rng.choice(syllables[i]) for _ in range(2)) for _ in range(n))
    rows = [(1000 + 10 * i + j, say(i, 100 if i == 69 else 30), f"l{i}", None) for i in range(70) for j in range(3 if i < 60 else 2)]
    got = {r.doc_id: r for r in language.identify_language(documents(spark, rows)).collect()}
    assert all(got[k].language == declared and got[k].kept for k, _, declared, _ in rows)


def test_page_evidence(spark):
    pages = spark.createDataFrame(
        [(1, "https://www.a.org/de/1", '<html lang="DE"><style>x</style><p>Hallo</p>'), (2, None, None), (3, "http://b.fr", "<p>x")], "page_id long, url string, html string"
    )
    rows = {r.page_id: r for r in language.page_evidence(pages).collect()}
    assert (rows[1].declared, rows[1].suffix, rows[1].host, rows[1].text.split()) == ("de", "de", "www.a.org", ["Hallo"])
    assert (rows[2].declared, rows[2].suffix, rows[2].host) == (None, None, None)
    assert (rows[3].declared, rows[3].suffix) == (None, "fr")


def plain_posterior(rows, sample=language.SAMPLE):
    """{row: (language, confidence)} of (text, declared, suffix, host) rows, counted one by one."""
    texts = {}
    for text, declared, _, _ in rows:
        if declared and text:
            texts.setdefault(declared.lower(), set()).add(text)
    names, model = language.fit_text(texts)
    n = len(names) + 1
    bins = [language.trigrams(np.frombuffer((text or "").encode(), np.uint8)) for text, *_ in rows]
    logs = np.array([[float(m[b].sum(dtype=np.float64)) / 3 for m in model] + [-len(b) * np.log(1 << 16) / 3] for b in bins])
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    word = [bool((text or "").strip(" \t\n\r\x0b\x0c")) for text, *_ in rows]
    belief = np.array([soft(x) * w for x, w in zip(logs, word)])
    parts = []
    for _, declared, suffix, host in rows:
        host = host and host.lower()
        domain = ".".join(host.split(".")[-2:]) if host and host.count(".") > 1 else None
        parts.append({"declared": declared and declared.lower(), "suffix": suffix and suffix.lower(), "host": host, "domain": domain})
    out = []
    for i in range(len(rows)):
        total = logs[i].copy()
        others = lambda kind: sum((belief[j] for j in range(len(rows)) if parts[j][kind] == parts[i][kind]), np.zeros(n)) - belief[i]
        for kind in ("declared", "suffix"):
            if parts[i][kind] is not None:
                values = len({p[kind] for p in parts} - {None})
                whole = sum(belief[j] for j in range(len(rows)) if parts[j][kind] is not None) - belief[i]
                total += np.log((others(kind) + 0.5) / (whole + 0.5 * values))
        prior = (belief.sum(axis=0) + 1) / (belief.sum() + n)
        for kind in ("domain", "host"):
            if parts[i][kind] is not None:
                prior = (others(kind) + 20 * prior) / (others(kind).sum() + 20)
        posterior = soft(total + np.log(prior))
        out.append(([*names, "und"][int(posterior.argmax())], float(posterior.max())) if word[i] else ("und", 0.0))
    return out


def test_language_equals_the_posterior_counted_by_hand(spark):
    rng = random.Random(21)
    spoken = {"aa": "abcd", "bb": "efgh", "cc": "adeh"}
    rows = []
    for i in range(90):
        tongue = rng.choice(list(spoken))
        text = " ".join("".join(rng.choices(spoken[tongue], k=3)) for _ in range(rng.choice([0, 1, 2, 12])))
        declared = rng.choice([tongue, tongue, tongue.upper(), None, rng.choice(list(spoken))])
        host = rng.choice([None, f"www.{tongue}.org", f"x{i % 3}.mixed.net", "plain"])
        rows.append((text if rng.random() < 0.95 else None, declared, rng.choice([None, tongue, "com"]), host))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, t string, d string, s string, h string")
    got = {r.k: (r.language, r.confidence) for r in language.identify_language(df, "k", "t", "d", "h", "s").collect()}
    for i, (name, sure) in enumerate(plain_posterior(rows)):
        assert got[i][1] == pytest.approx(sure, abs=1e-4)
        assert got[i][0] == name or sure < 0.5001


def test_mix_of_odd_sources(spark):
    rng = random.Random(12)
    rows = [*ODD, (20, sentence(rng, 3000), "en", "c")] + [(30 + i, sentence(rng, rng.randint(1, 30)), "en", rng.choice(["a", "b", None])) for i in range(300)]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    targets = {(r.source_size, round(r.target, 6)) for r in got}
    assert len(targets) == 4 and abs(sum(t for _, t in targets) - sum(s for s, _ in targets)) < 1e-3
    df = documents(spark, rows)
    mix = mixing.take_mix(df)
    assert mix.columns == df.columns
    counts = {}
    for r in mix.collect():
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    total = sum(r["size"] for r in got)
    assert 0.85 * total <= sum(n * len(plain.words(t)) for (_, t), n in counts.items()) <= total
    assert all(n <= 3 * sum((k, t) == (r[0], r[1]) for r in rows) for (k, t), n in counts.items())


def test_mix_of_equal_rows(spark):
    """Equal rows are drawn apart, and the sum comes as near to the target as one of them."""
    rows = [(7, "w " * 20, "en", "a")] * 100 + [(i, "w " * 13, "en", "b") for i in range(200)]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    for size, n in ((20, 100), (13, 200)):
        mine = [r for r in got if r["size"] == size]
        assert len(mine) == n and mine[0].target - size < sum(r.taken for r in mine) <= mine[0].target
        assert max(r.taken for r in mine) <= 3 * size


def test_mix_favours_large_documents(spark):
    """Inclusion odds go by size: of small and large documents, the large ones are taken more often."""
    rows = [(i, "w " * (10 if i % 2 else 40), "en", "a") for i in range(600)] + [(1000 + i, "w " * 1000, "en", "b") for i in range(3)]
    rows += [(2000 + i, "w " * 30, "en", "c") for i in range(800)]
    got = [r for r in mixing.mix_sources(documents(spark, rows)).collect() if r.doc_id >= 2000 or r.doc_id < 600]
    part = [r for r in got if r.doc_id < 600]
    base = min(r.copies for r in part)
    share = lambda size: sum(r.copies > base for r in part if r["size"] == size) / 300
    assert share(40) > 1.5 * share(10)


def test_mix_joins_few_tables_of_sources(spark, monkeypatch):
    """A round of the mix joins what was granted and the sums of the buckets only; budgets are columns of the rows."""
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(3, 60), "en", rng.choice("abc")) for i in range(400)]
    joins, cut = [], mixing.cut_lineage
    monkeypatch.setattr(mixing, "cut_lineage", lambda df: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or cut(df))
    got = mixing.mix_sources(documents(spark, rows)).collect()
    assert len(joins) > 8 and max(joins) <= 2
    assert len(got) == 400 and all(sum(r.taken for r in got if r.target == t) <= t for t in {r.target for r in got})


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * s).tolist() for s in (0.05, 0.1, 0.2, 0.3, 0.4) for _ in range(12)]
    rows = [(i, v) for i, v in enumerate(rows)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None, *[1.0] * 15]), (1004, [float("nan")] * 16), (1005, [float("inf"), *[1.0] * 15])]
    rows += [(1006, rows[0][1]), (1007, rows[0][1]), (1007, rows[0][1]), (None, rows[1][1]), (1008, (np.array(rows[2][1]) * 1e200).tolist()), (1009, [1.0, 2.0, 3.0]), (1010, [1.0, 2.0, 3.1])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_vector_near_duplicates(spark, monkeypatch, small):
    """Also with groups of two vectors, whose cones are compared in blocks of eight."""
    if small:
        for name, value in (("LEAST_GROUP", 2), ("MOST_GROUP", 2), ("_HEADERS", 8)):
            monkeypatch.setattr(vector_dedup, name, value)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit(1)).withColumn("id", F.lit(2))
    got = sorted(map(tuple, vector_dedup.near_duplicate_vectors(df).collect()), key=str)

    def good(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [vector_dedup.unit(np.array([v]))[0] if good(v) else None for _, v in rows]
    linked = lambda x, y: x is not None and y is not None and len(x) == len(y) and float(x @ y) >= 0.9
    roots = plain.components([(k, u) for (k, _), u in zip(rows, units)], linked)
    expected = []
    for i, (k, _) in enumerate(rows):
        n = sum(linked(units[i], u) for j, u in enumerate(units) if j != i)
        expected.append((k, n, roots[i], k is not None and roots[i] == k))
    assert got == sorted(expected, key=str)


def test_quantisation_bounds():
    rng = np.random.default_rng(1)
    u = vector_dedup.unit(rng.normal(size=(200, 24)))
    codes, scale, error = vector_dedup.quantise(u)
    near = (codes * scale[:, None]) @ (codes * scale[:, None]).T
    bound = error[:, None] * (1 + error[None, :]) + error[None, :]
    assert (np.abs(near - u @ u.T) <= bound + 1e-12).all() and bound.max() < 0.05


def test_nearest_of_odd_vectors(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = neighbours.nearest_neighbours(df.where("vec_id <> 1008 OR vec_id IS NULL"), every=7, k=4).collect()
    x = {k: np.array(v) for k, v in rows if k is not None and k != 1008 and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    answers = {}
    for r in got:
        answers.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    expected = {}
    for k in (k for k in x if k % 7 == 0):
        near = sorted((float(np.sqrt(((x[k] - v) ** 2).sum())), j) for j, v in x.items() if j != k and len(v) == len(x[k]))[:4]
        expected[k] = [(i + 1, j, round(d, 9)) for i, (d, j) in enumerate(near)]
    hits = sum(len({a[1] for a in answers[k]} & {a[1] for a in expected[k]}) for k in expected)
    assert set(answers) == set(expected) and hits >= 0.97 * sum(map(len, expected.values()))
    assert answers[7] == expected[7] and answers[0] == expected[0]


@pytest.mark.parametrize("huge", [1e7, 1e30])
def test_nearest_beside_one_huge_vector(spark, huge):
    """One vector of another magnitude leaves the neighbours of the rest as they are."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    x[599] *= huge
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest_neighbours(df, every=5, k=6).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & set(np.argsort(np.where(np.arange(600) == q, np.inf, ((x - x[q]) ** 2).sum(axis=1)), kind="stable")[:6].tolist())) for q in range(0, 599, 5))
    assert len(got) == 120 and hits >= 0.95 * 120 * 6


def test_rounds_go_on_until_little_changes(spark, monkeypatch):
    """From a poor first graph more than two rounds are made."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 12))
    monkeypatch.setattr(neighbours, "LEAF", 24)
    monkeypatch.setattr(neighbours.grow_trees, "__defaults__", (3, 7))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vector array<double>")
    graph = neighbours.neighbour_graph(df.mapInArrow(neighbours._encode(1.0), "node long, code binary"), 1500, 8)
    hits = 0
    for r in graph.collect():
        far = ((x - x[r.node]) ** 2).sum(axis=1)
        far[r.node] = np.inf
        hits += len(set(np.frombuffer(r.ids, np.int64).tolist()) & set(np.argsort(far)[:8].tolist()))
    assert graph.agg(F.sum("changed")).first()[0] < 0.02 * 8 * 1500 and hits >= 0.9 * 8 * 1500


def test_empty_tables(spark):
    docs = documents(spark, [(1, "x", "en", "s")]).where("false")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        ngram_join.ngram_jaccard_join(docs),
        ngram_join.keep_one_of_each(docs),
        pii.find_pii(docs),
        pii.redact_pii(docs),
        secret_scan.scan_secrets(docs),
        seq_packing.pack_documents(docs, tokenizer_path()),
        passages.repeated_passages(docs),
        warc.archive_pages(pages),
        language.identify_language(docs),
        language.keep_identified(docs),
        mixing.mix_sources(docs),
        mixing.take_mix(docs),
        neighbours.nearest_neighbours(vectors),
        vector_dedup.near_duplicate_vectors(vectors),
    ):
        assert df.collect() == []
