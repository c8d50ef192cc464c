"""Find secrets by fixed formats, and by probabilistic automata inferred from the secrets found."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rundiff.session import cut_lineage

KINDS = ("assign", "access", "hex")
SAMPLE = 1000  # distinct labelled values per kind that an automaton is fitted on
LONGEST_SAMPLE = 256  # characters of a labelled value, at most, to be fitted on
LEAST_SAMPLE = 20
_LEAST = 6  # characters of a candidate: of the shortest value that a format finds
_ALPHA = 0.05  # of the Hoeffding test
_MARGIN = 0.7  # natural log units a character by which a format must beat the background

_REMEMBERED = 32  # characters of a run whose answer is remembered, at most


def _either_case(word):
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile("(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")  # runs are maximal, so a shorter run is one that is dropped
_DIGIT = re.compile("[0-9]")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % _LEAST)


def find_base(text):
    """Base spans of one text: (kind, start, end, value), by start and then kind as listed."""
    lower = text.lower()
    out = []
    if any(word in lower for word in _KEYWORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[1]) >= 6:
                out.append(("assign", m.start(), m.end(), m[1]))
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_candidates(text, base):
    """Runs of credential characters with a digit and a letter that no base span touches."""
    if not _DIGIT.search(text):
        return []
    out, i, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        while i < len(base) and base[i][1] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach <= m.start() and _DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0]):
            out.append(("candidate", m.start(), m.end(), m[0]))
    return out


def _labelled(batches):
    """(kind, value) of all base spans."""
    import pyarrow as pa

    for batch in batches:
        found = [(s[0], s[3]) for text in batch.column("text").to_pylist() for s in find_base(text or "")]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(2)], names=["kind", "value"])


def _count_symbols(batches):
    """(symbol, n): how often each class is in the candidates of a task."""
    import pyarrow as pa

    counts = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            text = text or ""
            for _, _, _, value in find_candidates(text, find_base(text)):
                counts.update(value)
    yield pa.RecordBatch.from_arrays([pa.array([symbol(c) for c in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["symbol", "n"])


_CLASSES = {**{c: "0" for c in "0123456789"}, **{c: "a" for c in "abcdef"}, **{c: "g" for c in "ghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEF"}, **{c: "G" for c in "GHIJKLMNOPQRSTUVWXYZ"}}
_CLASS_SIZE = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}


def symbol(c):
    """The class of a character; others than letters and digits stand for themselves."""
    return _CLASSES.get(c, c)


def symbols(value):
    """A value as character classes."""
    return [_CLASSES.get(c, c) for c in value]


class Automaton:
    """A deterministic probabilistic automaton: per state, how often it was entered, left by each symbol, and final."""

    def __init__(self):
        self.entered, self.final, self.go, self.freq = [], [], [], []

    def state(self):
        self.entered.append(0)
        self.final.append(0)
        self.go.append({})
        self.freq.append({})
        return len(self.entered) - 1

    def add(self, word):
        at = 0
        self.entered[0] += 1
        for s in word:
            if s not in self.go[at]:
                self.go[at][s] = self.state()
            self.freq[at][s] = self.freq[at].get(s, 0) + 1
            at = self.go[at][s]
            self.entered[at] += 1
        self.final[at] += 1

    def similar(self, a, b):
        """Whether two states, and all that follows them, may have the same frequencies (Hoeffding bound)."""
        bound = math.sqrt(0.5 * math.log(2 / _ALPHA))
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.entered[a], self.entered[b]
            if not n or not m:
                continue
            wide = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.final[a] / n - self.final[b] / m) >= wide:
                return False
            for s in self.freq[a].keys() | self.freq[b].keys():
                if abs(self.freq[a].get(s, 0) / n - self.freq[b].get(s, 0) / m) >= wide:
                    return False
            todo += [(self.go[a][s], self.go[b][s]) for s in self.go[a].keys() & self.go[b].keys() if self.go[a][s] != self.go[b][s]]
        return True

    def fold(self, a, b):
        """Adds the tree below state b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.entered[a] += self.entered[b]
            self.final[a] += self.final[b]
            for s, child in self.go[b].items():
                self.freq[a][s] = self.freq[a].get(s, 0) + self.freq[b][s]
                if s in self.go[a]:
                    if self.go[a][s] != child:
                        todo.append((self.go[a][s], child))
                else:
                    self.go[a][s] = child

    def score(self, word):
        """Log likelihood per character of a word of classes; unseen steps go back to the start."""
        total, at = 0.0, 0
        for s in word:
            n, seen = self.entered[at], self.freq[at].get(s, 0)
            total += math.log((seen + 0.001) / (n + 0.011)) - math.log(_CLASS_SIZE.get(s, 1))
            at = self.go[at].get(s, 0)
        total += math.log((self.final[at] + 0.001) / (self.entered[at] + 0.011))
        return total / max(1, len(word))


def infer(words):
    """Merges the compatible states of the prefix tree of ``words``, starting at the root."""
    tree = Automaton()
    tree.state()
    for word in words:
        tree.add(word)
    kept, parents = [0], {}
    while True:
        fringe = []
        for r in kept:
            for s, child in tree.go[r].items():
                if child not in kept:
                    fringe.append((-tree.entered[child], r, s, child))
        if not fringe:
            return tree
        _, r, s, child = min(fringe)
        for other in kept:
            if tree.similar(other, child):
                tree.go[r][s] = other
                tree.fold(other, child)
                break
        else:
            kept.append(child)


def fit(values):
    """(automaton, least score): what the labelled values of a kind score, but for the lowest twentieth."""
    automaton = infer([symbols(v) for v in values])
    scores = sorted(automaton.score(symbols(v)) for v in values)
    return automaton, scores[len(scores) // 20]


def accept(word, models, background):
    """The kind whose format a value, as classes, has, or None: typical of its automaton and far from the background."""
    common = background.score(word)
    best = None
    for kind, (automaton, least) in models.items():
        score = automaton.score(word)
        if score >= least and score - common >= _MARGIN and (best is None or score > best[0]):
            best = (score, kind)
    return best[1] if best else None


def _answer(models, background):
    import pyarrow as pa

    table = str.maketrans(_CLASSES)

    def run(batches):
        known = {}  # the answers for short runs of classes, which repeat

        def kind_of(value):
            word = value.translate(table)
            if len(word) > _REMEMBERED:
                return accept(word, models, background)
            if word not in known:
                if len(known) >= 1 << 18:
                    known.clear()
                known[word] = accept(word, models, background)
            return known[word]

        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = find_base(text or "")
                plain = [f"{kind}:{start}:{end}" for kind, start, end, _ in base]
                spans = [(s[1], KINDS.index(s[0]), p) for s, p in zip(base, plain)]
                added = 0
                for _, start, end, value in find_candidates(text or "", base) if models else []:
                    kind = kind_of(value)
                    if kind is not None:
                        spans.append((start, len(KINDS) + KINDS.index(kind), f"like_{kind}:{start}:{end}"))
                        added += 1
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(",".join(plain).encode()).hexdigest(), ",".join(s[2] for s in sorted(spans)), added))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["id", *names])

    return run


def fit_models(rows: DataFrame, sample: int = SAMPLE):
    """Automata by kind from bounded samples, and one state of the class frequencies of all candidates for the background.

    The sample of a kind is the ``sample`` distinct values with the smallest hashes.
    """
    labelled = cut_lineage(rows.mapInArrow(_labelled, "kind string, value string").where(F.length("value") <= LONGEST_SAMPLE).distinct())
    models = {}
    for kind in KINDS:
        known = [r["value"] for r in labelled.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()]
        if len(known) >= LEAST_SAMPLE:
            models[kind] = fit(known)
    background = Automaton()
    background.state()
    background.add([])
    counts = rows.mapInArrow(_count_symbols, "symbol string, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    for r in counts.orderBy("symbol").collect() if models else []:
        background.entered[0] += r["n"]
        background.freq[0][r["symbol"]] = r["n"]
        background.go[0][r["symbol"]] = 0
    return models, background


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row: (key, n_assign, n_access, n_hex, base_sha256, spans, n_added).

    Base spans have one of three fixed formats. Their values are labelled credentials: for each kind, the prefix
    tree of up to ``sample`` distinct values, as character classes, is folded into a probabilistic automaton by
    merging states that a Hoeffding test cannot tell apart. Every other run of credential characters with a
    letter and a digit, as long as the shortest value that a format finds (6), is then scored by all automata. One that scores like the labelled
    values, and better than the class frequencies of all such runs, is added as like_<kind>.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. base_sha256 covers the base
    spans. A null text counts as empty, a null key is an ordinary key, repeated rows each have their row, an empty
    table gives no rows, other columns are ignored. With fewer than 20 labelled values a kind has no automaton.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    models, background = fit_models(rows, sample)
    out = rows.mapInArrow(_answer(models, background), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", key)
