"""Language identification by Bayesian fusion of text, markup, address and host evidence."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rundiff.llm import arrays
from rundiff.llm.tables import free_prefix, only
from rundiff.session import cut_lineage

SAMPLE = 200  # labelled texts per language that the text model is fitted on
LONGEST_SAMPLE = 20000  # characters of such a text that count: its first
STRENGTH = 20.0  # rows that the prior of the level above counts for
LEAST_CONFIDENCE = 0.5
UNKNOWN = "und"
_BINS = 1 << 16
_SMOOTH = 0.5
_UNKNOWN_TRIGRAM = -math.log(1 << 16)  # what a trigram costs under no language: all bins alike
_TEMPER = 1 / 3  # each letter is part of three trigrams
_CHUNK = 1 << 22
_KEPT = ("id", "row_key", "declared", "suffix", "host", "domain", "words")


def trigrams(data):
    """Bins of the byte triples of a lower-cased text."""
    data = data.astype(np.uint32)
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    return ((data[:-2] * 40503 + data[1:-1] * 277 + data[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.uint16) if len(data) > 2 else np.zeros(0, np.uint16)


def fit_text(samples):
    """(languages, log probabilities of the bins): one trigram model per language from {language: texts}."""
    languages, rows = [], []
    for language, texts in sorted(samples.items()):
        counts = np.full(_BINS, _SMOOTH)
        for text in texts:
            counts += np.bincount(trigrams(np.frombuffer(text.encode(), np.uint8)), minlength=_BINS)
        languages.append(language)
        rows.append(np.log(counts / counts.sum()))
    return languages, np.array(rows, dtype=np.float32).reshape(len(rows), _BINS)


def _likelihoods(model):
    """Adds ``text_ll``, the tempered log likelihood of the text under each language and under none, and ``belief``,
    the posterior from the text alone, zero for a text without words."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            data, offsets = arrays.text_buffer(batch.column("text"))
            out = np.zeros((batch.num_rows, len(model) + 1))
            for i in range(batch.num_rows):
                for at in range(offsets[i], offsets[i + 1], _CHUNK):
                    bins = trigrams(data[at : min(at + _CHUNK + 2, offsets[i + 1])])
                    for k, row in enumerate(model):
                        out[i, k] += float(row[bins].sum(dtype=np.float64)) * _TEMPER
                    out[i, -1] += len(bins) * _UNKNOWN_TRIGRAM * _TEMPER
            believed = _softmax(out) * np.array(batch.column("words"))[:, None]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * (len(model) + 1), pa.int32()), pa.array(x.ravel())) for x in (out, believed)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _KEPT], *lists], names=[*_KEPT, "text_ll", "belief"])

    return run


def _softmax(logs):
    weights = np.exp(logs - logs.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def _fuse(names, everything, totals):
    """The posterior of each row from its likelihoods and the counts of its evidence, without its own part in them."""
    import pyarrow as pa

    def run(batches):
        n = len(names)
        for batch in batches:
            matrix = lambda c: np.array(batch.column(c).flatten()).reshape(-1, n)

            def counts(column):
                known = ~np.array(batch.column(column).is_null())
                out = np.zeros((batch.num_rows, n))
                out[known] = np.array(batch.column(column).drop_null().flatten()).reshape(-1, n)
                return known[:, None], np.maximum(0.0, out - own)

            logs, own = matrix("text_ll"), matrix("belief")
            for column in ("declared", "suffix"):
                values, total = totals[column]
                known, others = counts(f"{column}_counts")
                share = (others + _SMOOTH) / (np.maximum(0.0, total - own) + _SMOOTH * max(1, values))
                logs = logs + np.where(known, np.log(share), 0.0)
            prior = np.tile((everything + 1) / (everything.sum() + n), (batch.num_rows, 1))
            for column in ("domain", "host"):
                known, others = counts(f"{column}_counts")
                prior = np.where(known, (others + STRENGTH * prior) / (others.sum(axis=1, keepdims=True) + STRENGTH), prior)
            posterior = _softmax(logs + np.log(prior))
            words = np.array(batch.column("words"))
            best = np.where(words, posterior.argmax(axis=1), n - 1)
            sure = np.where(words, posterior.max(axis=1), 0.0)
            kept = words & (best < n - 1) & (sure >= LEAST_CONFIDENCE)
            columns = [batch.column("id"), batch.column("row_key"), pa.array([names[k] for k in best], pa.string()), pa.array(sure), batch.column("declared"), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row_key", "language", "confidence", "declared", "kept"])

    return run


def page_evidence(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, text, declared, suffix, host) of web pages: visible text, the language the markup declares, the last
    label of the host name or a two-letter first path segment, and the host."""
    page = F.coalesce(F.col(html).cast("string"), F.lit(""))
    some = lambda c: F.when(c != "", F.lower(c))
    text = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*+>", " "), r"<[^>]*+>", " ")
    host = some(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*+://([^/:?#]++)", 1))
    path = some(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*+://[^/?#]++/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return pages.select(
        F.col(key),
        text.alias("text"),
        some(F.regexp_extract(page, r"""(?i)<html\b[^>]*?\blang\s*+=\s*+["']?([A-Za-z]{2,3})""", 1)).alias("declared"),
        F.coalesce(path, F.substring_index(host, ".", -1)).alias("suffix"),
        host.alias("host"),
    )


def domain_of(host: Column) -> Column:
    """The last two labels of a host name; null where there are no more."""
    return F.when(F.size(F.split(host, r"\.")) > 2, F.substring_index(host, ".", -2))


def _fit(table):
    """The model of one declared language, as bytes."""
    import pyarrow as pa

    languages, rows = fit_text({table.column("declared")[0].as_py(): table.column("text").to_pylist()})
    return pa.table({"declared": pa.array(languages, pa.string()), "model": pa.array([row.tobytes() for row in rows], pa.binary())})


def fit_languages(rows: DataFrame, most: int) -> tuple:
    """(languages, models) of all declared languages, each fitted on the starts of texts with the smallest hashes.

    Only hashes are ranked and written. Texts are picked by language and hash, so no language owns a task, and texts
    move only if the picked hashes are too many to send to all tasks. Each language is fitted in a task of its own.
    """
    usable = rows.where("declared IS NOT NULL AND text <> ''").select("declared", F.substring("text", 1, LONGEST_SAMPLE).alias("text"))
    hashed = usable.withColumn("h", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("declared").orderBy("h"))
    first = cut_lineage(hashed.select("declared", "h").distinct().withColumn("place", place).where(F.col("place") <= most).drop("place"))
    texts = hashed.join(first, ["declared", "h"]).groupBy("declared", "h").agg(F.first("text").alias("text"))
    fitted = texts.groupBy("declared").applyInArrow(_fit, "declared string, model binary").orderBy("declared").collect()
    return [r["declared"] for r in fitted], np.array([np.frombuffer(r["model"], np.float32) for r in fitted], dtype=np.float32).reshape(len(fitted), _BINS)


def identify_language(docs: DataFrame, key: str = "doc_id", text: str = "text", declared: str | None = "lang", host: str | None = "source", suffix: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per row: (key, row_key, language, confidence, declared, kept).

    A text has a likelihood under each declared language, however many there are, from byte trigrams fitted on the
    starts of up to ``sample`` of its texts, and under none. Counts over all rows give how often a language is declared as another,
    how often it occurs under an address suffix, and how often at a host; a host is smoothed towards its domain and
    a domain towards all rows, and a row does not count towards its own prior. The posterior is their product.
    ``kept`` means that the text has a word and that a language, not ``und``, is believed with a
    confidence of at least one half. row_key is equal for equal rows only.

    A null or empty text is ``und`` and not kept. Null evidence is left out. Repeated rows have equal answers.
    In a table that declares no language every text is ``und``, and as nothing speaks against them, texts with a word
    are kept. An empty table gives no rows. Other columns are ignored.
    """
    optional = lambda c: (F.lower(F.col(c).cast("string")) if c else F.lit(None).cast("string"))
    body = F.col(text).cast("string")
    rows = docs.select(
        F.col(key).alias("id"),
        document_key(docs, key, text, declared, host, suffix).alias("row_key"),
        body.alias("text"),
        optional(declared).alias("declared"),
        optional(suffix).alias("suffix"),
        optional(host).alias("host"),
        (domain_of(optional(host)) if host else F.lit(None).cast("string")).alias("domain"),
        F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    languages, model = fit_languages(rows, sample)
    names = [*languages, UNKNOWN]
    columns = f"id {kind}, row_key string, declared string, suffix string, host string, domain string, words boolean, text_ll array<double>, belief array<double>"
    scored = cut_lineage(rows.mapInArrow(_likelihoods(model), columns))
    if not languages:
        return scored.select(F.col("id").alias(key), "row_key", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"), "declared", F.col("words").alias("kept"))
    sums = F.array(*[F.sum(F.col("belief")[k]) for k in range(len(names))])
    everything = np.array(scored.agg(sums).first()[0] or [0.0] * len(names), dtype=float)
    rows, totals = scored, {}
    for column in ("declared", "suffix", "domain", "host"):
        table = cut_lineage(scored.where(F.col(column).isNotNull()).groupBy(column).agg(sums.alias(f"{column}_counts")))
        if column in ("declared", "suffix"):
            parts = F.array(*[F.sum(F.col(f"{column}_counts")[k]) for k in range(len(names))])
            values, total = table.agg(F.count("*"), parts).first()
            totals[column] = (values, np.array([t or 0.0 for t in total]))
        rows = rows.join(table, column, "left")
    answers = f"id {kind}, row_key string, language string, confidence double, declared string, kept boolean"
    return rows.mapInArrow(_fuse(names, everything, totals), answers).withColumnRenamed("id", key)


def document_key(docs: DataFrame, *columns: str | None) -> Column:
    """A string that is equal for rows that are equal in the columns."""
    used = [F.col(c).cast("string") for c in columns if c]
    return F.concat_ws(":", used[0], F.xxhash64(*used).cast("string"))


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """``docs`` without the rows whose language is not identified; same columns. The rejected rows are joined, not the kept ones."""
    answers = identify_language(docs, key, text, declared, host)
    p = free_prefix(docs)
    rejected = cut_lineage(answers.where(~F.col("kept")).select(F.col("row_key").alias(f"{p}gone")).distinct())
    keyed = docs.withColumn(f"{p}row", document_key(docs, key, text, declared, host))
    return only(keyed.join(rejected, F.col(f"{p}row") == F.col(f"{p}gone"), "left_anti"), docs.columns)
