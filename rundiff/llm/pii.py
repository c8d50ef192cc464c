"""Find personal data by fixed formats, and by contexts bootstrapped from what those find. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rundiff.llm.tables import free_prefix, only
from rundiff.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 3  # distinct seeds that a pattern must surround
LEAST_CONFIDENCE = 0.8
_LONG = 64  # characters of a context word that is not stood for by its hash, at most
_WORD = r"[^\x20\x09-\x0D]++"

# The formats, written so that no position is tried twice: a match starts where a run starts or where the
# last match ended, and quantifiers do not give back. They match what the plain formats match, except that
# card runs of other than 16 to 19 digits, which would be dropped, do not match at all.
_FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "word": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
}


def _possible(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": text.contains("+"),
        "word": text.rlike("[0-9@]"),
    }[kind]


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    total = F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    """Whether a match passes the test of its kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))
    return (
        F.when(kind == "ip", parts)
        .when(kind == "card", _luhn(digits))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )


def _scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, rid, found, text): per kind with a match, the matches and what lies between them; the text if there are any."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), row_key(F.col(key), whole).alias("rid"), whole.alias("text"))
    parts = []
    for kind, pattern in _FORMATS.items():
        gaps = F.split("text", pattern, -1)
        found = F.struct(
            F.lit(kind).alias("kind"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("matches"),
            F.transform(gaps, lambda g: F.struct(F.length(g).alias("n"), F.octet_length(g).alias("bytes"), F.regexp_count(g, F.lit(_WORD)).alias("words"), _solid(F.left(g, F.lit(1))).alias("opens"), _solid(F.right(g, F.lit(1))).alias("closes"))).alias("gaps"),
        )
        parts.append(F.when(_possible(kind, F.col("text")), found))
    found = F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.size(p["matches"]) > 0))
    return rows.select("id", "rid", found.alias("found"), "text").withColumn("text", F.when(F.size("found") > 0, F.col("text")))


def _solid(c: Column) -> Column:
    """Whether a character is one of a word, as a number; the empty text is not."""
    return c.rlike(_WORD).cast("int")


def row_key(key: Column, text: Column) -> Column:
    """What tells rows apart: equal rows have equal spans."""
    return F.concat_ws(":", key.cast("string"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).cast("string"))


def _occurrences(scanned: DataFrame) -> DataFrame:
    """(rid, kind, start, end, from, to, value, patterns): all matches with their places in characters and bytes, and their contexts.

    The words that start in a gap or a match are counted up to each match, which begins and ends inside a word.
    """
    several = scanned.where(F.size("found") > 0).select("rid", "found", "text").dropDuplicates(["rid"])
    flat = several.select("rid", F.explode("found").alias("f")).select("rid", F.col("f.kind").alias("kind"), F.posexplode(F.arrays_zip("f.matches", "f.gaps")), F.col("f.gaps").alias("gaps"))
    flat = flat.select(
        "rid",
        "kind",
        F.col("pos").alias("i"),
        F.col("col.matches").alias("value"),
        F.col("col.gaps.n").alias("gap"),
        F.col("col.gaps.bytes").alias("gap_bytes"),
        F.col("col.gaps.words").alias("gap_words"),
        F.col("col.gaps.opens").alias("opens"),
        F.col("col.gaps.closes").alias("closes"),
    )
    order = Window.partitionBy("rid", "kind").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    gap_starts = F.col("gap_words") - F.when(F.col("i") > 0, F.col("opens")).otherwise(0)
    joined = F.when(F.col("gap") > 0, F.col("closes")).otherwise((F.col("i") > 0).cast("int"))  # to the word before the match
    starts = F.coalesce(F.regexp_count("value", F.lit(_WORD)), F.lit(0))
    length, size = F.coalesce(F.length("value"), F.lit(0)), F.coalesce(F.octet_length("value"), F.lit(0))
    placed = flat.select(
        "rid",
        "kind",
        "value",
        F.sum(gap_starts + F.when(F.col("value").isNull(), 0).otherwise(starts - joined)).over(upto).alias("last"),
        starts.alias("n"),
        (F.sum(F.col("gap") + length).over(upto)).cast("long").alias("end"),
        (F.sum(F.col("gap_bytes") + size).over(upto)).cast("long").alias("to"),
    ).where("value IS NOT NULL")
    placed = placed.withColumn("start", F.col("end") - F.length("value")).withColumn("from", F.col("to") - F.octet_length("value"))
    columns = ("kind", "start", "end", "from", "to", "value")
    listed = placed.where(_holds(F.col("kind"), F.col("value"))).groupBy("rid").agg(F.collect_list(F.struct(*columns, "last", "n")).alias("listed"))
    plain = F.split(F.regexp_replace(F.lower("text"), "[0-9]", "0"), r"[\x20\x09-\x0D]+")
    short = lambda w: F.when(F.length(w) <= _LONG, w).otherwise(F.concat(F.lit("#"), F.xxhash64(w).cast("string")))
    words = F.transform(F.filter(plain, lambda w: w != ""), short)
    told = listed.join(several.select("rid", words.alias("words")), "rid")
    told = told.select("rid", F.explode(F.transform("listed", lambda o: F.struct(*[o[c].alias(c) for c in columns], _patterns(F.col("words"), o["last"] - o["n"] + 1, o["last"]).alias("patterns")))).alias("o"))
    return told.select("rid", "o.*")


def _patterns(words: Column, first: Column, last: Column) -> Column:
    """The contexts of an occurrence in some words: two words before, one on either side, two words after."""
    at = lambda i: F.get(words, (i - 1).cast("int"))
    made = F.array(
        F.concat(F.lit("left "), at(first - 2), F.lit(" "), at(first - 1)),
        F.concat(F.lit("both "), at(first - 1), F.lit(" "), at(last + 1)),
        F.concat(F.lit("right "), at(last + 1), F.lit(" "), at(last + 2)),
    )
    return F.filter(made, lambda p: p.isNotNull())


def _bootstrap(occurrences: DataFrame, rounds: int) -> DataFrame:
    """Spans that high-confidence contexts add: (rid, kind, start, end, from, to).

    Seeds are the base values, instances all words with a digit or an at sign that no base span touches.
    The graph has an edge for each distinct (context, instance). Each round scores a context for a kind by the
    share of its instances believed to be of that kind, and an instance by the contexts it occurs in.
    """
    by_place = Window.partitionBy("rid").orderBy("start", "end", "kind")
    is_base = F.col("kind") != "word"
    covered = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start"), F.lit(False))
    covers = F.coalesce(F.min(F.when(is_base, F.col("start"))).over(by_place.rowsBetween(1, Window.unboundedFollowing)) < F.col("end"), F.lit(False))
    free = occurrences.withColumn("touched", covered | covers).where(is_base | ~F.col("touched"))
    free = free.withColumn("seed", F.when(is_base, F.col("kind")))
    edges = free.select(F.explode("patterns").alias("pattern"), F.xxhash64("value").alias("value"), "seed").distinct()
    seeded = edges.where("seed IS NOT NULL").groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= LEAST_SEEDS)
    edges = cut_lineage(edges.join(seeded.select("pattern"), "pattern"))
    if edges.where("seed IS NULL").isEmpty():
        return occurrences.where("false").select("rid", "kind", "start", "end", "from", "to")
    kinds = F.array(*map(F.lit, KINDS))
    beliefs = edges.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    sizes = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    scores = None
    for _ in range(rounds):
        told = edges.select("pattern", "value").distinct().join(beliefs, "value")
        told = told.groupBy("pattern", "kind").agg(F.sum("belief").alias("sure"), F.sum(F.when(F.col("belief") == 1.0, 1).otherwise(0)).alias("seeds"))
        scores = told.where(F.col("seeds") >= LEAST_SEEDS).join(sizes, "pattern").select("pattern", "kind", (F.col("sure") / F.col("n")).alias("score"))
        scores = cut_lineage(scores)
        unseen = edges.where("seed IS NULL").select("pattern", "value").distinct().join(scores, "pattern")
        unseen = unseen.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("score")))))).alias("belief"))
        unseen = unseen.withColumn("belief", F.least("belief", F.lit(0.999)))
        beliefs = cut_lineage(edges.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct().unionByName(unseen))
    strong = scores.where(F.col("score") >= LEAST_CONFIDENCE)
    words = free.where("seed IS NULL").drop("kind").withColumn("pattern", F.explode("patterns"))
    hits = words.join(strong, "pattern").groupBy("rid", "start", "end", "from", "to").agg(F.max(F.struct("score", "kind")).alias("best"))
    return hits.where(F.array_contains(kinds, F.col("best.kind"))).select("rid", F.concat(F.lit("like_"), F.col("best.kind")).alias("kind"), "start", "end", "from", "to")


def _spans(scanned: DataFrame, rounds: int) -> DataFrame:
    """(rid, kind, start, end, from, to) of all base spans and added spans, once for each distinct row."""
    occurrences = cut_lineage(_occurrences(scanned))
    base = occurrences.where("kind <> 'word'").select("rid", "kind", "start", "end", "from", "to")
    return cut_lineage(base.unionByName(_bootstrap(occurrences, rounds)))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row: (key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added).

    Base spans have one of four fixed formats, leftmost and non-overlapping within a kind; matches that fail the
    test of their kind are dropped. Base values are seeds: the words before and after those they are in, with digits as 0, make
    contexts, contexts and values make a graph that is scored in ``rounds`` rounds, and words in contexts of high confidence are added as
    like_<kind>. Spans are kind:start:end in code points, end exclusive, by kind and then start; base_sha256
    covers the base spans.

    A null text counts as empty, a null key is an ordinary key, repeated rows each have their row, an empty table
    gives no rows, other columns are ignored.
    """
    scanned = cut_lineage(_scan(docs, key, text))
    spans = _spans(scanned, rounds)
    listed = [*KINDS, *[f"like_{k}" for k in KINDS]]
    place = F.array_position(F.array(*map(F.lit, listed)), F.col("kind")).cast("int")
    told = F.concat_ws(":", "kind", "start", "end")
    by_row = spans.groupBy("rid").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.collect_list(F.struct(place.alias("place"), "start", told.alias("told")))).alias("all"),
    )
    join = lambda c: F.array_join(F.transform(c, lambda s: s["told"]), ",")
    by_row = by_row.select(
        "rid",
        *[f"n_{k}" for k in KINDS],
        join(F.filter("all", lambda s: s["place"] <= len(KINDS))).alias("base"),
        join(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda s: s["place"] > len(KINDS))).cast("long").alias("n_added"),
    )
    return scanned.select("id", "rid").join(by_row, "rid", "left").select(
        F.col("id").alias(key),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"),
    )


def redact_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; same columns, same rows.

    Overlapping spans are replaced once, by the kind of the first. Texts are cut at byte positions, which takes
    time in proportion to the text. Nulls and repeated rows are as in ``find_pii``.
    """
    spans = _spans(cut_lineage(_scan(docs, key, text)), rounds)
    order = Window.partitionBy("rid").orderBy("from", F.desc("to"), "kind")
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", (F.coalesce(reach, F.lit(-1)) <= F.col("from")).cast("int"))
    merged = opened.withColumn("group", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("rid", "group").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.max(F.when(F.col("opens") == 1, F.col("kind"))).alias("kind"))
    before = F.coalesce(F.lag("to").over(Window.partitionBy("rid").orderBy("from")), F.lit(0))
    merged = merged.withColumn("before", before)
    by_row = merged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("from", "before", "to", "kind"))).alias("cuts"))
    p = free_prefix(docs)
    by_row = cut_lineage(by_row.select(F.col("rid").alias(f"{p}rid"), F.col("cuts").alias(f"{p}cuts")))
    raw = F.col(text).cast("binary")
    piece = lambda c: F.concat(F.substring(raw, (c["before"] + 1).cast("int"), (c["from"] - c["before"]).cast("int")).cast("string"), F.lit("["), F.upper(F.regexp_replace(c["kind"], "^like_", "")), F.lit("]"))
    last = F.element_at(f"{p}cuts", -1)["to"]
    made = F.concat(F.array_join(F.transform(f"{p}cuts", piece), ""), F.substring(raw, (last + 1).cast("int"), F.octet_length(text)).cast("string"))
    joined = docs.withColumn(f"{p}row", row_key(F.col(key), F.col(text))).join(by_row.hint("shuffle_hash"), F.col(f"{p}row") == F.col(f"{p}rid"), "left")
    return only(joined.withColumn(text, F.when(F.col(f"{p}cuts").isNull(), F.col(text)).otherwise(made)), docs.columns)
