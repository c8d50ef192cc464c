"""Mix sources to target weights by Pareto order sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rundiff.llm.tables import free_prefix, only, row_struct
from rundiff.session import cut_lineage

WEIGHTS = (5, 2, 1)
LIMIT = 3
_BUCKET = 256  # documents in one bucket of ranks, about
_EQUAL = 4096  # equal rows that one task numbers


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """Target words of each source, from (source, source_size).

    Sources in code point order, null last, have the weights in turn and share all words. A target
    stops at ``limit`` times the size of its source and the excess is shared again by weight. The
    shares that result are min(limit * size, level * weight) for one level, which is found by sorting
    the sources by the level at which they fill up. One row per source is all that is sorted here.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighted = weighted.withColumn("full", F.lit(float(limit)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # the level if this source and all that fill up later stay open
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = weighted.withColumn("level", level).withColumn("open", F.col("full") / F.col("weight") >= F.col("level"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("full") / F.col("weight"), F.col("level")))).over(everything)
    return leveled.select(
        "source", "source_size", F.least("full", F.coalesce(first["level"], F.lit(float("inf"))) * F.col("weight")).alias("target")
    )


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _take_first(docs: DataFrame) -> DataFrame:
    """Adds ``fits``: whether the words of all documents up to this one, by rank, stay within the budget of the source.

    ``budget`` is a column of the rows, the same for all of a source. The running sum has two levels: sums of rank
    buckets, then rows inside a bucket.
    """
    docs = docs.withColumn("bucket", F.floor(F.col("u") * F.col("n_buckets")))
    inside = Window.partitionBy("source_no", "bucket").orderBy("rank", F.desc("size"), "row_key", "nth").rowsBetween(Window.unboundedPreceding, 0)
    sums = docs.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    # buckets wholly below or above the budget need no order
    settled = docs.join(sums, ["source_no", "bucket"])
    whole = F.col("before") + F.col("bucket_size") <= F.col("budget")
    cut = ~whole & (F.col("before") <= F.col("budget"))
    even = settled.where(~cut).withColumn("fits", whole)
    mixed = settled.where(cut).withColumn("fits", F.col("before") + F.sum("size").over(inside) <= F.col("budget"))
    return even.unionByName(mixed).drop("bucket", "bucket_size", "before")


def _still_fit(rows: DataFrame, granted: DataFrame) -> DataFrame:
    """The rows no larger than what is left of their budget after the words granted, with that as their budget."""
    used = granted.groupBy("source_no").agg(F.sum("size").alias("used"))
    left = rows.join(used, "source_no", "left").withColumn("budget", F.col("budget") - F.coalesce("used", F.lit(0)))
    return left.where("size <= budget").select(*rows.columns)


def _odds_per_word(rows: DataFrame) -> DataFrame:
    """(source_no, per_word): inclusion odds are per_word times the measure of a document, 1 at most, such that the
    words expected are the budget.

    Documents that would pass 1 are certain: the measures are gone through from the greatest, as long as what is
    left of the budget would give the next one more than 1. One row per source and measure is all that is sorted.
    """
    words = rows.groupBy("source_no", "measure").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    order = Window.partitionBy("source_no").orderBy(F.desc("measure"))
    certain = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("words") * F.col("measure")).over(order.rowsBetween(0, Window.unboundedFollowing))
    tried = words.withColumn("per_word", (F.col("budget") - certain) / open_)
    return tried.where("per_word * measure <= 1").groupBy("source_no").agg(F.max_by("per_word", "measure").alias("per_word"))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, limit: float = LIMIT, weight: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: (key, size, source_size, target, taken, copies).

    Every source is expected to be taken target / source_size times. The whole part of that is certain for each of
    its documents. The rest of the target is sampled: documents have inclusion odds in proportion to their size
    (times ``weight``, if given), those that would pass 1 being certain; they are ranked by random odds divided by
    inclusion odds, and taken in that order while their words fit. Then the later documents that fit the gap are
    taken the same way, as often as any fits, and then further copies of small ones, as long as ``limit`` allows: what
    is missing in the end is less than the smallest document that could still be taken. No target is exceeded. The
    random numbers are hashes of key, size and the number of a copy, so reruns agree.

    Nulls: a null text has size 0, a null source is a source of its own (last), a null key is an ordinary key. Rows of
    size 0 are taken 0 times. Rows with equal key, source and size are numbered, so each is drawn by itself and may
    get another count. An empty table gives no rows. Other columns are ignored.
    """
    equal = docs.select(
        F.col(key).alias("row_key"),
        F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("doc_weight"),
    )
    equal = cut_lineage(equal.groupBy("row_key", "source", "size", "doc_weight").agg(F.count("*").alias("many")))
    sources = equal.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.sum("many").alias("n"))
    targets = source_targets(sources.select("source", "source_size"), weights, limit)
    sources = targets.join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a ratio a rounding error below a whole number counts as that number
    sources = sources.withColumn("copies", F.floor(ratio + 1e-9)).withColumn("odds", F.greatest(F.lit(0.0), ratio - F.col("copies")))
    sources = sources.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    sources = cut_lineage(sources.withColumn("source_no", number).withColumn("n_buckets", F.ceil(F.col("n") / _BUCKET)))

    # equal rows apart, those of a large group over many tasks
    blocks = equal.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("many") - 1) / _EQUAL))))
    blocks = blocks.repartition("row_key", "size", "block")
    nth = F.sequence(F.col("block") * _EQUAL, F.least(F.col("many"), (F.col("block") + 1) * _EQUAL) - 1)
    rows = blocks.withColumn("nth", F.explode(nth)).drop("block", "many")
    known = sources.select(F.col("source").alias("s"), "source_no", "source_size", "target", "copies", "odds", "budget", "n_buckets")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("measure", F.col("size") * F.col("doc_weight"))
    rows = cut_lineage(rows.withColumn("rid", F.monotonically_increasing_id()))
    per_word = cut_lineage(_odds_per_word(rows.where("measure > 0")))
    drawn = rows.join(per_word, "source_no", "left").withColumn("expected", F.coalesce(F.col("per_word"), F.lit(0.0)) * F.col("measure"))
    chance = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("expected")))
    drawn = drawn.withColumn("draw", uniform(F.col("row_key"), F.col("size"), F.col("nth")))
    random_odds = F.col("draw") / (1 - F.col("draw"))
    drawn = drawn.withColumn("rank", F.when(F.col("expected") >= 1, 0.0).otherwise(random_odds / (chance / (1 - chance))))
    # ranks as positions in (0, 1), by the mean odds, so that buckets hold similar numbers of rows
    mean = F.greatest(F.col("odds"), F.lit(1e-9)) / (1 - F.least(F.col("odds"), F.lit(1 - 1e-9)))
    drawn = drawn.withColumn("u", F.least(F.col("rank") * mean / (1 + F.col("rank") * mean), F.lit(1 - 1e-12)))
    columns = ["rid", "row_key", "nth", "size", "copies", "source_no", "budget", "n_buckets", "rank", "u"]

    # every join with a table of the sources takes memory of the driver, so rows carry what they need of it
    first = cut_lineage(_take_first(cut_lineage(drawn.select(*columns, "source_size", "target"))))
    granted, left, grants, level = first.where("fits AND size > 0"), first.where("NOT fits AND size > 0"), [], 0
    while True:
        left = cut_lineage(_still_fit(left.select(*columns), granted))
        while left.isEmpty():  # none fits once; those taken may fit once more
            level += 1
            if level >= limit:
                break
            again = first.where("size > 0").where(F.col("copies") + level + 1 <= limit).select(*columns)
            every = reduce(DataFrame.union, grants, first.where("fits AND size > 0").select("rid", "source_no", "size"))
            left = cut_lineage(_still_fit(again, every))
        if level >= limit:
            break
        taken = cut_lineage(_take_first(left))
        granted, left = taken.where("fits").select("rid", "source_no", "size"), taken.where("NOT fits")
        grants.append(granted)
    extra = F.col("fits").cast("long")
    if grants:
        more = reduce(DataFrame.union, grants).groupBy("rid").agg(F.count("*").alias("more"))
        first = first.join(more, "rid", "left")
        extra = extra + F.coalesce("more", F.lit(0))
    copies = F.when(F.col("size") > 0, F.col("copies") + extra).otherwise(0).cast("long")
    return first.select(
        F.col("row_key").alias(key), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies")
    )


def take_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as ``mix_sources`` takes it; same columns."""
    p = free_prefix(docs)
    keyed = docs.withColumn(f"{p}key", row_struct(F.col(key), F.col(text)))
    counts = mix_sources(keyed, f"{p}key", source, text, weights, limit)
    counts = cut_lineage(counts.groupBy(F.col(f"{p}key").alias(f"{p}own")).agg(F.sum("copies").alias(f"{p}copies"), F.count("*").alias(f"{p}rows")))
    if not counts.where(f"{p}rows > 1").isEmpty():
        keyed = keyed.dropDuplicates([f"{p}key"])
    taken = keyed.join(counts.where(f"{p}copies > 0").hint("shuffle_hash"), F.col(f"{p}key").eqNullSafe(F.col(f"{p}own")))
    return only(taken.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}copies")))), docs.columns)
