"""Exact Jaccard join of word n-gram sets by set-relation skipping."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rundiff.llm import arrays
from rundiff.llm.graph import components
from rundiff.llm.tables import free_prefix, only, row_struct
from rundiff.session import cut_lineage

_BUCKET_TOKENS = 2_000_000  # shingles of one bucket of the token count, about
_GROUP_SETS = 2048  # sets whose shared shingles meet in one place, about
_FLUSH_TOKENS = 1_500_000  # shingles that a task holds before it sends them
_BLOCK = 512  # entries of one block of an index list, about
_BAND = 1.05  # ratio of set sizes in one band


def _fingerprints(width):
    """(id, n, set_key) of every row."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            n, keys = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.uint64)
            for i, words in arrays.row_words(batch.column("text")):
                tokens = arrays.shingle_set(words, width)
                n[i], keys[i] = len(tokens), arrays.set_key(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(keys.view(np.int64))], names=["id", "n", "set_key"])

    return run


def _send_tokens(width, buckets):
    """(bucket, blob): the shingles of many sets dealt by hash; a task sends equal sets once per flush.

    A blob holds the number of sets in it, their keys, sizes and counts, then the shingles.
    """
    import pyarrow as pa

    def flush(keys, sets):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        where = (tokens % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint64)
        order = np.argsort(where, kind="stable")
        tokens, owner, where = tokens[order], owner[order], where[order]
        edges = np.flatnonzero(np.diff(where)) + 1
        keys = np.array(keys, dtype=np.uint64)
        numbers, blobs = [], []
        for a, b in zip(np.r_[0, edges], np.r_[edges, len(tokens)]):
            runs = np.r_[0, np.flatnonzero(np.diff(owner[a:b])) + 1]
            own = owner[a:b][runs]
            counts = np.diff(np.r_[runs, b - a]).astype(np.uint32)
            numbers.append(int(where[a]))
            blobs.append(
                np.int64(len(own)).tobytes() + keys[own].tobytes() + sizes[own].astype(np.uint32).tobytes() + counts.tobytes() + tokens[a:b].tobytes()
            )
            if len(blobs) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])
                numbers, blobs = [], []
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches):
        seen, sets, held = {}, [], 0
        for batch in batches:
            for _, words in arrays.row_words(batch.column("text")):
                tokens = arrays.shingle_set(words, width)
                key = arrays.set_key(tokens)
                if not len(tokens) or key in seen:
                    continue
                seen[key] = None
                sets.append(tokens)
                held += len(tokens)
                if held >= _FLUSH_TOKENS:
                    yield from flush(list(seen), sets)
                    seen, sets, held = {}, [], 0
        if sets:
            yield from flush(list(seen), sets)

    return run


def _pack(keys, sizes, tokens, counts):
    """Sets with their sizes, and tokens with the numbers of sets that hold them; rows are sorted by key."""
    first = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
    lengths = np.diff(np.r_[first, len(keys)]).astype(np.uint32)
    parts = (np.array([len(first), len(keys)]), keys[first], tokens, sizes[first].astype(np.uint32), lengths, counts.astype(np.uint32))
    return b"".join(p.tobytes() for p in parts)


def _unpack(blob):
    """(keys, sizes, tokens, counts), one row per token."""
    sets, total = np.frombuffer(blob, np.int64, 2).tolist()
    at = 16
    keys = np.frombuffer(blob, np.uint64, sets, at)
    tokens = np.frombuffer(blob, np.uint64, total, at + 8 * sets)
    at += 8 * (sets + total)
    sizes, lengths = np.frombuffer(blob, np.uint32, sets, at), np.frombuffer(blob, np.uint32, sets, at + 4 * sets)
    return np.repeat(keys, lengths), np.repeat(sizes, lengths), tokens, np.frombuffer(blob, np.uint32, total, at + 8 * sets)


def _shared_tokens(groups):
    """(grp, blob): of each bucket, the shingles that several sets hold, dealt by set to groups."""
    import pyarrow as pa

    def answer(blobs):
        keys, sizes, tokens = [], [], []
        for blob in blobs:
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            own = np.frombuffer(blob, np.uint64, n, 8)
            size = np.frombuffer(blob, np.uint32, n, 8 + 8 * n)
            count = np.frombuffer(blob, np.uint32, n, 8 + 12 * n)
            keys.append(np.repeat(own, count))
            sizes.append(np.repeat(size, count))
            tokens.append(np.frombuffer(blob, np.uint64, -1, 8 + 16 * n))
        keys, sizes, tokens = np.concatenate(keys), np.concatenate(sizes), np.concatenate(tokens)
        order = np.argsort(tokens)
        tokens = tokens[order]
        twice = np.zeros(len(tokens), dtype=bool)
        same = tokens[1:] == tokens[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        order, tokens = order[twice], tokens[twice]
        keys, sizes = keys[order], sizes[order]
        order = np.lexsort((keys, tokens))
        keys, sizes, tokens = keys[order], sizes[order], tokens[order]
        fresh = np.ones(len(tokens), dtype=bool)  # equal sets came from several tasks
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
        keys, sizes, tokens = keys[fresh], sizes[fresh], tokens[fresh]
        if not len(tokens):
            return
        first = np.r_[0, np.flatnonzero(tokens[1:] != tokens[:-1]) + 1]
        length = np.diff(np.r_[first, len(tokens)])
        counts = np.repeat(length, length)
        grp = (keys % np.uint64(groups)).astype(np.int64)
        order = np.flatnonzero(counts > 1)
        order = order[np.lexsort((keys[order], grp[order]))]
        keys, sizes, tokens, counts, grp = keys[order], sizes[order], tokens[order], counts[order], grp[order]
        if not len(tokens):
            return
        edges = np.r_[0, np.flatnonzero(grp[1:] != grp[:-1]) + 1, len(grp)]
        for i in range(0, len(edges) - 1, 256):
            spans = list(zip(edges[i : i + 256], edges[i + 1 : i + 257]))
            blobs = [_pack(keys[a:b], sizes[a:b], tokens[a:b], counts[a:b]) for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array([int(grp[a]) for a, _ in spans], pa.int64()), pa.array(blobs, pa.binary())], names=["grp", "blob"])

    def run(batches):
        yield from _by_first(batches, answer)

    return run


def _by_first(batches, answer):
    """Calls ``answer`` with the blobs of each group, not copied; rows are (group, blob), sorted by group."""
    current, blobs = None, []
    for batch in batches:
        for group, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            blob = value.as_buffer()
            if group != current and blobs:
                yield from answer(blobs)
                blobs = []
            current = group
            blobs.append(blob)
    if blobs:
        yield from answer(blobs)


def _reduced_sets(num, den):
    """One row per set that enough other sets share: (set_key, n, shared, tokens), rare tokens first."""
    import pyarrow as pa

    def answer(blobs):
        keys, sizes, tokens, counts = map(np.concatenate, zip(*map(_unpack, blobs)))
        order = np.lexsort((tokens, counts, keys))
        keys, sizes, tokens = keys[order], sizes[order], tokens[order]
        edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        kept = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if (b - a) * den >= int(sizes[a]) * num]
        for i in range(0, len(kept), 256):
            spans = kept[i : i + 256]
            first = np.array([a for a, _ in spans])
            shared = np.array([b - a for a, b in spans], dtype=np.int32)
            columns = [pa.array(keys[first].view(np.int64)), pa.array(sizes[first].astype(np.int32)), pa.array(shared), pa.array([tokens[a:b].tobytes() for a, b in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["set_key", "n", "shared", "tokens"])

    def run(batches):
        yield from _by_first(batches, answer)

    return run


def _prefix_entries(num, den):
    """The index: (token, set_key, n, own, pos) for the tokens in the prefix; ``own`` tokens are in no other set."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            n = np.array(batch.column("n"), dtype=np.int64)
            own = n - np.array(batch.column("shared"), dtype=np.int64)
            take = n - -(-n * num // den) + 1 - own
            tokens = [np.frombuffer(t, np.int64)[:k] for t, k in zip(batch.column("tokens").to_pylist(), take)]
            if not tokens:
                continue
            take = np.array([len(t) for t in tokens])
            at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(own, take)
            columns = [np.concatenate(tokens), np.repeat(np.array(batch.column("set_key")), take), np.repeat(n, take), np.repeat(own, take), at]
            for a in range(0, len(at), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 17)]) for c in columns], names=["token", "set_key", "n", "own", "pos"])

    return run


def _overlaps(batches):
    import pyarrow as pa

    for batch in batches:
        pairs = zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist())
        common = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "n_a", "n_b")], pa.array(common, pa.int64())], names=["a", "b", "n_a", "n_b", "common"])


def _overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, common) for pairs of set keys."""
    side = lambda s: sets.select(F.col("set_key").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"tokens_{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")
    return cut_lineage(both.mapInArrow(_overlaps, "a long, b long, n_a int, n_b int, common long"))


def _block_pairs(num, den):
    """Pairs of sets of two blocks that may link and that nothing computed so far decides: (a, b, sure).

    Both sets of a pair may have been compared with the same anchor x. Their overlap is then at least
    |y & x| + |z & x| - |x|, and at most min(|y & x|, |z & x|) plus what either has outside x and shares
    with any set. Where that decides the pair, its sets are not read.
    """
    import pyarrow as pa

    names = ("n", "own", "pos", "set_key", "comp", "anchor", "anchor_n", "common")

    def run(batches):
        for batch in batches:
            sides = [[batch.column(f"{c}_{s}") for c in names] for s in "ab"]
            found = []
            for i in range(batch.num_rows):
                x, y = ({c: np.array(col[i].values) for c, col in zip(names, side)} for side in sides)
                for k in range(len(x["n"])):
                    n, m = int(x["n"][k]), y["n"]
                    need = -(-(n + m) * num // (num + den))
                    reach = 1 + np.minimum(n - x["pos"][k] - 1, m - y["pos"] - 1)
                    maybe = (y["comp"] != x["comp"][k]) & (reach >= need) & (np.minimum(n, m) * den >= np.maximum(n, m) * num)
                    if not maybe.any():
                        continue
                    same = (y["anchor"] == x["anchor"][k]) & (x["anchor_n"][k] > 0)
                    outside = np.minimum(n - x["own"][k] - x["common"][k], m - y["own"] - y["common"])
                    most = np.minimum(x["common"][k], y["common"]) + outside
                    sure = same & (x["common"][k] + y["common"] - x["anchor_n"][k] >= need)
                    hit = np.flatnonzero(maybe & (~same | (most >= need)))
                    if len(hit):
                        a, b = np.full(len(hit), x["set_key"][k]), y["set_key"][hit]
                        found.append((np.minimum(a, b), np.maximum(a, b), sure[hit]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b", "sure"])

    return run


def _remaining_pairs(entries: DataFrame, nodes: DataFrame, checked: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs across the components found so far, from lists cut into blocks by set size."""
    ends = checked.select(F.col("a").alias("set_key"), F.col("b").alias("anchor"), F.col("n_b").alias("anchor_n"), "common").union(
        checked.select("b", "a", "n_a", "common")
    )
    # the anchor of a set is the most often compared set among those it was compared with; an anchor is its own
    degree = ends.groupBy("anchor").agg(F.count("*").alias("degree"))
    best = ends.join(degree, "anchor").union(degree.join(sets.select(F.col("set_key").alias("anchor"), F.col("n").alias("anchor_n"), F.col("shared").cast("long").alias("common")), "anchor").select("anchor", F.col("anchor").alias("set_key"), "anchor_n", "common", "degree"))
    best = best.groupBy("set_key").agg(F.max(F.struct("degree", "anchor", "anchor_n", "common")).alias("best"))
    info = sets.select("set_key").join(best, "set_key", "left").join(nodes.withColumnRenamed("node", "set_key"), "set_key", "left")
    info = info.select(
        "set_key",
        F.coalesce("component", "set_key").alias("comp"),
        F.coalesce("best.anchor", F.lit(0)).alias("anchor"),
        F.coalesce("best.anchor_n", F.lit(0)).cast("long").alias("anchor_n"),
        F.coalesce("best.common", F.lit(0)).cast("long").alias("common"),
    )
    known = cut_lineage(entries.join(info, "set_key"))
    mixed = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("token")
    rows = known.join(mixed, "token").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(_BAND)))
    counts = rows.groupBy("token", "band").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks"))
    rows = rows.join(counts, ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")))
    names = ("n", "own", "pos", "set_key", "comp", "anchor", "anchor_n", "common")
    entry = F.sort_array(F.collect_list(F.struct(*names)))
    rest = F.col("n") - F.col("pos")
    blocks = rows.groupBy("token", "band", "block").agg(entry.alias("e"), F.max(rest).alias("reach"), F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    blocks = cut_lineage(blocks)
    side = lambda s: blocks.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("band", "block", "reach", "least", "lo", "hi")], *[F.col(f"e.{c}").alias(f"{c}_{s}") for c in names])
    apart = math.ceil(math.log(den / num) / math.log(_BAND))
    near = (F.col("band_b") >= F.col("band_a")) & (F.col("band_b") <= F.col("band_a") + apart)
    once = (F.col("band_a") < F.col("band_b")) | (F.col("block_a") <= F.col("block_b"))
    # skip a block when the positions left in it cannot reach the overlap that its smallest set needs
    enough = F.least("reach_a", "reach_b") * (num + den) >= (F.col("least_a") + F.col("least_b")) * num
    several = (F.col("lo_a") != F.col("hi_a")) | (F.col("lo_b") != F.col("hi_b")) | (F.col("lo_a") != F.col("lo_b"))
    met = side("a").join(side("b"), "token").where(near & once & enough & several)
    met = met.select(*[f"{c}_{s}" for s in "ab" for c in names])
    found = met.mapInArrow(_block_pairs(num, den), "a long, b long, sure boolean")
    return cut_lineage(found.where("a != b").groupBy("a", "b").agg(F.max("sure").alias("sure")))


def ngram_jaccard_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: (key, n_shingles, component_id).

    A document's set holds its distinct runs of ``width`` words (lower-cased A-Z, split at 0x20 and
    0x09 to 0x0D); a shorter sequence counts as one run. Two documents link when
    den * |intersection| >= num * |union|; component_id is the smallest key reachable by links.

    Shingles are 64-bit hashes. Equal sets become one. Shingles are counted over all sets in buckets;
    those of one set alone can match nothing, so only a count of them stays. A set enters the index
    with its rarest tokens, as many as a linking partner could lack, plus one; most sets have enough
    tokens of their own and enter with none. In each list, the entry with the fewest tokens of its own
    is compared with all others, which merges families of copies with as many comparisons as members.
    What remains are pairs across components: lists are cut into blocks by size, pairs of blocks are
    skipped by size and position, pairs of sets are decided from their overlaps with a common anchor
    where that is possible, and all others are compared. No pair is left out.

    Null or word-less text has an empty set (n_shingles 0), links with nothing, and its component is
    its own key. Repeated rows link with each other. A null key is skipped when the smallest is taken;
    a component of null keys alone has null. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    base = cut_lineage(rows.mapInArrow(_fingerprints(width), f"id {id_type}, n int, set_key long"))
    total, sets = (v or 0 for v in base.agg(F.sum("n"), F.count("*")).first())
    buckets, groups = max(8, math.ceil(total / _BUCKET_TOKENS)), max(8, math.ceil(sets / _GROUP_SETS))
    sent = rows.select("text").mapInArrow(_send_tokens(width, buckets), "bucket int, blob binary")
    shared = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_tokens(groups), "grp long, blob binary")
    sets = shared.repartition("grp").sortWithinPartitions("grp").mapInArrow(_reduced_sets(num, den), "set_key long, n int, shared int, tokens binary")
    sets = cut_lineage(sets)
    entries = cut_lineage(sets.mapInArrow(_prefix_entries(num, den), "token long, set_key long, n long, own long, pos long"))

    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num * 1.001))
    listed = entries.withColumn("cls", size_class)
    star = listed.groupBy("token", "cls").agg(F.min(F.struct("own", "n", "set_key", "pos")).alias("s"))
    star = star.select("token", F.explode(F.array("cls", F.col("cls") + 1)).alias("cls"), F.col("s.n").alias("sn"), F.col("s.set_key").alias("sk"), F.col("s.pos").alias("sp"))
    close = F.least("n", "sn") * den >= F.greatest("n", "sn") * num
    reach = F.least(F.col("n") - F.col("pos"), F.col("sn") - F.col("sp")) * (num + den) >= (F.col("n") + F.col("sn")) * num
    pairs = listed.join(star, ["token", "cls"]).where((F.col("set_key") != F.col("sk")) & close & reach)
    pairs = pairs.select(F.least("set_key", "sk").alias("a"), F.greatest("set_key", "sk").alias("b")).distinct()
    checked = _overlap(pairs, sets)
    linked = F.col("common") * den >= (F.col("n_a") + F.col("n_b") - F.col("common")) * num
    nodes = cut_lineage(components(checked.where(linked)))

    left = _remaining_pairs(entries, nodes, checked, sets, num, den)
    more = left.where("sure").select("a", "b").union(_overlap(left.where("not sure").select("a", "b"), sets).where(linked).select("a", "b"))
    if not more.isEmpty():
        nodes = cut_lineage(components(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))

    placed = base.join(nodes, base["set_key"] == nodes["node"], "left").select("id", "n", F.coalesce("component", "set_key").alias("comp"))
    placed = cut_lineage(placed)
    smallest = placed.where("n > 0").groupBy("comp").agg(F.min("id").alias("component_id"))
    return placed.where("n > 0").join(smallest, "comp").select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id").union(
        placed.where("n = 0").select("id", F.lit(0).cast("long"), "id")
    )


def keep_one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked rows: the smallest key, nulls last; same columns.

    Rows are told apart by key and text; of rows that agree in both, one stays. Texts move once, to the keys of
    the rows that go, at every size alike.
    """
    p = free_prefix(docs)
    keyed = docs.withColumn(f"{p}key", row_struct(F.col(key), F.col(text)))
    answers = cut_lineage(ngram_jaccard_join(keyed, width, num, den, f"{p}key", text).select(F.col(f"{p}key").alias("own"), "component_id"))
    gone = cut_lineage(answers.where("own <> component_id").select(F.col("own").alias(f"{p}gone")).distinct())
    left = keyed.join(gone.hint("shuffle_hash"), F.col(f"{p}key").eqNullSafe(F.col(f"{p}gone")), "left_anti")
    if not answers.groupBy("own").count().where("count > 1").isEmpty():
        left = left.dropDuplicates([f"{p}key"])
    return only(left, docs.columns)
