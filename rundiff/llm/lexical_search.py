"""Ranked lexical search with pipelined term partitioning.

The terms of the items are shared out among owners. A bundle of items visits the owners one after the other and
carries accumulators, the scores so far of the documents that any of its items has met; each owner adds what its
terms contribute, in integers, and after the last one the best documents are chosen. Bundles travel once per block of
documents, so accumulators and posting lists are bounded however many documents hold a term.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rundiff.llm import arrays
from rundiff.session import cut_lineage

BEST = 10
STAGES = 4  # owners that a bundle visits
_BLOCK_DOCS = 4096  # documents of a block, at most
_BUNDLE_ITEMS = 128  # items of a bundle, at most
_PASS_TERMS = 1 << 18  # terms looked up in one pass over the documents, or those of one bundle if they are more

# letters and digits of ASCII and all bytes of other characters make terms
_GAPS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def _bundles():
    """(bundle, slot, id, terms): the items, those of a bundle numbered from 0, with their distinct terms."""
    from pyspark import TaskContext

    def run(batches):
        bundle, slot, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            rows = []
            for i, words in arrays.row_words(batch.column("text"), _GAPS):
                terms = np.unique(words.view(np.int64))
                if slot and (slot == _BUNDLE_ITEMS or held + len(terms) > _PASS_TERMS):
                    bundle, slot, held = bundle + 1, 0, 0
                rows.append((bundle, slot, terms))
                slot, held = slot + 1, held + len(terms)
            if rows:
                bundles, slots, terms = zip(*rows)
                columns = [pa.array(bundles, pa.int64()), pa.array(slots, pa.int32()), batch.column("id"), pa.array(terms, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["bundle", "slot", "id", "terms"])

    return run


def _postings(wanted):
    """Blocks of documents and the posting lists of the wanted terms in them.

    A row without a term tells of a block: its documents' keys in order and their lengths in terms, where only
    documents with a term count. A row with one has the slots of the documents that hold it and how often.
    """
    from pyspark import TaskContext

    names = ["block", "term", "docs", "words", "ids", "lengths", "slots", "counts"]

    def flush(block, kind, docs):
        order = pa.compute.sort_indices(pa.array([d[0] for d in docs], kind)).to_numpy()  # nulls last
        docs = [docs[i] for i in order]
        lengths = np.array([d[1] for d in docs], dtype=np.uint32)
        sizes = [len(d[2]) for d in docs]
        terms, counts = (np.concatenate([d[k] for d in docs]) for k in (2, 3))
        slots = np.repeat(np.arange(len(docs), dtype=np.uint16), sizes)
        by_term = np.argsort(terms, kind="stable")
        terms, counts, slots = terms[by_term], counts[by_term].astype(np.uint32), slots[by_term]
        found, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))
        n, none = len(found), [None] * len(found)
        columns = [
            pa.array([block] * (n + 1), pa.int64()),
            pa.array([None, *wanted[found].tolist()], pa.int64()),
            pa.array([len(docs), *(ends - starts).tolist()], pa.int64()),
            pa.array([int(lengths.sum(dtype=np.int64)), *none], pa.int64()),
            pa.array([[d[0] for d in docs], *none], pa.list_(kind)),
            pa.array([lengths.tobytes(), *none], pa.binary()),
            pa.array([None, *[slots[a:b].tobytes() for a, b in zip(starts, ends)]], pa.binary()),
            pa.array([None, *[counts[a:b].tobytes() for a, b in zip(starts, ends)]], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        block, docs, kind = TaskContext.get().partitionId() << 32, [], None
        for batch in batches:
            ids = batch.column("id")
            kind = ids.type
            for i, words in arrays.row_words(batch.column("text"), _GAPS):
                if not len(words):
                    continue
                words = words.view(np.int64)
                at = np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)
                terms, counts = np.unique(at[wanted[at] == words], return_counts=True)
                docs.append((ids[i].as_py(), len(words), terms, counts))
                if len(docs) == _BLOCK_DOCS:
                    yield flush(block, kind, docs)
                    block, docs = block + 1, []
        if docs:
            yield flush(block, kind, docs)

    return run


_CARRIED = "bundle long, block long, lengths binary, per_item binary, slots binary, scores binary"


def _visit(documents, words, best):
    """An owner's work on a bundle and a block: adds the contributions of the owner's terms.

    With ``best`` it is the last owner, which returns that many documents for each item.
    """

    def scores_so_far(bundle, docs):
        scores = np.zeros((_BUNDLE_ITEMS, docs), dtype=np.int64)
        if bundle["per_item"]:
            item = np.repeat(np.arange(_BUNDLE_ITEMS), np.frombuffer(bundle["per_item"], np.uint32))
            scores[item, np.frombuffer(bundle["slots"], np.uint16)] = np.frombuffer(bundle["scores"], np.int64)
        return scores

    def choose(bundle, scores):
        rows = []
        for item in np.flatnonzero(scores.any(axis=1)):
            slots = np.flatnonzero(scores[item])
            of_item = scores[item, slots]
            if len(slots) > best:
                least = np.partition(of_item, -best)[-best]
                slots, of_item = slots[of_item >= least], of_item[of_item >= least]
            order = np.lexsort((slots, -of_item))[:best]  # slots are in order of the documents' keys
            rows += [(bundle["bundle"], bundle["block"], int(item), int(slots[i]), int(of_item[i])) for i in order]
        columns = zip(*rows) if rows else [[]] * 5
        kinds = [("bundle", pa.int64()), ("block", pa.int64()), ("item", pa.int32()), ("slot", pa.int32()), ("score", pa.int64())]
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[name for name, _ in kinds])

    def run(left, right):
        bundle = left.to_pylist()[0]
        lengths = np.frombuffer(bundle["lengths"], np.uint32).astype(np.int64)
        norm = 100 - 90 + (90 * lengths * documents) // words
        scores = scores_so_far(bundle, len(lengths))
        for weight, items, slots, counts in zip(*(right.column(c).to_pylist() for c in ("weight", "items", "slots", "counts"))):
            slots, counts = np.frombuffer(slots, np.uint16), np.frombuffer(counts, np.uint32).astype(np.int64)
            given = weight * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm[slots]))
            for item in items:
                scores[item, slots] += given
        if best:
            return choose(bundle, scores)
        item, slots = np.nonzero(scores)
        per_item = np.bincount(item, minlength=_BUNDLE_ITEMS).astype(np.uint32)
        blobs = [per_item.tobytes(), slots.astype(np.uint16).tobytes(), scores[item, slots].tobytes()]
        columns = [pa.array([bundle["bundle"]], pa.int64()), pa.array([bundle["block"]], pa.int64())]
        columns += [pa.array([b], pa.binary()) for b in (bundle["lengths"], *blobs)]
        return pa.table(columns, names=["bundle", "block", "lengths", "per_item", "slots", "scores"])

    return run


def _owners(spark, counts, documents):
    """(term, weight, stage) of the terms of one pass: the rarest terms first, so bundles get heavy only at the end.

    Each stage has twice the postings of the one before.
    """
    counts = counts.sort_by([("docs", "ascending"), ("term", "ascending")])
    docs, items = (counts.column(c).to_numpy() for c in ("docs", "items"))
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in docs]
    share = np.cumsum(docs * items) / max(1, int((docs * items).sum()))
    stage = np.searchsorted([2.0 ** (s - STAGES + 1) for s in range(STAGES - 1)], share)
    return spark.createDataFrame(pa.table({"term": counts.column("term"), "weight": pa.array(weight, pa.int64()), "stage": pa.array(stage, pa.int32())}))


def _search(docs, items, bundles, best):
    """The best documents of every block for the items of some bundles, with their keys."""
    spark = docs.sparkSession
    items = items.where(F.col("bundle").isin(bundles))
    needs = items.select("bundle", "slot", F.explode("terms").alias("term"))
    wanted = np.sort(needs.select("term").distinct().toArrow().column("term").to_numpy())
    if not len(wanted):
        return None
    kind = docs.schema["id"].dataType.simpleString()
    made = docs.mapInArrow(_postings(wanted), f"block long, term long, docs long, words long, ids array<{kind}>, lengths binary, slots binary, counts binary")
    postings = cut_lineage(made)
    blocks = postings.where("term IS NULL")
    total = blocks.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    if not total.docs:
        return None
    found = postings.where("term IS NOT NULL").groupBy("term").agg(F.sum("docs").alias("docs"))
    wide = needs.groupBy("term").agg(F.count("*").alias("items"))
    owners = _owners(spark, found.join(wide, "term").toArrow(), total.docs)
    per_bundle = needs.groupBy("bundle", "term").agg(F.collect_list("slot").alias("items"))
    visits = cut_lineage(per_bundle.join(owners, "term"))
    carried = blocks.select(F.explode(F.array(*[F.lit(b).cast("long") for b in bundles])).alias("bundle"), "block", "lengths", *[F.lit(None).cast("binary").alias(c) for c in ("per_item", "slots", "scores")])
    for stage in range(STAGES):
        last = stage == STAGES - 1
        owned = postings.where("term IS NOT NULL").join(visits.where(F.col("stage") == stage), "term")
        owned = owned.select(F.col("bundle").alias("to_bundle"), F.col("block").alias("to_block"), "weight", "items", "slots", "counts")
        visit = _visit(total.docs, total.words, best if last else 0)
        meet = carried.groupBy("bundle", "block").cogroup(owned.groupBy("to_bundle", "to_block"))
        carried = meet.applyInArrow(visit, "bundle long, block long, item int, slot int, score long" if last else _CARRIED)
    keys = blocks.select("block", F.posexplode("ids").alias("slot", "doc"))
    return carried.join(keys, ["block", "slot"]).select("bundle", "item", "doc", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, best: int = BEST, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_key, rank, key, score): the documents that score best for each item, highest first, equal ones by key.

    Terms are runs of ASCII letters and digits and of all other characters, A to Z lower-cased, told apart by 64-bit
    hashes. With N documents that have a term, L terms in all and n in a document, of which tf are the same, a term of
    df documents weighs w = floor(1000 ln((2N + 2) / (2df + 1))) and adds w * (10^9 tf div (1000 tf + 8m)), where
    m = 10 + (90 n N) div L, once for each item that holds it.

    The documents are read once for every ``_PASS_TERMS`` terms of the items, which a task looks up in memory; posting
    lists of these terms are kept per block of at most ``_BLOCK_DOCS`` documents. Accumulators are exact and complete,
    and only the best of each block leave the last owner, so nothing grows with the documents that hold a term but
    the number of blocks.

    A null or empty text has no terms; such documents do not count and such items have no rows. Each row of
    ``items`` is ranked by itself, also one with a null or repeated key; each row of ``docs`` is a document, equal
    ones rank next to each other, a null key after all others. Documents that score 0 are left out, so no documents,
    or no items, give no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_key).alias("id"), F.col(item_text).cast("string").alias("text"))
    kinds = [df.schema["id"].dataType.simpleString() for df in (rows, asked)]
    numbered = cut_lineage(asked.mapInArrow(_bundles(), f"bundle long, slot int, id {kinds[1]}, terms array<long>"))
    sizes = numbered.groupBy("bundle").agg(F.sum(F.size("terms")).alias("terms")).orderBy("bundle").collect()
    passes, held = [], 0
    for r in sizes:
        if not passes or held + r.terms > _PASS_TERMS:
            passes.append([])
            held = 0
        passes[-1].append(r.bundle)
        held += r.terms
    found = [f for f in (_search(rows, numbered, bundles, best) for bundles in passes) if f is not None]
    if not found:
        return asked.sparkSession.createDataFrame([], f"`{item_key}` {kinds[1]}, rank int, `{key}` {kinds[0]}, score long")
    place = F.row_number().over(Window.partitionBy("bundle", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    ranked = reduce(DataFrame.union, found).withColumn("rank", place).where(F.col("rank") <= best)
    named = ranked.join(numbered.select("bundle", F.col("slot").alias("item"), "id"), ["bundle", "item"])
    return named.select(F.col("id").alias(item_key), "rank", F.col("doc").alias(key), "score")
