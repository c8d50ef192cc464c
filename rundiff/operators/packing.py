"""Greedy packing of lines into size-bounded chunks, also for documents of any length.

A chunk takes lines while they fit, so where a chunk starts depends on every line before
it. The dependence is small, though: all that passes from one line to the next is the
fill of the open chunk, a number up to the limit. A block of lines is thus a step
function from the fill before it to the fill after it and the number of chunks it opens.
Blocks are computed independently, their functions are composed in a tree of groups, and
a last pass numbers the lines of each block from its known entry. A document of one block
needs only that last pass, which streams over many blocks per task.

The functions that run in tasks import what they need and refer to nothing in this
module, so executors do not need the package installed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rundiff.session import cut_lineage

# Chunk limits, the general one and the one used for comparisons.
DEFAULT_CHUNK = 20_000
COMPARISON_CHUNK = 18_000

BLOCK_LINES = 1 << 16
FAN_OUT = 32  # step functions composed in one task, each of at most three lists as long as a chunk

_STEP = "_index long, _ends array<long>, _fills array<long>, _opened array<long>, _total long"


def _describe_block(limit: int):
    """Lines of a block -> its step function.

    ``_ends`` are the running sizes that can still fit an open chunk. An entry fill
    breaks first at the line numbered by its place among them; ``_fills`` and
    ``_opened`` hold the outcome per such line. An entry beyond them passes through.
    """

    def describe(key, table):
        import numpy as np
        import pyarrow as pa

        cost = table.sort_by("_pos")["_cost"].to_numpy()
        ends, n = np.cumsum(cost), len(cost)
        base = ends - cost
        after = np.maximum(np.searchsorted(ends, base + limit, side="right"), np.arange(1, n + 1))
        reach = int(np.searchsorted(ends, limit + 1, side="right"))
        start = np.arange(min(reach + 1, n))
        opened = np.ones(len(start), dtype=np.int64)
        going = after[start] < n
        while going.any():
            start = np.where(going, after[np.minimum(start, n - 1)], start)
            opened += going
            going = after[start] < n
        fills = np.minimum(ends[-1] - base[start], limit)
        numbers = pa.list_(pa.int64())
        *names, block = key
        columns = [pa.array([k.as_py()], type=k.type) for k in names]
        columns += [pa.array([block.as_py()], type=pa.int64())]
        columns += [pa.array([x.tolist()], type=numbers) for x in (ends[:reach], fills, opened)]
        columns += [pa.array([int(ends[-1])], type=pa.int64())]
        labels = [f"k{i}" for i in range(len(names))] + ["_index", "_ends", "_fills", "_opened", "_total"]
        return pa.Table.from_arrays(columns, names=labels)

    return describe


def _compose_group(limit: int, fan_out: int):
    """Step functions of up to ``fan_out`` neighbours -> the step function of the group."""

    def compose(key, table):
        import numpy as np
        import pyarrow as pa

        steps = table.sort_by("_index").to_pylist()
        ends, total = [], 0
        for s in steps:
            ends += [total + e for e in s["_ends"] if total + e <= limit + 1]
            total += s["_total"]
        # entry fills that break first at line 0, 1, 2, … of the group
        fill = np.array([limit] + [limit - e for e in ends], dtype=np.int64)
        opened = np.zeros(len(fill), dtype=np.int64)
        for s in steps:
            place = np.searchsorted(np.array(s["_ends"], dtype=np.int64), limit - fill, side="right")
            outcome = np.array(s["_fills"], dtype=np.int64)
            breaks = place < len(outcome)
            place = np.minimum(place, len(outcome) - 1)
            fill = np.where(breaks, outcome[place], fill + s["_total"])
            opened += np.where(breaks, np.array(s["_opened"], dtype=np.int64)[place], 0)
        if total <= limit + 1:  # the last entry of the list passes through
            fill, opened = fill[:-1], opened[:-1]
        numbers = pa.list_(pa.int64())
        *names, group = key
        columns = [pa.array([k.as_py()], type=k.type) for k in names]
        columns += [pa.array([group.as_py()], type=pa.int64()), pa.array([ends], type=numbers)]
        columns += [pa.array([x.tolist()], type=numbers) for x in (fill, opened)]
        columns += [pa.array([total], type=pa.int64())]
        labels = [f"k{i}" for i in range(len(names))] + ["_index", "_ends", "_fills", "_opened", "_total"]
        return pa.Table.from_arrays(columns, names=labels)

    return compose


def _enter_children(limit: int):
    """Entry of a group and the step functions of its members -> the entry of each."""

    def enter(key, entry, table):
        import bisect

        import pyarrow as pa

        *names, _ = key
        first = entry.to_pylist()[0]
        fill, chunk = first["_fill"], first["_chunk"]
        index, fills, chunks = [], [], []
        for s in table.sort_by("_index").to_pylist():
            index.append(s["_index"])
            fills.append(fill)
            chunks.append(chunk)
            place = bisect.bisect_right(s["_ends"], limit - fill)
            if place < len(s["_fills"]):
                fill, chunk = s["_fills"][place], chunk + s["_opened"][place]
            else:
                fill += s["_total"]
        columns = [pa.array([k.as_py()] * len(index), type=k.type) for k in names]
        columns += [pa.array(x, type=pa.int64()) for x in (index, fills, chunks)]
        return pa.Table.from_arrays(columns, names=[f"k{i}" for i in range(len(names))] + ["_index", "_fill", "_chunk"])

    return enter


def _number_lines(limit: int):
    """Lines sorted by block and position -> the same lines with their chunk numbers.

    Batches of many blocks come in one stream. A block starts where the running size
    equals the cost of the line; ``_fill`` and ``_chunk`` are its entry. Work is done per
    chunk, not per line.
    """

    def number(batches):
        import numpy as np
        import pyarrow as pa

        helpers = ("_ends", "_cost", "_fill", "_chunk")
        chunk, bound = -1, 0  # the open chunk takes lines whose running size is within the bound
        for batch in batches:
            ends, cost, fill, first = (batch.column(c).to_numpy() for c in helpers)
            n = len(ends)
            chunks = np.empty(n, dtype=np.int64)
            starts = np.flatnonzero(ends == cost).tolist()
            opening = set(starts)
            edges = [0, *[i for i in starts if i > 0], n]
            for low, high in zip(edges, edges[1:]):
                if low in opening:
                    chunk, bound = int(first[low]), limit - int(fill[low])
                at = low
                while at < high:
                    stop = max(at, low + int(np.searchsorted(ends[low:high], bound, side="right")))
                    chunks[at:stop] = chunk
                    if stop < high:  # this line opens the next chunk, however long it is
                        chunk, bound = chunk + 1, int(ends[stop] - cost[stop]) + limit
                        chunks[stop] = chunk
                        stop += 1
                    at = stop
            names = [c for c in batch.schema.names if c not in helpers]
            columns = [batch.column(c) for c in names] + [pa.array(chunks)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "chunk_no"])

    return number


def chunk_lines(
    lines: DataFrame,
    keys: Sequence[str] = (),
    pos: str = "line_no",
    column: str = "line",
    max_chunk_size: int = DEFAULT_CHUNK,
    block_lines: int = BLOCK_LINES,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """Add ``chunk_no`` (from 0) to the lines of each document.

    A line costs its length plus one. A line longer than the limit is a chunk of its
    own, and a document within the limit is one chunk. ``pos`` orders the lines and is
    unique within a document. Only documents with a position from ``block_lines`` on
    need the tree; one pass over the positions looks for the largest.
    """
    keys = list(keys)
    schema = lines.schema
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields], "chunk_no bigint"])
    blocked = lines.withColumns(
        {
            "_block": F.floor(F.col(pos) / F.lit(block_lines)),
            "_cost": (F.coalesce(F.length(column), F.lit(0)) + 1).cast("long"),
        }
    )
    last_block = (lines.agg(F.max(pos)).head()[0] or 0) // block_lines

    group = [*keys, "_block"]
    rows = Window.partitionBy(*group).orderBy(pos)
    placed = blocked.select(
        "*",
        F.sum("_cost").over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_ends"),
        F.sum("_cost").over(rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_size"),
    )
    whole = F.col("_size") <= max_chunk_size + 1  # fits the limit without its last newline
    fill = F.when(whole, -1).otherwise(max_chunk_size).cast("long")
    chunk = F.when(whole, 0).otherwise(-1).cast("long")
    if last_block > 0:
        entries = _block_entries(blocked, keys, pos, max_chunk_size, fan_out, last_block)
        placed = placed.join(entries, group, "left")
        fill, chunk = F.coalesce("_in_fill", fill), F.coalesce("_in_chunk", chunk)
    ready = placed.select(*schema.names, "_block", "_ends", "_cost", fill.alias("_fill"), chunk.alias("_chunk"))
    ready = ready.sortWithinPartitions(*group, pos).drop("_block")  # the order the window left them in
    return ready.mapInArrow(_number_lines(max_chunk_size), out)


def _block_entries(
    blocked: DataFrame, keys: list[str], pos: str, limit: int, fan_out: int, last_block: int
) -> DataFrame:
    """Entry fill and chunk of every block of the documents that have several blocks."""
    schema = blocked.schema
    sizes = blocked.select(*keys, "_block", F.col(pos).cast("long").alias("_pos"), "_cost")
    if keys:
        large = blocked.groupBy(*keys).agg(F.max("_block").alias("_m")).where("_m > 0").select(*keys)
        sizes = sizes.join(large, keys, "left_semi")
    key_schema = "".join(f"`{k}` {schema[k].dataType.simpleString()}, " for k in keys)
    described = sizes.groupBy(*keys, "_block").applyInArrow(_renamed(_describe_block(limit), keys), key_schema + _STEP)
    levels = [cut_lineage(described)]
    while last_block > 0:
        last_block //= fan_out
        parents = levels[-1].withColumn("_parent", F.floor(F.col("_index") / F.lit(fan_out)))
        composed = parents.groupBy(*keys, "_parent").applyInArrow(
            _renamed(_compose_group(limit, fan_out), keys), key_schema + _STEP
        )
        levels.append(cut_lineage(composed))

    whole = F.col("_total") <= limit + 1
    entries = levels[-1].select(
        *keys,
        "_index",
        F.when(whole, -1).otherwise(limit).cast("long").alias("_fill"),
        F.when(whole, 0).otherwise(-1).cast("long").alias("_chunk"),
    )
    for level in reversed(levels[:-1]):
        members = level.withColumn("_parent", F.floor(F.col("_index") / F.lit(fan_out))).groupBy(*keys, "_parent")
        entries = (
            entries.groupBy(*keys, "_index")
            .cogroup(members)
            .applyInArrow(
                _renamed(_enter_children(limit), keys, pair=True),
                key_schema + "_index long, _fill long, _chunk long",
            )
        )
    return entries.withColumnsRenamed({"_index": "_block", "_fill": "_in_fill", "_chunk": "_in_chunk"})


def _renamed(function, keys: list[str], pair: bool = False):
    """Give the key columns of a result their own names."""

    def rename(result):
        return result.rename_columns([*keys, *result.column_names[len(keys) :]])

    def run(key, table):
        return rename(function(key, table))

    def run_pair(key, left, right):
        return rename(function(key, left, right))

    return run_pair if pair else run


def chunk_texts(chunked: DataFrame, keys: Sequence[str] = (), pos: str = "line_no", column: str = "line") -> DataFrame:
    """Text, line count and size per chunk; a chunk is bounded, so it fits one row."""
    entry = F.sort_array(F.collect_list(F.struct(F.col(pos), F.col(column))))
    joined = F.array_join(F.transform(entry, lambda e: F.coalesce(e[column], F.lit(""))), "\n")
    return (
        chunked.groupBy(*keys, "chunk_no")
        .agg(joined.alias("text"), F.count("*").alias("line_count"))
        .withColumn("char_count", F.length("text"))
    )
