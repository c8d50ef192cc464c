"""Pack documents into sequences of bounded length by a configuration linear program."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rundiff.llm import tokens
from rundiff.session import cut_lineage

CAPACITY = 4096
END_ID = 1
CLASSES = 64  # length classes of the linear program
_LEAST_SHARE = 16  # pieces shorter than capacity / this fill gaps and are not in the program
_STEP = 0.1
_SALT_ROWS = 256


def _pieces(path, capacity, end_id):
    """(id, piece, start, length, crc) of every document."""
    import pyarrow as pa

    def run(batches):
        encode = tokens.new_encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        names = ["id", "piece", "start", "length", "ids_crc32"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column("text")):
                ids = memoryview(encode(text.as_py() or "") + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    owner.append(i)
                    rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), *columns], names=names)

    return run


def knapsack(sizes, prices, capacity):
    """Copies of each size, in any number, of greatest total price within the capacity."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for k, (size, price) in enumerate(zip(sizes, prices)):
        for a in range(size, capacity + 1, size):
            b = min(a + size, capacity + 1)
            offer = value[a - size : b - size] + price
            better = offer > value[a:b]
            value[a:b][better] = offer[better]
            choice[a:b][better] = k
    copies, at = {}, capacity
    while at > 0 and choice[at] >= 0:
        copies[int(choice[at])] = copies.get(int(choice[at]), 0) + 1
        at -= sizes[choice[at]]
    return copies


def solve_program(sizes, counts, capacity, step=_STEP):
    """Configurations and how often to use each, as a fractional cover of the counts: {((class, copies), ...): times}.

    Multiplicative weights: a class weighs exp(-coverage / step), its price is its weight over its count, the
    knapsack finds the configuration of greatest price, and enough of it is taken to cover a part ``step`` of the
    class that it covers most. Each round covers some class by a step, so rounds are at most about classes / step.
    """
    counts = np.asarray(counts, dtype=float)
    covered = np.zeros(len(sizes))
    used = {}
    for _ in range(int(4 * len(sizes) / step)):
        if covered.min() >= 1:
            break
        prices = np.exp(-(covered - covered.min()) / step) / counts
        config = knapsack(sizes, prices, capacity)
        times = step * min(counts[k] / n for k, n in config.items())
        key = tuple(sorted(config.items()))
        used[key] = used.get(key, 0.0) + times
        for k, n in config.items():
            covered[k] += times * n / counts[k]
    scale = max(1.0, float(np.average(covered, weights=counts * sizes))) if len(sizes) else 1.0
    return {c: t / scale for c, t in used.items()}


def plan_packing(histogram, capacity):
    """Runs of equal sequences for a histogram {length: count}: [(sequences, [(length, copies), ...]), ...].

    The program is over classes of adjacent lengths, each as long as its longest. Its configurations are rounded
    down and their places taken by the pieces of the classes, longest first. The rest, and all short pieces, go
    best fit decreasing into what space is left. Everything works on runs of equal sequences, so the work depends
    on the number of lengths and not on the number of pieces.
    """
    left = dict(sorted(histogram.items(), reverse=True))
    runs = []
    if capacity in left:
        runs.append((left.pop(capacity), [(capacity, 1)]))
    large = [length for length in left if length * _LEAST_SHARE >= capacity]
    mass = np.cumsum([length * left[length] for length in large]) if large else np.zeros(0)
    groups = {}
    for length, upto in zip(large, mass):
        groups.setdefault(int((upto - 1) * CLASSES // mass[-1]), []).append(length)
    classes = list(groups.values())
    sizes, counts = [c[0] for c in classes], [sum(left[x] for x in c) for c in classes]
    for config, times in sorted(solve_program(sizes, counts, capacity).items(), key=lambda c: (-c[1], c[0])):
        rest = [sum(left[x] for x in classes[k]) for k, _ in config]
        whole = min(int(times), *(r // n for r, (_, n) in zip(rest, config)))
        if whole <= 0:
            continue
        open_runs = [(whole, {})]
        for k, n in config:
            for _ in range(n):
                filled = []
                for many, taken in open_runs:
                    while many:
                        length = next(x for x in classes[k] if left[x])
                        some = min(many, left[length])
                        left[length] -= some
                        filled.append((some, {**taken, length: taken.get(length, 0) + 1}))
                        many -= some
                open_runs = filled
        runs += [(many, sorted(taken.items(), reverse=True)) for many, taken in open_runs]
    return _best_fit(runs, {x: n for x, n in left.items() if n}, capacity)


def _best_fit(runs, left, capacity):
    """Adds the pieces that are left, longest first, each to the fullest sequences that still hold it."""
    runs = [(many, list(taken)) for many, taken in runs]
    room = sorted((capacity - sum(x * n for x, n in taken), i) for i, (_, taken) in enumerate(runs))

    def put(i, many, taken, length, copies):
        grown = [*taken, (length, copies)]
        if i is None:
            runs.append((many, grown))
            i = len(runs) - 1
        else:
            runs[i] = (many, grown)
        bisect.insort(room, (capacity - sum(x * n for x, n in grown), i))

    for length, count in sorted(left.items(), reverse=True):
        while count:
            at = bisect.bisect_left(room, (length, -1))
            if at < len(room):
                space, i = room.pop(at)
                many, taken = runs[i]
            else:
                space, i, many, taken = capacity, None, count, []
            copies = min(space // length, count)
            used = min(many, count // copies)
            if i is not None and used < many:  # the rest of the run stays as it is
                runs.append((many - used, list(taken)))
                bisect.insort(room, (space, len(runs) - 1))
            put(i, used, taken, length, copies)
            count -= used * copies
    return runs


def _places(runs):
    """Per length, sorted intervals of piece numbers with copies a sequence, first sequence and offset."""
    out, base = {}, 0
    for many, taken in runs:
        offset = 0
        for length, copies in taken:
            first = out.setdefault(length, [[0]])
            first.append([first[-1][0] + many * copies, copies, base, offset])
            offset += length * copies
        base += many
    return {length: np.array([[a[0], *b[1:]] for a, b in zip(rows, rows[1:])], dtype=np.int64) for length, rows in out.items()}


def _assign(places):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            length, number = np.array(batch.column("length")), np.array(batch.column("number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                rows = np.flatnonzero(length == value)
                table = places[int(value)]
                at = table[np.searchsorted(table[:, 0], number[rows], side="right") - 1]
                inside = number[rows] - at[:, 0]
                sequence[rows] = at[:, 2] + inside // at[:, 1]
                offset[rows] = at[:, 3] + inside % at[:, 1] * value
            kept = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: (key, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its token ids and ``end_id``; only one longer than ``capacity`` is cut, into pieces of that
    length. Pieces go into sequences of at most ``capacity`` tokens, without gaps. The driver sees the histogram of
    lengths, at most ``capacity`` rows, and makes a plan from it; pieces of one length are numbered in parallel
    and look up their place in the plan.

    A null text counts as empty, which is one token. A null key is an ordinary key, repeated rows are packed each,
    an empty table gives no rows, other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), f"id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = cut_lineage(made)
    salt = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(1 << 20))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if not histogram:
        return pieces.select(F.col("id").alias(key), "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = _places(plan_packing(histogram, capacity))

    spread = docs.sparkSession.createDataFrame([(n, -(-k // _SALT_ROWS)) for n, k in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(spread), "length").withColumn("salt", salt % F.col("salts")).drop("salts")
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("above"))
    own = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    numbered = salted.withColumn("row", F.row_number().over(own)).join(counts, ["length", "salt"])
    numbered = numbered.withColumn("number", F.col("above") + F.col("row") - 1).drop("salt", "row", "above")
    return numbered.mapInArrow(_assign(places), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", key)
