"""Pack documents into windows while they stream by, by the sum of squares over fill levels."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rundiff.llm import byte_tokens

CAPACITY = 2048
END_ID = 1
_OPEN_TOKENS = 8_000_000  # tokens that the open windows of a task hold before they are closed
_FLUSH_ROWS = 8192


class Levels:
    """Open windows by fill level: ``counts[h]`` windows hold h tokens, and ``windows[h]`` lists them.

    A document goes to the level that makes the sum of the squared counts least afterwards; a full window is no
    longer counted. Levels with equal sums: the fullest one.
    """

    def __init__(self, capacity):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.windows = [[] for _ in range(capacity + 1)]
        self.tokens = 0

    def choose(self, size):
        """The level for a document of ``size`` tokens, fewer than the capacity; 0 opens a window."""
        top = self.capacity - size
        below, above = self.counts[: top + 1], self.counts[size:]
        growth = 2 * (above - below) + 2  # one window fewer at the level, one more at level + size
        growth[0] -= 1
        growth[top] -= 1  # the window is full
        closed = below == 0
        closed[0] = False
        growth[closed] = np.iinfo(np.int64).max
        return top - int(np.argmin(growth[::-1]))

    def place(self, piece, size):
        """Adds a piece; returns the pieces of its window if that is full now."""
        level = self.choose(size)
        window = self.windows[level].pop() if level else []
        self.counts[level] -= level > 0
        window.append(piece)
        self.tokens += size
        if level + size == self.capacity:
            self.tokens -= self.capacity
            return window
        self.windows[level + size].append(window)
        self.counts[level + size] += 1
        return None

    def drain(self):
        """Closes all windows: yields lists of pieces, each a full window or one whose length is a power of two.

        Windows whose level is a power of two need no padding and stay as they are. The others are cut anew:
        their pieces, fullest windows first, fill whole windows, and what is left over is cut at powers of two.
        """
        rest = []
        for level in range(self.capacity - 1, 0, -1):
            for window in self.windows[level]:
                if level & (level - 1):
                    rest += window
                else:
                    yield window
        left = sum(p[2] for p in rest)
        lengths = [self.capacity] * (left // self.capacity)
        lengths += [1 << b for b in range(self.capacity.bit_length(), -1, -1) if left % self.capacity >> b & 1]
        pieces = iter(rest)
        piece = next(pieces, None)
        for length in lengths:
            window = []
            while length:
                some, piece = _cut(piece, length)
                window.append(some)
                length -= some[2]
                if piece is None:
                    piece = next(pieces, None)
            yield window
        self.__init__(self.capacity)


def _cut(piece, length):
    """A piece (key, start, length, ids, doc_tokens) as its first ``length`` tokens and the rest, or None."""
    key, start, size, ids, total = piece
    if size <= length:
        return piece, None
    return (key, start, length, ids[: 4 * length], total), (key, start + length, size - length, ids[4 * length :], total)


def _pack(path, capacity, end_id, open_tokens):
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        encode = byte_tokens.encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        levels, rows, kind = Levels(capacity), [], None
        number = TaskContext.get().partitionId() << 40

        def close(window):
            nonlocal number
            offset = 0
            for key, start, size, ids, total in window:
                rows.append((key, start, size, zlib.crc32(ids), total, number, offset))
                offset += size
            number += 1

        def flush():
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind = batch.schema.field("id").type
            for key, text in zip(batch.column("id"), batch.column("text")):
                ids, key = encode(text.as_py() or "") + end, key.as_py()
                total, view = len(ids) // 4, memoryview(ids)
                whole = total - total % capacity
                for at in range(0, whole, capacity):
                    close([(key, at, capacity, view[4 * at : 4 * (at + capacity)], total)])
                if whole < total:
                    window = levels.place((key, whole, total - whole, ids[4 * whole :], total), total - whole)
                    if window:
                        close(window)
                    if levels.tokens > open_tokens:
                        for window in levels.drain():
                            close(window)
                if len(rows) >= _FLUSH_ROWS:
                    yield flush()
        for window in levels.drain():
            close(window)
        if rows:
            yield flush()

    return run


def pack_online(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", open_tokens: int = _OPEN_TOKENS
) -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its token ids and ``end_id``. Whole windows are cut from its front; the rest of it, shorter than
    ``capacity``, is placed by the sum of squares: into an open window of the fill level that leaves the least sum
    of squared counts of partly filled windows, or a new one. Every task packs the documents of its partition as
    they come, with a level array of its own, so nothing is shuffled and work grows with the documents. At the end
    of a partition, and whenever open windows hold more than ``open_tokens`` tokens (which bounds a task's
    memory), open windows are closed: those filled to a power of two stay, the pieces of the others are cut to
    fill windows, and what is left over, less than a window, is cut at powers of two. Sequences so are full or as
    long as a power of two, and need no padding.

    A null text counts as empty, which is one token. A null key is an ordinary key, repeated rows are packed each,
    an empty table gives no rows, other columns are ignored. Sequence numbers are unique, with gaps.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(
        _pack(tokenizer_path, capacity, end_id, open_tokens),
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
    return made.withColumnRenamed("id", key)
