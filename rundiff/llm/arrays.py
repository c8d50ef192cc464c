"""NumPy helpers that run in tasks: words, shingles and their 64-bit fingerprints.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D of the UTF-8 text, A to Z lower-cased.
All hashes are fixed functions of the bytes, the same in every task and every run.
"""

import numpy as np

_WORK = 1 << 20  # bytes hashed at a time
_PART = 1 << 22  # bytes split into words at a time


def mix(x):
    """A 64-bit finaliser: every input bit changes half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables():
    seed = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    values = mix(seed)
    upper = np.arange(256)
    upper[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return values[upper], space


_VALUES, _SPACE = _tables()
_RADIX = 0xD6E8FEB86659FD93
_POWERS = {}


def _powers(n):
    """Powers of the radix and of its inverse modulo 2**64, at least n of them."""
    if _POWERS.get("n", 0) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _RADIX), ("down", pow(_RADIX, -1, 1 << 64))):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
        _POWERS["n"] = size
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_buffer(column):
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data, offsets, gaps=_SPACE):
    """Byte positions where words start and end, and for each row the number of its first word."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    word = ~gaps[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data, starts, ends):
    """A 64-bit hash of each word; works through the bytes in bounded pieces."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _WORK, side="right")))
        part = data[base : ends[to - 1]]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[part] * up[: len(part)], out=sums[1:])
        first, last = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[last] - sums[first]) * down[first]
        at = to
    return mix(out)


def _cuts(data, start, end, space):
    """Ends of pieces of a long text, cut between words."""
    while end - start > _PART:
        gaps = np.flatnonzero(space[data[start : start + _PART]])
        if len(gaps):
            start += int(gaps[-1]) + 1
        else:
            while start < end and not space[data[start : start + _PART]].any():
                start += _PART
            start = min(end, start)
            start += int(np.argmax(space[data[start : start + _PART]])) + 1 if start < end else 0
        yield min(start, end)
    if start < end:
        yield end


def row_words(column, gaps=_SPACE):
    """Yields (row, word hashes) of a string column, in row order, with few bytes in work at a time.

    ``gaps`` says for each byte whether it is between words.
    """
    data, offsets = text_buffer(column)
    row = 0
    while row < len(offsets) - 1:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _PART, side="right")) - 1)
        start, end = int(offsets[row]), int(offsets[to])
        if to == row + 1 and end - start > _PART:
            parts, at = [], start
            for cut in _cuts(data, start, end, gaps):
                part = data[at:cut]
                first, last, _ = word_bounds(part, np.array([0, len(part)]), gaps)
                parts.append(word_hashes(part, first, last))
                at = cut
            yield row, np.concatenate(parts)
        else:
            part = data[start:end]
            first, last, rows = word_bounds(part, offsets[row : to + 1] - start, gaps)
            words = word_hashes(part, first, last)
            for i in range(to - row):
                yield row + i, words[rows[i] : rows[i + 1]]
        row = to


def shingles(words, width):
    """Hashes of all runs of ``width`` words; a shorter sequence counts as one; none for no words."""
    n = len(words)
    if n == 0:
        return words
    span = min(n, width)
    total = np.full(n - span + 1, mix(np.uint64([span + (n < width) * 1000]))[0], dtype=np.uint64)
    for i in range(span):
        total += mix(words[i : n - span + 1 + i] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return mix(total)


def shingle_set(words, width):
    """The distinct shingles, sorted."""
    return np.unique(shingles(words, width))


def set_key(tokens):
    """One number for a set of tokens, the same for any order; 0 for the empty set."""
    if not len(tokens):
        return np.uint64(0)
    total = np.uint64([np.add.reduce(mix(tokens ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(tokens))])
    return mix(total)[0]
