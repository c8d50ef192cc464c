"""Near-duplicate embeddings by int8 tile products with error bounds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rundiff.llm.graph import components
from rundiff.session import cut_lineage

LEAST_GROUP, MOST_GROUP = 2048, 32768  # vectors of one group: two groups meet in one task
_TILE = 1024
_MOST_CENTRES = 1024
_HEADERS = 1024  # groups whose cones are compared with those of as many others in one place
_SLACK = 1e-9  # more than all rounding of the double arithmetic; products of codes are exact


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column):
    import pyarrow as pa

    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def unit(x):
    """Rows scaled to length one in double precision; scaled by the largest component first, so nothing overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(u):
    """int8 codes, scales, and a bound on the distance of each row from its code."""
    scale = np.abs(u).max(axis=1) / 127.0
    codes = np.rint(u / scale[:, None])
    return codes.astype(np.int8), scale, np.sqrt(((u - codes * scale[:, None]) ** 2).sum(axis=1))


def _nearest_centre(centres):
    """Adds ``part``: the nearest centre of the vector's dimension."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            dims = np.array(batch.column("dim"))
            part = np.zeros(len(dims), dtype=np.int32)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                own = [(k, c) for k, c in enumerate(centres) if len(c) == dim]
                x = unit(_matrix(batch.column("vector").take(pa.array(rows))))
                best = (x @ np.array([c for _, c in own]).T).argmax(axis=1)
                part[rows] = np.array([k for k, _ in own], dtype=np.int32)[best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    return run


def _pack(table):
    """One row for a group: its row numbers, vectors, and a cone that holds all of them."""
    import pyarrow as pa

    x = _matrix(table.column("vector"))
    u = unit(x)
    centre = u.sum(axis=0)
    length = np.sqrt((centre * centre).sum())
    centre = centre / length if length > 1e-9 else u[0]
    angle = float(np.arccos(np.clip(u @ centre, -1, 1)).max())
    return pa.table(
        {
            "grp": table.column("grp").slice(0, 1),
            "dim": pa.array([x.shape[1]], pa.int32()),
            "rows": pa.array([np.array(table.column("row")).astype(np.int64).tobytes()], pa.binary()),
            "vectors": pa.array([(x if x.dtype == np.float32 else x.astype(np.float64)).tobytes()], pa.binary()),
            "centre": pa.array([centre.tobytes()], pa.binary()),
            "angle": pa.array([angle], pa.float64()),
        }
    )


def _vectors(blob, rows, dim):
    """The vectors of a group as they were packed, in single or double precision."""
    return np.frombuffer(blob, dtype=np.float32 if len(blob) == 4 * rows * dim else np.float64).reshape(rows, dim)


def _hook(parent, a, b):
    """Joins the trees of a[i] and b[i] for all i; roots are the smallest members."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _meet(threshold):
    """Compares two groups, or a group with itself: (row, links, root) for rows with a link."""
    import pyarrow as pa

    def run(key, table):
        table = table.sort_by("grp")
        sides = []
        for i in range(table.num_rows):
            rows = np.frombuffer(table.column("rows")[i].as_py(), dtype=np.int64)
            u = unit(_vectors(table.column("vectors")[i].as_py(), len(rows), table.column("dim")[i].as_py()))
            codes, scale, error = quantise(u)
            exact = u.shape[1] * 127 * 127 < 1 << 24  # integer sums that float32 holds; float64 holds all others
            sides.append((rows, u, codes.astype(np.float32 if exact else np.float64), scale, error))
        one = len(sides) == 1
        (rows_a, u_a, c_a, s_a, e_a), (rows_b, u_b, c_b, s_b, e_b) = sides[0], sides[-1]
        rows = rows_a if one else np.concatenate([rows_a, rows_b])
        shift = 0 if one else len(rows_a)
        links, parent = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        for i in range(0, len(rows_a), _TILE):
            to_i = min(i + _TILE, len(rows_a))
            e_i = e_a[i:to_i, None]
            for j in range(i if one else 0, len(rows_b), _TILE):
                to_j = min(j + _TILE, len(rows_b))
                e_j = e_b[None, j:to_j]
                near = (c_a[i:to_i] @ c_b[j:to_j].T) * (s_a[i:to_i, None] * s_b[None, j:to_j])  # whole numbers, then scales
                if near.max() + (e_i.max() * (1 + e_j.max()) + e_j.max() + _SLACK) < threshold:
                    continue
                bound = e_i * (1 + e_j) + e_j + _SLACK
                linked = near - bound >= threshold
                x, y = np.nonzero((near + bound >= threshold) & ~linked)
                for k in range(0, len(x), 1 << 16):  # possibly above: in full precision
                    p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                    linked[p, q] = np.einsum("ij,ij->i", u_a[i + p], u_b[j + q]) >= threshold
                if one and i == j:
                    linked &= np.triu(np.ones(linked.shape, dtype=bool), 1)
                if not linked.any():
                    continue
                links[i:to_i] += linked.sum(axis=1)
                links[shift + j : shift + to_j] += linked.sum(axis=0)
                p, q = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                _hook(parent, i + p, shift + j + linked[p].argmax(axis=1))
                _hook(parent, i + linked[:, q].argmax(axis=0), shift + j + q)
                linked &= parent[i:to_i, None] != parent[None, shift + j : shift + to_j]
                p, q = np.nonzero(linked)
                _hook(parent, i + p, shift + j + q)
        hit = np.flatnonzero(links)
        return pa.table({"row": rows[hit], "links": links[hit], "root": rows[parent[hit]]})

    return run


def _near_cones(threshold):
    """(low, high) of the groups of two blocks that may hold a link: their cones are near enough."""
    import pyarrow as pa

    limit = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def run(key, table):
        low, high = (k.as_py() for k in key)
        blocks, dims, groups, angles = (np.array(table.column(c)) for c in ("block", "dim", "grp", "angle"))
        centres = np.array(table.column("centre").to_pylist(), dtype=object)
        found = []
        for dim in np.unique(dims):
            left, right = (np.flatnonzero((blocks == b) & (dims == dim)) for b in (low, high))
            if not len(left) or not len(right):
                continue
            x, y = (np.array([np.frombuffer(c) for c in centres[side]]) for side in (left, right))
            between = np.arccos(np.clip(x @ y.T, -1, 1))
            near = between - angles[left, None] - angles[None, right] <= limit
            near |= groups[left, None] == groups[None, right]
            p, q = np.nonzero(near & (groups[left, None] <= groups[None, right]))
            found.append((groups[left[p]], groups[right[q]]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2
        return pa.table({"low": columns[0], "high": columns[1]})

    return run


def _near_groups(packed: DataFrame, groups: int, threshold: float) -> DataFrame:
    """(low, high): pairs of groups that may hold a link, each group with itself too; found block of cones by block."""
    heads = packed.select("grp", "dim", "centre", "angle", F.floor(F.col("grp") / _HEADERS).alias("block"))
    others = F.sequence(F.lit(0).cast("long"), F.lit((groups - 1) // _HEADERS).cast("long"))
    sent = heads.withColumn("other", F.explode(others))
    sent = sent.select("grp", "dim", "centre", "angle", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return cut_lineage(sent.groupBy("low", "high").applyInArrow(_near_cones(threshold), "low long, high long"))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row: (key, n_links, component_id, kept).

    Two vectors link when their cosine, in double precision, is at least ``threshold``. Vectors are
    grouped by the nearest of a few centres; two groups meet in one task unless the cones that hold
    them are further apart than the threshold allows. There, tiles of int8 codes are multiplied. Each
    vector has a bound on the distance from its code, so a product is known to within a bound: pairs
    surely above count, pairs possibly above are recomputed. A task returns counts and a spanning
    forest, at most one row per vector, never pairs.

    Null, empty, zero vectors and those with null or non-finite components link with nothing, nor do
    vectors of different length. Repeated rows are vectors of their own; a null key is left out of the
    smallest key of its component, and its row is never kept. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    base = cut_lineage(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(vector).alias("vector")))
    valid = base.where(usable(F.col("vector"))).select("row", F.size("vector").alias("dim"), "vector")
    sizes = {r["dim"]: r["count"] for r in valid.groupBy("dim").count().collect()}  # one row per vector length
    if not sizes:
        return base.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    group = max(LEAST_GROUP, min(MOST_GROUP, sum(sizes.values()) // 8))
    centres = []
    for dim, n in sizes.items():
        some = valid.where(F.col("dim") == dim).orderBy(F.xxhash64("row")).limit(max(1, min(_MOST_CENTRES, n // group)))
        centres += [unit(np.array([r["vector"]]))[0] for r in some.select("vector").collect()]
    kind = valid.schema["vector"].dataType.simpleString()
    placed = cut_lineage(valid.mapInArrow(_nearest_centre(centres), f"row long, dim int, vector {kind}, part int"))
    start, offset = [], 0
    filled = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # one row per centre
    for part in range(len(centres)):
        groups = math.ceil(filled.get(part, 0) / group)
        start.append((offset, max(1, groups)))
        offset += groups
    first = F.element_at(F.array(*[F.lit(s).cast("long") for s, _ in start]), F.col("part") + 1)
    split = F.element_at(F.array(*[F.lit(n).cast("long") for _, n in start]), F.col("part") + 1)
    grouped = placed.withColumn("grp", first + F.pmod(F.xxhash64("row"), split))
    packed = cut_lineage(
        grouped.groupBy("grp").applyInArrow(_pack, "grp long, dim int, rows binary, vectors binary, centre binary, angle double")
    )
    near = _near_groups(packed, offset, threshold)
    ends = F.explode(F.array_distinct(F.array("low", "high"))).alias("grp")
    cells = packed.select("grp", "dim", "rows", "vectors").join(near.select("low", "high", ends), "grp")
    met = cut_lineage(cells.groupBy("low", "high").applyInArrow(_meet(threshold), "row long, links long, root long"))
    counts = met.groupBy("row").agg(F.sum("links").alias("n_links"))
    nodes = components(met.select(F.col("row").alias("a"), F.col("root").alias("b")))
    linked = cut_lineage(base.select("row", "id").join(nodes, base["row"] == nodes["node"]).select("row", "id", "component"))
    smallest = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    answers = linked.join(smallest, "component").join(counts, "row").select("row", "n_links", "component_id")
    own = F.coalesce("component_id", "id")
    return base.select("row", "id").join(answers, "row", "left").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"),
    )
