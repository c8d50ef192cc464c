"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search in it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rundiff.llm.vector_dedup import usable
from rundiff.session import cut_lineage

DEGREE = 32  # neighbours of a vector in the graph
REVERSE = 16  # vectors that have it as a neighbour and meet with them, about
LEAST_CHANGE = 0.02  # share of changed neighbours below which no further round of NN-descent is made
TREES, LEAF = 8, 128  # random projection trees for the first graph, and vectors of a leaf, about
SAMPLE = 20000  # vectors that the trees are fitted on, about
BEAM = 128  # vectors that a search keeps
_SALTS = 64


def _vectors(column):
    """A binary column of equally long codes as a float32 matrix."""
    return _decoded(column.to_pylist())


def _decoded(codes):
    """Codes are the scale of a vector, as float32, and the vector divided by it, as float16."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    scales, values = np.ascontiguousarray(raw[:, :4]).view(np.float32), np.ascontiguousarray(raw[:, 4:]).view(np.float16)
    return values.astype(np.float32) * scales


def _squares(x, y):
    """Squared distances between the rows of two float32 matrices."""
    found = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.maximum(found, 0, out=found)


def grow_trees(sample, leaves, trees=TREES, seed=7):
    """Trees of random hyperplanes with the sample's medians as thresholds: lists of (direction, threshold, left, right).

    A negative child -1 - k is leaf k. A node with few sample vectors is not split further.
    """
    rng = np.random.default_rng(seed)
    depth = max(0, math.ceil(math.log2(max(1, leaves))))
    out = []
    for _ in range(trees):
        nodes, count = [], 0

        def grow(rows, level):
            nonlocal count
            if level == depth or len(rows) < 16:
                count += 1
                return -count
            direction = rng.normal(size=sample.shape[1]).astype(np.float32)
            values = sample[rows] @ direction
            middle = float(np.median(values))
            low = values <= middle
            if low.all() or not low.any():
                count += 1
                return -count
            place = len(nodes)
            nodes.append(None)
            left, right = grow(rows[low], level + 1), grow(rows[~low], level + 1)
            nodes[place] = (direction, middle, left, right)
            return place

        root = grow(np.arange(len(sample)), 0)
        out.append((root, nodes))
    return out


def _leaf_of(tree, x):
    root, nodes = tree
    at = np.full(len(x), root)
    while (at >= 0).any():
        for node in np.unique(at[at >= 0]):
            rows = np.flatnonzero(at == node)
            direction, middle, left, right = nodes[node]
            at[rows] = np.where(x[rows] @ direction <= middle, left, right)
    return -1 - at


def _encode(scale):
    """(node, code): vectors divided by their largest component, as float16, after that component as a multiple of ``scale``.

    Multiples are kept between 1e-15 and 1e15, so that squares are finite; a vector beyond keeps its direction.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
            largest = np.abs(x).max(axis=1, keepdims=True)
            with np.errstate(over="ignore"):
                multiples = np.clip(largest / scale, 1e-15, 1e15).astype(np.float32)
            codes = pa.array([m.tobytes() + row.tobytes() for m, row in zip(multiples, (x / largest).astype(np.float16))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), codes], names=["node", "code"])

    return run


def _plant(trees):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("code"))
            for k, tree in enumerate(trees):
                leaf = _leaf_of(tree, x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(leaf.astype(np.int64)), batch.column("node"), batch.column("code")], names=["tree", "leaf", "node", "code"])

    return run


def _entries(owners, others, distances):
    """Rows (node, ids, distances) of entries that are sorted by node."""
    import pyarrow as pa

    if not len(owners):
        return None
    starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    ends = np.r_[starts, len(owners)]

    def blobs(values):
        offsets = (ends * values.dtype.itemsize).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])

    return pa.array(owners[starts]), blobs(others.astype(np.int64)), blobs(distances.astype(np.float32))


def _within_leaf(degree):
    """The nearest vectors of each vector of one leaf."""
    import pyarrow as pa

    def run(table):
        nodes = np.array(table.column("node"))
        x = _vectors(table.column("code"))
        k = min(degree, len(nodes) - 1)
        owners, others, far = [], [], []
        for a in range(0, len(nodes) if k > 0 else 0, 1024):
            found = _squares(x[a : a + 1024], x)
            rows = np.arange(len(found))
            found[rows, a + rows] = np.inf
            best = np.argpartition(found, k - 1, axis=1)[:, :k]
            owners.append(np.repeat(nodes[a : a + 1024], k))
            others.append(nodes[best].ravel())
            far.append(np.take_along_axis(found, best, 1).ravel())
        if not owners:
            return pa.table({"node": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "far": pa.array([], pa.binary())})
        return pa.table(dict(zip(("node", "ids", "far"), _entries(*map(np.concatenate, (owners, others, far))))))

    return run


def _grouped(batches, names):
    """Batches as dictionaries of arrays or lists, cut so that the rows of one group (the first name) stay together."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = np.array(table.column(names[0]))
        cut = int(np.searchsorted(keys == keys[-1], True))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def fingerprints(ids):
    """16-bit hashes of node numbers."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)


def _keep_nearest(degree):
    """The nearest of all entries of a node: (node, code, ids, far, reach, known, changed).

    ``reach`` is the distance of the furthest, ``known`` the fingerprints of all; ``changed`` counts new ones.
    """
    import pyarrow as pa

    def run(batches):
        for table in _grouped(batches, ("node",)):
            nodes = np.array(table.column("node"))
            ids, far = table.column("ids").to_pylist(), table.column("far").to_pylist()
            sizes = np.array([len(b or b"") // 8 for b in ids])
            owner = np.repeat(nodes, sizes)
            other, distance = np.frombuffer(b"".join(b or b"" for b in ids), np.int64), np.frombuffer(b"".join(b or b"" for b in far), np.float32)
            old = np.repeat(np.array([c is not None for c in table.column("code").to_pylist()]), sizes)
            order = np.lexsort((distance, ~old, other, owner))
            owner, other, distance, old = owner[order], other[order], distance[order], old[order]
            fresh = np.r_[True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])] if len(owner) else np.zeros(0, bool)
            owner, other, distance, old = owner[fresh], other[fresh], distance[fresh], old[fresh]
            order = np.lexsort((other, distance, owner))
            owner, other, distance, old = owner[order], other[order], distance[order], old[order]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
            lengths = np.diff(np.r_[starts, len(owner)])
            near = np.arange(len(owner)) - np.repeat(starts, lengths) < degree
            owner, other, distance, old = owner[near], other[near], distance[near], old[near]
            codes = {n: c for n, c in zip(nodes.tolist(), table.column("code").to_pylist()) if c is not None}
            every = np.array(sorted(codes), dtype=np.int64)
            low, high = np.searchsorted(owner, every), np.searchsorted(owner, every, side="right")
            rows = []
            for n, a, b in zip(every.tolist(), low, high):
                known = np.full(degree, n, dtype=np.int64)
                known[: b - a] = other[a:b]
                reach = float(distance[b - 1]) if b - a == degree else math.inf
                rows.append((n, codes[n], other[a:b].tobytes(), distance[a:b].tobytes(), reach, fingerprints(known).tobytes(), int(np.count_nonzero(~old[a:b]))))
            types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float32(), pa.binary(), pa.int64())
            for a in range(0, len(rows), 4096):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows[a : a + 4096]), types)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "code", "ids", "far", "reach", "known", "changed"])

    return run


_GRAPH = "node long, code binary, ids binary, far binary, reach float, known binary, changed long"


def _edges(batches):
    """(u, v) of each neighbour v of a vector u."""
    import pyarrow as pa

    for batch in batches:
        ids = batch.column("ids").to_pylist()
        v = np.frombuffer(b"".join(ids), np.int64)
        u = np.repeat(np.array(batch.column("node")), [len(b) // 8 for b in ids])
        for a in range(0, len(u), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(u[a : a + (1 << 17)]), pa.array(v[a : a + (1 << 17)])], names=["u", "v"])


def _meet(batches):
    """Neighbours of one vector meet: a pair of them that is nearer than one's furthest neighbour is an entry.

    Pairs that are neighbours already are left out by the fingerprints of the neighbours; so is, rarely, one that is not.
    """
    import pyarrow as pa

    def flush(found):
        owner, other, distance = map(np.concatenate, zip(*found))
        order = np.argsort(owner, kind="stable")
        made = _entries(owner[order], other[order], distance[order])
        if made is not None:
            yield pa.RecordBatch.from_arrays(list(made), names=["node", "ids", "far"])

    found, held = [], 0
    for table in _grouped(batches, ("u",)):
        hubs, nodes = np.array(table.column("u")), np.array(table.column("v"))
        x, reach = _vectors(table.column("code")), np.array(table.column("reach"))
        known = np.frombuffer(b"".join(table.column("known").to_pylist()), np.uint16).reshape(len(nodes), -1)
        marks = fingerprints(nodes)
        edges = np.r_[0, np.flatnonzero(hubs[1:] != hubs[:-1]) + 1, len(hubs)]
        for a, b in zip(edges[:-1], edges[1:]):
            own, first = np.unique(nodes[a:b], return_index=True)
            first += a
            far = _squares(x[first], x[first])
            near = far < reach[first][:, None]
            np.fill_diagonal(near, False)
            p, q = np.nonzero(near)
            fresh = ~(known[first][p] == marks[first][q][:, None]).any(axis=1)
            p, q = p[fresh], q[fresh]
            found.append((own[p], own[q], far[p, q]))
            held += len(p)
            if held > 1 << 20:
                yield from flush(found)
                found, held = [], 0
    if found:
        yield from flush(found)


def _undirected(graph: DataFrame, degree: int) -> DataFrame:
    """(u, v): the graph's edges, and of the edges to a vector about ``degree``, drawn by a hash."""
    edges = cut_lineage(graph.mapInArrow(_edges, "u long, v long"))
    incoming = edges.groupBy("v").count()
    draw = F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)) / float(1 << 20)
    back = edges.join(incoming, "v").where(draw < degree / F.col("count")).select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.union(back)


def neighbour_graph(codes: DataFrame, n: int, degree: int = DEGREE, least: float = LEAST_CHANGE) -> DataFrame:
    """The neighbour graph of (node, code): the leaves of random projection trees give first neighbours, then rounds of
    NN-descent let the neighbours of each vector meet, until less than the share ``least`` of the neighbours changes. Every vector is in one leaf of every tree; a leaf that is much
    larger than planned is cut by a hash, as the rounds make up for it."""
    some = codes.where(F.pmod(F.xxhash64("node"), F.lit(n)) < SAMPLE).select("code").collect()  # a share of SAMPLE / n, by hash
    sample = _decoded([bytes(r["code"]) for r in some])
    planted = codes.mapInArrow(_plant(grow_trees(sample, math.ceil(n / LEAF))), "tree int, leaf long, node long, code binary")
    planted = cut_lineage(planted)
    sizes = planted.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2.0 * LEAF)).alias("cuts"))
    cut = planted.join(sizes, ["tree", "leaf"]).withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")))
    first = cut.groupBy("tree", "leaf", "cut").applyInArrow(_within_leaf(degree), "node long, ids binary, far binary")
    none = codes.select("node", "code", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("far"))

    def nearest(entries, owners):
        every = owners.unionByName(entries.withColumn("code", F.lit(None).cast("binary")))
        return cut_lineage(every.repartition("node").sortWithinPartitions("node").mapInArrow(_keep_nearest(degree), _GRAPH))

    graph = nearest(first, none)
    changed = math.inf
    while changed >= least * degree * n:
        members = graph.select(F.col("node").alias("v"), "code", "reach", "known")
        met = _undirected(graph, REVERSE).join(members, "v").select("u", "v", "code", "reach", "known")
        entries = met.repartition("u").sortWithinPartitions("u").mapInArrow(_meet, "node long, ids binary, far binary")
        graph = nearest(entries, graph.select("node", "code", "ids", "far"))
        changed = graph.agg(F.sum("changed")).first()[0]
    return graph


_STATE = "query long, code binary, beam binary, far binary, open binary, seen binary, todo int"


def _pick(batches):
    """(query, node): what a search visits next."""
    import pyarrow as pa

    for batch in batches:
        rows = [(q, np.frombuffer(b, np.int64)[np.frombuffer(o, np.bool_)]) for q, b, o in zip(*(batch.column(c).to_pylist() for c in ("query", "beam", "open")))]
        node = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int64)), pa.array(node)], names=["query", "node"])


def _advance(beam):
    """One step of all searches: measures the vectors found and keeps the nearest; rows of a query hold its state or one vector."""
    import pyarrow as pa

    def run(batches):
        for table in _grouped(batches, ("query",)):
            queries = np.array(table.column("query"))
            edges = np.r_[0, np.flatnonzero(queries[1:] != queries[:-1]) + 1, len(queries)]
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                part = table.slice(a, b - a)
                held = np.array([s is not None for s in part.column("seen").to_pylist()])
                row = {c: part.column(c)[int(np.argmax(held))].as_py() for c in ("code", "beam", "far", "seen")}
                seen = np.frombuffer(row["seen"], np.int64)
                found, first = np.unique(np.array(part.column("node").filter(pa.array(~held))).astype(np.int64), return_index=True)
                new = ~np.isin(found, seen)
                found, first = found[new], first[new]
                nodes, far = np.frombuffer(row["beam"], np.int64), np.frombuffer(row["far"], np.float32)
                opened = np.zeros(len(nodes), bool)
                if len(found):
                    codes = part.column("code").filter(pa.array(~held)).take(pa.array(first))
                    own = _decoded([row["code"]])
                    near = _squares(own, _vectors(codes))[0]
                    nodes, far, opened = np.r_[nodes, found], np.r_[far, near.astype(np.float32)], np.r_[opened, np.ones(len(found), bool)]
                    order = np.lexsort((nodes, far))[:beam]
                    nodes, far, opened = nodes[order], far[order], opened[order]
                    seen = np.sort(np.r_[seen, found])
                out.append((int(queries[a]), row["code"], nodes.tobytes(), far.tobytes(), opened.tobytes(), seen.tobytes(), int(opened.sum())))
            types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["query", "code", "beam", "far", "open", "seen", "todo"])

    return run


def greedy_search(graph: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, beam): of each query node, itself and the nearest nodes that a greedy search finds.

    A search starts at its own node. Each round, all searches visit the neighbours of what is new among the nearest
    that they know; a search ends when nothing is.
    """
    neighbours = cut_lineage(_undirected(graph, REVERSE))
    codes = graph.select("node", "code")
    start = queries.join(codes, F.col("query") == F.col("node")).select("query", "code", "node")
    state = cut_lineage(start.mapInArrow(_start, _STATE))
    while True:
        visited = state.where("todo > 0").mapInArrow(_pick, "query long, node long")
        found = visited.join(neighbours, F.col("node") == F.col("u")).select("query", F.col("v").alias("node"))
        found = found.repartition("node").distinct()  # dealt as the join below needs it
        found = found.join(codes, "node").select("query", "node", "code")
        blank = [F.lit(None).cast("binary").alias(c) for c in ("beam", "far", "seen")]
        every = found.select("query", "node", "code", *blank).union(state.select("query", F.lit(None).cast("long"), "code", "beam", "far", "seen"))
        state = cut_lineage(every.repartition("query").sortWithinPartitions("query").mapInArrow(_advance(beam), _STATE))
        if state.where("todo > 0").isEmpty():
            return state.select("query", "beam")


def _start(batches):
    import pyarrow as pa

    for batch in batches:
        n = batch.num_rows
        own = [np.int64(v).tobytes() for v in batch.column("node").to_pylist()]
        rows = [batch.column("query"), batch.column("code"), pa.array(own, pa.binary()), pa.array([np.float32(0).tobytes()] * n, pa.binary()), pa.array([b"\x01"] * n, pa.binary()), pa.array(own, pa.binary()), pa.array([1] * n, pa.int32())]
        yield pa.RecordBatch.from_arrays(rows, names=["query", "code", "beam", "far", "open", "seen", "todo"])


def _measure(batches):
    """(query, node, score): the distance of two vectors in double precision."""
    import pyarrow as pa

    for batch in batches:
        x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64) if batch.num_rows else np.zeros((0, 1)) for c in ("x", "y"))
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(np.sqrt(((x - y) ** 2).sum(axis=1)))], names=["query", "node", "score"])


def _search_one_size(rows: DataFrame, every: int, k: int) -> DataFrame:
    """The answers for vectors of one length: (query_id, rank, vec_id, score)."""
    grouped = rows.groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    nodes = cut_lineage(grouped)
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    n, scale, most = nodes.agg(F.count("*"), F.percentile_approx(largest.cast("double"), 0.5), F.max("copies")).first()
    copied = None
    if most > 1:  # ids of copies, by node: as many as one answer can list, and one more
        copied = rows.join(nodes.where("copies > 1").select(F.col("vector").alias("v"), "node"), F.col("vector") == F.col("v")).select("node", "id")
        inside = Window.partitionBy("node", F.pmod(F.xxhash64("id"), F.lit(_SALTS))).orderBy("id")
        copied = copied.withColumn("r", F.row_number().over(inside)).where(F.col("r") <= k + 1)
        copied = copied.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1).select("node", "id")
        copied = cut_lineage(copied)
    codes = cut_lineage(nodes.select("node", "vector").mapInArrow(_encode(float(scale)), "node long, code binary"))
    graph = neighbour_graph(codes, n)
    asked = rows.where(F.col("id") % every == 0)
    asked = cut_lineage(asked.join(nodes.select(F.col("vector").alias("v"), "node"), F.col("vector") == F.col("v")).select(F.col("id").alias("query_id"), "node"))
    beams = greedy_search(graph, asked.select(F.col("node").alias("query")).distinct())
    near = beams.mapInArrow(_beam_rows, "query long, node long")
    vectors = nodes.select("node", F.col("vector").alias("y"))
    near = near.join(vectors, "node").join(nodes.select(F.col("node").alias("query"), F.col("vector").alias("x")), "query").select("query", "node", "x", "y")
    scored = cut_lineage(near.mapInArrow(_measure, "query long, node long, score double"))
    if copied is not None:
        ids = scored.join(copied.select(F.col("node").alias("n"), "id"), F.col("node") == F.col("n"), "left").select("query", F.coalesce("id", "node").alias("vec_id"), "score")
    else:
        ids = scored.select("query", F.col("node").alias("vec_id"), "score")
    first = Window.partitionBy("query").orderBy("score", "vec_id")
    ids = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    answers = asked.join(ids, F.col("node") == F.col("query")).where("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _beam_rows(batches):
    import pyarrow as pa

    for batch in batches:
        beams = batch.column("beam").to_pylist()
        owner = np.repeat(np.array(batch.column("query")), [len(b) // 8 for b in beams])
        yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int64)), pa.array(np.frombuffer(b"".join(beams), np.int64))], names=["query", "node"])


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each row whose key is divisible by ``every``, among all other rows:
    (query_id, rank, vec_id, score), by Euclidean distance in double precision, ties to the smaller key.

    Equal vectors are one node of the graph; their keys are told apart in the answers. Null, empty and zero vectors and
    those with null or non-finite components take no part, nor does a row with a null key. Vectors are compared with
    those of their own length. Of rows that repeat a key, the smallest vector counts. With ``k`` or fewer other rows all are
    answers; an empty table gives none. Other columns are ignored.
    """
    valid = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = cut_lineage(valid.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector")))
    out = None
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):
        found = _search_one_size(rows.where(F.col("dim") == dim).select("id", "vector"), every, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    return out.select(F.col("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id"), F.col("score"))
