"""Repair of conversation structure: cheapest edits by a cost program, the least edit string by prefix doubling.

A repaired conversation reads: nothing, or an optional system turn and then user and assistant turns in turn, ending
with an assistant. A turn is kept (K), given the role that is due (R), deleted (D), or an empty one is inserted (I).
After each turn the repair is in one of four states: nothing yet, after the system turn, a user's, an assistant's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rundiff.session import cut_lineage

_PIECE = 4096  # turns of a conversation that one group solves
_BUCKET = 30_000  # turns of whole conversations solved in one group, about
_FLUSH_ROWS = 4096

# What edits cost, their initials in order, and the white space of texts.
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
LABELS = "DIKR"
SPACE = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

_FAR = 1 << 40
_DUE = np.array([2, 2, 3, 2])  # the state after a turn of the role that is due: after nothing, system, user, assistant
_KEPT = np.full((4, 4), -1)  # the state after a kept turn, by its role's initial (s, u, a, other) and the state before
_KEPT[0, 0], _KEPT[1, [0, 1, 3]], _KEPT[2, 2] = 1, 2, 3
_END = np.array([0, 2 * INSERT, INSERT, 0])  # what it costs to end from each state
_INSERTS = np.array([[0, _FAR, 3, 6], [_FAR, 0, 3, 6], [_FAR, _FAR, 0, 3], [_FAR, _FAR, 3, 0]])  # states by inserts only


def _then(a, b):
    """Least costs of going by ``a`` and then by ``b``, for each two states."""
    out = np.full(np.broadcast_shapes(a.shape, b.shape), _FAR)
    for k in range(4):
        np.minimum(out, a[..., :, k, None] + b[..., None, k, :], out=out)
    return out


class Turns:
    """Turns of one or more conversations or pieces of such, in order, with the cost program over them.

    ``first`` marks the first turn of each segment. A node is a state before a turn; a segment's exit nodes, the
    states after its last turn, come after all others.
    """

    def __init__(self, initial, must, cut, first):
        self.rows, self.starts = len(initial), np.flatnonzero(first)
        self.ends = np.append(self.starts[1:], self.rows)
        self.segment = np.cumsum(first) - 1
        self.initial, self.must, self.extra = initial, must, np.where(cut, CUT, 0)

    def _after_keeping(self):
        return np.where(self.must[:, None], -1, _KEPT[self.initial])

    def suffix_costs(self):
        """For every turn, least costs from each state before it to each state at the end of its segment.

        Costs over 2, 4, 8 ... turns are put together, so there are as many steps as the longest segment has doublings.
        """
        step = np.full((self.rows, 4, 4), _FAR)
        at = np.arange(self.rows)
        for state in range(4):
            step[:, state, state] = DELETE
            to = np.where(self.must, state, _DUE[state])
            step[at, state, to] = np.minimum(step[at, state, to], np.where(self.must, DELETE, REROLE + self.extra))
        kept = self._after_keeping()
        for state in range(4):
            able = np.flatnonzero(kept[:, state] >= 0)
            to = kept[able, state]
            step[able, state, to] = np.minimum(step[able, state, to], self.extra[able])
        costs = _then(_INSERTS, step)
        left, width = self.ends[self.segment] - at, 1
        while (left > width).any():
            more = np.flatnonzero(left > width)
            costs[more] = _then(costs[more], costs[more + width])
            width *= 2
        return costs

    def rank(self, exits):
        """Chooses an arc for every node, given what it costs to go on from the exit states of each segment.

        Arcs on a cheapest way are ranked by the initials that follow: first by one, then by twice as many in each
        round, as the rank of a node and the rank of the node so far ahead make the rank of double the length. The
        arc with the least initial and the least ranked target is taken. ``jumps[k]`` leads 2**k arcs ahead.
        """
        costs = (self.suffix_costs() + exits[self.segment][:, None, :]).min(axis=2)
        after = exits[self.segment]
        inner = np.flatnonzero(self.segment[1:] == self.segment[:-1])
        after[inner] = costs[inner + 1]
        at = np.arange(self.rows)
        next_layer = 4 * np.append(at[1:], self.rows)
        next_layer[self.ends - 1] = 4 * (self.rows + np.arange(len(self.starts)))
        kept = self._after_keeping()
        target = np.zeros((4, self.rows, 4), dtype=np.int64)  # by initial in order, turn and state
        best = np.zeros((4, self.rows, 4), dtype=bool)
        for state in range(4):
            due, keep = _DUE[state], kept[:, state]
            here, extra = costs[:, state], self.extra
            target[:, :, state] = [next_layer + state, 4 * at + due, next_layer + keep, next_layer + due]
            best[0, :, state] = DELETE + after[:, state] == here
            best[1, :, state] = INSERT + costs[:, due] == here
            best[2, :, state] = (keep >= 0) & (extra + after[at, keep] == here)
            best[3, :, state] = ~self.must & (REROLE + extra + after[:, due] == here)
        nodes, count = 4 * self.rows, 4 * (self.rows + len(self.starts))
        target, best = target.reshape(4, nodes), best.reshape(4, nodes)
        rank = np.zeros(count, dtype=np.int64)
        rank[:nodes] = 1 + np.argmax(best, axis=0)
        ahead = np.arange(count)
        ahead[:nodes] = target[rank[:nodes] - 1, np.arange(nodes)]
        while (ahead[:nodes] < nodes).any():
            rank = np.unique(rank * (rank.max() + 1) + rank[ahead], return_inverse=True)[1]
            ahead = ahead[ahead]
        most = rank.max() + 1
        offer = np.where(best, np.arange(4)[:, None] * most + rank[np.where(best, target, 0)], 4 * most)
        self.label = np.argmin(offer, axis=0)
        ahead = np.arange(count)
        ahead[:nodes] = target[self.label, np.arange(nodes)]
        self.jumps = [ahead]
        while (ahead[:nodes] < nodes).any():
            ahead = ahead[ahead]
            self.jumps.append(ahead)

    def exit_states(self):
        """For each segment and each state at its start, the state at its end."""
        return self.jumps[-1][4 * self.starts[:, None] + np.arange(4)] % 4

    def edits(self, entries):
        """The initials of every turn: its own, after those of turns inserted before it."""
        nodes = 4 * self.starts + entries
        place = np.zeros(len(nodes), dtype=np.int64)
        for k, jump in enumerate(self.jumps):
            ahead = jump[nodes]
            inside = ahead < 4 * self.rows
            nodes, place = np.append(nodes, ahead[inside]), np.append(place, place[inside] + (1 << k))
        order = np.lexsort((place, nodes // 4))
        nodes = nodes[order]
        initials = np.array(list(LABELS.encode()), dtype=np.uint8)[self.label[nodes]].tobytes().decode()
        cuts = np.searchsorted(nodes // 4, np.arange(self.rows + 1)).tolist()
        return [initials[a:b] for a, b in zip(cuts, cuts[1:])]


_ORDER = ["late", "turn", "role", "print"]


def _turns(table):
    """The turns of a sorted table, a segment for each run of equal conversations."""
    conversation = table.column("conv").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.append(True, conversation[1:] != conversation[:-1])
    fault = table.column("fault").to_numpy()
    initial = np.array(["sua".find(r[:1]) if r else 3 for r in table.column("role").to_pylist()])
    return Turns(np.where(initial < 0, 3, initial), np.isin(fault, (BLANK, DUPLICATE)), fault == TRUNCATED, first)


def _decided(table, turns, entries):
    return table.select(["conv", *_ORDER, "copies", "fault"]).append_column("edits", pa.array(turns.edits(entries), pa.string()))


def _solve(table):
    """The edits of whole conversations."""
    table = table.sort_by([(c, "ascending") for c in ("conv", *_ORDER)])
    turns = _turns(table)
    turns.rank(np.tile(_END, (len(turns.starts), 1)))
    return _decided(table, turns, 0)


def _piece(table):
    return table.sort_by("at")


def _summaries(table):
    """What a piece of conversations costs from each state at its start to each at its end."""
    table = _piece(table)
    turns = _turns(table)
    starts = pa.array(turns.starts)
    costs = turns.suffix_costs()[turns.starts].reshape(-1, 16)
    columns = [table.column(c).take(starts) for c in ("conv", "part", "piece")]
    return pa.table([*columns, pa.array(range(len(starts)), pa.int32()), pa.array(costs.tolist(), pa.list_(pa.int64()))], names=["conv", "part", "piece", "segment", "costs"])


_PLACE = [("part", "ascending"), ("piece", "ascending")]


def _exit_costs(table):
    """For each piece of one conversation, what it costs to go on from each state at its end."""
    table = table.sort_by(_PLACE)
    costs = np.array(table.column("costs").to_pylist()).reshape(-1, 4, 4)
    exits = np.empty((len(costs), 4), dtype=np.int64)
    exits[-1] = _END
    for i in range(len(costs) - 1, 0, -1):
        exits[i - 1] = (costs[i] + exits[i]).min(axis=1)
    return table.select(["conv", "part", "piece", "segment"]).append_column("exits", pa.array(exits.tolist(), pa.list_(pa.int64())))


def _ranked(table, known):
    table, known = _piece(table), known.sort_by("segment")
    turns = _turns(table)
    turns.rank(np.array(known.column("exits").to_pylist(), dtype=np.int64))
    return table, known, turns


def _exit_states(table, known):
    _, known, turns = _ranked(table, known)
    return known.append_column("states", pa.array(turns.exit_states().tolist(), pa.list_(pa.int64())))


def _entries(table):
    """For each piece of one conversation, the state at its start."""
    table = table.sort_by(_PLACE)
    state, entries = 0, []
    for states in table.column("states").to_pylist():
        entries.append(state)
        state = states[state]
    return table.drop_columns(["states"]).append_column("entry", pa.array(entries, pa.int64()))


def _solve_piece(table, known):
    table, known, turns = _ranked(table, known)
    return _decided(table, turns, known.column("entry").to_numpy())


def _rows(turns: DataFrame, conversation: str, turn: str, role: str, text: str, copies: Column | None) -> DataFrame:
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    shown = [F.coalesce(name(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))]
    times = F.lit(1) if copies is None else copies
    rows = turns.select(name(conversation).alias("conv"), name(turn).cast("long").alias("turn"), *shown, times.cast("long").alias("copies"))
    return rows.select("conv", F.col("turn").isNotNull().alias("late"), "turn", "role", F.md5("text").alias("print"), "text", "copies")


def _steps(rows: DataFrame) -> DataFrame:
    """One row for all equal turns of a conversation: how many, and the fault of the first."""
    bare = F.rtrim("text", F.lit(SPACE))
    faults = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    equal = rows.where("copies > 0").groupBy("conv", *_ORDER).agg(F.sum("copies").alias("copies"), F.min(faults).alias("fault"))
    equal = cut_lineage(equal)
    seen = equal.groupBy(F.col("conv").alias("of"), F.col("role").alias("by"), F.col("print").alias("like")).agg(F.min(F.struct("late", "turn")).alias("first"))
    same = equal.conv.eqNullSafe(seen.of) & (equal.role == seen.by) & (equal.print == seen.like)
    again = ~F.struct("late", "turn").eqNullSafe(F.col("first"))
    fault = F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault"))
    return cut_lineage(equal.join(seen, same).select("conv", *_ORDER, "copies", fault.cast("int").alias("fault")))


def _in_pieces(steps: DataFrame, kind: str, decided: str) -> DataFrame:
    """The edits of long conversations: pieces of their sorted turns are solved side by side.

    Up: each piece tells its costs between states, and the pieces of a conversation, one small row each, are gone
    through backwards. Down: each piece ranks its arcs and tells where each state at its start leads; gone through
    forwards, this gives the state in which each piece starts.
    """
    order = [F.asc_nulls_first("conv"), *_ORDER]
    placed = steps.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = placed.withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = cut_lineage(placed.withColumn("piece", F.floor(F.col("at") / _PIECE)))
    one, place = placed.groupBy("part", "piece"), f"conv {kind}, part int, piece long, segment int"
    costs = one.applyInArrow(_summaries, f"{place}, costs array<long>")
    exits = cut_lineage(costs.groupBy("conv").applyInArrow(_exit_costs, f"{place}, exits array<long>"))
    states = one.cogroup(exits.groupBy("part", "piece")).applyInArrow(_exit_states, f"{place}, exits array<long>, states array<long>")
    entries = cut_lineage(states.groupBy("conv").applyInArrow(_entries, f"{place}, exits array<long>, entry long"))
    return one.cogroup(entries.groupBy("part", "piece")).applyInArrow(_solve_piece, decided)


def _decisions(rows: DataFrame) -> DataFrame:
    """(conv, turn and what else orders it, copies, fault, edits): the edits of all equal turns' first one."""
    steps = _steps(rows)
    kind = steps.schema["conv"].dataType.simpleString()
    decided = f"conv {kind}, late boolean, turn long, role string, print string, copies long, fault int, edits string"
    sizes = steps.groupBy("conv").count()
    total = sizes.agg(F.sum("count").alias("turns"), F.max("count").alias("most")).first()
    bucket = F.pmod(F.xxhash64("conv"), F.lit(-(-(total.turns or 1) // _BUCKET)))
    if (total.most or 0) <= _PIECE:
        return steps.groupBy(bucket).applyInArrow(_solve, decided)
    long = cut_lineage(sizes.where(F.col("count") > _PIECE).select(F.col("conv").alias("of")))
    within = steps.conv.eqNullSafe(long.of)
    short = steps.join(long, within, "left_anti").groupBy(bucket).applyInArrow(_solve, decided)
    return short.union(_in_pieces(steps.join(long, within, "left_semi"), kind, decided))


class Repair:
    """The turns and edits of one conversation as they stream by, and what is counted of them."""

    def __init__(self, key):
        self.key, self.state, self.hash, self.lines = key, 0, hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit, self.last, self.low, self.high, self.turns = [], None, None, None, 0

    def _line(self, role, text):
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        return self.lines - 1, role, text

    def _due(self, text):
        self.state = int(_DUE[self.state])
        return self._line("user" if self.state == 2 else "assistant", text)

    def take(self, turn, role, text, copies, fault, edits):
        """Counts the turn and yields (place, turn, edit, role, text) for every line that its edits leave."""
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += copies - 1 + (self.last is not None and self.last + role[:1] not in ("su", "ua", "au"))
        self.last = role[:1]
        self.blank += copies if fault == BLANK else 0
        self.truncated += fault == TRUNCATED
        self.duplicate += copies if fault == DUPLICATE else copies - 1 if fault != BLANK else 0
        self.audit.append(edits + "D" * (copies - 1))
        self.cost += DELETE * (copies - 1)
        for edit in edits:
            if edit == "D":
                self.cost += DELETE
            elif edit == "I":
                self.cost += INSERT
                place, due, empty = self._due("")
                yield place, None, edit, due, empty
            else:
                self.cost += (REROLE if edit == "R" else 0) + (CUT if fault == TRUNCATED else 0)
                if edit == "R":
                    place, role, _ = self._due(text)
                else:
                    self.state = int(_KEPT["sua".find(role[0]), self.state])
                    place, role, _ = self._line(role, text)
                yield place, turn, edit, role, text

    def end(self):
        """Yields the turns to insert at the end."""
        while self.state in (1, 2):
            self.cost += INSERT
            self.audit.append("I")
            place, role, text = self._due("")
            yield place, None, "I", role, text

    def report(self):
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_LINES = ["place", "turn", "edit", "role", "text"]


def _merge(reports):
    """Puts texts and edits together, conversation by conversation, from rows sorted so that a turn's text comes first."""

    def run(batches):
        repair, text, rows, kind = None, None, [], None
        types = [pa.int64()] * 6 + [pa.string()] * 2 if reports else [pa.int64(), pa.int64(), *[pa.string()] * 3]
        names = ["conv", *(_REPORT if reports else _LINES)]

        def flush():
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, t) for c, t in zip(columns[1:], types)]], names=names)

        def close():
            lines = [(repair.key, *line) for line in repair.end()]
            rows.extend([repair.report()] if reports else lines)

        for batch in batches:
            kind = batch.schema.field("conv").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "tag", "turn", "role", "text", "copies", "fault", "edits"))):
                if repair is None or repair.key != row[0]:
                    if repair is not None:
                        close()
                    repair = Repair(row[0])
                if row[1] == 0:
                    text = row[4]
                elif row[1] == 1:
                    for line in repair.take(row[2], row[3], text, *row[5:]):
                        if not reports:
                            rows.append((repair.key, *line))
                if len(rows) >= _FLUSH_ROWS:
                    yield flush()
        if repair is not None:
            close()
        if rows:
            yield flush()

    return run


def _repaired(turns, conversation, turn, role, text, copies, reports, schema):
    rows = _rows(turns, conversation, turn, role, text, copies)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("copies", "long"), ("fault", "int"), ("edits", "string"))]
    here = F.col("copies") > 0
    # a turn that is not there leaves its conversation's key
    texts = rows.select(
        "conv", *[F.when(here, F.col(c)).alias(c) for c in _ORDER], F.when(here, 0).otherwise(2).alias("tag"), F.when(here, F.col("text")).alias("text"), *none
    )
    edits = _decisions(rows).select("conv", *_ORDER, F.lit(1).alias("tag"), F.lit(None).cast("string").alias("text"), "copies", "fault", "edits")
    both = texts.union(edits).repartition("conv").sortWithinPartitions("conv", *_ORDER, "tag")
    kind = both.schema["conv"].dataType.simpleString()
    return both.mapInArrow(_merge(reports), f"conv {kind}, {schema}").withColumnRenamed("conv", conversation)


def repair_conversations(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None
) -> DataFrame:
    """The repaired turns: (conversation, place, turn, edit, role, text), with the cheapest edits.

    The turns of a conversation are taken in the order of ``turn``, nulls first, turns with the same number by role
    and a hash of the text. A turn is blank (only white space), a duplicate (role and text seen earlier) or truncated
    (its last character but white space is none of ``.!?``); the first that fits counts. Keeping costs nothing,
    giving the role that is due and inserting an empty turn cost 3, deleting, which blank and duplicate turns need,
    costs 4, and a truncated turn that stays 3 more. Of the cheapest repairs, that with the least string of edit
    initials is taken. ``edit`` is K, R or I; deleted turns have no row, inserted ones no ``turn``.

    Equal turns count as one with a number, so they may repeat without bound. Conversations of up to ``_PIECE`` turns
    are solved in groups of bounded size. Longer ones are sorted over all tasks and solved in pieces of that many
    turns; only a summary of each piece, a row of 16 numbers, is gone through in order. The texts pass once, sorted by
    conversation, and are not held: a conversation of any length streams through one task, as its lines are in order.

    A null role or text counts as one space, a null conversation is one like others. ``copies`` says how often a row
    occurs (once, if not given); none means that the turn is lost. An empty table gives no rows. Other columns are
    ignored.
    """
    return _repaired(turns, conversation, turn, role, text, copies, False, "place long, turn long, edit string, role string, text string")


def repair_report(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None
) -> DataFrame:
    """One row per conversation on its faults and its repair, as ``repair_conversations`` makes it.

    (conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): numbers missing between
    the least and the greatest turn (0 if all are null), faults, neighbours whose initials are not su, ua or au, the
    cost of the edits and their initials, and the SHA-256 of the repaired ``role:text`` lines. A conversation whose
    turns are all lost has zeros, an empty audit and the hash of the empty string.
    """
    counted = ", ".join(f"{c} long" for c in _REPORT[:6])
    return _repaired(turns, conversation, turn, role, text, copies, True, f"{counted}, audit string, repaired_sha256 string")


def damage(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, role, text, copies) with faults planted by the CRC-32 of ``conversation:turn``; null counts as one space.

    Of 20 remainders, 0 loses the turn (no copies), 1 empties its text, 2 removes its sentence marks, 3 makes two
    copies, 4 sets the role user.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conversation, turn, role, text)]
    fate = F.crc32(F.concat_ws(":", *shown[:2])) % 20
    marred = F.when(fate == 1, "").when(fate == 2, F.translate(shown[3], ".!?", "")).otherwise(shown[3])
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    given = F.when(fate == 4, "user").otherwise(shown[2])
    return turns.select(F.col(conversation), F.col(turn), given.alias(role), marred.alias(text), copies.alias("copies"))
