"""Conversation structure repair by Viterbi with survivor coalescence.

A repaired conversation has role initials ``(s?(ua)+)?``. Rows are read in order by an automaton of four states:
nothing yet, after the system row, after a user row, after an assistant row. Each row is kept, given another role or
deleted, rows may be inserted before it, and the cheapest way into each state survives. Survivors are the leaves of a
tree of backpointers with reference counts: a branch without a living leaf is dropped, and once all survivors share an
ancestor the edits up to it are emitted and forgotten. So the memory is that of the edits still open, however long
the conversation is.

Of equally cheap ways the one whose edits come first in ASCII survives. Two ways into one state never have edits of
which one begins the other (both end at the same row, with a letter that takes a row), so whole open suffixes decide;
the order of all survivors' suffixes is kept as a rank, which each row extends, instead of being read again at every tie.
A survivor that is dearer than another by more than any rest of the conversation can make good (``lead``) is dropped:
without that, "nothing yet" would survive to the end by deleting every row and no ancestor would ever be shared.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.llm.common import field
from statfold.session import broadcast_if_small, cut_lineage

START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3     # costs
OPENING = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}   # the only next user or assistant row
NAMES = {USER: "user", ASSISTANT: "assistant"}
SEGMENT_ROWS = 200_000   # longer conversations are cut into segments of about as many rows
OUT_ROWS = 4_096


def moves(initial: str, removed: bool, truncated: bool) -> list[tuple[int, int, int, bytes]]:
    """Cheapest (from, to, cost, edits) over one row, insertions before it included; ties by edits."""
    found: dict[tuple[int, int], tuple[int, bytes]] = {}
    for origin in range(4):
        state, cost, edits = origin, 0, b""
        for _ in range(3):   # a third insertion only repeats a pair
            steps = [(state, DELETE, b"D")]
            if not removed:
                extra = TRUNCATED if truncated else 0
                if initial == "s" and state == START:
                    steps.append((SYSTEM, extra, b"K"))
                if initial == "ua"[OPENING[state] - USER]:
                    steps.append((OPENING[state], extra, b"K"))
                steps.append((OPENING[state], REROLE + extra, b"R"))
            for to, more, letter in steps:
                way = (cost + more, edits + letter)
                found[origin, to] = min(found.get((origin, to), way), way)
            state, cost, edits = OPENING[state], cost + INSERT, edits + b"I"
    return [(a, b, cost, edits) for (a, b), (cost, edits) in sorted(found.items())]


# cheapest (state, cost, edits) of an accepted end
ENDS = [(START, 0, b""), (SYSTEM, 2 * INSERT, b"II"), (USER, INSERT, b"I"), (ASSISTANT, 0, b"")]


_MOVES = {(c, r, t): moves(c, r, t) for c in "sua?" for r in (False, True) for t in (False, True)}


def options(initial: str, removed: bool, truncated: bool) -> list[tuple[int, int, int, bytes]]:
    return _MOVES[initial if initial in ("s", "u", "a") else "?", removed, truncated]


def lead() -> list[list[int]]:
    """[x][y]: the most that any rest of a conversation can cost more from state x than from state y."""
    end = {s: cost for s, cost, _ in ENDS}
    table = [[end[x] - end[y] for y in range(4)] for x in range(4)]
    while True:
        wider = [[max(table[x][y], *(
            min(a - b + table[x2][y2] for x1, x2, a, _ in m if x1 == x)
            for m in _MOVES.values() for y1, y2, b, _ in m if y1 == y)) for y in range(4)] for x in range(4)]
        if wider == table:
            return table
        table = wider


_LEAD = lead()


class Node:
    """Edits since the parent; ``uses`` counts the nodes and survivors that refer to this one."""

    __slots__ = ("parent", "edits", "uses")

    def __init__(self, parent: Node | None, edits: bytes):
        self.parent, self.edits, self.uses = parent, bytearray(edits), 1


class Survivors:
    """The cheapest way into each state, as a tree of edits; ``step`` gives the edits that are settled."""

    def __init__(self, state: int = START):
        self.root = Node(None, b"")
        self.ways: dict[int, tuple[int, int, Node]] = {state: (0, 0, self.root)}   # state: cost, rank, leaf

    def step(self, options: list[tuple[int, int, int, bytes]]) -> bytes:
        """Advance all survivors over ``options`` (from, to, cost, edits)."""
        ways, best = self.ways, {}
        for origin, to, cost, edits in options:
            way = ways.get(origin)
            if way is not None:
                offer = (way[0] + cost, way[1], edits, origin)
                if to not in best or offer < best[to]:
                    best[to] = offer
        hopeless = [y for y in best if any(best[x][0] + _LEAD[x][y] < best[y][0] for x in best if x != y)]
        for state in hopeless:
            del best[state]
        return self._extend(best)

    def finish(self, ends: list[tuple[int, int, bytes]] = ENDS) -> tuple[int, bytes]:
        """The cost of the cheapest accepted way and its edits not yet given out."""
        offers = [(self.ways[s][0] + cost, self.ways[s][1], edits, s) for s, cost, edits in ends if s in self.ways]
        cost, _, edits, state = min(offers)
        return cost, self._extend({state: (cost, 0, edits, state)})

    def open_edits(self) -> int:
        """Edits held for all survivors."""
        seen = {}
        for _, _, leaf in self.ways.values():
            while leaf is not None:
                seen[id(leaf)] = len(leaf.edits)
                leaf = leaf.parent
        return sum(seen.values())

    def _extend(self, best: dict[int, tuple[int, int, bytes, int]]) -> bytes:
        order = {to: k for k, to in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        heirs: dict[int, list[int]] = {}
        for to, offer in best.items():
            heirs.setdefault(offer[3], []).append(to)
        ways = {}
        for origin, (_, _, leaf) in self.ways.items():
            own = heirs.get(origin, ())
            if len(own) == 1:   # one heir: the leaf grows
                leaf.edits += best[own[0]][2]
                ways[own[0]] = (best[own[0]][0], order[own[0]], leaf)
            else:
                leaf.uses += len(own) - 1
                for to in own:
                    ways[to] = (best[to][0], order[to], Node(leaf, best[to][2]))
        # children are counted before any branch is dropped, then dead leaves release their ancestors
        for origin, (_, _, leaf) in self.ways.items():
            if origin not in heirs:
                node = leaf
                while node is not None and node.uses == 0:
                    node = node.parent
                    if node is not None:
                        node.uses -= 1
        self.ways = ways
        return self._settled()

    def _settled(self) -> bytes:
        """Join chains, then take the edits above the nearest ancestor of all survivors."""
        for state, (cost, rank, leaf) in self.ways.items():
            node = leaf
            while node.parent is not None:
                if node.parent.uses == 1:   # an only child takes its parent's edits in front of its own
                    parent = node.parent
                    parent.edits += node.edits
                    node.edits, node.parent = parent.edits, parent.parent
                else:
                    node = node.parent
            self.root = node
        out = bytes(self.root.edits)
        self.root.edits.clear()
        return out


def segment_moves(rows: Iterator[tuple[str, bool, bool]]) -> list[tuple[int, int, int, bytes]]:
    """Cheapest (from, to, cost, edits) over all rows of a segment, for every state it may begin in."""
    lanes = [(s, Survivors(s), []) for s in range(4)]
    for row in rows:
        for _, survivors, given in lanes:
            given.append(survivors.step(options(*row)))
    out = []
    for origin, survivors, given in lanes:
        head = b"".join(given)
        for to, (cost, _, leaf) in survivors.ways.items():
            parts, node = [], leaf
            while node is not None:
                parts.append(bytes(node.edits))
                node = node.parent
            out.append((origin, to, cost, head + b"".join(reversed(parts))))
    return sorted(out)


class Applier:
    """Turns settled edits into rows (edit, kept row or None, role); ``state`` follows the roles given out."""

    def __init__(self, state: int = START):
        self.state, self.waiting = state, deque()

    def apply(self, edits: bytes) -> Iterator[tuple[str, object, str | None]]:
        for letter in edits.decode():
            if letter == "D":
                yield "D", self.waiting.popleft(), None
                continue
            row = None if letter == "I" else self.waiting.popleft()
            if letter == "K" and row[0] == "s":
                self.state = SYSTEM
                yield letter, row, None
            else:
                self.state = OPENING[self.state]
                yield letter, row, NAMES[self.state]


def faulty(rows: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Adds ``blank`` and ``truncated`` (of the last character that is not ASCII white space) by SQL functions."""
    trimmed = F.rtrim(text, F.lit(" \t\n\v\f\r"))
    return (rows.withColumn("blank", trimmed == "")
            .withColumn("truncated", ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")))


_ROW = T.StructType([T.StructField("edit", T.StringType()), T.StructField("turn", T.LongType()),
                     T.StructField("was", T.StringType()), T.StructField("fault", T.StringType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


class _Writer:
    """Collects output rows into record batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def add(self, *row) -> None:
        self.rows.append(row)

    def full(self, least: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)],
                                             schema=self.schema)
            self.rows = []


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _faults(prev: tuple | None, row: tuple) -> str:
    """The row's first fault; copies inside a turn follow each other, ``early`` tells of earlier turns."""
    _, _, turn, role, text, blank, truncated, early, k1, k2 = row
    if blank:
        return "blank"
    if early or (prev is not None and prev[2] == turn and (prev[8], prev[9]) == (k1, k2)):
        return "duplicate"
    return "truncated" if truncated else ""


def _emit(write: _Writer, key, part, seq: int, applier: Applier, edits: bytes) -> int:
    for edit, row, role in applier.apply(edits):
        if row is None:
            write.add(key, part, seq, edit, None, None, None, role, "")
        else:
            _, turn, was, text, fault = row
            write.add(key, part, seq, edit, turn, was, fault, None if edit == "D" else role if edit == "R" else was,
                      None if edit == "D" else text)
        seq += 1
    return seq


def _repairs(schema: pa.Schema):
    """Of rows sorted by conversation and order: the edited rows, given out as survivors coalesce."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = _Writer(schema)
        key = survivors = applier = prev = None
        seq, begun = 0, False
        for batch in batches:
            for row in _columns(batch):
                if not begun or row[0] != key:
                    if begun:
                        _emit(write, key, part, seq, applier, survivors.finish()[1])
                    key, part, begun, prev, seq = row[0], row[1], True, None, 0
                    survivors, applier = Survivors(), Applier()
                fault = _faults(prev, row)
                removed = fault in ("blank", "duplicate")
                applier.waiting.append((row[3][:1], row[2], row[3], None if removed else row[4], fault))
                seq = _emit(write, key, part, seq, applier, survivors.step(options(row[3][:1], removed, fault == "truncated")))
                prev = row
                yield from write.full()
        if begun:
            _emit(write, key, part, seq, applier, survivors.finish()[1])
        yield from write.full(1)
    return run


def _segments(schema: pa.Schema):
    """Of long conversations' rows sorted by (conversation, segment, order): the moves over each segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, here, held, prev = _Writer(schema), None, [], None

        def close():
            for origin, to, cost, edits in segment_moves(iter(held)):
                write.add(*here, origin, to, cost, edits)
        for batch in batches:
            for row in _columns(batch):
                if here != row[:2]:
                    if held:
                        close()
                    here, held, prev = row[:2], [], None
                fault = _faults(prev, row)
                held.append((row[3][:1], fault in ("blank", "duplicate"), fault == "truncated"))
                prev = row
            yield from write.full(64)
        if held:
            close()
        yield from write.full(1)
    return run


def _chained(schema: pa.Schema):
    """Of segment moves sorted by (conversation, segment): the state each segment begins in and its edits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = _Writer(schema)
        key, survivors, waiting, rest, state, part, own = None, None, deque(), bytearray(), START, None, []

        def settle(edits: bytes, last: bool) -> None:
            # cut the settled edits at the ends of segments; insertions at the very end go to the last one
            rest.extend(edits)
            while len(waiting) > 1:
                number, size = waiting[0]
                ends = np.flatnonzero(np.frombuffer(bytes(rest), np.uint8) != ord("I"))
                if len(ends) < size:
                    break
                to = int(ends[size - 1]) + 1
                give(number, bytes(rest[:to]))
                del rest[:to]
                waiting.popleft()
            if last:
                give(waiting.popleft()[0], bytes(rest))
                rest.clear()

        def give(number: int, edits: bytes) -> None:
            nonlocal state
            write.add(key, number, state, edits)
            # closing insertions end the conversation, so they have no state to go on from
            state = kept.pop(number).get((state, edits), ASSISTANT)

        def advance() -> None:
            first = own[0][3]
            waiting.append((part, sum(c != ord("I") for c in first)))
            kept[part] = {(a, e): b for a, b, _, e in own}
            settle(survivors.step(own), False)

        def close() -> None:
            settle(survivors.finish()[1], True)

        kept: dict = {}
        for batch in batches:
            for conv, number, origin, to, cost, edits in _columns(batch):
                if survivors is None or conv != key:
                    if survivors is not None:
                        advance()
                        close()
                    key, part, own, survivors, state = conv, number, [], Survivors(), START
                elif number != part:
                    advance()
                    part, own = number, []
                own.append((origin, to, cost, bytes(edits)))
                yield from write.full(64)
        if survivors is not None:
            advance()
            close()
        yield from write.full(1)
    return run


def _applied(schema: pa.Schema):
    """Of long conversations sorted by (conversation, segment, kind, order), edits first, then rows: the edited rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, here, prev, applier, edits, at, seq = _Writer(schema), None, None, None, b"", 0, 0
        for batch in batches:
            for *row, kind, state, own in _columns(batch):
                if not kind:
                    if here is not None:
                        _emit(write, *here, seq, applier, edits[at:])
                    here, prev, applier, edits, at, seq = tuple(row[:2]), None, Applier(state), bytes(own), 0, 0
                    continue
                fault = _faults(prev, row)
                removed = fault in ("blank", "duplicate")
                applier.waiting.append((row[3][:1], row[2], row[3], None if removed else row[4], fault))
                to = at
                while edits[to:to + 1] == b"I":
                    to += 1
                seq = _emit(write, *here, seq, applier, edits[at:to + 1])
                at, prev = to + 1, row
                yield from write.full()
        if here is not None:
            _emit(write, *here, seq, applier, edits[at:])
        yield from write.full(1)
    return run


def _facts(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, blank, truncated, early, k1, k2; ``early``: an earlier turn has the role and text."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    data = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                       blank(role_col).alias("role"), blank(text_col).alias("text"))
    data = faulty(data).withColumn("k1", F.xxhash64("role", "text")).withColumn("k2", F.xxhash64("text", "role", F.lit(1)))
    # only repeated texts need a look-up; they are counted before anything moves
    low = F.coalesce("turn", F.lit(-(1 << 63)))
    seen = (data.filter(~F.col("blank")).groupBy("conv", "k1", "k2")
            .agg(F.min(low).alias("first"), F.max(low).alias("last")).filter(F.col("first") < F.col("last")))
    seen = broadcast_if_small(cut_lineage(seen.select(F.col("conv").alias("sc"), F.col("k1").alias("s1"),
                                                      F.col("k2").alias("s2"), "first")))
    same = F.col("conv").eqNullSafe(F.col("sc")) & (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))
    return data.join(seen, same, "left").select("conv", "turn", "role", "text", "blank", "truncated",
                                                F.coalesce(low > F.col("first"), F.lit(False)).alias("early"), "k1", "k2")


def _ordered(rows: DataFrame, *keys: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, F.asc_nulls_first("turn"), "role", "k1", "k2")


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", segment_rows: int = SEGMENT_ROWS, together: bool = False) -> DataFrame:
    """One row per edit: (id, part, seq, edit, turn, was, fault, role, text), in order of (part, seq) in a conversation.

    Rows of a conversation are taken by turn, nulls first, then by role and a hash of the text. ``edit`` is K, R, D
    or I; ``role`` and ``text`` are those of the repaired conversation (null if deleted), ``was`` the role before,
    ``fault`` blank, duplicate, truncated or empty. Rows of a partition are in order as they come; with ``together``
    all rows of a long conversation follow each other in one partition, else its segments stay apart.

    Null roles and texts count as one space, a null id is a conversation of its own, an empty role fits nowhere.
    Rows equal in all columns are rows of their own, all but the first duplicates. Texts of any length are only
    carried along. Of equally cheap repairs the one with the ASCII-least edits is taken. An empty table gives an
    empty one; extra columns, whatever their names, are ignored. Conversations of more than ``segment_rows`` rows
    are cut into segments that tasks read apart, for every state they may begin in; the segments' edits are chained
    by the same Viterbi, so no task holds a whole conversation's rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from statfold.operators.position import with_position
    schema = T.StructType([field(conversations, id_col, "conv"), T.StructField("part", T.LongType()),
                           T.StructField("seq", T.LongType()), *_ROW.fields])
    facts = _facts(conversations, id_col, turn_col, role_col, text_col)
    order = ["conv", "part", "turn", "role", "text", "blank", "truncated", "early", "k1", "k2"]
    sizes = conversations.groupBy(F.col(id_col).alias("conv")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > segment_rows)
    long_ = cut_lineage(sizes.select(F.col("conv").alias("lc")))
    plain = F.lit(0).cast("long").alias("part")
    if not long_.limit(1).count():
        return (_ordered(facts.withColumn("part", plain).select(*order), "conv").mapInArrow(
            _repairs(to_arrow_schema(schema)), schema).withColumnRenamed("conv", id_col))
    is_long = broadcast_if_small(long_)
    match = F.col("conv").eqNullSafe(F.col("lc"))
    short = facts.join(is_long, match, "left_anti").withColumn("part", plain)
    done = _ordered(short.select(*order), "conv").mapInArrow(_repairs(to_arrow_schema(schema)), schema)
    placed = with_position(facts.join(is_long, match, "left_semi"),
                           [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("k1"), F.col("k2")], "pos")
    starts = broadcast_if_small(cut_lineage(placed.groupBy("conv").agg(F.min("pos").alias("p0"))
                                            .select(F.col("conv").alias("lc"), "p0")))
    # a segment ends between two positions; copies of a row that it separates are marked as early ones
    near = F.col("pos") - F.col("p0")
    parts = cut_lineage(placed.join(starts, match).withColumn("part", F.floor(near / segment_rows).cast("long"))
                        .select(*order, "pos"))
    heads = parts.groupBy("conv", "part").agg(F.max_by(F.struct("turn", "k1", "k2"), "pos").alias("end"))
    heads = broadcast_if_small(cut_lineage(heads.select(F.col("conv").alias("hc"), (F.col("part") + 1).alias("hp"), "end")))
    copied = (F.col("turn").eqNullSafe(F.col("end.turn")) & (F.col("k1") == F.col("end.k1")) & (F.col("k2") == F.col("end.k2")))
    parts = parts.join(heads, F.col("conv").eqNullSafe(F.col("hc")) & (F.col("part") == F.col("hp")), "left").withColumn(
        "early", F.col("early") | F.coalesce(copied, F.lit(False))).select(*order)
    moved = T.StructType([schema["conv"], T.StructField("part", T.LongType()), T.StructField("origin", T.IntegerType()),
                          T.StructField("to", T.IntegerType()), T.StructField("cost", T.LongType()),
                          T.StructField("edits", T.BinaryType())])
    found = cut_lineage(_ordered(parts, "conv", "part").mapInArrow(_segments(to_arrow_schema(moved)), moved))
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    chosen = T.StructType([schema["conv"], T.StructField("part", T.LongType()), T.StructField("state", T.IntegerType()),
                           T.StructField("edits", T.BinaryType())])
    edits = cut_lineage(found.repartition(n, "conv").sortWithinPartitions("conv", "part", "origin", "to")
                        .mapInArrow(_chained(to_arrow_schema(chosen)), chosen))
    # a segment's edits come as one row before its rows
    columns = T.StructType([*parts.schema.fields, T.StructField("kind", T.IntegerType()),
                            T.StructField("state", T.IntegerType()), T.StructField("edits", T.BinaryType())])
    plain_rows = parts.withColumn("kind", F.lit(1)).withColumn("state", F.lit(0)).withColumn("edits", F.lit(None).cast("binary"))
    own = edits.withColumn("kind", F.lit(0)).select(*[
        F.col(f.name) if f.name in ("conv", "part", "kind", "state", "edits") else F.lit(None).cast(f.dataType).alias(f.name)
        for f in columns])
    stream = own.unionByName(plain_rows).repartition(n, "conv", "part").sortWithinPartitions(
        "conv", "part", "kind", F.asc_nulls_first("turn"), "role", "k1", "k2")
    rest = stream.mapInArrow(_applied(to_arrow_schema(schema)), schema)
    if together:
        rest = rest.repartition(n, "conv").sortWithinPartitions("conv", "part", "seq")
    return done.unionByName(rest).withColumnRenamed("conv", id_col)


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _summaries(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, here, begun = _Writer(schema), None, False
        legal = {"su", "ua", "au"}

        def close():
            gaps = high - low + 1 - turns if turns else 0
            write.add(here, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost,
                      "".join(audit), digest.hexdigest())
        for batch in batches:
            for conv, edit, turn, was, fault, role, text in _columns(batch):
                if not begun or conv != here:
                    if begun:
                        close()
                    here, begun, audit, digest = conv, True, [], hashlib.sha256()
                    faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
                    low = high = last = before = None
                    turns = illegal = cost = written = 0
                audit.append(edit)
                if edit != "I":
                    faults[fault] += 1
                    if before is not None and before + was[:1] not in legal:
                        illegal += 1
                    before = was[:1]
                    if turn is not None:
                        low, high = (turn, turn) if low is None else (min(low, turn), max(high, turn))
                        turns, last = turns + (turn != last), turn
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                if edit != "D":
                    cost += TRUNCATED if fault == "truncated" else 0
                    digest.update((("\n" if written else "") + f"{role}:{text}").encode())
                    written += 1
            yield from write.full()
        if begun:
            close()
        yield from write.full(1)
    return run


def summaries(repaired: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``repair``'s rows in the order they come: counts, cost, audit and digest.

    The digest reads a conversation's repaired rows one by one (SHA-256 has no other order) and holds none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = T.StructType([field(repaired, id_col, "conv"), *[T.StructField(c, T.LongType()) for c in SUMMARY],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    rows = repaired.select(F.col(id_col).alias("conv"), "edit", "turn", "was", "fault", "role", "text")
    return rows.mapInArrow(_summaries(to_arrow_schema(schema)), schema).withColumnRenamed("conv", id_col)


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn``; nulls are a space.

    Remainder by 20: 0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes it a user row.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), space("role").alias("role"),
                                space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", ""))
                       .otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", "role", "text")
