"""Conversation structure repair by Viterbi with survivor coalescence.

A conversation is sound when its roles are an optional system turn followed by
user and assistant in turns, ending with the assistant (by initials:
``(s?(ua)+)?``).  The cheapest edits that make it so are found row by row:
Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert of an empty
user or assistant turn 5, and a truncated row that stays 5 more.  Blank rows and
duplicates must go.  Of equally cheap edits the ASCII-least string of their
initials counts.

Four states (nothing yet, after system, after user, after assistant) each keep
one survivor: the cheapest and, among those, least path of edits.  Paths are a
tree of back pointers in which every node counts its references (children, and
survivors that end in it).  A path that loses gives its nodes back up to the
next one that is still shared.  As soon as all survivors descend from one node,
the edits up to it are certain: they are emitted (to the audit, the digest or
the repaired rows) and leave memory, so a task holds the unresolved part of one
conversation only, however long it is.  Two rules keep that part short and never
change a result: a state that costs more than another one plus the edits that
lead from that one to every end it could reach is dropped (``DETOUR``), and a
run of deletions is one node with a count.  Where two ends stay open until the
last row (say, a conversation of unknown roles only, which needs one deletion or
none by parity), nothing is certain before and the part is the conversation.

Ties compare the complete unresolved paths.  Survivors have different paths and
none is the beginning of another (each holds one initial a row and ends in one,
and the edits determine the state), so the order of two survivors also orders
whatever extends them: the order is kept from row to row instead of walking back.

Faults, each row's first: blank (no character but 0x20, 0x09-0x0D), duplicate
(role and text seen earlier in the conversation), truncated (the last such
character is none of ``.!?``).

Scale: one shuffle by conversation; duplicates are found by a window that this
partitioning already satisfies; rows stream through the task in order of turn.
A conversation is never gathered: the sorts spill, and Python sees Arrow batches.
Its rows meet in one task, as the digest of its repaired text is sequential.

Defined results: a null role, text or (in the damage) id or turn is one space; a
role counts by its first character, an empty one fits nowhere; a null
conversation id is a conversation; null turns come first; rows of the same turn
are ordered by role and text; a conversation without rows gives zeros, an empty
audit and the digest of the empty string; ``gaps`` beyond a long are cut to it;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_STAYS = 5
SOUND, BLANK, DUPLICATE, TRUNCATED, ABSENT = range(5)
SPACES = " \t\n\x0b\x0c\r"
CLOSING = (".", "!", "?")

START, SYSTEM, USER, ASSISTANT = range(4)
#: Inserts that may stand before a row or at the end: state, then states passed.
INSERTS = {START: ((), (USER,), (USER, ASSISTANT)), SYSTEM: ((), (USER,), (USER, ASSISTANT)),
           USER: ((), (ASSISTANT,)), ASSISTANT: ((), (USER,))}
BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,), SYSTEM: (START,)}
BY_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: DETOUR[y][x]: what it costs at most to reach from ``y`` every end that ``x`` can reach, beyond ``x``'s own cost.
DETOUR = {START: {SYSTEM: 10, USER: 5, ASSISTANT: 10}, SYSTEM: {START: 10, USER: 5, ASSISTANT: 10},
          USER: {START: 7, SYSTEM: 5, ASSISTANT: 5}, ASSISTANT: {START: 2, SYSTEM: 0, USER: 5}}


def moves(initial: str, fault: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """``(from, to, cost, initials, inserted states)`` of every way to treat one row."""
    out = [(s, s, COST[DELETE], DELETE, ()) for s in range(4)]
    if fault in (BLANK, DUPLICATE):
        return out
    stays = TRUNCATED_STAYS if fault == TRUNCATED else 0
    own = BY_INITIAL.get(initial)
    for state, ways in INSERTS.items():
        for way in ways:
            at = way[-1] if way else state
            for to in (SYSTEM, USER, ASSISTANT):
                edit = KEEP if to == own else REROLE
                if at in BEFORE[to] and (edit == KEEP or to != SYSTEM):
                    out.append((state, to, COST[INSERT] * len(way) + COST[edit] + stays, INSERT * len(way) + edit, way))
    return out


class Node:
    """One edit of a path; ``times`` above 1 is a run of deletions."""

    __slots__ = ("parent", "edit", "times", "turn", "role", "text", "kids", "held")

    def __init__(self, parent, edit, turn=None, role=None, text=None):
        self.parent, self.edit, self.times = parent, edit, 1
        self.turn, self.role, self.text = turn, role, text
        self.kids: list[Node] = []
        self.held = 0  # survivors that end here
        if parent is not None:
            parent.kids.append(self)

    @property
    def references(self) -> int:
        return len(self.kids) + self.held


class Repair:
    """The edits of one conversation.  ``row`` takes its rows in order, ``end`` returns the cost;
    ``emit(edit, times, turn, role, text)`` is called for every edit in order, as soon as it is certain."""

    _moves: dict[tuple[str, int], list] = {}

    def __init__(self, emit: Callable):
        self.emit = emit
        self.root = Node(None, "")
        self.root.held = 1
        #: state -> (cost, order among the survivors, node)
        self.survivors = {START: (0, 0, self.root)}

    def row(self, turn, role: str, text: str, fault: int) -> None:
        key = (role[:1], fault)
        ways = self._moves.get(key)
        if ways is None:
            if len(self._moves) > 10_000:  # initials of odd roles: made again when needed
                self._moves.clear()
            ways = self._moves[key] = moves(*key)
        best: dict[int, tuple] = {}
        now = self.survivors
        for way in ways:
            at = now.get(way[0])
            if at is not None:
                found = (at[0] + way[2], at[1], way[3])
                if way[1] not in best or found < best[way[1]][0]:
                    best[way[1]] = (found, way, at[2])
        if len(best) > 1:
            for x in [x for x in best if any(best[y][0][0] + DETOUR[y][x] < best[x][0][0] for y in best if y != x)]:
                del best[x]
        order = sorted(best, key=lambda s: best[s][0][1:])
        users = {}
        for _, _, node in best.values():
            users[id(node)] = users.get(id(node), 0) + 1
        after = {}
        for rank, state in enumerate(order):
            (cost, _, initials), way, node = best[state]
            if initials == DELETE and node.edit == DELETE and users[id(node)] == 1 and not node.kids:
                node.times += 1
            else:
                for inserted in way[4]:
                    node = Node(node, INSERT, role=ROLE[inserted], text="")
                edit = initials[-1]
                if edit == DELETE:
                    node = Node(node, DELETE)
                else:
                    node = Node(node, edit, turn, role if edit == KEEP else ROLE[state], text)
            node.held += 1
            after[state] = (cost, rank, node)
        for _, _, node in now.values():
            node.held -= 1
        for _, _, node in now.values():
            self._release(node)
        self.survivors = after
        self._settle()

    def _release(self, node: Node) -> None:
        """Give a path back up to its next shared node."""
        while node is not self.root and node.references == 0:
            node.parent.kids.remove(node)
            node = node.parent

    def _settle(self) -> None:
        """Emit what all survivors share."""
        while self.root.references == 1 and not self.root.held:
            node = self.root.kids[0]
            if node.held and node.edit == DELETE and node.references == 1:
                # the run of the only survivor may grow: what is there is certain
                self.emit(DELETE, node.times, None, None, None)
                node.edit, node.times = "", 0
                node.parent, self.root = None, node
                return
            self.emit(node.edit, node.times, node.turn, node.role, node.text)
            node.parent, node.turn, node.role, node.text = None, None, None, None
            node.edit = ""
            self.root = node

    @property
    def unresolved(self) -> int:
        """Nodes in memory, the emitted root aside."""
        n, todo = -1, [self.root]
        while todo:
            n += 1
            todo += todo.pop().kids
        return n

    def end(self) -> int:
        ends = {START: (), ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}
        cost, _, initials, state = min((c + COST[INSERT] * len(ends[s]), rank, INSERT * len(ends[s]), s)
                                       for s, (c, rank, _) in self.survivors.items())
        path, node = [], self.survivors[state][2]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.edit, node.times, node.turn, node.role, node.text)
        for inserted in ends[state]:
            self.emit(INSERT, 1, None, ROLE[inserted], "")
        return cost


class _Report:
    """Counts, audit and digest of one conversation."""

    def __init__(self, conv):
        self.conv, self.audit, self.digest, self.lines = conv, [], hashlib.sha256(), 0
        self.faults = [0] * 4
        self.illegal, self.previous = 0, None
        self.low = self.high = None
        self.turns = 0
        self.repair = Repair(self._emit)

    def _emit(self, edit, times, turn, role, text):
        self.audit.append(edit * times)
        if edit != DELETE:
            self.digest.update(f"\n{role}:{text}".encode() if self.lines else f"{role}:{text}".encode())
            self.lines += 1

    def row(self, turn, role, text, fault):
        if fault == ABSENT:
            return []
        self.faults[fault] += 1
        initial = role[:1]
        if self.previous is not None and self.previous + initial not in LEGAL:
            self.illegal += 1
        self.previous = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.repair.row(turn, role, text, fault)
        return []

    def end(self):
        cost = self.repair.end()
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return [(self.conv, min(gaps, (1 << 63) - 1), self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost,
                 "".join(self.audit), self.digest.hexdigest())]


class _Rows:
    """The repaired rows of one conversation."""

    def __init__(self, conv):
        self.conv, self.ready, self.position = conv, [], 0
        self.repair = Repair(self._emit)

    def _emit(self, edit, times, turn, role, text):
        if edit != DELETE:
            self.ready.append((self.conv, self.position, edit, turn, role, text))
            self.position += 1

    def row(self, turn, role, text, fault):
        if fault != ABSENT:
            self.repair.row(turn, role, text, fault)
        out, self.ready = self.ready, []
        return out

    def end(self):
        self.repair.end()
        return self.ready


def _stream(kind, fields):
    """Rows come sorted by conversation and turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out = None, []
        schema = None

        def batch_of(rows):
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *fields])
            for conv, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if current is None or current.conv != conv:
                    if current is not None:
                        out += current.end()
                    current = kind(conv)
                out += current.row(turn, role, text, fault)
                if len(out) >= 2_000:
                    yield batch_of(out)
                    out = []
        if current is not None:
            yield batch_of(out + current.end())
    return run


def _or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, present`` with one row in four damaged, by the checksum of ``conv_id:turn``:
    dropped (kept here with ``present`` false, so that its conversation is not lost), emptied, without closing
    marks, repeated, or given the role of the user."""
    kind = F.crc32(F.concat(_or_space(F.col(conv_col)), F.lit(":"), _or_space(F.col(turn_col))).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                _or_space(F.col(role_col)).alias("role"), _or_space(F.col(text_col)).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", "".join(CLOSING), "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("kind") != 0).alias("present"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, fault`` in order within conversations; ``rows``: as from :func:`damaged`."""
    ink = F.rtrim(F.col("text"), F.lit(SPACES))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "present").orderBy(F.col("turn").asc_nulls_first()))
    fault = (F.when(~F.col("present"), ABSENT).when(F.col("ink") == "", BLANK).when(seen > 1, DUPLICATE)
             .when(~F.substring("ink", -1, 1).isin(*CLOSING), TRUNCATED).otherwise(SOUND))
    return (rows.repartition("conv_id").withColumn("ink", ink)
            .select("conv_id", "turn", "role", "text", fault.alias("fault"))
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text"))


def _conform(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                _or_space(F.col(role_col)).alias("role"), _or_space(F.col(text_col)).alias("text"),
                                F.lit(True).alias("present"))


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    ``rows``: as from :func:`damaged`; rows that are not ``present`` only name their conversation."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = [(c, pa.int64()) for c in counts] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _with_faults(rows).mapInArrow(_stream(_Report, fields), f"conv_id {kind}, " + ", ".join(f"{c} long" for c in counts)
                                         + ", audit string, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """The repaired rows: ``conv_id, position, edit, turn, role, text`` (inserted rows have no turn)."""
    rows = _conform(conversations, conv_col, turn_col, role_col, text_col)
    fields = [("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _with_faults(rows).mapInArrow(_stream(_Rows, fields), f"conv_id {kind}, position long, edit string, turn long, role string, text string")
