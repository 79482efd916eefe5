"""Operator 11: the cheapest edits that give a conversation its proper structure.

A repaired conversation is empty, or an optional system message and then user and
assistant in turn, ending with the assistant.  Rows may be kept (0), given another role
(3) or deleted (4; blank and repeated rows must be); messages without text may be put in
anywhere (3); a truncated row that stays costs 3 more.  Of the cheapest edits those whose
initials (D, I, K, R) are least in ASCII order are taken.

Four states tell what may come next, and after each row every state has one survivor: its
cheapest edits so far, least in ASCII order.  Survivors are leaves of a tree of
back-pointers; a node counts its references, and goes with its branch when none is left.
Once the root has one branch only, all survivors share that ancestor, and its edits are
emitted: their initials are written out and their text goes into the hash.  A survivor
that cannot win any more, as another state can do all that it can for less, is dropped, so
that survivors soon share ancestors.  Ties are decided on complete unresolved suffixes:
all survivors' strings end with the edit of the same row, so none is a prefix of another,
and their order after a row follows from their order before it and the row's edits.

Memory: a task holds the unresolved edits of one conversation.  Where survivors never meet
(two phases that cost the same all the way), `MOST_PENDING` rows or `MOST_BYTES` of
text are folded into a hash and initials of each survivor's own, so that what is held is
at most four hashes and the initials, one byte an edit.

Rows are sorted by conversation and streamed, so no conversation is ever one group in
memory.  One conversation is one task, as the hash of its text is inherently a sequence.
Repeated rows are found by grouping hashes apart from the stream, with sums before the
shuffle, and marked by narrow rows in the same sort; texts are shuffled once.

Null role and text are one space, and so is null in the damage key.  Rows go by turn (nulls
first), rows of one turn by role and then by hash of the text.  A null conv_id is a
conversation.  An empty table gives no rows.  Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship_package
from .common import slices, stage

ROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # messages to put in before the end
NEXT_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT_STATE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
# A state can go on like another for at most so much more: (state, other): cost.
AS_GOOD = {
    (START, SYSTEM): 6, (START, USER): 7, (START, ASSISTANT): 4,
    (SYSTEM, START): 0, (SYSTEM, USER): 3, (SYSTEM, ASSISTANT): 0,
    (USER, START): 3, (USER, SYSTEM): 3, (USER, ASSISTANT): 3,
    (ASSISTANT, START): 0, (ASSISTANT, SYSTEM): 6, (ASSISTANT, USER): 3,
}
MOST_PENDING, MOST_BYTES = 4096, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}


# ---- damage: what the query does to the rows before they are repaired ----

def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: a fifth of the rows spoilt, by a hash of their key."""
    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    return rows.select(
        "conv_id", "turn",
        F.when(fate == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


# ---- the search for the cheapest edits ----

@lru_cache(maxsize=None)
def moves(initial: str, must_go: bool, truncated: bool) -> tuple:
    """(from, to, cost, initials, roles put in, role of the row or None if it is deleted,
    role is new) of everything that can be done up to and with a row.

    Deleting comes before putting in: it is as cheap and less in order.
    """
    found = []
    more = TRUNCATED_COST if truncated else 0
    for state in range(4):
        found.append((state, state, DELETE_COST, "D", (), False))
        if must_go:
            continue
        put, at = (), state
        for n in range(3):
            cost, keeps = INSERT_COST * n + more, initial and initial == NEXT_ROLE[at][0]
            if keeps:
                found.append((state, NEXT_STATE[at], cost, "I" * n + "K", put, None))
            else:
                found.append((state, NEXT_STATE[at], cost + ROLE_COST, "I" * n + "R", put, NEXT_ROLE[at]))
            if initial == "s" and at == START:
                found.append((state, SYSTEM, cost, "I" * n + "K", put, None))
            put, at = (*put, NEXT_ROLE[at]), NEXT_STATE[at]
    return tuple(found)


class Node:
    """Edits of one row, after those of its parent; `digest` once it holds a hash of its own."""

    __slots__ = ("parent", "children", "held", "initials", "lines", "digest")

    def __init__(self, parent, initials, lines):
        self.parent, self.initials, self.lines = parent, initials, lines
        self.children, self.held, self.digest = [], 0, None
        if parent is not None:
            parent.children.append(self)

    def references(self) -> int:
        return len(self.children) + self.held


class Lines:
    """Hash of lines joined by newlines."""

    __slots__ = ("sha", "any")

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, lines: Iterable[bytes]) -> Lines:
        for line in lines:
            if self.any:
                self.sha.update(b"\n")
            self.sha.update(line)
            self.any = True
        return self

    def copy(self) -> Lines:
        other = Lines()
        other.sha, other.any = self.sha.copy(), self.any
        return other


class Repair:
    """Rows of one conversation go in, in order; `finish` gives cost, initials and hash."""

    def __init__(self, most_pending: int = MOST_PENDING, most_bytes: int = MOST_BYTES):
        self.most_pending, self.most_bytes = most_pending, most_bytes
        self.root = Node(None, "", ())
        self.root.digest, self.root.held = Lines(), 1
        self.survivors = {START: (0, 0, self.root)}  # state: cost, place in order, leaf
        self.emitted: list[str] = []
        self.pending = self.pending_bytes = self.most_held = 0

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """Extend every survivor by what can be done with a row, and keep the best."""
        best: dict[int, tuple] = {}
        for move in moves(role[:1] if role[:1] in ("s", "u", "a") else "", must_go, truncated):
            survivor = self.survivors.get(move[0])
            if survivor is not None:
                option = (survivor[0] + move[2], survivor[1], move[3])
                if move[1] not in best or option < best[move[1]][0]:
                    best[move[1]] = (option, move, survivor[2])
        least = {state: found[0][0] for state, found in best.items()}
        alive = sorted(
            (found[0][1:], state) for state, found in best.items()
            if not any(least[state] > cost + AS_GOOD[state, other] for other, cost in least.items() if other != state)
        )
        own = None if must_go else f"{role}:{text}".encode("utf-8", "surrogatepass")
        survivors = {}
        for place, (_, state) in enumerate(alive):
            option, move, parent = best[state]
            lines = tuple(f"{r}:".encode() for r in move[4])
            if move[5] is None:
                lines += (own,)
            elif move[5]:
                lines += (f"{move[5]}:{text}".encode("utf-8", "surrogatepass"),)
            leaf = Node(parent, move[3], lines)
            leaf.held = 1
            survivors[state] = (option[0], place, leaf)
        for _, _, leaf in self.survivors.values():
            leaf.held = 0
            self._drop(leaf)
        self.survivors = survivors
        self.pending += 1
        self.pending_bytes += len(own or b"")
        self._emit()
        self.most_held = max(self.most_held, self.pending)
        if self.pending > self.most_pending or self.pending_bytes > self.most_bytes:
            self._fold()

    def _drop(self, node: Node) -> None:
        """Take away a branch without references."""
        while node.parent is not None and not node.references():
            node.parent.children.remove(node)
            node = node.parent

    def _emit(self) -> None:
        """Write out the edits that all survivors share."""
        while self.root.references() == 1 and self.root.children:
            node = self.root.children[0]
            self.emitted.append(node.initials)
            node.digest = node.digest or self.root.digest.add(node.lines)
            node.lines, node.parent, self.root = (), None, node
            self.pending -= 1
        if not self.root.children:
            self.pending = self.pending_bytes = 0

    def _fold(self) -> None:
        """Give every survivor a hash and initials of its own in place of its rows."""
        folded = {}
        for state, (cost, place, leaf) in self.survivors.items():
            path, node = [], leaf
            while node.digest is None:
                path.append(node)
                node = node.parent
            short = Node(node, "".join(n.initials for n in reversed(path)), ())
            short.digest = node.digest.copy()
            for n in reversed(path):
                short.digest.add(n.lines)
            short.held = 1
            folded[state] = (cost, place, short)
        for _, _, leaf in self.survivors.values():
            leaf.held = 0
            self._drop(leaf)
        self.survivors, self.pending, self.pending_bytes = folded, 0, 0

    def finish(self) -> tuple[int, str, str]:
        ends = []
        for state, (cost, place, leaf) in self.survivors.items():
            put, at = [], state
            for _ in range(ENDS[state]):
                put.append(NEXT_ROLE[at])
                at = NEXT_STATE[at]
            ends.append((cost + INSERT_COST * len(put), place, put, leaf))
        cost, _, put, node = min(ends, key=lambda e: e[:2])
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        digest = self.root.digest.copy()
        initials = self.emitted
        for node in reversed(path):
            initials.append(node.initials)
            digest = node.digest.copy() if node.digest else digest.add(node.lines)
        digest.add(f"{role}:".encode() for role in put)
        return cost, "".join(initials) + "I" * len(put), digest.sha.hexdigest()


class Conversation:
    """What is counted along one conversation, and its repair."""

    def __init__(self):
        self.repair = Repair()
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = self.marked = self.seen = None

    def mark(self, key: tuple) -> None:
        """Rows of this key repeat an earlier turn."""
        self.marked = key

    def row(self, key: tuple, text: str, blank: bool, open_end: bool) -> None:
        turn, role, _ = key
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL
        self.before = role[:1]
        repeated = key in (self.marked, self.seen)
        self.seen = key
        truncated = open_end and not blank and not repeated
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += truncated
        self.repair.row(role, text, blank or repeated, truncated)

    def finish(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.finish())


# ---- the Spark job ----

RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
STREAM = ("conv", "turn", "role", "hash", "text", "copies", "blank", "open_end")


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows to be streamed: faults that one row tells by itself, and a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    stripped = F.rtrim(text, F.lit(BLANKS))
    gone = F.col("copies") == 0
    return rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.unhex(F.sha2(text, 256)).alias("hash"),
        F.when(~gone, text).alias("text"),
        F.col("copies").cast("int").alias("copies"),
        (F.char_length(stripped) == 0).alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("open_end"),
    )


def _later_copies(prepared: DataFrame) -> DataFrame:
    """Narrow rows that mark the turns at which a conversation repeats a role and text.

    Groups are reduced to their first turn before they are shuffled; keys that a third of
    the rows share meet it in a join that Spark splits.
    """
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keys = stage(
        prepared.where("copies > 0").groupBy("conv", "role", "hash", "turn").agg(F.lit(1).alias("one")).drop("one"),
        "keys",
    )
    firsts = keys.groupBy("conv", "role", "hash").agg(F.min(at).alias("first"), F.count("*").alias("turns"))
    firsts = firsts.where("turns > 1").select(
        F.col("conv").alias("of_conv"), F.col("role").alias("of_role"), F.col("hash").alias("of_hash"), "first"
    )
    same = (
        F.col("conv").eqNullSafe(F.col("of_conv"))
        & (F.col("role") == F.col("of_role")) & (F.col("hash") == F.col("of_hash"))
    )
    return keys.join(firsts, same).where(at > F.col("first")).select(
        "conv", "turn", "role", "hash", F.lit(None).cast("string").alias("text"),
        F.lit(-1).alias("copies"), F.lit(False).alias("blank"), F.lit(False).alias("open_end"),
    )


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from rows sorted by conversation; state goes on over batches."""
    nothing = object()
    name, current, names, found = nothing, None, [], []

    def out(schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array(names, schema.field("conv").type)]
        columns += [pa.array(values) for values in zip(*found)]
        labels = [c.split()[0] for c in RESULT.split(", ")]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *labels])

    schema = None
    for batch in slices(batches):
        schema = batch.schema
        rows = zip(*(batch.column(c).to_pylist() for c in STREAM))
        for conv, turn, role, digest, text, copies, blank, open_end in rows:
            if conv != name or current is None:
                if current is not None:
                    names.append(name)
                    found.append(current.finish())
                name, current = conv, Conversation()
            if copies < 0:
                current.mark((turn, role, digest))
            for _ in range(copies):
                current.row((turn, role, digest), text, blank, open_end)
        if found:
            yield out(schema)
            names, found = [], []
    if current is not None:
        names.append(name)
        found.append(current.finish())
        yield out(schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id with faults, cost, edits and hash; rows(conv_id, turn, role, text, copies).

    A row is taken `copies` times, next to itself; one of no copies only names its
    conversation, which is then in the result even if nothing is left of it.
    """
    ship_package(rows.sparkSession)
    prepared = _prepared(rows)
    stream = prepared.unionByName(_later_copies(prepared)).repartition("conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "hash", "copies"
    )
    name = rows.schema["conv_id"].dataType.simpleString()
    return stream.mapInArrow(_stream, f"conv_id {name}, {RESULT}")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """The query's result: rows are damaged first."""
    return repair_conversations(damage(rows))
