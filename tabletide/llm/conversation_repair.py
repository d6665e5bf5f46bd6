"""Conversation repair: a survivor-coalescence Viterbi.

A conversation's rows are read in order. The cheapest edits that make its role initials (s?(ua)+)? are a shortest path over
four states: nothing yet, after s, after u, after a. Each state that can still win has one survivor: a leaf of a tree of
backpointers, whose nodes count their children and survivors. A node that loses its last reference goes, with those above it
that only led there. Once all survivors share an ancestor, what leads to it is settled: those edits are emitted and
the root moves down. So memory holds only the rows on which survivors still differ, and a conversation of any length is one
stream through its task. (Survivors may differ for long: a run of rows of a foreign role can be shifted by one
place at either end; then the tree holds four rows of backpointers for each.)

Of paths of one cost to a state that with the least edit letters stays. The comparison is of the whole unresolved suffixes,
however long: the survivors are kept in the order of their suffixes. Inserts are made just before the row that needs them, so
each path ends in a row's letter, no suffix begins another, and two paths that differ at an earlier survivor are in its
order whatever follows. A survivor goes for good if another, by a bridge of edits, could do all that it can for less.

Rows of a conversation come together by a shuffle and a sort, duplicates are found by a window on the same
partitioning, and rows then stream through in Arrow batches. The digest of a repaired conversation is sequential, so a
conversation is one task's work; it is never held whole.

Defined results: null role or text counts as one space (in the damage's key, null conv_id or turn too); null turns come first;
rows of one turn are ordered by role and text. A null conv_id is a conversation of its own. A role that is empty has no
initial and fits nowhere. Equal rows are duplicates but for the first. A conversation of no rows has empty edits. Roles are
compared as they are, by their first character. Other columns aren't read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: The characters that count as white space.
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after s, after u, after a. Where a role's initial leads, and what bridges cost (row: from, column: to).
START, S, U, A = range(4)
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
#: The state after an insert, and after changing a role: each state takes one of user and assistant.
PLAIN = {START: U, S: U, A: U, U: A}
ROLES = {U: "user", A: "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: No continuation of the second state is cheaper than one of the first by more than this.
BRIDGE = {(START, S): 0, (START, U): 2, (START, A): 0, (S, START): 4, (S, U): 2, (S, A): 4, (U, START): 5, (U, S): 2, (U, A): 2, (A, START): 3, (A, S): 0, (A, U): 2}
#: Letters and inserts that end a conversation in a state: only nothing and after a are whole.
ENDS = {START: "", S: "II", U: "I", A: ""}


class Row(NamedTuple):
    role: str
    text: str
    required: bool  # blank or a duplicate: must go
    truncated: bool


class Edit(NamedTuple):
    """One edit: its letter, and the role and text that it leaves (none for a deletion)."""

    letter: str
    role: str | None
    text: str


class Node:
    """A step of the backpointer tree: the letters (inserts, then the row's), the row, the state before; refs counts children
    and survivors."""

    __slots__ = ("parent", "letters", "row", "before", "refs", "children")

    def __init__(self, parent: Node | None, letters: str, row: Row | None, before: int) -> None:
        self.parent, self.letters, self.row, self.before, self.refs = parent, letters, row, before, 0
        self.children: list[Node] = []
        if parent is not None:
            parent.refs += 1
            parent.children.append(self)

    def release(self) -> None:
        """One reference less; whatever only led here goes."""
        node = self
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            parent.refs -= 1
            node.parent, node = None, parent


def edits_of(node: Node) -> Iterator[Edit]:
    state = node.before
    for letter in node.letters:
        if letter == "I":
            state = PLAIN[state]
            yield Edit("I", ROLES[state], "")
        elif letter == "R":
            yield Edit("R", ROLES[PLAIN[state]], node.row.text)
        else:
            yield Edit(letter, node.row.role if letter == "K" else None, node.row.text)


def steps(state: int, row: Row) -> Iterator[tuple[int, int, str]]:
    """(state after, cost, letters) of what can be done with a row. An insert before a deletion, or a second one, never pays."""
    yield state, DELETE, "D"
    if row.required:
        return
    late = TRUNCATED if row.truncated else 0
    for before, cost, letters in ((state, late, ""), (PLAIN[state], INSERT + late, "I")):
        if (kept := NEXT.get((before, row.role[:1]))) is not None:
            yield kept, cost, letters + "K"
        yield PLAIN[before], cost + REROLE, letters + "R"


class Repair:
    """The survivors of one conversation. `feed` takes a row and returns the edits that are settled; `end` the rest."""

    def __init__(self) -> None:
        self.root = Node(None, "", None, START)
        self.root.refs = 1
        #: state -> (cost, its place in the order of the survivors' suffixes, leaf)
        self.survivors: dict[int, tuple[int, int, Node]] = {START: (0, 0, self.root)}
        self.cost: int = 0

    def feed(self, row: Row) -> list[Edit]:
        best: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, place, _) in self.survivors.items():
            for after, more, letters in steps(state, row):
                found = (cost + more, place, letters, state)
                if after not in best or found < best[after]:
                    best[after] = found
        kept = {s: b for s, b in best.items() if not any(o != s and c[0] + BRIDGE[o, s] < b[0] for o, c in best.items())}
        now = {}
        for place, s in enumerate(sorted(kept, key=lambda s: kept[s][1:3])):
            cost, _, letters, before = kept[s]
            leaf = Node(self.survivors[before][2], letters, row, before)
            leaf.refs = 1
            now[s] = (cost, place, leaf)
        for _, _, old in self.survivors.values():
            old.release()
        self.survivors = now
        return self.settled()

    def settled(self) -> list[Edit]:
        """Edits down to the last ancestor that all survivors share, which becomes the root."""
        out: list[Edit] = []
        while self.root.refs == 1 and self.root.children:
            self.root = self.root.children[0]
            self.root.parent = None
            out += edits_of(self.root)
        return out

    def end(self) -> list[Edit]:
        """The rest of the cheapest path; `cost` holds its price."""
        state = min(self.survivors, key=lambda s: (self.survivors[s][0] + INSERT * len(ENDS[s]), self.survivors[s][1]))
        cost, _, leaf = self.survivors[state]
        self.cost = cost + INSERT * len(ENDS[state])
        path, node = [], leaf
        while node is not self.root:
            path.append(node)
            node = node.parent
        out = [e for n in reversed(path) for e in edits_of(n)]
        for _ in ENDS[state]:
            state = PLAIN[state]
            out.append(Edit("I", ROLES[state], ""))
        return out


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive after the damage that crc32('conv_id:turn') % 20 decides: 0 drops the row (it stays with
    alive false, so that its conversation does), 1 empties its text, 2 takes out . ! ?, 3 repeats it, 4 makes it the user's."""
    how = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", how.alias("how"), text_of("role").alias("role"), text_of("text").alias("text"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.col("how") != 0).alias("alive"), times.alias("copy"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns of rows as they are."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), F.lit(True).alias("alive"), F.lit(1).alias("copy"))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order, with blank, duplicate and truncated: its first fault counts. One shuffle."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    core = F.rtrim(F.col("text"), F.lit(BLANKS))
    seen = F.row_number().over(Window.partitionBy("conv_id", "alive", "role", "text").orderBy(order[0], order[3])) > 1
    marked = rows.repartition("conv_id").withColumns({"blank": core == "", "seen": seen, "closed": F.right(core, F.lit(1)).isin(".", "!", "?")})
    blank, duplicate = F.col("blank"), ~F.col("blank") & F.col("seen")
    out = marked.select(
        "conv_id", "turn", "role", "text", "alive", "copy", blank.alias("blank"), duplicate.alias("duplicate"), (~blank & ~F.col("seen") & ~F.col("closed")).alias("truncated"),
    )
    return out.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order).drop("copy")


class Summary:
    """What is counted of a conversation on the way through."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.repair, self.sha, self.letters = conv_id, Repair(), hashlib.sha256(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.last_turn = self.last_initial = None
        self.any = False

    def row(self, turn: int | None, row: Row, blank: bool, duplicate: bool) -> list[Edit]:
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + row.truncated
        if turn is not None and turn != self.last_turn:
            self.turns, self.least, self.most, self.last_turn = self.turns + 1, turn if self.least is None else self.least, turn, turn
        initial = row.role[:1]
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        return self.note(self.repair.feed(row))

    def note(self, edits: list[Edit]) -> list[Edit]:
        for e in edits:
            self.letters.append(e.letter)
            if e.role is not None:
                self.sha.update((b"\n" if self.any else b"") + f"{e.role}:{e.text}".encode())
                self.any = True
        return edits

    def end(self) -> list[Edit]:
        return self.note(self.repair.end())

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Summary, list[Edit], bool]]:
    """(conversation, edits settled by now, whether it has ended), from ordered rows."""
    now: Summary | None = None
    for batch in batches:
        names = ("conv_id", "turn", "role", "text", "alive", "blank", "duplicate", "truncated")
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            for conv, turn, role, text, alive, blank, duplicate, truncated in zip(*[part.column(n).to_pylist() for n in names], strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        yield now, now.end(), True
                    now = Summary(conv)
                if alive and (edits := now.row(turn, Row(role, text, blank or duplicate, truncated), blank, duplicate)):
                    yield now, edits, False
    if now is not None:
        yield now, now.end(), True


REPORT = StructType(
    [StructField(n, LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [StructField(n, StringType()) for n in ("audit", "repaired_sha256")]
)
EDITS = StructType([StructField("place", LongType()), *[StructField(n, StringType()) for n in ("edit", "role", "text")]])


def with_conv(rows: DataFrame, more: StructType) -> StructType:
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *more.fields])


def in_batches(found: Iterator[tuple], form: StructType, most: int = 2048) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(form)
    while held := list(islice(found, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """A row a conversation of rows (as of `damaged` or `undamaged`): conv_id; gaps in turns; rows by first fault: blank,
    duplicate, truncated; illegal neighbours; cost and audit (letters K, R, D, I) of the repair; repaired_sha256."""
    form = with_conv(rows, REPORT)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for c, _, ended in conversations_of(batches):
            if ended:
                yield c.conv_id, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, c.repair.cost, "".join(c.letters), c.sha.hexdigest()

    return ordered(rows).mapInArrow(lambda batches: in_batches(found(batches), form), form)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text. Edits leave the task as they settle."""
    form = with_conv(rows, EDITS)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for c, edits, ended in conversations_of(batches):
            for e in edits:
                if e.role is not None:
                    yield c.conv_id, place, *e
                    place += 1
            place = 0 if ended else place

    return ordered(rows).mapInArrow(lambda batches: in_batches(found(batches), form), form)
