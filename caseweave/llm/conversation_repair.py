"""Cheapest repairs of conversations, by a Viterbi search whose survivors coalesce.

A row has at most one fault, the first of: ``blank`` (nothing but blanks), ``duplicate`` (role and text stood earlier in the conversation),
``truncated`` (the last character that is no blank closes no sentence). The edits give a conversation whose role initials read ``(s?(ua)+)?``: keep
a row (0), rerole it to user or assistant (1), delete it (2; a must for blank and duplicate rows) or insert an empty user or assistant row
anywhere (5). A truncated row that stays costs 5 more. Of the cheapest edits those are chosen whose initials D, I, K, R, read in order, are least.

Search: what may follow depends on one of four states (nothing yet, after a system, a user, an assistant row), so a row at a time each state
keeps its best edits. These hang in one tree of back pointers. An edit that no survivor refers to any more, by itself or through later edits, is
removed, and so are survivors that a complete conversation beats whatever follows; once all survivors share an edit it is settled and leaves the tree. So only what is undecided is held, however long the conversation is.
Survivors of equal cost are compared by all their undecided edits; what is settled is common to them. No one's edits up to a row
begin with all of another's, so the order of the survivors is carried from row to row and only what came since is compared.

Rows of a conversation pass through one task in order, spilled and sorted by Spark; its edits leave while later rows arrive. The task holds the undecided
rows only.

Edges: a null role or text reads as empty; null turns come first. Rows of one turn follow role and text, equal rows are adjacent. Rows whose
conversation is null are one conversation. Texts of any length are whole; each is held while undecided. An empty table gives no edits.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, crc32_of, slices

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: Roles by the state they lead to; state 0 is the beginning.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after the next row that is no system row.
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIALS = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
COMPLETE = (START, ASSISTANT)
#: What a complete conversation must pay at most to follow any edits that these states may follow: only the beginning can keep a system row, which costs a deletion.
BEHIND = {START: DELETE, SYSTEM: 0}
LEGAL = frozenset(("su", "ua", "au"))
ROWS_OUT = 2048


class Edit:
    """A node of the tree; it lives as long as a survivor holds it or a later edit refers to it."""

    __slots__ = ("parent", "later", "held", "letter", "row")

    def __init__(self, parent: Edit | None, letter: str, row: tuple) -> None:
        self.parent, self.letter, self.row = parent, letter, row
        self.later: set[Edit] = set()
        self.held = True
        if parent is not None:
            parent.later.add(self)

    def release(self) -> None:
        self.held = False
        edit = self
        while not (edit.held or edit.later) and edit.parent is not None:
            edit.parent.later.discard(edit)
            edit = edit.parent


class Repair:
    """The search over one conversation. ``settled`` are edits that no later row can change, in order."""

    def __init__(self) -> None:
        self.root = Edit(None, "", ())
        #: By state: the cost, the last edit, the rank of the edits up to the last row among the survivors, and the letters since.
        self.best: dict[int, tuple[int, Edit, int, str]] = {START: (0, self.root, 0, "")}
        self.settled: list[tuple] = []
        self.insert()

    def row(self, turn: object, role: str, text: str, fault: str | None) -> None:
        bound = fault in ("blank", "duplicate")
        extra = CUT_OFF if fault == "truncated" else 0
        ways: dict[int, list[tuple]] = {}
        for state, (cost, edit, rank, since) in self.best.items():
            ways.setdefault(state, []).append((cost + DELETE, rank, since + "D", edit, (turn, role, None, None, fault, DELETE)))
            if bound:
                continue
            to = FOLLOWS[state]
            ways.setdefault(to, []).append((cost + REROLE + extra, rank, since + "R", edit, (turn, role, ROLES[to], text, fault, REROLE + extra)))
            to = SYSTEM if state == START and role[:1] == INITIALS[SYSTEM] else to
            if role[:1] == INITIALS[to]:
                ways.setdefault(to, []).append((cost + KEEP + extra, rank, since + "K", edit, (turn, role, role, text, fault, KEEP + extra)))
        before = self.best
        won = {state: min(found, key=lambda w: w[:3]) for state, found in ways.items()}
        self.best = {}
        for rank, state in enumerate(sorted(won, key=lambda s: won[s][1:3])):
            cost, _, letters, edit, row = won[state]
            self.best[state] = (cost, Edit(edit, letters[-1], row), rank, "")
        for _, edit, *_ in before.values():
            edit.release()
        self.insert()
        self.give_up()
        self.settle()

    def insert(self) -> None:
        """Insertions after the row at hand: from the cheapest state on, as each costs something."""
        todo = set(self.best)
        while todo:
            state = min(todo, key=lambda s: self.best[s][0])
            todo.discard(state)
            cost, edit, rank, since = self.best[state]
            to, way = FOLLOWS[state], (cost + INSERT, rank, since + "I")
            old = self.best.get(to)
            if old is None or way < (old[0], *old[2:]):
                self.best[to] = (way[0], Edit(edit, "I", (None, None, ROLES[to], "", None, INSERT)), *way[1:])
                if old is not None:
                    old[1].release()
                todo.add(to)

    def give_up(self) -> None:
        """Drop survivors that can no longer win, not even in a tie."""
        for state, behind in BEHIND.items():
            if state in self.best and self.best[ASSISTANT][0] + behind < self.best[state][0]:
                self.best.pop(state)[1].release()

    def settle(self) -> None:
        while not self.root.held and len(self.root.later) == 1:
            self.root = self.root.later.pop()
            self.root.parent = None
            self.settled.append((self.root.letter, *self.root.row))

    def end(self) -> None:
        """Of the complete states the cheapest wins."""
        chosen = min((self.best[s] for s in COMPLETE if s in self.best), key=lambda x: (x[0], *x[2:]))[1]
        for _, edit, *_ in self.best.values():
            if edit is not chosen:
                edit.release()
        chosen.held = True
        while self.root is not chosen:
            self.root.held = False
            self.settle()

    def taken(self) -> list[tuple]:
        out, self.settled = self.settled, []
        return out


EDIT_FIELDS = "edit string, turn {turn}, role string, fixed_role string, text string, fault string, charge bigint"


def repaired(schema: pa.Schema) -> Callable:
    """Rows (conversation, turn, role, text, fault) come sorted by conversation and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, search, step, out = None, None, 0, []

        def flush() -> None:
            nonlocal step
            for edit in search.taken():
                out.append((conversation, step, *edit))
                step += 1

        for part in slices(batches):
            for name, *row in zip(*(c.to_pylist() for c in part.columns)):
                if search is None or name != conversation:
                    if search is not None:
                        search.end()
                        flush()
                    conversation, search, step = name, Repair(), 0
                search.row(*row)
                flush()
                if len(out) >= ROWS_OUT:
                    yield as_batch(out)
                    out = []
        if search is not None:
            search.end()
            flush()
        yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, step, edit, turn, role, fixed_role, text, fault, charge): the edits of every conversation. A partition has whole
    conversations, each in order; deleted rows have no ``fixed_role`` and no ``text``, inserted ones no ``turn`` and no ``role``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {c: rows.schema[c].dataType for c in (conversation, turn)}
    read = rows.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))],
    ).repartition("conversation")
    place = F.row_number().over(Window.partitionBy("conversation", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    end = F.right(F.btrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", "blank").when(place > 1, "duplicate").when(~end.isin(*".!?"), "truncated")
    in_order = read.select("conversation", "turn", "role", "text", fault.alias("fault")).sortWithinPartitions(
        "conversation", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == "duplicate"
    )
    named = {"conversation": kinds[conversation].simpleString(), "turn": kinds[turn].simpleString()}
    schema = pa.schema([
        ("conversation", to_arrow_type(kinds[conversation])), ("step", pa.int64()), ("edit", pa.string()), ("turn", to_arrow_type(kinds[turn])),
        ("role", pa.string()), ("fixed_role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("charge", pa.int64()),
    ])
    return in_order.mapInArrow(repaired(schema), "conversation {conversation}, step bigint, ".format(**named) + EDIT_FIELDS.format(**named))


class Totals:
    """What is said of one conversation, gathered edit by edit."""

    def __init__(self) -> None:
        self.turns: list = []  # least, greatest and last
        self.distinct = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.before: str | None = None
        self.audit: list[str] = []
        self.text = sha256()
        self.rows = 0

    def add(self, edit: str, turn: int | None, role: str | None, fixed_role: str | None, text: str | None, fault: str | None, charge: int) -> None:
        self.audit.append(edit)
        self.cost += charge
        if edit != "I":
            if turn is not None and (not self.turns or turn != self.turns[2]):
                self.distinct += 1
                self.turns = [self.turns[0] if self.turns else turn, turn, turn]
            if self.before is not None and self.before + role[:1] not in LEGAL:
                self.illegal += 1
            self.before = role[:1]
            if fault is not None:
                self.faults[fault] += 1
        if edit != "D":
            self.text.update((b"\n" if self.rows else b"") + f"{fixed_role}:{text}".encode("utf-8"))
            self.rows += 1

    def row(self) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.text.hexdigest()


TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def summed(kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, totals, out = None, None, []
        for part in slices(batches):
            for name, step, *edit in zip(*(c.to_pylist() for c in part.columns)):
                if step == 0:
                    if totals is not None:
                        out.append((conversation, *totals.row()))
                    conversation, totals = name, Totals()
                totals.add(*edit)
            if len(out) >= ROWS_OUT:
                yield as_batch(out)
                out = []
        if totals is not None:
            out.append((conversation, *totals.row()))
        yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["conversation", *TOTALS]
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def totals(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s edits, taken as they come: faults, cost, the edits' initials, and the hash of the repaired rows.

    The hash of a conversation is one stream over its rows, so they pass through one task, which holds the hash and the initials."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = edits.schema["conversation"].dataType
    return edits.mapInArrow(summed(to_arrow_type(kind)), f"conversation {kind.simpleString()}, " + ", ".join(f"{n} bigint" for n in TOTALS[:6]) + ", audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with some rows dropped, emptied, cut off, repeated or given to the user, by the hash of their place."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    marked = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), (crc32_of(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20).alias("h"))
    times = F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1)
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return marked.select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_"),
    ).drop("_")


def audited(rows: DataFrame) -> DataFrame:
    """The totals of every conversation of ``rows`` after damage; those without a row left have none of anything."""
    found = totals(repair(damaged(rows)))
    every = rows.select("conv_id").distinct()
    return every.join(found, every["conv_id"].eqNullSafe(found["conversation"]), "left").select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in TOTALS[:6]],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"),
    )
