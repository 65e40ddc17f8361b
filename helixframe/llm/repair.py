"""Repair of conversations by the lightest derivation of a well-formed one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..tables import materialize

SPACES = " \t\n\v\f\r"
#: Where a conversation stands: nothing yet, after a system, user or assistant turn; it may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_LEGAL = ("su", "ua", "au")

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_STATS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_TURNS = "turns array<struct<role:string,text:string>>"
PIECES = f"conv_id bigint, piece bigint, whole boolean, {_STATS}, {_TURNS}"
_STEPS = "steps array<struct<before:int,after:int,cost:bigint,audit:string>>"
_SUMS = (
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, n_turns bigint, first_turn bigint, last_turn bigint"
)
_HEADS = f"conv_id bigint, task bigint, seq bigint, {_SUMS}, {_STEPS}"
_ELEMENTS = "elements array<struct<role:string,text:string,deleted:bigint>>"
_SCANNED = f"{_HEADS}, gaps bigint, cost bigint, audit string, {_TURNS}, {_ELEMENTS}"


class Element(NamedTuple):
    """A turn, or ``deleted`` turns in a row of which nothing may stay."""

    role: str
    text: str
    truncated: bool = False
    deleted: int = 0


Step = tuple[int, str, int]  # cost, audit, state after


def element_steps(element: Element, state: int) -> list[Step]:
    """The edits of one element in a state: Delete 2, Keep 0, Rerole 1; a truncated turn that stays adds 5."""
    if element.deleted:
        return [(2 * element.deleted, "D" * element.deleted, state)]
    stays = 5 if element.truncated else 0
    steps = [(2, "D", state), (1 + stays, "R", ASSISTANT if state == USER else USER)]
    if (after := _NEXT.get((state, element.role[:1]))) is not None:
        steps.append((stays, "K", after))
    return steps


def derive(n: int, steps: Callable[[int, int], list[Step]], start: int, inserts: bool, goal: bool) -> dict[int, tuple[int, str]]:
    """Knuth's lightest derivations over the items (elements read, state): the values of the items that have read all ``n``.

    A deduction takes a finalised item and the axiom of the next element to an
    item that has read one more; an Insert (5) takes an item to one that has
    read as many.  Both add to the cost and append to the audit, so no value is
    below that of the item it comes from, and the item popped with the least
    (cost, audit) is final.  With equal costs none of two audits of one item is
    the beginning of the other, so their order outlives what is appended.  With
    ``goal`` the agenda ends as soon as an accepting item is final.
    """
    agenda, final = [(0, "", 0, start)], {}
    while agenda:
        cost, audit, i, state = heappop(agenda)
        if (i, state) in final:
            continue
        final[i, state] = cost, audit
        if i == n and goal and state in ACCEPTED:
            return {state: (cost, audit)}
        if inserts:
            after = ASSISTANT if state == USER else USER
            if (i, after) not in final:
                heappush(agenda, (cost + 5, audit + "I", i, after))
        if i < n:
            for more, edits, after in steps(i, state):
                if (i + 1, after) not in final:
                    heappush(agenda, (cost + more, audit + edits, i + 1, after))
    return {state: value for (i, state), value in final.items() if i == n}


class Segment:
    """Consecutive turns of a conversation: its elements, what is counted, and the edits between any two states."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.elements, self.chars, self.seq = conv_id, [], 0, 0
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.initials: tuple[str, str] | None = None
        self.turns: tuple[int, int | None, int | None] = (0, None, None)

    def add(self, turn: int | None, role: str, text: str, n: int, first: bool) -> None:
        """``n`` equal rows; ``first``: no earlier turn has this role and text."""
        words = text.strip(SPACES)
        initial = role[:1]
        self.counts["illegal"] += n - 1 + (self.initials is not None and self.initials[1] + initial not in _LEGAL)
        self.initials = (self.initials[0] if self.initials else initial, initial)
        if turn is not None and turn != self.turns[2]:
            self.turns = (self.turns[0] + 1, turn if self.turns[1] is None else self.turns[1], turn)
        if not words:
            self.counts["blank"] += n
        elif first:
            self.counts["truncated"] += words[-1] not in ".!?"
            self.counts["duplicate"] += n - 1
            self.elements.append(Element(role, text, words[-1] not in ".!?"))
            self.chars += len(role) + len(text)
            n -= 1
        else:
            self.counts["duplicate"] += n
        if n:
            if self.elements and self.elements[-1].deleted:
                n += self.elements.pop().deleted
            self.elements.append(Element("", "", deleted=n))

    def _steps(self, i: int, state: int) -> list[Step]:
        return element_steps(self.elements[i], state)

    def head(self) -> dict:
        initials = self.initials or (None, None)
        return {"conv_id": self.conv_id, "seq": self.seq, **self.counts, "first_initial": initials[0], "last_initial": initials[1]} | dict(
            zip(("n_turns", "first_turn", "last_turn"), self.turns)
        )

    def open_row(self, task: int) -> dict:
        """For a conversation that other tasks or segments have parts of."""
        steps = [
            {"before": p, "after": q, "cost": cost, "audit": audit}
            for p in range(4)
            for q, (cost, audit) in derive(len(self.elements), self._steps, p, True, False).items()
        ]
        elements = [{"role": e.role, "text": e.text, "deleted": e.deleted} for e in self.elements]
        return self.head() | {"task": task, "steps": steps, "elements": elements}

    def whole_row(self) -> dict:
        """For a conversation of which this is everything."""
        ((cost, audit),) = derive(len(self.elements), self._steps, START, True, True).values()
        n, least, most = self.turns
        gaps = most - least + 1 - n if n else 0
        return self.head() | {"gaps": gaps, "cost": cost, "audit": audit, "turns": Applied().turns(audit, self.elements)}


class Applied:
    """Edits applied to elements, in order, over any number of calls."""

    def __init__(self):
        self.state, self.at = START, 0

    def _inserted(self, audit: str, out: list[dict]) -> None:
        while audit[self.at : self.at + 1] == "I":
            self.at += 1
            out.append({"role": self._move(), "text": ""})

    def _move(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "user" if self.state == USER else "assistant"

    def turns(self, audit: str, elements: list[Element], last: bool = True) -> list[dict]:
        out: list[dict] = []
        for element in elements:
            self._inserted(audit, out)
            edit = audit[self.at]
            self.at += max(1, element.deleted)
            if edit == "R":
                out.append({"role": self._move(), "text": element.text})
            elif edit == "K":
                self.state = _NEXT[self.state, element.role[:1]]
                out.append({"role": element.role, "text": element.text})
        if last:
            self._inserted(audit, out)
        return out


def combine(parts: list[dict]) -> dict:
    """Neighbouring segments as one: sums, what their ends add, and the lightest edits between any two states."""
    tables = [{} for _ in parts]
    for table, part in zip(tables, parts):
        for s in part["steps"]:
            table.setdefault(s["before"], []).append((s["cost"], s["audit"], s["after"]))
    steps = [
        {"before": p, "after": q, "cost": cost, "audit": audit}
        for p in range(4)
        for q, (cost, audit) in derive(len(parts), lambda i, state: tables[i].get(state, []), p, False, False).items()
    ]
    out = {c: sum(p[c] for p in parts) for c in (*_COUNTS, "n_turns")}
    initials = [(p["first_initial"], p["last_initial"]) for p in parts if p["first_initial"] is not None]
    out["illegal"] += sum(a[1] + b[0] not in _LEGAL for a, b in zip(initials, initials[1:]))
    turns = [(p["first_turn"], p["last_turn"]) for p in parts if p["first_turn"] is not None]
    out["n_turns"] -= sum(a[1] == b[0] for a, b in zip(turns, turns[1:]))
    out["first_initial"], out["last_initial"] = (initials[0][0], initials[-1][1]) if initials else (None, None)
    out["first_turn"], out["last_turn"] = (turns[0][0], turns[-1][1]) if turns else (None, None)
    return out | {"steps": steps}


def _batches(rows: list[dict], schema: pa.Schema, least: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows gathered, if there are ``least``."""
    if len(rows) >= least:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
        rows.clear()


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def _same(*columns: str) -> Column:
    """Equal in all columns of the two sides ``c`` and ``f``, where null is equal to null."""
    return reduce(Column.__and__, (F.col(f"c.{x}").eqNullSafe(F.col(f"f.{x}")) for x in columns))


def repair(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    copies_col: str | None = None,
    segment_rows: int = 128,
    segment_chars: int = 1 << 20,
    fan_in: int = 64,
) -> DataFrame:
    """The cheapest repair of every conversation, in pieces (``PIECES``).

    Turns are ordered by turn number (nulls first), then role and text.  A blank
    turn and one whose role and text an earlier turn has must be deleted (2); any
    may be; a turn stays as it is (0) or becomes one of user or assistant (1),
    and 5 is added if it stays without ``.!?`` at its end; empty turns of user
    and assistant may be inserted anywhere (5).  The result is empty or has
    turns of user and assistant in pairs, after one turn whose role begins with
    s or none.  ``audit`` names the edits in order (Delete, Insert, Keep,
    Rerole); of equally cheap ones the least audit counts.

    Rows are dealt out by ranges of (conversation, turn), so a conversation of
    any size is spread.  One that lies inside a task is repaired there by
    :func:`derive` and is one piece, ``whole``.  Of the others, segments of at
    most ``segment_rows`` elements or about ``segment_chars`` characters give
    the lightest edits between any two states; ``fan_in`` segments at a time are
    combined until one is left.  Piece 0 then has the counts and the audit, and
    the pieces after it the repaired turns, in order.

    A null conversation is one of its own; a null role or text is one space;
    equal rows are repetitions and are counted before they are dealt out.  Where
    ``copies_col`` is 0 the row only names its conversation, which comes out
    empty if it has no others; 2 is a row that occurs twice.  Other columns are
    ignored; an empty table gives no rows.  A text is read whole in one task; an
    audit is as long as its conversation.
    """
    space = F.lit(" ")
    named = rows.select(
        rows[conv_col].cast("long").alias("conv_id"), rows[turn_col].cast("long").alias("turn"), F.coalesce(rows[role_col].cast("string"), space).alias("role"),
        F.coalesce(rows[text_col].cast("string"), space).alias("text"), (rows[copies_col].cast("long") if copies_col else F.lit(1).cast("long")).alias("copies"),
    )
    classes = materialize(named.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumn("digest", F.unhex(F.sha2("text", 256))), "turns")
    again = classes.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("often"), F.min("turn").alias("least"), F.bool_or(F.isnull("turn")).alias("unnumbered"))
    joined = classes.alias("c").join(again.where("often > 1").alias("f"), _same("conv_id", "role", "digest"), "left")
    first = F.when(F.col("f.often").isNull(), True).when(F.col("f.unnumbered"), F.col("c.turn").isNull()).otherwise(F.col("c.turn") == F.col("f.least"))
    ordered = (
        joined.select("c.conv_id", "c.turn", "c.role", "c.text", "c.n", first.alias("first"))
        .repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    scanned_schema, heads_schema = _arrow(_SCANNED), _arrow(_HEADS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        out: list[dict] = []
        segment, shared = None, True  # the first conversation of a task may begin in another one, the last may go on
        for batch in batches:
            for conv_id, turn, role, text, n, first in zip(*(c.to_pylist() for c in batch.columns)):
                if segment is None:
                    segment = Segment(conv_id)
                elif conv_id != segment.conv_id:
                    out.append(segment.open_row(task) if shared else segment.whole_row())
                    segment, shared = Segment(conv_id), False
                elif len(segment.elements) >= segment_rows or segment.chars >= segment_chars:
                    out.append(segment.open_row(task))
                    seq = segment.seq + 1
                    segment, shared = Segment(conv_id), True
                    segment.seq = seq
                if n:
                    segment.add(turn, role, text, n, first)
                yield from _batches(out, scanned_schema, 1000)
        if segment:
            out.append(segment.open_row(task))
        yield from _batches(out, scanned_schema)

    scanned = materialize(ordered.mapInArrow(scan, _SCANNED), "segments")
    whole = scanned.where("steps is null").select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit(True).alias("whole"), *_names(_STATS), "turns")
    parts = scanned.where("steps is not null")
    heads = parts.select(*_names(_HEADS))


    def merger(place: str) -> Callable[[pa.Table], pa.Table]:
        def merge(table: pa.Table) -> pa.Table:
            children = sorted(table.to_pylist(), key=lambda r: (r["task"], r["seq"]))
            up = {c: children[0][c] for c in ("conv_id", "task", "seq")} | combine(children)
            return pa.Table.from_pylist([up | {place: up[place] // fan_in}], schema=heads_schema)

        return merge

    for place, at in (("seq", ["conv_id", "task"]), ("task", ["conv_id"])):
        most = heads.agg(F.max(place)).first()[0] or 0
        while most:
            heads = materialize(heads.groupBy(*at, F.expr(f"{place} div {fan_in}")).applyInArrow(merger(place), _HEADS), "combined")
            most //= fan_in
    return whole.union(_pieces(heads, parts))


def _pieces(heads: DataFrame, parts: DataFrame) -> DataFrame:
    """Piece 0 of every head and the repaired segments after it; a task reads one conversation after the other, in order."""
    schema = _arrow(PIECES)
    first = F.lit(-1).cast("long")
    both = heads.withColumns({"task": first, "seq": first, "elements": F.lit(None).cast(_ELEMENTS.split(" ", 1)[1])}).unionByName(parts.select(*_names(_HEADS), "elements"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        applied = conv_id = audit = None
        piece = 0

        def following(turns: list[dict]) -> None:
            nonlocal piece
            if turns:
                piece += 1
                out.append({"conv_id": conv_id, "piece": piece, "whole": False, "turns": turns})

        for batch in batches:
            for row in batch.to_pylist():
                if row["task"] < 0:
                    if applied:
                        following(applied.turns(audit, [], True))
                    accepted = [s for s in row["steps"] if s["before"] == START and s["after"] in ACCEPTED]
                    cost, audit = min((s["cost"], s["audit"]) for s in accepted)
                    applied, conv_id, piece = Applied(), row["conv_id"], 0
                    gaps = row["last_turn"] - row["first_turn"] + 1 - row["n_turns"] if row["n_turns"] else 0
                    counts = {c: row[c] for c in _COUNTS}
                    out.append({"conv_id": conv_id, "piece": 0, "whole": False, "gaps": gaps, **counts, "cost": cost, "audit": audit, "turns": []})
                else:
                    elements = [Element(e["role"], e["text"], deleted=e["deleted"]) for e in row["elements"]]
                    following(applied.turns(audit, elements, False))
                yield from _batches(out, schema, 100)
        if applied:
            following(applied.turns(audit, [], True))
        yield from _batches(out, schema)

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq").mapInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired turns as ``role:text``, joined by line feeds.

    That of a conversation in one piece is an expression.  A hash reads its
    input in order, so all pieces of a larger one go through one task, a piece
    at a time.
    """
    line = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = conv_id = None
        filled = False
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if row["piece"] == 0:
                    if state:
                        out.append({"conv_id": conv_id, "repaired_sha256": state.hexdigest()})
                    state, conv_id, filled = sha256(), row["conv_id"], False
                elif row["line"] is not None:
                    state.update(("\n" * filled + row["line"]).encode())
                    filled = True
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "repaired_sha256": state.hexdigest()}], schema=schema)

    parts = pieces.where("not whole").select("conv_id", "piece", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return pieces.where("whole").select("conv_id", F.sha2(line, 256).alias("repaired_sha256")).union(parts.mapInArrow(run, "conv_id bigint, repaired_sha256 string"))


def _names(ddl: str) -> list[str]:
    return [f.name for f in _parse_datatype_string(ddl).fields]
