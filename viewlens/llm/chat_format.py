"""Conversations as training text: a state machine over roles, driven by a template.

The template says which role may follow which, what is written around a turn of each role, and which
texts count for the loss. A machine walks a conversation's turns in order and emits *segments*: the
marks before and after a text, and the text itself with its loss flag. Control strings within texts
and role names are escaped, so that a mark in the output always comes from the template, and the
output can be read back to the turns it was made of.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows, and characters of text, that a step returns at once; a longer text is a batch of its own.
ROWS, CHARS = 4096, 1 << 22


@dataclass(frozen=True)
class Piece:
    """What stands around a turn's text. Both parts begin with a control string of their own."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A format, declared. Every control string in the pieces must be listed in ``control``."""

    control: tuple[str, ...]
    pieces: Mapping[str, Piece]
    #: For any other role; its name stands, escaped, between ``before`` and ``named``.
    other: Piece
    named: str
    #: For each state the state that a role leads to; the state behind a role that may not come
    #: there is the role's own, in ``after``.
    start: str
    moves: Mapping[str, Mapping[str, str]]
    after: Mapping[str, str]
    ends: frozenset[str] = field(default_factory=frozenset)
    escape: str = "\\"

    @cached_property
    def _hidden(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, (self.escape, *sorted(self.control, key=len, reverse=True)))))

    @cached_property
    def marks(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.control, key=len, reverse=True))))

    def escaped(self, text: str) -> str:
        """The escape sign comes behind the first character of a control string, and twice for
        itself: no control string is left."""
        return self._hidden.sub(lambda m: m[0][0] + self.escape + m[0][1:], text)

    def unescaped(self, text: str) -> str:
        sign, out, at = self.escape, [], 0
        while (found := text.find(sign, at)) >= 0:
            # a doubled sign stands for one; a single one is left out
            out.append(text[at:found])
            if text.startswith(sign, found + 1):
                out.append(sign)
                at = found + 2
            else:
                at = found + 1
        return "".join([*out, text[at:]])

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The next state, and whether the role may come in this one."""
        to = self.moves.get(state, {}).get(role)
        return (to, True) if to is not None else (self.after.get(role, self.start), False)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn's segments: text and loss flag."""
        piece = self.pieces.get(role)
        if piece is not None:
            return [(piece.before, False), (self.escaped(text), piece.loss), (piece.after, False)]
        before = self.other.before + self.escaped(role) + self.named
        return [(before, False), (self.escaped(text), self.other.loss), (self.other.after, False)]


#: A system text, then questions and answers; the answers are learnt.
INSTRUCT = Template(
    control=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<<TEXT>>", "<<SAY>>"),
    pieces={
        "system": Piece("<<SYS>>", "<</SYS>>"),
        "user": Piece("<s>[INST]", "[/INST]"),
        "assistant": Piece("<<SAY>>", "</s>", loss=True),
    },
    other=Piece("<<ROLE>>", "<</ROLE>>"),
    named="<<TEXT>>",
    start="start",
    moves={
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    after={"system": "system", "user": "user", "assistant": "assistant"},
    ends=frozenset({"assistant"}),
)

SEGMENT = "segment bigint, turn bigint, text string, loss boolean, state string, legal boolean"


def _batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int | None = None) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[text_at]) if text_at is not None else 0
        if len(out) >= ROWS or size >= CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _segments(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[tuple]:
    now, state, number = object(), template.start, 0
    for conv, turn, role, text in _rows(batches):
        if conv != now:
            now, state, number = conv, template.start, 0
        state, legal = template.step(state, role)
        for part, loss in template.turn(role, text):
            yield conv, number, turn, part, loss, state, legal
            number += 1


def segments(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``conv_id`` and ``SEGMENT`` for the rows of ``conversations`` (``conv_id``, ``turn``,
    ``role``, ``text``): three segments for each turn, numbered from 0, with the state behind the
    turn and whether its role may come there.

    Turns are in the order of ``turn``, nulls first, then of role and text; equal rows are turns of
    their own. A null role or text is an empty one, a null ``conv_id`` a conversation. A turn out of
    order is flagged and written all the same. An empty table gives none; other columns are left
    out, whatever their names. The rows of a conversation pass through one task one by one, sorted,
    without being held, and its segments leave it in their order.
    """
    empty = F.lit("")
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = StructType([conversations.schema["conv_id"], *StructType.fromDDL(SEGMENT).fields])
    arrow = to_arrow_schema(schema)
    return ordered.mapInArrow(lambda b: _batches(_segments(b, template), arrow, 3), schema)


class Reader:
    """Formatted text, fed in stretches that cut no control string, to turns of role and text."""

    def __init__(self, template: Template):
        self.template = template
        self.by_mark = {p.before: (r, p) for r, p in template.pieces.items()}
        self.role: str | None = None
        self.open: str | None = None
        self.text: list[str] = []

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """The turns that end within ``text``."""
        t, at = self.template, 0
        for mark in t.marks.finditer(text):
            self.text.append(text[at : mark.start()])
            at = mark.end()
            yield from self._mark(mark[0])
        self.text.append(text[at:])

    def _mark(self, mark: str) -> Iterator[tuple[str, str]]:
        t = self.template
        said = "".join(self.text)
        if self.open is None:
            if said:
                raise ValueError(f"text between turns: {said[:40]!r}")
            self.open, self.text = mark, []
            return
        opened = self.open + mark if not said else None
        if self.role is None and opened and any(b.startswith(opened) for b in self.by_mark):
            self.open = opened
            return
        if self.role is None and mark == t.named and self.open == t.other.before:
            self.role, self.text = t.unescaped(said), []
            return
        role, piece = (self.role, t.other) if self.role is not None else self.by_mark.get(self.open, (None, None))
        if piece is None or mark != piece.after:
            raise ValueError(f"{mark} after {self.open}")
        self.open = self.role = None
        self.text = []
        yield role, t.unescaped(said)

    def end(self) -> None:
        if self.open is not None or "".join(self.text):
            raise ValueError("the text ends within a turn")


READ = (
    "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
    "valid boolean, first_illegal bigint"
)


def _read(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[tuple]:
    now, started = None, False

    class Conversation:
        def __init__(self, conv):
            self.conv, self.reader = conv, Reader(template)
            self.turns = self.loss_chars = self.chars = 0
            self.turn_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()
            self.state, self.illegal = template.start, None

        def row(self):
            self.reader.end()
            valid = self.illegal is None and self.state in template.ends
            digests = self.turn_digest.hexdigest(), self.loss_chars, self.loss_digest.hexdigest()
            return (self.conv, self.turns, *digests, self.chars, valid, self.illegal)

    for conv, text, loss in _rows(batches):
        if not started or conv != now.conv:
            if started:
                yield now.row()
            now, started = Conversation(conv), True
        now.chars += len(text)
        if loss:
            plain = template.unescaped(text)
            now.loss_chars += len(plain)
            now.loss_digest.update(plain.encode())
        for role, said in now.reader.feed(text):
            now.state, legal = template.step(now.state, role)
            if not legal and now.illegal is None:
                now.illegal = now.turns
            now.turns += 1
            now.turn_digest.update(f"{role}\n{said}\n".encode())
    if started:
        yield now.row()


def read_back(formatted: DataFrame, template: Template = INSTRUCT, in_order: bool = False) -> DataFrame:
    """One row for each conversation of ``segments``'s output with ``READ``, from the marks and the
    loss flags alone: turns and their digest (role, line feed, text, line feed), the code points and
    digest of the text under the loss flags, all code points, and whether the turns read back are in
    legal order and end where a conversation may (``first_illegal`` numbers turns from 0).

    ``in_order`` is for what ``segments`` has just returned; rows from a table are sorted first.
    Text that no template wrote is an error.
    """
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    schema = StructType([formatted.schema["conv_id"], *StructType.fromDDL(READ).fields])
    arrow = to_arrow_schema(schema)
    return formatted.select("conv_id", "text", "loss").mapInArrow(lambda b: _batches(_read(b, template), arrow), schema)


def as_text(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``text`` and ``loss_spans`` (code points, end exclusive) of each conversation,
    for those short enough to be one row."""
    parts = F.array_sort(F.collect_list(F.struct("segment", "text", "loss")))
    whole = formatted.groupBy("conv_id").agg(parts.alias("parts"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"))

    def step(now, p):
        end = now["at"] + F.length(p["text"])
        span = F.array(F.struct(now["at"].alias("first"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["loss"], F.concat(now["spans"], span)).otherwise(now["spans"]).alias("spans"))

    return whole.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
        F.aggregate("parts", start, step, lambda now: now["spans"]).alias("loss_spans"),
    )
