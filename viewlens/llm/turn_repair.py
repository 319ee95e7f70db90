"""Cheapest edits that make the roles of a conversation's turns follow each other.

Legal role initials are ``(s?(ua)+)?``. A turn is kept at no cost, gets the role ``user`` or
``assistant`` for 1, or is deleted for 2, which blank and duplicate turns must be; an empty turn of
either role is inserted anywhere for 5, and a truncated turn that stays costs 5 more.

The costs to the end of a conversation are a vector over the four states of that pattern, and a turn
of some role and fault is a min-plus matrix upon it. Equal consecutive turns are collapsed to a run,
which takes the binary powers of its matrix, cached for all conversations. Then the choices are
unrolled from the front, the first letter in the alphabet where several cost the same.

Matrices are associative, so a conversation needn't lie in one task: turns are sorted by ranges, and
where a range cuts a conversation, each part gives its matrix, learns the costs behind it from those
of the parts that follow, unrolls for every state that it could begin in, and the parts are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.llm.tables import written

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
RELABEL, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5

#: What comes with each conversation, beside its id.
SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
COUNTS = [c.split()[0] for c in SUMMARY.split(", ")][:-1]

#: Rows that a Python step returns at once.
ROWS = 4096

# --- states and costs ---------------------------------------------------------------------

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 60

#: The state behind a kept turn by its role, and behind one that is given a role or inserted.
KEPT = {
    SYSTEM: {START: AFTER_SYSTEM},
    USER: dict.fromkeys((START, AFTER_SYSTEM, AFTER_ASSISTANT), AFTER_USER),
    ASSISTANT: {AFTER_USER: AFTER_ASSISTANT},
    OTHER: {},
}
FREE = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
ENDS = (START, AFTER_ASSISTANT)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

Matrix = tuple[tuple[int, ...], ...]
Costs = tuple[int, ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(x + b[k][j] for k, x in enumerate(row)), FAR) for j in STATES) for row in a)


def _apply(m: Matrix, costs: Costs) -> Costs:
    return tuple(min(x + c for x, c in zip(row, costs)) for row in m)


UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in STATES) for i in STATES)
_ONE = tuple(tuple(0 if i == j else INSERT if j == FREE[i] else FAR for j in STATES) for i in STATES)
#: More than two insertions in a row never pay.
_INSERTED = _times(_ONE, _ONE)
END: Costs = _apply(_INSERTED, tuple(0 if q in ENDS else FAR for q in STATES))


def symbol(role: int, fault: int) -> int:
    return role * 4 + fault


def edits(sym: int, state: int) -> list[tuple[str, int, int]]:
    """What can be done to a turn in a state: letter, cost, state behind it."""
    role, fault = divmod(sym, 4)
    found = [("D", DELETE, state)]
    if fault in (OK, TRUNCATED):
        more = CUT_SHORT if fault == TRUNCATED else 0
        if state in KEPT[role]:
            found.append(("K", more, KEPT[role][state]))
        found.append(("R", RELABEL + more, FREE[state]))
    return found


@lru_cache(maxsize=None)
def power(sym: int, k: int) -> Matrix:
    """The matrix of a run of 2**k turns."""
    if k:
        return _times(power(sym, k - 1), power(sym, k - 1))
    rows = [[FAR] * 4 for _ in STATES]
    for q in STATES:
        for _, cost, to in edits(sym, q):
            rows[q][to] = min(rows[q][to], cost)
    return _times(_INSERTED, tuple(map(tuple, rows)))


def advance(sym: int, n: int, costs: Costs) -> Costs:
    """The costs before a run of ``n`` turns, from those behind it."""
    k = 0
    while n:
        if n & 1:
            costs = _apply(power(sym, k), costs)
        n >>= 1
        k += 1
    return costs


def run_matrix(runs: list[list[int]]) -> Matrix:
    out = UNIT
    for sym, n in runs:
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = _times(out, power(sym, k))
    return out


def _one_turn(sym: int, costs: Costs, state: int) -> tuple[str, int]:
    before, letters = _apply(power(sym, 0), costs), ""
    while True:
        options = [*edits(sym, state), ("I", INSERT, FREE[state])]
        for letter, cost, to in sorted(options):
            if cost + (before if letter == "I" else costs)[to] == before[state]:
                break
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


def _unrolled(sym: int, n: int, costs: Costs, state: int) -> tuple[str, int]:
    if n == 1:
        return _one_turn(sym, costs, state)
    half = 1 << (n - 1).bit_length() - 1
    first, state = unrolled(sym, half, advance(sym, n - half, costs), state)
    second, state = unrolled(sym, n - half, costs, state)
    return first + second, state


_short = lru_cache(maxsize=1 << 15)(_unrolled)


def unrolled(sym: int, n: int, costs: Costs, state: int) -> tuple[str, int]:
    """Letters of the cheapest edits of a run, and the state behind it."""
    low = min(costs)
    costs = tuple(c - low for c in costs)
    return (_short if n <= 64 else _unrolled)(sym, n, costs, state)


def audit(runs: list[list[int]], costs: Costs, state: int, last: bool) -> tuple[str, int]:
    """Letters of the cheapest edits of all runs, given the costs behind them; ``last`` closes the
    conversation."""
    behind = [costs]
    for sym, n in reversed(runs[1:]):
        behind.append(advance(sym, n, behind[-1]))
    letters = []
    for (sym, n), after in zip(runs, reversed(behind)):
        part, state = unrolled(sym, n, after, state)
        letters.append(part)
    while last and state not in ENDS:
        letters.append("I")
        state = FREE[state]
    return "".join(letters), state


# --- turns to runs ------------------------------------------------------------------------


class Part:
    """The turns of a conversation, or of a part of one, as runs and counts."""

    def __init__(self, conv):
        self.conv = conv
        self.runs: list[list[int]] = []
        self.low = self.high = self.first = None
        self.turns = 0

    def add(self, sym: int, n: int) -> None:
        if self.runs and self.runs[-1][0] == sym:
            self.runs[-1][1] += n
        else:
            self.runs.append([sym, n])

    def turn(self, turn: int | None, key: bytes, role: int, fault: int, copies: int) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if fault == BLANK:
            self.add(symbol(role, BLANK), copies)
            return
        if self.first == (turn, key):
            self.add(symbol(role, fault), 1)
            copies -= 1
        if copies:
            self.add(symbol(role, DUPLICATE), copies)

    def counts(self) -> list[int]:
        """Blank, duplicate and truncated turns, and illegal neighbours."""
        found = [0] * 4
        illegal = 0
        before = None
        for sym, n in self.runs:
            role, fault = divmod(sym, 4)
            found[fault] += n
            illegal += n - 1 + (before is not None and (before, role) not in LEGAL)
            before = role
        return [*found[1:], illegal]

    def summary(self) -> list:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        costs = END
        for sym, n in reversed(self.runs):
            costs = advance(sym, n, costs)
        return [gaps, *self.counts(), costs[START], audit(self.runs, END, START, True)[0]]


PART = "part int, symbols array<int>, lengths array<bigint>, matrix array<bigint>, counts array<bigint>, low bigint, high bigint, turns bigint"


def _parts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted turns to summaries, of a partition's first and last conversation to open parts: they
    may go on in its neighbours."""
    number = TaskContext.get().partitionId()
    out: list[tuple] = []
    now, is_first = None, True

    def row(part: Part, is_open: bool) -> tuple:
        if not is_open:
            return (part.conv, *part.summary(), *[None] * 8)
        matrix = [x for line in run_matrix(part.runs) for x in line]
        symbols, lengths = [s for s, _ in part.runs], [n for _, n in part.runs]
        return (part.conv, *[None] * 7, number, symbols, lengths, matrix, part.counts(), part.low, part.high, part.turns)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for b in batches:
        for conv, turn, key, is_row, role, fault, copies in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(row(now, is_first))
                    is_first = False
                now = Part(conv)
            if not is_row:
                now.first = (turn, key)
            elif copies:
                now.turn(turn, key, role, fault, copies)
        if len(out) >= ROWS:
            yield batch()
            out = []
    if now is not None:
        out.append(row(now, True))
    if out:
        yield batch()


# --- conversations over several ranges ----------------------------------------------------

JOINED = f"{SUMMARY}, behind array<struct<part: int, costs: array<bigint>, last: boolean>>"


def _join_parts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The counts of whole conversations from their parts' small columns, and the costs behind each part."""
    for b in batches:
        rows = []
        for conv, parts in zip(*(c.to_pylist() for c in b.columns)):
            counts = [sum(p["counts"][k] for p in parts) for k in range(4)]
            low = high = before = None
            turns = 0
            for p in parts:
                if p["first"] is not None:
                    counts[3] += before is not None and (before, p["first"] // 4) not in LEGAL
                    before = p["last"] // 4
                if p["low"] is not None:
                    turns += p["turns"] - (p["low"] == high)
                    low, high = p["low"] if low is None else low, p["high"]
            costs, behind = END, []
            for p in reversed(parts):
                behind.append({"part": p["part"], "costs": costs, "last": not behind})
                costs = _apply(tuple(tuple(p["matrix"][4 * q : 4 * q + 4]) for q in STATES), costs)
            gaps = 0 if low is None else high - low + 1 - turns
            rows.append((conv, gaps, *counts, costs[START], None, behind))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


UNROLLED = "part int, audits array<string>, states array<int>"


def _unroll_parts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for conv, part, symbols, lengths, costs, last in zip(*(c.to_pylist() for c in b.columns)):
            runs = list(zip(symbols, lengths))
            found = [audit(runs, tuple(costs), q, last) for q in STATES]
            row = ([conv], [part], [[a for a, _ in found]], [[q for _, q in found]])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)


def _arrow(df: DataFrame, step, columns: str) -> DataFrame:
    """``df`` through a step that returns ``conv_id`` as it came, and ``columns``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([df.schema["conv_id"], *StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: step(batches, arrow), schema)


def _joined(open_parts: DataFrame) -> DataFrame:
    """Summaries of the conversations that begin or end a range."""
    small = F.struct(
        "part",
        "matrix",
        "counts",
        "low",
        "high",
        "turns",
        F.try_element_at("symbols", F.lit(1)).alias("first"),
        F.try_element_at("symbols", F.lit(-1)).alias("last"),
    )
    whole = open_parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(small)).alias("parts"))
    whole = written(_arrow(whole, _join_parts, JOINED), "conversations")
    behind = whole.select(F.col("conv_id").alias("of"), F.explode("behind").alias("b")).select("of", "b.*")
    behind = behind.withColumnRenamed("part", "of_part")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    parts = open_parts.join(behind, same).select("conv_id", "part", "symbols", "lengths", "costs", "last")
    unrolled_parts = _arrow(parts, _unroll_parts, UNROLLED)
    steps = F.sort_array(F.collect_list(F.struct("part", "audits", "states")))
    begin = F.struct(F.lit(START).alias("state"), F.lit("").alias("audit"))
    step = lambda now, p: F.struct(
        p["states"][now["state"]].alias("state"), F.concat(now["audit"], p["audits"][now["state"]]).alias("audit")
    )
    audits = unrolled_parts.groupBy(F.col("conv_id").alias("of")).agg(
        F.aggregate(steps, begin, step, lambda now: now["audit"]).alias("letters")
    )
    return whole.join(audits, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", *COUNTS, F.col("letters").alias("audit")
    )


# --- the operator -------------------------------------------------------------------------


def _key(role: Column, text: Column) -> Column:
    """Stands for role and text: half of a SHA-256."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def _turns(rows: DataFrame) -> DataFrame:
    rows = rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.col("copies") if "copies" in rows.columns else F.lit(1)).cast("bigint").alias("copies"),
    )
    return rows.withColumn("turn_key", _key(F.col("role"), F.col("text")))


def _marked(rows: DataFrame) -> DataFrame:
    """Turns without their texts, a row for equal ones, and before each role and text's first turn
    a row that says so."""
    initial = F.substring("role", 1, 1)
    said = F.rtrim("text", F.lit(SPACE))
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(said == "", BLANK).when(F.right(said, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    turns = rows.groupBy(
        "conv_id", "turn", "turn_key", role.cast("tinyint").alias("role"), fault.cast("tinyint").alias("fault")
    ).agg(F.sum("copies").alias("copies"))
    turns = written(turns, "turns")
    first = F.when(~F.bool_or(F.col("turn").isNull()), F.min("turn"))
    firsts = turns.filter("copies > 0").groupBy("conv_id", "turn_key").agg(first.alias("turn"))
    none = F.lit(0).cast("tinyint")
    return turns.select("conv_id", "turn", "turn_key", F.lit(True).alias("is_row"), "role", "fault", "copies").union(
        firsts.select("conv_id", "turn", "turn_key", F.lit(False), none, none, F.lit(0).cast("bigint"))
    )


def solve(rows: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``), with
    ``SUMMARY``.

    Turns are in the order of ``turn``, nulls first, then of a hash of role and text, so that equal
    rows stand together. A null role or text is one space; a null ``conv_id`` is a conversation. A
    column ``copies``, if there is one, says how often a row stands: 0 leaves only its conversation.
    A turn is blank (white space only), else duplicate (its role and text stand earlier), else
    truncated (it does not end in ``.``, ``!`` or ``?``). ``gaps`` counts the numbers that miss
    between the first and last turn. ``audit`` has a letter for each edit, K, R, D or I, the least
    in the alphabet among the cheapest. A conversation without turns has zeros and no edits, an
    empty table gives an empty one. Other columns are left out, whatever their names.
    """
    order = ["conv_id", "turn", "turn_key"]
    marked = _marked(_turns(rows)).repartitionByRange(*order).sortWithinPartitions(*order, "is_row")
    parts = written(_arrow(marked, _parts, f"{SUMMARY}, {PART}"), "parts")
    ended = parts.filter("part IS NULL").select("conv_id", *COUNTS, "audit")
    return ended.unionByName(_joined(parts.filter("part IS NOT NULL")))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted turns, each conversation's summary before them: ``(conv, summary)`` at its start, then
    ``(letter, turn, role, text)`` for each turn that stays."""
    letters, at, last = "", 0, ""

    def inserted():
        nonlocal at, last
        while at < len(letters) and letters[at] == "I":
            last = "assistant" if last.startswith("u") else "user"
            at += 1
            yield "I", None, last, ""

    for b in batches:
        for conv, turn, copies, role, text, summary in zip(*(c.to_pylist() for c in b.columns)):
            if summary is not None:
                yield from inserted()
                letters, at, last = summary["audit"], 0, ""
                yield conv, summary
            for _ in range(copies):
                yield from inserted()
                letter = letters[at]
                at += 1
                if letter == "R":
                    last = "assistant" if last.startswith("u") else "user"
                elif letter == "K":
                    last = role
                if letter != "D":
                    yield letter, turn, last, text
    yield from inserted()


def _with_summaries(rows: DataFrame, solved: DataFrame) -> DataFrame:
    turns = _turns(rows)
    kind = solved.schema.simpleString()
    rows = turns.filter("copies > 0").select(
        "conv_id", "turn", "copies", "role", "text", F.lit(None).cast(kind).alias("summary"), "turn_key"
    )
    heads = solved.select(
        "conv_id", *(F.lit(None).cast(t) for t in ("bigint",)), F.lit(0).cast("bigint"),
        *(F.lit(None).cast("string"),) * 2, F.struct(*solved.columns), F.lit(None).cast("binary"),
    )
    both = rows.union(heads).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.col("summary").isNull(), "turn", "turn_key").drop("turn_key")


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    done: list[list] = []
    digest, first = None, True
    for event in _followed(batches):
        if len(event) == 2:
            if digest is not None:
                done[-1].append(digest.hexdigest())
            if len(done) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
            conv, summary = event
            done.append([conv, *(summary[c] for c in COUNTS), summary["audit"]])
            digest, first = hashlib.sha256(), True
        else:
            digest.update(f"{'' if first else chr(10)}{event[2]}:{event[3]}".encode())
            first = False
    if digest is not None:
        done[-1].append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def with_digest(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """``solved`` with ``repaired_sha256``, of the repaired turns as ``role:text`` in lines.

    The turns of a conversation pass through one task in order, as a digest asks, one at a time and
    without being held.
    """
    return _arrow(_with_summaries(rows, solved), _digests, f"{SUMMARY}, repaired_sha256 string")


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    conv, position = None, 0
    for event in _followed(batches):
        if len(event) == 2:
            conv, position = event[0], 0
            continue
        out.append((conv, position, *event))
        position += 1
        if len(out) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``position`` from 0, ``edit``, ``turn`` (null where
    inserted), ``role`` and ``text``. Deleted turns are left out."""
    return _arrow(
        _with_summaries(rows, solved), _repaired, "position bigint, edit string, turn bigint, role string, text string"
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults, by the CRC-32 of ``conv_id:turn``: of 20 turns one is left out
    (``copies`` 0), one has no text, one no sentence marks, one stands twice and one is the user's.
    Nulls count as one space, in that key too."""
    word = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(word("role")).alias("role"),
        text.alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )
