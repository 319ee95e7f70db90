"""Turn repair against a plain search over all edits, and on hand-made conversations."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from support import DATA

from viewlens.llm import turn_repair as R
from viewlens.llm.registry import QUERIES
from viewlens.llm.tables import load

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, letters, repaired turns) by trying every edit of every turn."""
    n = len(rows)

    def stays(role, so_far):
        """Initials after one more turn, as short as what can follow asks; None if none can."""
        now = so_far + role[:1]
        if not re.match(r"(s?(ua)*u?)\Z", now) or len(role) == 0:
            return None
        return "ua" if now.endswith("a") else now[-1]

    @functools.cache
    def best(i, so_far, inserted):
        found = []
        if i == n and LEGAL.match(so_far):
            found.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                now = stays(role, so_far)
                if now is not None:
                    cost, letters, out = best(i, now, inserted + 1)
                    found.append((cost + 5, "I" + letters, ((role, ""), *out)))
        if i < n:
            role, text, fault = rows[i]
            cost, letters, out = best(i + 1, so_far, 0)
            found.append((cost + 2, "D" + letters, out))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                for letter, to, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    now = stays(to, so_far)
                    if now is not None:
                        cost, letters, out = best(i + 1, now, 0)
                        found.append((cost + price + more, letter + letters, ((to, text), *out)))
        return min(found, key=lambda f: f[:2]) if found else (1 << 40, "", ())

    return best(0, "", 0)


def plain(turns):
    """The contract's columns for one conversation's turns after damage."""
    key = lambda t: hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()[:16]
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, key(t)))
    seen, rows, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
        seen.add((role, text))
        rows.append((role, text, fault))
        if fault:
            counts[fault] += 1
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, letters, out = cheapest(tuple(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, letters, digest), out


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        word = lambda v: " " if v is None else str(v)
        case = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(case, 1))
    return out


def check(spark, rows, hurt=True):
    df = spark.createDataFrame(rows, SCHEMA)
    given = R.damage(df) if hurt else df
    want = {c: plain(t) for c, t in (damaged(rows) if hurt else grouped(rows)).items()}
    solved = R.solve(given)
    got = {r["conv_id"]: tuple(r)[1:] for r in R.with_digest(given, solved).collect()}
    assert got == {c: w for c, (w, _) in want.items()}
    turns = {}
    for r in R.repaired(given, solved).orderBy("conv_id", "position").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns == {c: list(out) for c, (_, out) in want.items() if out}


def grouped(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in load(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = {c: plain(t)[0] for c, t in damaged(rows).items()}
    got = QUERIES["op11_turn_repair"](spark, DATA).collect()
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want


def some(n, seed, convs):
    pick = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "u", "A"]
    texts = ["Yes.", "No!", "why", "", " \t", None, "Well?  ", "x\x00", "é."]
    weights = [6, 6, 2, 1, 1, 1, 1, 1]
    return [
        (pick.choice(convs), pick.choice([None, *range(n // 2)]), pick.choices(roles, weights)[0], pick.choice(texts))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_nulls_ties_repeated_rows_and_odd_roles(spark, seed):
    check(spark, some(60, seed, [1, 2, 3, None, -5, 7, 8]))


def test_undamaged(spark):
    check(spark, some(50, 9, [1, 2, 3, 4, None]), hurt=False)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_a_conversation_over_many_ranges(spark, partitions):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check(spark, some(150, 5, [1] * 9 + [2, None]))
        texts = itertools.cycle(["Yes.", "No", "Ay."])
        check(spark, [(1, k, "user" if k % 90 < 70 else "assistant", f"{k} {next(texts)}") for k in range(180)])
        check(spark, [(1, 3, "user", "Yes.")] * 100 + [(2, 1, "user", "Yes.")])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_turns_left_and_empty_table(spark):
    gone = next(n for n in range(100) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "Hi.")])
    empty = spark.createDataFrame([], SCHEMA)
    assert R.with_digest(R.damage(empty), R.solve(R.damage(empty))).count() == 0


def test_long_runs_and_texts(spark):
    rows = [(1, k, "user", f"{k}.") for k in range(400)] + [(2, 0, "user", "a. " * 100_000), (2, 1, "assistant", "b" * 100_000)]
    solved = R.solve(spark.createDataFrame(rows, SCHEMA))
    found = {r["conv_id"]: r for r in solved.collect()}
    assert found[1]["cost"] == 200 and found[1]["audit"] == "KR" * 200
    assert found[2]["cost"] == 4 and found[2]["audit"] == "DD"


def test_runs_of_any_length_cost_what_single_turns_cost():
    for sym in range(16):
        for n in (1, 2, 3, 63, 64, 65, 200):
            step = R.END
            for _ in range(n):
                step = R.advance(sym, 1, step)
            assert R.advance(sym, n, R.END) == step
            for q in R.STATES:
                singles, state = "", q
                behind = [R.END]
                for _ in range(n - 1):
                    behind.append(R.advance(sym, 1, behind[-1]))
                for costs in reversed(behind):
                    part, state = R.unrolled(sym, 1, costs, state)
                    singles += part
                assert R.unrolled(sym, n, R.END, q) == (singles, state)


def test_other_columns_are_left_out(spark):
    rows = some(20, 3, [1, 2])
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["turn_key", "fault", "part", "audit", "summary", "is_row", "of", "cost"]
    extra = df.selectExpr("*", *(f"'x' AS {n}" for n in names))
    want = sorted(map(tuple, R.with_digest(df, R.solve(df)).collect()), key=str)
    assert sorted(map(tuple, R.with_digest(extra, R.solve(extra)).collect()), key=str) == want
