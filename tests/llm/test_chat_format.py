"""Formatting and reading back: round trips, and the query against the table's own rows."""

import hashlib
import random

import pytest
from support import DATA

from viewlens.llm import chat_format as C
from viewlens.llm.registry import CONTROL_TEXT, QUERIES
from viewlens.llm.tables import load

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """What has to come back, from the rows alone."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = {}
    for conv, turns in by.items():
        turns = [(r.decode(), t.decode()) for _, _, r, t in sorted(turns)]
        learnt = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt))
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:5] for r in df.collect()}


def test_query_reads_back_every_conversation(spark):
    rows = [tuple(r) for r in load(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    found = QUERIES["op12_chat_format"](spark, DATA)
    assert got(found) == plain(rows) and found.count() == len({r[0] for r in rows})
    (own,) = found.filter("conv_id = -1").collect()
    assert own["loss_chars"] == len(CONTROL_TEXT) and own["valid"]
    marks = len("<s>[INST]" "[/INST]" "<<SAY>>" "</s>")
    assert own["formatted_chars"] == marks + 2 * (len(CONTROL_TEXT) + 3)


PARTS = [*C.INSTRUCT.control, "\\", "\\\\", "<", ">", "/s>", "[", "INST]", "x", "\n", " ", " ", "é", "😀", "\x00"]


@pytest.mark.parametrize("seed", range(3))
def test_any_text_and_role_comes_back(spark, seed):
    pick = random.Random(seed)
    text = lambda: pick.choice([None, "", "".join(pick.choices(PARTS, k=pick.randrange(12)))])
    role = lambda: pick.choice(["user", "assistant", "system", None, "", "tool", text()])
    rows = [(pick.choice([1, 2, 3, None, -9]), pick.choice([None, 1, 2, 3]), role(), text()) for _ in range(200)]
    segments = C.segments(spark.createDataFrame(rows, SCHEMA))
    assert got(C.read_back(segments, in_order=True)) == plain(rows)
    assert got(C.read_back(segments.repartition(5))) == plain(rows)


def test_escaped_text_holds_no_control_string():
    pick = random.Random(1)
    for _ in range(2000):
        text = "".join(pick.choices(PARTS, k=8))
        hidden = C.INSTRUCT.escaped(text)
        assert not C.INSTRUCT.marks.search(hidden)
        assert C.INSTRUCT.unescaped(hidden) == text


def test_turn_order(spark):
    def judged(*roles):
        rows = [(1, k, r, "x") for k, r in enumerate(roles)]
        (row,) = C.read_back(C.segments(spark.createDataFrame(rows, SCHEMA))).collect()
        return row["valid"], row["first_illegal"]

    assert judged("system", "user", "assistant", "user", "assistant") == (True, None)
    assert judged("user", "assistant") == (True, None)
    assert judged("user") == (False, None)
    assert judged("user", "user", "assistant") == (False, 1)
    assert judged("assistant") == (False, 0)
    assert judged("user", "assistant", "system", "user", "assistant") == (False, 2)
    assert judged("user", "tool", "assistant") == (False, 1)


def test_loss_covers_answers_only(spark):
    rows = [(1, 0, "user", "a<s>b"), (1, 1, "assistant", "c\\d</s>"), (1, 2, "assistant", ""), (1, 3, "critic", "no")]
    segments = C.segments(spark.createDataFrame(rows, SCHEMA))
    loss = [r["text"] for r in segments.orderBy("segment").collect() if r["loss"]]
    assert [C.INSTRUCT.unescaped(t) for t in loss] == ["c\\d</s>", ""]
    (whole,) = C.as_text(segments).collect()
    assert [whole["text"][s["first"] : s["end"]] for s in whole["loss_spans"]] == loss
    assert list(C.Reader(C.INSTRUCT).feed(whole["text"])) == [(r, t) for _, _, r, t in rows]


def test_repeated_rows_long_texts_other_columns_and_no_rows(spark):
    rows = [(1, 0, "user", "Yes.")] * 3 + [(1, 1, "assistant", "</s>\\" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.selectExpr("*", "'x' AS segment", "1 AS loss", "2 AS state", "3 AS n_turns")
    assert got(C.read_back(C.segments(extra), in_order=True)) == plain(rows)
    assert C.read_back(C.segments(df.limit(0))).count() == 0


def test_foreign_text_is_an_error():
    for bad in ("hello", "<s>[INST]a", "[/INST]x", "<s>[INST]a</s>", "<<ROLE>>a<</ROLE>>"):
        with pytest.raises(ValueError):
            reader = C.Reader(C.INSTRUCT)
            list(reader.feed(bad))
            reader.end()


def test_another_template(spark):
    tagged = C.Template(
        control=("<|turn|>", "<|end|>", "<|is|>"),
        pieces={},
        other=C.Piece("<|turn|>", "<|end|>", loss=True),
        named="<|is|>",
        start="any",
        moves={"any": {"a": "any", "b": "any"}},
        after={},
        ends=frozenset({"any"}),
        escape="%",
    )
    rows = [(1, 0, "a", "50% <|end|>"), (1, 1, "b", "%")]
    (row,) = C.read_back(C.segments(spark.createDataFrame(rows, SCHEMA), tagged), tagged).collect()
    assert row["turns_sha256"] == plain(rows)[1][1] and row["valid"] and row["loss_chars"] == 12
