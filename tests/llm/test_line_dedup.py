"""Boilerplate lines against a plain count."""

import collections

import duckdb
import pyarrow as pa

from viewlens.llm import line_dedup
from viewlens.llm.oracle import ORACLE

SCHEMA = "doc_id bigint, source string, text string"
SPACE = " \t\x0b\x0c\r"


def plain(rows, ratio=0.05, min_pages=5):
    pages = {(s, t) for _, s, t in rows if t is not None}
    total, n = collections.Counter(s for s, _ in pages), collections.Counter()
    for s, t in pages:
        n.update((s, x) for x in {y.strip(SPACE) for y in t.split("\n")} if x)
    bad = {k for k, c in n.items() if c >= min_pages and c >= ratio * total[k[0]]}
    out = []
    for i, s, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if (s, x.strip(SPACE)) not in bad]
        if not any(x.strip(SPACE) for x in kept):
            kept = lines
        out.append((i, s, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_awkward_rows(spark):
    rows = [(k, "a", f"own {k}\n  menu\t\n\nmore {k % 3}") for k in range(60)]
    rows += [(k, "a", "copied page\nwith its lines") for k in range(100, 140)]  # one page, however often
    rows += [(200, "a", "menu"), (201, "a", None), (202, "a", ""), (203, None, "menu\nx"), (None, "b", "menu\ny\n")]
    rows += [(k, None, f"menu\nz{k}") for k in range(300, 305)] + [(7, "b", "\n".join(f"l{k}" for k in range(50_000)))]
    rows += [(k, "c", f"less common\n{k}" if k < 4 else f"{k}") for k in range(400, 480)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, line_dedup.drop_boilerplate(df).collect()), key=str) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "x", 5, "b")], SCHEMA + ", N_Lines int, host string")
    got = line_dedup.drop_boilerplate(df).collect()
    assert [r.asDict() for r in got] == [{"doc_id": 1, "source": "a", "text": "x", "host": "b", "n_lines": 1, "n_dropped": 0}]
    assert line_dedup.drop_boilerplate(df.limit(0)).collect() == []


def test_a_page_of_boilerplate_alone_is_cut_where_the_caller_says_so(spark):
    import corpus_pipeline

    rows = [(k, "a", f"own {k}\nmenu\nfooter") for k in range(20)] + [(50, "a", "menu\n footer\t"), (51, "a", None), (52, "a", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    strict = {r["doc_id"]: tuple(r)[2:] for r in line_dedup.drop_boilerplate(df, keep_whole=False).collect()}
    assert strict[50] == ("", 2, 2) and strict[0] == ("own 0", 3, 2)
    assert strict[51] == (None, 0, 0) and strict[52] == ("", 1, 0)
    sql = duckdb.connect()
    sql.register("documents", pa.Table.from_pylist([dict(zip(("doc_id", "source", "text"), r)) for r in rows]))
    assert {r[0]: r[2:] for r in sql.execute(ORACLE["op4_line_dedup"]).fetchall()} == strict
    staged = corpus_pipeline.without_boilerplate(spark, df.selectExpr("*", "length(text) AS n_chars"), "")
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in staged.collect()}[50] == ("", 0)
