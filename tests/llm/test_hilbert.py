"""The curve's defining property, and shards against a plain sort."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewlens.llm import hilbert, registry
from viewlens.llm.tables import load


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions))).T
    index = hilbert.curve_index(cells, bits)
    assert sorted(index) == list(range(1 << bits * dimensions))
    path = cells[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_query_equals_a_plain_sort_of_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = registry.op6_hilbert(spark, sf_dir).collect()
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    hashed = {r["doc_id"]: r["h"] for r in rows}
    assert {r["doc_id"] for r in got} == set(text) and len(got) == len(text)
    for r in got:
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
    ordered = sorted(got, key=lambda r: (r["hilbert"], r["text_crc32"], hashed[r["doc_id"]], r["doc_id"]))
    n = len(ordered)
    want = [k * 40 // n for k in range(n)]
    assert [r["shard"] for r in ordered] == want
    assert [r["slot"] for r in ordered] == [k - want.index(s) for k, s in enumerate(want)]


def test_few_rows_ties_nulls_and_clashing_columns(spark):
    rows = [(k % 3 if k else None, None if k % 2 else "x", 5) for k in range(11)]
    df = spark.createDataFrame(rows, "id int, lang string, slot int")
    cells = {"lang": hilbert.category_cell(F.col("lang")), "id": hilbert.size_cell(F.col("id"))}
    got = hilbert.assign(df, cells, [F.col("id")], shards=4)
    assert got.columns == ["id", "lang", "lang_cell", "id_cell", "hilbert", "shard", "slot"]
    by = {}
    for r in got.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, by.values())) == [2, 3, 3, 3]
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert hilbert.assign(df.limit(0), cells, [F.col("id")]).collect() == []


def test_manifest_rules_shards_out_and_loses_none(spark, tmp_path):
    df = spark.range(4000).select("id", F.col("id").cast("string").alias("name"))
    cells = {"id": (F.col("id") % 64).cast("int"), "name": (F.col("id") / 64).cast("int")}
    assigned = hilbert.assign(df, cells, [F.col("id")])
    hilbert.write_shards(assigned, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    found = {r["shard"] for r in hilbert.shards_for(hilbert.manifest(back), id=7).collect()}
    assert {r["shard"] for r in back.filter("id % 64 = 7").select("shard").distinct().collect()} <= found
    assert len(found) < 20
    assert back.count() == 4000
