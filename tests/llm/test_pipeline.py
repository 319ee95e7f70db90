"""The stages, each against a plain account of what it keeps, and the whole run."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_near_copies import plain
from tokenizers import Tokenizer

import corpus_pipeline
from viewlens.llm import decontaminate, line_dedup, quality
from viewlens.llm.tables import load

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before each stage, and the last one's result."""
    docs = [load(spark, SF_DIR, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs[-1], SF_DIR)
        docs.append(spark.createDataFrame(out.collect(), out.schema))
    return docs


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_all_but_the_last_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for docs in stages[1:-1]:
        assert docs.schema == stages[0].schema


def test_decisions_take_effect(spark, stages):
    first, good, cut, single, clean, _ = stages
    assert ids(good) == ids(quality.judge(first).filter("kept")) != ids(first)
    assert ids(cut) == ids(good)
    dropped = line_dedup.drop_boilerplate(good).filter("n_dropped > 0")
    assert {r["doc_id"] for r in cut.join(good.select("doc_id", F.col("text").alias("old")), "doc_id").filter("text <> old").collect()} == set(ids(dropped))
    assert cut.filter("n_chars <> length(text)").count() == 0
    alone, _ = plain([(r["doc_id"], r["text"]) for r in cut.collect()])
    assert ids(single) == [doc_id for doc_id, _ in alone] != ids(cut)
    found = decontaminate.find_benchmark(single, load(spark, SF_DIR, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("hits"))
    bad = found.filter(decontaminate.is_contaminated(n_hit, F.col("n_words")))
    assert ids(clean) == sorted(set(ids(single)) - set(ids(bad)))
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in clean.collect())


def test_run_returns_the_library_s_digests(spark, stages):
    clean = {r["doc_id"]: r["text"] for r in stages[-2].collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(clean)
    for r in got:
        own = library.encode(clean[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(own, skip_special_tokens=False)
        assert r["n_tokens"] == len(own)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in own)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_awkward_documents_pass_through(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "x", None, None, 1), (2, "word " * 300, "en", "a", 1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SF_DIR).collect() == []
