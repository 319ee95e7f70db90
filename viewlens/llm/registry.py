"""The corpus operators with production parameters, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlens.llm import (
    bpe,
    chat_format,
    decontaminate,
    divergence,
    hilbert,
    line_dedup,
    main_text,
    quality,
    secrets,
    simhash,
    token_counts,
    turn_repair,
    warc,
)
from viewlens.llm.oracle import ORACLE as ORACLE
from viewlens.llm.tables import load
from viewlens.session import new_run_dir

#: The vocabulary file; installed with its package on every machine.
MODEL = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 2048


def _joined_sha256(values: Column) -> Column:
    return F.sha2(F.array_join(values, ","), 256)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(
        load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark")
    )
    n_hit = decontaminate.hit_words(F.col("hits"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        _joined_sha256(F.col("items")).alias("items_sha256"),
        decontaminate.is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_run_dir(spark, "warc")
    pages = load(spark, sf_dir, "pages")
    warc.write_records(pages, path, "page_id", "html", "url")
    found = warc.read_records(spark.read.parquet(path))
    kind = pages.schema["page_id"].dataType
    return found.select(
        F.col("id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judge(documents, keep_text=False).drop("lang")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(documents, keep_whole=False)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(load(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda *kinds: F.size(secrets.of_kind(F.col("secrets"), *kinds)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.as_text(secrets.of_kind(F.col("secrets"), 0, 1, 2)), 256).alias("base_sha256"),
        secrets.as_text(F.col("secrets")).alias("spans"),
    )


def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    documents = load(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(text) + F.lit(16).cast("bigint")).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    dimensions = {
        "lang": hilbert.category_cell(F.col("lang")),
        "source": hilbert.category_cell(F.col("source")),
        "size": hilbert.size_cell(F.col("size")),
    }
    # equal texts of one cell stand side by side
    order = [F.col(c) for c in ("text_crc32", "text_hash", "doc_id")]
    return hilbert.assign(documents, dimensions, order).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = main_text.extract(pages).withColumnRenamed("main_text", "text")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes")
    return token_counts.count_tokens(documents, MODEL).select(
        "doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "n_splices", "n_widened"
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(load(spark, sf_dir, "documents"), MODEL, "text", ["doc_id"])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_repair.damage(load(spark, sf_dir, "conversations"))
    return turn_repair.with_digest(rows, turn_repair.solve(rows))


#: One more conversation, whose texts are made of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    rows = rows.unionByName(spark.createDataFrame(more, rows.schema))
    return chat_format.read_back(chat_format.segments(rows), in_order=True)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_secrets": op5_secrets,
    "op6_hilbert": op6_hilbert,
    "op7_main_text": op7_main_text,
    "op8_token_counts": op8_token_counts,
    "op9_bpe": op9_bpe,
    "op10_simhash": op10_simhash,
    "op11_turn_repair": op11_turn_repair,
    "op12_chat_format": op12_chat_format,
    "op13_divergence": op13_divergence,
}
