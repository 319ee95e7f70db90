"""Quality rules: counts of words, symbols and repetitions, and perplexity bands.

Texts that pass the base rules are judged by the perplexity that their language's character model
gives them. The model counts every text that reads as prose, which is to say one with few symbols
for its length: a model that had counted the junk too would expect it. The band of a language lies around the median of the logarithms, as wide on either
side as so many median deviations, and never narrower than a fixed ratio. Short texts scatter
more, so both the deviations and the band are in units that widen as a text gets shorter. The band
is taken over distinct scores: copies of one text count once, however many there are.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.llm import kneser_ney as K
from viewlens.llm.tables import appended, clear_of, pieces, settled, without, written
from viewlens.llm.words import stretches, words

MIN_WORDS, WINDOW_WORDS, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
#: A text that the model counts has a symbol in so many characters at most.
CHARS_PER_SYMBOL = 50
#: Half-widths of the band in median deviations, and the least, as a difference of logarithms.
LOWER_DEVIATIONS, UPPER_DEVIATIONS, LEAST_WIDTH = 5.0, 5.0, 0.05
#: A text of so many symbols scatters by the root of two times as much as a very long one.
SHORT_SYMBOLS = 1000
FEATURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
SCORES = "sum_log_p double, n_scored bigint"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "perplexity", "base_failed", "kept")
_BASE = np.uint64(0x9E3779B97F4A7C15)


# --- base rules ---------------------------------------------------------------------------


def repeated_words(ids: np.ndarray, window: int) -> int:
    """Words inside windows found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    hashed = np.zeros(n, np.uint64)
    for k in range(window):
        hashed = hashed * _BASE + ids[k : k + n].astype(np.uint64)
    order = np.argsort(hashed, kind="stable")
    twin = np.flatnonzero(hashed[order[1:]] == hashed[order[:-1]])
    if not len(twin):
        return 0
    one, two = order[twin], order[twin + 1]
    if any((ids[one + k] != ids[two + k]).any() for k in range(window)):  # unequal words, equal hashes
        seen: dict[bytes, list[int]] = {}
        for k in range(n):
            seen.setdefault(ids[k : k + window].tobytes(), []).append(k)
        one = two = np.array([k for at in seen.values() if len(at) > 1 for k in at], np.int64)
    covered = np.zeros(len(ids) + 1, np.int64)
    starts = np.unique(np.concatenate((one, two)))
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def features(text: str) -> tuple[int, int, int, int, int]:
    number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    ids = [np.array([number[w] for w in words(s)], np.int64) for s in stretches(text)]
    flat = np.concatenate([*ids, np.empty(0, np.int64)])
    spaces = sum(map(text.count, " \t\n\x0b\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\f\r")]
    return (
        len(flat),
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(flat, WINDOW_WORDS),
    )


def feature_batches(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    names = ADDED[:5]
    for batch in pieces(batches, text_col):
        rows = [features(t or "") for t in batch.column(text_col).to_pylist()]
        yield appended(batch, **{n: pa.array(x, pa.int64()) for n, x in zip(names, zip(*rows))})


# --- perplexity ---------------------------------------------------------------------------


def score_batches(
    batches: Iterator[pa.RecordBatch], text_col: str, lang_col: str, model, whole: bool = True
) -> Iterator[pa.RecordBatch]:
    """Adds ``SCORES``. Of a model that isn't ``whole`` in memory each batch reads every part once."""
    for batch in pieces(batches, text_col) if whole else batches:
        texts = [t or "" for t in batch.column(text_col).to_pylist()]
        langs = [x or "" for x in batch.column(lang_col).to_pylist()]
        found = K.scores(texts, langs, model, K.ORDER, K.JOINED if whole else K.JOINED_LARGE)
        yield appended(
            batch,
            sum_log_p=pa.array([x for x, _ in found], pa.float64()),
            n_scored=pa.array([n for _, n in found], pa.int64()),
        )


def scored(df: DataFrame, model: DataFrame, text_col: str, lang_col: str, max_entries: int) -> DataFrame:
    """``df`` with ``SCORES`` and ``FEATURES``, in one pass over the texts, which stay where they
    are. The model comes to them in parts; a process holds ``max_entries`` of it, and reads parts
    again where that isn't all."""
    parts, whole = K.broadcast_parts(model, max_entries)
    added = f"{SCORES}, {FEATURES}"
    declared = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added])
    return df.mapInArrow(
        lambda batches: feature_batches(score_batches(batches, text_col, lang_col, parts, whole), text_col), declared
    )


def reads_as_prose(text: Column) -> Column:
    """Whether the model counts a text; an empty one holds nothing to count."""
    n_symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return CHARS_PER_SYMBOL * n_symbols <= F.length(text)


def _scatter(n_scored: Column) -> Column:
    return F.sqrt(1 + SHORT_SYMBOLS / n_scored)


def bands(judged: DataFrame) -> DataFrame:
    """(lang, middle, below, above) over distinct rows (lang, log_perplexity, n_scored): the band's
    middle, and how far it reaches to either side in units of ``_scatter``. Medians are those of
    thousandths, so that their tables stay small whatever the number of texts."""
    rows = written(judged.distinct(), "scores")
    steps = rows.withColumn("step", F.round(F.col("log_perplexity") * 1000).cast("bigint"))
    middle = K.weighted_median(steps.groupBy("lang", "step").agg(F.count("*").alias("n")), "lang", "step", "n")
    middle = written(middle.select("lang", (F.col("median") / 1000).alias("middle")), "middle")
    apart = F.abs(F.col("log_perplexity") - F.col("middle")) / _scatter(F.col("n_scored"))
    steps = rows.join(middle, "lang").withColumn("step", F.round(apart * 1000).cast("bigint"))
    spread = K.weighted_median(steps.groupBy("lang", "step").agg(F.count("*").alias("n")), "lang", "step", "n")
    width = lambda k: F.greatest(F.col("median") / 1000 * 1.4826 * k, F.lit(LEAST_WIDTH))
    return middle.join(spread, "lang").select(
        "lang", "middle", width(LOWER_DEVIATIONS).alias("below"), width(UPPER_DEVIATIONS).alias("above")
    )


@clear_of("_lang", "middle", "below", "above", "sum_log_p", "n_scored")
def judge(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    keep_text: bool = True,
    max_entries: int = K.MAX_ENTRIES,
) -> DataFrame:
    """``df`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``perplexity`` (null without words), ``base_failed`` and ``kept``. Columns
    of these names are replaced; others stay, whatever their names.

    A null or empty text has no words and fails. A null language is a language of its own; one
    without a text that reads as prose has no model, gives all its texts one perplexity, and keeps
    those that pass the base rules. Rows are judged one by one, so repeated rows and null ids stay
    as they are; what all rows share is the model and the bands.
    """
    df = without(df, *ADDED)
    texts = df.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))

    def score() -> DataFrame:
        model = K.train(texts.filter(reads_as_prose(F.col("text"))))
        rows = scored(df, model, text_col, lang_col, max_entries)
        return rows if keep_text else rows.drop(text_col)

    rows = settled(score, "scored")
    lang = F.coalesce(F.col(lang_col), F.lit("")).alias("lang")
    log_perplexity = -F.col("sum_log_p") / F.col("n_scored")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    passed = rows.filter(~failed).select(lang, log_perplexity.alias("log_perplexity"), "n_scored")
    limits = settled(lambda: bands(passed), "bands").withColumnRenamed("lang", "_lang")
    off = (log_perplexity - F.col("middle")) / _scatter(F.col("n_scored"))
    inside = F.when(F.col("n_scored") > 0, off.between(-F.col("below"), F.col("above")))
    judged = rows.join(limits, F.coalesce(F.col(lang_col), F.lit("")) == F.col("_lang"), "left")
    return judged.select(
        *(f"`{c}`" for c in rows.columns if c not in ("sum_log_p", "n_scored")),
        F.when(F.col("n_scored") > 0, F.exp(log_perplexity)).alias("perplexity"),
        failed.alias("base_failed"),
        (~failed & F.coalesce(inside, F.lit(False))).alias("kept"),
    )
