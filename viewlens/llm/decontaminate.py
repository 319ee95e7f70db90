"""Benchmark decontamination: find benchmark passages in texts and remove them.

Words are runs of ``[0-9a-z]`` and of anything beyond ASCII, after A-Z became lower case. A
window is 13 consecutive words of an item; an item of fewer words, but not none, is one window.
A word of a text inside any occurrence of a window is hit.

The normalised windows go to the executors as a hash set: sorted 64-bit hashes, broadcast. Each
task numbers its words by the windows' vocabulary, rolls the hash over them, looks up the
positions where every word is known, and verifies each find word by word. A set is broadcast
only up to ``max_windows`` windows; more windows are dealt by hash into several sets, the texts
are scanned once for each, and the finds are joined by the text's SHA-256.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.llm.tables import appended, free, pieces, without, written

WINDOW_WORDS = 13
#: Windows in one broadcast set: at about 150 bytes each, 75 MB on the driver at most.
MAX_WINDOWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = "n_words bigint, hits array<struct<first:int,last:int>>, items array<string>"
_FOLD = str.maketrans(UPPER, LOWER)
_WORD = re.compile(WORD)
#: Characters read at a time from one text.
_STRETCH = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (item, window): words joined by a space, with their number."""
    words = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
        words_of(F.col(text_col)).alias("words"),
    ).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    parts = F.transform(starts, lambda i: F.array_join(F.slice("words", i, window), " "))
    return words.select(
        "item", F.least(F.size("words"), F.lit(window)).alias("size"), F.explode(parts).alias("window")
    ).distinct()


@dataclass
class WindowSet:
    """Windows of one length, by their hash; equal hashes stand side by side."""

    hashes: np.ndarray
    words: np.ndarray
    items: list[list[str]]

    def finds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``ids`` where a window begins, and which one."""
        size = self.words.shape[1]
        if len(ids) < size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        at = np.flatnonzero(unknown[size:] == unknown[:-size])
        hashes = np.zeros(len(at), np.uint64)
        for k in range(size):
            hashes = hashes * _BASE + ids[at + k].astype(np.uint64)
        which = np.searchsorted(self.hashes, hashes)
        positions, windows = [], []
        while len(at):
            same = which < len(self.hashes)
            same[same] = self.hashes[which[same]] == hashes[same]
            at, hashes, which = at[same], hashes[same], which[same]
            true = (ids[at[:, None] + np.arange(size)] == self.words[which]).all(axis=1)
            positions.append(at[true])
            windows.append(which[true])
            which = which + 1
        return np.concatenate([*positions, np.empty(0, np.int64)]), np.concatenate(
            [*windows, np.empty(0, np.int64)]
        )


def window_sets(rows: list[tuple[str, int, str]]) -> tuple[dict[str, int], list[WindowSet]]:
    """The vocabulary of (item, size, window) rows, and a set for each size."""
    vocabulary: dict[str, int] = {}
    owners: dict[int, dict[str, list[str]]] = {}
    for item, size, window in rows:
        for word in window.split(" "):
            vocabulary.setdefault(word, len(vocabulary) + 1)
        owners.setdefault(size, {}).setdefault(window, []).append(item)
    sets = []
    for _, of in sorted(owners.items()):
        words = np.array([[vocabulary[x] for x in w.split(" ")] for w in of], np.int32)
        hashes = np.zeros(len(words), np.uint64)
        for column in words.T:
            hashes = hashes * _BASE + column.astype(np.uint64)
        order = np.argsort(hashes, kind="stable")
        items = list(of.values())
        sets.append(WindowSet(hashes[order], words[order], [items[i] for i in order]))
    return vocabulary, sets


def stretches(text: str) -> Iterator[str]:
    """``text`` lower-cased, in stretches that cut no word unless it is longer than one."""
    start = 0
    while start < len(text):
        end = min(len(text), start + _STRETCH)
        while end < len(text) and _WORD.match(text[end - 1].translate(_FOLD)) and _WORD.match(text[end].translate(_FOLD)):
            end += 1
        yield text[start:end].translate(_FOLD)
        start = end


def numbered(text: str, vocabulary: dict[str, int]) -> np.ndarray:
    """The vocabulary's number of each word, 0 if it has none."""
    number = vocabulary.get
    parts = [
        np.array([number(w, 0) for w in _WORD.findall(stretch)], np.int32) for stretch in stretches(text)
    ]
    return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.empty(0, np.int32)])


def runs(covered: np.ndarray) -> list[dict[str, int]]:
    edges = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return [
        {"first": int(a), "last": int(b) - 1}
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))
    ]


def scan_batches(batches: Iterator[pa.RecordBatch], text_col: str, index) -> Iterator[pa.RecordBatch]:
    """Adds ``FIELDS`` to each row."""
    vocabulary, sets = index.value
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for batch in pieces(batches, text_col):
        ids = [numbered(t or "", vocabulary) for t in batch.column(text_col).to_pylist()]
        # one array for all texts; the zeros between them keep windows from reaching across
        starts = np.cumsum([0, *(len(x) + 1 for x in ids)])
        flat = np.zeros(starts[-1], np.int32)
        for x, start in zip(ids, starts):
            flat[start : start + len(x)] = x
        covered = np.zeros(len(flat), bool)
        items: list[set[str]] = [set() for _ in ids]
        for windows in sets:
            at, which = windows.finds(flat)
            for k in range(windows.words.shape[1]):
                covered[at + k] = True
            rows = np.searchsorted(starts, at, side="right") - 1
            for row, w in set(zip(rows.tolist(), which.tolist())):
                items[row].update(windows.items[w])
        hits = [
            runs(covered[start : start + len(x)]) if found else []
            for x, start, found in zip(ids, starts, items)
        ]
        yield appended(
            batch,
            n_words=pa.array([len(x) for x in ids], pa.int64()),
            hits=pa.array(hits, kind),
            items=pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        )


def scan(texts: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """``texts`` with ``FIELDS``, against windows few enough to broadcast."""
    spark = texts.sparkSession
    rows = [(r["item"], r["size"], r["window"]) for r in windows.collect()]
    index = spark.sparkContext.broadcast(window_sets(rows))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema), FIELDS])
    return texts.mapInArrow(lambda batches: scan_batches(batches, text_col, index), schema)


def find_benchmark(
    texts: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Each row of ``texts`` with ``n_words``, ``hits`` (runs of hit words, first and last word
    number) and ``items`` (ids of the items found, sorted as text).

    A null or empty text has no words and no hits. Rows are judged one by one, so repeated rows
    and repeated or null ids stay as they are. Items that share an id count as one; a null id is
    the item ``null``. Items without words have no window. Columns of ``texts`` named as an
    added one are replaced.
    """
    texts = without(texts, "n_words", "hits", "items")
    windows = written(benchmark_windows(items, item_id, item_text, window), "windows")
    sets = math.ceil(windows.count() / max_windows)
    if sets <= 1:
        return scan(texts, windows, text_col)
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    distinct = texts.select(key.alias("text_key"), F.col(text_col).alias("text")).dropDuplicates(["text_key"])
    distinct = written(distinct, "texts")
    found = None
    for k in range(sets):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(sets)) == k)
        one = written(scan(distinct, part, "text").drop("text"), "finds")
        found = one if found is None else found.unionByName(one)
    covered = F.flatten(F.collect_list(F.transform("hits", lambda h: F.sequence(h["first"], h["last"]))))
    (own,) = free(texts, "_key")
    merged = found.groupBy("text_key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(covered))).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # a run begins where the word before is not hit, and ends where the word after is not
    firsts = F.array_except("at", F.transform("at", lambda x: x + 1))
    lasts = F.array_except("at", F.transform("at", lambda x: x - 1))
    hits = F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    merged = merged.select(F.col("text_key").alias(own), "n_words", hits.alias("hits"), "items")
    return texts.withColumn(own, key).join(merged, own).drop(own)


def hit_words(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda n, h: n + (h["last"] - h["first"] + 1))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(found: DataFrame) -> DataFrame:
    """What ``find_benchmark`` returned, without the contaminated rows and the added columns."""
    n_hit = hit_words(F.col("hits"))
    return found.filter(~is_contaminated(n_hit, F.col("n_words"))).drop("n_words", "hits", "items")


def cut_batches(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text_col).to_pylist()
        for row, hits in enumerate(batch.column("hits").to_pylist()):
            if not hits:
                continue
            text, kept, end = texts[row], [], 0
            first, last = {h["first"] for h in hits}, {h["last"] for h in hits}
            for n, word in enumerate(_WORD.finditer(text.translate(_FOLD))):
                if n in first:
                    kept.append(text[end : word.start()])
                if n in last:
                    end = word.end()
            texts[row] = "".join([*kept, text[end:]])
        at = batch.schema.get_field_index(text_col)
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))


def cut_hits(found: DataFrame, text_col: str = "text") -> DataFrame:
    """What ``find_benchmark`` returned, with the hit words and what stands between hit words of
    one run cut from the texts, and without the added columns."""
    return found.mapInArrow(lambda batches: cut_batches(batches, text_col), found.schema).drop(
        "n_words", "hits", "items"
    )
