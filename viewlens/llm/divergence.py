"""How far the words of a language's sources lie apart: counts over exactly the frequent terms.

A first pass counts the documents of each term and keeps those in enough of them. The kept terms go
into minimal perfect hashes, in shards, which are broadcast, as many terms at a time as a stated
bound allows. The second pass looks each task's terms up, checks them against the stored ones, and
adds to dense slots per language and source. From the slots come smoothed shares, the distances
between sources, and the terms that a source has more of than its language.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from viewlens.llm import perfect_hash
from viewlens.llm.tables import pieces, written

MIN_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a shard, on average; terms broadcast at a time; slots that a task holds before it passes
#: its counts on; entries of a dictionary likewise; sources in a block.
SHARD_TERMS, MAX_TERMS, HELD_SLOTS, HELD_TERMS, BLOCK = 4096, 500_000, 4 << 20, 1 << 18, 256
#: Bytes of a text split at once.
STRETCH = 1 << 20

#: A-Z to a-z; what is no letter among ASCII to a space.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded length."""
    folded, start = text.translate(FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + STRETCH)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def _step(df: DataFrame, step, columns: str, *args) -> DataFrame:
    schema = StructType.fromDDL(columns)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for row in step(batches, *args):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, str, bytes]]]:
    for batch in batches:
        for piece in pieces([batch], "text"):
            text = piece.column("text").cast(pa.binary()).to_pylist()
            yield list(zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), text))


# --- the kept terms -----------------------------------------------------------------------


def _documents(batches):
    found: dict[str, Counter] = defaultdict(Counter)

    def columns():
        sizes = [(lang, len(c)) for lang, c in found.items()]
        names = pa.array([t for c in found.values() for t in c], pa.binary()).cast(pa.string())
        return [lang for lang, n in sizes for _ in range(n)], names, [n for c in found.values() for n in c.values()]

    for rows in _texts(batches):
        for lang, _, text in rows:
            own: set[bytes] = set()
            for some in terms(text):
                own.update(some)
            found[lang].update(own)
        if sum(map(len, found.values())) > HELD_TERMS:
            yield columns()
            found.clear()
    if found:
        yield columns()


def kept_terms(texts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``lang`` and ``term`` of each term in at least so many of the language's documents."""
    counted = _step(texts, _documents, "lang string, term string, n bigint")
    total = counted.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    return total.filter(F.col("n") >= min_documents).select("lang", "term")


SHARD = "lang string, shard int, size int, displacements array<int>, terms array<string>, apart array<int>"


def _build(batches):
    for batch in batches:
        for lang, shard, stored in zip(*(c.to_pylist() for c in batch.columns)):
            moved, order, apart = perfect_hash.build([t.encode() for t in stored])
            yield [lang], [shard], [len(stored)], [moved], [[stored[i] for i in order]], [apart]


def shards(kept: DataFrame) -> DataFrame:
    """A perfect hash for each part of a language's terms, with ``shards``, their number."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_TERMS).cast("int").alias("shards"))
    place = F.shiftrightunsigned(F.xxhash64("term"), 40) % F.col("shards")
    dealt = kept.join(sizes, "lang").groupBy("lang", place.cast("int").alias("shard"))
    built = _step(dealt.agg(F.collect_list("term").alias("terms")), _build, SHARD)
    return built.join(sizes, "lang")


# --- counting into slots ------------------------------------------------------------------

COUNTS = "lang string, source string, shard int, size int, slots array<int>, counts array<bigint>"


def _recount(batches, table):
    by_lang = defaultdict(list)
    count = {}
    for lang, shard, moved, stored, apart, n in zip(*(table.value.column(c).to_pylist() for c in HASH)):
        by_lang[lang].append((shard, moved, [t.encode() for t in stored], apart))
        count[lang] = n
    hashes = {lang: perfect_hash.Shards(count[lang], rows) for lang, rows in by_lang.items()}
    held: dict[tuple[str, str], np.ndarray] = {}

    def rows():
        for (lang, source), counts in held.items():
            mine = hashes[lang]
            for shard in np.flatnonzero(mine.size).tolist():
                first, size = int(mine.first[shard]), int(mine.size[shard])
                own = counts[first : first + size]
                at = np.flatnonzero(own)
                if len(at):
                    yield [lang], [source], [shard], [size], [at], [own[at]]

    for some in _texts(batches):
        found: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for lang, source, text in some:
            if lang in hashes:
                for part in terms(text):
                    found[lang, source].update(part)
        for group, counter in found.items():
            mine = hashes[group[0]]
            place = mine.find(list(counter))
            n = np.fromiter(counter.values(), np.int64, len(counter))
            slots = held.setdefault(group, np.zeros(len(mine.terms), np.int64))
            slots[place[place >= 0]] += n[place >= 0]
        if sum(map(len, held.values())) > HELD_SLOTS:
            yield from rows()
            held.clear()
    yield from rows()


HASH = ["lang", "shard", "displacements", "terms", "apart", "shards"]


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(offsets, offsets[1:]))


def _merge(batches):
    """Sorted rows of counts to one dense row for each language, source and shard."""
    now, total = None, None
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "shard", "size")))
        for key, slots, counts in zip(keys, _lists(batch.column("slots")), _lists(batch.column("counts"))):
            if key != now:
                if now is not None:
                    yield *([v] for v in now), [np.arange(now[3])], [total]
                now, total = key, np.zeros(key[3], np.int64)
            total[slots] += counts
    if now is not None:
        yield *([v] for v in now), [np.arange(now[3])], [total]


def merged(counts: DataFrame) -> DataFrame:
    key = ["lang", "source", "shard"]
    return _step(counts.repartition(*key).sortWithinPartitions(*key), _merge, COUNTS)


def recount(texts: DataFrame, hashes: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """Occurrences of the kept terms by language, source and shard: a scan for each ``max_terms``."""
    spark = texts.sparkSession
    before = F.sum("size").over(Window.orderBy("lang", "shard").rowsBetween(Window.unboundedPreceding, -1))
    turns = hashes.select("lang", "shard", "size").withColumn("scan", F.floor(F.coalesce(before, F.lit(0)) / max_terms))
    turns = written(hashes.join(turns.drop("size"), ["lang", "shard"]), "hashes")
    scans = (turns.agg(F.max("scan")).first()[0] or 0) + 1
    found = None
    for k in range(scans):
        table = spark.sparkContext.broadcast(turns.filter(F.col("scan") == k).select(*HASH).toArrow())
        one = _step(texts, _recount, COUNTS, table)
        found = one if found is None else found.unionByName(one)
    return merged(found)


# --- shares and distances -----------------------------------------------------------------


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + SMOOTHING) / (n + SMOOTHING * v))``, by long division
    in three steps of a thousand, as ``SCALE`` times a count may not fit."""
    whole = max(n + SMOOTHING * v, 1)
    rest = counts + SMOOTHING if whole < 1 << 53 else counts.astype(object) + SMOOTHING
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return (out + 1).astype(np.int64)


def _foremost(batches, top):
    """For each source the terms of a shard whose share exceeds the language's most; the shard's
    terms and the language's counts come before its sources."""
    stored = q = order = None
    for batch in batches:
        names = ("lang", "source", "n", "v", "terms")
        for (lang, source, n, v, terms_), counts in zip(
            zip(*(batch.column(c).to_pylist() for c in names)), _lists(batch.column("counts"))
        ):
            if terms_ is not None:
                stored, q = terms_, shares(counts, n, v)
                order = np.empty(len(stored), np.int64)
                order[sorted(range(len(stored)), key=stored.__getitem__)] = np.arange(len(stored))
                continue
            more = shares(counts, n, v) - q
            at = np.flatnonzero((counts > 0) & (more > 0))
            at = at[np.lexsort((order[at], -more[at]))[:top]]
            if len(at):
                yield [lang] * len(at), [source] * len(at), [stored[i] for i in at], more[at]


def _distances(batches):
    for batch in batches:
        langs, groups = batch.column("lang").to_pylist(), batch.column("rows")
        for lang, start, end in zip(langs, groups.offsets.to_numpy(), groups.offsets.to_numpy()[1:]):
            rows = groups.values.slice(start, end - start)
            names, counts = rows.field("source").to_pylist(), rows.field("counts")
            block, other = rows.field("block").to_numpy(), rows.field("other").to_numpy()
            p = [
                shares(c.values.to_numpy(zero_copy_only=False) if c.is_valid else np.zeros(size, np.int64), n, v)
                for c, size, n, v in zip(counts, *(rows.field(f).to_pylist() for f in ("size", "n", "v")))
            ]
            p = np.array(p).reshape(len(names), -1)
            for i, name in enumerate(names):
                # within a block each pair once; between two, from the lower to the higher
                far = np.flatnonzero(block > block[i]) if block[i] < other[i] else np.arange(i + 1, len(names))
                if len(far) and block[i] <= other[i]:
                    apart = np.abs(p[far] - p[i]).sum(axis=1)
                    yield [lang] * len(far), [name] * len(far), [names[j] for j in far], apart


def _ranked(df: DataFrame, part: str) -> DataFrame:
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(place).alias("rank")
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def audit(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, max_terms: int = MAX_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` from ``text``, ``lang`` and
    ``source``.

    Part ``pair``: each other source of the language, by the sum over all kept terms of the
    differences between their shares. Part ``term``: the ``top`` kept terms that the source has and
    of which its share exceeds the language's, by how much. Ranks start at 1 with the largest value,
    equal ones by the item. Null texts, languages and sources are empty ones; repeated rows count
    each; a source without a kept term takes part with counts of zero, and in a language without any
    all distances are 0. An empty table gives none; other columns are left out, whatever their names.
    """
    texts = documents.select(*(_text(c) for c in ("lang", "source", "text")))
    kept = written(kept_terms(texts, min_documents), "terms")
    hashes = written(shards(kept), "shards")
    counts = written(recount(texts, hashes, max_terms), "counts")

    sums = counts.groupBy("lang", "source").agg(F.sum(_total()).alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sources = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    sources = written(sources.select("lang", "source", _number("n"), _number("v")), "sources")
    return _ranked(_pairs(sources, hashes, counts), "pair").unionByName(
        _ranked(_terms(sources, hashes, counts, top), "term").filter(F.col("rank") <= top)
    )


def _total() -> Column:
    return F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)


def _terms(sources: DataFrame, hashes: DataFrame, counts: DataFrame, top: int) -> DataFrame:
    of_lang = merged(counts.withColumn("source", F.lit("")))
    n = sources.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    stored = hashes.select("lang", "shard", "terms")
    heads = of_lang.join(stored, ["lang", "shard"]).join(n, "lang")
    rows = counts.join(sources, ["lang", "source"]).withColumn("terms", F.lit(None).cast("array<string>"))
    names = ["lang", "shard", "source", "n", "v", "counts", "terms"]
    both = rows.select(*names).unionByName(heads.select(*names))
    sorted_rows = both.repartition("lang", "shard").sortWithinPartitions("lang", "shard", F.col("terms").isNull())
    return _step(sorted_rows, _foremost, "lang string, source string, item string, value bigint", top)


def _pairs(sources: DataFrame, hashes: DataFrame, counts: DataFrame) -> DataFrame:
    """Distances of sources, shard by shard and block by block of at most about ``BLOCK`` sources."""
    blocks = sources.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    # a language without terms has one shard without slots
    sized = sources.select("lang").distinct().join(hashes.select("lang", "shard", "size"), "lang", "left")
    sized = sized.select("lang", F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("size", F.lit(0)).alias("size"))
    dense = sources.join(blocks, "lang").withColumn("block", block).join(sized, "lang")
    dense = dense.join(counts.drop("size", "slots"), ["lang", "source", "shard"], "left")
    dense = dense.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row = F.struct("block", "other", "source", "n", "v", "size", "counts")
    grouped = dense.groupBy("lang", "shard", F.least("block", "other"), F.greatest("block", "other"))
    grouped = grouped.agg(F.collect_list(row).alias("rows")).select("lang", "rows")
    parts = _step(grouped, _distances, "lang string, a string, b string, value bigint")
    # which of two comes first differs between shards
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    far = parts.groupBy("lang", *ends).agg(F.sum("value").alias("value"))
    side = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    sides = F.explode(F.array(side("a", "b"), side("b", "a")))
    return far.select("lang", sides.alias("side"), "value").select("lang", "side.*", "value")
