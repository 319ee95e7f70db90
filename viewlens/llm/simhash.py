"""SimHash near-duplicates, linked through BK-trees.

A text's fingerprint has a bit set if over half of its shingles' hashes have it set. Texts whose
fingerprints differ in ``radius`` bits or fewer are linked, and linked texts form groups.

Only distinct fingerprints are compared. The 64 bits are cut into blocks. Two fingerprints that
differ in at most ``radius`` bits agree on all but ``radius`` of the blocks, so each fingerprint
goes to one shard for every choice of that many agreeing blocks, and no link can be lost. More
blocks make smaller shards and more of them; their number follows that of the fingerprints. Each
shard is a BK-tree, and its fingerprints are its queries. A tree isn't sent to all tasks, but only
where queries need it: a shard beyond ``max_shard`` is cut into parts, and each part's tree meets
every part's queries, two parts to a cell, so that no task holds an unbounded group. What leaves a
cell is a spanning tree of what it has linked, never all pairs; the groups of the whole follow by
joins over those links.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.llm.bktree import Forest, Groups
from viewlens.llm.tables import appended, pieces, settled, without, written
from viewlens.llm.words import stretches

BITS, SEED = 64, 42
SHINGLE_WORDS, RADIUS = 4, 4
#: Fingerprints in a shard: as many as blocks are chosen for, and the most that one cell takes.
MEAN_SHARD, MAX_SHARD = 1024, 16384
CELL = ["choice", "bits", "part", "other"]


# --- fingerprints -------------------------------------------------------------------------


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, stretch by stretch; of all words if there are fewer."""
    carried: list[bytes] = []
    any_yet, digest = False, xxhash.xxh64_intdigest
    for stretch in stretches(text):
        # lower() on bytes knows only ASCII's letters
        words = carried + stretch.encode().lower().split()
        carried = words[max(0, len(words) - shingle + 1) :]
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
            any_yet = True
            yield np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    if carried and not any_yet:
        yield np.array([digest(b" ".join(carried), SEED)], np.uint64)


def fingerprint(text: str, shingle: int) -> int:
    total, ones = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text, shingle):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprint_batches(batches: Iterator[pa.RecordBatch], text_col: str, shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, text_col):
        found = [fingerprint(t or "", shingle) for t in batch.column(text_col).to_pylist()]
        kept = batch.drop_columns([text_col])
        yield appended(kept, fingerprint=pa.array(found, pa.int64()))


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` with ``fingerprint`` (the 64 bits as a signed number) instead of the text. A null
    text has no words; without words the fingerprint is 0. A column named ``fingerprint`` is
    replaced."""
    df = without(df, "fingerprint")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col]
    return df.mapInArrow(
        lambda batches: fingerprint_batches(batches, text_col, shingle), ", ".join([*kept, "fingerprint bigint"])
    )


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# --- links --------------------------------------------------------------------------------


def block_masks(fingerprints: int, radius: int, mean_shard: int) -> list[int]:
    """For every choice of agreeing blocks, the bits they cover."""
    blocks = radius + 1
    while blocks < 2 * radius + 4 and fingerprints >> (BITS * (blocks - radius) // blocks) > mean_shard:
        blocks += 1
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    return [sum(chosen) for chosen in itertools.combinations(masks, blocks - radius)]


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def shards(distinct: DataFrame, masks: list[int], max_shard: int) -> DataFrame:
    """Rows (choice, bits, part, other, side, fingerprint): cells by their first four columns.
    Fingerprints of side 0 are in the cell's tree; all of them, or those of side 1 if there are
    any, are its queries."""
    choice = F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(_signed(m))) for m in masks)))
    rows = distinct.select("fingerprint", choice.alias("choice", "bits"))
    return dealt(rows, ["choice", "bits"], F.ceil(F.count("*") / max_shard), F.xxhash64("fingerprint"), ["fingerprint"])


def dealt(rows: DataFrame, keys: list[str], parts: Column, by: Column, carried: list[str]) -> DataFrame:
    """Rows (keys, part, other, side, carried) of the cells of each key. A key's rows are cut into
    so many ``parts`` (an aggregate) by the hash ``by``, and every two parts meet in a cell."""
    sizes = rows.groupBy(*keys).agg(parts.cast("int").alias("parts")).filter("parts > 1")
    many = written(sizes, "shards")
    many = F.broadcast(many) if many.count() <= 10_000 else many
    rows = rows.join(many, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(by, F.col("parts")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct(
            F.least(k, F.col("own")).alias("part"),
            F.greatest(k, F.col("own")).alias("other"),
            (F.col("own") > k).cast("int").alias("side"),
        ),
    )
    return rows.withColumn("own", part).select(*keys, F.inline(cells), *carried)


def linked(
    cells: np.ndarray,
    side: np.ndarray,
    values: np.ndarray,
    radius: int,
    names: np.ndarray | None = None,
    near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, or their ``names``, and the one each hangs on, so that what the cells link
    stays linked. Of the pairs within the radius those count that ``near`` says are near.
    Fingerprints of several columns are searched by a tree of each."""
    tree = np.cumsum(np.diff(cells, prepend=cells[:1]) != 0)
    groups = Groups(len(values))
    inside = np.flatnonzero(side == 0)
    crossing = np.bincount(tree, weights=side) > 0
    queries = np.flatnonzero((side == 1) | ~crossing[tree])
    # a cell of two parts may lack the first: then it has no tree to search
    has = np.zeros(tree[-1] + 1, bool)
    has[tree[inside]] = True
    queries = queries[has[tree[queries]]]
    for column in values.T if values.ndim > 1 else [values]:
        forest = Forest(column[inside], tree[inside])
        place = np.searchsorted(tree[inside][forest.roots], tree)
        for query, node in forest.near(column[queries], place[queries], radius):
            a, b = queries[query], inside[node]
            if near is not None:
                true = near(a, b)
                a, b = a[true], b[true]
            groups.unite(a, b)
    names = values if names is None else names
    hangs = np.flatnonzero(groups.root != np.arange(len(values)))
    return names[hangs], names[groups.root[hangs]]


def whole_cells(batches: Iterator[pa.RecordBatch], cell: list[str]) -> Iterator[pa.Table]:
    """Tables of whole cells. A cell that goes on in the next batch waits for it."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in cell]
        others = np.flatnonzero(np.any([x != x[-1] for x in columns], axis=0))
        if waiting and any(x[0] != waiting[-1].column(c)[-1].as_py() for c, x in zip(cell, columns)):
            yield pa.Table.from_batches(waiting)
            waiting = []
        waiting.append(batch)
        if len(others):
            cut = int(others[-1]) + 1
            yield pa.Table.from_batches([*waiting[:-1], batch.slice(0, cut)])
            waiting = [batch.slice(cut)]
    if waiting:
        yield pa.Table.from_batches(waiting)


def cell_numbers(table: pa.Table, cell: list[str]) -> np.ndarray:
    """0, 1, 2 ... for the cells in their order."""
    columns = [table.column(c).to_numpy() for c in cell]
    return np.cumsum(np.append(0, np.any([x[1:] != x[:-1] for x in columns], axis=0)))


def link_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole cells in, links out."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for table in whole_cells(batches, CELL):
        values = table.column("fingerprint").to_numpy().view(np.uint64)
        found = linked(cell_numbers(table, CELL), table.column("side").to_numpy(), values, radius)
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], schema=kind)


def links(distinct: DataFrame, count: int, radius: int, mean_shard: int, max_shard: int) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect what is within ``radius``."""
    rows = shards(distinct, block_masks(count, radius, mean_shard), max_shard)
    rows = rows.repartition(*CELL).sortWithinPartitions(*CELL)
    return rows.mapInArrow(lambda batches: link_batches(batches, radius), "a bigint, b bigint").distinct()


# --- groups -------------------------------------------------------------------------------


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of ``pairs`` (a, b) but the roots; a component's root is its
    smallest node. Large-star and small-star steps alternate until nothing changes; each node's
    smallest neighbour is a table of its own, so that a hub's rows can be split in the join."""

    def smallest(rows: DataFrame) -> DataFrame:
        return written(rows.groupBy("v").agg(F.min("u").alias("m")), "smallest")

    def mark(rows: DataFrame) -> tuple:
        total = F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
        return tuple(rows.agg(F.count("*"), total).first())

    edges = pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct()
    edges = written(edges, "edges")
    def stars(edges: DataFrame) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = smallest(both).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # every edge keeps its larger end; the smaller ends of one node hang on the least of them
        large = written(large.filter("v <> u").distinct(), "edges")
        small = large.join(smallest(large), "v")
        own, other = F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))
        return small.select(F.explode(F.array(own, other)).alias("e")).select("e.*").filter("v <> u").distinct()

    before = mark(edges)
    while before[0]:
        edges = settled(functools.partial(stars, edges), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    mean_shard: int = MEAN_SHARD,
    max_shard: int = MAX_SHARD,
) -> DataFrame:
    """(id, ``fingerprint``, ``component_id``) for each row: the smallest id of all rows
    reachable over links, itself included.

    A null or empty text has fingerprint 0 and is linked like any other. Repeated rows each get
    their row. Null ids never name a component; where a component has no other, its id is null.
    """
    rows = written(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), "_text", shingle), "fingerprints")

    def classes() -> DataFrame:
        distinct = written(rows.groupBy("fingerprint").agg(F.min("id").alias("low")), "distinct")
        pairs = links(distinct.select("fingerprint"), distinct.count(), radius, mean_shard, max_shard)
        roots = components(pairs).withColumnRenamed("node", "fingerprint")
        of = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
        of = written(of, "roots")
        least = written(of.groupBy("root").agg(F.min("low").alias("component_id")), "least")
        return of.join(least, "root").select("fingerprint", "component_id")

    classes = settled(classes, "classes")
    return rows.join(classes, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def drop_copies(df: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``df`` with one row of each component: that whose id names it. ``classes`` is what
    ``near_duplicates`` says of ``df``. Where several rows bear that id, one of them stays.
    Rows with a null id stay: nothing tells them apart."""
    named = classes.filter(F.col(id_col).isNotNull())
    same = F.col(id_col) == F.col("_id")
    gone = named.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_id")).distinct()
    kept = df.join(written(gone, "gone"), same, "left_anti")
    stay = named.filter(F.col(id_col) == F.col("component_id"))
    often = written(stay.groupBy(F.col(id_col).alias("_id")).count().filter("count > 1").select("_id"), "often")
    if often.isEmpty():
        return kept
    return kept.join(often, same, "left_anti").unionByName(kept.join(often, same, "left_semi").dropDuplicates([id_col]))
