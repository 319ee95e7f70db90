"""Boilerplate lines of a host: those that stand on too large a share of its pages.

Only column functions. A page is a distinct text of its host, so that copies of a page don't make
its lines boilerplate. Lines are compared by the MD5 of what is left of them without white space
at the ends. What crosses the shuffle is one list of digests for each distinct page, then one
count for each line, task and host. A host has few boilerplate lines: lines on a share ``ratio``
of its pages are at most 1 / ``ratio`` times as many as a page has on average, so they fit a list
beside the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.llm.tables import clear_of, settled, without, written

#: Boilerplate stands on this share of a host's pages, and on this many at least.
RATIO, MIN_PAGES = 0.05, 5
SPACE = " \t\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """Of a blank line null."""
    plain = F.btrim(line, F.lit(SPACE))
    return F.when(plain != "", F.unhex(F.md5(plain)))


def boilerplate(df: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """(host, keys): the digests of each host's boilerplate lines."""
    keys = F.array_compact(F.array_distinct(F.transform(lines_of(text), line_key)))
    page = df.filter(text.isNotNull()).select(host.alias("host"), F.unhex(F.sha2(text, 256)).alias("page"), keys.alias("keys"))
    pages = written(page.groupBy("host", "page").agg(F.first("keys").alias("keys")), "pages")
    totals = written(pages.groupBy("host").agg(F.count("*").alias("pages")), "totals")
    counts = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").count()
    counts = written(counts.filter(F.col("count") >= min_pages), "lines")
    same = counts["host"].eqNullSafe(totals["host"])
    bad = counts.join(totals, same).filter(F.col("count") >= ratio * F.col("pages"))
    return bad.groupBy(counts["host"].alias("host")).agg(F.collect_set("key").alias("keys"))


@clear_of("_host", "_keys", "_kept")
def drop_boilerplate(
    df: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    keep_whole: bool = True,
) -> DataFrame:
    """``df`` with ``text_col`` less the boilerplate lines of the row's host, and with ``n_lines``
    and ``n_dropped`` (bigint; columns of these names are replaced).

    A null text stays null and has no lines; blank lines are kept. A text all of whose lines with
    something on them are boilerplate stays whole: the share says nothing against it as a page. Not so
    with ``keep_whole`` false: then its lines go too, and what is left is empty or blank.
    A null host is a host of its own. The caller's other columns stay, whatever their names. Repeated rows count as one page and are all cut alike.
    """
    df = without(df, "n_lines", "n_dropped")
    text = F.col(f"`{text_col}`")
    found = settled(lambda: boilerplate(df, F.col(f"`{host_col}`"), text, ratio, min_pages), "boilerplate")
    found = found.withColumnsRenamed({"host": "_host", "keys": "_keys"})
    rows = df.join(found, F.col(f"`{host_col}`").eqNullSafe(F.col("_host")), "left")
    kept = F.filter(lines_of(text), lambda x: ~F.coalesce(F.array_contains("_keys", line_key(x)), F.lit(False)))
    rows = rows.withColumn("_kept", F.when(F.col("_keys").isNotNull(), kept))
    empty = ~F.exists("_kept", lambda x: F.btrim(x, F.lit(SPACE)) != "")
    cut = F.col("_kept").isNotNull() & (~empty if keep_whole else F.lit(True))
    lines = F.coalesce(F.size(lines_of(text)), F.lit(0)).cast("bigint")
    lines = F.when(text.isNotNull(), lines).otherwise(0)
    dropped = F.when(cut, lines - F.size("_kept")).otherwise(0)
    return rows.select(
        *(
            F.when(cut, F.array_join("_kept", "\n")).otherwise(text).alias(c) if c == text_col else f"`{c}`"
            for c in df.columns
        ),
        lines.alias("n_lines"),
        dropped.cast("bigint").alias("n_dropped"),
    )
