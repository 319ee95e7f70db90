"""Tables written on the way: which are removed, and that queries don't remove each other's."""

from concurrent.futures import ThreadPoolExecutor

from viewlens.llm.registry import QUERIES
from viewlens.llm.tables import settled, written
from viewlens.streaming import paths

SF_DIR = "/root/testdata/sf0.001"


def path(df):
    (one,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    return one


def test_settled_removes_what_it_wrote_and_nothing_else(spark):
    other = written(spark.range(3), "other")
    seen = []

    def inner():
        seen.append(written(spark.range(5), "inner"))
        return seen[-1].filter("id > 1")

    def outer():
        seen.append(settled(inner, "settled"))
        return seen[-1].filter("id > 2")

    out = settled(outer, "outer")
    assert out.count() == 2 and other.count() == 3
    assert [paths.exists(spark, path(df)) for df in seen] == [False, False]


def test_queries_in_threads(spark):
    names = ["op3_quality", "op10_simhash", "op4_line_dedup"]
    alone = {n: sorted(map(str, QUERIES[n](spark, SF_DIR).collect())) for n in names}
    for _ in range(2):
        with ThreadPoolExecutor(3) as threads:
            found = threads.map(lambda n: sorted(map(str, QUERIES[n](spark, SF_DIR).collect())), names)
        assert dict(zip(names, found)) == alone
