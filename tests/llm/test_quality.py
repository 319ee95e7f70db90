"""Base rules and the model against plain reimplementations."""

import collections
import math
import re
import statistics

import numpy as np
import pytest

from viewlens.llm import kneser_ney as K
from viewlens.llm import quality, registry
from viewlens.llm.tables import load

SCHEMA = "doc_id bigint, lang string, text string"


def plain_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )


class PlainModel:
    """Modified Kneser-Ney of one language's symbol lists, from the definition."""

    def __init__(self, texts, order):
        self.order, self.n = order, {}
        runs = collections.Counter()
        for t in texts:
            runs.update(t[i : i + order] for i in range(len(t) - order + 1))
        self.n[order] = runs
        for size in range(order - 1, 0, -1):
            self.n[size] = collections.Counter(g[1:] for g in self.n[size + 1])
        self.cuts, self.contexts = {}, {}
        for size, grams in self.n.items():
            of = collections.Counter(grams.values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
            cut = [0]
            for k in (1, 2, 3):
                raw = k - (k + 1) * y * of[k + 1] / of[k] if of[k] and of[k + 1] and of[1] else 0
                cut.append(raw if raw > 0.1 else 0.5 * k)
            self.cuts[size] = cut
            self.contexts[size] = sums = {}
            for g, c in grams.items():
                total, taken = sums.get(g[:-1], (0, 0))
                sums[g[:-1]] = total + c, taken + cut[min(c, 3)]

    def p(self, gram):
        size = len(gram)
        if not size:
            return 1 / (len(self.n[1]) + 1)
        lower = self.p(gram[1:])
        if gram[:-1] not in self.contexts[size]:
            return lower
        total, taken = self.contexts[size][gram[:-1]]
        c = self.n[size].get(gram, 0)
        return (max(c - self.cuts[size][min(c, 3)], 0) + taken * lower) / total


def symbols(text):
    return K.START * (K.ORDER - 1) + " " + " ".join(text.lower().split())


@pytest.fixture(scope="module")
def documents(spark):
    return load(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "lang", "text")


def test_query_equals_brute_force_on_the_whole_table(spark, documents):
    got = {r["doc_id"]: r for r in registry.op3_quality(spark, "/root/testdata/sf0.001").collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    by_lang = collections.defaultdict(list)
    for r in rows:
        if 50 * len(re.findall(r"[#*$%&|<>]", r["text"])) <= len(r["text"]):
            by_lang[r["lang"]].append(symbols(r["text"]))
    models = {lang: PlainModel(texts, K.ORDER) for lang, texts in by_lang.items()}
    logs, failed = {}, {}
    for r in rows:
        found = got[r["doc_id"]]
        want = plain_features(r["text"])
        assert tuple(found[c] for c in quality.ADDED[:5]) == want
        failed[r["doc_id"]] = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert found["base_failed"] == failed[r["doc_id"]]
        s = symbols(r["text"])
        p = [models[r["lang"]].p(s[i : i + K.ORDER]) for i in range(len(s) - K.ORDER + 1)]
        logs[r["doc_id"]] = -sum(map(math.log, p)) / len(p), len(p)
        assert found["perplexity"] == pytest.approx(math.exp(logs[r["doc_id"]][0]), rel=1e-9)
    for lang in by_lang:
        ids = [r["doc_id"] for r in rows if r["lang"] == lang]
        passed = {logs[i] for i in ids if not failed[i]}
        middle = statistics.median_low(round(x, 3) for x, _ in passed)
        scatter = lambda n: math.sqrt(1 + 1000 / n)
        spread = statistics.median_low(round(abs(x - middle) / scatter(n), 3) for x, n in passed)
        width = max(spread * 1.4826 * 5, 0.05)
        for i in ids:
            off = abs(logs[i][0] - middle) / scatter(logs[i][1])
            if abs(off - width) > 0.01:  # thousandths are rounded differently
                assert got[i]["kept"] == (not failed[i] and off <= width)


def test_bands_part_labelled_junk_from_prose(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in load(spark, sf_dir, "labels").collect()}
    found = registry.op3_quality(spark, sf_dir).filter("not base_failed").collect()
    kept = {q: [r["kept"] for r in found if labels.get(r["doc_id"]) == q] for q in (0, 1)}
    assert len(kept[0]) > 200 and kept[0].count(False) >= 0.9 * len(kept[0])
    assert kept[1].count(False) <= 0.01 * len(kept[1])


def test_a_language_without_prose_keeps_what_passes_the_base_rules(spark):
    prose = "one text of plain words follows another here and none of them has a sign in it at all so all is well"
    rows = [(1, "en", prose), (2, "en", prose + " too"), (3, "xx", "a# b$ c% d& " * 2), (4, "yy", " ".join(f"{w}&&" for w in prose.split()))]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, lang string, text string")).collect()}
    assert got[3]["base_failed"] and not got[3]["kept"]
    assert got[4]["kept"] and got[4]["perplexity"] == pytest.approx(math.exp(-K.UNKNOWN))


def test_blocks_give_the_broadcast_models_scores(spark, documents):
    one = {r["doc_id"]: r["perplexity"] for r in quality.judge(documents, keep_text=False).collect()}
    two = {r["doc_id"]: r["perplexity"] for r in quality.judge(documents, max_entries=0).collect()}
    assert one.keys() == two.keys()
    assert all(two[k] == pytest.approx(v, rel=1e-12) for k, v in one.items())


def test_unseen_texts_get_backed_off_probabilities(spark):
    texts = [("en", "abracadabra abba cad"), ("en", "a bad cab"), ("de", "ebbe")]
    model = K.sorted_arrays(K.entries(K.train(spark.createDataFrame(texts, "lang string, text string"))).toArrow())
    plain = PlainModel([symbols(t) for lang, t in texts if lang == "en"], K.ORDER)
    for text in ("abba", "zzz", "cadab xq ra"):
        s = symbols(text)
        want = sum(math.log(plain.p(s[i : i + K.ORDER])) for i in range(len(s) - K.ORDER + 1))
        assert K.scores([text], ["en"], model, K.ORDER)[0] == (pytest.approx(want), len(text) + 1)
    assert K.scores(["ab"], ["xx"], model, K.ORDER)[0] == (pytest.approx(3 * K.UNKNOWN), 3)


def test_awkward_rows(spark):
    long = "\n".join(f"line {k % 5000} of a text with some words" for k in range(40_000))
    rows = [(1, "en", None), (1, "en", ""), (None, None, "x"), (2, None, "a b " * 30), (2, None, "a b " * 30), (3, "en", long), (4, "zz", "\x0b \x0c\n\n\t"), (5, "en", "É" * 50), (6, "en", "nul\0 \0\0 at\0 ends\0")]
    df = spark.createDataFrame([(*r, "old", 7) for r in rows], SCHEMA + ", kept string, N_Words int")
    got = quality.judge(df).collect()
    assert sorted(tuple(r[c] for c in quality.ADDED[:5]) for r in got) == sorted(plain_features(r[2]) for r in rows)
    assert [r["kept"] for r in got if not (r["text"] or "").strip()] == [False] * 3
    assert quality.judge(df.limit(0)).collect() == []


def test_a_model_beyond_what_a_task_holds_moves_no_texts(spark, documents, monkeypatch):
    model = K.train(documents.select("lang", "text"))
    monkeypatch.setattr(K, "LEAST_PART", 1000)
    parts, whole = K.broadcast_parts(model, 5000)
    count = [len(x.value.keys) for p in parts.values() for x in p.arrays]
    assert not whole and len(count) > 10 and sum(count) == model.count() and max(count) < 7500
    small = quality.scored(documents, model, "text", "lang", 5000)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search("Exchange|CoGroup", plan)
    large = quality.scored(documents, model, "text", "lang", 10**9)
    assert sorted(small.collect()) == sorted(large.collect())


def test_a_process_drops_parts_beyond_what_it_may_hold(spark):
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 4000, np.uint64, endpoint=False))
    number = K.part_number(keys, 4)
    arrays = [spark.sparkContext.broadcast(K.HashArray(keys[number == k], np.arange(4000.0)[number == k], np.zeros(0))) for k in range(4)]
    parts = K.Parts(arrays, 2500)
    for _ in range(2):
        known, found = parts.look_up(np.append(keys, keys[:5] + np.uint64(1)), "log_p")
        assert known.tolist() == [True] * 4000 + [False] * 5 and found.tolist() == list(range(4000))
    assert sum("_value" in vars(x) for x in arrays) == 2
