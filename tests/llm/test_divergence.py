"""Perfect hashes, exact shares, and the audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from viewlens.llm import divergence as D
from viewlens.llm import perfect_hash as H

SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 5000])
def test_every_term_has_its_own_slot(n):
    terms = [f"term{i}".encode() for i in range(n)]
    moved, order, apart = H.build(terms)
    assert sorted(order) == list(range(n)) and not apart
    shards = H.Shards(1, [(0, moved, [terms[i] for i in order], apart)])
    places = shards.find(terms)
    assert sorted(places) == list(range(n))
    assert all(shards.terms[p] == t for p, t in zip(places, terms))
    assert (shards.find([f"other{i}".encode() for i in range(200)]) == -1).all()


def test_terms_of_equal_hash_are_listed(monkeypatch):
    monkeypatch.setattr(H, "hashes", lambda terms: np.array([len(t) * 2**50 + 7 for t in terms], np.uint64))
    terms = [b"a", b"b", b"c", b"dd", b"ee", b"fff"]
    moved, order, apart = H.build(terms)
    assert len(apart) == 3
    shards = H.Shards(1, [(0, moved, [terms[i] for i in order], apart)])
    assert [shards.terms[p] for p in shards.find(terms)] == terms
    assert list(shards.find([b"x", b"gggg"])) == [-1, -1]


def test_terms_of_a_text():
    text = "Ab1cd_ÉK x\x00y\n" * 3 + "Z" * 10
    want = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert [t.decode() for part in D.terms(text.encode()) for t in part] == want
    long = ("ab, " * (1 << 19)).encode()
    parts = list(D.terms(long))
    assert len(parts) > 1 and sum(map(len, parts)) == 1 << 19


@pytest.mark.parametrize("n", [0, 12345, 10**14, 5 * 10**17])
def test_shares_are_exact(n):
    pick = random.Random(n)
    counts = np.array([0, n, *(pick.randrange(n + 1) for _ in range(50))], np.int64)
    v = 1000
    assert D.shares(counts, n, v).tolist() == [1 + 10**9 * (int(c) + 5) // (n + 5 * v) for c in counts]


def plain(rows, least, top):
    documents, totals, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", folded))
        documents[lang].update(found.keys())
        totals[lang, source].update(found)
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        whole = sum((totals[lang, s] for s in names), Counter())

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(totals[lang, s]) for s in names}, shares(whole)
        for s in names:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in names if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if totals[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda f: (-f[1], f[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def corpus(seed, n=200):
    pick = random.Random(seed)
    words = ["a", "B", "b", "É", "é", "tion", "x😀", "ﬀ", "zz", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda: pick.choice([None, "", " 12 "]) if pick.random() < 0.1 else "_ ".join(pick.choices(words, weights, k=30))
    langs, sources = ["en", "en", "en", "de", None, "xx"], ["hot"] * 5 + [None, "", "s1", "s2", "ü", "z"]
    rows = [(i, text(), pick.choice(langs), pick.choice(sources)) for i in range(n)]
    return rows + [(n, "rare", "only", "s1"), (n, None, "only", "s2"), (n + 1, "", "lone", "s")] + [rows[0]] * 5


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_plain_counting(spark, monkeypatch, small):
    """Also with many shards, several scans, and blocks of few sources."""
    if small:
        monkeypatch.setattr(D, "SHARD_TERMS", 5)
        monkeypatch.setattr(D, "BLOCK", 2)
    rows = corpus(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = D.audit(df, min_documents=8, top=10, max_terms=12 if small else D.MAX_TERMS)
    assert sorted(map(tuple, got.collect())) == plain(rows, 8, 10)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame(corpus(5, 40), SCHEMA)
    assert D.audit(df.limit(0)).count() == 0
    extra = df.selectExpr("*", *(f"1 AS {c}" for c in ("term", "shard", "n", "v", "counts", "rank", "item", "block")))
    want = sorted(map(tuple, D.audit(df, 3, 5).collect()))
    assert sorted(map(tuple, D.audit(extra, 3, 5).collect())) == want == plain(corpus(5, 40), 3, 5)
