"""Patterns and battery against plain reimplementations."""

import collections
import hashlib
import math
import random
import re
import string

from pyspark.sql import functions as F

from viewlens.llm import registry, secrets
from viewlens.llm.tables import load

SCHEMA = "doc_id bigint, text string"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return found


def below(z):
    return math.erfc(-z / math.sqrt(2)) / 2


def score(x, degrees, shift):
    mean = degrees + shift
    spread = 2 / (9 * mean**2 / (degrees + 2 * shift))
    return ((x / mean) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)


def plain_chance(run):
    """(encoding, chance), the chance None where a test refutes."""
    for number, (_, alphabet, coincide) in enumerate(secrets.ENCODINGS):
        if set(run) <= set(alphabet):
            break
    else:
        return None
    n, k = len(run), len(alphabet)
    x = k / n * sum(c * c for c in collections.Counter(run).values()) - n
    index = [alphabet.index(c) for c in run]
    high = [i >= k / 2 for i in index]
    n1 = sum(high)
    expected = 2 * n1 * (n - n1) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    count = 1 + sum(a != b for a, b in zip(high, high[1:]))
    runs = 2 * below(-abs(count - expected) / math.sqrt(variance)) if variance > 0 else 0
    mean = sum(index) / n
    about = sum((i - mean) ** 2 for i in index)
    along = sum((a - mean) * (b - mean) for a, b in zip(index, index[1:]))
    serial = 2 * below(-abs((along / about + 1 / n) * math.sqrt(n))) if about else 0
    stays = min(1 - below(score(x, k - 1, 0)), runs, serial) >= secrets.REFUTES
    return number, below(score(x, k - 1, (n - 1) * (k * coincide - 1))) if stays else None


def plain(rows):
    bases = [plain_base(t) for _, t in rows]
    free = []
    for (_, t), base in zip(rows, bases):
        runs = re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}", t or "")
        free.append([m for m in runs if not any(b[0] < m.end() and m.start() < b[2] for b in base)])
    chance = {m[0]: plain_chance(m[0]) for ms in free for m in ms}
    family = collections.defaultdict(list)
    for c in filter(None, chance.values()):
        family[c[0]].append(None if c[1] is None else min(math.floor(-math.log10(max(c[1], 1e-300)) * 20), 240))
    least = {}
    for e, bins in family.items():
        ok = [b for b in bins if b is not None and b >= 0 and len(bins) * 10 ** (-b / 20) <= secrets.RATE * sum(x is not None and x >= b for x in bins)]
        if ok:
            least[e] = min(ok)
    out = []
    for base, ms in zip(bases, free):
        some = []
        for m in ms:
            c = chance[m[0]]
            if c and c[1] is not None and c[0] in least and min(math.floor(-math.log10(max(c[1], 1e-300)) * 20), 240) >= least[c[0]]:
                some.append((m.start(), 3, m.end()))
        out.append(sorted(base + some))
    return out


def check(df, rows):
    got = secrets.find_secrets(df).collect()
    key = lambda x: (str(x[0]), x[1])
    have = sorted(((r["doc_id"], [tuple(s) for s in r["secrets"]]) for r in got), key=key)
    assert have == sorted(((i, s) for (i, _), s in zip(rows, plain(rows))), key=key)


def test_query_equals_brute_force_on_whole_tables(spark):
    for sf in ("0.001", "0.01"):
        sf_dir = f"/root/testdata/sf{sf}"
        rows = [tuple(r) for r in load(spark, sf_dir, "documents").select("doc_id", "text").collect()]
        want = {i: s for (i, _), s in zip(rows, plain(rows))}
        name = ("assign", "access", "hex", "random")
        text = lambda found: ",".join(f"{name[k]}:{a}:{b}" for a, k, b in found)
        for r in registry.op5_secrets(spark, sf_dir).collect():
            base = [s for s in want[r["doc_id"]] if s[1] < 3]
            assert r["spans"] == text(want[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest()
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]


def varied_rows():
    rng = random.Random(7)
    kinds = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567", string.digits + "abcdef", string.ascii_lowercase]
    rows = []
    for k in range(300):
        run = "".join(rng.choices(rng.choice(kinds), k=rng.randint(18, 70)))
        word = "".join(rng.choices("eeeettaaoinshrdlu_/-ABC", k=rng.randint(18, 60)))
        rows.append((k, f"wörd 𝄞 {run}= and {word} x/{run[:17]} {'Bookkeeper-AtTheLake' * 2}\n"))
    return rows


def test_random_runs_and_ordinary_ones(spark):
    rows = varied_rows()
    check(spark.createDataFrame(rows, SCHEMA), rows)
    found = [any(k == 3 for _, k, _ in s) for s in plain(rows)]
    assert 100 < sum(found) < 250


def test_awkward_rows(spark):
    rows = [
        (1, None), (1, ""), (2, "token=pass; token=apikey:abcdefgh12 PassWord \" : 'x.y-z_1234"), (3, "AKIAAKIA0 AKIA" + "Z" * 12 + "a"),
        (4, "f" * 31 + " " + "0a" * 16 + "g" + "é𝄞" + "b" * 40), (None, "secret='" + "A" * 8 + "'" * 3), (5, "api_key=" + "q" * 7 + " api-key=12345678 apikey = \"k9+/_.=-"),
        (6, "x " * 200_000 + "passwd:zzzzzzzz"), (7, "token: " + "9" * 20), (7, "token: " + "9" * 20), (8, "0" * 50_000 + "/" + "Z" * 30),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("secrets", F.lit("old")).withColumn("_x", F.lit(1))
    check(df, rows)
    assert secrets.find_secrets(df.limit(0)).collect() == []


def test_values_after_an_equals_sign_and_pieces_of_paths(spark):
    rng = random.Random(11)
    token = lambda: "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    forms = ["private_key={}", "/x?sig={}&a=1", "AWS_SECRET_ACCESS_KEY={}", "see /a-b/{}", "in 𝄞 /some-dir/b_c/{}/x-y", "{}=="]
    rows, want = [], {}
    for k in range(60):
        value = token()
        text = "é " + forms[k % len(forms)].format(value) + " end"
        rows.append((k, text))
        want[k] = (text.index(value), 3, text.index(value) + 40)
    rows.append((60, "a-long/path-of/ordinary_words-only/in-small_letters/goes-here"))
    got = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secrets.find_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[60] == []
    for k in range(60):
        assert got[k] == [want[k]], rows[k]
