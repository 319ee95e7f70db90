"""Secrets in texts: three fixed patterns, and strings that a battery of tests finds random.

Only column functions. The battery takes runs of encoding characters. The smallest alphabet that
covers a run is its encoding; a run that none covers is cut at '/', '-' and '_'. Three tests ask whether the run could be random: the chi-squared
statistic of its alphabet's uniformity, the number of runs above and below the alphabet's middle,
and the correlation of neighbours. A run that any of them refutes is dropped.

A short run passes such tests whatever it is, so passing isn't evidence. Evidence is the chance that
an ordinary string of the same length looks as uniform: for one whose characters coincide as often
as those of words do, the statistic has a noncentral chi-squared distribution, whose distance from
uniform grows with the length. Over the distinct runs of each encoding, Benjamini and Hochberg's
procedure on these chances holds the expected share of false finds at ``RATE``. It needs only their
histogram, which is small whatever the number of texts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewlens.llm.tables import clear_of, without, written

#: The kinds in their order, their patterns, and the least length of what each finds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LENGTH = 8

#: Runs that the battery takes, without padding. What follows '=' is a value, so a run may begin there.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Pieces that stand for a run no alphabet covers: those between its separators.
PIECE = r"[A-Za-z0-9+]{20,}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, alphabet, and how often two characters of an ordinary string in it are the same one.
ENCODINGS = (
    ("decimal", DIGITS, 0.12),
    ("hex", DIGITS + LOWER[:6], 0.10),
    ("upper_hex", DIGITS + UPPER[:6], 0.10),
    ("lower", LOWER, 0.06),
    ("upper", UPPER, 0.06),
    ("base32", UPPER + DIGITS[2:8], 0.06),
    ("lower_base36", DIGITS + LOWER, 0.06),
    ("upper_base36", DIGITS + UPPER, 0.06),
    ("letters", LOWER + UPPER, 0.06),
    ("base62", DIGITS + LOWER + UPPER, 0.06),
    ("base64", UPPER + LOWER + DIGITS + "+/", 0.06),
    ("base64url", UPPER + LOWER + DIGITS + "-_", 0.06),
)
#: Chance of each test to refute a random run, and share of false finds.
REFUTES, RATE = 0.001, 0.01
#: Histogram bins for a factor of ten, and the number of bins.
BINS, MOST = 20, 240


# --- spans --------------------------------------------------------------------------------


def spans(text: Column, matches: Column, pattern: str) -> Column:
    """(start, end) of each match, in code points: what stands between matches, and the matches,
    follow each other."""
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(
        F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"))
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        one = F.struct(begin.alias("start"), (begin + x["own"]).alias("end"))
        return F.struct((begin + x["own"]).alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    return F.when(F.size(matches) > 0, F.aggregate(lengths, start, step, lambda s: s["found"])).otherwise(none)


def pieces_of(run: Column) -> Column:
    """(run, at) of what the battery takes of one (run, at): itself, or, where no alphabet has all
    its characters, its pieces."""
    matches = F.regexp_extract_all(run["run"], F.lit(PIECE), F.lit(0))
    begin = run["at"]["start"]
    moved = lambda m, s: F.struct(
        m.alias("run"), F.struct((begin + s["start"]).alias("start"), (begin + s["end"]).alias("end")).alias("at")
    )
    pieces = F.zip_with(matches, spans(run["run"], matches, PIECE), moved)
    return F.when(encoding_of(run["run"]).isNull(), pieces).otherwise(F.array(run))


# --- the battery --------------------------------------------------------------------------


def normal_below(z: Column) -> Column:
    """The standard normal distribution function, within 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    terms = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    series = reduce(lambda total, c: total * t + c, reversed(terms), F.lit(0.0)) * t
    above = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z < 0, above).otherwise(1 - above)


def chi_squared_score(x: Column, degrees: Column, shift: Column) -> Column:
    """A chi-squared value with noncentrality ``shift`` as a standard normal one (Patnaik's moments
    in Wilson and Hilferty's cube root)."""
    mean = degrees + shift
    spread = 2 / (9 * mean * mean / (degrees + 2 * shift))
    return (F.pow(x / mean, 1 / 3) - (1 - spread)) / F.sqrt(spread)


def encoding_of(run: Column) -> Column:
    """The number of the first alphabet that has all characters of ``run``, or null."""
    found = F.lit(None).cast("int")
    for number, (_, alphabet, _) in reversed(list(enumerate(ENCODINGS))):
        found = F.when(F.translate(run, alphabet, "") == "", F.lit(number)).otherwise(found)
    return found


def pick(number: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), number + 1)


def judged(runs: DataFrame) -> DataFrame:
    """(run, encoding, bin) of rows (run): the bin of the run's chance, -1 where a test refutes
    that it is random. Each step adds what the next one uses."""
    letter = lambda i: F.substring("run", i, F.lit(1))
    rows = runs.withColumns({"n": F.length("run").cast("double"), "encoding": encoding_of(F.col("run"))})
    rows = rows.filter(F.col("encoding").isNotNull())
    rows = rows.withColumns(
        {
            "alphabet": pick(F.col("encoding"), [a for _, a, _ in ENCODINGS]),
            "k": pick(F.col("encoding"), [float(len(a)) for _, a, _ in ENCODINGS]),
            "coincide": pick(F.col("encoding"), [c for _, _, c in ENCODINGS]),
            "letters": F.transform(F.sequence(F.lit(1), F.length("run")), letter),
        }
    )
    squares = F.aggregate(
        F.array_distinct("letters"),
        F.lit(0.0),
        lambda total, c: total + F.pow(F.col("n") - F.length(F.replace("run", c, F.lit(""))), F.lit(2)),
    )
    rows = rows.withColumns(
        {
            "statistic": F.col("k") / F.col("n") * squares - F.col("n"),
            "index": F.transform("letters", lambda c: (F.position(c, F.col("alphabet")) - 1).cast("double")),
        }
    )
    total = lambda values, zero: F.aggregate(values, F.lit(zero), lambda a, b: a + b)
    rows = rows.withColumns(
        {
            "high": F.transform("index", lambda x: (x >= F.col("k") / 2).cast("int")),
            "mean": total("index", 0.0) / F.col("n"),
        }
    )
    after = lambda c: (F.slice(c, 2, F.length("run")), F.slice(c, 1, F.length("run") - 1))
    off = lambda x: x - F.col("mean")
    n1 = total("high", 0).cast("double")
    rows = rows.withColumns(
        {
            "changes": total(F.zip_with(*after("high"), lambda a, b: F.abs(a - b)), 0),
            "expected": 2 * n1 * (F.col("n") - n1) / F.col("n") + 1,
            "about": F.aggregate("index", F.lit(0.0), lambda a, b: a + off(b) * off(b)),
            "along": total(F.zip_with(*after("index"), lambda a, b: off(a) * off(b)), 0.0),
        }
    )
    n, k, statistic = F.col("n"), F.col("k"), F.col("statistic")
    variance = (F.col("expected") - 1) * (F.col("expected") - 2) / (n - 1)
    runs_off = F.abs(F.col("changes") + 1 - F.col("expected")) / F.sqrt(variance)
    serial = F.abs((F.col("along") / F.col("about") + 1 / n) * F.sqrt(n))
    rows = rows.withColumns(
        {
            "uniform": 1 - normal_below(chi_squared_score(statistic, k - 1, F.lit(0.0))),
            "runs": F.when(variance > 0, 2 * normal_below(-runs_off)).otherwise(0.0),
            "serial": F.when(F.col("about") > 0, 2 * normal_below(-serial)).otherwise(0.0),
            "ordinary": normal_below(chi_squared_score(statistic, k - 1, (n - 1) * (k * F.col("coincide") - 1))),
        }
    )
    bin_ = F.least(F.floor(-F.log10(F.greatest("ordinary", F.lit(1e-300))) * BINS), F.lit(MOST)).cast("int")
    stays = F.least("uniform", "runs", "serial") >= REFUTES
    return rows.select("run", "encoding", F.when(stays, bin_).otherwise(-1).alias("bin"))


def limits(tested: DataFrame) -> DataFrame:
    """(encoding, least): the least bin that counts, by the step-up procedure."""
    counts = written(tested.groupBy("encoding", "bin").agg(F.count("*").alias("n")), "chances")
    above = Window.partitionBy("encoding").orderBy(F.desc("bin"))
    rows = counts.withColumn("upto", F.sum("n").over(above))
    rows = rows.withColumn("all", F.sum("n").over(Window.partitionBy("encoding")))
    # all chances of a bin are at most that of its edge
    holds = F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / BINS) <= RATE * F.col("upto")
    return rows.filter((F.col("bin") >= 0) & holds).groupBy("encoding").agg(F.min("bin").alias("least"))


# --- the operator -------------------------------------------------------------------------


@clear_of(*(f"_{c}{at}" for c in ("assign", "access", "hex", "run") for at in ("", "_at")), "_text", "_base", "_runs", "_key", "_random")
def find_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``secrets``: an array of (start, kind, end) in their order,
    where ``kind`` is the place in ``KINDS``, and offsets are code points, the end exclusive.

    Random runs that overlap a pattern's span aren't listed again. A null text is empty. Rows are
    searched one by one; repeated rows add no runs to the procedure. A column named ``secrets`` is
    replaced; others stay, whatever their names.
    """
    df = without(df, "secrets")
    names = [c for c in df.columns if c != text_col]
    kept = [F.col(f"`{c}`") for c in names]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(*kept, text.alias("_text"))
    found = {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX, "_run": RUN}
    rows = rows.select("*", *(F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(c) for c, p in found.items()))
    rows = rows.select("*", *(spans(F.col("_text"), F.col(c), p).alias(f"{c}_at") for c, p in found.items())).drop("_text")
    long = F.transform("_assign", lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= ASSIGN_LENGTH)
    assign = F.filter(F.zip_with("_assign_at", long, lambda s, x: F.when(x, s)), lambda s: s.isNotNull())
    as_kind = lambda at, kind: F.transform(
        at, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    )
    base = F.concat(as_kind(assign, 0), as_kind(F.col("_access_at"), 1), as_kind(F.col("_hex_at"), 2))
    rows = rows.select(*names, base.alias("_base"), F.arrays_zip(F.col("_run").alias("run"), F.col("_run_at").alias("at")).alias("_runs"))
    free = F.filter(
        F.flatten(F.transform("_runs", pieces_of)),
        lambda r: ~F.exists("_base", lambda b: (b["start"] < r["at"]["end"]) & (r["at"]["start"] < b["end"])),
    )
    rows = rows.select(*names, "_base", free.alias("_runs")).withColumn("_key", F.monotonically_increasing_id())
    rows = written(rows, "secrets")
    runs = rows.select("_key", F.explode("_runs").alias("r")).select("_key", "r.run", "r.at")
    tested = written(judged(runs.select("run").distinct()), "tested")
    secret = tested.join(limits(tested), "encoding").filter("bin >= least").select("run")
    random = runs.join(written(secret, "random"), "run").groupBy("_key").agg(F.collect_list("at").alias("_random"))
    rows = rows.join(written(random, "random"), "_key", "left")
    some = F.when(F.col("_random").isNotNull(), as_kind(F.col("_random"), 3)).otherwise(F.slice("_base", 1, 0))
    return rows.select(*names, F.array_sort(F.concat("_base", some)).alias("secrets"))


def as_text(secrets: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(
            secrets,
            lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def of_kind(secrets: Column, *kinds: int) -> Column:
    return F.filter(secrets, lambda s: s["kind"].isin(*kinds))
