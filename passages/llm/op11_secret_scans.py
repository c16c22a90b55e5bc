"""Operator 11, secret scans: patterns, and a battery of randomness tests under false-discovery control.

All of it is DataFrame operations. Three patterns give the base spans. Beyond them, every run of 20 or more
characters of `[A-Za-z0-9+/_-]` is tested. The smallest usual alphabet that holds it is its encoding (hex, base32,
one case and digits, letters, letters and digits, base64), of K symbols; digits alone have none and are left out.

The battery asks whether the run could be drawn at random from that alphabet: chi-squared of its K counts against
equal ones (Wilson-Hilferty), Wald and Wolfowitz's runs of symbols of the alphabet's lower and upper half, and
the serial correlation of neighbouring symbols. Fisher's method joins the three; runs below ALPHA are ordinary.
Short runs of ordinary text pass such tests too, so the rest must also be far from ordinary text for their length.
The ordinary share of equal pairs and triples of symbols is summed for each encoding over all the runs that the
battery refuses (with PRIOR pairs of usual text); they give mean and variance of the number of equal pairs in an
ordinary run of n symbols, hence its p-value: the shorter the run, the less any count can prove. Benjamini and
Hochberg's rule at Q decides within each encoding and octave of lengths, on p-values rounded up to tenths of
a power of ten, so that only a histogram of bounded size leaves the tasks.

A text is scanned once and only spans and test figures are written; places come from the lengths between matches,
added up in blocks of BLOCK so that many matches don't cost their square. Kinds may overlap: a random value in an
assignment gives both spans.

Defined results: a null text is empty and has no spans, '' as spans and the hash of ''; rows with equal or null
doc_ids are rows of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.common import table, written

NAME = "op11_secret_scans"

#: Base patterns, each with the group whose length counts and that length. For the last two the length is in the
#: pattern: a run that is too short holds no longer one, so what fails is dropped either way.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
KINDS = (*PATTERNS, "random")
#: Runs that are tested: symbols, then padding that isn't.
LEAST = 20
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, smallest first: pattern of a run, its alphabet in order, and the share of equal pairs and of equal
#: triples of symbols in usual text.
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", DIGITS + LOWER[:6], 0.12, 0.02),
    (r"^[a-z]+$|^[A-Z]+$", LOWER, 0.066, 0.0053),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", LOWER + DIGITS[2:8], 0.066, 0.0053),
    (r"^(?=.*[0-9])(?=.*[a-zA-Z])([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER, 0.066, 0.0053),
    (r"^(?=.*[a-zA-Z])[0-9A-Za-z]+$", DIGITS + UPPER + LOWER, 0.066, 0.0053),
    (r"[^0-9]", UPPER + LOWER + DIGITS + "+/", 0.066, 0.0053),
)
#: Encodings whose letters are read in lower case.
FOLDED = 4
#: Level of the battery, rate of false discoveries, pairs that usual text counts for, octaves of lengths.
ALPHA, Q, PRIOR, OCTAVES = 1e-3, 0.05, 10_000.0, 8
#: Tenths of a power of ten of p-values that the histogram holds.
BINS = 120
#: Matches whose places are added up together.
BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Array of (start, end, run) of a pattern's matches in code points, those whose group is long enough."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("run"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    parts = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m["run"].alias("run"), F.length(m["part"]).alias("size")))
    parts = F.filter(parts, lambda p: p["run"].isNotNull())  # the last gap has no match
    none = "array<struct<start:int,end:int,run:string,size:int>>"
    nothing = F.array().cast(none)

    def place(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["run"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["run"].alias("run"), p["size"].alias("size")))).alias("out"))

    def block(acc: Column, own: Column) -> Column:
        placed = F.aggregate(own, F.struct(acc["at"].alias("at"), nothing.alias("out")), place)
        return let(placed, lambda b: F.struct(b["at"].alias("at"), F.concat(acc["out"], b["out"]).alias("out")))

    def all_blocks(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda k: F.slice(p, k * BLOCK + 1, F.lit(BLOCK)))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), nothing.alias("out")), block)["out"]

    kept = F.filter(let(parts, all_blocks), lambda m: m["size"] >= least)
    kept = F.transform(kept, lambda m: F.struct(m["start"], m["end"], m["run"]))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<start:int,end:int,run:string>>"))


def above(z: Column) -> Column:
    """Probability that a normal variable exceeds z (Abramowitz and Stegun 26.2.17), at least 1e-12."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.lit(1e-12), F.when(z >= 0, tail).otherwise(1 - tail))


def encoding(body: Column) -> Column:
    """Number of the smallest encoding that holds a run, null for digits alone."""
    found = F.lit(None).cast("int")
    for i, (pattern, *_) in reversed(list(enumerate(ENCODINGS))):
        found = F.when(body.rlike(pattern), F.lit(i)).otherwise(found)
    return found


def choice(number: Column, values: list) -> Column:
    """The value of that number, from 0."""
    return F.element_at(F.array(*map(F.lit, values)), number + 1)


def codes(body: Column, enc: Column) -> Column:
    """Places of a run's symbols in the alphabet, from 1."""
    read = F.when(enc < FOLDED, F.lower(body)).otherwise(F.translate(body, "-_", "+/"))
    return let(choice(enc, [a for _, a, *_ in ENCODINGS]), lambda a: F.transform(F.split(read, ""), lambda c: F.position(c, a)))


def equal_sets(own: Column) -> Column:
    """(pairs, triples): ordered pairs and triples of different places with the same symbol."""
    start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("pairs"), F.lit(0.0).alias("triples"))

    def step(acc: Column, c: Column) -> Column:
        before = F.when(acc["last"] == c, acc["run"]).otherwise(F.lit(0).cast("long"))  # as many equal ones stand before it
        return F.struct(c.alias("last"), (before + 1).alias("run"), (acc["pairs"] + 2 * before).alias("pairs"), (acc["triples"] + 3 * before * (before - 1)).alias("triples"))

    return F.aggregate(F.array_sort(own), start, step)


def sequence_sums(own: Column, half: Column) -> Column:
    """Sums that the runs and serial-correlation tests need, in one pass."""
    zero = F.lit(0.0)
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("first"), zero.alias("high"), zero.alias("runs"), zero.alias("sum"), zero.alias("squares"), zero.alias("products"))

    def step(acc: Column, c: Column) -> Column:
        new = (acc["last"] == 0) | ((acc["last"] > half) != (c > half))
        return F.struct(
            c.alias("last"), F.when(acc["last"] == 0, c).otherwise(acc["first"]).alias("first"), (acc["high"] + (c > half).cast("int")).alias("high"), (acc["runs"] + new.cast("int")).alias("runs"),
            (acc["sum"] + c).alias("sum"), (acc["squares"] + c * c).alias("squares"), (acc["products"] + acc["last"] * c).alias("products"),
        )

    return F.aggregate(own, start, step)


def battery(n: Column, symbols: Column, pairs: Column, s: Column) -> Column:
    """Fisher's p-value of the three tests: probability that a random run of n looks less random than this one."""
    df = symbols - 1
    chi = symbols / n * (pairs + n) - n
    cube = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    low = n - s["high"]
    mean = 2 * s["high"] * low / n + 1
    spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
    runs = F.when(spread > 0, 2 * above(F.abs((s["runs"] - mean) / spread))).otherwise(1e-12)
    m = s["sum"] / n
    variance = s["squares"] - n * m * m
    around = s["products"] - m * (2 * s["sum"] - s["first"] - s["last"]) + (n - 1) * m * m
    serial = F.when(variance > 1e-9, 2 * above(F.abs((around / variance + 1 / n) * F.sqrt(n)))).otherwise(1e-12)
    half = -(F.log(above(cube)) + F.log(F.least(F.lit(1.0), runs)) + F.log(F.least(F.lit(1.0), serial)))
    return F.exp(-half) * (1 + half + half * half / 2)


def tested(found: Column) -> Column:
    """Runs (start, end, run) -> (start, end, enc, n, p, pairs, triples), without those of no encoding."""

    def one(m: Column, enc: Column, own: Column) -> Column:
        k = choice(enc, [float(len(a)) for _, a, *_ in ENCODINGS])
        n = F.size(own).cast("double")
        return let(equal_sets(own), lambda e: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), enc.alias("enc"), n.alias("n"),
            let(sequence_sums(own, F.floor(k / 2)), lambda s: battery(n, k, e["pairs"], s)).alias("p"), e["pairs"].alias("pairs"), e["triples"].alias("triples"),
        ))

    def run(m: Column) -> Column:
        return let(F.rtrim(m["run"], F.lit("=")), lambda body: let(encoding(body), lambda enc: F.when(enc.isNotNull(), let(codes(body, enc), lambda own: one(m, enc, own)))))

    return F.filter(F.transform(found, run), lambda t: t.isNotNull())


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, a column of (start, end) for each base kind, and the tested runs."""
    text = F.coalesce("text", F.lit(""))
    base = [F.transform(spans(text, *PATTERNS[k]), lambda m: F.struct(m["start"], m["end"])).alias(k) for k in PATTERNS]
    return docs.select("doc_id", *base, tested(spans(text, RUN)).alias("runs"))


def shares(runs: DataFrame) -> list[tuple[float, float]]:
    """Share of equal pairs and triples in ordinary runs of each encoding: one row an encoding leaves the tasks."""
    n = F.col("n")
    sums = runs.where(F.col("p") < ALPHA).groupBy("enc").agg(F.sum("pairs").alias("x2"), F.sum(n * (n - 1)).alias("n2"), F.sum("triples").alias("x3"), F.sum(n * (n - 1) * (n - 2)).alias("n3"))
    found = {r["enc"]: r for r in sums.collect()}
    made = []
    for i, (_, _, two, three) in enumerate(ENCODINGS):
        r = found.get(i)
        x2, n2, x3, n3 = (r["x2"], r["n2"], r["x3"], r["n3"]) if r else (0.0, 0.0, 0.0, 0.0)
        s2, s3 = (x2 + PRIOR * two) / (n2 + PRIOR), (x3 + PRIOR * LEAST * three) / (n3 + PRIOR * LEAST)
        made.append((s2, max(s3, s2 * s2)))
    return made


def ordinary(run: Column, known: list[tuple[float, float]]) -> Column:
    """Probability that an ordinary run of this length has as few equal pairs, in bins: floor(-10 log10 p)."""
    n, s2, s3 = run["n"], choice(run["enc"], [a for a, _ in known]), choice(run["enc"], [b for _, b in known])
    pairs = n * (n - 1)
    spread = F.sqrt(2 * pairs * (s2 - s2 * s2) + 4 * pairs * (n - 2) * (s3 - s2 * s2))
    return F.least(F.lit(BINS), F.floor(-10 * F.log10(above((pairs * s2 - run["pairs"]) / spread)))).cast("int")


def octave(run: Column) -> Column:
    return F.least(F.lit(OCTAVES - 1), F.floor(F.log2(run["n"] / LEAST))).cast("int")


def thresholds(counts: dict[tuple[int, int, int], int]) -> list[int]:
    """Least bin that Benjamini and Hochberg's rule accepts, by encoding and octave; BINS + 1: none.

    counts: runs by (encoding, octave, bin; -1: refused by the battery, a test with a p-value of 1)."""
    found = []
    for enc in range(len(ENCODINGS)):
        for o in range(OCTAVES):
            own = [counts.get((enc, o, b), 0) for b in range(-1, BINS + 1)]
            total = sum(own)
            passing = [b for b in range(BINS + 1) if (k := sum(own[b + 1 :])) and total * 10 ** (-b / 10) <= Q * k]
            found.append(min(passing, default=BINS + 1))
    return found


def listed(kinds: dict[str, Column]) -> Column:
    """kind:start:end of all spans, by start and then kind, joined by commas."""

    def ranked(i: int, column: Column) -> Column:
        return F.transform(column, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end")))

    every = F.concat(*[ranked(i, c) for i, c in enumerate(kinds.values())])
    return F.array_join(F.transform(F.array_sort(every), lambda m: F.concat_ws(":", choice(m["kind"], list(kinds)), m["start"], m["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the base kinds and `random` as arrays of (start, end)."""
    found = written(scanned(docs), "secrets-runs")
    runs = found.select(F.explode("runs").alias("r")).select("r.*")
    known = shares(runs)
    whole = F.struct("n", "enc", "pairs")
    bins = F.when(F.col("p") < ALPHA, -1).otherwise(let(whole, lambda r: ordinary(r, known)))
    counts = runs.groupBy("enc", octave(whole).alias("octave"), bins.alias("bin")).count().collect()  # at most encodings x octaves x bins
    limits = thresholds({(r["enc"], r["octave"], r["bin"]): r["count"] for r in counts})
    random = F.filter("runs", lambda r: (r["p"] >= ALPHA) & (ordinary(r, known) >= choice(r["enc"] * OCTAVES + octave(r), limits)))
    return found.select("doc_id", *PATTERNS, F.transform(random, lambda r: F.struct(r["start"], r["end"])).alias("random"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = {k: F.col(k) for k in PATTERNS}
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed({k: F.col(k) for k in KINDS}).alias("spans"))


#: Tests hold the query against plain Python.
ORACLE_SQL = None
