"""Secret scans: fixed patterns, and a randomness test battery for everything else.

All work is in column expressions. Three patterns give the base spans. The battery looks at
every maximal run of ``[A-Za-z0-9+/_-]``, with the ``=`` that pad it, of at least ``MIN_LENGTH``
characters that holds a letter and a digit (a ``=`` with more of such characters behind it parts
a name from its value, so both are runs of their own), infers the smallest encoding that holds all its characters (hex, base 32
lower or upper case, base 36, base 62, base 64), and tests the run as a sample of that
alphabet:

* chi-squared of the symbol counts against equal frequencies, and whether all counts are as
  near to equal as chance allows (both tails);
* the number of runs above and below the middle of the alphabet (Wald and Wolfowitz);
* the serial correlation of neighbouring symbols.

Under the null hypothesis, a random string, each gives a p-value; Bonferroni combines
them. Natural strings fail them the more surely the longer they are, so false discoveries are
controlled per length band: within a band, Benjamini and Hochberg's step-up rule at level
``RATE`` rejects the strings that are not random, and what is left is a span of kind
``random``. The rule needs the number of p-values below each of a fixed number of
grid points, so a band is never sorted or collected.

Defined cases: null and empty texts have no spans; a run that a base span overlaps is no
candidate; rows are judged one by one, so equal ids do no harm; an empty table gives an empty
one; other columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import stored

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: A run of hex digits that is long enough matches as a whole, since it is greedy and maximal.
MIN_VALUE, MIN_ACCESS = 8, 16
#: ``=`` belongs to a run only as padding at its end; padding counts for the length.
RUN = r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?|(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]+=+(?![A-Za-z0-9+/_=-])"
MIN_LENGTH = 20
KINDS = ("assign", "access", "hex", "random")
#: Encodings from small to large: name, pattern, number of symbols.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$|^[0-9A-F]+$", 16),
    ("base32", "^[A-Z2-7]+=*$|^[a-z2-7]+=*$", 32),
    ("base36", "^[0-9a-z]+$|^[0-9A-Z]+$", 36),
    ("base62", "^[0-9A-Za-z]+$", 62),
    ("base64", "^[0-9A-Za-z+/_-]+=*$", 64),
)
RATE = 0.05
BANDS = (20, 28, 40, 64, 128)
#: p-values are told apart on a logarithmic grid of this many steps per factor e.
STEPS = 16
LEAST_LOG = 50
MASK = "[secret]"


def _found(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Spans (start, kind, end) of the leftmost matches that do not overlap, in code points.

    Splitting at the pattern gives what lies between the same matches, so the lengths of both
    give all places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    between = F.split(text, pattern, -1)
    parts = F.arrays_zip(
        F.transform(F.slice(between, 1, F.size(matches)), F.length).alias("gap"),
        F.transform(matches, F.length).alias("size"),
        F.transform(values, F.length).alias("value"),
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        span = F.struct(
            begin.alias("start"), F.lit(kind).alias("kind"), (begin + part["size"]).alias("end"), part["value"].alias("value")
        )
        return F.struct((begin + part["size"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(parts, start, step, lambda state: state["spans"])
    long_enough = F.filter(spans, lambda s: s["value"] >= least)
    plain = F.transform(long_enough, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern), plain).otherwise(none)


def _symbols(run: Column, size: Column) -> Column:
    """Each character's number in its alphabet, from 0."""
    code = lambda c: F.ascii(c)
    number = (
        lambda c: F.when(c.between("0", "9"), code(c) - 48)
        .when(c.between("a", "z"), code(c) - 87 + F.when(size >= 62, F.lit(26)).otherwise(F.lit(0)))
        .when(c.between("A", "Z"), code(c) - 55)
        .when(c.isin("+", "-"), F.lit(62))
        .otherwise(F.lit(63))
    )
    base32 = lambda c: F.when(c.between("2", "7"), code(c) - 24).otherwise(code(F.lower(c)) - 97)
    characters = F.split(F.rtrim(F.translate(run, "=", " ")), "")
    return F.transform(characters, lambda c: F.when(size == 32, base32(c)).otherwise(number(c)))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    # Fixed values of the formula.
    series = ((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t
    return F.greatest(F.exp(-z * z / 2) / 2.5066282746310002 * series, F.lit(1e-300))


def _two_sided(z: Column) -> Column:
    return F.least(2 * _tail(F.abs(z)), F.lit(1.0))


def p_value(run: Column) -> Column:
    """The battery's combined p-value for a string to be random in its encoding (null: no encoding)."""
    size = reduce(lambda e, x: e.when(run.rlike(x[1]), F.lit(x[2])), ENCODINGS[1:], F.when(run.rlike(ENCODINGS[0][1]), F.lit(16)))
    whole = F.struct(_symbols(run, size).alias("s"), size.cast("double").alias("k"))

    def battery(x: Column) -> Column:
        s, k = x["s"], x["k"]
        n = F.size(s).cast("double")
        squares = F.aggregate(
            F.array_distinct(s), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(s, lambda y: y == v)).cast("double"), 2.0)
        )
        chi, df = squares * k / n - n, k - 1
        # Exact mean and variance of the statistic for equal frequencies; short strings are far from asymptotic.
        by_chi = (chi - df) / F.sqrt(2 * df * (n - 1) / n)
        pairs = F.transform(F.slice(s, 1, F.size(s) - 1), lambda v, i: F.struct(v.alias("a"), F.get(s, i + 1).alias("b")))
        middle = (k - 1) / 2
        high = F.size(F.filter(s, lambda v: v > middle)).cast("double")
        low = n - high
        turns = F.size(F.filter(pairs, lambda p: (p["a"] > middle) != (p["b"] > middle))) + 1.0
        mean = 2 * high * low / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
        by_runs = F.when(spread > 0, (turns - mean) / spread).otherwise(F.lit(9.0))
        center = F.aggregate(s, F.lit(0.0), lambda a, v: a + v) / n
        power = F.aggregate(s, F.lit(0.0), lambda a, v: a + (v - center) * (v - center))
        shared = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - center) * (p["b"] - center))
        by_serial = F.when(power > 0, (shared / power + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        least = F.least(_two_sided(by_chi), _two_sided(by_runs), _two_sided(by_serial))
        return F.least(3 * least, F.lit(1.0))

    return F.when(size.isNotNull(), F.element_at(F.transform(F.array(whole), battery), 1))


def _band(length: Column) -> Column:
    return reduce(lambda e, b: e.when(length >= b, F.lit(b)), reversed(BANDS[:-1]), F.when(length >= BANDS[-1], F.lit(BANDS[-1])))


def _overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (s["end"] > start))


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with base spans and the candidates of the battery with their p-values."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(
        _found(whole, ASSIGN, 0, MIN_VALUE, 1), _found(whole, ACCESS, 1, MIN_ACCESS), _found(whole, HEX, 2, 0)
    )
    runs = F.filter(
        _found(whole, RUN, 3, MIN_LENGTH),
        lambda s: F.substring(whole, s["start"] + 1, s["end"] - s["start"]).rlike("[0-9]")
        & F.substring(whole, s["start"] + 1, s["end"] - s["start"]).rlike("[A-Za-z]"),
    )
    judged = F.transform(
        F.filter(F.col("_runs"), lambda s: ~_overlaps(F.col("_base"), s["start"], s["end"])),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            p_value(F.substring(whole, s["start"] + 1, s["end"] - s["start"])).alias("p"),
        ),
    )
    df = docs.withColumn("_base", F.array_sort(base)).withColumn("_runs", runs)
    return df.withColumn("_candidates", judged).drop("_runs")


def thresholds(scanned: DataFrame, rate: float = RATE) -> dict[int, float]:
    """For each length band, the p-value at and below which a string counts as not random.

    Benjamini and Hochberg on a grid: the largest grid point g with g <= rate * (p-values
    up to g) / (all). One row per band reaches the driver.
    """
    one = scanned.select(F.explode("_candidates").alias("c")).where("c.p is not null").select(
        _band(F.col("c.end") - F.col("c.start")).alias("band"),
        F.least(F.floor(-STEPS * F.log("c.p")), F.lit(STEPS * LEAST_LOG)).cast("int").alias("step"),
    )
    counts = one.groupBy("band", "step").agg(F.count("*").alias("n"))
    listed = counts.groupBy("band").agg(F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("up"), "n"))).alias("steps"))
    limits = {}
    for row in listed.collect():  # at most a band's grid points for each of the bands
        total, below, limit = sum(s["n"] for s in row["steps"]), 0, 0.0
        for s in row["steps"]:
            below += s["n"]
            # The step holds p-values up to exp(up / STEPS).
            largest = 2.718281828459045 ** (s["up"] / STEPS)
            if largest <= rate * below / total:
                limit = largest
        limits[row["band"]] = limit
    return limits


def _decided(scanned: DataFrame, rate: float) -> DataFrame:
    """All spans (start, kind number, end) in order, from what ``_scanned`` has found and written."""
    limits = thresholds(scanned, rate)
    band = lambda c: _band(c["end"] - c["start"])
    none = F.when(F.lit(False), F.lit(1.0))
    limit = lambda c: reduce(lambda e, b: e.when(band(c) == b[0], F.lit(b[1])), limits.items(), none)
    random = F.transform(
        F.filter(F.col("_candidates"), lambda c: c["p"] > F.coalesce(limit(c), F.lit(1.0))),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")),
    )
    return scanned.withColumn("_spans", F.array_sort(F.concat("_base", random))).drop("_candidates")


def _written(column: str) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document: id, base spans and all spans as ``kind:start:end`` in order, counts."""
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = stored(_scanned(slim, "text").drop("text"), "secrets")
    # Of one parameter: Spark takes a second one for the place in the array.
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("_base", of(i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(3)]
    return _decided(found, rate).select("doc_id", *counts, _written("_base").alias("base"), _written("_spans").alias("spans"))


def masked(docs: DataFrame, text: str = "text", rate: float = RATE, mask: str = MASK) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) written as ``mask``, and ``n_chars`` to match."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    body = names[text]
    df = _decided(stored(_scanned(plain, body), "secrets"), rate)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], state["at"])
        gap = F.substring(body, state["at"] + 1, begin - state["at"])
        inside = s["start"] < state["at"]
        out = F.concat(state["out"], gap, F.when(inside, F.lit("")).otherwise(F.lit(mask)))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), out.alias("out"))

    rest = lambda state: F.concat(state["out"], F.substring(body, state["at"] + 1, F.length(body)))
    clean = F.when(F.size("_spans") == 0, F.col(body)).otherwise(F.aggregate("_spans", start, step, rest))
    columns = []
    for c, n in names.items():
        if c == text:
            columns.append(clean.alias(c))
        elif c == "n_chars":
            size = F.when(F.size("_spans") == 0, F.col(n)).otherwise(F.length(clean).cast(docs.schema[c].dataType))
            columns.append(size.alias(c))
        else:
            columns.append(F.col(n).alias(c))
    return df.select(*columns)
