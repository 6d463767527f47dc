"""Secret scans: pattern spans and a randomness test battery with length-aware false-discovery control.

Three kinds of span follow patterns (assignments, access keys, hex runs). Beyond these, every
long token is a hypothesis "ordinary text or identifier". Its encoding is inferred
(hex, base32, lower-case alphanumeric, alphanumeric, base64), and three statistics ask how much
it resembles uniform random symbols of that alphabet: the chi-squared statistic of
symbol counts, the number of runs of character classes, and the serial correlation
of neighbouring codes. Each gives the probability that ordinary text of the same length looks
that random; Fisher's method combines them, and Benjamini-Hochberg, run within length
classes over the tokens of all documents, decides which are discoveries.

Only built-in expressions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import checkpoint, let

#: The pattern kinds in the order in which spans are listed. Runs of hex digits and of key
#: characters are maximal, so their least length may stand in the pattern; an assignment's is tested on its value.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
#: A hypothesis: a maximal run of at least 20 symbols of the base64 alphabets.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Length classes (lower bounds) within which false discoveries are controlled.
CLASSES = (20, 24, 32, 48, 96)
#: Encodings: pattern, symbols, excess concentration of ordinary tokens (symbols * sum p**2 - 1).
#: Ordinary hex tokens are numbers (ten equal digits); ordinary others have the letter frequencies of text, sum p**2 = 0.066.
ENCODINGS = (
    (r"^([0-9a-f]+|[0-9A-F]+)$", 16, 16 * 0.1 - 1),
    (r"^[A-Z2-7]+=*$", 32, 32 * 0.066 - 1),
    (r"^[a-z0-9]+$", 36, 36 * 0.066 - 1),
    (r"^[A-Za-z0-9]+$", 62, 62 * 0.066 - 1),
    (r"", 64, 64 * 0.066 - 1),
)
#: Share of neighbours of different class, and serial correlation, in ordinary tokens.
SWITCHES, CORRELATION = 0.12, 0.5
#: Accepted share of false discoveries; resolution and end of the axis -log10 p.
RATE = 0.001
STEPS, END = 100, 60

SPAN = "array<struct<start:int,kind:int,stop:int>>"


def spans_of(text: Column, pattern: str, kind: int, value: int = 0, least: int = 0) -> Column:
    """Spans of leftmost non-overlapping matches, in code points; with `least`, of those whose group `value` is that long."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(value))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["1"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + m["0"]).alias("stop"))
        keep = F.when(m["2"] >= least, F.array(span)).otherwise(F.array().cast(SPAN))
        return F.struct((start + m["0"]).alias("at"), F.concat(state["out"], keep).alias("out"))

    empty = F.array().cast(SPAN)
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def walked(found: Column) -> Column:
        zipped = F.arrays_zip(F.transform(found, F.length).alias("n"), F.slice(F.transform(gaps, F.length), 1, F.size(found)).alias("gap"), F.transform(values, F.length).alias("v"))
        return F.aggregate(F.transform(zipped, lambda m: F.struct(m["n"].alias("0"), m["gap"].alias("1"), m["v"].alias("2"))), zero, step, lambda s: s["out"])

    return F.when(F.regexp_like(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walked)).otherwise(empty)


def log_phi(z: Column) -> Column:
    """Natural logarithm of the normal distribution function, by its logistic approximation."""
    return let(z, lambda z: -F.log1p(F.exp(F.least(-(1.5976 * z + 0.07056 * z * z * z), F.lit(700.0)))))


def evidence(token: Column) -> Column:
    """-log10 of the combined probability that ordinary text of this length looks as random as the token.

    Every value that a formula names repeatedly is bound once: written out in place, they multiply to an
    expression whose analysis takes hundreds of MB of the driver.
    """
    alphabet, excess = F.lit(float(ENCODINGS[-1][1])), F.lit(ENCODINGS[-1][2])
    for pattern, symbols, delta in reversed(ENCODINGS[:-1]):
        fits = F.regexp_like(token, F.lit(pattern))
        alphabet, excess = F.when(fits, float(symbols)).otherwise(alphabet), F.when(fits, delta).otherwise(excess)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "+")
    switches = F.regexp_count(classes, F.lit(r"a+|A+|0+|[+]+")).cast("double") - 1

    def uniformity(n: Column, chars: Column) -> Column:
        """Under the hypothesis the statistic is non-central chi-squared, taken as normal."""
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))

        def deviation(alphabet: Column, shift: Column) -> Column:
            return let(alphabet - 1, lambda freedom: (alphabet * squares / n - n - freedom - shift) / F.sqrt(2 * (freedom + 2 * shift)))

        return let(alphabet, lambda symbols: let(n * excess, lambda shift: deviation(symbols, shift)))

    def correlation(n: Column, codes: Column) -> Column:
        total = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x)
        square = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x * x)
        rotated = F.concat(F.slice(codes, 2, F.size(codes) - 1), F.slice(codes, 1, 1))
        product = F.aggregate(F.zip_with(codes, rotated, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)

        def serial(total: Column) -> Column:
            return let(n * square - total * total, lambda spread: F.when(spread > 0, F.abs((n * product - total * total) / spread)).otherwise(1.0))

        return (let(total, serial) - CORRELATION) * F.sqrt(n)

    def combined(n: Column, chars: Column) -> Column:
        runs = (switches - (n - 1) * SWITCHES) / F.sqrt((n - 1) * SWITCHES * (1 - SWITCHES))
        serial = let(F.transform(chars, lambda c: F.ascii(c).cast("double")), lambda codes: correlation(n, codes))
        half = -(log_phi(uniformity(n, chars)) + log_phi(-runs) + log_phi(serial))
        return let(half, lambda half: (half - F.log(1 + half + half * half / 2)) / math.log(10.0))

    return let(F.length(token).cast("double"), lambda n: let(F.split(token, ""), lambda chars: combined(n, chars)))


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(CLASSES[1:], 1):
        out = F.when(n >= least, k).otherwise(out)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """`docs` with __base (base spans) and __tokens: array<struct<start, stop, class, bin>> of the hypotheses no base span touches."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(spans_of(text, ASSIGN, 0, 1, LEAST_VALUE), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2))
    out = docs.withColumn("__base", F.sort_array(base)).withColumn("__long", spans_of(text, TOKEN, 3))

    def judged(t: Column) -> Column:
        token = F.substring(text, t["start"] + 1, t["stop"] - t["start"])
        step = F.floor(F.greatest(let(token, evidence), F.lit(0.0)) * STEPS)
        return F.struct(t["start"].alias("start"), t["stop"].alias("stop"), length_class(t["stop"] - t["start"]).alias("class"), F.least(step, F.lit(STEPS * END)).cast("int").alias("bin"))

    free = F.filter("__long", lambda t: ~F.exists("__base", lambda b: (b["start"] < t["stop"]) & (b["stop"] > t["start"])))
    return out.withColumn("__tokens", F.transform(free, judged)).drop("__long")


def limits(scanned: DataFrame, rate: float = RATE) -> list[int]:
    """The least bin that is a discovery, per length class (one past the end where there is none).

    Counts per class and bin, a bounded table whatever the corpus, give the
    Benjamini-Hochberg rule with every probability rounded up to its bin.
    """
    counts = scanned.select(F.explode("__tokens").alias("t")).groupBy("t.class", "t.bin").count().collect()  # CLASSES x bins at most
    out = []
    for k in range(len(CLASSES)):
        bins = sorted(((r["bin"], r["count"]) for r in counts if r["class"] == k), reverse=True)
        total, above, least = sum(n for _, n in bins), 0, STEPS * END + 1
        for at, n in bins:
            above += n
            if 10.0 ** (-at / STEPS) <= rate * above / total:
                least = at
        out.append(least)
    return out


def with_spans(scanned: DataFrame, least: list[int]) -> DataFrame:
    """Add `__spans`: base spans and discoveries, by start, then kind, as array<struct<start, kind, stop>>."""
    bound = F.array(*[F.lit(x) for x in least])
    hits = F.filter("__tokens", lambda t: t["bin"] >= F.element_at(bound, t["class"] + 1))
    added = F.transform(hits, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["stop"].alias("stop")))
    return scanned.withColumn("__spans", F.sort_array(F.concat("__base", added)))


def listed(spans: str) -> Column:
    """Spans as kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def counted(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_secrets(docs: DataFrame, keep: list[str], *, rate: float = RATE) -> DataFrame:
    """Columns `keep` with base_spans and spans of every document.

    Offsets are code points, ends exclusive. A null text is empty and has no span;
    null and repeated ids and repeated rows are kept. A text's tokens are scored whole, however long. An
    empty table has no discoveries. `keep` must not name base_spans or spans.
    """
    scanned = checkpoint(scan(docs.select(*dict.fromkeys([*keep, "text"]))).select(*keep, "__base", "__tokens"))
    found = with_spans(scanned, limits(scanned, rate))
    return found.select(*keep, F.col("__base").alias("base_spans"), F.col("__spans").alias("spans"))


def redact(docs: DataFrame, *, mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """`docs` with every span of its text replaced by `mark` (overlapping spans by one) and n_chars, if present, renewed."""
    scanned = scan(docs)
    found = with_spans(scanned, limits(scanned, rate))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        piece = F.when(s["start"] >= state["at"], F.concat(gap, F.lit(mark))).otherwise("")
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.concat(state["out"], piece).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("__spans", zero, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    out = found.withColumn("text", F.when(F.size("__spans") > 0, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
