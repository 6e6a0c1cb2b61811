"""Secret scans with built-in functions only.

Three patterns find assignments, access keys and long hex strings. Further secrets are runs of encoding characters, at
least 20 long and outside what the patterns found, that ordinary text does not explain. The encoding is inferred from the
characters (hex, base32, base64; symbols only part groups and are passed over), and a battery of three tests asks of each
run how likely ordinary characters of that alphabet would look as random as it does:

- chi-squared uniformity: the sum of squared counts, by which the chi-squared statistic against a uniform alphabet
  orders runs, is as low as the run's;
- runs: changes between capitals, small letters and digits are as many (Chernoff's bound of the binomial);
- serial correlation: the correlation of neighbouring digits' values is as near to zero.

What ordinary text is, is counted over all documents: shares of characters, changes and correlation of neighbours within
words shorter than 20. The p-value of a run is twice the second least of the three, so two tests of the battery must
speak for randomness (partial conjunction). False discoveries are controlled (Benjamini-Hochberg) within strata of
length over the whole corpus, as short runs have little power: p-values are counted in bins, a table of fixed size,
whatever the corpus. Runs that are rejected as ordinary text are reported as `random`; runs of digits alone are numbers.

Null and empty texts have no spans; an empty table gives no rows; without ordinary text nothing is rejected. Spans are in
code points, end exclusive, by start, then kind. Ids are passed through, repeated rows are scanned alike; other columns,
whatever their names, stay in with_spans() and are not looked at; its own new column is the one named. Texts are scanned
whole; n matches in one text are placed in n to the power 1.5 steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.common import fresh

#: Kinds in the order in which spans of equal start come.
KINDS = ("assign", "access", "hex", "random")

#: The base patterns; what they match is dropped if group `group` is shorter than `least`.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a shorter run is dropped anyway and holds no longer one

#: Characters of runs, and how long a run must be to be tested; shorter ones are the words of ordinary text.
RUN_CHARACTERS = "A-Za-z0-9+/_-"
LEAST_RUN = 20
CANDIDATE = f"[{RUN_CHARACTERS}]{{{LEAST_RUN},}}"

#: Letters and digits of the encodings, each in the order of their values, and the values at which a new
#: class of characters begins.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
CLASSES = {"hex": (10, 99), "base32": (26, 99), "base64": (26, 52)}

#: The rate of changes of class that ordinary text is granted at least: names such as v2 or aB are ordinary too.
LEAST_CHANGES = 0.02

#: Lengths at which a new stratum begins.
STRATA = (20, 28, 40, 64, 128)
BINS_PER_DECADE = 10
MOST_BINS = 300


def _prefixes(xs: Column, op) -> Column:
    """For each place of an array of ints op over all before it (0 before the first), in pieces of the root of its size."""
    ints = "array<int>"

    def scan(f):
        v, k = f["v"], f["k"]
        over = lambda part: F.aggregate(part, F.lit(0), op)
        totals = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / k).cast("int") - 1), lambda c: over(F.slice(v, c * k + 1, k)))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(ints).alias("out"))
        starts = F.aggregate(totals, begin, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        bound = F.struct(v.alias("v"), k.alias("k"), starts.alias("starts"))

        def each(b):
            return F.transform(b["v"], lambda x, i: op(F.get(b["starts"], F.floor(i / b["k"]).cast("int")), over(F.slice(b["v"], i - i % b["k"] + 1, i % b["k"]))))

        return F.get(F.transform(F.array(bound), each), F.lit(0))

    facts = F.array(F.struct(xs.alias("v"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int")).alias("k")))
    return F.get(F.transform(facts, lambda f: F.when(F.size(f["v"]) == 0, F.array().cast(ints)).otherwise(scan(f))), F.lit(0))


_PLACED = "array<struct<start:int,end:int,match:string>>"


def _placed(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of a pattern's matches; starts come from the lengths between matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(matches.alias("match"), F.slice(between, 1, F.size(between) - 1).alias("gap"))

    def place(pairs):
        before = _prefixes(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["match"])), lambda a, x: a + x)
        return F.transform(F.arrays_zip(pairs.alias("p"), before.alias("b")), lambda x: F.struct(
            (x["b"] + F.length(x["p"]["gap"])).alias("start"), (x["b"] + F.length(x["p"]["gap"]) + F.length(x["p"]["match"])).alias("end"), x["p"]["match"].alias("match")
        ))

    found = F.get(F.transform(F.array(pairs), place), F.lit(0))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_PLACED))


def _spans(placed: Column, kind: int) -> Column:
    return F.transform(placed, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start,kind,end>> of the three base patterns."""
    long_value = lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 6
    assign = F.filter(_placed(text, ASSIGN), long_value)
    access = F.filter(_placed(text, ACCESS), lambda m: m["end"] - m["start"] >= 20)
    return F.concat(_spans(assign, 0), _spans(access, 1), _spans(_placed(text, HEX), 2))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal by the rational approximation of Abramowitz and Stegun 26.2.17 (fixed values)."""

    def tail(x):
        t = x["t"]
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        upper = F.exp(-x["z"] * x["z"] / 2) / math.sqrt(2 * math.pi) * poly
        return F.struct(x["z"].alias("z"), upper.alias("upper"))

    # each step is bound once, or the expression would double with every use
    bound = F.transform(F.array(z), lambda z: F.struct(z.alias("z"), (1 / (1 + 0.2316419 * F.abs(z))).alias("t")))
    return F.get(F.transform(F.transform(bound, tail), lambda x: F.when(x["z"] >= 0, x["upper"]).otherwise(1 - x["upper"])), F.lit(0))


def battery(token: Column, ordinary: dict[str, tuple[float, float, float, float]]) -> Column:
    """struct<stratum,p>: p is small where ordinary text hardly looks as random as the token; null for numbers.

    ordinary: of each encoding what ordinary_text() gives.
    """
    hexish, b32 = token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), token.rlike("^[A-Z2-7]+$")
    by_encoding = lambda of: F.when(hexish, of("hex")).when(b32, of("base32")).otherwise(of("base64"))
    alphabet = by_encoding(lambda e: F.lit(ALPHABETS[e]))
    plain = F.when(hexish, F.lower(token)).otherwise(token)
    values = F.filter(F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1), lambda v: v >= 0)
    names = ("s2", "s3", "changes", "rho")
    known = by_encoding(lambda e: F.struct(*[F.lit(float(x)).alias(c) for c, x in zip(names, ordinary[e])], *[F.lit(x).alias(f"t{k}") for k, x in enumerate(CLASSES[e])]))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    facts = F.struct(values.alias("v"), known.alias("o"), F.length(token).alias("length"))

    def classed(f):
        o = f["o"]
        kinds = F.transform(f["v"], lambda x: (x >= o["t0"]).cast("int") + (x >= o["t1"]).cast("int"))
        return F.struct(f["v"].alias("v"), o.alias("o"), f["length"].alias("length"), kinds.alias("kinds"))

    def sums(f):  # every step reads what the one before has bound, or it would be found anew for each character
        v, o, kinds = f["v"], f["o"], f["kinds"]
        n = F.size(v).cast("double")
        squares = total(F.transform(F.array_distinct(v), lambda d: F.pow(F.size(F.filter(v, lambda x: x == d)).cast("double"), F.lit(2.0))))
        turns = total(F.transform(kinds, lambda x, i: ((i > 0) & (x != F.get(kinds, i - 1))).cast("double")))
        mean = total(F.transform(v, lambda x: x.cast("double"))) / n
        return F.struct(v.alias("v"), o.alias("o"), f["length"].alias("length"), n.alias("n"), squares.alias("squares"), turns.alias("turns"), mean.alias("mean"))

    def statistics(f):
        v, o, n, mean = f["v"], f["o"], f["n"], f["mean"]
        moved = F.transform(v, lambda x: x - mean)
        pairs = n * (n - 1)
        spread = 2 / pairs * (2 * (n - 2) * (o["s3"] - o["s2"] * o["s2"]) + o["s2"] - o["s2"] * o["s2"])
        return F.struct(
            f["length"].alias("length"), n.alias("n"), o.alias("o"), ((f["squares"] - n) / pairs).alias("repeats"), spread.alias("spread"), (f["turns"] / (n - 1)).alias("x"),
            total(F.transform(moved, lambda x: x * x)).alias("var"), total(F.transform(moved, lambda x, i: F.when(i > 0, x * (F.get(v, i - 1) - mean)).otherwise(F.lit(0.0)))).alias("cross"),
        )

    def scores(f):
        o, n, x, r = f["o"], f["n"], f["x"], f["o"]["changes"]
        uniform = F.when(f["spread"] > 0, _upper_tail((o["s2"] - f["repeats"]) / F.sqrt(f["spread"]))).otherwise(F.lit(1.0))
        apart = x * F.log(x / r) + F.when(x < 1, (1 - x) * F.log((1 - x) / (1 - r))).otherwise(F.lit(0.0))
        runs = F.when(x > r, F.exp(-(n - 1) * apart)).otherwise(F.lit(1.0))
        rho = F.abs(f["cross"] / f["var"])
        serial = F.when(f["var"] > 0, F.abs(_upper_tail((-rho - o["rho"]) * F.sqrt(n)) - _upper_tail((rho - o["rho"]) * F.sqrt(n)))).otherwise(F.lit(1.0))
        return F.struct(f["length"].alias("length"), F.array_sort(F.array(uniform, runs, serial)).alias("ps"))

    def joined(f):
        return F.struct(sum((f["length"] >= s).cast("int") for s in STRATA).alias("stratum"), F.least(F.lit(1.0), 2 * F.get(f["ps"], F.lit(1))).alias("p"))

    kept = F.filter(F.array(facts), lambda f: (F.size(f["v"]) > 2) & ~token.rlike("^[0-9]+$"))
    for step in (classed, sums, statistics, scores, joined):
        kept = F.transform(kept, step)
    return F.get(kept, F.lit(0))


def ordinary_text(docs: DataFrame, text_col: str = "text") -> dict[str, tuple[float, float, float, float]]:
    """Of each encoding, over the words of all documents shorter than LEAST_RUN: sums of squares and of cubes of the
    shares of its characters, the share of neighbours that change class, and their values' correlation.

    Words are counted first, then their pairs of neighbours; some four thousand counts at most reach the driver.
    """
    words = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), f"[^{RUN_CHARACTERS}]+")).alias("word")).filter(F.length("word").between(1, LEAST_RUN - 1))
    counted = words.groupBy("word").count()
    joined = F.concat(F.lit(" "), "word")  # the blank stands before the first character
    pairs = counted.select("count", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(joined, i, F.lit(2)))).alias("pair"))
    table = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("count").alias("n")).collect()}
    out = {}
    for name, alphabet in ALPHABETS.items():
        shown = {"hex": str.lower, "base32": str.upper, "base64": str}[name]
        place = {c: i for i, c in enumerate(alphabet)}
        kind = lambda i, t=CLASSES[name]: (i >= t[0]) + (i >= t[1])
        shares, met = [0.0] * len(alphabet), []
        for pair, n in table.items():
            a, b = place.get(shown(pair[0])), place.get(shown(pair[1]))
            if b is not None:
                shares[b] += n
                if a is not None:
                    met.append((a, b, n))
        total, neighbours = sum(shares), sum(n for *_, n in met)
        if not neighbours:
            out[name] = (1.0, 1.0, 1.0, 0.0)
            continue
        mean = lambda f: sum(f(a, b) * n for a, b, n in met) / neighbours  # noqa: E731, B023
        ma, mb = mean(lambda a, b: a), mean(lambda a, b: b)
        va, vb, cov = mean(lambda a, b: (a - ma) ** 2), mean(lambda a, b: (b - mb) ** 2), mean(lambda a, b: (a - ma) * (b - mb))  # noqa: B023
        changes = max(LEAST_CHANGES, mean(lambda a, b: kind(a) != kind(b)))  # noqa: B023
        out[name] = (sum((s / total) ** 2 for s in shares), sum((s / total) ** 3 for s in shares), min(changes, 1.0), cov / math.sqrt(va * vb) if va * vb > 0 else 0.0)
    return out


@dataclass
class Calibration:
    """What ordinary text is, and of each stratum the largest p that is rejected."""

    ordinary: dict[str, tuple[float, float, float, float]]
    limits: dict[int, float]


def candidates(text: Column, base: Column, ordinary: dict) -> Column:
    """array<struct<start,kind,end,stratum,p>> of the runs outside the base spans."""
    clear = F.when((F.size(base) > 0) & text.rlike(CANDIDATE), _covered(text, F.array_sort(base), None)).otherwise(text)
    runs = F.get(F.transform(F.array(clear), lambda t: _placed(t, CANDIDATE)), F.lit(0))
    tested = F.transform(runs, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end"), battery(m["match"], ordinary).alias("t")))
    kept = F.filter(tested, lambda m: m["t"].isNotNull())
    return F.transform(kept, lambda m: F.struct(m["start"], m["kind"], m["end"], m["t"]["stratum"].alias("stratum"), m["t"]["p"].alias("p")))


def _prepared(docs: DataFrame, ordinary: dict, text_col: str, base: str, found: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_base = docs.withColumn(base, base_spans(text))
    return with_base.withColumn(found, candidates(text, F.col(base), ordinary))


def calibrate(docs: DataFrame, rate: float = 0.10, text_col: str = "text") -> Calibration:
    """Ordinary text and the limits at the false-discovery rate, from counts over all of docs.

    At most len(STRATA) x (MOST_BINS + 1) counts of p-values reach the driver.
    """
    ordinary = ordinary_text(docs, text_col)
    every = _prepared(docs.select(F.col(text_col).alias("text")), ordinary, "text", "base", "found").select(F.explode("found").alias("c"))
    place = F.least(F.lit(MOST_BINS), F.floor(-F.log10(F.greatest(F.col("c.p"), F.lit(1e-40))) * BINS_PER_DECADE)).cast("int")
    counts = every.groupBy(F.col("c.stratum").alias("stratum"), place.alias("bin")).count().collect()
    limits = {}
    for stratum in range(1, len(STRATA) + 1):
        bins = {r["bin"]: r["count"] for r in counts if r["stratum"] == stratum}
        total, below, limit = sum(bins.values()), 0, -1.0
        for b in sorted(bins, reverse=True):
            below += bins[b]
            edge = 10 ** (-b / BINS_PER_DECADE)  # all p of the bin are at most this
            if edge <= rate * below / total:
                limit = edge
        limits[stratum] = limit
    return Calibration(ordinary, limits)


def with_spans(docs: DataFrame, calibration: Calibration, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """docs with array<struct<start,kind,end>> of all secrets, sorted; kind is the place in KINDS. No shuffle."""
    base, found = fresh("secret_base", docs), fresh("secret_found", docs)

    def unlike_text(c):
        out = F.lit(False)
        for stratum, edge in calibration.limits.items():
            out = out | ((c["stratum"] == stratum) & (c["p"] <= edge))
        return out

    added = F.transform(F.filter(F.col(found), unlike_text), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return _prepared(docs, calibration.ordinary, text_col, base, found).withColumn(spans_col, F.array_sort(F.concat(F.col(base), added))).drop(base, found)


def scan_secrets(docs: DataFrame, rate: float = 0.10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_spans(rows, calibrate(rows, rate)).select("doc_id", "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _covered(text: Column, spans: Column, mark: str | None) -> Column:
    """The text with each stretch that the sorted spans cover replaced by one mark, or, without a mark, by as many
    blanks."""

    def whole(spans):
        before = _prefixes(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))

        def piece(x):
            s, at = x["s"], x["at"]
            gap = F.substr(text, at + 1, F.greatest(F.lit(0), s["start"] - at))
            if mark is None:
                return F.concat(gap, F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(at, s["start"]))))
            return F.when(s["start"] >= at, F.concat(gap, F.lit(mark))).otherwise(F.lit(""))

        pieces = F.transform(F.arrays_zip(spans.alias("s"), before.alias("at")), piece)
        return F.concat(F.array_join(pieces, ""), F.substr(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text)))

    return F.get(F.transform(F.array(spans), whole), F.lit(0))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by one mark; spans are sorted."""
    return F.when(F.size(spans) > 0, _covered(text, spans, mark)).otherwise(text)
