"""Secret scans: fixed patterns, and a randomness test battery for everything else. [native]

Patterns find assignments, access keys and hex runs. Every other long token with letters and digits
is tested. Its encoding is inferred (hex, base32, base62, base64, base64url); the battery is a
chi-squared test of alphabet uniformity, a runs test of the upper against the lower half of the
alphabet, and a lag-1 serial correlation of alphabet positions, combined by Fisher's method. A token
that the battery calls random is found if it is hex, as text is never written in that alphabet. Any
other gets a p-value under the opposite hypothesis, that its characters are as uneven as written
text: the lower tail of the same chi-squared statistic, whose mean grows with the token's length, or,
for base32, of the log-likelihood of text's letters against even ones. Those p-values are held to a false-discovery rate by Benjamini and Hochberg,
separately in strata of length, so that the many short tokens don't drown the few long ones. Their
cumulative counts come from a histogram (bounded: strata x bins), never from sorting all tokens.

All of it is built-in expressions: match offsets are prefix sums of the lengths of what ``split`` leaves
between the matches, and of the matches, taken by chunks, so a text costs time in proportion to its length.

Edge cases: a null text is empty; rows are independent, so repeated rows, null ids and extra columns
change nothing; an empty table gives an empty result. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: The pattern of each base kind, in listed order, and the least length of a match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
LEAST_VALUE, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}=*"
#: Fixed values: (name, pattern, alphabet).
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("base62", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", "^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Chance that two characters of written text are equal, over letters and over digits.
TEXT_COINCIDENCE, DIGIT_COINCIDENCE = 0.065, 0.12
ALPHA = 0.001
FDR = 0.01
#: Hex is no alphabet of words, so what the battery calls random is found.
VERDICT = "hex"
#: Share of A-Z and of each of 2-7 in capitals of written text, for base32, whose alphabet is too small for evenness to tell.
_SHARES = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.4, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.4, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.4, 2.0, 0.4, *[1.7] * 6)
_LIKELY = tuple(math.log(32 * x / sum(_SHARES)) for x in _SHARES)
_LIKELY_MEAN = sum(x * w for x, w in zip(_SHARES, _LIKELY, strict=True)) / sum(_SHARES)
#: Twice that of independent letters, as words repeat theirs.
_LIKELY_SPREAD = 2 * (sum(x * w * w for x, w in zip(_SHARES, _LIKELY, strict=True)) / sum(_SHARES) - _LIKELY_MEAN**2)
STRATA = (20, 24, 32, 48, 64)
BINS, BIN = 400, 0.05
#: Items of an array that are summed up at a time.
CHUNK = 128


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often ``use`` and its loops look at it: it is an array's one element."""
    return F.get(F.transform(F.array(value), use), 0)


def chunked(items: Column) -> Column:
    """An array cut into arrays of at most ``CHUNK``."""
    return once(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK))))


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """zero, step(zero, items[0]), ... without the last one: an array of states before each item.

    Appending copies the array, so this is for short arrays only.
    """
    start = F.struct(zero.alias("at"), F.filter(F.array(zero), lambda _: F.lit(False)).alias("out"))
    return F.aggregate(items, start, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def prefixes(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``running`` over an array of any length: by chunks, and over the chunks' totals. step must be associative with ``zero`` neutral."""

    def both(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, step))
        return F.flatten(F.zip_with(chunks, running(totals, zero, step), lambda c, at: running(c, at, step)))

    return once(chunked(items), both)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches, in code points.

    The text is split and searched once; offsets are prefix sums, so the cost is linear in the text.
    """
    kind = "array<struct<start:int,end:int,match:string>>"

    def placed(parts: Column) -> Column:
        width = F.transform(parts["found"], lambda m, i: F.length(F.get(parts["between"], i)) + F.length(m))
        ends = F.zip_with(prefixes(width, F.lit(0), lambda a, b: a + b), width, lambda a, b: a + b)
        return F.zip_with(parts["found"], ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))

    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), once(parts, placed)).otherwise(F.from_json(F.lit("[]"), kind))


def clear_of(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span, both array<struct<start, end, ...>>: a binary search each.

    A token meets a span if, of the spans that start before its end, one ends after its start.
    """

    def clear(b: Column) -> Column:
        reach = F.concat(prefixes(F.transform(b, lambda x: x["end"]), F.lit(-1), lambda x, y: F.greatest(x, y)), F.array(F.array_max(F.transform(b, lambda x: x["end"]))))

        def free(m: Column, ends: Column) -> Column:
            halve = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(b, ((s["lo"] + s["hi"]) / 2).cast("int"))["start"] < m["end"], F.struct((((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
            before = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(b) + 1)).cast("int") + 1), F.struct(F.lit(0).alias("lo"), F.size(b).alias("hi")), halve, lambda s: s["lo"])
            return F.get(ends, before) <= m["start"]

        return once(reach, lambda ends: F.filter(tokens, lambda m: free(m, ends)))

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(once(F.array_sort(base), clear))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (Abramowitz and Stegun 26.2.17), never under 1e-30."""

    def tail(x: Column) -> Column:
        a = F.least(F.abs(x), F.lit(11.0))
        poly = once(1 / (1 + 0.2316419 * a), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        return once(F.greatest(F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly, F.lit(1e-30)), lambda p: F.when(x >= 0, p).otherwise(1 - p))

    return once(z, tail)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, n, p_random (battery) and p_text (opposite hypothesis) to rows with ``token``.

    Tokens of no encoding, or of digits or letters only, get p_random 0 and p_text 1.
    """
    token = F.col("token")
    encoding = F.lit(None).cast("string")
    alphabet = F.lit(None).cast("string")
    for name, pattern, letters in reversed(ENCODINGS):
        encoding = F.when(token.rlike(pattern), name).otherwise(encoding)
        alphabet = F.when(token.rlike(pattern), letters).otherwise(alphabet)
    t = tokens.withColumn("encoding", F.when(token.rlike("[0-9]") & token.rlike("[A-Za-z]"), encoding)).withColumn("_alphabet", alphabet)
    t = t.withColumn("_body", F.regexp_replace(token, "=+$", "")).withColumn("n", F.length("_body")).withColumn("_k", F.length("_alphabet").cast("double"))
    t = t.withColumn("_at", F.transform(F.split("_body", ""), lambda c: F.instr(F.col("_alphabet"), c) - 1))
    n, k = F.col("n").cast("double"), F.col("_k")
    squares = F.aggregate(F.array_distinct("_at"), F.lit(0.0), lambda s, x: s + F.pow(F.size(F.filter("_at", lambda y: y == x)).cast("double"), F.lit(2.0)))
    t = t.withColumn("_chi", k / n * squares - n)
    t = t.withColumn("_mean", F.aggregate("_at", F.lit(0.0), lambda s, x: s + x) / n)
    high = lambda x: F.when(x * 2 >= F.col("_k"), 1.0).otherwise(0.0)
    pairs = F.zip_with(F.slice("_at", F.lit(1), F.col("n") - 1), F.slice("_at", F.lit(2), F.col("n") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    t = t.withColumn("_pairs", pairs)
    ones = F.aggregate("_at", F.lit(0.0), lambda s, x: s + high(x))
    t = t.withColumn("_ones", ones).withColumn("_runs", 1 + F.aggregate("_pairs", F.lit(0.0), lambda s, p: s + F.abs(high(p["a"]) - high(p["b"]))))
    cross = F.aggregate("_pairs", F.lit(0.0), lambda s, p: s + (p["a"] - F.col("_mean")) * (p["b"] - F.col("_mean")))
    spread = F.aggregate("_at", F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean")))
    t = t.withColumn("_r", F.try_divide(cross, spread))
    both = 2 * F.col("_ones") * (n - F.col("_ones"))
    z_runs = F.try_divide(F.col("_runs") - 1 - both / n, F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(0.0))))
    z_chi = (F.col("_chi") - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    z_serial = (F.col("_r") + 1 / n) * F.sqrt(n)
    worst = F.lit(1e-30)
    p = [upper_tail(z_chi), F.coalesce(2 * upper_tail(F.abs(z_runs)), worst), F.coalesce(2 * upper_tail(F.abs(z_serial)), worst)]
    half = -(F.ln(p[0]) + F.ln(p[1]) + F.ln(p[2]))
    t = t.withColumn("p_random", F.coalesce(F.when(F.col("encoding").isNotNull(), F.exp(-half) * (1 + half + half * half / 2)), F.lit(0.0)))
    uneven = F.when(F.col("encoding") == "hex", k * DIGIT_COINCIDENCE - 1).otherwise(k * TEXT_COINCIDENCE - 1)
    z_chi_text = (F.col("_chi") - (k - 1) - (n - 1) * uneven) / F.sqrt(2 * (k - 1) + 4 * (n - 1) * uneven)
    likely = F.aggregate("_at", F.lit(0.0), lambda s, x: s + F.get(F.array(*map(F.lit, _LIKELY)), x))
    z_text = F.when(F.col("encoding") == "base32", (likely - n * _LIKELY_MEAN) / F.sqrt(n * _LIKELY_SPREAD)).otherwise(z_chi_text)
    t = t.withColumn("p_text", F.when(F.col("p_random") >= ALPHA, upper_tail(-z_text)).otherwise(F.lit(1.0)))
    return t.drop("_alphabet", "_body", "_k", "_at", "_chi", "_mean", "_pairs", "_ones", "_runs", "_r")


def stratum(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(STRATA):
        out = F.when(n >= least, i).otherwise(out)
    return out


def thresholds(tested: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """Benjamini-Hochberg: the largest p_text that is discovered, by stratum (at most ``len(STRATA)`` rows)."""
    hist = tested.groupBy("stratum", F.least(F.floor(-F.log10("p_text") / BIN), F.lit(BINS)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    more = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    every = Window.partitionBy("stratum")
    hist = hist.withColumn("found", F.sum("c").over(more)).withColumn("m", F.sum("c").over(every))
    high = F.pow(F.lit(10.0), -F.col("bin") * BIN)  # no p-value of the bin is above it
    rows = hist.where(high <= fdr * F.col("found") / F.col("m")).groupBy("stratum").agg(F.max(high).alias("p")).collect()
    return {r["stratum"]: r["p"] for r in rows}


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, spans array<struct<start, rank, end, kind>> in order, of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    value = lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1))
    span = lambda rank: lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"))
    assign = F.transform(F.filter(matches(F.col("text"), ASSIGN), lambda m: value(m) >= LEAST_VALUE), span(0))
    access = F.transform(F.filter(matches(F.col("text"), ACCESS), lambda m: m["end"] - m["start"] >= LEAST_ACCESS), span(1))
    hexes = F.transform(matches(F.col("text"), HEX), span(2))
    rows = rows.select("doc_id", F.concat(assign, access, hexes).alias("base"), matches(F.col("text"), TOKEN).alias("tokens"))
    worth = lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]")
    rows = rows.withColumn("tokens", clear_of(F.filter("tokens", worth), F.col("base"))).withColumn("row", F.expr("uuid()"))
    rows = cut(rows, "secrets")
    each = rows.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("m")).select("row", "m.start", "m.end", F.col("m.match").alias("token"))
    tested = cut(battery(each).withColumn("stratum", stratum(F.col("n"))), "tested")
    own = F.col("encoding").eqNullSafe(VERDICT)
    found = own & (F.col("p_random") >= ALPHA)
    for k, p in thresholds(tested.where(~own), fdr).items():
        found = found | (~own & (F.col("stratum") == k) & (F.col("p_text") <= p))
    more = tested.where(found).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("rank"), "end")).alias("more"))
    out = rows.join(more, "row", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return out.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", F.coalesce("more", none))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")
