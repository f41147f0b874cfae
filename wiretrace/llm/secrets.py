"""Secret scans with a battery of randomness tests, in SQL functions only.

Base finds are fixed patterns. Beyond them, every long run of key characters is a candidate:

1. Its encoding is inferred (hexadecimal, base 32, letters and digits of one case, letters only,
   base 64), which gives the alphabet; what fits no other is tested over that of base 64.
2. Three tests ask whether it looks drawn at random from that alphabet: chi-squared for even use
   of the symbols, runs above and below the middle, serial correlation of neighbours. Their
   p-values are combined by Fisher's method.
3. Texts written by people fail. How many failures to believe is decided over the whole table by
   the Benjamini-Hochberg rule at level ``FDR``, separately for each encoding and length class
   (lengths by powers of two), since the tests' power follows the length: of the candidates
   thrown out as not random, at most that share is expected to be random after all.

Candidates that remain are spans of kind "random". The rule needs only counts of p-values in
bins of their logarithm, a table of bounded size; a bin counts with its larger edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# The patterns of the base kinds, in their order.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 8
ACCESS = "AKIA[A-Z0-9]+"
ACCESS_LEAST = 16
HEX = "[0-9a-f]{32,}"  # runs of 32 or more are what is left of all runs

KINDS = ("assign", "access", "hex", "random")
#: '=' is padding at the end only: in NAME=value it parts the two
CANDIDATE = "[A-Za-z0-9+/_-]{20,}=*"
POSSIBLE = "[A-Za-z0-9+/_-]{20}"
FDR = 0.01
BINS_A_UNIT = 16
MOST_BIN = 4000
CHUNK = 512

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding: pattern it must match, further pattern that must be found, alphabet (fixed values);
#: the first that fits, and the last fits every candidate
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", "[0-9]", "0123456789abcdef"),
    "HEX": ("^[0-9A-F]+$", "[0-9]", "0123456789ABCDEF"),
    "base32": ("^[A-Z2-7]+=*$", "[2-7]", _UPPER + "234567"),
    "base32-lower": ("^[a-z2-7]+=*$", "[2-7]", _LOWER + "234567"),
    "base36": ("^[a-z0-9]+=*$", "[0-9]", _LOWER + _DIGITS),
    "BASE36": ("^[A-Z0-9]+=*$", "[0-9]", _UPPER + _DIGITS),
    "lower": ("^[a-z]+=*$", "", _LOWER),
    "upper": ("^[A-Z]+=*$", "", _UPPER),
    "letters": ("^[A-Za-z]+=*$", "", _UPPER + _LOWER),
    "base64": ("^[A-Za-z0-9+/_-]+=*$", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", _UPPER + _LOWER + _DIGITS + "+/"),
    "general": ("^[A-Za-z0-9+/_-]+=*$", "", _UPPER + _LOWER + _DIGITS + "+/"),
}


def _before(lengths: Column) -> Column:
    """Sums of all earlier elements. In chunks, as an array grown one by one costs its square."""
    grow = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"])).alias("sums"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("sums"))
    starts = F.sequence(F.lit(0), F.greatest((F.size(lengths) - 1) / CHUNK, F.lit(0)).cast("int"))
    parts = F.transform(starts, lambda c: F.aggregate(F.slice(lengths, c * CHUNK + 1, CHUNK), zero, grow))
    base = F.aggregate(F.transform(parts, lambda p: p["sum"]), zero, grow)["sums"]
    return F.flatten(F.zip_with(base, parts, lambda b, p: F.transform(p["sums"], lambda x: x + b)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, as the variable of a lambda; used directly, the
    expression would be in the plan, and computed, once for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, pattern: str, possible: Column | None = None) -> Column:
    """array<struct<start: long, end: long, match: string>> of the leftmost non-overlapping
    matches, in code points. ``possible``: false where there is surely none."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    length = lambda s: F.coalesce(F.char_length(s), F.lit(0))

    def placed(found: Column, sizes: Column) -> Column:
        end = F.zip_with(_before(sizes), sizes, lambda a, b: a + b)
        return F.zip_with(F.slice(end, 1, F.size(found)), found, lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("match")))

    spans = _let(both, lambda p: _let(F.zip_with(p["gaps"], p["found"], lambda g, m: (length(g) + length(m)).cast("long")), lambda s: placed(p["found"], s)))
    none = F.array().cast("array<struct<start: long, end: long, match: string>>")
    return F.when(F.coalesce(possible if possible is not None else text.rlike(pattern), F.lit(False)), spans).otherwise(none)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (rational approximation 26.2.17 of Abramowitz and
    Stegun, error below 1e-7), at least 1e-12."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-12))


def battery(token: Column, alphabet: Column) -> Column:
    """Combined p-value of a token being random over an alphabet (Fisher over three tests).

    ``token`` has only characters of the alphabet and at least two of them.
    """
    size = F.char_length(alphabet).cast("double")
    symbols = F.split(alphabet, "")
    n = F.char_length(token).cast("double")
    squares = F.aggregate(F.transform(symbols, lambda s: (n - F.char_length(F.replace(token, s, F.lit("")))).cast("double")), F.lit(0.0), lambda a, c: a + c * c)
    # Wilson and Hilferty's cube root makes chi-squared nearly normal.
    df = size - 1
    chi = (F.cbrt(F.greatest(size / n * squares - n, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    values = F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double"))
    return F.when(n > 1, _let(values, lambda v: _tests(v, n, size, chi))).otherwise(F.lit(1.0))


def _tests(values: Column, n: Column, size: Column, chi: Column) -> Column:
    """One pass over neighbours: sums for the correlation, changes of side for the runs."""
    middle = (size + 1) / 2
    first = F.element_at(values, 1)
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("sum", "square", "product", "changes", "high")], first.alias("last"))
    side = lambda v: (v > middle).cast("double")

    def step(acc: Column, v: Column) -> Column:
        return F.struct(
            (acc["sum"] + v).alias("sum"), (acc["square"] + v * v).alias("square"), (acc["product"] + acc["last"] * v).alias("product"),
            (acc["changes"] + F.abs(side(acc["last"]) - side(v))).alias("changes"), (acc["high"] + side(v)).alias("high"), v.alias("last"),
        )

    def judge(acc: Column) -> Column:
        mean = acc["sum"] / n
        # the first product is the first value with itself
        cross = acc["product"] - first * first - mean * (2 * acc["sum"] - first - acc["last"]) + (n - 1) * mean * mean
        spread = F.greatest(acc["square"] - n * mean * mean, F.lit(1e-9))
        serial = F.abs(cross / spread + 1 / n) * F.sqrt(n)
        pairs = 2 * acc["high"] * (n - acc["high"])
        runs_var = F.greatest(pairs * (pairs - n) / (n * n * (n - 1)), F.lit(1e-9))
        runs = F.abs(acc["changes"] - pairs / n) / F.sqrt(runs_var)
        half = -(F.log(_tail(chi)) + F.log(F.least(2 * _tail(serial), F.lit(1.0))) + F.log(F.least(2 * _tail(runs), F.lit(1.0))))
        return F.exp(-half) * (1 + half + half * half / 2)

    return F.aggregate(values, zero, step, judge)


def _encoding(token: Column) -> Column:
    """The first encoding that a candidate fits."""
    out = F.lit(None).cast("string")
    for name, (whole, part, _) in reversed(ENCODINGS.items()):
        out = F.when(token.rlike(whole) & token.rlike(part) if part else token.rlike(whole), F.lit(name)).otherwise(out)
    return out


def _candidates(text: Column) -> Column:
    """array<struct<start, end, stratum, bin>> of the candidates."""
    alphabets = F.create_map(*[F.lit(x) for name, (_, _, letters) in ENCODINGS.items() for x in (name, letters)])

    def judged(s: Column) -> Column:
        # the alphabet of base 64 has two ways to write its last symbols
        body = F.translate(F.regexp_replace(s["match"], "=+$", ""), "-_", "+/")
        told = F.struct(body.alias("token"), _encoding(s["match"]).alias("encoding"))
        length = F.floor(F.log2((s["end"] - s["start"]).cast("double"))).cast("string")

        def result(x: Column) -> Column:
            p = _let(F.element_at(alphabets, x["encoding"]), lambda letters: battery(x["token"], letters))
            bin_ = F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * BINS_A_UNIT), F.lit(MOST_BIN)).cast("int")
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat_ws(":", x["encoding"], length).alias("stratum"), F.greatest(bin_, F.lit(0)).alias("bin"))

        return _let(told, result)

    return F.transform(find_all(text, CANDIDATE, text.rlike(POSSIBLE)), judged)


def rejected_from(counts: DataFrame, level: float = FDR) -> dict[str, int]:
    """For each stratum the smallest bin that the Benjamini-Hochberg rule throws out as not random.

    ``counts``: stratum, bin, n; at most strata times bins rows.
    """
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    ranked = counts.select("stratum", "bin", F.sum("n").over(down).alias("k"), F.sum("n").over(Window.partitionBy("stratum")).alias("m"))
    passed = ranked.where(F.exp(-F.col("bin") / BINS_A_UNIT) <= level * F.col("k") / F.col("m"))
    return {r["stratum"]: r["from"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("from")).collect()}


def find_secrets(docs: DataFrame, text_col: str = "text", level: float = FDR, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default; one called secrets is replaced) and
    ``secrets``: array<struct<start: long, kind: int, end: long>> by start, kind being a place in
    ``KINDS``. The finds are stored once, with the columns kept.

    Null and empty texts have no secrets; repeated rows stay; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = lambda spans, k: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    assigned = find_all(text, ASSIGN)
    values = F.when(text.rlike(ASSIGN), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    assigned = F.filter(F.zip_with(assigned, values, lambda s, v: F.when(F.char_length(v) >= ASSIGN_LEAST, s)), lambda s: s.isNotNull())
    access = F.filter(find_all(text, ACCESS, text.contains("AKIA")), lambda s: F.char_length(s["match"]) >= ACCESS_LEAST)
    base = F.concat(kind(assigned, 0), kind(access, 1), kind(find_all(text, HEX), 2))
    names = [c for c in (docs.columns if keep is None else keep) if c != "secrets"]
    rows = stored(docs.select(*names, F.struct(base.alias("base"), _candidates(text).alias("candidates")).alias("secrets")), "secret-candidates")
    counts = rows.select(F.explode("secrets.candidates").alias("c")).groupBy("c.stratum", "c.bin").agg(F.count("*").alias("n"))
    cuts = rejected_from(counts, level)
    limit = F.create_map(*[F.lit(v) for kv in cuts.items() for v in kv]) if cuts else F.create_map().cast("map<string, int>")
    random_ = F.filter("secrets.candidates", lambda c: c["bin"] < F.coalesce(F.try_element_at(limit, c["stratum"]), F.lit(MOST_BIN + 1)))
    return rows.withColumn("secrets", F.array_sort(F.concat("secrets.base", kind(random_, 3))))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``. Null stays null."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        # a span that begins inside the last one only lengthens it
        cut = F.concat(acc["parts"], F.array(F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], cut).otherwise(acc["parts"]).alias("parts"))

    joined = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"].cast("int") + 1, 2147483647)))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
