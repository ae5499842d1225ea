"""Secret scan in Spark columns only: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same places as AKIA[A-Z0-9]+ of 20 or more characters
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # the same places as [0-9a-f]+ of 24 or more characters
KINDS = ["assign", "access", "hex", "random"]
LEAST_VALUE = 6

#: What the battery looks at: whole runs of letters, digits and the marks of base 64.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
LEAST_BITS = 80
Q = 0.05
_GRID = 10_000
FLOOR = _GRID // 100
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
#: Encodings from narrow to wide: what a token must match, and its symbols in the order of their values.
ENCODINGS = [
    (r"^[0-9]+$", _DIGITS),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]*[2-7][A-Z2-7]*$", _UPPER + "234567"),
    (r"^[a-z0-9]*[0-9][a-z0-9]*$", _DIGITS + _LOWER),
    (r"^[A-Z0-9]*[0-9][A-Z0-9]*$", _DIGITS + _UPPER),
    (r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    (r"^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
]


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Starts and ends of matches from (gap, length) pairs, in blocks, so that no long array is copied at every step."""
    step = lambda s, x: F.struct((s["at"] + x["gap"] + x["length"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["length"]).alias("end")))).alias("out"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: F.slice(x, b * block + 1, F.lit(block)))

    def one(s: Column, part: Column) -> Column:
        added = lambda inner: F.struct(inner["at"].alias("at"), F.concat(s["out"], F.array(inner["out"])).alias("out"))
        return _bound(F.aggregate(part, F.struct(s["at"].alias("at"), empty.alias("out")), step), added)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:bigint,end:bigint>>>").alias("out"))
    return F.flatten(F.aggregate(_bound(lengths, blocks), start, one)["out"])


def places(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start, end, token>> of a pattern's leftmost matches, in code points; ``found`` are the matches.

    What stands between matches comes from splitting at them, so positions are sums of lengths. Only texts with a
    match are split."""
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("token")), lambda z: z["token"].isNotNull())
    lengths = F.transform(pairs, lambda z: F.struct(F.char_length(z["gap"]).cast("long").alias("gap"), F.char_length(z["token"]).cast("long").alias("length")))
    spans = F.transform(F.arrays_zip(_prefix_sums(lengths).alias("p"), found.alias("m")), lambda z: F.struct(z["p"]["start"].alias("start"), z["p"]["end"].alias("end"), z["m"].alias("token")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,token:string>>"))


def _above(z: Column) -> Column:
    """Chance of a normal number above z, to 1e-7 (a rational approximation of the normal integral)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.lit(0.3989422804014327) * F.exp(-z * z / 2) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(tokens: Column) -> Column:
    """Tokens with their encoding, and the chance that symbols drawn evenly and independently look less random.

    Chi-squared of the symbols' counts (its moments are those of n draws, its shape is Wilson and Hilferty's), runs of
    symbols of the upper and lower half, and products of neighbouring symbols; Fisher's sum joins the three.
    """
    body = lambda s: F.translate(F.rtrim(s["token"], F.lit("=")), "-_", "+/")
    coded = F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), body(s).alias("body")))

    def alphabet(s: Column) -> Column:
        chosen = F.when(s["body"].rlike(ENCODINGS[0][0]), F.lit(ENCODINGS[0][1]))
        for pattern, symbols in ENCODINGS[1:]:
            chosen = chosen.when(s["body"].rlike(pattern), F.lit(symbols))
        return chosen

    coded = F.transform(coded, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body"), alphabet(s).alias("symbols"), F.char_length(s["body"]).cast("double").alias("n")))
    coded = F.transform(coded, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "body", "symbols", "n")], F.char_length(s["symbols"]).cast("double").alias("m")))
    coded = F.filter(coded, lambda s: s["symbols"].isNotNull() & (s["n"] * F.log2(s["m"]) >= LEAST_BITS))

    def sums(s: Column) -> Column:
        chars = F.filter(F.split(s["body"], ""), lambda c: c != "")
        times = lambda c: s["n"] - F.char_length(F.replace(s["body"], c, F.lit("")))
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + times(c) * times(c))
        value = lambda c: F.call_function("instr", s["symbols"], c) - 1 - (s["m"] - 1) / 2
        values = F.transform(chars, value)
        begin = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("products"), F.lit(1.0).alias("runs"))
        step = lambda a, x: F.struct(x.alias("last"), (a["products"] + F.coalesce(a["last"] * x, F.lit(0.0))).alias("products"), (a["runs"] + F.when((a["last"] > 0) != (x > 0), 1.0).otherwise(0.0)).alias("runs"))
        walked = F.aggregate(values, begin, step)
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "body", "n", "m")], squares.alias("squares"), walked.alias("w"))

    def scores(s: Column) -> Column:
        n, m = s["n"], s["m"]
        k = (m - 1) * n / (n - 1)
        chi = ((F.pow((s["squares"] * m / n - n) / (m - 1), F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))).alias("chi")
        runs = ((s["w"]["runs"] - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4)).alias("runs")
        serial = (s["w"]["products"] / ((m * m - 1) / 12) / F.sqrt(n - 1)).alias("serial")
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "body", "n", "m")], chi, runs, serial)

    least = lambda p: F.greatest(p, F.lit(1e-7))
    fisher = lambda s: -2 * (F.log(least(_above(s["chi"]))) + F.log(least(2 * _above(F.abs(s["runs"])))) + F.log(least(2 * _above(F.abs(s["serial"])))))
    scored = F.transform(F.transform(coded, sums), scores)
    scored = F.transform(scored, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "body", "n")], fisher(s).alias("t")))
    chance = lambda t: F.exp(-t / 2) * (1 + t / 2 + t * t / 8)
    band = lambda s: F.floor(2 * F.log2(s["n"])).cast("int")
    return F.transform(scored, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body"), band(s).alias("band"), F.ceil(chance(s["t"]) * _GRID).cast("int").alias("p")))


def _limits(tested: DataFrame, q: float) -> dict[int, int]:
    """For every band of lengths, up to which p (in parts of the grid) tokens count as not random.

    Random tokens have evenly spread p, others small ones. So twice the tokens with p above one half (and one more, for
    small tables) estimate the random ones, and the limit is the least one, from ``FLOOR`` on, at which the tokens above
    it hold a share of at most ``q`` more than the random ones expected there. Each different token of the whole table
    counts once. One row a band (two for each doubling of the length) comes back.
    """
    tokens = tested.select(F.explode("tokens").alias("t")).select("t.body", "t.band", "t.p").distinct()
    counts = tokens.groupBy("band", "p").agg(F.count("*").alias("k"))
    ends = counts.select("band", F.explode(F.array(F.lit(FLOOR), F.lit(_GRID // 2))).alias("p"), F.lit(0).cast("long").alias("k")).distinct()
    counts = counts.union(ends).groupBy("band", "p").agg(F.sum("k").alias("k"))
    after = Window.partitionBy("band").orderBy("p").rowsBetween(1, Window.unboundedFollowing)
    steps = counts.withColumn("above", F.coalesce(F.sum("k").over(after), F.lit(0)))
    random = 2 * (F.sum(F.when(F.col("p") > _GRID // 2, F.col("k")).otherwise(0)).over(Window.partitionBy("band")) + 1)
    steps = steps.withColumn("random", random).where(F.col("p").between(FLOOR, _GRID // 2))
    fits = F.col("above") - F.col("random") * (1 - F.col("p") / _GRID) <= q * F.col("above")
    return {r["band"]: r["p"] for r in steps.where(fits).groupBy("band").agg(F.min("p").alias("p")).collect()}


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), q: float = Q) -> DataFrame:
    """(keep, spans): every secret of each row's whole text; spans are array<struct<start, kind, end>> by start and kind.

    ``assign``, ``access`` and ``hex`` are leftmost matches of fixed patterns. The battery adds ``random``: runs of 20 or
    more symbols outside these matches, of 80 bits or more in the narrowest encoding they fit, which its tests do not
    tell from evenly drawn symbols. How small a chance tells them apart is set for each band of lengths, so that of the
    spans added at most ``q`` are expected not to be random: short tokens are not judged by long ones.
    Letters of one case alone are in no encoding, and so never random.

    Every row gives one row: nulls (text or id) and empty texts have no spans, repeated rows repeat, an empty table gives
    none, further columns go. Nothing leaves its row but different tokens with their p, counted for the limits.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    columns = [F.col(c) for c in keep]
    found = docs.select(
        *columns,
        body.alias("body"),
        F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(0)).alias("a"),
        F.when(F.contains(body, F.lit("AKIA")), F.regexp_extract_all(body, F.lit(ACCESS), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("k"),
        F.regexp_extract_all(body, F.lit(HEX), F.lit(0)).alias("h"),
        F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)).alias("c"),
    )
    long_enough = lambda s: F.char_length(F.regexp_extract(s["token"], ASSIGN, 1)) >= LEAST_VALUE
    named = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    base = F.concat(
        named(F.filter(places(F.col("body"), ASSIGN, F.col("a")), long_enough), 0),
        named(places(F.col("body"), ACCESS, F.col("k")), 1),
        named(places(F.col("body"), HEX, F.col("h")), 2),
    )
    outside = lambda s, spans: ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = found.select(*keep, base.alias("base"), places(F.col("body"), CANDIDATE, F.col("c")).alias("c"))
    rows = rows.select(*keep, "base", _battery(F.filter("c", lambda s: outside(s, F.col("base")))).alias("tokens"))
    tested = stage(rows, "secrets")
    limits = _limits(tested, q)
    random = F.filter("tokens", lambda s: s["p"] > _limit_of(s["band"], limits))
    spans = F.array_sort(F.concat("base", named(random, 3)))
    back = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["end"].alias("end")))
    return tested.select(*keep, back.alias("spans"))


def _limit_of(band: Column, limits: dict[int, int]) -> Column:
    chosen = F.when(F.lit(False), F.lit(-1))
    for number, p in sorted(limits.items()):
        chosen = chosen.when(band == number, F.lit(p))
    return chosen.otherwise(F.lit(-1))
