"""Secret scan: fixed patterns plus a battery of randomness tests, in native expressions only.

Base spans are the leftmost non-overlapping matches of three patterns, from the start to the end
of the whole match in code points: keyed assignments, access keys and long hex strings. The battery
looks at every maximal run of 16 or more token characters. The run's encoding is inferred from its
alphabet, and three statistics are taken over it:

* chi-squared of its symbols against a uniform draw from the encoding's alphabet;
* the number of changes of character class (digits, upper, lower, signs): the runs test;
* the lag-1 serial correlation of its symbols' ordinals.

They are read twice, each time combined by Fisher's method. Against randomness (uniform symbols,
independent of each other; two-sided) a run that fails at RANDOM_LEVEL, such as an alphabet or a
counter, is no secret. Against ordinary text (chi-squared not central, as such text repeats its
symbols; few changes of class; serial correlation of either sign) the combined p-value says how
surely a run isn't ordinary. Weighted Benjamini-Hochberg over all runs of the table controls the
rate of false discoveries at FDR; a run's weight is its length over the mean length, as long runs
have more power. Ranks come from a histogram of -ln(p / weight) in a fixed number of bins
(conservative within a bin), never from a global sort. Discoveries that overlap no base span are
added as kind `random`.

Null and empty texts have no spans. Each row is judged alone, so repeated rows repeat their
result. An empty table gives no rows. Ties in start are ordered by kind as listed in KINDS.
Columns of the input other than those asked for are ignored or passed through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

KINDS = ("assign", "access", "hex", "random")
#: The three base patterns. Lengths are part of a pattern only where that changes no match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ASSIGN_VALUE = 6
FDR, RANDOM_LEVEL = 0.001, 1e-4
#: -ln(p / weight) is ranked in BINS bins of width 1 / BIN_SCALE.
BINS, BIN_SCALE = 8192, 16
_BLOCK = 256

_LOWER, _UPPER, _DIGITS, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-"
_SYMBOLS = _DIGITS + _UPPER + _LOWER + _SIGNS
_CLASSES = "d" * 10 + "u" * 26 + "l" * 26 + "s" * 5
#: Encoding: pattern, symbols of its alphabet, chance that two neighbours of a random run differ in class;
#: coincidence rate and rate of class changes of ordinary runs (1: all of one class, so there is nothing to test).
ENCODINGS = (
    ("decimal", "^[0-9]+$", 10, 0.0, 0.14, 1.0),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 16, 0.469, 0.12, 0.12),
    ("base32", "^[A-Z2-7]+=*$", 32, 0.305, 0.070, 0.12),
    ("base36", "^[0-9a-z]+$", 36, 0.401, 0.065, 0.12),
    ("base62", "^[0-9A-Za-z]+$", 62, 0.622, 0.065, 0.15),
    ("base64", "", 64, 0.643, 0.060, 0.25),
)
#: Deviation of the serial correlation of ordinary text, beside that of a finite run.
ORDINARY_SERIAL = 0.3


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(df: DataFrame, kind: str, pattern: str) -> DataFrame:
    """Column `kind`: array of (start, end, match) of all leftmost non-overlapping matches of a pattern in _t."""
    lens = f"_{kind}_lens"
    piece, hit = _sql(rf"(?s)\G.*?(?:{pattern})"), _sql(rf"(?s)\G.*?({pattern})")
    df = df.withColumn(f"_{kind}_p", F.expr(f"CASE WHEN _t RLIKE {_sql(pattern)} THEN regexp_extract_all(_t, {piece}, 0) ELSE CAST(array() AS array<string>) END"))
    df = df.withColumn(lens, F.expr(f"transform(_{kind}_p, x -> CAST(length(x) AS bigint))"))
    df = df.withColumn(f"_{kind}_m", F.expr(f"CASE WHEN size(_{kind}_p) > 0 THEN regexp_extract_all(_t, {hit}, 1) ELSE CAST(array() AS array<string>) END"))
    # sums up to each block, then within it: no array is walked once per match
    upto = f"aggregate(transform(sequence(0, (size({lens}) - 1) DIV {_BLOCK}), b -> aggregate(slice({lens}, b * {_BLOCK} + 1, {_BLOCK}), 0L, (a, x) -> a + x)), array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    ends = f"""CASE WHEN size({lens}) = 0 THEN CAST(array() AS array<bigint>) ELSE element_at(transform(array({upto}), u -> flatten(transform(sequence(0, (size({lens}) - 1) DIV {_BLOCK}), b ->
        slice(aggregate(slice({lens}, b * {_BLOCK} + 1, {_BLOCK}), array(u[b]), (a, x) -> concat(a, array(element_at(a, -1) + x))), 2, {_BLOCK})))), 1) END"""
    df = df.withColumn(f"_{kind}_e", F.expr(ends))
    df = df.withColumn(kind, F.expr(f"transform(_{kind}_m, (m, i) -> struct(_{kind}_e[i] - length(m) AS start, _{kind}_e[i] AS end, m AS m))"))
    return df.drop(f"_{kind}_p", lens, f"_{kind}_m", f"_{kind}_e")


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable, by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    a = F.abs(z)
    t = 1 / (1 + a * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    p = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.greatest(F.when(z >= 0, p).otherwise(1 - p), F.lit(1e-300))


def _once(value: Column, function) -> Column:
    """function(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _statistics(m: Column, n: Column) -> Column:
    """chi (chi-squared against the alphabet), changes (of class), serial (correlation), k, q, kappa and rate of a run m of n symbols."""

    def pick(place: int) -> Column:
        chosen = F.lit(float(ENCODINGS[-1][place]))
        for e in reversed(ENCODINGS[:-1]):
            chosen = F.when(m.rlike(e[1]), F.lit(float(e[place]))).otherwise(chosen)
        return chosen

    symbols = F.split(m, "")
    squares = F.aggregate(F.array_distinct(symbols), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(m, c, F.lit(""))), F.lit(2)))
    changes = F.length(F.regexp_replace(F.translate(m, _SYMBOLS, _CLASSES), r"(.)\1*", "$1")) - 1
    sums = F.aggregate(
        F.transform(symbols, lambda c: F.instr(F.lit(_SYMBOLS), c).cast("double")),
        F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("t2"), F.lit(0.0).alias("tt"), F.lit(-1.0).alias("first"), F.lit(0.0).alias("last")),
        lambda a, x: F.struct((a.t + x).alias("t"), (a.t2 + x * x).alias("t2"), (a.tt + F.when(a["first"] < 0, 0.0).otherwise(a["last"] * x)).alias("tt"), F.when(a["first"] < 0, x).otherwise(a["first"]).alias("first"), x.alias("last")),
    )
    mean = lambda s: s.t / n
    over = lambda s: s.tt - mean(s) * (2 * s.t - s["first"] - s["last"]) + (n - 1) * mean(s) * mean(s)
    under = lambda s: s.t2 - n * mean(s) * mean(s)
    serial = _once(sums, lambda s: F.when(under(s) > 0, over(s) / under(s)).otherwise(1.0))
    facts = F.struct(squares.alias("squares"), changes.cast("double").alias("changes"), serial.alias("serial"), *(pick(k).alias(c) for k, c in ((2, "k"), (3, "q"), (4, "kappa"), (5, "rate"))))
    return _once(facts, lambda s: F.struct((s.k * s.squares / n - n).alias("chi"), s.changes.alias("changes"), s.serial.alias("serial"), s.k.alias("k"), s.q.alias("q"), s.kappa.alias("kappa"), s.rate.alias("rate")))


def _fisher(*p: Column) -> Column:
    """Fisher's combination of three p-values."""
    half = -(F.log(p[0]) + F.log(p[1]) + F.log(p[2]))
    return F.exp(-half) * (1 + half + half * half / 2)


def _p_value(m: Column, n: Column) -> Column:
    """That a run m of n symbols is ordinary text; 1 where it isn't random either."""

    def random(s: Column) -> Column:
        sides = lambda z: F.least(2 * _upper_tail(F.abs(z)), F.lit(1.0))
        chi = (s.chi - (s.k - 1)) / F.sqrt(2 * (s.k - 1) * (n - 1) / n)
        changes = F.when(s.q > 0, sides((s.changes - s.q * (n - 1)) / F.sqrt((n - 1) * F.greatest(s.q * (1 - s.q), F.lit(0.01))))).otherwise(1.0)
        return _fisher(sides(chi), changes, sides(s.serial * F.sqrt(n)))

    def ordinary(s: Column) -> Column:
        spread = s.k * (n - 1) * F.sqrt(1.2 * s.kappa * s.kappa / n + 2 * s.kappa / (n * n))
        chi = _upper_tail((s.k * (n - 1) * s.kappa + s.k - n - s.chi) / spread)
        changes = F.when(s.rate < 1, _upper_tail((s.changes - 0.5 - s.rate * (n - 1)) / F.sqrt((n - 1) * s.rate * (1 - F.least(s.rate, F.lit(0.99)))))).otherwise(1.0)
        serial = F.greatest(1 - 2 * _upper_tail(F.abs(s.serial) / F.sqrt(1 / n + ORDINARY_SERIAL**2)), F.lit(0.01))
        return F.greatest(_fisher(chi, changes, serial), F.lit(1e-300))

    return _once(_statistics(m, n), lambda s: F.when(random(s) < RANDOM_LEVEL, F.lit(1.0)).otherwise(ordinary(s)))


def with_matches(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `_base` (kind, start, end in order) and `_runs` (start, end, n, p) of every whole text."""
    df = docs.withColumn("_t", text_or_empty(text))
    for kind, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX), ("_token", TOKEN)):
        df = _found(df, kind, pattern)
    df = df.withColumn("_assign", F.expr(f"filter(_assign, x -> length(regexp_extract(x.m, {_sql(ASSIGN)}, 1)) >= {ASSIGN_VALUE})"))
    listed = ", ".join(f"transform(_{k}, x -> struct(x.start AS start, {i} AS rank, x.end AS end))" for i, k in enumerate(KINDS[:3]))
    df = df.withColumn("_base", F.expr(f"array_sort(concat({listed}))"))
    runs = F.transform("_token", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), (x.end - x.start).alias("n"), _p_value(x.m, (x.end - x.start).cast("double")).alias("p")))
    df = df.withColumn("_runs", F.when(F.size("_token") > 0, runs).otherwise(F.expr("CAST(array() AS array<struct<start:bigint,end:bigint,n:bigint,p:double>>)")))
    return df.withColumn("_counts", F.struct(*(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]))).drop("_t", "_assign", "_access", "_hex", "_token")


def discovery_limit(matched: DataFrame, fdr: float = FDR) -> tuple[float, float]:
    """(mean run length, the largest p / weight that counts) by weighted Benjamini-Hochberg; -1 if none does."""
    runs = matched.select(F.explode_outer("_runs").alias("r")).select("r.n", "r.p").where("n IS NOT NULL")
    bins = F.least(F.greatest(F.floor(-F.log(F.col("p") / F.col("n")) * BIN_SCALE) + BINS // 4, F.lit(0)), F.lit(BINS - 1))
    # p / n is binned first; the mean length only shifts it
    rows = runs.groupBy(bins.alias("bin")).agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.max(F.col("p") / F.col("n")).alias("top")).collect()
    m = sum(r.c for r in rows)
    if not m:
        return 1.0, -1.0
    mean = sum(r.n for r in rows) / m
    seen, limit = 0, -1.0
    for r in sorted(rows, key=lambda r: -r.bin):
        seen += r.c
        if r.top * mean <= fdr * seen / m:
            limit = r.top * mean
    return mean, limit


def with_spans(matched: DataFrame, mean: float, limit: float) -> DataFrame:
    """Adds `_spans`: base spans and discoveries (start, rank, end), in order."""
    new = F.transform(
        F.filter("_runs", lambda x: (x.p / x.n * mean <= limit) & ~F.exists("_base", lambda b: (b.start < x.end) & (x.start < b.end))),
        lambda x: F.struct(x.start.alias("start"), F.lit(3).alias("rank"), x.end.alias("end")),
    )
    return matched.withColumn("_spans", F.array_sort(F.concat("_base", new)))


def _written(spans: str) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["rank"]), x.start.cast("string"), x.end.cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, and n_random."""
    matched = materialize(with_matches(docs.select("doc_id", "text")).select("doc_id", "_base", "_runs", "_counts"), "secrets")
    found = with_spans(matched, *discovery_limit(matched))
    return found.select(
        "doc_id", "_counts.*", F.sha2(_written("_base"), 256).alias("base_sha256"), _written("_spans").alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of the scan replaced by the mask; overlapping spans are masked once."""
    given = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")) if len(docs.columns) > 1 else docs.select("text")
    matched = materialize(with_matches(given).drop("_counts"), "secrets")  # the patterns run once for both reads
    found = with_spans(matched, *discovery_limit(matched))
    clean = f"""CASE WHEN size(_spans) = 0 THEN text ELSE aggregate(_spans, struct(0L AS at, '' AS done),
        (a, s) -> struct(greatest(a.at, s.end) AS at, CASE WHEN s.start >= a.at THEN concat(a.done, substring(text, CAST(a.at + 1 AS int), CAST(s.start - a.at AS int)), {_sql(mask)}) ELSE a.done END AS done),
        a -> concat(a.done, substring(text, CAST(a.at + 1 AS int)))) END"""
    found = found.withColumn("text", F.expr(clean))
    return found.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
