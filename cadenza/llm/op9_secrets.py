"""Secret scans with DataFrame functions only: three fixed kinds, and long tokens that a battery of randomness tests can't reject.

Fixed kinds (positions are code points of the whole text, ends exclusive): `assign`, `access` and `hex`. Kind `random`: runs of
20 or more letters, digits and + / _ = - outside assignments that are no `access` or `hex` span themselves. Each is tested, in the encoding inferred from its
characters, for uniform use of the alphabet (chi-squared), for runs above and below the alphabet's middle, and for serial
correlation; the smallest p-value times three is its p-value. The null hypothesis is "drawn at random". Within each stratum of
lengths the Benjamini-Hochberg procedure at level Q decides, over the whole corpus, which tokens are rejected as not random;
those that stay are reported. Of the rejected tokens a share of Q is random at most (that is what the procedure controls), and as it
rejects p-values up to Q times the rejected share only, which is at most Q, no random token is lost with a probability above Q.

Positions are running sums, taken in slices of CHUNK matches, so that a text of n matches costs n * CHUNK steps and not n * n.
Ranks for that procedure come from a histogram of -log10 p with a fixed number of bins, so no task sorts or holds all tokens.
Null and empty texts have no spans; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, doc_texts, read

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: An assignment, or as group 3 a token outside of one.
OUTSIDE = rf"{ASSIGN}|({TOKEN})"
CHUNK = 64
#: Share of random tokens that may be rejected; lower ends of the strata of lengths; bins for each unit of -log10 p, and their number.
Q, STRATA, BINS, TOP = 0.01, (20, 24, 32, 48, 64), 50, 1500
#: The alphabets that are told apart, smallest first: pattern, symbols in order.
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    (r"^[0-9]+$", DIGITS),
    (r"^[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", LOWER.upper() + "234567"),
    (r"^[A-Za-z0-9+/]+$", LOWER.upper() + LOWER + DIGITS + "+/"),
    (r"", LOWER.upper() + LOWER + DIGITS + "-_"),
)


def located(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches whose group has `least` characters or more.

    The text between matches and the matches alternate, so positions are running sums of both lengths.
    """
    p = F.lit(pattern)
    gaps, hits = F.split(text, p, -1), F.regexp_extract_all(text, p, F.lit(0))
    inner = F.regexp_extract_all(text, p, F.lit(group)) if group else hits
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), inner.alias("inner"))
    kind = "struct<start:bigint,end:bigint,hit:string,kept:boolean>"
    empty = F.array().cast(f"array<{kind}>")
    state = lambda at, found: F.struct(at.cast("bigint").alias("at"), found.alias("found"))

    def step(acc: Column, row: Column) -> Column:
        start = acc.at + F.length(row.gap)
        end = start + F.coalesce(F.length(row.hit), F.lit(0))
        keep = F.coalesce(F.length(row.inner) >= least, F.lit(False))
        span = F.struct(start.alias("start"), end.alias("end"), row.hit.alias("hit"), keep.alias("kept"))
        return state(end, F.array_append(acc.found, span))

    def sliced(rows: Column) -> Column:
        first = F.sequence(F.lit(1), F.size(rows), F.lit(CHUNK))
        parts = F.transform(first, lambda i: F.aggregate(F.slice(rows, i, CHUNK), state(F.lit(0), empty), step))
        ends = F.aggregate(parts, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x.at))
        return F.transform(F.arrays_zip(parts.found.alias("found"), ends.alias("begin")), lambda x: moved(x.found, x.begin))

    def moved(found: Column, begin: Column) -> Column:
        kept = F.filter(F.coalesce(found, empty), lambda s: s.kept)
        return F.transform(kept, lambda s: F.struct((s.start + begin).alias("start"), (s.end + begin).alias("end"), s.hit.alias("hit")))

    spans = F.flatten(F.flatten(F.transform(F.array(rows), sliced)))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>"))


def tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution at |z| (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = F.lit(1.0) / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2) * poly / math.sqrt(2 * math.pi)


def battery(token: Column) -> Column:
    """The p-value of a token under the hypothesis that its symbols are drawn at random from the inferred alphabet."""
    body = F.regexp_replace(token, "=+$", "")
    symbols = F.lit(ALPHABETS[-1][1])
    for pattern, letters in reversed(ALPHABETS[:-1]):
        symbols = F.when(body.rlike(pattern), F.lit(letters)).otherwise(symbols)
    seen = F.transform(F.split(body, ""), lambda c: F.instr(symbols, c) - 1)
    one = F.array(F.struct(seen.alias("v"), F.length(symbols).cast("double").alias("k"), F.greatest(F.length(body), F.lit(2)).cast("double").alias("n")))

    def tests(x: Column) -> Column:
        v, k, n = x.v, x.k, x.n
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, s: a + F.pow(F.size(F.filter(v, lambda y: y == s)), 2))
        chi = (k * squares / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        pairs = F.arrays_zip(F.slice(v, 1, F.size(v) - 1).alias("a"), F.slice(v, 2, F.size(v)).alias("b"))
        changes = F.size(F.filter(pairs, lambda y: (2 * y.a >= k) != (2 * y.b >= k)))
        runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        mid = (k - 1) / 2
        product = F.aggregate(pairs, F.lit(0.0), lambda a, y: a + (y.a - mid) * (y.b - mid))
        serial = product / (F.sqrt(n - 1) * (k * k - 1) / 12)
        upper = F.when(chi > 0, tail(chi)).otherwise(F.lit(0.5))
        return F.least(F.lit(1.0), 3 * F.least(upper, 2 * tail(runs), 2 * tail(serial)))

    return F.get(F.transform(one, tests), F.lit(0))


def stratum(length: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(STRATA):
        out = F.when(length >= least, i).otherwise(out)
    return out


def tagged(no: int):
    """A function from a span to one that says its kind, in the order in which spans are sorted."""
    return lambda x: F.struct(x.start.alias("start"), F.lit(no).alias("no"), x.end.alias("end"), F.lit(KINDS[no]).alias("kind"), x.hit.alias("hit"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of start, kind number, end, kind, hit) and tokens (array of start, end, hit, stratum, bin)."""
    found = doc_texts(docs).select(
        "doc_id",
        located(F.col("text"), ASSIGN, 2, 12).alias("assign"),
        located(F.col("text"), ACCESS).alias("access"),
        located(F.col("text"), HEX).alias("hex"),
        located(F.col("text"), OUTSIDE, 3).alias("token"),
    )
    base = F.flatten(F.array(*(F.transform(k, tagged(i)) for i, k in enumerate(KINDS[:3]))))
    free = F.array_except("token", F.concat("access", "hex"))
    held = found.select("doc_id", F.array_sort(base).alias("base"), free.alias("token"))
    tested = F.transform("token", lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), t.hit.alias("hit"), battery(t.hit).alias("p")))
    tested = held.select("doc_id", "base", tested.alias("token"))
    binned = F.transform("token", lambda t: F.struct(t.start, t.end, t.hit, t.p, stratum(t.end - t.start).alias("stratum"), F.least(F.lit(TOP), F.floor(-F.log10(F.greatest(t.p, F.lit(1e-200))) * BINS)).cast("int").alias("bin")))
    return tested.select("doc_id", "base", binned.alias("tokens"))


def rejection_bins(scanned: DataFrame, q: float = Q) -> dict[int, int]:
    """For each stratum the smallest bin that Benjamini and Hochberg's procedure rejects. At most as many rows as strata reach the driver."""
    tokens = scanned.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").count()  # bounded: strata x bins
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    whole = Window.partitionBy("stratum")
    ranked = tokens.select("stratum", "bin", F.sum("count").over(down).alias("above"), F.sum("count").over(whole).alias("all"))
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS) <= q * F.col("above") / F.col("all"))
    return {r[0]: r[1] for r in passed.groupBy("stratum").agg(F.min("bin")).collect()}


def find_secrets(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id and spans: array of (start, no, end, kind, hit) by start, then kind. The scan is kept in the checkpoint folder: one row a document, without its text."""
    scanned = cut(scan(docs))
    bins = rejection_bins(scanned, q)
    limit = lambda s: F.coalesce(*(F.when(s == i, F.lit(b)) for i, b in bins.items()), F.lit(TOP + 1))
    kept = F.filter("tokens", lambda t: t.bin < limit(t.stratum))
    extra = F.transform(kept, tagged(3))
    return scanned.select("doc_id", F.array_sort(F.concat("base", extra)).alias("spans"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.no < 3)
    count = lambda i: F.size(F.filter("spans", lambda s: s.no == i)).cast("bigint")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
