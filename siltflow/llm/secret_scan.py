"""Secret scans by a battery of randomness tests, in DataFrame functions alone.

Spans of the fixed patterns are always reported. Beside them every long token that mixes letters and digits is tested: its encoding is
inferred (hexadecimal, base 32, base 36 or base 64), and three statistics measure how far it is from uniform random characters: chi-squared
over the alphabet, the number of runs of the alphabet's halves, and the serial correlation of neighbours. The last two become tail
probabilities under randomness. Chi-squared becomes the probability of so even a token if it were prose (its non-central distribution, whose
shift grows with the length, so that longer tokens carry more evidence), times the chance that prose keeps to the alphabet; a token that the
other two tests find not random has the probability 1. A token is reported if its probability passes the Benjamini-Hochberg bound over all
tested tokens, those that the other tests reject among them.

Arrays are never grown element by element: running sums and maxima double their reach step by step, so a text costs time in proportion to its
length and the logarithm of its matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import only, written

# The patterns of the base kinds. A match of access or hex that is too short is part of no longer one, so their least lengths
# are written into the patterns; assign's is checked afterwards, as a failing match still takes its text.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORD = r"(?i)password|passwd|secret|token|api_?key"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")
#: Tested tokens: maximal runs of these characters, this long at least, with a letter and a digit.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Expected share of false reports among the tested tokens' reports; tail probability below which a test rejects randomness.
FDR, TAIL = 0.01, 0.001
#: Chance that two characters of prose are alike, and that one is a hexadecimal digit.
PROSE_MATCH, PROSE_HEX = 0.066, 0.35
#: The false-discovery bound is evaluated at this many steps of a twentieth of a decade, however many tokens there are.
STEPS = 4000

_SPAN = "array<struct<start:int,end:int,size:int,found:string>>"


def running(values: Column, join, back: bool = False) -> Column:
    """At each place of the array the values up to it joined (from it on, if back), by an associative function of two columns."""
    places = F.size(values)
    steps = F.when(places > 1, F.transform(F.sequence(F.lit(0), F.ceil(F.log2(places)).cast("int") - 1), lambda k: F.expr("1") * F.pow(F.lit(2), k).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))

    def reach(acc: Column, step: Column) -> Column:
        other = lambda i: F.get(acc, i + step if back else i - step)
        inside = (lambda i: i + step < F.size(acc)) if back else (lambda i: i >= step)
        return F.transform(acc, lambda x, i: F.when(inside(i), join(x, other(i))).otherwise(x))

    return F.aggregate(steps, values, reach)


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, size, found>> of the leftmost non-overlapping matches, in code points; size is the length of the pattern's
    group, found the match."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    sizes = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)) if group else whole
    gaps = F.split(text, pattern, -1)  # one more than matches
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("found"), sizes.alias("part"))
    rows = F.transform(rows, lambda x: F.struct((F.char_length(x["gap"]) + F.char_length(x["found"])).alias("end"), F.char_length(x["found"]).alias("len"), F.char_length(x["part"]).alias("size"), x["found"].alias("found")))
    # the first steps' result is bound once, then its ends are summed up
    ends = F.transform(F.array(rows), lambda r: F.arrays_zip(r.alias("r"), running(F.transform(r, lambda x: x["end"]), lambda a, b: a + b).alias("end")))[0]
    return F.transform(ends, lambda x: F.struct((x["end"] - x["r"]["len"]).alias("start"), x["end"].alias("end"), x["r"]["size"].alias("size"), x["r"]["found"].alias("found")))


def outside(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span. Both are sorted by start; tokens don't overlap one another."""
    mark = lambda x, kind, found: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), found.alias("found"))
    every = F.array_sort(F.concat(F.transform(base, lambda b: mark(b, 0, F.lit(None).cast("string"))), F.transform(tokens, lambda t: mark(t, 1, t["found"]))))

    def free(every: Column) -> Column:
        before = running(F.transform(every, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(-1)), F.greatest)
        after = running(F.transform(every, lambda x: F.when(x["kind"] == 0, x["start"]).otherwise((1 << 31) - 1)), F.least, back=True)
        rows = F.arrays_zip(every.alias("x"), before.alias("before"), after.alias("after"))
        kept = F.filter(rows, lambda r: (r["x"]["kind"] == 1) & (r["before"] <= r["x"]["start"]) & (r["after"] >= r["x"]["end"]))
        return F.transform(kept, lambda r: F.struct(r["x"]["start"].alias("start"), r["x"]["end"].alias("end"), r["x"]["found"].alias("token")))

    return F.transform(F.array(every), free)[0]


def _spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, by a logistic approximation (absolute error under 0.0002)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070566 * z * z * z)))


def _log_lower(z: Column) -> Column:
    """ln P(Z < z): the same approximation, and its asymptote far below."""
    return F.when(z < -4, -z * z / 2 - F.log(-z * math.sqrt(2 * math.pi))).otherwise(F.log(1 / (1 + F.exp(F.least(F.lit(700.0), -(1.5976 * z + 0.070566 * z * z * z))))))


def battery(tokens: DataFrame, token: str = "token") -> DataFrame:
    """tokens with k (alphabet size), chi2, p_runs, p_serial and log_p (natural logarithm of the prose probability) added. A token of any length
    takes time in proportion to it."""
    t = F.col(token)
    kind = F.when(t.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 16).when(t.rlike("^[A-Z2-7]+$"), 32).when(t.rlike("^[a-z0-9]+$|^[A-Z0-9]+$"), 36).otherwise(64)
    alphabet = F.when(F.col("k") == 64, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")).when(F.col("k") == 32, F.lit("abcdefghijklmnopqrstuvwxyz234567")).otherwise(F.lit("0123456789abcdefghijklmnopqrstuvwxyz"))
    plain = F.when(F.col("k") == 64, F.translate(t, "-_", "+/")).otherwise(F.lower(t))
    out = tokens.withColumn("k", kind).withColumn("_alphabet", alphabet).withColumn("_plain", plain)
    out = out.withColumn("_v", F.expr("transform(regexp_extract_all(_plain, '(?s).', 0), c -> cast(instr(_alphabet, c) - 1 as double))"))
    n = F.size("_v").cast("double")
    out = out.withColumn("_n", n).withColumn("_same", F.expr("aggregate(sequence(1, k), 0D, (a, i) -> a + pow(char_length(_plain) - char_length(replace(_plain, substring(_alphabet, i, 1), '')), 2))"))
    out = out.withColumn("chi2", F.col("k") * F.col("_same") / F.col("_n") - F.col("_n"))
    out = out.withColumn("_n1", F.expr("aggregate(_v, 0D, (a, x) -> a + if(x >= k / 2, 1, 0))"))
    # sums over neighbours carry the value before
    runs = "aggregate(_v, named_struct('n', 0D, 'up', cast(null as boolean)), (a, x) -> named_struct('n', a.n + if(a.up <=> (x >= k / 2), 0, 1), 'up', x >= k / 2), a -> a.n)"
    out = out.withColumn("_runs", F.expr(runs))
    out = out.withColumn("_mean_runs", 2 * F.col("_n1") * (F.col("_n") - F.col("_n1")) / F.col("_n") + 1)
    sd = F.sqrt((F.col("_mean_runs") - 1) * (F.col("_mean_runs") - 2) / (F.col("_n") - 1))
    out = out.withColumn("p_runs", F.when((F.col("_mean_runs") <= 2), F.lit(0.0)).otherwise(2 * _tail(F.abs(F.col("_runs") - F.col("_mean_runs")) / sd)))
    out = out.withColumn("_mean", F.expr("aggregate(_v, 0D, (a, x) -> a + x) / _n"))
    out = out.withColumn("_var", F.expr("aggregate(_v, 0D, (a, x) -> a + pow(x - _mean, 2))"))
    out = out.withColumn("_cov", F.expr("aggregate(_v, named_struct('s', 0D, 'd', 0D), (a, x) -> named_struct('s', a.s + a.d * (x - _mean), 'd', x - _mean), a -> a.s)"))
    r = F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var")).otherwise(1.0)
    out = out.withColumn("p_serial", 2 * _tail(F.abs(r) * F.sqrt("_n")))
    shift = F.greatest(F.lit(0.1), F.col("k") * PROSE_MATCH - 1) * F.col("_n")
    z = (F.col("chi2") - (F.col("k") - 1 + shift)) / F.sqrt(2 * (F.col("k") - 1 + 2 * shift))
    stay = F.when(F.col("k") == 16, F.col("_n") * math.log(PROSE_HEX)).otherwise(0.0)
    out = out.withColumn("log_p", _log_lower(z) + stay)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def discovery_bound(tested: DataFrame, fdr: float = FDR) -> float:
    """The largest step t of log_p with tests * exp(t) <= fdr * (tests with log_p <= t), or minus infinity: Benjamini and Hochberg's rule
    on a fixed grid, over all rows of tested. Only counts by step, STEPS at most, reach the driver."""
    width = math.log(10) / 20
    step = F.least(F.lit(STEPS), F.greatest(F.lit(0), F.floor(-F.col("log_p") / width))).cast("int")
    rows = {r[0]: r[1] for r in tested.groupBy(step.alias("s")).count().collect()}
    m, seen, best = sum(rows.values()), 0, -math.inf
    for s in sorted(rows, reverse=True):
        seen += rows[s]
        if m * math.exp(-s * width) <= fdr * seen:
            best = -s * width
    return best


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, base, added) for each row of docs: arrays of struct<start, k, kind, end>, in code points, end exclusive, ordered by start and
    kind. base: the fixed patterns' spans. added: tokens that look random, outside all base spans.

    Null and empty texts have empty arrays; repeated rows stay; an empty table gives an empty one. Whole texts are scanned.
    """
    text = F.col("text")
    none = F.expr(f"cast(array() as {_SPAN})")
    gate = lambda yes, found: F.when(yes, found).otherwise(none)
    found = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = found.select(
        "doc_id",
        "text",
        gate(text.rlike(KEYWORD), F.filter(find(text, ASSIGN, 2), lambda x: x["size"] >= ASSIGN_LEAST)).alias("assign"),
        gate(text.contains("AKIA"), find(text, ACCESS)).alias("access"),
        gate(text.rlike(HEX), find(text, HEX)).alias("hex"),
        gate(text.rlike(TOKEN), find(text, TOKEN)).alias("token"),
    )
    base = F.array_sort(F.concat(*[_spans(k, F.col(k)) for k in KINDS[:3]]))
    mixed = F.filter("token", lambda t: t["found"].rlike("[0-9]") & t["found"].rlike("[A-Za-z]"))
    found = found.withColumn("base", base).withColumn("token", mixed).select("doc_id", "base", outside(F.col("token"), F.col("base")).alias("tokens"))
    # a row number of its own for each row, as doc_id may repeat or be null
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "spans")
    each = found.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t")).select("row", "t.start", "t.end", "t.token")
    tested = written(battery(each).withColumn("log_p", F.when((F.col("p_runs") >= TAIL) & (F.col("p_serial") >= TAIL), F.col("log_p")).otherwise(0.0)), "tested")
    passed = tested.where(F.col("log_p") <= F.lit(discovery_bound(tested, fdr)))
    span = F.struct("start", F.lit(KINDS.index("random")).alias("k"), F.lit("random").alias("kind"), "end")
    added = passed.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("added"))
    empty = F.expr("cast(array() as array<struct<start:int,k:int,kind:string,end:int>>)")
    return found.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", empty).alias("added"))


def listing(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of docs, from scan()."""
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = listing(F.array_sort(F.concat("base", "added")))
    return scan(docs, fdr).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"), every.alias("spans"))
