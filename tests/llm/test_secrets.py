"""The randomness battery, its false-discovery control and its spans against a brute-force version."""

import math
import random
import re
import string
import time

from pyspark.sql import functions as F

from siltflow.llm import secret_scan as S

ALPHABETS = {16: string.digits + "abcdef", 32: string.ascii_lowercase + "234567", 36: string.digits + string.ascii_lowercase, 64: string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"}


def tail(z):
    return 1 / (1 + math.exp(min(700, 1.5976 * z + 0.070566 * z**3)))


def log_p(token):
    """The natural logarithm of the token's prose probability, 0 if the runs or serial test rejects randomness."""
    k = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token) else 32 if re.fullmatch("[A-Z2-7]+", token) else 36 if re.fullmatch("[a-z0-9]+|[A-Z0-9]+", token) else 64
    plain = token.replace("-", "+").replace("_", "/") if k == 64 else token.lower()
    v = [ALPHABETS[k].index(c) for c in plain]
    n = len(v)
    up = [x >= k / 2 for x in v]
    high = sum(up)
    runs, mean_runs = 1 + sum(a != b for a, b in zip(up, up[1:])), 2 * high * (n - high) / n + 1
    p_runs = 0 if mean_runs <= 2 else 2 * tail(abs(runs - mean_runs) / math.sqrt((mean_runs - 1) * (mean_runs - 2) / (n - 1)))
    mean = sum(v) / n
    var, cov = sum((x - mean) ** 2 for x in v), sum((a - mean) * (b - mean) for a, b in zip(v, v[1:]))
    p_serial = 2 * tail(abs(cov / var if var else 1) * math.sqrt(n))
    if p_runs < S.TAIL or p_serial < S.TAIL:
        return 0.0
    chi2 = k * sum(v.count(x) ** 2 for x in set(v)) / n - n
    shift = max(0.1, k * S.PROSE_MATCH - 1) * n
    z = (chi2 - (k - 1 + shift)) / math.sqrt(2 * (k - 1 + 2 * shift))
    low = -z * z / 2 - math.log(-z * math.sqrt(2 * math.pi)) if z < -4 else math.log(1 / (1 + math.exp(min(700, -(1.5976 * z + 0.070566 * z**3)))))
    return low + (n * math.log(S.PROSE_HEX) if k == 16 else 0)


def base(t):
    out = [(m.start(), m.end()) for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    return out + [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}", t)] + [m.span() for m in re.finditer("[0-9a-f]{24,}", t)]


def added(texts):
    """The added spans of each text: Benjamini and Hochberg's rule over every tested token, on the grid of log probabilities."""
    tested = []
    for i, t in enumerate(texts):
        for m in re.finditer(S.TOKEN, t):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and b > m.start() for a, b in base(t)):
                tested.append((i, m.start(), m.end(), log_p(m[0])))
    width, bound = math.log(10) / 20, -math.inf
    steps = [min(S.STEPS, max(0, math.floor(-x[3] / width))) for x in tested]
    for s in sorted(set(steps)):
        if len(tested) * math.exp(-s * width) <= S.FDR * sum(x >= s for x in steps):
            bound = -s * width
            break
    return [[(a, b) for j, a, b, p in tested if j == i and p <= bound] for i in range(len(texts))]


def test_added_spans_equal_brute_force(spark):
    rng = random.Random(3)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    parts = [
        lambda: pick(string.ascii_letters + string.digits, rng.randint(16, 60)), lambda: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32), lambda: pick("0123456789ABCDEF", 40), lambda: pick("0123456789abcdef", 30), lambda: "the-quick-brown-fox-jumps-over-2-lazy-dogs",
        lambda: pick("ab", 12) + pick("89", 12), lambda: "a1" * 14, lambda: "internationalisation2internationalisation", lambda: "token=abc123", lambda: "AKIA" + pick(string.ascii_uppercase, 16), lambda: "é😀 word", lambda: "x",
    ]
    texts = [" ".join(rng.choice(parts)() for _ in range(rng.randint(0, 6))) for _ in range(300)]
    want = added(texts)
    assert sum(map(len, want)) > 100 and any(log_p(m[0]) == 0 for t in texts for m in re.finditer(S.TOKEN, t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x["start"], x["end"]) for x in r.added] for r in S.scan(docs).collect()}
    assert got == dict(enumerate(want))


def test_tokens_that_other_tests_reject_count(spark):
    """The bound is over all tested tokens: with many that are not random, one of middling evidence is no discovery."""
    rng = random.Random(5)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(28))
    few = [f"key {key}"]
    many = few + [f"see {'ab' * 10}{i % 10} here" for i in range(3000)]
    run = lambda texts: [x for r in S.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("size(added) > 0").collect() for x in r.added]
    assert bool(run(few)) == bool(added(few)[0]) and bool(run(many)) == bool(added(many)[0])
    assert math.exp(log_p(key)) * 3001 > S.FDR > math.exp(log_p(key))


def test_running(spark):
    rows = [([],), ([3],), ([1, 5, 2, 8, 2, 9, 0],), (list(range(100, 0, -1)),)]
    df = spark.createDataFrame(rows, "v array<int>")
    got = df.select(S.running(F.col("v"), lambda a, b: a + b).alias("sum"), S.running(F.col("v"), F.greatest).alias("most"), S.running(F.col("v"), F.least, True).alias("least")).collect()
    for (v,), r in zip(rows, got, strict=True):
        assert r["sum"] == [sum(v[: i + 1]) for i in range(len(v))]
        assert r["most"] == [max(v[: i + 1]) for i in range(len(v))] and r["least"] == [min(v[i:]) for i in range(len(v))]


def test_long_text_takes_linear_time(spark):
    rng = random.Random(4)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    part = " ".join(f"{pick('0123456789abcdef', 24)} {pick(string.ascii_letters + string.digits, 24)} secret=abcdef{i}" for i in range(2000))
    text = " ".join([part] * 40)  # 5 MB, 240,000 spans
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (r,) = S.report(docs).collect()
    assert time.time() - began < 90
    assert r.n_hex == 80_000 and r.n_assign == 80_000


def test_a_token_takes_time_in_proportion_to_its_length(spark):
    rng = random.Random(5)
    seconds = {}
    for n in (200_000, 1_600_000):
        token = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
        df = spark.createDataFrame([(1, token)], "doc_id long, token string")
        df.count()
        began = time.time()
        row = S.battery(df).first()
        seconds[n] = time.time() - began
        assert row.k == 64 and row.p_runs > 1e-4 and row.p_serial > 1e-4 and row.log_p < -1000
    assert seconds[1_600_000] < 16 * seconds[200_000] + 2 and seconds[1_600_000] < 30
