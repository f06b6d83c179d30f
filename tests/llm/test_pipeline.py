"""Every stage against a brute-force version of its own, on a table with nulls, empties, repeats, copies and clashing columns."""

import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from siltflow.llm import pii, quality
from test_ngrams import brute, contained, sets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, keep boolean, evidence double, spans string, block int, component long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def corpus():
    rng = random.Random(8)
    vocabulary = "river stone light walking under bridge evening people quiet window garden letter morning summer village market winter corner paper bottle".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(20)
    good = [text(rng.randint(30, 90)) for _ in range(60)]
    near = good[0].split()
    near[5] = "changed"
    texts = [*good, good[0], " ".join(near), f"{text(40)} {item} {text(30)}", f"{text(30)} call +1 (743) 555-3824 or mail a.b@x.example.com {text(9)}", None, "", "", "one two", text(6000)]
    texts += [" ".join(w + "***" for w in text(50).upper().split()) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], (None, text(50), None, None, 1), (5, text(40), "de", "s1", 2)]
    labels = [(i, int(i < 60)) for i in range(0, len(texts), 2)] + [(None, 1), (10**9, 0)]
    return rows, labels, [(1, item), (2, None), (3, "")]


def test_stages_equal_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    sf = str(tmp_path)
    extra = ("x", True, 1.0, "y", 7, 9)
    docs = spark.createDataFrame([(*r, *extra) for r in rows], DOCS)
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), {}
    before = docs
    for name in ("quality", "near_duplicates", "decontamination", "pii"):
        out = stages[name](spark, before, sf)
        assert out.columns == COLUMNS
        out.write.parquet(f"{sf}/{name}")
        seen[name] = (before, [tuple(r) for r in spark.read.parquet(f"{sf}/{name}").select(*COLUMNS).collect()])
        before = spark.read.parquet(f"{sf}/{name}")
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    given = {n: [tuple(r) for r in d.select(*COLUMNS).collect()] for n, (d, _) in seen.items()}

    judged = [(r.doc_id, r.keep) for r in quality.report(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()]
    assert sorted(((d,) for d, k in judged if k), key=key) == sorted(((r[0],) for r in seen["quality"][1]), key=key)
    assert {i for i in range(60)} <= {r[0] for r in seen["quality"][1]} and not {i for i in range(len(rows) - 33, len(rows) - 3)} & {r[0] for r in seen["quality"][1]}

    # of each class the text with the least id stays, and of its rows one with that id; texts without an id are known by it
    numbered = [(10**6 if r[0] is None else r[0], r[1]) for r in given["near_duplicates"]]
    classes = brute(numbered)
    kept = {(10**6 if r[0] is None else r[0], r[1] or "") for r in seen["near_duplicates"][1]}
    first = {}
    for i, t in numbered:
        first[t or ""] = min(i, first.get(t or "", i))
    want = {(i, t) for t, i in first.items() if not sets(t) or i == min(first[u] for u in first if u == t or (sets(u) and len(sets(t) & sets(u)) >= 0.8 * len(sets(t) | sets(u))))}
    assert kept == want and len(kept) == len(seen["near_duplicates"][1]) and classes

    clean = [r for r in given["decontamination"] if not any(contained(x, r[1]) for _, x in items)]
    assert sorted(seen["decontamination"][1], key=key) == sorted(clean, key=key) and len(clean) == len(given["decontamination"]) - 1

    model = pii.fit(seen["pii"][0])
    mask = lambda t: t if t is None else pii.masked(t, (b := pii.base_spans(t)) + pii.added_spans(t, b, model))
    want = [(d, mask(t), lang, s, None if t is None else len(mask(t))) for d, t, lang, s, _ in given["pii"]]
    assert sorted(seen["pii"][1], key=key) == sorted(want, key=key) and any("<email>" in (r[1] or "") and "<phone>" in r[1] for r in want)

    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t, *_ in seen["pii"][1]:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((d, len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())))
    got = [tuple(r) for r in stages["encoding"](spark, before, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == COLUMNS else docs
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_run_keeps_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.3 * n < out.count() <= n and out.select("doc_id").distinct().count() == out.count()


def test_all_ten_are_registered():
    names = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names
