import random
import tracemalloc
import zlib

import duckdb
import numpy as np

from siltflow.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def prose(rng, n=60):
    return " ".join(rng.choice("the of and house river walking slowly under bright morning light people talked about work".split()) for _ in range(n)) + "."


def rows(n=600):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        t, toxic, good = prose(rng), int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(("dolt", "doltish", "fiend")))
            t = " ".join(w)
        if not good:
            t = " ".join(w + "***" for w in t.upper().split())
        docs.append((i, t, "en", f"s{i % 5}", len(t)))
        labels.append((i, good, toxic))
    docs += [(n, None, "en", None, None), (n + 1, "", None, "s0", 0), (0, docs[0][1], "en", "s0", 1), (None, "text", "en", "s1", 4)]
    return docs, [*labels, (0, None, None), (None, 1, 1), (10**9, 1, 1)]


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def test_toxicity_generalises(spark):
    docs, labels = rows()
    got = toxicity.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels if t is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_without_labels(spark):
    docs, _ = rows(10)
    got = toxicity.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(docs) and not any(r.predicted for r in got)
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_convolution_equals_loops():
    rng = np.random.default_rng(1)
    m = toxicity.Model(
        rng.normal(size=(toxicity.BUCKETS, toxicity.SIZE)).astype(np.float32), [rng.normal(size=(w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], np.ones(3 * toxicity.FILTERS, np.float32), 0.0,
    )
    texts = ["one two three four", "", "one", None, "two one"]
    a, b, at, _ = toxicity.read(texts)
    got = m.pooled(a, b, at)
    best, _ = m.maxima(m.embed[a] + m.embed[b], at)
    for d in range(len(texts)):
        x = (m.embed[a] + m.embed[b])[at[d] : at[d + 1]]
        want = [
            max([0.0, *[float(sum(x[i + j] @ m.filters[k][j][:, f] for j in range(w)) + m.bias[k][f]) for i in range(len(x) - w + 1)]]) for k, w in enumerate(toxicity.WIDTHS) for f in range(toxicity.FILTERS)
        ]
        assert np.allclose(got[d], want, atol=1e-3) and np.allclose(best[d], want, atol=1e-3)


def test_scores_equal_loops_and_long_texts_are_read_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    m = toxicity.Model(
        rng.normal(size=(toxicity.BUCKETS, toxicity.SIZE)).astype(np.float32) / 4, [rng.normal(size=(w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) / 4 for w in toxicity.WIDTHS],
        [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], rng.normal(size=3 * toxicity.FILTERS).astype(np.float32) / 8, -0.3, rng.normal(size=len(toxicity.LANGUAGES)),
    )
    word = lambda: "".join(rng.choice(list("abcdeΣ'é日"), rng.integers(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 2, 3, 40, 400)] + ["der Hund und die Katze", None, "a,b;c" * 30, "x" * 500, "ΟΔΟΣ, ΟΔΟΣ " * 40]

    def loops(text):
        a, b, _, votes = toxicity.read([text])
        x = [m.embed[i] + m.embed[j] for i, j in zip(a, b, strict=True)]
        z = m.base
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                found = [float(sum(x[i + j] @ m.filters[k][j][:, f] for j in range(width)) + m.bias[k][f]) for i in range(len(x) - width + 1)]
                z += max([0.0, *found]) * float(m.out[k * toxicity.FILTERS + f])
        lang = max(range(len(toxicity.LANGUAGES)), key=lambda i: (votes[0][i], -i)) if votes.any() else len(toxicity.LANGUAGES) - 1
        return 1 / (1 + np.exp(m.threshold[lang] - z))

    want = [loops(t) for t in texts]
    assert np.allclose(m.score(texts), want, atol=1e-4)
    for piece in (7, 60, 300):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.allclose(m.score(texts), want, atol=1e-4)
        for t in texts:
            assert "".join(toxicity.blocks(t)) == (t or "") and all(np.array_equal(x, y) for x, y in zip(toxicity.whole(t), toxicity.read([t])[:2], strict=True))


def test_memory_of_a_long_text_is_that_of_a_block():
    m = toxicity.train(["a", "b"], np.zeros(2))
    peaks = []
    for n in (1, 8):
        text = "some words of a very long text " * (n * 100_000)
        tracemalloc.start()
        m.score([text])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] * 1.3


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    docs, labels = rows()
    out = quality.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: g for i, g, _ in labels if g is not None}
    assert len(out) == len(docs) and np.mean([r.keep == bool(truth[r.doc_id]) for r in out if r.doc_id in truth]) > 0.99
    kept = quality.keep_good(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_site_posteriors_equal_brute_force(spark):
    docs, labels = rows(200)
    out = quality.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    p = 1 / (1 + np.exp(-np.array([r.evidence for r in out])))
    by_id = {i: (s or "", lang or "") for i, _, lang, s, _ in docs}
    host, path = (np.array(["\t".join(by_id[r.doc_id][:k]) for r in out]) for k in (1, 2))
    mean = min(max(p.mean(), 1e-4), 1 - 1e-4)

    def strength(groups):
        n = np.array([(groups == g).sum() for g in np.unique(groups)])
        m = np.array([p[groups == g].mean() for g in np.unique(groups)])
        within = sum(((p[groups == g] - p[groups == g].mean()) ** 2).sum() for g in np.unique(groups) if (groups == g).sum() > 1)
        n, m = n[n > 1], m[n > 1]
        noise = within / (n.sum() - len(n))
        spread = ((n * (m - mean) ** 2).sum() - (len(n) - 1) * noise) / (n.sum() - (n**2).sum() / n.sum())
        return float(np.clip(noise / spread if spread > 0 else quality.STRENGTH[1], *quality.STRENGTH))

    k, k_path = strength(host), strength(path)
    want = np.array([(p[host == h].sum() - p[i] + k * mean) / ((host == h).sum() - 1 + k) for i, h in enumerate(host)])
    assert np.allclose([r.host_mean for r in out], want, atol=1e-6)
    want = np.array([(p[path == h].sum() - p[i] + k_path * want[i]) / ((path == h).sum() - 1 + k_path) for i, h in enumerate(path)])
    assert np.allclose([r.path_mean for r in out], want, atol=1e-6)
    odds = lambda x: np.log(x / (1 - x))
    shift = np.clip(odds(np.clip(want, 1e-4, 1 - 1e-4)) - odds(mean), -quality.MOST_SHIFT, quality.MOST_SHIFT)
    want = 1 / (1 + np.exp(-(np.array([r.evidence for r in out]) + shift)))
    assert np.allclose([r.score for r in out], want, atol=1e-6) and [r.keep for r in out] == (np.array([r.score for r in out]) >= quality.LEAST).tolist()


def test_models_do_not_depend_on_the_rows_order(spark):
    """A repeated id with several texts gives one model, whatever comes first; the sample is bounded in characters."""
    docs, labels = rows(60)
    docs += [(5, "another text of the same id dolt", "en", "s0", 1), (7, "a third house", "en", "s0", 1)]
    frames = [(spark.createDataFrame(x, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)) for x in (docs, docs[::-1])]
    assert np.array_equal(*[quality.fit(*f) for f in frames])
    one, two = (toxicity.fit(*f, chars=4000) for f in frames)
    assert np.array_equal(one.embed, two.embed) and one.base == two.base


def test_quality_without_labels_keeps_all(spark):
    docs, _ = rows(10)
    out = quality.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(out) == len(docs) and all(r.keep for r in out)
    assert quality.report(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_quality_on_the_table():
    r = duckdb.sql(f"select d.text, l.quality from '{SF}/documents.parquet' d join '{SF}/labels.parquet' l using (doc_id) order by hash(doc_id)").fetchall()
    x, y = quality.features([t for t, _ in r]), np.array([q for _, q in r], float)
    k = len(r) * 2 // 3
    p = quality._design(x[k:]) @ quality.train(x[:k], y[:k]) > 0
    assert (p == y[k:]).mean() > 0.97
