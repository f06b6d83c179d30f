"""Toxicity: a convolutional text classifier, trained in numpy.

Words are hashed, and so are their first letters, into one embedding table; a word's vector is the sum of both. Filters of several widths
run over the word vectors, each keeps its maximum over the whole text, and a logistic layer reads the maxima. Thresholds are calibrated by
language, which is guessed from the text's function words, and moved into the score, so that 0.5 is the threshold everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import U64, Words, bounded_batches, chunks, mix, only, span_hashes, written

BUCKETS, SIZE, WIDTHS, FILTERS, STEM = 1 << 15, 16, (1, 2, 3), 8, 5
#: Labelled rows that training reads at most, those of least hash; a fifth of them calibrates the thresholds.
TRAIN_ROWS = 12_000
#: Characters of their texts at most: rows that would exceed it are left out of the sample.
TRAIN_CHARS = 60_000_000
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.05, 7
#: Texts to learn from, with repeats, where rows are few: up to ten times the epochs.
LEAST_SEEN = 40_000
#: Calibration rows that a language's own threshold needs; half its weight goes to the common threshold at this number.
SHRINK = 200

#: Characters of the texts that are held as words at once; a longer text is read in blocks of so many.
PIECE = 300_000
#: Where a text may be cut into blocks: no word has such a character, nor does lower case depend on what is beyond it.
_CUT = re.compile(r"[\s,;!?()\[\]{}<>\"/。、，；！？]")

# Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was with are this from".split(),
    "de": "der die das und ist den ein nicht mit von für auf dem sich".split(),
    "fr": "le les des et une est du dans pour qui sur pas au par".split(),
    "es": "el los las del y se con por una para lo al su como".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def _hash_words(words: list[str]) -> np.ndarray:
    return Words(words).h


_KNOWN = {lang: np.sort(_hash_words(words)) for lang, words in FUNCTION_WORDS.items()}


def _buckets(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + U64(salt)) >> U64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of its first letters, first word of each text and the end, how many function words of each language)."""
    w = Words(texts)
    stem = span_hashes(w.joined, w.start, np.minimum(w.end, w.start + STEM))
    at = np.searchsorted(w.doc, np.arange(len(texts) + 1))
    votes = np.zeros((len(texts), len(LANGUAGES)), np.int64)
    for k, known in enumerate(_KNOWN.values()):
        hit = known[np.minimum(np.searchsorted(known, w.h), len(known) - 1)] == w.h
        votes[:, k] = np.bincount(w.doc[hit], minlength=len(texts))
    return _buckets(w.h, 1), _buckets(stem, 2), at, votes


def guessed(votes: np.ndarray) -> np.ndarray:
    """The language that most function words tell; without any, the last."""
    return np.where(votes.any(axis=1), votes.argmax(axis=1), len(LANGUAGES) - 1)


def blocks(text: str | None) -> Iterator[str]:
    """The text in blocks of PIECE characters and as many more as there are to the next place where it may be cut."""
    text, lo = text or "", 0
    while len(text) - lo > PIECE and (m := _CUT.search(text, lo + PIECE)):
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:]


def whole(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of its first letters) of one text."""
    return tuple(np.concatenate(x) for x in zip(*[read([t])[:2] for t in blocks(text)], strict=True))


@dataclass
class Model:
    embed: np.ndarray
    filters: list[np.ndarray]  # by width: (width, SIZE, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def maxima(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(maximum of each filter over each text, 0 at least; where it is, -1 if nowhere)."""
        n, docs = len(x), len(at) - 1
        best, where = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32), np.full((docs, len(WIDTHS) * FILTERS), -1)
        for k, width in enumerate(WIDTHS):
            if n < width:
                continue
            conv = sum((x[j : n - width + 1 + j] @ self.filters[k][j] for j in range(width)), self.bias[k])
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            for d in range(docs):
                lo, hi = at[d], at[d + 1] - width + 1
                if hi > lo:
                    arg = conv[lo:hi].argmax(axis=0)
                    best[d, cols] = conv[lo + arg, np.arange(FILTERS)]
                    where[d, cols] = lo + arg
        where[best <= 0] = -1
        return np.maximum(best, 0), where

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(logit of each text before its threshold, its guessed language)."""
        out, langs = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for lo, hi in chunks(texts, PIECE):
            if hi - lo == 1 and len(texts[lo] or "") > PIECE:
                best, votes = self.pooled_long(texts[lo])
            else:
                a, b, at, votes = read(texts[lo:hi])
                best = self.pooled(a, b, at)
            out[lo:hi] = best @ self.out + self.base
            langs[lo:hi] = guessed(votes)
        return out, langs

    def pooled_long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The maxima and function words of one text, block by block; a block starts with the last words of the one before, so that no filter
        misses a place."""
        best, votes = np.zeros((1, len(WIDTHS) * FILTERS), np.float32), np.zeros((1, len(LANGUAGES)), np.int64)
        kept = np.zeros(0, np.int32), np.zeros(0, np.int32)
        for block in blocks(text):
            a, b, _, more = read([block])
            a, b = np.append(kept[0], a), np.append(kept[1], b)
            best, votes = np.maximum(best, self.pooled(a, b, np.array([0, len(a)]))), votes + more
            kept = a[max(0, len(a) - max(WIDTHS) + 1) :], b[max(0, len(b) - max(WIDTHS) + 1) :]
        return best, votes

    def pooled(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The maxima of texts by their words."""
        n, docs = len(a), len(at) - 1
        best = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32)
        if not n:
            return best
        x = self.embed[a] + self.embed[b]
        doc = np.repeat(np.arange(docs), np.diff(at))
        for k, width in enumerate(WIDTHS):
            if n < width:
                continue
            conv = sum((x[j : n - width + 1 + j] @ self.filters[k][j] for j in range(width)), self.bias[k])
            inside = doc[: n - width + 1] == doc[width - 1 :]
            if width > 1:
                conv[~inside] = 0
            full = np.unique(doc[: n - width + 1])
            best[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(conv, np.searchsorted(doc[: n - width + 1], full), axis=0)
        return np.maximum(best, 0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        z, langs = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(z - self.threshold[langs], -500, 500)))


def train(texts: list[str | None], toxic: np.ndarray) -> Model:
    """Adagrad on the logistic loss over four fifths of the rows, thresholds from the rest. Without rows of both labels every score is under 0.5."""
    rng = np.random.default_rng(SEED)
    m = Model(
        rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32),
        [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0.3, 0.1, len(WIDTHS) * FILTERS).astype(np.float32),
        -2.0,
    )
    y = np.asarray(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        m.base, m.out = -2.0, m.out * 0
        return m
    parts = [whole(t) for t in texts]
    order = rng.permutation(len(y))
    check, fit = order[: len(y) // 5], order[len(y) // 5 :]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 0.02), 1.0).clip(1, 5).astype(np.float32)
    grown = {"e": np.full((BUCKETS, 1), 1e-6, np.float32), "o": 1e-6, "b": 1e-6, **{("f", k): 1e-6 for k in range(len(WIDTHS))}, **{("c", k): 1e-6 for k in range(len(WIDTHS))}}

    def step(key, value, grad):
        grown[key] = grown[key] + grad * grad
        return value - RATE * grad / np.sqrt(grown[key])

    for _ in range(int(np.clip(LEAST_SEEN / len(fit), EPOCHS, 10 * EPOCHS))):
        for lo in range(0, len(fit), BATCH):
            rows = rng.permutation(fit)[:BATCH] if lo + BATCH > len(fit) else fit[lo : lo + BATCH]
            a, b = (np.concatenate([parts[r][i] for r in rows]) for i in (0, 1))
            at = np.append(0, np.cumsum([len(parts[r][0]) for r in rows]))
            x = m.embed[a] + m.embed[b]
            best, where = m.maxima(x, at)
            p = 1 / (1 + np.exp(-np.clip(best @ m.out + m.base, -30, 30)))
            g = (p - y[rows]) * weight[rows] / len(rows)
            back = g[:, None] * m.out[None, :] * (where >= 0)
            out_grad, base_grad = best.T @ g, float(g.sum())
            ids, grads = [], []
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                w, gb = where[:, cols], back[:, cols]
                d, f = np.nonzero(w >= 0)
                fgrad = np.zeros_like(m.filters[k])
                for j in range(width):
                    pos = w[d, f] + j
                    np.add.at(fgrad[j].T, f, gb[d, f, None] * x[pos])
                    vec = gb[d, f, None] * m.filters[k][j].T[f]
                    ids += [a[pos], b[pos]]
                    grads += [vec, vec]
                m.filters[k] = step(("f", k), m.filters[k], fgrad)
                m.bias[k] = step(("c", k), m.bias[k], gb.sum(axis=0))
            m.out = step("o", m.out, out_grad).astype(np.float32)
            m.base = float(step("b", m.base, base_grad))
            ids, grads = np.concatenate(ids), np.concatenate(grads)
            seen, to = np.unique(ids, return_inverse=True)
            total = np.zeros((len(seen), SIZE), np.float32)
            np.add.at(total, to, grads)
            grown["e"][seen] += (total**2).mean(axis=1, keepdims=True)
            m.embed[seen] -= RATE * total / np.sqrt(grown["e"][seen])
        fit = rng.permutation(fit)
    m.threshold = _thresholds(*m.logits([texts[i] for i in check]), y[check])
    return m


def _best(z: np.ndarray, y: np.ndarray) -> float:
    """A threshold with the fewest errors, in the middle of the widest such interval."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = np.append(0, np.cumsum(y)) + (1 - y).sum() - np.append(0, np.cumsum(1 - y))
    least = np.flatnonzero(errors == errors.min())
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    wide = max(least, key=lambda i: edges[i + 1] - edges[i])
    return float((edges[wide] + edges[wide + 1]) / 2)


def _thresholds(z: np.ndarray, langs: np.ndarray, y: np.ndarray) -> np.ndarray:
    both = lambda v: len(v) and v.min() != v.max()
    common = _best(z, y) if both(y) else 0.0
    out = np.full(len(LANGUAGES), common)
    for k in range(len(LANGUAGES)):
        mine = langs == k
        if both(y[mine]):
            share = mine.sum() / (mine.sum() + SHRINK)
            out[k] = share * _best(z[mine], y[mine]) + (1 - share) * common
    return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder modulo 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """A model from the labelled rows that aren't held out: at most so many, those with the least hash of the id, whose texts have so many
    characters together. Rows with a null label or id are left out; a document that several label rows name counts once, with the greatest
    label, and one that has several texts with the least."""
    truth = only(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = truth.where(~held_out(F.col("doc_id"))).orderBy(order, "doc_id").limit(rows)
    known = written(chosen.join(only(docs, "doc_id", "text"), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    left, fit_in = chars, []
    for r in known.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).orderBy(order, "doc_id").collect():
        if r["n"] <= left:
            left -= r["n"]
            fit_in.append((r["doc_id"],))
    pdf = known.join(F.broadcast(docs.sparkSession.createDataFrame(fit_in, "doc_id long")), "doc_id").toPandas().sort_values("doc_id")
    return train(pdf["text"].tolist(), (pdf["toxic"] > 0).to_numpy(np.float32))


def score_column(spark, model: Model, text: Column) -> Column:
    """The score (0 to 1) of a text column; null counts as empty."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)  # fixed size: the embedding table and a few filters

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score([t if isinstance(t, str) else None for t in texts]), dtype="float64")

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, by its whole text alone. Null and empty texts get the score of a text without
    words; repeated rows repeat; an empty table gives an empty one."""
    model = fit(docs, labels)
    out = only(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
