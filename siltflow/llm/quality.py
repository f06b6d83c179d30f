"""Quality classifier by hierarchical empirical Bayes.

A logistic classifier over features of the text (shares of symbols, capitals, separators, repeated words and shingles, and the like) gives
each document its own evidence. Hosts and the paths below them have posteriors: the mean of their documents' probabilities, shrunk towards
the level above by a strength that is estimated from the spread of the groups' means, so a sparse path falls back on its host and a sparse
host on the global prior. A document's posterior log odds are its own, plus those of its path without it, less those of the global prior.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Words, bounded_batches, char_table, chunks, codepoints, only, shingle_hashes, written

#: Labelled rows that training reads at most, those of least hash.
TRAIN_ROWS = 8_000
#: The posterior of good quality below which a document is rejected.
LEAST = 0.5
#: Groups up to which their table is broadcast (about 100 bytes each); a larger one is joined by shuffling, hot hosts split by the skew join.
BROADCAST_GROUPS = 50_000
STRENGTH = (2.0, 10_000.0)
#: Most that a site may shift a document's log odds, and most that these are by its text alone.
MOST_SHIFT, MOST_EVIDENCE = 2.0, 20.0

# The classes of characters whose shares are features, beside letters.
_CLASSES = (r"\p{Lu}", r"\p{L}", r"\p{N}", r"\s", r"#$%&*^~=+<>{}\[\]\\@_", "|", "!", r"\p{P}")
N_FEATURES = 12


def features(texts: list[str | None]) -> np.ndarray:
    """A row of N_FEATURES for each text; of an empty one all are 0."""
    out = np.zeros((len(texts), N_FEATURES))
    for lo, hi in chunks(texts, 500_000):
        part = [t or "" for t in texts[lo:hi]]
        size = np.fromiter(map(len, part), np.int64, len(part))
        k = len(_CLASSES) + 1
        cls = char_table(*_CLASSES)[codepoints("".join(part))].astype(np.int64)
        n = np.bincount(np.repeat(np.arange(len(part)), size) * k + cls, minlength=len(part) * k).reshape(-1, k).astype(float)
        upper, lower, digit, white, symbol, pipe, bang, punct = n[:, 1:].T
        letters, chars = np.maximum(1, upper + lower), np.maximum(1, size - white)
        w = Words(part)
        at = np.searchsorted(w.doc, np.arange(len(part) + 1))
        count = np.diff(at)
        words = np.maximum(1, count)
        same = np.flatnonzero((w.h[1:] == w.h[:-1]) & (w.doc[1:] == w.doc[:-1]))
        stutter = np.bincount(w.doc[same], minlength=len(part)) / words
        fresh, again = np.ones(len(part)), np.zeros(len(part))
        for i in np.flatnonzero(count):
            h = w.h[at[i] : at[i + 1]]
            fresh[i] = len(np.unique(h)) / len(h)
            sh = shingle_hashes(h)
            again[i] = 1 - len(np.unique(sh)) / len(sh)
        length = np.bincount(w.doc, weights=w.end - w.start, minlength=len(part)) / words
        share = np.stack([upper / letters, digit / chars, symbol / chars, pipe / words, bang / words, punct / words, stutter, again], axis=1)
        out[lo:hi, :8] = np.log1p(50 * share)
        out[lo:hi, 8] = fresh * np.log1p(count)
        out[lo:hi, 9] = length / 10
        out[lo:hi, 10] = np.log1p(count) / 10
        out[lo:hi, 11] = np.log1p(50 * (n[:, 0] / chars))
        out[lo:hi][size == 0] = 0
    return out


def _design(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x, x[:, :8] ** 2])


def train(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic weights by Newton's method. With one label only they give that label's smoothed odds."""
    d = _design(x)
    w = np.zeros(d.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
        return w
    penalty = np.full(d.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - y) + penalty * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most so many labelled rows, those of least hash; a document with several labels counts once, by the least, and one with
    several texts by the least too. The driver gets the rows' features, not their texts."""
    truth = only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series(list(features([t if isinstance(t, str) else None for t in texts])))

    known = chosen.join(only(docs, "doc_id", "text"), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = known.select("doc_id", "quality", read("text").alias("x")).toPandas().sort_values("doc_id")
    return train(np.array(found["x"].tolist()).reshape(-1, N_FEATURES), (found["quality"] > 0).to_numpy(float))


def evidence(spark, weights: np.ndarray, text: Column) -> Column:
    """The classifier's log odds of good quality, MOST_EVIDENCE at most either way."""
    bounded_batches(spark)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        z = _design(features([t if isinstance(t, str) else None for t in texts])) @ weights
        return pd.Series(np.clip(np.round(z, 9), -MOST_EVIDENCE, MOST_EVIDENCE), dtype="float64")

    return run(text)


def _strength(groups: DataFrame, mean: float) -> float:
    """How many documents the level above counts for: the beta prior whose variance is what the groups' means vary beyond sampling."""
    n, p = F.col("_n"), F.col("_p")
    row = groups.where(n > 1).agg(
        F.sum(n).alias("n"), F.sum(n * F.pow(p / n - mean, F.lit(2))).alias("between"), F.count("*").alias("groups"), F.sum(n * n).alias("nn"), F.sum(F.col("_pp") - p * p / n).alias("within")
    ).first()
    if not row or not row["groups"] or row["groups"] < 2:
        return STRENGTH[1]
    n, k = row["n"], row["groups"]
    noise = row["within"] / max(1, n - k)
    spread = (row["between"] - (k - 1) * noise) / max(1e-9, n - row["nn"] / n)
    return float(np.clip(noise / spread if spread > 0 else STRENGTH[1], *STRENGTH))


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """columns of docs' rows with evidence (log odds of the text alone), host_mean, path_mean (posterior means without the document itself),
    score (posterior probability of good quality) and keep (score >= LEAST) added. A site shifts a document's log odds by MOST_SHIFT at most.

    host defaults to source, path to lang below it; nulls are groups of their own. Empty texts are scored like any other, by features that
    are all 0. Repeated rows repeat. Without usable labels the evidence is even and everything is kept. Texts are read by the classifier once:
    what it finds is written beside the columns, and the groups' sums and the scores come from there.
    """
    spark = docs.sparkSession
    weights = fit(docs, labels)
    base = only(docs, *COLUMNS)
    host, path = host if host is not None else F.col("source"), path if path is not None else F.col("lang")
    place = F.struct(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")).alias("_place")
    base = written(base.select(*columns, place, evidence(spark, weights, F.col("text")).alias("evidence")), "evidence")
    base = base.select("*", F.col("_place.host").alias("_host"), F.col("_place.path").alias("_path"), (1 / (1 + F.exp(-F.col("evidence")))).alias("_p0"))
    sums = [F.count("*").alias("_n"), F.sum("_p0").alias("_p"), F.sum(F.col("_p0") * F.col("_p0")).alias("_pp")]
    paths = written(base.groupBy("_host", "_path").agg(*sums), "paths")
    hosts = paths.groupBy("_host").agg(*[F.sum(c).alias(c) for c in ("_n", "_p", "_pp")])
    total = hosts.agg(F.sum("_n"), F.sum("_p")).first()
    mean = total[1] / total[0] if total[0] else 0.5
    mean = min(max(mean, 1e-4), 1 - 1e-4)
    k_host, k_path = _strength(hosts, mean), _strength(paths, mean)
    groups = paths.select("_host", "_path", "_n", "_p").join(hosts.select("_host", F.col("_n").alias("_host_n"), F.col("_p").alias("_host_p")), "_host")
    groups = F.broadcast(groups) if paths.count() <= BROADCAST_GROUPS else groups
    out = base.join(groups, ["_host", "_path"])
    out = out.withColumn("host_mean", (F.col("_host_p") - F.col("_p0") + k_host * mean) / (F.col("_host_n") - 1 + k_host))
    out = out.withColumn("path_mean", (F.col("_p") - F.col("_p0") + k_path * F.col("host_mean")) / (F.col("_n") - 1 + k_path))
    odds = lambda x: F.log(x / (1 - x))
    near = F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), F.col("path_mean")))
    shift = F.least(F.lit(MOST_SHIFT), F.greatest(F.lit(-MOST_SHIFT), odds(near) - odds(F.lit(mean))))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + shift)))).withColumn("keep", F.col("score") >= LEAST)
    return out.select(*columns, "evidence", "host_mean", "path_mean", "score", "keep")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, evidence, host_mean, path_mean, score, keep) of each row of docs."""
    return score(docs, labels, columns=("doc_id",))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with the columns doc_id, text, lang, source and n_chars."""
    return score(docs, labels).where("keep").select(*COLUMNS)
