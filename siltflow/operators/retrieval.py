"""BM25 retrieval with a cap per section, batched over any number of queries, on a stored index that changes by segments."""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as D

from ..functions import text as T
from ..functions import urls as U
from ..storage import bounded_batches, commit, latest, parts, place, work_dir, written

K1, B, TITLE_WEIGHT, OVERVIEW_BOOST, LEAST_TERM = 1.5, 0.75, 3, 1.2, 3
#: Words too common to search for.
STOP = (
    "a about after all also an and any are as at be been but by can do does for from has have how if in into is it its more need new no not of on one only or other our out over see set so some than "
    "that the their them then there these this those to up use used using want was we what when where which who will with would you your"
).split()


def plain_stem(w: str) -> str:
    """The stem of functions.text.stem, for words known when a plan is made."""
    n = len(w)
    if n > 4 and w.endswith("ies"):
        w = w[:-3] + "y"
    elif n > 4 and w.endswith("es") and w[:-2].endswith(("s", "x", "z", "ch", "sh")):
        w = w[:-2]
    elif n > 3 and w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if len(w) > 4 and w.endswith(("ing", "ed")):
        w = w[:-3] if w.endswith("ing") else w[:-2]
    if len(w) > 4 and w.endswith("e"):
        w = w[:-1]
    return w[:-1] if len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdgklmnprt" else w


STOP_STEMS = sorted({plain_stem(w) for w in STOP})


def searchable(term: Column) -> Column:
    return (F.char_length(term) >= LEAST_TERM) & ~term.isin(STOP_STEMS)


def terms(text: Column) -> Column:
    """The searchable stems of a text, in order, repeats kept: null texts have none."""
    return F.filter(F.transform(T.words(F.coalesce(text, F.lit(""))), T.stem), searchable)


class Index:
    """A stored index of pages (url, title, text, section, kind, overview), made of segments that are written once.

    A segment has docs (url, hash, len, section, kind, overview, terms, fs), terms (term, df), dead (seg, url: pages of earlier segments that it
    replaces or drops) and a line of counts in the manifest. df and counts of a segment have what it takes away subtracted, so that sums over
    segments are those of the pages that are alive.
    """

    def __init__(self, pages: DataFrame, store: str, segments: list[dict]):
        self.pages, self.store, self.segments = pages, store, segments

    def table(self, name: str) -> DataFrame:
        """One of the tables over all segments, with seg."""
        spark, out = self.pages.sparkSession, None
        for s in self.segments:
            df = spark.read.parquet(f"{self.store}/{s['name']}/{name}")
            df = df if name == "dead" else df.withColumn("seg", F.lit(s["name"]))
            out = df if out is None else out.unionByName(df)
        return out

    @property
    def docs(self) -> DataFrame:
        """The pages that are alive."""
        docs = self.table("docs")
        return docs if len(self.segments) == 1 else docs.join(self.table("dead"), ["seg", "url"], "left_anti")

    @property
    def tf(self) -> DataFrame:
        return self.docs.select("url", F.explode(F.arrays_zip("terms", "fs")).alias("x")).select("url", F.col("x.terms").alias("term"), F.col("x.fs").alias("f"))

    @property
    def df(self) -> DataFrame:
        return self.table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def length(self) -> DataFrame:
        return self.docs.select("url", "len")

    @property
    def counts(self) -> tuple[int, float]:
        """Pages, and their average length (1 if there are none, or none has terms)."""
        n, total = (sum(s[k] for s in self.segments) for k in ("n", "total"))
        return n, (total / n if n and total else 1.0)

    @property
    def stats(self) -> DataFrame:
        n, total = (sum(s[k] for s in self.segments) for k in ("n", "total"))
        return self.pages.sparkSession.createDataFrame([(n, total / n if n else None)], "n long, avg double")


#: Pages that a task scores at once, fewer if queries have many terms: CELLS of a table of terms and pages at most.
BLOCK_ROWS, CELLS = 128, 4_000_000
#: A task ranks what it has gathered when that is so many pages a query, or after so many blocks; then only better ones are gathered.
SEED_ROWS, SEED_BLOCKS = 48, 4
#: Queries that a pass over the pages scores.
QUERY_BLOCK = 4096


def gain(f, length, average: float):
    """What a term adds to a page's score, without its idf; of columns or of arrays."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))


@lru_cache(maxsize=None)
def version() -> str:
    """Changes with the code that makes an index."""
    return hashlib.sha1((inspect.getsource(T) + inspect.getsource(inspect.getmodule(version))).encode()).hexdigest()[:12]


def _held(pages: DataFrame) -> DataFrame:
    """Pages that have text, with a title made of the url where there is none, and a digest of all that the index knows of them."""
    held = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), U.title(F.col("url").cast("string"))))
    return held.withColumn("hash", F.sha1(F.to_json(F.struct("title", "text", "section", "kind", "overview"))))


#: Letters and digits of a text in lower case as themselves, else 0.
_LETTER = np.array([b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 0 for b in range(256)], np.uint8)
#: Terms whose counts a task keeps; characters that are counted at once, unless a page has more.
MOST_MET, MOST_CHARACTERS = 500_000, 4_000_000


def stems(words: pa.Array) -> pa.Array:
    """plain_stem() of words, all at once: of each the place of its end moves back."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) + 4  # room for what is before a first word
    x = np.concatenate([np.zeros(4, np.uint8), np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)])
    start, end = at[:-1], at[1:].copy()
    last = lambda k, letters: np.isin(x[end - k], np.frombuffer(letters.encode(), np.uint8))
    ending = lambda w: np.logical_and.reduce([last(len(w) - i, c) for i, c in enumerate(w)])
    longer = lambda n: end - start > n
    ies = longer(4) & ending("ies")
    es = longer(4) & ending("es") & ~ies & (last(3, "sxz") | last(3, "h") & last(4, "cs"))
    s = longer(3) & ending("s") & ~last(2, "s") & ~ies & ~es
    x[end[ies] - 3] = ord("y")
    end -= 2 * (ies | es) + s
    ing = longer(4) & ending("ing")
    end -= 3 * ing + 2 * (longer(4) & ending("ed"))
    end -= longer(4) & ending("e")
    end -= longer(1) & (x[end - 1] == x[end - 2]) & last(1, "bdgklmnprt")
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    kept = x[np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(kept))


def _words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in their order, and how many each text has."""
    data = [x.lower().encode() for x in texts]
    x = _LETTER[np.frombuffer(b" ".join([*data, b""]), np.uint8)]
    said = x != 0
    change = np.flatnonzero(np.diff(said, prepend=False))  # where words begin, and end: the last byte is a space
    starts, ends = change[::2], change[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    at = np.cumsum([0, *(len(d) + 1 for d in data)])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(x[said])), np.diff(np.searchsorted(starts, at))


def counted(texts: list[str], titles: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(how many, terms, fs): of each page the number of its searchable stems, and page by page these and how often they occur; those of the
    title count TITLE_WEIGHT times. Each distinct word of all pages is stemmed once."""
    (words, n), (more, m) = _words(texts), _words(titles)
    coded = pa.concat_arrays([words, more]).dictionary_encode()
    found = stems(coded.dictionary).dictionary_encode()
    searched = pc.and_not(pc.greater_equal(pc.binary_length(found.dictionary), LEAST_TERM), pc.is_in(found.dictionary, value_set=pa.array(STOP_STEMS))).to_numpy(zero_copy_only=False)
    # a page and a term as one number
    term, size = found.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64), max(1, len(found.dictionary))
    key = np.concatenate([np.repeat(np.arange(len(texts)), n), np.repeat(np.arange(len(texts)), m)]) * size + term
    has = searched[term] if len(term) else np.zeros(0, bool)
    in_text, in_title = (np.unique(k[h], return_counts=True) for k, h in ((key[: len(words)], has[: len(words)]), (key[len(words) :], has[len(words) :])))
    keys = np.union1d(in_text[0], in_title[0])
    fs = np.zeros(len(keys), np.int64)
    fs[np.searchsorted(keys, in_text[0])] += in_text[1]
    fs[np.searchsorted(keys, in_title[0])] += TITLE_WEIGHT * in_title[1]
    return np.bincount(keys // size, minlength=len(texts)), found.dictionary.take(pa.array(keys % size)), fs


def _counted(text: Column, title: Column) -> Column:
    """struct<terms, fs, len> of texts and titles: counted(), and the sum of its counts."""

    @F.arrow_udf("struct<terms:array<string>,fs:array<bigint>,len:bigint>")
    def run(texts: pa.Array, titles: pa.Array) -> pa.Array:
        texts, titles = texts.to_pylist(), titles.to_pylist()
        sizes, each, lo = np.cumsum([0, *map(len, texts)]), [], 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + MOST_CHARACTERS, "right")) - 1)
            each.append(counted(texts[lo:hi], titles[lo:hi]))
            lo = hi
        at = np.cumsum([0, *np.concatenate([np.zeros(0, np.int64), *(n for n, _, _ in each)])])
        offsets, fs = pa.array(at, pa.int32()), np.concatenate([np.zeros(0, np.int64), *(f for _, _, f in each)])
        sums = np.concatenate([[0], np.cumsum(fs)])[at]
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.concat_arrays([pa.array([], pa.string()), *(t for _, t, _ in each)]), pa.array(fs))]
        return pa.StructArray.from_arrays([*lists, pa.array(np.diff(sums), pa.int64())], ["terms", "fs", "len"])

    return run(text, title)


def _frequencies(docs: DataFrame, sign: int) -> DataFrame:
    """(term, d): in how many of docs (terms, each once) a term is, times sign, in parts to be added up. Each task adds up its own, and hands
    them on when they have MOST_MET terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, n = [], 0
        for b in batches:
            c = pc.value_counts(b.column("terms").flatten())
            met.append(pa.table({"term": c.field("values"), "d": pc.multiply(c.field("counts"), sign)}))
            n += len(c)
            if n >= 2 * MOST_MET:
                met = [added(met)]
                n = len(met[0])
                if n >= MOST_MET:
                    yield from met[0].to_batches()
                    met, n = [], 0
        if met:
            yield from added(met).to_batches()

    def added(met: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(met).group_by("term").aggregate([("d", "sum")]).select(["term", "d_sum"]).rename_columns(["term", "d"])

    return docs.select("terms").mapInArrow(run, "term string, d long")


def _segment(store: str, name: str, held: DataFrame, dead: DataFrame, dropped: DataFrame, before: tuple[int, int]) -> dict:
    """Writes a segment of pages; dead: (seg, url) that it takes away, dropped: their docs. before: pages and total length so far."""
    spark, to = held.sparkSession, f"{store}/{name}"
    bounded_batches(spark)
    said = lambda c: F.coalesce(c, F.lit(""))
    docs = held.select("url", "hash", "section", "kind", "overview", _counted(said("text"), said("title")).alias("x")).select("url", "hash", "section", "kind", "overview", "x.terms", "x.fs", "x.len")
    docs = written(docs, f"{to}/docs")
    dead = written(dead, f"{to}/dead")
    new = docs.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    old = dropped.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    n, total = new[0] - old[0], new[1] - old[1]
    average = (before[1] + total) / (before[0] + n) if before[0] + n and before[1] + total else 1.0
    _frequencies(docs, 1).unionByName(_frequencies(dropped, -1)).groupBy("term").agg(F.sum("d").alias("df")).where("df <> 0").write.parquet(f"{to}/terms")
    return {"name": name, "n": n, "total": total, "avg": average}


def build(pages: DataFrame, store: str | None = None) -> Index:
    """An index of pages (url, title, text, section, kind, overview) in a folder, a new one if none is named. Pages without text aren't indexed;
    statistics are over all others. urls are unique."""
    spark = pages.sparkSession
    store = store or f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
    held, name = _held(pages), f"seg-{uuid.uuid4().hex}"
    none = held.select(F.lit("").alias("seg"), "url").limit(0)
    first = _segment(store, name, held, none, spark.createDataFrame([], "len long, terms array<string>"), (0, 0))
    commit(spark, f"{store}/manifest", 0, json.dumps([first]))
    return stored(pages, store)


def stored(pages: DataFrame, store: str) -> Index | None:
    """The index that a folder has of pages; None if it has none, or was never finished."""
    found = latest(pages.sparkSession, f"{store}/manifest")
    return Index(pages.where(F.trim(F.coalesce("text", F.lit(""))) != ""), store, json.loads(found[1])) if found else None


def update(index: Index, pages: DataFrame) -> Index:
    """The index after pages took the place of those that it was made of: only what is new or differs is read into terms, as a segment of its own;
    what differs or is gone is dead in the segments before."""
    spark = pages.sparkSession
    number, text = latest(spark, f"{index.store}/manifest")
    index = Index(index.pages, index.store, json.loads(text))
    held, docs = _held(pages), index.docs
    now, was = held.select("url", "hash"), docs.select("seg", "url", F.col("hash").alias("old"))
    name = f"seg-{uuid.uuid4().hex}"
    differ = written(now.join(was, "url", "full").where(~F.col("hash").eqNullSafe(F.col("old"))), f"{index.store}/{name}/differ")
    new, dead = differ.where("hash is not null").select("url"), differ.where("old is not null").select("seg", "url")
    if not differ.take(1):
        return Index(stored(pages, index.store).pages, index.store, index.segments)
    dropped = index.table("docs").join(dead, ["seg", "url"], "left_semi").select("len", "terms")
    before = tuple(sum(s[k] for s in index.segments) for k in ("n", "total"))
    segment = _segment(index.store, name, held.join(new, "url", "left_semi"), dead, dropped, before)
    commit(spark, f"{index.store}/manifest", number + 1, json.dumps([*index.segments, segment]))
    return stored(pages, index.store)


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, pos): the distinct terms of (qid, text), by where they first occur."""
    raw = queries.select("qid", F.posexplode(T.words(F.col("text"))).alias("pos", "word")).select("qid", "pos", T.stem(F.col("word")).alias("term"))
    return raw.where(searchable(F.col("term"))).groupBy("qid", "term").agg(F.min("pos").alias("pos"))


def _scored(index: Index, found: DataFrame, lists: DataFrame, average: float) -> DataFrame:
    """(qid, url, score, matched, section) of pages (qid, seg, url): BM25 with the overview boost, rounded to 6 places. lists: (qid, asked,
    idfs), a query's terms in their order."""
    docs = index.docs.select("seg", "url", "len", "section", "overview", "terms", "fs")
    held = found.join(docs, ["seg", "url"]).join(lists.select("qid", "asked", "idfs"), "qid").withColumn("matched", F.array_intersect("asked", "terms"))
    at = lambda values, keys, x: F.element_at(values, F.array_position(keys, x).cast("int"))
    add = lambda total, t: total + at("idfs", "asked", t) * gain(at("fs", "terms", t), F.col("len"), average)
    raw = F.aggregate("matched", F.lit(0.0), add)
    score = F.round(F.when(F.col("overview"), raw * OVERVIEW_BOOST).otherwise(raw), 6)
    return held.select("qid", "url", score.alias("score"), "matched", "section").where("score > 0")


def _ranked(found: DataFrame, limit: int, per_section: int | None) -> DataFrame:
    if per_section:
        place = F.row_number().over(Window.partitionBy("qid", "section").orderBy(F.desc("score"), "url"))
        found = found.withColumn("place", place).where(F.col("place") <= per_section).drop("place")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "url"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def _micro(scores: np.ndarray) -> np.ndarray:
    """Scores in millionths, rounded as Spark's round does: the shortest decimal that tells a double, halves upwards."""
    x = scores * 1e6
    out = np.floor(x + 0.5)
    for i in np.nonzero(np.abs(x - np.floor(x) - 0.5) < 1e-4)[0]:
        out[i] = int(Decimal(repr(float(scores[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return out.astype(np.int64)


class Best:
    """The best pages of each query of a block, over the pages of a task, by blocks of these. queries: (q, asked, idfs)."""

    def __init__(self, queries: pa.Table, limit: int, per_section: int | None, average: float):
        self.limit, self.per_section, self.average = limit, per_section, average
        sizes = pc.list_value_length(queries["asked"]).to_numpy()
        order = np.argsort(-sizes, kind="stable")  # longest first: those with an n-th term are the first so many
        queries, self.sizes = queries.take(order), sizes[order]
        self.q = queries["q"].to_numpy()
        coded = queries["asked"].combine_chunks().flatten().dictionary_encode()
        self.vocabulary, n, most = coded.dictionary, len(self.q), int(self.sizes.max(initial=0))
        where = np.arange(most) < self.sizes[:, None]
        self.at, self.idf = np.zeros((n, most), np.int64), np.zeros((n, most))
        self.at[where], self.idf[where] = coded.indices.to_numpy(), queries["idfs"].combine_chunks().flatten().to_numpy()
        self.rows = max(1, min(BLOCK_ROWS, CELLS // max(1, len(self.vocabulary))))
        self.gains = np.zeros((len(self.vocabulary), self.rows))
        self.least = np.zeros(n)  # in millionths: the score of the last place, once all are taken
        self.full = (np.zeros(0, np.int64),) * 3  # (query, section, score) of sections whose places are taken
        self.sections: dict = {}
        self.best: pa.Table | None = None
        self.met: list[pa.Table] = []
        self.n_met = 0

    def add(self, pages: pa.RecordBatch) -> None:
        for lo in range(0, pages.num_rows, self.rows):
            self._add(pages.slice(lo, self.rows))

    def _scores(self, pages: pa.RecordBatch) -> np.ndarray:
        """Of each query and page: terms are added in the order of the query, as the final scores add them."""
        n = pages.num_rows
        code = pc.fill_null(pc.index_in(pages.column("terms").flatten(), value_set=self.vocabulary), -1).to_numpy()
        page, f, length = np.repeat(np.arange(n), pc.list_value_length(pages.column("terms")).to_numpy()), pages.column("fs").flatten().to_numpy(), pages.column("len").to_numpy()
        has = code >= 0
        code, page = code[has], page[has]
        self.gains[code, page] = gain(f[has], length[page], self.average)
        out = np.zeros((len(self.q), n))
        for k in range(self.at.shape[1]):
            m = int(np.count_nonzero(self.sizes > k))
            out[:m] += self.idf[:m, k, None] * self.gains[self.at[:m, k], :n]
        self.gains[code, page] = 0
        boosted = pc.fill_null(pages.column("overview"), False).to_numpy(zero_copy_only=False)
        out[:, boosted] *= OVERVIEW_BOOST
        return out

    def _add(self, pages: pa.RecordBatch) -> None:
        scores = self._scores(pages)
        section = np.array([self.sections.setdefault(x, len(self.sections)) for x in pages.column("section").to_pylist()] if self.per_section else [0] * pages.num_rows, np.int64)
        hit = (scores > 0) & (scores * 1e6 >= self.least[:, None] - 1)
        if self.per_section:
            here, which = np.unique(section, return_inverse=True)
            own, (q, s, least) = np.zeros((len(self.q), len(here))), self.full
            known = np.isin(s, here)
            own[q[known], np.searchsorted(here, s[known])] = least[known]
            hit &= scores * 1e6 >= own[:, which] - 1
        q, page = np.nonzero(hit)
        kept = pages.select(["seg", "url", "section"]).take(pa.array(page))
        self.met.append(pa.table({"_q": q, "_section": section[page], "_score": _micro(scores[q, page]), **dict(zip(kept.schema.names, kept.columns, strict=True))}))
        self.n_met += len(q)
        if self.n_met >= SEED_ROWS * len(self.q) or len(self.met) >= SEED_BLOCKS:
            self._rank()

    @staticmethod
    def _first(rows: pa.Table, keys: list[str], most: int) -> tuple[pa.Table, np.ndarray]:
        """The first rows of each key by score, then url, and their places from 0."""
        rows = rows.take(pc.sort_indices(rows, sort_keys=[*((k, "ascending") for k in keys), ("_score", "descending"), ("url", "ascending")]))
        key = np.stack([rows[k].to_numpy() for k in keys])
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]) if len(rows) else np.zeros(0, bool)
        starts = np.nonzero(new)[0]
        place = np.arange(len(rows)) - np.repeat(starts, np.diff([*starts, len(rows)]))
        return rows.filter(pa.array(place < most)), place[place < most]

    def _rank(self) -> None:
        """Ranks what was gathered with what was best before. A page beyond the places of its section, or then beyond all, can't be in the result."""
        rows = pa.concat_tables([*self.met, *([self.best] if self.best is not None else [])])
        rows = rows.filter(pc.greater(rows["_score"], 0))
        self.met, self.n_met = [], 0
        if self.per_section:
            rows, _ = self._first(rows, ["_q", "_section"], self.per_section)
        rows, place = self._first(rows, ["_q"], self.limit)
        q, section, score = (rows[c].to_numpy() for c in ("_q", "_section", "_score"))
        last = place == self.limit - 1
        self.least[q[last]] = score[last]
        if self.per_section:
            order = np.lexsort((-score, section, q))
            new = np.concatenate([[True], (np.diff(q[order]) != 0) | (np.diff(section[order]) != 0)]) if len(q) else np.zeros(0, bool)
            starts = np.nonzero(new)[0]
            ends = starts + self.per_section - 1
            full = np.diff([*starts, len(q)]) == self.per_section
            at = order[ends[full]]
            self.full = (q[at], section[at], score[at])
        self.best = rows.combine_chunks()

    def result(self) -> pa.Table | None:
        """(q, seg, url, section, score in millionths) of the best pages."""
        if self.met:
            self._rank()
        if self.best is None:
            return None
        b = self.best
        return pa.table({"q": pa.array(self.q[b["_q"].to_numpy()], pa.int64()), "seg": b["seg"], "url": b["url"], "section": b["section"], "score": b["_score"]})


def _met(index: Index, lists: DataFrame, folder: str, limit: int, per_section: int | None, kinds: list[str] | None, average: float) -> DataFrame:
    """(qid, seg, url, section, score in millionths): of each task's pages the best of each query. A pass over the pages for each file of lists."""
    spark = lists.sparkSession
    bounded_batches(spark)
    docs = index.docs.where(F.col("kind").isin(kinds)) if kinds else index.docs
    docs = docs.select("seg", "url", "section", "overview", "len", "terms", "fs")
    kept = {f.name: f.dataType for f in docs.schema}
    schema = D.StructType([D.StructField("q", D.LongType()), *(D.StructField(c, kept[c]) for c in ("seg", "url", "section")), D.StructField("score", D.LongType())])

    def best(path: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, at = place(path)
            with system.open_input_file(at) as f:
                found = Best(pq.read_table(f, columns=["q", "asked", "idfs"]), limit, per_section, average)
            for b in batches:
                found.add(b)
            if (rows := found.result()) is not None:
                yield from rows.to_batches()

        return docs.mapInArrow(run, schema)

    out = None
    for path in parts(spark, folder):
        out = best(path) if out is None else out.unionByName(best(path))
    out = spark.createDataFrame([], schema) if out is None else out
    return out.join(lists.select("q", "qid"), "q").drop("q")


def search(index: Index, queries: DataFrame, limit: int = 10, per_section: int | None = 2, kinds: list[str] | None = None) -> DataFrame:
    """(qid, url, score, matched, section, rank): at most per_section pages of a section, then the best limit, by score, then url. kinds restrict
    the pages, not the statistics.

    All pages are scored for all queries, where they lie: a task goes over its pages once for a block of queries, in tables of terms, pages and
    queries, and keeps of each query the pages that can still be in the result. These alone, limit a task and query at most, are ranked together.
    """
    n, average = index.counts
    if not index.segments:
        raise ValueError("the index has no segment")
    df = index.table("terms").join(query_terms(queries).select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    asked = written(query_terms(queries).join(df, "term").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    passes = -(-asked.select("qid").distinct().count() // QUERY_BLOCK)
    lists = asked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "idf"))).alias("x")).select("qid", F.col("x.term").alias("asked"), F.col("x.idf").alias("idfs"))
    folder = f"{work_dir(queries.sparkSession)}/asked-{uuid.uuid4().hex}"
    lists = written(lists.repartition(max(1, passes)).withColumn("q", F.monotonically_increasing_id()), folder)
    met = _met(index, lists, folder, limit, per_section, kinds, average)
    found = written(_ranked(met, limit, per_section).select("qid", "seg", "url"))
    return _ranked(_scored(index, found, lists, average), limit, per_section)


def excerpts(hits: DataFrame, pages: DataFrame, queries: DataFrame, most: int = 700, extra: int = 4) -> DataFrame:
    """(qid, url, excerpt): the first sentence and up to extra others with most distinct query terms, in text order. Texts are joined to hits
    alone, after ranking."""
    asked = query_terms(queries).groupBy("qid").agg(F.collect_set("term").alias("terms"))
    # a written table is known to be small, so the texts stay where they are
    held = written(hits.select("qid", "url").join(asked, "qid")).join(pages.select("url", "text"), "url")
    each = held.select("qid", "url", "terms", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    stems = terms(F.col("s"))
    each = each.withColumn("n", F.size(F.array_intersect(stems, "terms")))
    place = F.row_number().over(Window.partitionBy("qid", "url").orderBy(F.desc(F.col("i") == 0), F.desc("n"), "i"))
    kept = each.withColumn("place", place).where((F.col("place") <= extra + 1) & ((F.col("i") == 0) | (F.col("n") > 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), " ")
    return kept.groupBy("qid", "url").agg(joined.alias("whole")).select("qid", "url", T.truncate(F.col("whole"), most).alias("excerpt"))


def context(index: Index, signals: DataFrame, overviews: DataFrame, limit: int = 10, per_section: int = 4, most_routed: int = 3) -> DataFrame:
    """(qid, url, why, place): the pages that a signal (qid, text, topics) is read beside: those that a search ranks highest, and the overviews
    (label, url) of its topics that are held and not among them, the first most_routed."""
    found = search(index, signals.select("qid", "text"), limit, per_section)
    hits = found.select("qid", "url", F.lit("search").alias("why"), F.col("rank").cast("int").alias("place"))
    routed = signals.select("qid", F.posexplode("topics").alias("place", "label")).join(F.broadcast(overviews), "label")  # the catalog: a row a topic
    routed = routed.join(index.pages.select("url"), "url", "left_semi").join(hits.select("qid", "url"), ["qid", "url"], "left_anti").groupBy("qid", "url").agg(F.min("place").alias("place"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("place", "url"))
    routed = routed.withColumn("place", nth).where(F.col("place") <= most_routed)
    return hits.unionByName(routed.select("qid", "url", F.lit("overview").alias("why"), (limit + F.col("place")).cast("int").alias("place")))


def signal_text(title: Column, raw: Column) -> Column:
    """What a signal says of itself: its title, the description, and the body, preview or text of its raw fields (JSON), by blank lines."""
    said = lambda *names: F.coalesce(*[F.when(F.trim(F.get_json_object(raw, f"$.{n}")) != "", F.get_json_object(raw, f"$.{n}")) for n in names])
    return F.concat_ws("\n\n", F.when(F.trim(title) != "", title), said("description"), said("body", "preview", "text"))
