"""Queries read whole texts: fixtures whose telling part comes late in a text, against brute force."""

import re

import pytest

from siltflow.plans import catalog


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    def write(texts):
        sf = str(tmp_path_factory.mktemp("whole"))
        rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{sf}/documents.parquet")
        return sf

    return write


LONG = [" ".join(f"w{(7 * i + i // 5) % 23}" for i in range(n)) for n in (12, 95, 590, 700)]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return row[-1]


def edited(text):
    return re.sub(r"(\S+) (\S+) (\S+)", r"\1 \3", text) + " and more words here"


def test_differences_are_of_whole_texts(spark, documents):
    sf = documents(LONG)
    spans, runs = ({i: [] for i in range(len(LONG))} for _ in range(2))
    for name, out in (("word_diff", spans), ("copy_runs", runs)):
        for r in sorted(catalog.QUERIES[name](spark, sf).collect(), key=lambda r: (r.doc_id, r.pos)):
            out[r.doc_id].append((r.kind, r.text))
    numbers = {r.doc_id: r for r in catalog.QUERIES["edit_proportion"](spark, sf).collect()}
    for i, before in enumerate(LONG):
        after = edited(before)
        a, b = before.split(), after.split()
        part = lambda *kinds: " ".join(t for k, t in spans[i] if k in kinds).split()  # noqa: B023, E731
        assert part("same", "removed") == a and part("same", "added") == b
        assert "".join(t for _, t in runs[i]).split() == b
        kept = common(a, b) if max(len(a), len(b)) <= 600 else 0
        assert (len(part("same")), numbers[i].removed, numbers[i].added) == (kept, len(a) - kept, len(b) - kept)
    assert [k for k, _ in spans[3]] == ["removed", "added"]


def test_batches_of_whole_texts_are_small(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F
    from siltflow.plans.base import table

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = table(spark, "/root/testdata/sf0.01", "documents").select(F.col("doc_id").cast("long").alias("doc_id")).coalesce(1)
    most = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").agg(F.max("n")).first()[0]
    assert most <= 256


def test_a_table_of_differences_is_a_number_a_word():
    import sys

    from siltflow.functions import diff as D

    a, b = [str(i) for i in range(600)], [str(i) for i in range(0, 1200, 2)]
    t = D.table(a, b)
    assert t[0, 0] == 300 and sum(map(sys.getsizeof, t.rows)) < 100_000


def test_words_are_counted_as_before():
    from siltflow.functions import diff as D

    for text in ("", "a, b - 3. ... x-", " K İx ١ ß\x1cq !z", "A b c"):
        assert D.count(text) == sum(any(c.isascii() and c.isalnum() for c in w) for w in text.lower().split())
