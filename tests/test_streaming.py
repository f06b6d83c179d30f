import glob
import os
import random

from siltflow.operators import signals as S
from siltflow.streaming.ingest import ingest

ITEMS = "ord long, source string, external_id long, published_at timestamp"


def rows(seed, n, most):
    r = random.Random(seed)
    return [(i + seed * 10_000, r.choice(["a", "b", None]), r.choice([None, *range(most)]), None) for i in range(n)]


def read(spark, store):
    return sorted(map(repr, (tuple(r)[:4] for r in spark.read.parquet(store).select("ord", "source", "external_id", "published_at").collect())))


def batch_insert(batches):
    """The least ord of each key in the first batch that has it."""
    out, seen = [], set()
    for batch in batches:
        first = {}
        for r in batch:
            if r[1:3] not in seen and (r[1:3] not in first or r[0] < first[r[1:3]][0]):
                first[r[1:3]] = r
        seen |= set(first)
        out += first.values()
    return sorted(map(repr, out))


def test_two_runs_equal_batch_inserts_and_never_read_the_store(spark, tmp_path):
    batches = [rows(1, 300, 90), rows(2, 300, 150)]
    seen = []
    for i, b in enumerate(batches):
        spark.createDataFrame(b, ITEMS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(ITEMS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        ingest(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint")
        seen.append({f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/store/*/*.parquet")})
    assert read(spark, f"{tmp_path}/store") == batch_insert(batches)
    assert all(seen[1][f] == t for f, t in seen[0].items())
    # what was there may be gone: keys are state, not rows that are read again
    spark.createDataFrame(batches[0], ITEMS).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    os.rename(f"{tmp_path}/store", f"{tmp_path}/moved")
    stream = spark.readStream.schema(ITEMS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ingest(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint")
    assert read(spark, f"{tmp_path}/store") == []


def test_keys_known_from_the_start(spark, tmp_path):
    stored = spark.createDataFrame(rows(3, 50, 90), ITEMS)
    spark.createDataFrame(rows(4, 200, 90), ITEMS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ITEMS).parquet(f"{tmp_path}/in")
    ingest(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint", stored=stored.where("source is not null and external_id is not null"))
    known = {r[1:3] for r in rows(3, 50, 90) if None not in r[1:3]}
    assert read(spark, f"{tmp_path}/store") == batch_insert([[r for r in rows(4, 200, 90) if r[1:3] not in known]])
    assert S.KEY == ("source", "external_id")
