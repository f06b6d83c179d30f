import functools
import glob
import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltflow.llm import erasure, queries

NAMES = ("clients", "clicks", "sales", "sale_lines")
AMOUNT = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


def by_cell(a, b):
    for x, y in zip(a, b):
        if x != y:
            if x is None or y is None:
                return -1 if x is None else 1
            if isinstance(x, str):
                x, y = x.encode(), y.encode()
            return -1 if x < y else 1
    return 0


def brute(tables):
    """tables: by name (column names, rows as tuples). The rows that op12 has to return, without path, and the survivors of each file."""
    at = {n: {c: i for i, c in enumerate(cols)} for n, (cols, _) in tables.items()}
    owner, out, kept = {}, [], {}
    for r in tables["sales"][1]:
        s, c = r[at["sales"]["sale_id"]], r[at["sales"]["client_id"]]
        if s is not None and (s not in owner or c is not None and (owner[s] is None or c < owner[s])):
            owner[s] = c
    clicks = Counter(r[at["clicks"]["client_id"]] for r in tables["clicks"][1])
    own = defaultdict(set)
    for r in tables["clients"][1]:
        if r[at["clients"]["master_id"]] is not None:
            own[r[at["clients"]["master_id"]]].add(r[at["clients"]["client_id"]])
    masters = {m for m in own if crc(m) % 400 == 0}
    if own:
        masters.add(min(own, key=lambda m: (-sum(clicks[c] for c in own[m] if c is not None), m)))
    people = {c for m in masters for c in own[m] if c is not None}
    sold = {r[at["sales"]["sale_id"]] for r in tables["sales"][1] if r[at["sales"]["client_id"]] in people} - {None}
    for n in NAMES:
        cols, rows = tables[n]
        who = (lambda r: owner.get(r[at[n]["sale_id"]])) if n == "sale_lines" else (lambda r: r[at[n]["client_id"]])  # noqa: B023
        gone = {"clients": lambda r: r[at[n]["master_id"]] in masters, "sale_lines": lambda r: r[at[n]["sale_id"]] in sold}.get(n, lambda r: r[at[n]["client_id"]] in people)  # noqa: B023
        rows = sorted(rows, key=functools.cmp_to_key(lambda a, b: (crc(who(a)) > crc(who(b))) - (crc(who(a)) < crc(who(b))) or by_cell(a, b)))  # noqa: B023
        size = 1 + len(rows) // 350
        for f in range(math.ceil(len(rows) / size)):
            mine = rows[f * size : (f + 1) * size]
            left = [r for r in mine if not gone(r)]
            if left:
                cents = sum(math.floor(100 * x + 0.5) for r in left if (x := r[at[n][AMOUNT[n]]]) is not None and math.isfinite(x))
                ids = ",".join("" if r[0] is None else str(r[0]) for r in left)
                out.append((n, f, len(left), len(mine) - len(left), cents, len(left) < len(mine), hashlib.sha256(ids.encode()).hexdigest(), ",".join(cols)))
                kept[n, f] = left
    return sorted(out), kept


def check(spark, tables):
    """Runs the operator on DataFrames and compares files and report with brute(). Returns the report."""
    plain = {n: (df.columns, [tuple(r) for r in df.collect()]) for n, df in tables.items()}
    want, kept = brute(plain)
    files = erasure.rewrite(*(tables[n] for n in NAMES))
    got = erasure.report(files).collect()
    assert sorted((r.table_name, r.file_no, r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256, r.columns) for r in got) == want
    for r in got:
        table = pq.read_table(r.path)
        assert [tuple(x.values()) for x in table.to_pylist()] == kept[r.table_name, r.file_no]
        meta = pq.ParquetFile(r.path).metadata
        stats = [meta.row_group(g).column(0).statistics for g in range(meta.num_row_groups)]
        ids = [x[0] for x in kept[r.table_name, r.file_no] if x[0] is not None]
        assert not ids or (min(s.min for s in stats if s.has_min_max), max(s.max for s in stats if s.has_min_max)) == (min(ids), max(ids))
    if got:
        root = os.path.dirname(os.path.dirname(got[0].path))
        assert sorted(glob.glob(f"{root}/**/*.parquet", recursive=True)) == sorted(r.path for r in got)
    return got


CLIENTS = "client_id long, master_id long, source string, balance double"
CLICKS = "click_id long, client_id long, value double, row string, crc int"
SALES = "sale_id long, client_id long, total double"
LINES = "sale_id long, line_no int, amount double, sale string, owner int"


def fixture(spark, seed=1, n=40):
    rng = np.random.default_rng(seed)
    some = lambda lo, hi: None if rng.random() < 0.1 else int(rng.integers(lo, hi))
    clients = [(some(0, n), some(0, n // 2), rng.choice(["a", "b", "é"]), rng.choice([None, 1.005, -2.5, float(i)])) for i in range(n)]
    clicks = [(some(0, 900), 3 if rng.random() < 0.3 else some(0, n + 5), rng.choice([None, 0.125, 1e9]), "x", 1) for _ in range(900)]
    sales = [(some(0, 120), some(0, n + 5), 1.5 * i) for i in range(150)]
    lines = [(7 if rng.random() < 0.3 else some(0, 140), int(rng.integers(3)), 0.25, "s", None) for _ in range(800)]
    return {n: spark.createDataFrame(r, s) for n, r, s in zip(NAMES, (clients, clicks, sales, lines), (CLIENTS, CLICKS, SALES, LINES))}


@pytest.mark.parametrize("seed", [1, 2])
def test_files_and_report_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(erasure, "BATCH_ROWS", 2)
    got = check(spark, fixture(spark, seed))
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)


def test_empty_tables(spark):
    tables = fixture(spark)
    assert {r.table_name for r in check(spark, tables | {"clicks": tables["clicks"].limit(0), "sale_lines": tables["sale_lines"].limit(0)})} == {"clients", "sales"}
    assert check(spark, {n: t.limit(0) for n, t in tables.items()}) == []


def test_equal_counts_go_to_the_least_master(spark):
    none = {n: t.limit(0) for n, t in fixture(spark).items()}
    clients = spark.createDataFrame([(1, 9, "a", 1.0), (2, 8, "a", 1.0), (3, None, "b", None)], CLIENTS)
    assert [r.master_id for r in erasure.victim_masters(clients, none["clicks"]).collect()] == [8]
    assert len(check(spark, none | {"clients": clients})) == 2


def test_untouched_files_are_not_written_again(spark, monkeypatch):
    times = {}
    plain = erasure.erase

    def watched(manifests, victims, layouts, folder, stage):
        times.update({p: (os.stat(p).st_mtime_ns, os.stat(p).st_ino) for p in glob.glob(f"{folder}/*/*.parquet")})
        return plain(manifests, victims, layouts, folder, stage)

    monkeypatch.setattr(erasure, "erase", watched)
    for r in erasure.report(erasure.rewrite(*(fixture(spark)[n] for n in NAMES))).collect():
        assert r.rewritten == (times[r.path] != (os.stat(r.path).st_mtime_ns, os.stat(r.path).st_ino))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6))), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), unique=True), st.integers(1, 4), st.booleans())
def test_two_cursors(rows, victims, step, ordered):
    """Crcs collide, and cursors go forward only."""
    rows, victims = sorted(rows) if ordered else sorted(rows, key=lambda r: r[0]), sorted(victims)
    source = ((np.array([c for c, _ in victims[i : i + 2]]), np.array([k for _, k in victims[i : i + 2]])) for i in range(0, len(victims), 2))
    cursor, out = erasure.Victims(source), []
    for i in range(0, len(rows), step):
        c, k = (np.array(x) for x in zip(*rows[i : i + step]))
        last = int(c[-1]), int(k[-1]) if ordered else None
        out += erasure.struck(c, k, np.ones(len(c), bool), *cursor.reach(*last)).tolist()
        cursor.drop(*last)
    assert out == [r in victims for r in rows]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    plain = {}
    for n in NAMES:
        t = pq.read_table(f"{sf}/{n}.parquet")
        plain[n] = (t.column_names, [tuple(r.values()) for r in t.to_pylist()])
    got = queries.op12_erasure(spark, sf).collect()
    assert sorted((r.table_name, r.file_no, r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256, r.columns) for r in got) == brute(plain)[0]
