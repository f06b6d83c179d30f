"""Cascading erasure rewrite: a co-ordered merge scan of crc-sorted files and victims.

Tables are laid out once (`lay_out`): sorted by a crc of the person that a row belongs to, then by all columns, in files of equally many rows.
Beside each file, in a work folder, lie the crcs of its rows, as the tables themselves have none. A manifest names of each file its first and last
(crc, key).

Erasing (`erase`) sends no table through a shuffle. The victims, keys alone, are dealt to the files whose range holds them and sorted as these
are; a task reads its file in batches and advances two cursors, one in the file, one in the victims, each forward only. A row and a victim of one
crc are compared by key, so colliding crcs erase nothing else. A file without a victim is left as it is, having been read in two columns; another is
read once more, and its survivors are written in order. Files are written under names of their own in a staging folder, once for each try of a
task, and moved into place when all have been written, so that a lost executor or a second try leaves nothing behind.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import work_dir, written

#: Files of a table: 1 + floor(n / FILES) rows each, so FILES + 1 at most. VICTIM_SHARE: the part of all masters that is erased.
FILES, VICTIM_SHARE = 350, 400
#: Rows of a row group, and of a batch that is merged at once.
GROUP_ROWS, BATCH_ROWS = 1 << 17, 1 << 16
LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Layout:
    """A table to erase from: the column by which a row is a victim, and the column that is summed up."""

    name: str
    key: str
    amount: str


LAYOUTS = (Layout("clients", "master_id", "balance"), Layout("clicks", "client_id", "value"), Layout("sales", "client_id", "total"), Layout("sale_lines", "sale_id", "amount"))


def _crc(c: Column) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")))


# ---------------------------------------------------------------- files


def _place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """A path of the shared folder for pyarrow: a local one, or an address with a scheme."""
    if "://" not in path and not path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def batches_of(path: str, columns: list[str] | None = None, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """A Parquet file's rows in their order, some at a time."""
    system, at = _place(path)
    with system.open_input_file(at) as f:
        yield from pq.ParquetFile(f).iter_batches(batch_size=rows, columns=columns)


class Writer:
    """A Parquet file that is written as batches come; its statistics are those of these batches."""

    def __init__(self, path: str, schema: pa.Schema):
        self.system, self.at = _place(path)
        self.system.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(self.at)
        self.file = pq.ParquetWriter(self.out, schema, compression="snappy", write_statistics=True)
        self.schema, self.rows, self.held, self.waiting = schema, 0, [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows += batch.num_rows
        self.waiting += batch.num_rows
        if self.waiting >= GROUP_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.file.write_table(pa.Table.from_batches(self.held, self.schema), row_group_size=GROUP_ROWS)
            self.held, self.waiting = [], 0

    def close(self) -> int:
        self._flush()
        self.file.close()
        self.out.close()
        return self.rows


def _move(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    """Renames files within the shared folder; what is at the second name goes first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for source, target in pairs:
        a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
        system = a.getFileSystem(conf)
        system.mkdirs(b.getParent())
        system.delete(b, False)
        if not system.rename(a, b):
            raise OSError(f"{source} can't be renamed to {target}")


def _remove(spark: SparkSession, paths: list[str], all_below: bool = False) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, all_below)


# ---------------------------------------------------------------- layout

_MANIFEST = "file_no long, n_rows long, first_crc long, last_crc long, first_key long, last_key long, ordered boolean, written_to string, crcs string"


def _batch(kinds: str, *columns) -> pa.RecordBatch:
    """A batch with the names of a schema of ours, from columns of values."""
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [c.split() for c in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, types[t]) for v, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def lay_out(rows: DataFrame, layout: Layout, folder: str, stage: str, files: int = FILES) -> DataFrame:
    """Writes a table, given as (row: a struct of all its columns, crc), sorted by crc and then by all columns from left to right, as Parquet
    files `folder/name/00000.parquet` and so on, of 1 + floor(n / files) rows each, and returns the manifest: file_no, n_rows, first and last crc
    and key, ordered (whether rows of one crc are sorted by the key), path, crcs (path of the file of crcs).

    Nulls come first, equal rows stay, an empty table gives no file. A file is written by one task, in batches.
    """
    spark = rows.sparkSession
    parted = rows.select("row", "crc").orderBy("crc", "row").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    parted.write.parquet(f"{stage}/sorted-{layout.name}")
    ordered = spark.read.schema(parted.schema).parquet(f"{stage}/sorted-{layout.name}")
    counts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition of the sort
    total, before, starts = sum(counts.values()), 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    size = 1 + total // files
    placed = ordered.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").withColumn("n", F.col("start") + F.col("at"))
    many = max(1, math.ceil(total / size))
    parts = _parts(spark, many)
    filed = placed.withColumn("file", F.floor(F.col("n") / size).cast("int"))
    dealt = filed.repartitionById(parts, F.col("file") % parts).sortWithinPartitions("n").select("file", "crc", "row")

    def write(batches):
        at = target = None

        def closed():
            if target is not None:
                crcs.close()
                yield _batch(_MANIFEST, *[[v] for v in (at, target.close(), first[0], last[0], first[1], last[1], named, to, to_crcs)])

        for batch in batches:
            file = batch.column("file").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), len(file)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                crc, data = batch.column("crc").slice(lo, hi - lo), pa.RecordBatch.from_struct_array(batch.column("row").slice(lo, hi - lo))
                key = data.column(layout.key)
                if file[lo] != at:
                    yield from closed()
                    at, token, first = int(file[lo]), uuid.uuid4().hex, (crc[0].as_py(), key[0].as_py())
                    to, to_crcs = (f"{stage}/{kind}-{layout.name}/{token}.parquet" for kind in ("try", "crcs"))
                    target, crcs, named = Writer(to, data.schema), Writer(to_crcs, pa.schema([("crc", pa.int64())])), data.schema.names[0] == layout.key
                last = (crc[-1].as_py(), key[-1].as_py())
                target.add(data)
                crcs.add(pa.RecordBatch.from_arrays([crc], ["crc"]))
        yield from closed()

    made = written(dealt.mapInArrow(write, _MANIFEST), "manifest")
    # files + 1 rows at most
    _move(spark, [(r["written_to"], f"{folder}/{layout.name}/{r['file_no']:05d}.parquet") for r in made.select("file_no", "written_to").collect()])
    path = F.concat(F.lit(f"{folder}/{layout.name}/"), F.lpad(F.col("file_no").cast("string"), 5, "0"), F.lit(".parquet"))
    return made.withColumn("path", path).drop("written_to")


# ---------------------------------------------------------------- the merge scan


class Victims:
    """The cursor over the victims of one file: sorted (crc, key) that come in batches. Only what a batch of the file may meet is held."""

    def __init__(self, source: Iterator[tuple[np.ndarray, np.ndarray]]):
        self.source, self.crc, self.key = source, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _more(self) -> bool:
        got = next(self.source, None)
        if got is not None:
            self.crc, self.key = np.concatenate([self.crc, got[0]]), np.concatenate([self.key, got[1]])
        return got is not None

    def reach(self, crc: int, key: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All held victims up to and with (crc, key), or up to and with crc, if no key is given."""
        beyond = lambda: len(self.crc) and (self.crc[-1] > crc or key is not None and self.crc[-1] == crc and self.key[-1] > key)
        while not beyond() and self._more():
            pass
        return self.crc, self.key

    def drop(self, crc: int, key: int | None) -> None:
        """Forgets the victims before (crc, key), or before crc: the file won't meet them any more."""
        lo, hi = np.searchsorted(self.crc, crc), np.searchsorted(self.crc, crc, "right")
        at = lo if key is None else lo + np.searchsorted(self.key[lo:hi], key)
        self.crc, self.key = self.crc[at:], self.key[at:]


def struck(crc: np.ndarray, key: np.ndarray, known: np.ndarray, v_crc: np.ndarray, v_key: np.ndarray) -> np.ndarray:
    """For each row whether its (crc, key) is a victim's; rows whose key isn't known are none's. Crcs are of 32 bits; the keys that occur are
    numbered, so that a pair is one number of 64 bits."""
    out = np.zeros(len(crc), bool)
    rows = np.flatnonzero(known & (np.searchsorted(v_crc, crc) < np.searchsorted(v_crc, crc, "right")))
    if len(rows):
        near = np.isin(v_crc, crc[rows])
        names = np.unique(v_key[near])
        at = np.minimum(np.searchsorted(names, key[rows]), len(names) - 1)
        pair = (v_crc[near] << 31) | np.searchsorted(names, v_key[near])
        out[rows] = (names[at] == key[rows]) & np.isin((crc[rows] << 31) | at, pair)
    return out


def _columns(batch: pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray]:
    k = batch.column(key)
    return pc.fill_null(k, 0).to_numpy(zero_copy_only=False).astype(np.int64), k.is_valid().to_numpy(zero_copy_only=False)


def scan(path: str, crcs: str, key_column: str, ordered: bool, victims: Victims, columns: list[str] | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A file's batches, each with a flag for every row: whether it is a victim. ordered: rows of one crc are sorted by the key, nulls first."""
    keys = batches_of(crcs)
    for batch in batches_of(path, columns):
        crc = next(keys).column(0).to_numpy()
        if len(crc) != batch.num_rows:
            raise ValueError(f"{crcs} doesn't belong to {path}")
        key, known = _columns(batch, key_column)
        last = int(crc[-1]), int(key[-1]) if ordered and known[-1] else None
        out = struck(crc, key, known, *victims.reach(*last))
        victims.drop(*last)
        yield batch, out


_LOG = "table_name string, file_no long, n_rows long, n_erased long, written_to string"
_DEAL = ("ordinal", "kind", "crc", "key", "table_name", "file_no", "ordered", "path", "crcs")
#: Victims meet files by the upper bits of their crcs first.
SHIFT = 20


def _queue(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """From rows sorted by (ordinal, kind, crc, key) each file and an iterator over its victims, which may be left before its end."""
    source, held = batches, None

    def fetch() -> bool:
        nonlocal held
        while held is None or not held.num_rows:
            held = next(source, None)
            if held is None:
                return False
        return True

    def victims(ordinal: int):
        nonlocal held
        while fetch():
            same = (held.column("ordinal").to_numpy() == ordinal) & (held.column("kind").to_numpy() == 1)
            n = len(same) if same.all() else int(np.argmin(same))
            if not n:
                return
            part, held = held.slice(0, n), held.slice(n)
            yield part.column("crc").to_numpy(), part.column("key").to_numpy()

    while fetch():
        file = {c: held.column(c)[0].as_py() for c in _DEAL}
        held = held.slice(1)
        mine = victims(file["ordinal"])
        yield file, mine
        for _ in mine:
            pass


def erase(manifests: dict[str, DataFrame], victims: dict[str, DataFrame], layouts: tuple[Layout, ...], folder: str, stage: str) -> DataFrame:
    """Rewrites the files of `lay_out` without the rows of victims and returns a table of all files: (table_name, file_no, n_rows, n_erased,
    rewritten, ordinal, path); of files that got empty, and are gone, too. victims: by table the (crc, key) to erase, each once; null keys are nobody's.

    A file that holds no victim isn't touched. One that does is replaced by its survivors, in order, or removed if there are none. A table or
    list of victims that is empty is fine.
    """
    spark = next(iter(manifests.values())).sparkSession
    files = None
    for i, layout in enumerate(layouts):
        f = manifests[layout.name].select("*", F.lit(layout.name).alias("table_name"), (F.lit(i * (FILES + 1)) + F.col("file_no")).cast("int").alias("ordinal"))
        files = f if files is None else files.unionByName(f)
    files = written(files, "files")
    parts = _parts(spark, files.count())
    nothing = lambda kind, *cols: [F.lit(None).cast(kind).alias(c) for c in cols]
    rows = files.select("ordinal", F.lit(0).alias("kind"), *nothing("long", "crc", "key"), "table_name", "file_no", "ordered", "path", "crcs")
    for layout in layouts:
        v = victims[layout.name].where("key is not null").select(F.col("crc").cast("long").alias("crc"), F.col("key").cast("long").alias("key")).distinct()
        f = files.where(F.col("table_name") == layout.name).select("ordinal", "ordered", "first_crc", "last_crc", "first_key", "last_key")
        # files + 1 rows, and one for each further range of 2^SHIFT crcs that a file meets
        f = f.withColumn("range", F.explode(F.sequence(F.shiftright("first_crc", SHIFT), F.shiftright("last_crc", SHIFT))))
        met = v.withColumn("range", F.shiftright("crc", SHIFT)).join(F.broadcast(f), "range").where(F.col("crc").between(F.col("first_crc"), F.col("last_crc")))
        # in ordered files a victim lies where its (crc, key) does, or in more, where its rows are split
        early = (F.col("crc") == F.col("first_crc")) & F.col("first_key").isNotNull() & (F.col("key") < F.col("first_key"))
        late = (F.col("crc") == F.col("last_crc")) & (F.col("last_key").isNull() | (F.col("key") > F.col("last_key")))
        met = met.where(~F.col("ordered") | ~(early | late))
        rows = rows.unionByName(met.select("ordinal", F.lit(1).alias("kind"), "crc", "key", *nothing("string", "table_name"), *nothing("long", "file_no"), *nothing("boolean", "ordered"), *nothing("string", "path", "crcs")))
    dealt = rows.repartitionById(parts, F.col("ordinal") % parts).sortWithinPartitions("ordinal", "kind", "crc", "key").select(*_DEAL)
    by_name = {x.name: x for x in layouts}

    def run(batches):
        for file, mine in _queue(iter(batches)):
            layout, path, crcs = by_name[file["table_name"]], file["path"], file["crcs"]
            n = gone = 0
            flags = []  # a bit for each row of the file, packed
            for _, out in scan(path, crcs, layout.key, file["ordered"], Victims(mine), [layout.key]):
                n, gone = n + len(out), gone + int(out.sum())
                flags.append((len(out), np.packbits(out) if out.any() else None))
            to = None
            if 0 < gone < n:
                to = f"{stage}/try-{layout.name}/{uuid.uuid4().hex}.parquet"
                target = None
                for batch, (size, bits) in zip(batches_of(path), flags, strict=True):
                    target = target or Writer(to, batch.schema)
                    target.add(batch if bits is None else batch.filter(pa.array(np.unpackbits(bits, count=size) == 0)))
                target.close()
            yield _batch(_LOG, [layout.name], [file["file_no"]], [n - gone], [gone], [to])

    log = written(dealt.mapInArrow(run, _LOG), "erased")
    changed = log.where("n_erased > 0").collect()
    at = lambda r: f"{folder}/{r['table_name']}/{r['file_no']:05d}.parquet"
    _move(spark, [(r["written_to"], at(r)) for r in changed if r["written_to"]])
    _remove(spark, [at(r) for r in changed if not r["written_to"]])
    return log.join(F.broadcast(files.select("table_name", "file_no", "ordinal", "path")), ["table_name", "file_no"]).select("table_name", "file_no", "n_rows", "n_erased", (F.col("n_erased") > 0).alias("rewritten"), "ordinal", "path")


def _parts(spark: SparkSession, files: int) -> int:
    """Tasks for so many files."""
    return max(1, min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)))


# ---------------------------------------------------------------- the shop


def _owners(sales: DataFrame) -> DataFrame:
    """(sale_id, client_id): whose a sale is. A sale_id that repeats is its least client's."""
    return sales.where("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("owner"))


def victim_masters(clients: DataFrame, clicks: DataFrame, share: int = VICTIM_SHARE) -> DataFrame:
    """(master_id): those whose crc32 is divisible by share, and the one whose clients together have most clicks, ties to the least."""
    own = clients.where("master_id is not null").select("client_id", "master_id").distinct()
    counts = clicks.where("client_id is not null").groupBy("client_id").agg(F.count("*").alias("n"))
    busiest = own.join(counts, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).orderBy(F.desc("n"), "master_id").limit(1).select("master_id")
    return own.select("master_id").where(_crc(F.col("master_id")) % share == 0).union(busiest).distinct()


def rewrite(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame) -> DataFrame:
    """Lays the four tables out in a new folder of the shared one, erases the victims of `victim_masters` from all, and returns the files as
    `erase` does.

    A line belongs to its sale's client; lines without a sale or with a null sale_id, and rows with a null client_id, to nobody (crc of the empty
    string), and stay, except that a client row with a victim's master_id goes whatever its client_id. Repeated rows are kept or go alike.
    """
    spark = clients.sparkSession
    token = uuid.uuid4().hex
    folder, stage = f"{work_dir(spark)}/erasure-{token}", f"{work_dir(spark)}/erasure-work-{token}"
    whole = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    by_client = lambda df: df.select(whole(df), _crc(F.col("client_id")).alias("crc"))
    owners = written(_owners(sales), "owners")  # a table, so that a sale with many lines is split in the join
    lines = sale_lines.select(whole(sale_lines), F.col("sale_id").alias("sale")).join(owners.select(F.col("sale_id").alias("sale"), "owner"), "sale", "left").select("row", _crc(F.col("owner")).alias("crc"))
    sources = {"clients": by_client(clients), "clicks": by_client(clicks), "sales": by_client(sales), "sale_lines": lines}
    manifests = {x.name: lay_out(sources[x.name], x, folder, stage) for x in LAYOUTS}
    masters = victim_masters(clients, clicks)
    gone = written(clients.join(masters, "master_id", "left_semi").select("client_id", "master_id").distinct(), "gone")
    ids = gone.where("client_id is not null").select("client_id").distinct()
    by_id = ids.select(_crc(F.col("client_id")).alias("crc"), F.col("client_id").alias("key"))
    # a sale may have rows of several clients: it goes if one of them does, and its lines lie at its owner's crc
    their = sales.where("sale_id is not null").select("sale_id", "client_id").join(ids, "client_id", "left_semi").select("sale_id").distinct()
    by_sale = owners.join(their, "sale_id", "left_semi").select(_crc(F.col("owner")).alias("crc"), F.col("sale_id").alias("key"))
    victims = {"clients": gone.select(_crc(F.col("client_id")).alias("crc"), F.col("master_id").alias("key")), "clicks": by_id, "sales": by_id, "sale_lines": by_sale}
    done = erase(manifests, victims, LAYOUTS, folder, stage)
    done = written(done, "done")
    _remove(spark, [stage], True)
    return done


# ---------------------------------------------------------------- reading the files back


def _cents(x: pa.Array) -> int:
    """The sum of floor(100 * x + 0.5); null and what isn't finite count 0."""
    v = pc.fill_null(x.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    v = np.floor(100 * np.where(np.isfinite(v), v, 0.0) + 0.5)
    small = np.abs(v) < 2.0**40
    return int(v[small].astype(np.int64).sum()) + sum(int(y) for y in v[~small] if np.isfinite(y))


def digest(path: str, amount: str) -> tuple[int, int, str, str]:
    """(rows, cents, sha256 of the first column, names of the columns) of a file, read in batches."""
    system, at = _place(path)
    seen, n, cents = hashlib.sha256(), 0, 0
    with system.open_input_file(at) as f:
        file = pq.ParquetFile(f)
        names = file.schema_arrow.names
        for batch in file.iter_batches(batch_size=BATCH_ROWS, columns=list(dict.fromkeys([names[0], amount]))):
            ids = pc.fill_null(batch.column(names[0]).cast(pa.string()), "").to_pylist()
            if ids:
                seen.update((("," if n else "") + ",".join(ids)).encode())
            n += len(ids)
            cents += _cents(batch.column(amount))
    return n, cents, seen.hexdigest(), ",".join(names)


_REPORT = "file_no long, n_rows long, n_erased long, cents long, rewritten boolean, table_name string, ids_sha256 string, columns string, path string"


def report(files: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """What is in each file of `rewrite` that is left, read from the files, a task a file: _REPORT."""
    amounts = {x.name: x.amount for x in layouts}
    left = files.where("n_rows > 0").select("file_no", "n_erased", "rewritten", "table_name", "path", "ordinal")
    parts = _parts(files.sparkSession, left.count())
    dealt = left.repartitionById(parts, F.col("ordinal") % parts)

    def read(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n, cents, sha, names = digest(r["path"], amounts[r["table_name"]])
                out.append((r["file_no"], n, r["n_erased"], max(LONG.min, min(LONG.max, cents)), r["rewritten"], r["table_name"], sha, names, r["path"]))
            if out:
                yield _batch(_REPORT, *zip(*out, strict=True))

    return dealt.mapInArrow(read, _REPORT)
