"""The shared folder for tables that a run writes, and how a stored table is matched to the files it was made of."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from functools import lru_cache

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows in an Arrow batch: whole texts, and what is made of them, are held a batch at a time.
BATCH_ROWS = 256


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size for the Python stages of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder on one machine (tests); executors of a cluster couldn't read that, so there
    it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return found or _temporary()


@lru_cache(maxsize=None)
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="siltflow-")


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = path or f"{work_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path), so that any storage that Spark reads will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """(Arrow's file system of a path, the path there), for tasks that read a shared file themselves."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def parts(spark: SparkSession, folder: str) -> list[str]:
    """The files of a written table, for tasks that read one whole."""
    fs, at = file_system(spark, folder)
    return sorted(str(f.getPath().toString()) for f in fs.listStatus(at) if f.getPath().getName().endswith(".parquet"))


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes with the names, sizes and times of the files under a path."""
    fs, at = file_system(spark, path)
    seen = hashlib.sha1(path.encode())
    if fs.exists(at):
        files = fs.listFiles(at, True)
        rows = []
        while files.hasNext():
            f = files.next()
            rows.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
        seen.update("\n".join(sorted(rows)).encode())
    return seen.hexdigest()


def commit(spark: SparkSession, folder: str, number: int, text: str, strict: bool = False) -> None:
    """Writes a text as the folder's next state: under a temporary name that is then renamed to the number. If another session was first, its
    state stays, and this is an error, except for number 0, whose states are equal (unless strict)."""
    fs, at = file_system(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(at)
    draft, final = path(f"{folder}/.draft-{uuid.uuid4().hex}"), path(f"{folder}/{number:09d}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        if number or strict:
            raise RuntimeError(f"another session has written state {number} of {folder}")


def latest(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """(number, text) of a folder's latest state, if it has any."""
    fs, at = file_system(spark, folder)
    if not fs.exists(at):
        return None
    names = sorted(n for f in fs.listStatus(at) if (n := f.getPath().getName()).isdigit())
    if not names:
        return None
    source = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{names[-1]}"))
    try:
        return int(names[-1]), spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a column of numbers from 1 on, by an order. Rows are sorted over all tasks and written; a number is a row's place in its partition
    and the rows of those before, so no task gets all rows."""
    spark = df.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = written(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": place}))
    starts, before = [], 1
    for r in sorted(held.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a row a partition
        starts.append((r["_part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    return held.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
