"""Reading addresses, as a Spark data source: a partition for hosts, with limits of time and rate and with retries.

`spark.read.format("siltflow_fetch")` reads the addresses of a folder of Parquet files, one task a file; `fetch_all` writes such a folder, with all
addresses of a host in one file, or in as many as it may have lanes. What opens an address is named by an option, so that tests and offline runs
need no network.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import place as _place
from ..storage import work_dir

#: Statuses worth another attempt, and the first pause in seconds; pauses double. Statuses of pages that are gone for good.
RETRIED, PAUSE, ATTEMPTS, GONE = frozenset({408, 425, 429}), 0.5, 3, (404, 410)
#: Seconds that an address may take; who asks; what it takes; requests a second of one host (0: no limit); files of addresses.
TIMEOUT, AGENT, ACCEPT, RATE, FILES = 20.0, "siltflow/1.0", "*/*", 0.0, 64
#: Answers of a batch.
BATCH = 64

#: Opens an address by a method (GET, HEAD): (status, content type, body). It raises OSError where there is no answer.
Opener = Callable[[str, str], tuple[int, str, str]]


def fetch(url: str, opener: Opener, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, method: str = "GET") -> tuple[int, str | None, str | None, int]:
    """(status, content type, body, attempts made): retried on 408, 425, 429, 5xx and network errors; other failures at once. Status 0: no
    answer. Type and body are None unless the status tells success."""
    status, n = 0, 0
    for n in range(1, attempts + 1):
        if n > 1:
            sleep(PAUSE * 2 ** (n - 2))
        try:
            status, kind, body = opener(url, method)
        except OSError:
            status = 0
            continue
        if status < 400:
            return status, kind, body, n
        if status not in RETRIED and status < 500:
            break
    return status, None, None, n


def http_opener(options: dict[str, str]) -> Opener:
    """Opens addresses over the network: within a time limit, naming who asks and what is taken, with further headers (JSON)."""
    headers = {"User-Agent": options.get("agent", AGENT), "Accept": options.get("accept", ACCEPT), **json.loads(options.get("headers", "{}"))}
    limit = float(options.get("timeout", TIMEOUT))

    def ask(url: str, method: str) -> tuple[int, str, str]:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, method=method, headers=headers), timeout=limit) as answer:
                body = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
                return answer.status, answer.headers.get("Content-Type", ""), body
        except urllib.error.HTTPError as e:
            return e.code, "", ""
        except ValueError as e:  # no address at all
            raise OSError(str(e)) from e

    return ask


def saved_name(url: str) -> str:
    """The file of an address below a folder of saved answers."""
    name = hashlib.sha1(url.encode()).hexdigest()
    return f"{name[:2]}/{name}"


def save(pages: DataFrame, folder: str) -> int:
    """Saves answers (url, body) for `saved_opener`, a file each, and returns how many. fails, if pages have it: the statuses (array<int>, 0: no
    answer) that an address has at its first attempts, before its body is given."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(folder)
        for batch in batches:
            for url, body, fails in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = f"{root}/{saved_name(url)}"
                system.create_dir(at.rpartition("/")[0], recursive=True)
                draft = f"{at}.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(f"{' '.join(map(str, fails or []))}\n{body or ''}".encode())
                system.move(draft, at)  # a second try of the task leaves the same file
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    fails = F.col("fails") if "fails" in pages.columns else F.lit(None)
    return pages.select("url", "body", fails.cast("array<int>").alias("fails")).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def saved_opener(options: dict[str, str]) -> Opener:
    """Answers from the folder that the option `folder` names; addresses without a file are not found. The type is told by how the body begins.
    Attempts at an address follow one another, so only the last one's are counted."""
    system, root = _place(options["folder"])
    last: list = [None, 0]

    def ask(url: str, method: str) -> tuple[int, str, str]:
        try:
            with system.open_input_file(f"{root}/{saved_name(url)}") as f:
                head, _, body = f.read().decode("utf-8", "replace").partition("\n")
        except FileNotFoundError:
            return 404, "", ""
        fails = head.split()
        last[:] = [(url, method), last[1] + 1 if last[0] == (url, method) else 1]
        if last[1] <= len(fails):
            if fails[last[1] - 1] == "0":
                raise OSError("no answer")
            return int(fails[last[1] - 1]), "", ""
        start = body.lstrip()[:1]
        return 200, "application/json" if start in ("{", "[") else "text/html" if start == "<" else "text/plain", "" if method == "HEAD" else body

    return ask


class Pace:
    """At most so many requests a second of each host."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.free = 1 / rate if rate else 0.0, clock, sleep, {}

    def wait(self, host: str | None) -> None:
        if self.gap:
            now = self.clock()
            at = max(now, self.free.get(host, now))
            self.free[host] = at + self.gap
            if at > now:
                self.sleep(at - now)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FetchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """A file each: FILES at most, times the lanes."""
        system, root = _place(self.options["path"])
        found = system.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
        files = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet"))
        return [_File(p) for p in files] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        o = self.options
        module, _, name = o.get("opener", f"{__name__}:http_opener").partition(":")
        opener = getattr(importlib.import_module(module), name)(dict(o))
        pace, method, attempts = Pace(float(o.get("rate", RATE))), o.get("method", "GET"), int(o.get("attempts", ATTEMPTS))
        sleep = (lambda s: None) if o.get("pause") == "none" else time.sleep
        system, _ = _place(o["path"])
        with system.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=BATCH, columns=["url", "host"]):
                urls, got = batch.column("url").to_pylist(), []
                for url, host in zip(urls, batch.column("host").to_pylist(), strict=True):

                    def paced(u: str, m: str, host=host) -> tuple[int, str, str]:
                        pace.wait(host)
                        return opener(u, m)

                    got.append(fetch(url, paced, attempts, sleep, method) if url else (0, None, None, 0))
                yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), *[pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int32()))]], ["url", "status", "content_type", "body", "attempts"])


class FetchSource(DataSource):
    """Options: path (a folder of Parquet files with url and host), opener (module:function from options to an opener), method, attempts, timeout,
    rate (requests a second of a host), agent, accept, headers (JSON), pause (none: retries don't wait)."""

    @classmethod
    def name(cls) -> str:
        return "siltflow_fetch"

    def schema(self) -> str:
        return "url string, status int, content_type string, body string, attempts int"

    def reader(self, schema) -> FetchReader:
        return FetchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FetchSource)


def fetch_all(rows: DataFrame, url: str = "url", files: int = FILES, lanes: int = 1, **options) -> DataFrame:
    """(url, status, content_type, body, attempts) of each row; a page that can't be read costs its own row only, a null address has status 0
    and no attempt. All addresses of a host are in one file, so in one task, which keeps to the host's rate; with lanes in as many, each with
    its part of the rate. Options are the data source's."""
    spark = rows.sparkSession
    register(spark)
    path = f"{work_dir(spark)}/addresses-{uuid.uuid4().hex}"
    at = rows.select(F.col(url).cast("string").alias("url")).withColumn("host", F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)))
    at = at.withColumn("lane", F.pmod(F.xxhash64("url"), F.lit(lanes)))
    at.repartition(files, "host", "lane").sortWithinPartitions("host", "url").write.parquet(path)
    if lanes > 1 and float(options.get("rate", 0)):
        options["rate"] = float(options["rate"]) / lanes
    reader = spark.read.format("siltflow_fetch").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def is_gone(status: Column) -> Column:
    """Whether a page no longer exists, which retires it at once; no other failure does."""
    return status.isin(*GONE)


def content_type(rows: DataFrame, url: str = "url", **options) -> DataFrame:
    """(url, content_type): what a page says it is, by a HEAD request, in one attempt; null where it fails."""
    return fetch_all(rows, url, method="HEAD", attempts=1, **options).select("url", "content_type")


def fetch_json(rows: DataFrame, schema: str, url: str = "url", **options) -> DataFrame:
    """(url, status, value): the bodies read as JSON of a schema; null where there is none or it isn't valid."""
    options = {"accept": "application/json", **options}
    return fetch_all(rows, url, **options).select("url", "status", F.when(F.try_parse_json("body").isNotNull(), F.from_json("body", schema)).alias("value"))
