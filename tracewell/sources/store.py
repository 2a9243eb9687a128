"""A store of recorded chunks as a Spark data source, ``chunk_store``: its listing in batch, its objects in streams; and fetching by key.

Keys are ``{site}/{day}/{visitor}/{slice}/{counter}.json.gz``. The driver lists sites and days alone, and only those that prefix, dates and filters leave; tasks list what lies
within them, so a listing of any length passes through no single place. What is to be read is decided by joins on the listing before any object is opened; ``fetched``
then opens just these, a bounded number at a time in each task, since a round trip takes long whatever an object's size.

A stream's offset is a time: a batch holds what was stored after the last one's and up to its own, so an object that is sent again is read again.
"""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

#: Objects that a task has in flight, and how often one is asked for.
IN_FLIGHT, TRIES = 64, 4
#: Bytes of objects for a task, and objects; days whose listing is a task's at most.
BYTES, OBJECTS, DAYS = 64 << 20, 10_000, 64
#: Rows and bytes of content handed on at once.
ROWS, HELD = 10_000, 16 << 20
LISTED = "key string, bytes long, uploaded_ms long, site string, day string"
STREAMED = f"{LISTED}, content binary"
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


class Files:
    """Objects under a root, by key."""

    def __init__(self, url: str):
        self.fs, self.root = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", url))

    def folders(self, under: str) -> list[str]:
        """Names of the folders right under one."""
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{under}".rstrip("/"), allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)

    def objects(self, under: str) -> Iterator[tuple[str, int, int]]:
        """(key, bytes, time stored) of all objects below a folder."""
        for f in self.fs.get_file_info(fs.FileSelector(f"{self.root}/{under}".rstrip("/"), recursive=True, allow_not_found=True)):
            if f.type == fs.FileType.File:
                yield f.path[len(self.root) :].lstrip("/"), f.size, f.mtime_ns // 1_000_000

    def read(self, key: str) -> bytes:
        for left in range(TRIES - 1, -1, -1):
            try:
                with self.fs.open_input_stream(f"{self.root}/{key}", compression=None) as stream:
                    return stream.read()
            except FileNotFoundError:
                raise
            except OSError:
                if not left:
                    raise
                time.sleep(0.2 * 2 ** (TRIES - 1 - left))
        raise AssertionError


def files_of(url: str) -> Files:
    return Files(url)


@dataclass
class Folders(InputPartition):
    """Site and day folders, or the objects beside them, that a task lists."""

    below: list[tuple[str, str]]
    after_ms: int = -1
    until_ms: int = 1 << 62


@dataclass
class Wanted:
    """What of a store is asked for."""

    prefix: str = ""
    since: str = ""
    until: str = "~"
    sites: frozenset[str] | None = None
    days: frozenset[str] | None = None

    def site(self, name: str) -> bool:
        head = self.prefix.partition("/")[0]
        return (name == head if "/" in self.prefix else name.startswith(head)) and (self.sites is None or name in self.sites)

    def day(self, site: str, name: str) -> bool:
        parts = self.prefix.split("/")
        if len(parts) > 2 and name != parts[1] or len(parts) == 2 and not name.startswith(parts[1]):
            return False
        return self.since <= name <= self.until and (self.days is None or name in self.days)

    def narrowed(self, f: Filter) -> Wanted | None:
        """What is left under one more filter, or None if it is none that folders tell."""
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        both = lambda held, new: frozenset(new) if held is None else held & frozenset(new)
        values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
        if values is not None and name == "site":
            return Wanted(self.prefix, self.since, self.until, both(self.sites, values), self.days)
        if values is not None and name == "day":
            return Wanted(self.prefix, self.since, self.until, self.sites, both(self.days, values))
        if name == "day" and isinstance(f, (GreaterThanOrEqual, GreaterThan)):
            return Wanted(self.prefix, max(self.since, f.value), self.until, self.sites, self.days)
        if name == "day" and isinstance(f, (LessThanOrEqual, LessThan)):
            return Wanted(self.prefix, self.since, min(self.until, f.value), self.sites, self.days)
        if name == "key" and isinstance(f, StringStartsWith) and (f.value.startswith(self.prefix) or self.prefix.startswith(f.value)):
            return Wanted(max(self.prefix, f.value, key=len), self.since, self.until, self.sites, self.days)
        return None


def planned(files: Files, wanted: Wanted) -> list[list[tuple[str, str]]]:
    """Groups of (site, day) folders to list, a task each."""
    found = [(site, day) for site in files.folders("") if wanted.site(site) for day in files.folders(site) if wanted.day(site, day)]
    n = max(1, -(-len(found) // DAYS))
    return [found[k::n] for k in range(n)] if found else []


def _listed(files: Files, below: list[tuple[str, str]], wanted: Wanted) -> Iterator[tuple]:
    rest = wanted.prefix.split("/")
    for site, day in below:
        # a prefix that goes on into a visitor and a slice leads to their folders
        under = "/".join([site, day, *rest[2:-1]]) if len(rest) > 3 else f"{site}/{day}"
        for key, size, stored in files.objects(under):
            if key.startswith(wanted.prefix):
                yield key, size, stored, site, day


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"key": pa.string(), "bytes": pa.int64(), "uploaded_ms": pa.int64(), "site": pa.string(), "day": pa.string()}
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


class Listing(DataSourceReader):
    def __init__(self, url: str, wanted: Wanted):
        self.url, self.wanted = url, wanted

    def partitions(self):
        return [Folders(below) for below in planned(files_of(self.url), self.wanted)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in _listed(files_of(self.url), partition.below, self.wanted):
            rows.append(row)
            if len(rows) == ROWS:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


class Narrowed(Listing):
    """A listing that takes filters; Spark refuses one where ``spark.sql.python.filterPushdown.enabled`` isn't set."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            less = self.wanted.narrowed(f)
            if less is not None:
                self.wanted = less
            yield f  # Spark asks each row again: a day's bounds may be strict


class Arrivals(DataSourceStreamReader):
    """Objects as they are stored. horizon: days back from the last offset whose folders may still get some; lag_ms: how old the newest of a batch is, so that none is still to come."""

    def __init__(self, url: str, wanted: Wanted, horizon: int, lag_ms: int, from_ms: int):
        self.url, self.wanted, self.horizon, self.lag_ms, self.from_ms = url, wanted, horizon, lag_ms, from_ms

    def initialOffset(self) -> dict:
        return {"until_ms": self.from_ms}

    def latestOffset(self) -> dict:
        return {"until_ms": time.time_ns() // 1_000_000 - self.lag_ms}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        wanted = self.wanted
        if start["until_ms"] > 0:
            since = (datetime.fromtimestamp(start["until_ms"] / 1000, UTC) - timedelta(days=self.horizon)).strftime("%Y-%m-%d")
            wanted = Wanted(wanted.prefix, max(wanted.since, since), wanted.until, wanted.sites, wanted.days)
        return [Folders(below, start["until_ms"], end["until_ms"]) for below in planned(files_of(self.url), wanted)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        files = files_of(self.url)
        rows = (r for r in _listed(files, partition.below, self.wanted) if partition.after_ms < r[2] <= partition.until_ms)
        for some, content in in_flight(files, rows):
            yield _batch(some).append_column("content", pa.array(content, pa.binary()))

    def commit(self, end: dict) -> None:
        pass


class ChunkStore(DataSource):
    """Options: path; prefix, a literal one; since, the first day; pushdown, whether the session lets it take filters; in streams also horizon, lag_ms and from_ms."""

    @classmethod
    def name(cls) -> str:
        return "chunk_store"

    def schema(self) -> str:
        return STREAMED if self.options.get("content") == "true" else LISTED

    def _wanted(self) -> Wanted:
        return Wanted(self.options.get("prefix", ""), self.options.get("since", ""))

    def reader(self, schema) -> Listing:
        return (Narrowed if self.options.get("pushdown") == "true" else Listing)(self.options["path"], self._wanted())

    def streamReader(self, schema) -> Arrivals:
        o = self.options
        return Arrivals(o["path"], self._wanted(), int(o.get("horizon", 30)), int(o.get("lag_ms", 2000)), int(o.get("from_ms", 0)))


def in_flight(files: Files, rows: Iterator[tuple]) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Rows, whose first column is a key, with what lies there; IN_FLIGHT objects are under way at once, and no more content is held than HELD bytes and these."""
    done: list[tuple] = []
    content: list[bytes] = []
    with ThreadPoolExecutor(IN_FLIGHT) as pool:
        waiting: deque = deque()

        def take() -> None:
            row, future = waiting.popleft()
            done.append(row)
            content.append(future.result())

        size = 0
        for row in rows:
            waiting.append((row, pool.submit(files.read, row[0])))
            if len(waiting) >= IN_FLIGHT:
                take()
                size += len(content[-1])
                if size > HELD:
                    yield done, content
                    done, content, size = [], [], 0
        while waiting:
            take()
    if done:
        yield done, content


def listed(spark: SparkSession, url: str, prefix: str = "", since: str = "") -> DataFrame:
    """(key, bytes, uploaded_ms, site, day) of a store's objects under a literal prefix, of days from ``since`` on."""
    spark.dataSource.register(ChunkStore)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("chunk_store").option("prefix", prefix).option("since", since).option("pushdown", pushdown).load(url)


def arriving(spark: SparkSession, url: str, **options) -> DataFrame:
    """A store's objects with their content, as they are stored: a stream."""
    spark.dataSource.register(ChunkStore)
    return spark.readStream.format("chunk_store").options(content="true", **{k: str(v) for k, v in options.items()}).load(url)


def fetched(objects: DataFrame, url: str) -> DataFrame:
    """objects(key, bytes, …) with ``content``: tasks of about BYTES each open just these."""
    total = objects.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
    tasks = max(1, -(-(total["bytes"] or 0) // BYTES), -(-total["n"] // OBJECTS))
    source = objects.drop("content")
    at = source.columns.index("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = files_of(url)
        for batch in batches:
            keys = batch.column(at).to_pylist()
            start = 0
            for some, content in in_flight(files, ((k,) for k in keys)):
                yield batch.slice(start, len(some)).append_column("content", pa.array(content, pa.binary()))
                start += len(some)

    return source.repartition(tasks).mapInArrow(run, source.schema.add("content", "binary"))
