"""Recorded chunks: gzipped JSON objects under ``{snippet}/{date}/{visitor}/{slice}/{counter}.json.gz``.

Listing and manifest come first and read no content; what is left is decoded in Arrow batches, and every event or chunk that can't
be used becomes a row of a reject table with its reason.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.books import parsed_keys, under_prefix, unloaded
from tracewell.sources import store

DECODED = (
    "key string, snippet string, visitor_id string, recorder_slice string, timestamp long, type int, counter string, content_hash string, raw_json binary, event string, "
    "user_agent string, language string, time_zone string, screen_width long, screen_height long, internal int, script_version string, reason string, n long, opens int, spoils int"
)


def store_root(url: str) -> str:
    """A bucket alone, or a local folder; keys are addressed by prefixes, not by paths in the address."""
    if re.fullmatch(r"s3://[a-z0-9.-]+/?", url):
        return "s3a" + url[2:].rstrip("/")
    if url.startswith("file:") or url.startswith("/"):
        return url.rstrip("/")
    raise ValueError(f"not a store: {url}")


def listing(spark: SparkSession, url: str, prefix: str = "", since: str = "") -> DataFrame:
    """Objects of a store: key, bytes, uploaded_ms, etag. No content is read, and only the folders that a prefix leads to, of days from ``since`` on, are listed."""
    rows = under_prefix(store.listed(spark, store_root(url), prefix, since).where(F.col("key").endswith(".json.gz")), prefix)
    return rows.select("key", "bytes", "uploaded_ms", F.md5(F.concat_ws("|", "key", F.col("bytes").cast("string"), F.col("uploaded_ms").cast("string"))).alias("etag"))


def canonical_json(event: dict) -> str:
    """The text whose hash is an event's identity: sorted keys, no spaces, ASCII only."""
    return json.dumps(event, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def unwrapped(wire: bytes) -> dict:
    """A chunk's body: gzip, else zlib, else raw deflate."""
    for attempt in (gzip.decompress, zlib.decompress, lambda b: zlib.decompress(b, -15)):
        try:
            return json.loads(attempt(wire))
        except (OSError, zlib.error, EOFError):
            continue
    raise ValueError("neither gzip nor deflate")


def chunk_reason(body: object) -> str | None:
    if not isinstance(body, dict):
        return "not an object"
    for name in ("visitorId", "sliceId"):
        if not isinstance(body.get(name), str) or not body[name]:
            return f"no {name}"
    return None if isinstance(body.get("events"), list) else "no events"


def event_reason(event: object) -> str | None:
    if not isinstance(event, dict):
        return "event is no object"
    if isinstance(event.get("type"), bool) or not isinstance(event.get("type"), int):
        return "event type is no whole number"
    if isinstance(event.get("timestamp"), bool) or not isinstance(event.get("timestamp"), (int, float)):
        return "event timestamp is no number"
    return None if isinstance(event.get("counter"), str) else "event counter is no text"


def clock(event: dict) -> int:
    """Where the event stands: a batch of moves at its last position."""
    data = event.get("data") if isinstance(event.get("data"), dict) else {}
    moves = data.get("positions") if event["type"] == 3 and data.get("source") in (1, 6, 12) else None
    shift = moves[-1].get("timeOffset", 0) if isinstance(moves, list) and moves and isinstance(moves[-1], dict) else 0
    return int(event["timestamp"] + (shift if isinstance(shift, (int, float)) else 0))


def _rows(key: str, snippet: str | None, wire: bytes) -> Iterator[dict]:
    try:
        body = unwrapped(wire)
        reason = chunk_reason(body)
    except ValueError:
        body, reason = None, "corrupt"
    if reason:
        yield {"key": key, "snippet": snippet, "reason": reason, "n": 1}
        return
    told = body.get("envelope") if isinstance(body.get("envelope"), dict) else {}
    screen = told.get("screen") if isinstance(told.get("screen"), dict) else {}
    common = {
        "key": key, "snippet": snippet, "visitor_id": body["visitorId"], "recorder_slice": body["sliceId"], "script_version": body.get("recorderVersion"), "user_agent": told.get("userAgent"),
        "language": told.get("language"), "time_zone": told.get("timeZone"), "screen_width": screen.get("width"), "screen_height": screen.get("height"), "internal": int(bool(told.get("internal"))),
    }
    for event in body["events"]:
        reason = event_reason(event)
        if reason:
            yield common | {"reason": reason, "n": 1}
            continue
        text = canonical_json(event)
        yield common | {"timestamp": clock(event), "type": event["type"], "counter": event["counter"], "event": text, "content_hash": hashlib.sha256(text.encode()).hexdigest(), "raw_json": zlib.compress(text.encode(), 6), "n": 1}
    for error in body.get("errors") or []:
        yield common | {"reason": f"recorder: {error}", "n": 1}


def decoded(objects: DataFrame) -> DataFrame:
    """Events and rejects of ``objects(key, snippet, content)``; rejects have a reason."""
    schema = objects.sparkSession.createDataFrame([], DECODED).schema
    kinds = {f.name: {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.dataType.simpleString()] for f in schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(_rows(row["key"], row["snippet"], row["content"]))
                spoilt = [k for k, r in enumerate(rows) if r.get("visitor_id") is not None and (r.get("reason") or "recorder: ").startswith("recorder: ") is False]
                for k, r in enumerate(rows):
                    r |= {"opens": int(k == 0), "spoils": int(k in spoilt[:1])}
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in kinds.items()], list(kinds))

    return objects.select("key", "snippet", "content").mapInArrow(run, schema)


def decode_stats() -> list[Column]:
    """Aggregates over decoded rows that tell what ``books.load_stats`` tells, for an Observation while they are made: the first row of each chunk, and its first reject, are marked."""
    reject = F.expr("reason is not null and reason not like 'recorder: %' and visitor_id is not null")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    corrupt = F.count_if(F.expr("reason is not null and visitor_id is null"))
    return [total("opens").alias("chunks"), corrupt.alias("corrupt"), total("spoils").alias("lossy"), F.count_if(F.col("reason").isNull()).alias("events"), F.count_if(reject).alias("rejected")]


def rejects(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").groupBy("key", "reason").agg(F.sum("n").alias("events"))


def fresh_objects(spark: SparkSession, url: str, manifest: DataFrame, prefix: str = "", cutoff: str = "") -> DataFrame:
    """What a load has to read: under the prefix, not expired, not held in this version. No content is read."""
    return unloaded(parsed_keys(listing(spark, url, prefix, cutoff)).where("not foreign"), manifest).where(F.col("date") >= cutoff)


def content_of(spark: SparkSession, url: str, fresh: DataFrame) -> DataFrame:
    """Fresh objects with their content; nothing else is opened."""
    return store.fetched(fresh, store_root(url))


def new_objects(spark: SparkSession, url: str, manifest: DataFrame, prefix: str = "", cutoff: str = "") -> DataFrame:
    """Fresh objects with their content."""
    return content_of(spark, url, fresh_objects(spark, url, manifest, prefix, cutoff))


def first_of_each(events: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Of equal events of one visitor the one whose key comes first, unless held; the envelope of that delivery stays."""
    w = Window.partitionBy("visitor_id", "content_hash").orderBy("key")
    one = events.where("reason is null").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return one if held is None else one.join(held.select("visitor_id", "content_hash"), ["visitor_id", "content_hash"], "left_anti")


def as_chunks(events: DataFrame) -> DataFrame:
    """The way back, for fixtures and export: a row a slice, its events in order of their counters."""
    return events.groupBy("snippet", "visitor_id", "recorder_slice").agg(F.sort_array(F.collect_list(F.struct("counter", "event"))).alias("events"), F.count("*").alias("n"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines ledger; a torn line is an error, not a gap."""
    from tracewell.schema import SPEND

    return spark.read.schema(SPEND).option("mode", "FAILFAST").json(path)
