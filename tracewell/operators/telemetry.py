"""Telemetry: pings checked by their metric's shape, laid out as positional rows, and SQL over them.

A ping is JSON. Its metric names which fields it must have and of what type; one that doesn't fit is rejected with a reason, never padded.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import exprs as X
from tracewell.operators import books
from tracewell.operators.flat import _kind

# Metrics with their fields in the order of their columns, and the bounds of a row.
#: s: text, b: yes or no, n: number; ?: may be absent. The slice: must be there, may be null (a context before its first), or has none.
METRICS: dict[str, tuple[str, dict[str, str], dict[str, str]]] = {
    "transport_probe": ("must", {}, {"ts": "n?"}),
    "slice_started": ("must", {"url": "s", "first_slice": "b", "visitor_source": "s?", "gate_exempt": "s?", "internal": "b?"}, {}),
    "page_load": ("must", {"url": "s", "referrer": "s", "spaRoute": "b"}, {"ts": "n?"}),
    "cost_sample": ("may", {}, {"mainThreadMs": "n", "uploadBytes": "n", "heapBytesMax": "n?", "heapBytesLimit": "n?", "backlogBytesMax": "n?", "deliveredBytes": "n?", "ts": "n?", "visibleMs": "n?"}),
    "chunk_oversize": ("must", {}, {"gzippedBytes": "n", "count": "n", "ts": "n?"}),
    "snapshot_fatal": ("must", {}, {"gzippedBytes": "n", "count": "n", "ts": "n?"}),
    "recorder_fault": ("may", {"reason": "s", "error": "s", "url": "s?"}, {"ts": "n?"}),
    "capture_gated": ("none", {"reason": "s", "url": "s", "detail": "s?"}, {"ts": "n?"}),
}
UNIFORM = ("metric", "visitor", "slice", "version", "origin", "user_agent", "as_organization")
BLOB_BYTES, UNMEASURED = 5120, -1.0


def _fits(value: Column, kind: str) -> Column:
    is_ = _kind(value)
    right = {"s": is_ == "STRING", "b": is_ == "BOOLEAN", "n": is_.isin("BIGINT", "DOUBLE", "DECIMAL")}[kind[0]]
    return F.coalesce(right, F.lit(False)) | (is_.isNull() if kind.endswith("?") else F.lit(False))


def _written(value: Column, kind: str) -> Column:
    if kind[0] == "n":
        return F.coalesce(F.try_variant_get(value, "$", "double"), F.lit(UNMEASURED))
    if kind[0] == "b":
        return F.when(F.coalesce(F.try_variant_get(value, "$", "boolean"), F.lit(False)), "1").otherwise("0")
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))


def fitted(blobs: Column, budget: int = BLOB_BYTES) -> Column:
    """Texts cut to a budget of bytes in all, the first served first; a cut falls between characters."""

    def step(state: Column, text: Column) -> Column:
        raw, left = F.encode(text, "UTF-8"), state["left"]

        def inside(k: int) -> Column:  # the byte at the cut moved back by k goes on a character
            return F.hex(F.substring(raw, left + 1 - k, F.lit(1))).between("80", "BF")

        end = F.when(~inside(0), left).when(~inside(1), left - 1).when(~inside(2), left - 2).otherwise(left - 3)
        kept = F.when(F.octet_length(raw) <= left, text).when(left <= 0, "").otherwise(F.decode(F.substring(raw, F.lit(1), F.greatest(end, F.lit(0))), "UTF-8"))
        return F.struct((left - F.octet_length(kept)).alias("left"), F.array_append(state["out"], kept).alias("out"))

    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(blobs, start, step)["out"]


def points(pings: DataFrame) -> DataFrame:
    """``pings(ping, visitor_id, snippet, origin, user_agent, as_organization)`` with metric, blobs and doubles, or a reason.

    ping: JSON text. A point's blobs begin with UNIFORM; -1 stands for a figure that wasn't taken.
    """
    p = pings.withColumn("_p", F.from_json("ping", "map<string,variant>"))
    get = lambda name: F.try_element_at("_p", F.lit(name))
    p = p.withColumn("metric", F.try_variant_get(get("metric"), "$", "string")).withColumn("_slice", F.try_variant_get(get("sliceId"), "$", "string"))
    good_slice = F.coalesce((_kind(get("sliceId")) == "STRING") & X.is_slice_id("_slice"), F.lit(False))
    present = F.array_contains(F.map_keys("_p"), "sliceId")
    blobs, doubles, reason = F.when(F.lit(False), F.array().cast("array<string>")), F.when(F.lit(False), F.array().cast("array<double>")), F.when(F.col("_p").isNull(), "no object").when(F.col("metric").isNull(), "no metric")
    reason = reason.when(~_fits(get("recorderVersion"), "s?"), "recorderVersion")
    for metric, (slice_, texts, figures) in METRICS.items():
        is_ = F.col("metric") == metric
        if slice_ == "must":
            reason = reason.when(is_ & ~good_slice, "sliceId")
        elif slice_ == "may":
            reason = reason.when(is_ & ~(good_slice | (present & _kind(get("sliceId")).isNull())), "sliceId")
        for name, kind in (*texts.items(), *figures.items()):
            reason = reason.when(is_ & ~_fits(get(name), kind), name)
        own = [_written(get(name), kind) for name, kind in texts.items()]
        sums = [_written(get(name), kind) for name, kind in figures.items()]
        if metric == "slice_started":
            sums = [X.slice_open_ms("_slice").cast("double")]
        where = F.lit("") if slice_ == "none" else F.coalesce("_slice", F.lit(""))
        head = [F.col("metric"), F.col("visitor_id"), where, F.coalesce(F.try_variant_get(get("recorderVersion"), "$", "string"), F.lit("")), *(F.coalesce(c, F.lit("")) for c in UNIFORM[4:])]
        blobs = blobs.when(is_, F.array(*head, *own))
        doubles = doubles.when(is_, F.array(*sums) if sums else F.array().cast("array<double>"))
    reason = reason.when(~F.col("metric").isin(*METRICS), "unknown metric")
    out = p.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return out.select(*(c for c in pings.columns if c not in ("metric", "blobs", "doubles", "reason")), "metric", F.when(ok, fitted(blobs)).alias("blobs"), F.when(ok, doubles).alias("doubles"), "reason")


def positional(rows: DataFrame, blobs: int = 12, doubles: int = 8) -> DataFrame:
    """Arrays as columns index1, blob1 .., double1 .., as the telemetry table has them."""
    cells = [F.get("blobs", F.lit(k)).alias(f"blob{k + 1}") for k in range(blobs)] + [F.get("doubles", F.lit(k)).alias(f"double{k + 1}") for k in range(doubles)]
    return rows.where("reason is null").select(F.col("snippet").alias("index1"), *cells)


_MS = re.compile(r"\bms\(\s*'([^']*)'\s*\)")


def utc_ms(value: str) -> int:
    """A moment as epoch milliseconds: 13 digits or more, or an ISO date or time, UTC unless it says otherwise."""
    if value.isdigit():
        if len(value) < 13:
            raise ValueError(f"{value} is too short for milliseconds")
        return int(value)
    at = datetime.fromisoformat(value)
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def expanded_ms(sql: str) -> str:
    """SQL with each ms('…') written out as a number."""
    return _MS.sub(lambda m: str(utc_ms(m.group(1))), sql)


def answer(spark: SparkSession, sql: str, table: DataFrame, name: str = "telemetry") -> dict:
    """The result of SQL over the telemetry table, and beside a result that means nothing how fresh the table is."""
    table.createOrReplaceTempView(name)
    rows = spark.sql(expanded_ms(sql))
    out = {"rows": rows, "nothing": books.means_nothing(rows).first()["nothing"]}
    if out["nothing"]:
        out["latest"] = table.agg(F.max("timestamp").alias("latest")).first()["latest"]
    return out
