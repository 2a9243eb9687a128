"""Intervals and moments: spans, labels, page pieces, screenshot marks, lanes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAD_MS, REACH_MS = 2000, 2000


def labelled(slices: DataFrame, keys: tuple[str, ...] = ("visitor_id",)) -> DataFrame:
    """S1 .. Sn in order of start, end and id."""
    w = Window.partitionBy(*keys).orderBy("start_ts", "end_ts", "recorder_slice")
    return slices.withColumn("label", F.concat(F.lit("S"), F.row_number().over(w).cast("string")))


def merged(spans: DataFrame, keys: tuple[str, ...], pad_ms: int = PAD_MS) -> DataFrame:
    """Spans widened by the pad, those that touch made one."""
    wide = spans.select(*keys, F.greatest(F.col("start_ts") - pad_ms, F.lit(0)).alias("start_ts"), (F.col("end_ts") + pad_ms).alias("end_ts"))
    w = Window.partitionBy(*keys).orderBy("start_ts", "end_ts")
    new = F.col("start_ts") > F.max("end_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = wide.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "island").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("spans")).drop("island")


def inside(events: DataFrame, spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Events within a span of their keys, closed at both ends. spans: merged, so that one covers each event at most."""
    bounds = spans.select(*keys, F.col("start_ts").alias("timestamp"), F.lit(0).alias("side"), F.struct("start_ts", "end_ts").alias("span"))
    both = bounds.unionByName(events.withColumn("side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("timestamp", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("span", F.last("span", ignorenulls=True).over(w)).where("side = 1 and timestamp <= span.end_ts")
    return last.withColumn("span_start", F.col("span.start_ts")).drop("span", "side")


def nearest_marks(claims: DataFrame, marks: DataFrame, keys: tuple[str, ...], reach_ms: int = REACH_MS) -> DataFrame:
    """claims(keys, timestamp, claim_id) with the distance to the nearest mark, null beyond the reach."""
    rows = claims.withColumn("mark", F.lit(None).cast("long")).unionByName(marks.select(*keys, "timestamp", F.col("timestamp").alias("mark")), allowMissingColumns=True)
    upto = lambda order: Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    # both frames only grow, so each row is added to them once
    before, after = (F.last("mark", ignorenulls=True).over(upto(order)) for order in (F.asc("timestamp"), F.desc("timestamp")))
    near = F.least(F.col("timestamp") - before, after - F.col("timestamp"))
    return rows.withColumn("distance_ms", F.when(near <= reach_ms, near)).where("mark is null").drop("mark")


def screenshot_marks(acts: DataFrame, bounds: DataFrame, keys: tuple[str, ...], interval_ms: int, radius_ms: int = 1000, load_radius_ms: int = 2000) -> DataFrame:
    """Moments on the grid start + k * interval near an act, and both ends of each slice. bounds: (keys, start_ts, end_ts)."""
    if radius_ms < interval_ms:
        raise ValueError("a radius below the interval can miss an act")
    near = acts.join(bounds, list(keys)).withColumn("radius", F.when(F.col("type_str") == "PageLoad", load_radius_ms).otherwise(radius_ms))
    lo = F.ceil((F.greatest(F.col("timestamp") - F.col("radius"), F.col("start_ts")) - F.col("start_ts")) / interval_ms)
    hi = F.floor((F.least(F.col("timestamp") + F.col("radius"), F.col("end_ts")) - F.col("start_ts")) / interval_ms)
    steps = near.where(lo <= hi).select(*keys, "start_ts", F.explode(F.sequence(lo, hi)).alias("k"))
    grid = steps.select(*keys, (F.col("start_ts") + F.col("k") * interval_ms).alias("mark_ts"))
    ends = bounds.select(*keys, F.explode(F.array("start_ts", "end_ts")).alias("mark_ts"))
    return grid.union(ends).distinct()


def page_pieces(events: DataFrame, bounds: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Slices cut at the page loads after their start: (keys, piece, start_ts, end_ts), half-open but for the last."""
    cuts = events.where(F.col("type_str") == "PageLoad").join(bounds, list(keys)).where("timestamp > start_ts and timestamp <= end_ts").select(*keys, "timestamp", "end_ts")
    cuts = cuts.union(bounds.select(*keys, "start_ts", "end_ts")).distinct()
    w = Window.partitionBy(*keys).orderBy("timestamp")
    return cuts.select(*keys, F.row_number().over(w).alias("piece"), F.col("timestamp").alias("start_ts"), F.coalesce(F.lead("timestamp").over(w), F.col("end_ts")).alias("end_ts"))


def disjoint_runs(slices: DataFrame) -> DataFrame:
    """Consecutive slices of one visitor that don't overlap share a run."""
    w = Window.partitionBy("visitor_id").orderBy("start_ts", "end_ts", "recorder_slice")
    over = F.max("end_ts").over(w.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start_ts")
    return slices.withColumn("over", F.coalesce(over, F.lit(False)).cast("int")).withColumn("run", F.sum("over").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("over")


def lanes(slices: DataFrame) -> DataFrame:
    """Each visitor's slices on parallel lanes: the lowest lane that is free. Greedy in order of start, so one visitor is one group."""

    def assign(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["start_ts", "end_ts", "recorder_slice"])
        busy: list[tuple[int, int]] = []
        free: list[int] = []
        out, used = [], 0
        for start, end in zip(own["start_ts"], own["end_ts"], strict=True):
            while busy and busy[0][0] <= start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                lane = heapq.heappop(free)
            else:
                lane, used = used, used + 1
            heapq.heappush(busy, (end, lane))
            out.append(lane)
        return own.assign(lane=out)

    rows = slices.select("visitor_id", "recorder_slice", "start_ts", "end_ts")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", lane int"
    return rows.groupBy("visitor_id").applyInPandas(assign, schema)


def showable(moments: DataFrame, slices: DataFrame, keys: tuple[str, ...] = ("visitor_id",)) -> DataFrame:
    """Whether each moment can be shown: in a slice and not before its snapshot; else why not."""
    starts = slices.select(*keys, F.col("start_ts").alias("timestamp"), F.struct("start_ts", "end_ts", "snapshot_ts").alias("s"), F.lit(0).alias("side"))
    both = starts.unionByName(moments.withColumn("side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("timestamp", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("s", F.last("s", ignorenulls=True).over(w)).where("side = 1")
    why = F.when(F.col("s").isNull(), "outside").when(F.col("timestamp") > F.col("s.end_ts"), "gap").when(F.col("timestamp") < F.col("s.snapshot_ts"), "lead")
    return last.withColumn("why", why).drop("s", "side")


def greedy_groups(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], size: str, budget: int) -> DataFrame:
    """Consecutive rows in groups of the budget at most; a row above it is a group of its own.

    The fold runs over each key's rows in order, a batch at a time, so no key is held whole.
    """
    columns = [f.name for f in rows.select(*keys, *order, size).schema.fields]
    rows = rows.select(*columns)
    schema = T.StructType([*rows.schema.fields, T.StructField("group", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, group = None, 0, 0
        for batch in batches:
            out = []
            for *own, n in zip(*(batch.column(c).to_pylist() for c in (*keys, size)), strict=True):
                if own != key:
                    key, used, group = own, 0, 0
                elif used and used + n > budget:
                    used, group = 0, group + 1
                used += n
                out.append(group)
            yield batch.append_column("group", pa.array(out, pa.int64()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
