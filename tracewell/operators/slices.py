"""Slices: all events that share one recorder stamp. Covering pairs, facts, status, rescue, forward fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.scans import Ordered

KEYS = ("visitor_id", "recorder_slice")
ORDER = ("timestamp", "counter", "id")
META, SNAPSHOT = 4, 2
RESCUE_MS = 10_000
REPLAYABLE, RESCUED, DISCARDED = "replayable", "rescued", "discarded"
ORPHAN, NO_SNAPSHOT, NO_VIEWPORT, DAMAGED = "orphan", "no snapshot", "zero viewport", "damaged"


def in_slice():
    return Window.partitionBy(*KEYS).orderBy(*ORDER)


def canonical(events: DataFrame) -> DataFrame:
    """Adds ``ord``, each event's place in its visitor's stream."""
    return Ordered.of(events, ("visitor_id",), ORDER).with_total("ord", F.lit(1)).rows().withColumn("ord", F.col("ord").cast("int"))


def filled_page_url(events: DataFrame) -> DataFrame:
    """page_url: the last address that isn't empty, up to the event, within its slice."""
    return last_known(events, F.nullif("url", F.lit("")), "page_url")


def covering_pairs(events: DataFrame) -> DataFrame:
    """First adjacent pair of Meta and FullSnapshot of each slice: (meta_ts, snapshot_ts)."""
    w = in_slice()
    pairs = events.withColumn("next_type", F.lead("type").over(w)).withColumn("snapshot_ts", F.lead("timestamp").over(w)).where((F.col("type") == META) & (F.col("next_type") == SNAPSHOT))
    first = F.min_by(F.struct(F.col("timestamp").alias("meta_ts"), "snapshot_ts"), F.struct(*ORDER)).alias("p")
    return pairs.groupBy(*KEYS).agg(first).select(*KEYS, "p.meta_ts", "p.snapshot_ts")


def summaries(events: DataFrame, facts: tuple[str, ...] = ()) -> DataFrame:
    """Span, number of events, and of each fact the first value that isn't null."""
    firsts = [F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(*ORDER))).alias(f) for f in facts]
    return events.groupBy(*KEYS).agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count("*").alias("n_events"), *firsts)


def materialised(events: DataFrame, facts: tuple[str, ...] = ("snippet",)) -> DataFrame:
    """Slices with status and reason.

    events: id, visitor_id, recorder_slice, timestamp, counter, type, href, width, height, root_id and the facts. A null stamp is an error.
    """
    sure = events.withColumn("recorder_slice", F.when(F.col("recorder_slice").isNull(), F.raise_error(F.lit("an event has no slice"))).otherwise(F.col("recorder_slice")))
    w = in_slice()
    pair = (F.col("type") == META) & (F.lead("type").over(w) == SNAPSHOT)
    marked = sure.withColumn("pair", pair).withColumn("root", F.when(pair, F.lead("root_id").over(w)))
    key = F.struct(*ORDER)
    of_pair = F.min_by(F.struct("timestamp", "href", "width", "height", "root"), F.when(F.col("pair"), key)).alias("cover")
    out = marked.groupBy(*KEYS).agg(
        F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("end_ts"),
        F.count("*").alias("n_events"),
        of_pair,
        F.bool_or(F.col("type") == META).alias("has_meta"),
        F.min_by("href", F.when((F.col("type") == META) & (F.col("href") != ""), key)).alias("url"),
        F.min_by("timestamp", F.when(F.col("type") == META, key)).alias("first_meta"),
        *(F.min_by(f, F.when(F.col(f).isNotNull(), key)).alias(f) for f in facts),
    )
    blank = (F.coalesce("cover.width", F.lit(0)) == 0) | (F.coalesce("cover.height", F.lit(0)) == 0)
    reason = (
        F.when(F.col("cover").isNull(), F.when(F.col("has_meta"), ORPHAN).otherwise(NO_SNAPSHOT))
        .when(blank, NO_VIEWPORT)
        .when(F.col("cover.root").isNull(), DAMAGED)
    )
    return out.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), REPLAYABLE).otherwise(DISCARDED)).drop("has_meta")


def opened_page(slices: DataFrame, open_ms: Column) -> DataFrame:
    """Adds ``opened``: the slice stands for a new document, not for a checkout within one."""
    fresh = F.when(F.col("reason") == NO_SNAPSHOT, True).when(F.col("reason") == NO_VIEWPORT, False).otherwise(open_ms < F.col("first_meta"))
    return slices.withColumn("opened", F.coalesce(fresh, F.lit(False)))


def _chained(slices: DataFrame, refused: DataFrame | None) -> DataFrame:
    """Replayable slices and orphans, with ``from``, the slice that an orphan would become part of, and whether its ``chain`` from there holds."""
    w = Window.partitionBy("visitor_id").orderBy("start_ts", "recorder_slice")
    part = slices.where((F.col("status") == REPLAYABLE) | (F.col("reason") == ORPHAN))
    base = F.sum((F.col("status") == REPLAYABLE).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("base", base).withColumn("from", F.max(F.when(F.col("status") == REPLAYABLE, F.col("recorder_slice"))).over(Window.partitionBy("visitor_id", "base")))
    run = Window.partitionBy("visitor_id", "base").orderBy("start_ts", "recorder_slice")
    part = part.withColumn("head", F.first("url").over(run))
    end = F.max("end_ts").over(run.rowsBetween(Window.unboundedPreceding, -1))
    good = (F.col("status") == REPLAYABLE) | ((F.col("start_ts") - end <= RESCUE_MS) & F.col("url").eqNullSafe(F.col("head")) & ~F.col("opened"))
    if refused is not None:
        part = part.join(refused.select(*KEYS, F.lit(True).alias("refused")).distinct(), list(KEYS), "left")
        good &= F.col("refused").isNull()
    part = part.withColumn("good", good & F.col("from").isNotNull())
    return part.withColumn("chain", F.min(F.col("good").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0)) == 1)


def rescuable(slices: DataFrame) -> DataFrame:
    """(visitor_id, recorder_slice, into): orphans that time and page would let go on where a replayable slice ended; what they name decides then (``dom.refusals``)."""
    return _chained(slices, None).where(F.col("chain") & (F.col("status") != REPLAYABLE)).select(*KEYS, F.col("from").alias("into"))


def rescued(slices: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """Orphans that go on where a replayable slice of the visitor ended, on the same page within RESCUE_MS, unless ``refused(visitor_id, recorder_slice)``.

    Each is judged on what the rescues before it made of the slice, so a chain is one run: an orphan joins the run if it starts soon enough after
    the run's end. Runs begin at replayable slices; other discarded slices neither join nor break one.
    """
    part = _chained(slices, refused).where("chain")
    taken = part.where(F.col("status") != REPLAYABLE).select("visitor_id", "recorder_slice", "from")
    grown = part.groupBy("visitor_id", F.col("from").alias("recorder_slice")).agg(
        F.max("end_ts").alias("grown_end"), F.sum("n_events").alias("grown_n"), F.sort_array(F.collect_list(F.when(F.col("status") != REPLAYABLE, F.col("recorder_slice")))).alias("absorbed")
    )
    out = slices.join(taken.withColumnRenamed("from", "into"), list(KEYS), "left").join(grown, list(KEYS), "left")
    return (
        out.withColumn("status", F.when(F.col("into").isNotNull(), RESCUED).otherwise(F.col("status")))
        .withColumn("end_ts", F.coalesce("grown_end", "end_ts"))
        .withColumn("n_events", F.coalesce("grown_n", "n_events"))
        .drop("grown_end", "grown_n")
    )


def prior_slices(slices: DataFrame) -> DataFrame:
    """As-of, strictly backward: of each slice the visitor's latest one that starts before it."""
    w = Window.partitionBy("visitor_id").orderBy("start_ts").rangeBetween(Window.unboundedPreceding, -1)
    return slices.withColumn("prior", F.max(F.struct("start_ts", "recorder_slice")).over(w)).select(*KEYS, "start_ts", F.col("prior.recorder_slice").alias("prior_slice"), F.col("prior.start_ts").alias("prior_start"))


def last_known(events: DataFrame, value: Column, name: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As-of state: the last value that isn't null, up to each event."""
    return Ordered.of(events, keys, ORDER).with_last(name, value).rows()


def overlapping(slices: DataFrame) -> DataFrame:
    """Slices that share time with another of their visitor: one pass over each visitor's order instead of a self-join."""
    w = Window.partitionBy("visitor_id").orderBy("start_ts", "end_ts", "recorder_slice")
    earlier = F.max("end_ts").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start_ts")
    later = F.lead("start_ts").over(w) <= F.col("end_ts")
    return slices.withColumn("concurrent", F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False)))


def not_current(events: DataFrame, slices: DataFrame) -> DataFrame:
    """Visitors with work to do: events without a slice, without flat columns, or slices without events."""
    a = events.where("slice_id is null").select("visitor_id")
    b = events.where("type_str is null").select("visitor_id")
    c = slices.join(events.select(*KEYS).distinct(), list(KEYS), "left_anti").select("visitor_id")
    return a.union(b).union(c).distinct()
