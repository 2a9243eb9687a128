"""Visits: runs of a visitor's acts on one site with no gap above the rule's.

A gap of exactly the threshold still belongs to the run. All windows are partitioned by visitor and site, so they share one shuffle; visitors of more rows than a
task should hold are scanned in stretches (``scans``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.scans import Ordered
from tracewell.schema import SessionRule

KEYS = ("visitor_id", "snippet")


def with_runs(acts: DataFrame, rule: SessionRule = SessionRule()) -> DataFrame:
    """Adds ``run``, the number of the session within visitor and site, and ``delta``, the time since the act before it in the run."""
    step = Ordered.of(acts, KEYS, ("timestamp", "counter")).with_lag("before", F.col("timestamp"))
    gap = F.col("timestamp") - F.col("before")
    step = step.with_total("run", F.when(gap > rule.gap_ms, 1).otherwise(0)).with_column("delta", F.when(gap <= rule.gap_ms, gap))
    return step.rows().drop("before")


def sessions(acts: DataFrame, rule: SessionRule = SessionRule()) -> DataFrame:
    """One row a session: span, page views, active time (stretches without a pause above the rule's), engagement."""
    short = F.when(F.col("delta") <= rule.stretch_ms, F.col("delta")).otherwise(0)
    out = with_runs(acts, rule).groupBy(*KEYS, "run").agg(
        F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("end_ts"),
        (F.max("timestamp") - F.min("timestamp")).alias("duration_ms"),
        F.count_if(F.col("type_str") == "PageLoad").alias("pageviews"),
        F.sum(short).alias("user_activity_ms"),
        F.count("*").alias("acts"),
    )
    engaged = (F.col("duration_ms") > rule.engaged_ms) | (F.col("pageviews") >= rule.engaged_pageviews)
    return out.withColumn("engaged", engaged.cast("int"))


def with_reach(found: DataFrame, rule: SessionRule = SessionRule()) -> DataFrame:
    """Adds low and high: a session also reaches a gap to either side, but not into what the one before reaches."""
    reach = Ordered.of(found.withColumn("high", F.col("end_ts") + rule.gap_ms), KEYS, ("start_ts",)).with_lag("before", F.col("high"))
    return reach.rows().withColumn("low", F.greatest(F.col("start_ts") - rule.gap_ms, F.col("before") + 1)).drop("before")


def stamped(events: DataFrame, found: DataFrame, rule: SessionRule = SessionRule()) -> DataFrame:
    """Events with ``session_start`` of the session that reaches them, or null.

    No range join: bounds and events are merged and the latest bound carried forward, so a visitor with many
    sessions and many events costs one sort.
    """
    reach = with_reach(found, rule).select(*KEYS, "start_ts", "low", "high")
    bounds = reach.select(*KEYS, F.col("low").alias("timestamp"), F.lit(0).alias("side"), F.struct("start_ts", "high").alias("bound"))
    both = bounds.unionByName(events.withColumn("timestamp", F.col("timestamp")).withColumn("side", F.lit(1)), allowMissingColumns=True)
    last = Ordered.of(both, KEYS, ("timestamp", "side")).with_last("bound", F.col("bound")).rows().where("side = 1")
    inside = F.when(F.col("timestamp") <= F.col("bound.high"), F.col("bound.start_ts"))
    return last.withColumn("session_start", inside).drop("bound", "side")


def stamped_by_range(events: DataFrame, found: DataFrame, rule: SessionRule = SessionRule()) -> DataFrame:
    """The same as ``stamped`` by a join on visitor and site (null-safe) with a residual range, for cross-checks."""
    r = with_reach(found, rule).select(*(F.col(k).alias("r_" + k) for k in KEYS), "start_ts", "low", "high")
    on = (events["visitor_id"] == r["r_visitor_id"]) & events["snippet"].eqNullSafe(r["r_snippet"]) & events["timestamp"].between(r["low"], r["high"])
    return events.join(r, on, "left").withColumn("session_start", F.col("start_ts")).drop("r_visitor_id", "r_snippet", "start_ts", "low", "high")


def by_session_window(acts: DataFrame, rule: SessionRule = SessionRule()) -> DataFrame:
    """The same sessions by Spark's own session window, which also runs in streams. Its end is the last act plus the gap."""
    stamp = F.timestamp_millis("timestamp")
    out = acts.groupBy(*KEYS, F.session_window(stamp, f"{rule.gap_ms} milliseconds").alias("w")).agg(F.count("*").alias("acts"))
    return out.select(*KEYS, F.unix_millis("w.start").alias("start_ts"), (F.unix_millis("w.end") - rule.gap_ms).alias("end_ts"), "acts")


def engagement_by_site(found: DataFrame) -> DataFrame:
    return found.groupBy("snippet").agg(
        F.count("*").alias("sessions"),
        F.sum("engaged").cast("long").alias("engaged"),
        F.round(1 - F.avg("engaged"), 6).alias("bounce_rate"),
        F.sum("pageviews").alias("pageviews"),
    )


def head_acts(slices: DataFrame, events: DataFrame) -> DataFrame:
    """Stub page loads: slices that opened a page but hold no PageLoad count as one at their start."""
    loads = events.where(F.col("type_str") == "PageLoad").select("visitor_id", "recorder_slice").distinct()
    return slices.join(loads, ["visitor_id", "recorder_slice"], "left_anti").select("visitor_id", "snippet", F.col("start_ts").alias("timestamp"), F.lit("PageLoad").alias("type_str"))


def of_user(found: DataFrame, events: DataFrame, user_id: str) -> DataFrame:
    """Sessions of all visitors that were ever identified as the user."""
    return found.join(events.where(F.col("user_id") == user_id).select("visitor_id").distinct(), "visitor_id", "left_semi")
