"""Micro-batch ingestion. In ``absorbed``, late events are never dropped: a batch that touches a visitor has its sessions derived anew.

``live_sessions`` and ``live_routes`` are for endless streams with bounded state: what comes later than their watermark is dropped there.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewell.functions import exprs as X
from tracewell.operators import sessions
from tracewell.schema import SessionRule
from tracewell.sources import store

EVENT = "visitor_id string, snippet string, timestamp long, counter string, type_str string, content_hash string"
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


class Store:
    """Event and session tables as Parquet, a folder for each run of a query and batch, events in buckets of visitors; a batch that runs again overwrites its own."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def path(self, table: str, run: str, batch: int) -> str:
        return f"{self.folder}/{table}/run={run}/batch={batch}"

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("visitor_id"), F.lit(self.buckets)).cast("int"))

    def events(self, run: str, before: int, buckets: list[int]) -> DataFrame:
        """What all batches but this run's from ``before`` on brought, of some buckets: partitions, so the others aren't read."""
        root = f"{self.folder}/events"
        try:
            every = self.spark.read.schema(f"{EVENT}, run string, batch int, bucket int").option("basePath", root).parquet(root)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            every = self.spark.createDataFrame([], f"{EVENT}, run string, batch int, bucket int")
        return every.where(F.col("bucket").isin(buckets) & ~((F.col("run") == run) & (F.col("batch") >= before))).select(*COLUMNS)


def absorbed(held: Store, rule: SessionRule = SessionRule(), run_name: str = "one"):
    """A foreachBatch function: new events are added once, then all sessions of their visitors are derived from all they have."""

    def run(batch: DataFrame, number: int) -> None:
        own = held.bucketed(batch.select(*COLUMNS).dropDuplicates(["visitor_id", "content_hash"])).persist()
        try:
            touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # as many as there are buckets at most
            new = own.join(held.events(run_name, number, touched).select("visitor_id", "content_hash"), ["visitor_id", "content_hash"], "left_anti")
            new.select(*COLUMNS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(held.path("events", run_name, number))
            acts = held.events(run_name, number + 1, touched).join(own.select("visitor_id").distinct(), "visitor_id", "left_semi")
            sessions.sessions(acts, rule).withColumn("derived_at", F.lit(time.time_ns())).write.mode("overwrite").parquet(held.path("sessions", run_name, number))
        finally:
            own.unpersist()

    return run


def current_sessions(held: Store) -> DataFrame:
    """Of each visitor the sessions that the latest batch to touch it derived."""
    every = held.spark.read.option("basePath", f"{held.folder}/sessions").parquet(f"{held.folder}/sessions")
    latest = every.groupBy("visitor_id").agg(F.max("derived_at").alias("derived_at"))
    return every.join(latest, ["visitor_id", "derived_at"], "left_semi").drop("run", "batch", "derived_at")


def start(source: DataFrame, held: Store, checkpoint: str, rule: SessionRule = SessionRule()) -> StreamingQuery:
    """Runs until all that is there has been read. Batches are named by their checkpoint too, so a new one doesn't overwrite an old one's."""
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    return source.writeStream.foreachBatch(absorbed(held, rule, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A store's objects with their content, as they are stored; one that is sent again comes again. options: those of the source ``chunk_store``."""
    return store.arriving(spark, folder, **options)


def live_sessions(acts: DataFrame, rule: SessionRule = SessionRule(), late: str = "30 days") -> DataFrame:
    """Sessions of an endless stream by Spark's session window; the watermark is the retention horizon, beyond which state goes and late rows are dropped."""
    stamped = acts.withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", late)
    w = F.session_window("at", f"{rule.gap_ms} milliseconds").alias("w")
    out = stamped.groupBy("visitor_id", "snippet", w).agg(F.count("*").alias("acts"), F.count_if(F.col("type_str") == "PageLoad").alias("pageviews"))
    return out.select("visitor_id", "snippet", F.unix_millis("w.start").alias("start_ts"), (F.unix_millis("w.end") - rule.gap_ms).alias("end_ts"), "acts", "pageviews")


def live_first_writers(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Each content of a visitor once, remembered as long as the watermark: bounded state instead of a join with all history."""
    return events.withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["visitor_id", "content_hash"]).drop("at")


def live_routes(events: DataFrame, late: str = "30 days", forget_ms: int = 30 * 86_400_000) -> DataFrame:
    """Route changes of each visitor across batches: the state is the last route, and goes when the watermark has passed it by ``forget_ms``."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["timestamp", "counter"])
        before = state.get[0] if state.exists else None
        changed = rows[rows["route"] != rows["route"].shift(fill_value=before if before is not None else "")]
        state.update((rows["route"].iloc[-1],))
        state.setTimeoutTimestamp(max(int(rows["timestamp"].max()) + forget_ms, state.getCurrentWatermarkMs() + 1))
        yield changed[["visitor_id", "timestamp", "counter", "route"]]

    rows = events.where("url is not null").select("visitor_id", "timestamp", "counter", X.route_key("url").alias("route"), F.timestamp_millis("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("visitor_id").applyInPandasWithState(step, "visitor_id string, timestamp long, counter string, route string", "route string", "append", GroupStateTimeout.EventTimeTimeout)


STITCHED = "visitor_id string, snippet string, start_ts long, end_ts long, duration_ms long, pageviews long, user_activity_ms long, acts long, engaged int, turn long"


class Stitch(StatefulProcessor):
    """Sessions of one visitor on one site across batches. State: the acts of the last ``forget_ms`` before the watermark, each content once; a timer drops what is older.

    A batch's acts, late or repeated, are put among those held, and the sessions of all of them come out with the number of the turn; the last turn's stand.
    """

    def __init__(self, rule: SessionRule, forget_ms: int):
        self.rule, self.forget_ms = rule, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("acts", "timestamp long, page int, content_hash string")
        self.turn = handle.getValueState("turn", "n long")

    def _sessions(self, key: tuple, acts: list[tuple], turn: int) -> pd.DataFrame:
        rule, out = self.rule, []
        for t, page, _ in acts:
            if out and t - out[-1][1] <= rule.gap_ms:
                last = out[-1]
                step = t - last[1]
                out[-1] = (last[0], t, last[2] + page, last[3] + (step if step <= rule.stretch_ms else 0), last[4] + 1)
            else:
                out.append((t, t, page, 0, 1))
        engaged = lambda s: int(s[1] - s[0] > rule.engaged_ms or s[2] >= rule.engaged_pageviews)
        rows = [(*key, s[0], s[1], s[1] - s[0], s[2], s[3], s[4], engaged(s), turn) for s in out]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STITCHED.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        known, fresh = {r[2] for r in held}, []
        for part in rows:
            for t, kind, content in zip(part["timestamp"], part["type_str"], part["content_hash"], strict=True):
                if content not in known:
                    known.add(content)
                    fresh.append((int(t), int(kind == "PageLoad"), content))
        if not fresh:
            return
        turn = (self.turn.get()[0] if self.turn.exists() else 0) + 1
        acts = sorted(held + fresh)
        self.turn.update((turn,))
        self.held.put(acts)
        self.handle.registerTimer(max(acts[-1][0] + self.forget_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._sessions(key, acts, turn)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() - self.forget_ms
        left = [tuple(r) for r in self.held.get() if r[0] > until] if self.held.exists() else []
        if left:
            self.held.put(left)
        else:  # the turn stays, so that what comes after such a silence counts on
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def stitched(acts: DataFrame, rule: SessionRule = SessionRule(), late: str = "30 days", forget_ms: int = 30 * 86_400_000) -> DataFrame:
    """Sessions of a stream of acts(visitor_id, snippet, timestamp, type_str, content_hash), each key's anew whenever some of its acts are new: of a key the rows of the highest ``turn`` stand.

    Acts count once by their content, so what is sent again changes nothing. One later than the watermark is dropped. State is a visitor's acts on a site, in one task. The session must have RocksDB as its
    state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = acts.select("visitor_id", F.coalesce("snippet", F.lit("")).alias("snippet"), "timestamp", "type_str", "content_hash", F.timestamp_millis("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("visitor_id", "snippet").transformWithStateInPandas(Stitch(rule, forget_ms), outputStructType=STITCHED, outputMode="Append", timeMode="EventTime")


def standing_sessions(rows: DataFrame) -> DataFrame:
    """Of what ``stitched`` has put out, the sessions that stand."""
    last = rows.groupBy("visitor_id", "snippet").agg(F.max("turn").alias("turn"))
    return rows.join(last, ["visitor_id", "snippet", "turn"], "left_semi").drop("turn")


def delivery_latency(objects: DataFrame) -> DataFrame:
    """How long after a slice opened each of its objects was stored."""
    return objects.withColumn("latency_ms", F.col("uploaded_ms") - X.slice_open_ms("recorder_slice"))
