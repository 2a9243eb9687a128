"""The engine: a store of recorded chunks on one side, derived tables on the other, and the verbs between them.

Tables are Parquet under one folder, and every verb that changes some publishes them together (``sources.snapshots``): a reader sees all tables of one version.
Events, slices and sessions lie in buckets of visitors, and a load replaces only the buckets that it touches; what can be derived is always derived from whole
visitors. Derivation has stages, each with a digest of its code and settings that a bucket keeps; ``refresh`` derives a bucket anew from its first stale stage on.
"""

from __future__ import annotations

import hashlib
import json
import pathlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import exprs as X
from tracewell.functions import tables
from tracewell.operators import books, dom, flat, sessions, slices, spans, telemetry, windows
from tracewell.schema import CHUNK_ERRORS, LOADED_CHUNKS, Retention, SessionRule
from tracewell.settled import settled
from tracewell.sources import chunks
from tracewell.sources.snapshots import Snapshots

_EVENT = (
    "id long, visitor_id string, snippet string, recorder_slice string, timestamp long, type int, counter string, content_hash string, event string, user_agent string, language string, time_zone string, "
    "screen_width long, screen_height long, internal int, script_version string, type_str string, url string, title string, referrer string, user_id string, x long, y long, pointer_type string, input string, extra string, "
    "wrong_typed int, page_url string, session_start long"
)
_SLICE = (
    "visitor_id string, recorder_slice string, snippet string, start_ts long, end_ts long, n_events long, status string, reason string, absorbed array<string>, url string, language string, internal int, "
    "meta_ts long, snapshot_ts long, into string, opened boolean"
)
_SESSION = "visitor_id string, snippet string, start_ts long, end_ts long, duration_ms long, pageviews long, user_activity_ms long, acts long, engaged int"
BUCKETED = {"events": _EVENT, "slices": _SLICE, "sessions": _SESSION}




def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _flat(events: DataFrame) -> DataFrame:
    """Events with the flat columns of their JSON, and what else the table holds of them."""
    out = flat.flattened(events, "event")
    return out.select(*(c for c in out.columns if c in _names(_EVENT)))


#: Stages of derivation, in order, with the files that make them what they are and what each takes from those before.
STAGES = {
    "flat": (("operators/flat.py", "functions/exprs.py", "schema.py"), ()),
    "slices": (("operators/slices.py", "operators/dom.py"), ("flat",)),
    "sessions": (("operators/sessions.py", "operators/scans.py"), ("flat", "slices")),
    "stamps": (("engine.py",), ("flat", "sessions")),
}
#: Folders of a table that grows by appending, before they are put together.
FOLDERS = 32


def vintages(rule: SessionRule) -> dict[str, str]:
    """A digest of each stage's code and settings: what another digest derived is stale."""
    here = pathlib.Path(__file__).parent
    out = {}
    for stage, (files, _) in STAGES.items():
        digest = hashlib.sha256(repr(rule).encode() if stage == "sessions" else b"")
        for part in files:
            digest.update((here / part).read_bytes())
        out[stage] = digest.hexdigest()
    return out


def stale_stages(held: dict[str, str], now: dict[str, str]) -> list[str]:
    """Stages to run again: those of another vintage, and those that take from one that is run again."""
    again: list[str] = []
    for stage, (_, needs) in STAGES.items():
        if held.get(stage) != now[stage] or any(n in again for n in needs):
            again.append(stage)
    return again


class Engine:
    """version: the tables' version to read, the last one if none is named; an engine with a version is for reading only."""

    def __init__(self, spark: SparkSession, folder: str, store: str | None = None, rule: SessionRule = SessionRule(), retention: Retention = Retention(), buckets: int = 64, version: int | None = None):
        self.spark, self.folder, self.store, self.rule, self.retention, self.buckets = spark, folder.rstrip("/"), store, rule, retention, buckets
        self.snapshots, self.version = Snapshots(spark, self.folder), version

    # ------------------------------------------------------------------ tables
    def at(self, version: int | None = None) -> Engine:
        """This engine with its tables as of one version, the present one if none is named, whatever is published meanwhile."""
        return Engine(self.spark, self.folder, self.store, self.rule, self.retention, self.buckets, self.snapshots.latest() if version is None else version)

    def table(self, name: str) -> DataFrame:
        if name in BUCKETED:
            return self.snapshots.table(name, f"{BUCKETED[name]}, bucket int", self.version)
        rows = self.snapshots.table(name, {"manifest": LOADED_CHUNKS, "errors": CHUNK_ERRORS}[name].simpleString()[7:-1].replace(":", " "), self.version)
        return books.latest_manifest(rows, rows.limit(0)) if name == "manifest" else rows

    def _base(self) -> Engine:
        if self.version is not None:
            raise ValueError("this engine reads one version; change tables through one without")
        return self.at()

    def _replaced(self, base: Engine, name: str, df: DataFrame, buckets: list[int]) -> dict[str, list[str]]:
        """The table with some buckets replaced by df's rows; a bucket that df has no rows of is empty then."""
        return {name: Snapshots.without(self.snapshots.commit(base.version)["tables"].get(name, []), buckets) + self.snapshots.staged(name, df)}

    def _appended(self, base: Engine, name: str, df: DataFrame) -> dict[str, list[str]]:
        """The table with df's rows after it; what stands is put together once it lies in many folders."""
        parts = self.snapshots.commit(base.version)["tables"].get(name, [])
        if len(parts) < FOLDERS:
            return {name: parts + self.snapshots.staged(name, df)}
        every = base.table(name).unionByName(df)
        return {name: self.snapshots.staged(name, books.latest_manifest(every, every.limit(0)) if name == "manifest" else every)}

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("visitor_id"), F.lit(self.buckets)).cast("int"))

    # ------------------------------------------------------------------ verbs
    def inventory(self, prefix: str = "", cutoff: str = "") -> tuple[DataFrame, DataFrame]:
        """What the store holds under a prefix, and totals."""
        objects = books.parsed_keys(chunks.listing(self.spark, self.store, prefix))
        rows = books.inventory(objects, self.table("slices"), cutoff)
        return rows, books.store_totals(rows, objects)

    def load(self, prefix: str = "", cutoff: str = "") -> dict:
        """Fetches what isn't held, and derives the visitors that it touches. Chunks with anything that couldn't be used stay off the manifest, so they are read and reported again."""
        base = self._base()
        fresh = settled(chunks.fresh_objects(self.spark, self.store, base.table("manifest"), prefix, cutoff))
        if fresh.isEmpty():
            return {"chunks": 0, "corrupt": 0, "lossy": 0, "events": 0, "rejected": 0, "new": 0}
        told = Observation()
        rows = settled(chunks.decoded(chunks.content_of(self.spark, self.store, fresh)).observe(told, *chunks.decode_stats()))
        stats = told.get
        touched = [r["bucket"] for r in self._bucketed(rows.where("reason is null")).select("bucket").distinct().collect()]  # as many as there are buckets at most
        held = base.table("events").where(F.col("bucket").isin(touched))
        new = settled(chunks.first_of_each(rows, held).withColumn("id", F.xxhash64("visitor_id", "content_hash")))
        every = settled(self._bucketed(held.drop("bucket").unionByName(_flat(new), allowMissingColumns=True)))
        tables, notes = self._derived(base, every, touched, [s for s in STAGES if s != "flat"])
        bad = rows.where("reason is not null and reason not like 'recorder: %'").select("key").distinct()
        tables |= self._appended(base, "manifest", fresh.join(bad, "key", "left_anti").select("key", "etag", "uploaded_ms"))
        tables |= self._appended(base, "errors", books.recorder_errors(rows, base.table("errors")))
        self.snapshots.publish(base.version, tables, notes)
        return stats | {"new": new.count()}

    def _derived(self, base: Engine, every: DataFrame, buckets: list[int], stages: list[str]) -> tuple[dict[str, list[str]], dict]:
        """Tables with the stages run for some buckets, and notes of their vintages. every: all events of these buckets, written down, flat columns as they shall be."""
        tables: dict[str, list[str]] = {}
        if "slices" in stages:
            made = settled(self._slices(every))
            tables |= self._replaced(base, "slices", self._bucketed(made).select(*_names(_SLICE), "bucket"), buckets)
        else:
            made = base.table("slices").where(F.col("bucket").isin(buckets)).drop("bucket")
        if "sessions" in stages:
            found = settled(self._sessions(every, made))
            tables |= self._replaced(base, "sessions", self._bucketed(found).select(*_names(_SESSION), "bucket"), buckets)
        else:
            found = base.table("sessions").where(F.col("bucket").isin(buckets)).drop("bucket")
        stamped = sessions.stamped(slices.filled_page_url(every.drop("session_start", "page_url")), found, self.rule)
        tables |= self._replaced(base, "events", stamped.select(*_names(_EVENT), "bucket"), buckets)
        held = self.snapshots.commit(base.version)["notes"].get("vintages", {})
        return tables, {"vintages": held | {str(b): vintages(self.rule) for b in buckets}}

    def _slices(self, every: DataFrame) -> DataFrame:
        """Slices, rescue and covering pairs of events."""
        told = lambda path, kind: F.get_json_object("event", path).cast(kind)
        every = every.withColumns({"href": told("$.data.href", "string"), "width": told("$.data.width", "double"), "height": told("$.data.height", "double"), "root_id": told("$.data.node.id", "long")})
        made = slices.materialised(every, ("snippet", "language", "internal"))
        made = settled(slices.opened_page(made, X.slice_open_ms("recorder_slice")))
        runs = settled(slices.rescuable(made))
        made = slices.rescued(made, None if runs.isEmpty() else dom.refusals(every, runs, "event"))
        return made.join(slices.covering_pairs(every), list(slices.KEYS), "left")

    def _sessions(self, every: DataFrame, made: DataFrame) -> DataFrame:
        stubs = sessions.head_acts(made.where("opened"), every).withColumn("counter", F.lit(""))
        columns = ["visitor_id", "snippet", "timestamp", "counter", "type_str"]
        acts = every.where(X.is_activity("type_str", "extra")).select(*columns).unionByName(stubs.select(*columns))
        return sessions.sessions(acts, self.rule)

    def stale(self) -> dict[str, list[int]]:
        """Buckets to derive anew, by their first stale stage: of another vintage than the code and its settings."""
        now, out = vintages(self.rule), {}
        for bucket, held in self.snapshots.commit(self.at(self.version).version)["notes"].get("vintages", {}).items():
            again = stale_stages(held, now)
            if again:
                out.setdefault(again[0], []).append(int(bucket))
        return out

    def unfinished(self) -> list[int]:
        """Buckets of visitors that derivation has left something to do for: events without a slice or flat columns, slices without events."""
        events, made = self.table("events"), self.table("slices")
        placed = events.join(made.select(*slices.KEYS, F.lit(1).alias("slice_id")), list(slices.KEYS), "left")
        return [r["bucket"] for r in self._bucketed(slices.not_current(placed, made)).select("bucket").distinct().collect()]

    def refresh(self) -> dict[str, list[int]]:
        """Derives stale and unfinished buckets anew, each from its first such stage on, and publishes them together. Says which."""
        base = self._base()
        todo, damaged = base.stale(), base.unfinished()
        if damaged:
            todo = {stage: left for stage, own in todo.items() if (left := [b for b in own if b not in damaged])}
            todo["flat"] = sorted({*todo.get("flat", []), *damaged})
        tables: dict[str, list[str]] = {}
        notes: dict = {"vintages": {}}
        for stage, buckets in todo.items():
            every = base.table("events").where(F.col("bucket").isin(buckets))
            stages = stale_stages({s: v for s, v in vintages(self.rule).items() if s != stage}, vintages(self.rule))
            if "flat" in stages:
                every = self._bucketed(_flat(every.drop("bucket")))
            own, said = self._derived(base, settled(every), buckets, stages)
            for name, parts in own.items():  # each replaces its own buckets of the base
                new = [p for p in parts if p not in self.snapshots.commit(base.version)["tables"].get(name, [])]
                tables[name] = Snapshots.without(tables.get(name, self.snapshots.commit(base.version)["tables"].get(name, [])), buckets) + new
            notes["vintages"] |= said["vintages"]
        if todo:
            self.snapshots.publish(base.version, tables, notes)
        return todo

    def expire(self, cutoff: str) -> dict:
        """Drops all that opened before the cutoff's day, and derives the visitors who lost something. Only buckets that hold such slices are read and replaced."""
        base = self._base()
        made = base.table("slices")
        old = made.where(X.utc_day(X.slice_open_ms("recorder_slice")) < cutoff)
        touched = [r["bucket"] for r in old.select("bucket").distinct().collect()]  # as many as there are buckets at most
        events, made = base.table("events").where(F.col("bucket").isin(touched)), made.where(F.col("bucket").isin(touched))
        left = books.swept(cutoff, events, made, base.table("errors"), base.table("manifest"))
        tables: dict[str, list[str]] = {}
        notes, gone, visitors = {}, 0, 0
        if touched:
            every = settled(left["events"])
            gone, visitors = events.count() - every.count(), left["touched"].count()
            tables, notes = self._derived(base, every, touched, [s for s in STAGES if s != "flat"])
        tables |= {name: self.snapshots.staged(name, left[name]) for name in ("errors", "manifest")}
        self.snapshots.publish(base.version, tables, notes)
        return {"cutoff": cutoff, "events": gone, "visitors": visitors}

    def status(self) -> dict[str, DataFrame]:
        """Accounts that must add up, slices by status, and the hosts of each site."""
        events, made = self.table("events"), self.table("slices")
        hosts = made.where("url is not null").groupBy("snippet").agg(F.sort_array(F.collect_set(X.url_host("url"))).alias("hosts"))
        through = self.table("manifest").groupBy(F.split_part("key", F.lit("/"), F.lit(1)).alias("snippet")).agg(F.max("uploaded_ms").alias("loaded_through"))
        return {"accounts": books.reconciled(events, made), "slices": books.by_status(made), "sites": hosts.join(through, "snippet", "left")}

    def doctor(self, cutoff: str = "", heal: bool = False) -> DataFrame:
        """Checks of the tables: derivations of this vintage, no event without a slice or flat columns, nothing past keeping, accounts that add up.

        heal: first derives what is stale or unfinished, and drops what is past keeping; the checks then tell how the tables stand after it.
        """
        if heal:
            self.refresh()
            if cutoff and not self.table("slices").where(X.utc_day(X.slice_open_ms("recorder_slice")) < cutoff).isEmpty():
                self.expire(cutoff)
        now = self.at(self.version)
        events, made = now.table("events"), now.table("slices")
        a = books.reconciled(events, made).first()
        checks = [
            ("vintage", not now.stale()),
            ("slices", a["unplaced"] == 0),
            ("flat", events.where("type_str is null").isEmpty()),
            ("accounts", a["events"] == a["analyzable"] + a["dropped"] + a["unplaced"]),
            ("standing", made.count() == books.standing(made, events).count()),
            ("retention", made.where(X.utc_day(X.slice_open_ms("recorder_slice")) < cutoff).isEmpty()),
        ]
        return self.spark.createDataFrame(checks, "name string, ok boolean")

    def targets(self, asked: DataFrame | None = None) -> DataFrame:
        """Clicks with their target's tag, class, followed address and shown text as they stood then; of ``asked(visitor_id, recorder_slice)``, or all. What was rescued is read where it went on."""
        events, made = self.table("events"), self.table("slices").where("status <> 'discarded'")
        if asked is not None:
            made = made.join(asked.select(*slices.KEYS).distinct(), list(slices.KEYS), "left_semi")
        place = made.select(*slices.KEYS, F.coalesce("into", "recorder_slice").alias("read_in"))
        # all of a slice that others were taken into is needed to know their page
        heads = self.table("slices").join(place.select("visitor_id", F.col("read_in").alias("recorder_slice")).distinct(), list(slices.KEYS), "left_semi")
        both = heads.select(*slices.KEYS, F.col("recorder_slice").alias("read_in")).union(place).distinct()
        rows = events.join(both, list(slices.KEYS)).withColumn("own", F.col("recorder_slice")).withColumn("recorder_slice", F.col("read_in")).drop("read_in")
        e = dom.with_epochs(rows.select("id", *slices.KEYS, "own", "timestamp", "counter", "type", "type_str", "event"))
        clicks = e.where("type_str = 'Click'").withColumn("target_id", F.get_json_object("event", "$.data.id").cast("long")).drop("event", "type", "type_str")
        out = dom.seen(clicks, dom.packed(e, "event", **dom.OF_BOTH)).withColumn("recorder_slice", F.col("own")).select("id", *slices.KEYS, "timestamp", "counter", "target_id", "tag", "class", "href", "text")
        return out if asked is None else out.join(asked.select(*slices.KEYS).distinct(), list(slices.KEYS), "left_semi")

    def sql(self, text: str) -> DataFrame:
        """Ad-hoc SQL over the tables as views; ``event_stream`` and the functions of ``functions.tables`` are known to it."""
        tables.register(self.spark)
        for name in (*BUCKETED, "manifest", "errors"):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def ae(self, text: str, points: DataFrame) -> dict:
        """SQL over a telemetry table; see telemetry.answer."""
        return telemetry.answer(self.spark, text, points)

    def window(self, asked: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
        """The slice table of ``asked(window, visitor_id, recorder_slice)``."""
        return windows.slice_table(asked, self.table("slices"), self.table("events"), start, end)

    def analyze(self, asked: DataFrame, tokens=None, interval_ms: int = 500, context: int = 1_000_000) -> dict[str, DataFrame]:
        """What a model would be given of a window: its table, context, stream and screenshot moments, and the price by ``tokens``, a function of a line's column. Nothing is sent."""
        table = settled(self.window(asked))
        events = self.table("events").join(table.where("reason is null").select(*slices.KEYS).distinct(), list(slices.KEYS), "left_semi")
        everything = self.table("events").join(table.select("visitor_id").distinct(), "visitor_id", "left_semi")
        line = F.concat_ws(" ", "type_str", F.coalesce("url", "input", "title"))
        seen = events.where(windows.stream_visible("type_str", F.lit(None).cast("int"), F.lit("x"))).withColumn("line", line)
        bounds = table.where("reason is null").select(*slices.KEYS, F.col("screenshot_start_ts").alias("start_ts"), "end_ts").distinct()
        marks = spans.screenshot_marks(events.where(X.is_activity("type_str", "extra")).select(*slices.KEYS, "timestamp", "type_str"), bounds, slices.KEYS, interval_ms)
        moments = marks.select(*slices.KEYS, F.col("mark_ts").alias("timestamp"), F.lit("screenshot").alias("line"))
        stream = windows.composed(table, seen, moments)
        timeline = windows.context_block(windows.timeline(self.table("slices"), everything))
        count = tokens or (lambda c: F.ceil(F.char_length(c) / 4))
        parts = stream.groupBy("window", "label").agg(F.sum(F.when(F.col("shot") == 0, count(F.col("line")))).alias("text_tokens"), F.sum(F.when(F.col("shot") == 1, 1000)).alias("screenshot_tokens"))
        return {"table": table, "stream": stream, "context": timeline.join(table.select(*slices.KEYS, "window"), list(slices.KEYS)), "price": windows.priced(parts, context)}

    def describe(self) -> str:
        """Tables and their columns as JSON, for whoever writes the SQL."""
        return json.dumps({name: self.table(name).schema.simpleString() for name in (*BUCKETED, "manifest", "errors")})
