"""Evidence windows: which slices a window may hold, its pages, what stood around them, and the stream that a reader gets.

All of it works on any number of windows, slices or visitors at once; walls come out as rows with a reason instead of stopping a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import exprs as X
from tracewell.operators.slices import KEYS, ORDER, REPLAYABLE

# Kinds that a stream prints.
STREAM = (
    "Meta", "FullSnapshot", "PageLoad", "PageVisible", "PageHidden", "Identify", "Mutation", "MouseMove", "ViewportResize", "Scroll", "Input", "TouchMove", "MediaInteraction", "Drag", "Selection",
    "Click", "DblClick", "MouseDown", "MouseUp", "TouchStart", "TouchEnd", "TouchCancel", "ContextMenu", "Focus", "Blur",
)


# ------------------------------------------------------------------ slice tables
def slice_table(asked: DataFrame, slices: DataFrame, events: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """The slices of windows ``asked(window, visitor_id, recorder_slice)``, labelled S1 .. Sn in order of start, end and id.

    slices: with status, snippet and snapshot_ts, the moment of the first snapshot. Bounds are those of the events within [start, end). A row that a
    window may not hold has no label but a reason: named twice, unknown, not replayable, without events there, or with none from its snapshot on.
    """
    within = events.select(*KEYS, "timestamp")
    within = within.where(F.col("timestamp") >= start) if start is not None else within
    within = within.where(F.col("timestamp") < end) if end is not None else within
    named = asked.groupBy("window", *KEYS).agg(F.count("*").alias("named"))
    bounds = within.join(named.select(*KEYS).distinct(), list(KEYS), "left_semi").groupBy(*KEYS).agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"))
    rows = named.join(slices.select(*KEYS, "snippet", "status", "snapshot_ts"), list(KEYS), "left").join(bounds, list(KEYS), "left")
    reason = (
        F.when(F.col("named") > 1, "named twice")
        .when(F.col("status").isNull(), "unknown")
        .when(F.col("status") != REPLAYABLE, "not replayable")
        .when(F.col("start_ts").isNull(), "no events")
        .when(F.col("snapshot_ts").isNull() | (F.col("snapshot_ts") > F.col("end_ts")), "before its snapshot")
    )
    rows = rows.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy("window", F.col("reason").isNull()).orderBy("start_ts", "end_ts", "recorder_slice"))
    shown = F.when(F.col("reason").isNull(), F.greatest("start_ts", "snapshot_ts"))
    return rows.withColumn("label", F.when(F.col("reason").isNull(), F.concat(F.lit("S"), place.cast("string")))).withColumn("screenshot_start_ts", shown).drop("named", "status")


def window_walls(table: DataFrame) -> DataFrame:
    """Why a window can't be replayed on one player: slices of several visitors, slices that overlap, or a refused slice; no row if it can."""
    w = Window.partitionBy("window").orderBy("start_ts", "end_ts", "recorder_slice")
    rows = table.withColumn("meets", F.lead("start_ts").over(w) < F.col("end_ts"))
    walls = rows.groupBy("window").agg(F.countDistinct("visitor_id").alias("visitors"), F.bool_or(F.coalesce("meets", F.lit(False))).alias("overlap"), F.bool_or(F.col("reason").isNotNull()).alias("refused"))
    wall = F.when(F.col("refused"), "a slice is refused").when(F.col("visitors") > 1, "several visitors").when(F.col("overlap"), "slices overlap")
    return walls.select("window", wall.alias("wall")).where("wall is not null")


def sites(table: DataFrame) -> DataFrame:
    """Sites of each window; a slice without one makes the window ``unplaced``."""
    return table.groupBy("window").agg(F.sort_array(F.collect_set("snippet")).alias("sites"), F.bool_or(F.col("snippet").isNull()).alias("unplaced"))


def set_names(table: DataFrame) -> DataFrame:
    """A window's name: its first slice, the number of the others and a digest of all."""
    own = F.concat_ws("_", "visitor_id", "recorder_slice")
    rows = table.groupBy("window").agg(F.min_by(own, F.struct("start_ts", "end_ts", "recorder_slice")).alias("first"), F.array_sort(F.collect_list(F.concat_ws(":", *KEYS))).alias("ids"))
    more = F.concat(F.lit("_plus"), (F.size("ids") - 1).cast("string"), F.lit("_"), F.substring(F.sha1(F.array_join("ids", "+")), 1, 6))
    return rows.select("window", F.concat("first", F.when(F.size("ids") > 1, more).otherwise("")).alias("name"))


def current(asked: DataFrame, slices: DataFrame) -> DataFrame:
    """Natural keys as they stand now: each with its slice's status, or why it can't be used."""
    rows = asked.join(slices.select(*KEYS, "status"), list(KEYS), "left")
    return rows.withColumn("reason", F.when(F.col("status").isNull(), "unknown").when(F.col("status") != REPLAYABLE, "not replayable"))


def replay_payloads(table: DataFrame, events: DataFrame) -> DataFrame:
    """A JSON array of each replayable window's events in order, ``events`` holding each one's own JSON. One window is one row."""
    rows = table.where("reason is null").select("window", *KEYS).join(events, list(KEYS))
    return rows.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "event"))).alias("e")).select("window", F.size("e").alias("n"), F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["event"]), ","), F.lit("]")).alias("payload"))


# ------------------------------------------------------------------ pages
def heads(events: DataFrame) -> DataFrame:
    """Of each slice the first event with an address: (keys, url, head_ts)."""
    own = events.where("url is not null and url <> ''")
    return own.groupBy(*KEYS).agg(F.min_by(F.struct("url", "timestamp"), F.struct(*ORDER)).alias("h")).select(*KEYS, "h.url", F.col("h.timestamp").alias("head_ts"))


def arrivals(events: DataFrame) -> DataFrame:
    """How each slice's page came to be: a page load if a PageLoad in the slice has the head's route, with its referrer; else unattested."""
    head = heads(events).withColumn("route", X.route_key("url"))
    loads = events.where("type_str = 'PageLoad'").select(*KEYS, X.route_key("url").alias("route"), *ORDER, F.nullif("referrer", F.lit("")).alias("referrer"))
    first = loads.groupBy(*KEYS, "route").agg(F.min_by(F.struct("referrer"), F.struct(*ORDER)).alias("load"))
    out = head.join(first, [*KEYS, "route"], "left")
    return out.select(*KEYS, "url", "head_ts", F.when(F.col("load").isNotNull(), "page-load").otherwise("unattested").alias("kind"), F.col("load.referrer").alias("referrer"))


def pages(events: DataFrame, arrived: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Pages of each slice in order: its head, then the page loads in it but the one that made the head. start and end bound the latter."""
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    loads = events.where("type_str = 'PageLoad'").withColumn("k", F.row_number().over(w)).select(*KEYS, F.col("url").alias("page"), F.col("timestamp").alias("ts"), "k")
    loads = loads.join(arrived.select(*KEYS, F.col("url").alias("head")), list(KEYS)).where(~((F.col("k") == 1) & X.route_key("page").eqNullSafe(X.route_key("head"))))
    loads = loads.where(F.col("ts") >= start) if start is not None else loads
    loads = loads.where(F.col("ts") < end) if end is not None else loads
    rows = arrived.select(*KEYS, F.lit(0).alias("k"), F.col("url").alias("page"), "kind", F.col("head_ts").alias("ts")).unionByName(loads.select(*KEYS, "k", "page", F.lit("page-load").alias("kind"), "ts"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*KEYS).orderBy("k"))).drop("k")


def timeline(slices: DataFrame, events: DataFrame) -> DataFrame:
    """Each slice that wasn't taken into another, with the page before and after it and how long ago and until.

    A slice opens mid-page if it is unattested and shows the page of the one before; then the page before is the last other one.
    """
    arrived = arrivals(events)
    last = pages(events, arrived).groupBy(*KEYS).agg(F.max_by("page", "place").alias("tail_url"))
    rows = slices.where("status <> 'rescued'").select(*KEYS, "start_ts", "end_ts", "status")
    rows = rows.join(arrived, list(KEYS), "left").join(last, list(KEYS), "left")
    w = Window.partitionBy("visitor_id").orderBy("start_ts", "recorder_slice")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("url").eqNullSafe(F.lag("url").over(w)) & F.lag("start_ts").over(w).isNotNull()
    rows = rows.withColumn("mid_page", F.coalesce((F.col("kind") == "unattested") & same, F.lit(False))).withColumn("turn", F.sum((~same).cast("int")).over(upto)).withColumn("stay", F.sum((~F.col("mid_page")).cast("int")).over(upto))
    rows = rows.withColumn("loaded_ts", F.min("start_ts").over(Window.partitionBy("visitor_id", "stay")))
    rows = rows.withColumn("before", F.lag(F.struct("tail_url", "end_ts")).over(w)).withColumn("after", F.lead(F.struct("url", "start_ts", "status")).over(w))
    turns = rows.groupBy("visitor_id", (F.col("turn") + 1).alias("turn")).agg(F.max_by(F.struct("tail_url", "end_ts"), F.struct("start_ts", "recorder_slice")).alias("other"))
    rows = rows.join(turns, ["visitor_id", "turn"], "left").withColumn("before", F.when(F.col("mid_page"), F.col("other")).otherwise(F.col("before")))
    return rows.select(
        *KEYS, "start_ts", "end_ts", "kind", "url", "referrer", "mid_page", "loaded_ts",
        F.col("before.tail_url").alias("prior_page"), (F.col("start_ts") - F.col("before.end_ts")).alias("prior_gap_ms"),
        F.col("after.url").alias("next_page"), F.when(F.col("after").isNotNull(), F.greatest(F.col("after.start_ts") - F.col("end_ts"), F.lit(0))).alias("next_gap_ms"), (F.col("after.status") == "discarded").alias("next_incomplete"),
    )


def context_block(line: DataFrame, incomplete: str = "recorded incompletely") -> DataFrame:
    """The timeline's rows as text: what was before, how the page was reached, what came after."""
    page = lambda c: F.coalesce(X.page_address(c), F.lit("an unknown page"))
    mid = F.when(F.col("mid_page"), F.concat(F.lit("This recording opens mid-page: "), page("url"), F.lit(", loaded "), X.coarse_duration(F.col("start_ts") - F.col("loaded_ts")), F.lit(" earlier.")))
    prior = F.when(F.col("prior_gap_ms").isNotNull(), F.concat(F.lit("Prior page: "), page("prior_page"), F.lit(", left "), X.coarse_duration("prior_gap_ms"), F.lit(" before this recording."))).when(~F.col("mid_page"), "Prior page: none recorded.")
    referrer = F.when(F.col("kind") == "page-load", F.concat(F.lit("Referrer: "), F.coalesce(X.page_address("referrer"), F.lit("none")), F.lit(".")))
    mark = F.when(F.col("next_incomplete"), F.concat(F.lit(" ("), F.lit(incomplete), F.lit(")"))).otherwise("")
    after = F.when(F.col("next_gap_ms").isNotNull(), F.concat(F.lit("Next page: "), page("next_page"), F.lit(", "), X.coarse_duration("next_gap_ms"), F.lit(" after this recording"), mark, F.lit("."))).otherwise("Next page: none recorded.")
    return line.withColumn("context", F.concat_ws("\n", mid, prior, referrer, after))


def route_changes(events: DataFrame) -> DataFrame:
    """Events with an address whose route differs from the one before in the visitor's stream."""
    w = Window.partitionBy("visitor_id").orderBy(*ORDER)
    rows = events.where("url is not null").withColumn("route", X.route_key("url"))
    return rows.withColumn("before", F.lag("route").over(w)).where(~F.col("route").eqNullSafe(F.col("before"))).drop("before")


# ------------------------------------------------------------------ streams
def stream_visible(type_str: Column | str = "type_str", hidden: Column | str = "hidden", diff: Column | str = "diff") -> Column:
    """Whether a flat event is a line of its own. One that was never flattened is an error."""
    kind, hidden, diff = (F.col(c) if isinstance(c, str) else c for c in (type_str, hidden, diff))
    unseen = kind.isin("Input", "Focus", "Blur") & hidden.eqNullSafe(F.lit(1))
    empty = (kind == "Mutation") & (F.coalesce(diff, F.lit("")) == "")
    return F.when(kind.isNull(), F.raise_error(F.lit("an event was never flattened"))).otherwise(kind.isin(*STREAM) & ~unseen & ~empty)


def stream_body(text: Column | str) -> Column:
    """Text under an event's line: blank lines and bare signs go, queries of links shrink to ?…"""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x, F.lit(" \t\r")).isin("", "+", "-"))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\]\((https?://[^)?\s]*)\?[^)#\s]*(#[^)\s]*)?\)", "]($1?…$2)")


#: What a window's lines are read in the order of, within it.
READING = ("opened", "visitor_id", "timestamp", "shot", "number", "counter")


def stream_lines(table: DataFrame, events: DataFrame, moments: DataFrame) -> DataFrame:
    """A window's lines, with what puts them in reading order (READING): visitors by their first slice, then events and screenshots by moment, kind and slice.

    events and moments: with keys, timestamp and line.
    """
    own = table.where("reason is null").select("window", *KEYS, "label", "start_ts", "end_ts")
    own = own.withColumn("opened", F.min("start_ts").over(Window.partitionBy("window", "visitor_id")))
    lines = events.select(*KEYS, "timestamp", F.lit(0).alias("shot"), "counter", "line").unionByName(moments.select(*KEYS, "timestamp", F.lit(1).alias("shot"), F.lit("").alias("counter"), "line"))
    rows = own.join(lines, list(KEYS)).where("timestamp between start_ts and end_ts")
    return rows.select("window", "label", "line", F.substring("label", 2, 9).cast("int").alias("number"), *(c for c in READING if c != "number"))


def composed(table: DataFrame, events: DataFrame, moments: DataFrame) -> DataFrame:
    """A window's lines in reading order, with their ``place``, from 1 in each window."""
    place = F.row_number().over(Window.partitionBy("window").orderBy(*READING))
    return stream_lines(table, events, moments).select("window", "visitor_id", "label", "timestamp", "shot", "line", place.alias("place"))


def priced(parts: DataFrame, context: int, headroom: float = 1.0) -> DataFrame:
    """``parts(window, label, text_tokens, screenshot_tokens)``: each window's tokens, its share of the context, and whether it fits; and each part's alone."""
    total = F.coalesce("text_tokens", F.lit(0)) + F.coalesce("screenshot_tokens", F.lit(0))
    rows = parts.withColumn("total", total).groupingSets([["window", "label"], ["window"]], "window", "label").agg(F.sum("total").alias("tokens"))
    return rows.select("window", "label", "tokens", (F.floor(F.col("tokens") * 1000 / context + 0.5) / 10).alias("percent"), (F.col("tokens") <= int(context * headroom)).alias("fits"))


#: Pages that a facts block names (a fixed value).
TOP_PAGES = 5


def facts_block(events: DataFrame, arrivals: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, facts): what a window holds, in a few lines: dates, number of events and their time, kinds by number, and the pages come to, the most frequent first.

    events: keys, timestamp, counter, type_str. arrivals: keys, timestamp, counter, url, loads; one row for each page in order. A page counts again when it was loaded
    or another stood before it. Equally frequent kinds and pages stand in the order in which they came. Kinds and pages are counted before
    anything is gathered, so a window's block grows with its distinct kinds, not with its events.
    """
    seen = F.min(F.struct("timestamp", "counter")).alias("seen")
    kinds = events.groupBy(*keys, "type_str").agg(F.count("*").alias("n"), seen, F.max("timestamp").alias("last"))
    told = lambda n, name, more: F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("order"), "seen", name, *more)))
    head = kinds.groupBy(*keys).agg(F.min("seen.timestamp").alias("first"), F.max("last").alias("last"), F.sum("n").alias("events"), told("n", "type_str", ("n",)).alias("kinds"))
    order = Window.partitionBy(*keys).orderBy("timestamp", "counter")
    before = F.lag("url").over(order)
    came = arrivals.withColumn("came", F.col("loads") | before.isNull() | (F.col("url") != before))
    pages = came.groupBy(*keys, "url").agg(F.count_if("came").alias("n"), F.min(F.when(F.col("came"), F.struct("timestamp", "counter"))).alias("seen"), F.count("*").alias("rows"))
    pages = pages.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("n").alias("total"), F.count("*").alias("unique"), F.slice(told("n", "url", ("n",)), 1, TOP_PAGES).alias("pages")).where("rows > 1")
    tenths = F.expr("(last - first + 50) div 100")
    n_of = lambda c: c.cast("string")
    several = lambda n, text: F.when(n > 1, F.concat(F.lit(" ("), n_of(n), F.lit(f" {text})"))).otherwise("")
    visited = F.when(F.col("unique") == 1, F.concat(F.lit("Pages Visited: 1"), several(F.col("total"), "arrivals"))).otherwise(
        F.concat(F.lit("Pages Visited: "), n_of(F.col("unique")), F.lit(" unique ("), n_of(F.col("total")), F.lit(" total arrivals)"))
    )
    lines = F.transform("pages", lambda p: F.concat(F.lit("  - "), X.page_address(p["url"]), several(p["n"], "arrivals")))
    rest = F.when(F.col("unique") > TOP_PAGES, F.concat(F.lit("  ... and "), n_of(F.col("unique") - TOP_PAGES), F.lit(" more")))
    block = F.concat_ws(
        "\n",
        F.lit("<SUMMARY>"),
        F.concat(F.lit("Date Range: "), X.utc_stamp("first"), F.lit(" – "), X.utc_stamp("last")),
        F.concat(F.lit("Recording: "), n_of(F.col("events")), F.lit(" events over "), n_of(F.floor(tenths / 10).cast("long")), F.lit("."), n_of(tenths % 10), F.lit(" seconds")),
        F.concat(F.lit("Event Types: "), F.array_join(F.transform("kinds", lambda k: F.concat(k["type_str"], F.lit(" ("), n_of(k["n"]), F.lit(")"))), ", ")),
        F.when(F.col("pages").isNotNull(), visited),
        F.when(F.col("pages").isNotNull(), F.array_join(lines, "\n")),
        F.when(F.col("pages").isNotNull(), rest),
        F.lit("</SUMMARY>"),
    )
    return head.join(pages, list(keys), "left").select(*keys, block.alias("facts"))


# ------------------------------------------------------------------ screenshots and requests
NAME = r"^(.+)_(activity|pulled)_screenshot_(\d+)\.png$"


def screenshot_index(files: DataFrame) -> DataFrame:
    """Of ``files(path)`` the one to show for each label and moment: a pulled one before an activity one."""
    name = F.substring_index("path", "/", -1)
    rows = files.select("path", *(F.regexp_extract(name, NAME, k).alias(c) for k, c in ((1, "label"), (2, "kind"), (3, "ts")))).where("label <> ''")
    return rows.groupBy("label", F.col("ts").cast("long").alias("ts")).agg(F.max_by("path", F.struct(F.col("kind") == "pulled", "path")).alias("path"))


def requested(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Moments asked for, ``requests(window, label, offset_ms)``: each once, in order, with the moment shown or the defect.

    A bare label stands for a window's only slice; one ahead of the slice's snapshot is served at the snapshot.
    """
    own = table.where("reason is null")
    all_ = own.groupBy("window").agg(F.count("*").alias("slices"), F.min("start_ts").alias("origin"), F.min("label").alias("only"))
    rows = requests.join(all_, "window").withColumn("wanted", F.coalesce("label", F.when(F.col("slices") == 1, F.col("only"))))
    rows = rows.join(own.select("window", F.col("label").alias("wanted"), "start_ts", "end_ts", "screenshot_start_ts"), ["window", "wanted"], "left")
    at = F.col("origin") + F.col("offset_ms")
    defect = (
        F.when(F.col("offset_ms").isNull(), "no whole number")
        .when(F.col("label").isNull() & (F.col("slices") > 1), "no label")
        .when(F.col("label").isNotNull() & (F.col("slices") == 1), "a label for the only slice")
        .when(F.col("start_ts").isNull(), "unknown label")
        .when(F.col("offset_ms") < 0, "negative")
        .when(~at.between(F.col("start_ts"), F.col("end_ts")), "out of bounds")
    )
    rows = rows.select("window", F.col("wanted").alias("label"), "offset_ms", defect.alias("defect"), F.greatest(at, "screenshot_start_ts").alias("shown"))
    return rows.select("window", "label", "offset_ms", "defect", F.when(F.col("defect").isNull(), F.col("shown")).alias("ts")).dropDuplicates(["window", "label", "offset_ms"])
