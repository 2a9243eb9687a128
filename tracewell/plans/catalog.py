"""The catalogue of queries over the driver's tables, and SQL for each that SQL can express.

The events table plays the flat act table: kinds by ``event_type``, sites by user, and one slice a visitor and half-day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import exprs as X
from tracewell.operators import books, pages, sessions, slices, spans, stream
from tracewell.schema import SessionRule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HALF_DAY = 43_200_000
HOURS_12 = SessionRule(gap_ms=12 * 3_600_000)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KINDS = {"view": "PageLoad", "click": "Click", "signup": "Input", "purchase": "Selection", "error": "Mutation"}


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.try_element_at(F.create_map(*(F.lit(x) for p in KINDS.items() for x in p)), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("visitor_id"),
        ms.alias("timestamp"),
        F.lpad(F.col("event_id").cast("string"), 19, "0").alias("counter"),
        kind.alias("type_str"),
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("snippet"),
        (F.col("user_id") % 50 == 0).cast("int").alias("internal"),
        F.concat(F.lit("h"), F.floor(ms / HALF_DAY).cast("string")).alias("recorder_slice"),
        F.when(F.col("event_type").isin("view", "signup"), F.concat(F.lit("https://a.test/p"), (k % 10).cast("string"))).alias("url"),
        (k % 5).alias("node_id"),
        k.alias("k"),
        F.round("value", 4).alias("value"),
    )


ACTS = """acts AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS visitor_id, (epoch_us(ts) // 1000) AS timestamp, lpad(CAST(event_id AS VARCHAR), 19, '0') AS counter,
  CASE event_type WHEN 'view' THEN 'PageLoad' WHEN 'click' THEN 'Click' WHEN 'signup' THEN 'Input' WHEN 'purchase' THEN 'Selection' WHEN 'error' THEN 'Mutation' END AS type_str,
  's' || CAST(user_id % 3 AS VARCHAR) AS snippet, CAST(user_id % 50 = 0 AS INTEGER) AS internal, 'h' || CAST((epoch_us(ts) // 1000) // 43200000 AS VARCHAR) AS recorder_slice,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS node_id,
  CASE WHEN event_type IN ('view', 'signup') THEN 'https://a.test/p' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) END AS url, round(value, 4) AS value FROM events)"""


def user_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acts(spark, sf_dir).where(X.is_activity("type_str", F.lit(None).cast("string")))


def _runs(gap: int, where: str = "type_str <> 'Mutation'") -> str:
    return f"""{ACTS}, g AS (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY visitor_id, snippet ORDER BY timestamp, counter) AS gap FROM acts WHERE {where}),
 r AS (SELECT *, sum(CASE WHEN gap > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY visitor_id, snippet ORDER BY timestamp, counter) AS run FROM g),
 s AS (SELECT visitor_id, snippet, run, min(timestamp) AS start_ts, max(timestamp) AS end_ts, max(timestamp) - min(timestamp) AS duration_ms,
  CAST(count(*) FILTER (WHERE type_str = 'PageLoad') AS BIGINT) AS pageviews, CAST(sum(CASE WHEN gap <= 10000 AND gap <= {gap} THEN gap ELSE 0 END) AS BIGINT) AS user_activity_ms, count(*) AS acts
  FROM r GROUP BY ALL), t AS (SELECT *, CAST(duration_ms > 10000 OR pageviews >= 2 AS INTEGER) AS engaged FROM s)"""


GAP, GAP12 = 30 * 60 * 1000, 12 * 3_600_000
_COLUMNS = ("visitor_id", "snippet", "start_ts", "end_ts", "duration_ms", "pageviews", "user_activity_ms", "acts", "engaged")
_LIST = ", ".join(_COLUMNS)


@query(f"WITH {_runs(GAP)} SELECT {_LIST} FROM t")
def session_summary(spark, sf_dir):
    return sessions.sessions(user_acts(spark, sf_dir)).select(*_COLUMNS)


@query(f"WITH {_runs(GAP12)} SELECT {_LIST} FROM t")
def session_gap_12h(spark, sf_dir):
    return sessions.sessions(user_acts(spark, sf_dir), HOURS_12).select(*_COLUMNS)


@query(f"WITH {_runs(GAP12)} SELECT snippet, count(*) AS sessions, CAST(sum(engaged) AS BIGINT) AS engaged, round(1 - avg(engaged), 6) AS bounce_rate, CAST(sum(pageviews) AS BIGINT) AS pageviews FROM t GROUP BY snippet")
def session_engaged_by_site(spark, sf_dir):
    return sessions.engagement_by_site(sessions.sessions(user_acts(spark, sf_dir), HOURS_12))


@query(f"WITH {_runs(GAP12)} SELECT count(*) AS sessions, round(1 - avg(engaged), 6) AS bounce_rate FROM t WHERE visitor_id NOT IN (SELECT visitor_id FROM acts WHERE internal = 1)")
def bounce_rate(spark, sf_dir):
    a = user_acts(spark, sf_dir)
    outside = a.join(a.where("internal = 1").select("visitor_id").distinct(), "visitor_id", "left_anti")
    return sessions.sessions(outside, HOURS_12).agg(F.count("*").alias("sessions"), F.round(1 - F.avg("engaged"), 6).alias("bounce_rate"))


_STAMP = f"""WITH {_runs(GAP12)}, h AS (SELECT *, end_ts + {GAP12} AS high, greatest(start_ts - {GAP12}, coalesce(lag(end_ts + {GAP12} + 1) OVER (PARTITION BY visitor_id, snippet ORDER BY start_ts), start_ts - {GAP12})) AS low FROM s)
 SELECT a.id, h.start_ts AS session_start FROM acts a LEFT JOIN h ON a.visitor_id = h.visitor_id AND a.snippet IS NOT DISTINCT FROM h.snippet AND a.timestamp BETWEEN h.low AND h.high"""


@query(_STAMP)
def session_stamp(spark, sf_dir):
    found = sessions.sessions(user_acts(spark, sf_dir), HOURS_12)
    return sessions.stamped(acts(spark, sf_dir), found, HOURS_12).select("id", "session_start")


@query(_STAMP)
def session_stamp_range_join(spark, sf_dir):
    found = sessions.sessions(user_acts(spark, sf_dir), HOURS_12)
    return sessions.stamped_by_range(acts(spark, sf_dir), found, HOURS_12).select("id", "session_start")


@query(f"WITH {_runs(GAP12)} SELECT visitor_id, snippet, start_ts, end_ts, acts FROM t")
def session_window_builtin(spark, sf_dir):
    return sessions.by_session_window(user_acts(spark, sf_dir), HOURS_12)


@query(f"WITH {ACTS} SELECT id, timestamp FROM acts WHERE type_str <> 'Mutation'")
def user_activity_filter(spark, sf_dir):
    return user_acts(spark, sf_dir).select("id", "timestamp")


@query(f"WITH {ACTS} SELECT type_str, count(*) AS events, arg_min(timestamp, counter) AS first_ts FROM (SELECT * FROM acts ORDER BY timestamp) GROUP BY type_str".replace("arg_min(timestamp, counter)", "min(timestamp)"))
def activity_by_kind(spark, sf_dir):
    return stream.kinds_by_count(acts(spark, sf_dir))


_W = "PARTITION BY visitor_id, recorder_slice ORDER BY timestamp, counter, id"


@query(f"WITH {ACTS} SELECT id, last_value(nullif(url, '') IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS page_url FROM acts")
def page_url_ffill(spark, sf_dir):
    return slices.filled_page_url(acts(spark, sf_dir)).select("id", "page_url")


@query(f"WITH {ACTS} SELECT id, CAST(row_number() OVER (PARTITION BY visitor_id ORDER BY timestamp, counter, id) AS INTEGER) AS ord FROM acts")
def canonical_order(spark, sf_dir):
    return slices.canonical(acts(spark, sf_dir)).select("id", "ord")


@query(f"""WITH {ACTS} SELECT id, visitor_id FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id, sha256(type_str || '|' || CAST(k AS VARCHAR)) ORDER BY id) AS rn FROM acts) d
 WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM acts h WHERE h.id % 10 = 0 AND h.visitor_id = d.visitor_id AND h.type_str = d.type_str AND h.k = d.k)""")
def dedup_first_writer(spark, sf_dir):
    a = acts(spark, sf_dir).withColumn("content_hash", F.sha2(F.concat_ws("|", "type_str", F.col("k").cast("string")), 256)).withColumn("arrival", F.col("id"))
    return books.first_writers(a, a.where("id % 10 = 0")).select("id", "visitor_id")


_SLICES = f"{ACTS}, sl AS (SELECT visitor_id, recorder_slice, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n_events FROM acts GROUP BY ALL)"


def _slices(spark, sf_dir) -> DataFrame:
    return slices.summaries(acts(spark, sf_dir))


@query(f"WITH {_SLICES} SELECT * FROM sl")
def slice_summary(spark, sf_dir):
    return _slices(spark, sf_dir)


@query(f"WITH {ACTS} SELECT visitor_id, recorder_slice, arg_min(url, (timestamp, counter, id)) FILTER (WHERE url IS NOT NULL) AS url FROM acts GROUP BY ALL")
def slice_facts_first_nonnull(spark, sf_dir):
    return slices.summaries(acts(spark, sf_dir), ("url",)).select("visitor_id", "recorder_slice", "url")


@query(f"""WITH {ACTS}, p AS (SELECT *, lead(type_str) OVER ({_W}) AS nt, lead(timestamp) OVER ({_W}) AS snapshot_ts, row_number() OVER ({_W}) AS rn FROM acts),
 q AS (SELECT *, row_number() OVER (PARTITION BY visitor_id, recorder_slice ORDER BY rn) AS f FROM p WHERE type_str = 'PageLoad' AND nt = 'Click') SELECT visitor_id, recorder_slice, timestamp AS meta_ts, snapshot_ts FROM q WHERE f = 1""")
def covering_pair(spark, sf_dir):
    kind = F.when(F.col("type_str") == "PageLoad", slices.META).when(F.col("type_str") == "Click", slices.SNAPSHOT).otherwise(3)
    return slices.covering_pairs(acts(spark, sf_dir).withColumn("type", kind))


@query(f"""WITH {_SLICES} SELECT a.visitor_id, a.recorder_slice, a.start_ts, (SELECT arg_max(b.recorder_slice, (b.start_ts, b.recorder_slice)) FROM sl b WHERE b.visitor_id = a.visitor_id AND b.start_ts < a.start_ts) AS prior_slice,
 (SELECT max(b.start_ts) FROM sl b WHERE b.visitor_id = a.visitor_id AND b.start_ts < a.start_ts) AS prior_start FROM sl a""")
def prior_slice_asof(spark, sf_dir):
    return slices.prior_slices(_slices(spark, sf_dir))


@query(f"WITH {ACTS} SELECT id, last_value(CASE WHEN k > 50 THEN k END IGNORE NULLS) OVER (PARTITION BY visitor_id ORDER BY timestamp, counter, id ROWS UNBOUNDED PRECEDING) AS width FROM acts")
def viewport_asof(spark, sf_dir):
    return slices.last_known(acts(spark, sf_dir), F.when(F.col("k") > 50, F.col("k")), "width", ("visitor_id",)).select("id", "width")


@query(f"WITH {ACTS} SELECT id FROM acts a WHERE NOT EXISTS (SELECT 1 FROM acts m WHERE m.k % 2 = 0 AND m.id = a.id AND m.visitor_id = a.visitor_id)")
def manifest_antijoin(spark, sf_dir):
    a = acts(spark, sf_dir).withColumnRenamed("visitor_id", "etag").withColumn("key", F.col("id"))
    return books.unloaded(a, a.where("k % 2 = 0")).select("id")


@query(f"WITH {_runs(GAP12)} SELECT visitor_id, snippet, start_ts FROM t WHERE visitor_id IN (SELECT visitor_id FROM acts WHERE k = 7)")
def user_semijoin(spark, sf_dir):
    named = acts(spark, sf_dir).withColumn("user_id", F.when(F.col("k") == 7, "u7"))
    return sessions.of_user(sessions.sessions(user_acts(spark, sf_dir), HOURS_12), named, "u7").select("visitor_id", "snippet", "start_ts")


@query(f"WITH {_SLICES} SELECT visitor_id, start_ts AS timestamp FROM sl WHERE NOT EXISTS (SELECT 1 FROM acts a WHERE a.visitor_id = sl.visitor_id AND a.recorder_slice = sl.recorder_slice AND a.type_str = 'PageLoad')")
def heads_without_pageload(spark, sf_dir):
    a = acts(spark, sf_dir)
    return sessions.head_acts(slices.summaries(a, ("snippet",)), a).select("visitor_id", "timestamp")


_WIDE = f"{_SLICES}, wide AS (SELECT visitor_id, recorder_slice, start_ts, end_ts + 86400000 AS end_ts FROM sl)"


def _wide(spark, sf_dir) -> DataFrame:
    return _slices(spark, sf_dir).withColumn("end_ts", F.col("end_ts") + 86_400_000)


@query(f"WITH {_WIDE} SELECT visitor_id, recorder_slice, EXISTS (SELECT 1 FROM wide b WHERE b.visitor_id = a.visitor_id AND b.recorder_slice <> a.recorder_slice AND a.start_ts <= b.end_ts AND b.start_ts <= a.end_ts) AS concurrent FROM wide a")
def overlap_concurrent(spark, sf_dir):
    return slices.overlapping(_wide(spark, sf_dir)).select("visitor_id", "recorder_slice", "concurrent")


@query(f"WITH {ACTS} SELECT visitor_id FROM acts WHERE k % 97 = 0 UNION SELECT visitor_id FROM acts WHERE k % 89 = 0 UNION SELECT visitor_id FROM acts GROUP BY visitor_id, recorder_slice HAVING max(k) < 3")
def not_current_union(spark, sf_dir):
    a = acts(spark, sf_dir).withColumn("slice_id", F.when(F.col("k") % 97 != 0, F.col("id"))).withColumn("type_str", F.when(F.col("k") % 89 != 0, F.col("type_str")))
    return slices.not_current(a.where("slice_id is null or type_str is null or k >= 3"), acts(spark, sf_dir).select("visitor_id", "recorder_slice").distinct())


_STATUS = f"{_SLICES}, st AS (SELECT *, CASE WHEN n_events >= 2 THEN 'replayable' WHEN start_ts % 3 = 0 THEN 'rescued' ELSE 'discarded' END AS status FROM sl)"


def _status(spark, sf_dir) -> DataFrame:
    return _slices(spark, sf_dir).withColumn("status", F.when(F.col("n_events") >= 2, "replayable").when(F.col("start_ts") % 3 == 0, "rescued").otherwise("discarded"))


@query(f"""WITH {_STATUS} SELECT count(*) AS events, count(*) FILTER (WHERE status = 'replayable') AS analyzable, count(*) FILTER (WHERE status <> 'replayable') AS dropped, count(*) FILTER (WHERE status IS NULL) AS unplaced
 FROM acts LEFT JOIN st USING (visitor_id, recorder_slice)""")
def status_reconcile(spark, sf_dir):
    return books.reconciled(acts(spark, sf_dir), _status(spark, sf_dir))


@query(f"WITH {_STATUS} SELECT status, count(*) AS slices, CAST(sum(n_events) AS BIGINT) AS events FROM st GROUP BY status")
def events_by_status(spark, sf_dir):
    return books.by_status(_status(spark, sf_dir))


_CUT = "2024-06-01"
_INV = f"""{ACTS}, o AS (SELECT snippet, strftime(to_timestamp(timestamp // 1000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, visitor_id, recorder_slice, k AS bytes, timestamp AS uploaded_ms FROM acts),
 inv AS (SELECT snippet, visitor_id, recorder_slice, date, count(*) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes, min(uploaded_ms) AS first_upload_ms, max(uploaded_ms) AS last_upload_ms,
 (SELECT count(*) > 0 FROM acts h WHERE h.id % 4 = 0 AND h.visitor_id = o.visitor_id AND h.recorder_slice = o.recorder_slice) AS loaded, date < '{_CUT}' AS expired FROM o GROUP BY ALL)"""


def _inventory(spark, sf_dir) -> DataFrame:
    a = acts(spark, sf_dir)
    o = a.select("snippet", X.utc_day("timestamp").alias("date"), "visitor_id", "recorder_slice", F.col("k").alias("bytes"), F.col("timestamp").alias("uploaded_ms"), F.lit(False).alias("foreign"))
    return books.inventory(o, a.where("id % 4 = 0"), _CUT)


@query(f"WITH {_INV} SELECT * FROM inv".replace("(SELECT count(*) > 0 FROM acts h WHERE h.id % 4 = 0 AND h.visitor_id = o.visitor_id AND h.recorder_slice = o.recorder_slice)", "(o.visitor_id, o.recorder_slice) IN (SELECT (visitor_id, recorder_slice) FROM acts WHERE id % 4 = 0)"))
def inventory_fold(spark, sf_dir):
    return _inventory(spark, sf_dir)


@query(f"""WITH {_INV} SELECT count(DISTINCT visitor_id) AS visitors, count(*) AS slices, count(*) FILTER (WHERE NOT loaded AND NOT expired) AS new, count(*) FILTER (WHERE expired) AS expired, CAST(sum(chunks) AS BIGINT) AS chunks,
 CAST(sum(bytes) AS BIGINT) AS bytes, min(first_upload_ms) AS first_upload_ms, max(last_upload_ms) AS last_upload_ms FROM inv""".replace("(SELECT count(*) > 0 FROM acts h WHERE h.id % 4 = 0 AND h.visitor_id = o.visitor_id AND h.recorder_slice = o.recorder_slice)", "(o.visitor_id, o.recorder_slice) IN (SELECT (visitor_id, recorder_slice) FROM acts WHERE id % 4 = 0)"))
def inventory_totals(spark, sf_dir):
    return books.inventory_totals(_inventory(spark, sf_dir))


_DAY = "strftime(to_timestamp(start_ts // 1000) AT TIME ZONE 'UTC', '%Y-%m-%d')"


@query(f"WITH {_SLICES} SELECT visitor_id, recorder_slice FROM sl WHERE {_DAY} < '{_CUT}'")
def retention_expired(spark, sf_dir):
    return _slices(spark, sf_dir).where(X.utc_day("start_ts") < _CUT).select("visitor_id", "recorder_slice")


@query(f"WITH {_SLICES} SELECT visitor_id, recorder_slice FROM sl WHERE {_DAY} >= '{_CUT}'")
def retention_survivors(spark, sf_dir):
    return books.survivors(_slices(spark, sf_dir), F.col("start_ts"), _CUT).select("visitor_id", "recorder_slice")


def _spend(period: str):
    def run(spark, sf_dir):
        return books.spend_by_period(read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("usd")), period)

    run.__name__ = f"spend_by_{period}"
    return query(f"SELECT strftime(date_trunc('{period}', o_orderdate), '%Y-%m-%d') AS period, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,8))) AS DOUBLE), 2) AS usd, count(*) AS calls FROM orders GROUP BY 1")(run)


for _p in ("day", "week", "month"):
    _spend(_p)


@query("SELECT round(coalesce(sum(CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN CAST(o_totalprice AS DECIMAL(18,8)) END), 0), 0)::DOUBLE AS usd, sum(CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN o_totalprice END) >= 1e6 AS refused FROM orders")
def spend_wall(spark, sf_dir):
    ledger = read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("usd"))
    return books.wall(ledger, F.lit("1997-01-01").cast("timestamp_ntz"), 1e6).withColumn("usd", F.round("usd", 0))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity * 3.0 + l_linenumber * 0.3 + (l_quantity + l_linenumber) * 15.0) / 1000000, 8) AS usd FROM lineitem")
def call_cost(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.call_cost(q, n, q, n, 3.0, 0.3, 15.0).alias("usd"))


@query(f"WITH {ACTS} SELECT type_str, CAST(sum(k) AS BIGINT) AS events, max(k) AS coarsest, max(timestamp) AS latest FROM acts GROUP BY type_str")
def ae_weighted_count(spark, sf_dir):
    return books.rates(acts(spark, sf_dir).withColumn("_sample_interval", F.col("k")), "type_str")


@query(f"WITH {ACTS} SELECT max(timestamp) AS latest FROM acts")
def ae_latest(spark, sf_dir):
    return acts(spark, sf_dir).agg(F.max("timestamp").alias("latest"))


@query(f"WITH {ACTS}, m AS (SELECT visitor_id, recorder_slice, snippet, max(k) AS k FROM acts GROUP BY ALL) SELECT snippet, CAST(sum(k) AS BIGINT) AS k FROM m GROUP BY snippet")
def cost_running_max(spark, sf_dir):
    return books.running_totals(acts(spark, sf_dir), "visitor_id", "recorder_slice", "snippet", value="k").groupBy("snippet").agg(F.sum("k").alias("k"))


@query(f"""WITH {_SLICES}, n AS (SELECT a.visitor_id, a.recorder_slice, start_ts, CAST(ceil((greatest(timestamp - CASE WHEN type_str = 'PageLoad' THEN 2000 ELSE 1000 END, start_ts) - start_ts) / 500.0) AS BIGINT) AS lo,
 CAST(floor((least(timestamp + CASE WHEN type_str = 'PageLoad' THEN 2000 ELSE 1000 END, end_ts) - start_ts) / 500.0) AS BIGINT) AS hi FROM acts a JOIN sl USING (visitor_id, recorder_slice) WHERE type_str <> 'Mutation')
 SELECT visitor_id, recorder_slice, start_ts + 500 * i AS mark_ts FROM (SELECT *, unnest(generate_series(lo, hi)) AS i FROM n WHERE lo <= hi) UNION SELECT visitor_id, recorder_slice, start_ts FROM sl UNION SELECT visitor_id, recorder_slice, end_ts FROM sl""")
def screenshot_marks(spark, sf_dir):
    return spans.screenshot_marks(user_acts(spark, sf_dir), _slices(spark, sf_dir).select(*slices.KEYS, "start_ts", "end_ts"), slices.KEYS, 500)


_MERGED = f"""{ACTS}, p AS (SELECT visitor_id, greatest(timestamp - 1800000, 0) AS start_ts, timestamp + 1800000 AS end_ts FROM acts),
 q AS (SELECT *, max(end_ts) OVER (PARTITION BY visitor_id ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
 i AS (SELECT *, sum(CASE WHEN before IS NULL OR start_ts > before THEN 1 ELSE 0 END) OVER (PARTITION BY visitor_id ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS island FROM q),
 mg AS (SELECT visitor_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS spans FROM i GROUP BY visitor_id, island)"""


def _merged(spark, sf_dir) -> DataFrame:
    return spans.merged(acts(spark, sf_dir).select("visitor_id", F.col("timestamp").alias("start_ts"), F.col("timestamp").alias("end_ts")), ("visitor_id",), 1_800_000)


@query(f"WITH {_MERGED} SELECT * FROM mg")
def merge_spans(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(f"WITH {_MERGED} SELECT a.id, m.start_ts AS span_start FROM acts a JOIN mg m ON a.visitor_id = m.visitor_id AND m.spans > 1 AND a.timestamp BETWEEN m.start_ts AND m.end_ts")
def claim_events(spark, sf_dir):
    return spans.inside(acts(spark, sf_dir), _merged(spark, sf_dir).where("spans > 1"), ("visitor_id",)).select("id", "span_start")


@query(f"""WITH {ACTS}, d AS (SELECT c.id AS claim_id, min(abs(c.timestamp - m.timestamp)) AS d FROM acts c LEFT JOIN acts m ON m.visitor_id = c.visitor_id AND m.type_str = 'PageLoad' AND abs(c.timestamp - m.timestamp) <= 3600000 WHERE c.type_str = 'Click' GROUP BY 1)
 SELECT claim_id, d AS distance_ms FROM d""")
def nearest_mark(spark, sf_dir):
    a = acts(spark, sf_dir)
    claims = a.where("type_str = 'Click'").select("visitor_id", "timestamp", F.col("id").alias("claim_id"))
    return spans.nearest_marks(claims, a.where("type_str = 'PageLoad'"), ("visitor_id",), 3_600_000).select("claim_id", "distance_ms")


@query(f"WITH {_SLICES} SELECT visitor_id, recorder_slice, 'S' || CAST(row_number() OVER (PARTITION BY visitor_id ORDER BY start_ts, end_ts, recorder_slice) AS VARCHAR) AS label FROM sl")
def window_labels(spark, sf_dir):
    return spans.labelled(_slices(spark, sf_dir)).select("visitor_id", "recorder_slice", "label")


@query(f"""WITH {ACTS}, b AS (SELECT visitor_id, min(timestamp) AS start_ts, max(timestamp) AS end_ts FROM acts GROUP BY 1), c AS (SELECT a.visitor_id, timestamp, end_ts FROM acts a JOIN b USING (visitor_id) WHERE type_str = 'PageLoad' AND timestamp > start_ts
 UNION SELECT visitor_id, start_ts, end_ts FROM b) SELECT visitor_id, CAST(row_number() OVER (PARTITION BY visitor_id ORDER BY timestamp) AS INTEGER) AS piece, timestamp AS start_ts, coalesce(lead(timestamp) OVER (PARTITION BY visitor_id ORDER BY timestamp), end_ts) AS end_ts FROM c""")
def page_pieces(spark, sf_dir):
    a = acts(spark, sf_dir)
    return spans.page_pieces(a, a.groupBy("visitor_id").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts")), ("visitor_id",))


@query(f"""WITH {ACTS} SELECT id, format('[{{:02d}}:{{:02d}}.{{:03d}}]', o // 60000, (o // 1000) % 60, o % 1000) AS stamp FROM (SELECT id, timestamp - min(timestamp) OVER (PARTITION BY visitor_id) AS o FROM acts)""")
def offset_stamp(spark, sf_dir):
    origin = F.min("timestamp").over(Window.partitionBy("visitor_id"))
    return acts(spark, sf_dir).select("id", X.offset_stamp(F.col("timestamp") - origin).alias("stamp"))


@query(f"WITH {ACTS} SELECT id, coalesce(type_str = 'Selection' AND lead(timestamp) OVER (PARTITION BY visitor_id, type_str ORDER BY timestamp, counter) - timestamp <= 1000, false) AS dropped FROM acts")
def selection_settle(spark, sf_dir):
    return stream.settled_selections(acts(spark, sf_dir)).select("id", "dropped")


@query(f"WITH {ACTS} SELECT id, coalesce(type_str = 'Input' AND lead(timestamp) OVER (PARTITION BY visitor_id, type_str, node_id ORDER BY timestamp, counter) - timestamp <= 50, false) AS dropped FROM acts")
def input_settle(spark, sf_dir):
    return stream.settled_inputs(acts(spark, sf_dir)).select("id", "dropped")


#: Half-days as minutes make the driver's sparse acts dense enough for passes that look at seconds.
_DENSE = f"{ACTS}, dn AS (SELECT * REPLACE (timestamp // 100000 AS timestamp, CASE type_str WHEN 'PageLoad' THEN 'MouseDown' WHEN 'Input' THEN 'Focus' ELSE type_str END AS type_str), k % 3 AS target, k AS x, k AS y FROM acts)"


def _dense(spark, sf_dir) -> DataFrame:
    a = acts(spark, sf_dir)
    kind = F.when(F.col("type_str") == "PageLoad", "MouseDown").when(F.col("type_str") == "Input", "Focus").otherwise(F.col("type_str"))
    return a.withColumns({"timestamp": F.expr("timestamp div 100000"), "type_str": kind, "target": F.col("k") % 3, "x": F.col("k"), "y": F.col("k")})


@query(f"""WITH {_DENSE}, n AS (SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY timestamp, counter) AS rn FROM dn)
 SELECT a.id, a.type_str = 'MouseDown' AND EXISTS (SELECT 1 FROM n b WHERE b.visitor_id = a.visitor_id AND b.rn BETWEEN a.rn + 1 AND a.rn + 5 AND b.type_str = 'Click' AND b.timestamp - a.timestamp <= 1000 AND b.target = a.target AND abs(b.x - a.x) <= 15) AS folded FROM n a""")
def press_click_collapse(spark, sf_dir):
    return stream.folded_presses(_dense(spark, sf_dir)).select("id", "folded")


@query(f"WITH {_DENSE} SELECT a.id, a.type_str = 'Focus' AND EXISTS (SELECT 1 FROM dn b WHERE b.visitor_id = a.visitor_id AND b.type_str IN ('MouseDown', 'Click') AND abs(b.timestamp - a.timestamp) <= 50) AS folded FROM dn a")
def focus_fold(spark, sf_dir):
    return stream.caused_focus(_dense(spark, sf_dir)).select("id", "folded")


@query(f"""WITH {ACTS}, q AS (SELECT *, type_str = 'Mutation' AS quiet, sum(CASE WHEN type_str = 'Mutation' THEN 0 ELSE 1 END) OVER (PARTITION BY visitor_id ORDER BY timestamp, counter) AS island FROM acts)
 SELECT visitor_id, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) AS rows FROM q WHERE quiet GROUP BY visitor_id, island""")
def churn_runs(spark, sf_dir):
    return stream.churn_runs(acts(spark, sf_dir))


@query(f"WITH {ACTS} SELECT id, coalesce(type_str = 'Input' AND lag(node_id) OVER w = node_id, false) AS quiet_target FROM acts WINDOW w AS (PARTITION BY visitor_id, type_str ORDER BY timestamp, counter)")
def target_suppression(spark, sf_dir):
    return stream.repeated_targets(acts(spark, sf_dir).withColumn("target", F.col("node_id"))).select("id", "quiet_target")


_ARRIVED = f"{ACTS}, u AS (SELECT *, lag(url) OVER (PARTITION BY visitor_id ORDER BY timestamp, counter) AS pu FROM acts WHERE url IS NOT NULL), ar AS (SELECT url, count(*) AS arrivals FROM u WHERE type_str = 'PageLoad' OR pu IS NULL OR url <> pu GROUP BY url)"


@query(f"WITH {_ARRIVED} SELECT * FROM ar")
def arrival_counter(spark, sf_dir):
    return stream.arrivals(acts(spark, sf_dir).where("url is not null"))


@query(f"WITH {_ARRIVED} SELECT * FROM ar ORDER BY arrivals DESC, url LIMIT 5")
def top_pages(spark, sf_dir):
    return stream.arrivals(acts(spark, sf_dir).where("url is not null")).orderBy(F.desc("arrivals"), "url").limit(5)


@query()
def lanes(spark, sf_dir):
    return spans.lanes(_wide(spark, sf_dir)).select("visitor_id", "recorder_slice", "lane")


@query(f"""WITH {_WIDE}, o AS (SELECT *, max(end_ts) OVER (PARTITION BY visitor_id ORDER BY start_ts, end_ts, recorder_slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM wide)
 SELECT visitor_id, recorder_slice, CAST(sum(CASE WHEN before > start_ts THEN 1 ELSE 0 END) OVER (PARTITION BY visitor_id ORDER BY start_ts, end_ts, recorder_slice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM o""")
def disjoint_runs(spark, sf_dir):
    return spans.disjoint_runs(_wide(spark, sf_dir)).select("visitor_id", "recorder_slice", "run")


@query("SELECT page_id, regexp_replace(url || '?q=1&r=2#top', '^([^?#]*)\\?[^#]*', '\\1') AS route FROM pages")
def route_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.route_key(F.concat("url", F.lit("?q=1&r=2#top"))).alias("route"))


@query("SELECT page_id, nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1), '') AS host FROM pages")
def url_host(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.url_host("url").alias("host"))


def _shed(cap: int, units: str, kilo: int, size: str, last: str) -> str:
    """SQL for an address that sheds its query beyond a cap. units: of {x}, how it is counted. size: of {n} beyond kilo. last: what becomes of it where even that is too long."""
    u = units.format
    return f"""WITH a AS (SELECT page_id, url, split_part(url, '#', 1) AS base, substr(url, length(split_part(url, '#', 1)) + 1) AS mark FROM pages),
 b AS (SELECT *, substr(base, strpos(base, '?') + 1) AS asked, {u(x="substr(base, strpos(base, '?') + 1)")} AS n FROM a),
 c AS (SELECT *, CASE WHEN strpos(base, '?') = 0 OR asked = '' THEN url ELSE substr(base, 1, strpos(base, '?') - 1) || '?… (' || CASE WHEN n < {kilo} THEN CAST(n AS VARCHAR) || ' chars' ELSE {size.format(n="n")} || 'kB' END || ' query)' || mark END AS shed FROM b)
 SELECT page_id, CASE WHEN {u(x="url")} <= {cap} THEN url WHEN {u(x="shed")} <= {cap} THEN shed ELSE {last} END AS described FROM c"""


@query(_shed(40, "length({x})", 1000, "CAST(round({n} / 1000.0, 1) AS VARCHAR)", "substr(shed, 1, 39) || '…'"))
def describe_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.describe_url("url", 40).alias("described"))


#: Letters outside the first plane count twice. Where even the shed form is too long the address is cut, and its length in letters then is at most the cap.
@query(_shed(2000, "(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))", 1024, "CAST(CAST(round_even({n} / 1024.0, 0) AS BIGINT) AS VARCHAR)", "substr(url, 1, 1999) || '…'"))
def page_addresses(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.page_address("url").alias("described"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed FROM documents")
def collapse_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.collapse("text"), 256).alias("collapsed"))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 79) || '…' END AS cut, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || ' (first 200 of ' || CAST(length(text) AS VARCHAR) || ' chars)' END AS noted FROM documents")
def truncate_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.truncate("text", 80).alias("cut"), X.cut_note("text", 200).alias("noted"))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS escaped FROM documents")
def escape_values(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.escape_value("text"), 256).alias("escaped"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def ledger_json_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT n_name, count(*) AS orders, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def tpch_joins(spark, sf_dir):
    t = lambda name: read(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'")
    revenue = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double")
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(revenue, 2).alias("revenue"))


@query("SELECT o_custkey AS custkey FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def tpch_setops(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.where("o_totalprice > 100000").select(F.col("o_custkey").alias("custkey")).subtract(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def tpch_rollup(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double"), 2).alias("qty"))


@query("SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def tpch_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).where("rn <= 3")


@query("""WITH f AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations), i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
 SELECT conv_id, role, CAST(min(turn) AS BIGINT) AS first_turn, count(*) AS turns FROM i GROUP BY conv_id, role, run""")
def conversation_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    f = read(spark, sf_dir, "conversations").withColumn("new", (~F.col("role").eqNullSafe(F.lag("role").over(w))).cast("int"))
    runs = f.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("conv_id", "role", "run").agg(F.min("turn").cast("long").alias("first_turn"), F.count("*").alias("turns")).drop("run")


@query(f"WITH {ACTS} SELECT coalesce(bool_and(k = 0 AND value = 0), true) AS nothing FROM acts")
def zero_shaped_acts(spark, sf_dir):
    return books.means_nothing(acts(spark, sf_dir).select("k", "value"))


@query(f"""WITH {ACTS}, a AS (SELECT snippet, visitor_id, recorder_slice, count(*) AS births FROM acts WHERE type_str = 'PageLoad' GROUP BY ALL), b AS (SELECT snippet, visitor_id, recorder_slice, count(*) AS arrivals FROM acts WHERE type_str = 'Click' GROUP BY ALL)
 SELECT snippet, visitor_id, recorder_slice, births, arrivals FROM a FULL JOIN b USING (snippet, visitor_id, recorder_slice)""")
def births_and_arrivals(spark, sf_dir):
    keys, a = ["snippet", "visitor_id", "recorder_slice"], acts(spark, sf_dir)
    births = a.where("type_str = 'PageLoad'").groupBy(*keys).agg(F.count("*").alias("births"))
    return births.join(a.where("type_str = 'Click'").groupBy(*keys).agg(F.count("*").alias("arrivals")), keys, "full_outer")


@query(f"WITH {ACTS} SELECT id, CASE WHEN k * 40 < 1 THEN 'seconds' WHEN k * 40 < 60 THEN format('{{}}s', k * 40) WHEN k * 40 < 3600 THEN format('{{}}m{{:02d}}s', k * 40 // 60, k * 40 % 60) ELSE format('{{}}h{{:02d}}m', k * 40 // 3600, k * 40 // 60 % 60) END AS lasted FROM acts")
def coarse_duration(spark, sf_dir):
    return acts(spark, sf_dir).select("id", X.coarse_duration(F.col("k") * 40_000).alias("lasted"))


@query("SELECT user_id % 3 AS site, count(*) FILTER (WHERE event_type = 'view') AS views, max(CASE WHEN event_type = 'purchase' THEN round(value, 4) END) AS best FROM events GROUP BY 1")
def adhoc_sql(spark, sf_dir):
    read(spark, sf_dir, "events").createOrReplaceTempView("tracewell_events")
    return spark.sql("SELECT user_id % 3 AS site, count_if(event_type = 'view') AS views, max(CASE WHEN event_type = 'purchase' THEN round(value, 4) END) AS best FROM tracewell_events GROUP BY 1")


@query("SELECT page_id, sha256(" + pages.rules_sql("html") + ") AS markdown FROM pages")
def page_markdown(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(pages.markdown("html"), 256).alias("markdown"))


@query("WITH md AS (SELECT page_id, url, " + pages.rules_sql("html") + """ AS md FROM pages), v AS (SELECT page_id, md, lag(md) OVER (PARTITION BY nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1), '') ORDER BY page_id) AS before FROM md),
 l AS (SELECT page_id, unnest(string_split(coalesce(md, ''), chr(10))) AS line, 1 AS n FROM v UNION ALL SELECT page_id, unnest(string_split(coalesce(before, ''), chr(10))) AS line, -1 AS n FROM v)
 SELECT page_id, line, CAST(sum(n) AS BIGINT) AS change FROM l GROUP BY page_id, line HAVING sum(n) <> 0""")
def page_changes(spark, sf_dir):
    md = read(spark, sf_dir, "pages").select("page_id", "url", pages.markdown("html").alias("md"))
    w = Window.partitionBy(X.url_host("url")).orderBy("page_id")
    return pages.line_changes(md.withColumn("before", F.lag("md").over(w)), "page_id", "before", "md")


@query(f"""WITH {ACTS}, z AS (SELECT visitor_id, counter, k, sum(k) OVER (PARTITION BY visitor_id ORDER BY counter) AS c FROM acts) SELECT visitor_id, counter FROM z WHERE c <= 500""")
def prefix_that_fits(spark, sf_dir):
    w = Window.partitionBy("visitor_id").orderBy("counter")
    return acts(spark, sf_dir).withColumn("c", F.sum("k").over(w)).where("c <= 500").select("visitor_id", "counter")


@query()
def greedy_batches(spark, sf_dir):
    return spans.greedy_groups(acts(spark, sf_dir).select("visitor_id", "counter", "k"), ("visitor_id",), ("counter",), "k", 300)
