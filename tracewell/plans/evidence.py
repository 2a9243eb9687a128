"""More of the catalogue: flat rows, telemetry, evidence windows, side tables and text helpers, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import exprs as X
from tracewell.functions import tables
from tracewell.operators import books, diffs, dom, flat, pages, slices, spans, stream, telemetry, windows
from tracewell.plans.catalog import _SLICES, _STATUS, ACTS, SQL, _slices, _status, acts, query, read

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _raw(spark, sf_dir):
    """The driver's events as raw ones: metas, clicks with a bad y, inputs, batches of moves, and names of visitors."""
    e = read(spark, sf_dir, "events")
    k, v = F.get_json_object("props", "$.k").cast("long"), F.round("value", 4)
    data = {
        "view": F.to_json(F.struct(F.concat(F.lit("https://a.test/p"), (k % 10).cast("string")).alias("href"), k.alias("width"), F.lit(5).alias("height"))),
        "click": F.to_json(F.struct(F.lit(2).alias("source"), F.lit(2).alias("type"), k.alias("id"), v.alias("x"), F.lit("far").alias("y"), (k % 3).alias("pointerType"))),
        "signup": F.to_json(F.struct(F.lit(5).alias("source"), k.alias("id"), F.repeat(F.lit("ab"), k.cast("int") * 200).alias("text"), F.lit(False).alias("isChecked"), F.lit(True).alias("userTriggered"))),
        "purchase": F.to_json(F.struct(F.lit(1).alias("source"), F.array(F.struct(F.lit(1.5).alias("x"), F.lit(2.0).alias("y")), F.struct(k.cast("double").alias("x"), F.lit(-0.5).alias("y"))).alias("positions"))),
        "error": F.to_json(F.struct(F.concat(F.lit("u"), k.cast("string")).alias("userId"), F.array(k).alias("list"))),
    }
    types = {"view": 4, "error": 72}
    body = F.lit(None).cast("string")
    for name, text in data.items():
        body = F.when(F.col("event_type") == name, F.concat(F.lit(f'{{"type":{types.get(name, 3)},"timestamp":1,"data":'), text, F.lit("}"))).otherwise(body)
    return e.select(F.col("event_id").alias("id"), body.alias("raw"))


@query(f"""WITH e AS (SELECT event_id AS id, event_type AS t, {_K} AS k, round(value, 4) AS v FROM events)
 SELECT id, CASE t WHEN 'view' THEN 'Meta' WHEN 'click' THEN 'Click' WHEN 'signup' THEN 'Input' WHEN 'purchase' THEN 'MouseMove' WHEN 'error' THEN 'Identify' END AS type_str,
 CASE WHEN t = 'view' THEN 'https://a.test/p' || CAST(k % 10 AS VARCHAR) END AS url, CASE WHEN t = 'error' THEN 'u' || CAST(k AS VARCHAR) END AS user_id,
 CASE t WHEN 'click' THEN CAST(floor(v + 0.5) AS BIGINT) WHEN 'purchase' THEN k END AS x, CASE t WHEN 'purchase' THEN 0 END AS y,
 CASE WHEN t = 'click' THEN CASE k % 3 WHEN 0 THEN 'Mouse' WHEN 1 THEN 'Pen' ELSE 'Touch' END END AS pointer_type,
 CASE WHEN t = 'signup' THEN CASE WHEN 400 * k <= 20000 THEN repeat('ab', 200 * CAST(k AS INTEGER)) ELSE substr(repeat('ab', 200 * CAST(k AS INTEGER)), 1, 19999) || '…' END END AS input,
 CASE t WHEN 'view' THEN '{{"width":' || CAST(k AS VARCHAR) || ',"height":5}}' WHEN 'signup' THEN '{{"userTriggered":true' || CASE WHEN 400 * k > 20000 THEN ',"input_chars":' || CAST(400 * k AS VARCHAR) ELSE '' END || '}}' END AS extra,
 CAST(t = 'click' AS INTEGER) AS wrong_typed FROM e""")
def flatten_events(spark, sf_dir):
    return flat.flattened(_raw(spark, sf_dir)).select("id", "type_str", "url", "user_id", "x", "y", "pointer_type", "input", "extra", "wrong_typed")


@query("SELECT count(*) AS events, count(*) FILTER (WHERE event_type = 'click') AS wrong_typed, CAST(0 AS BIGINT) AS unknown_kinds FROM events")
def flatten_residue(spark, sf_dir):
    return flat.residue(flat.flattened(_raw(spark, sf_dir)))


_PINGS = f"""e AS (SELECT event_id AS id, event_type AS t, {_K} AS k, user_id, lpad(CAST({_K} AS VARCHAR), 14, '1') || '-ab12' AS s FROM events)"""


@query(f"""WITH {_PINGS} SELECT id, CASE t WHEN 'view' THEN 'page_load' WHEN 'click' THEN 'cost_sample' WHEN 'signup' THEN 'slice_started' WHEN 'purchase' THEN 'capture_gated' ELSE 'nonsense' END AS metric,
 CASE t WHEN 'view' THEN array_to_string(['page_load', 'v' || CAST(user_id AS VARCHAR), s, '', '', '', '', 'https://a.test/' || CAST(k AS VARCHAR), '', '0'], '|') WHEN 'click' THEN array_to_string(['cost_sample', 'v' || CAST(user_id AS VARCHAR), '', '', '', '', ''], '|')
 WHEN 'purchase' THEN array_to_string(['capture_gated', 'v' || CAST(user_id AS VARCHAR), '', '', '', '', '', 'bot', 'https://a.test/', ''], '|') END AS blobs,
 CASE t WHEN 'view' THEN '-1' WHEN 'click' THEN array_to_string([CAST(k AS VARCHAR), '7', '-1', '-1', '-1', '-1', '-1', '-1'], '|') WHEN 'purchase' THEN '-1' END AS doubles,
 CASE t WHEN 'signup' THEN 'first_slice' WHEN 'error' THEN 'unknown metric' END AS reason FROM e""")
def ping_points(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    s = F.concat(F.lpad(F.col("k").cast("string"), 14, "1"), F.lit("-ab12"))
    pings = {
        "view": F.struct(F.lit("page_load").alias("metric"), s.alias("sliceId"), F.concat(F.lit("https://a.test/"), F.col("k").cast("string")).alias("url"), F.lit("").alias("referrer"), F.lit(False).alias("spaRoute")),
        "click": F.struct(F.lit("cost_sample").alias("metric"), F.lit(None).cast("string").alias("sliceId"), F.col("k").alias("mainThreadMs"), F.lit(7).alias("uploadBytes")),
        "signup": F.struct(F.lit("slice_started").alias("metric"), s.alias("sliceId"), F.lit("https://a.test/").alias("url"), F.lit("yes").alias("first_slice")),
        "purchase": F.struct(F.lit("capture_gated").alias("metric"), F.lit("bot").alias("reason"), F.lit("https://a.test/").alias("url")),
        "error": F.struct(F.lit("nonsense").alias("metric")),
    }
    ping = F.lit(None).cast("string")
    for name, body in pings.items():
        ping = F.when(F.col("event_type") == name, F.to_json(body, {"ignoreNullFields": "false"})).otherwise(ping)
    rows = e.select(F.col("event_id").alias("id"), ping.alias("ping"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("visitor_id"), F.lit("abc").alias("snippet"), *(F.lit("").alias(c) for c in ("origin", "user_agent", "as_organization")))
    doubles = F.array_join(F.transform("doubles", lambda d: F.format_string("%.0f", d)), "|")
    return telemetry.points(rows).select("id", "metric", F.array_join("blobs", "|").alias("blobs"), doubles.alias("doubles"), "reason")


@query()
def blob_budget(spark, sf_dir):
    cut = telemetry.fitted(F.array(F.lit("head"), F.coalesce("text", F.lit("")), F.lit("tail")))
    return read(spark, sf_dir, "documents").select("doc_id", F.transform(cut, lambda x: F.octet_length(x)).alias("bytes"), F.sha2(F.array_join(cut, "|"), 256).alias("kept"))


# ------------------------------------------------------------------ windows
_TABLE = f"""{_STATUS}, tb AS (SELECT visitor_id AS "window", visitor_id, recorder_slice, start_ts, end_ts, snippet, CASE WHEN status <> 'replayable' THEN 'not replayable' END AS reason, start_ts AS screenshot_start_ts
 FROM st JOIN (SELECT DISTINCT visitor_id, snippet FROM acts) USING (visitor_id)), lb AS (SELECT *, CASE WHEN reason IS NULL THEN 'S' || CAST(row_number() OVER (PARTITION BY "window", reason IS NULL ORDER BY start_ts, end_ts, recorder_slice) AS VARCHAR) END AS label FROM tb)"""


def _table(spark, sf_dir):
    a = acts(spark, sf_dir)
    made = _status(spark, sf_dir).join(a.select("visitor_id", "snippet").distinct(), "visitor_id").withColumn("snapshot_ts", F.col("start_ts"))
    return windows.slice_table(made.select(F.col("visitor_id").alias("window"), *slices.KEYS), made, a)


@query(f'WITH {_TABLE} SELECT "window", recorder_slice, start_ts, end_ts, label, reason FROM lb')
def slice_table(spark, sf_dir):
    return _table(spark, sf_dir).select("window", "recorder_slice", "start_ts", "end_ts", "label", "reason")


@query(f"""WITH {_TABLE}, m AS (SELECT *, coalesce(lead(start_ts) OVER (PARTITION BY "window" ORDER BY start_ts, end_ts, recorder_slice) < end_ts, false) AS meets FROM lb)
 SELECT "window", CASE WHEN bool_or(reason IS NOT NULL) THEN 'a slice is refused' WHEN bool_or(meets) THEN 'slices overlap' END AS wall FROM m GROUP BY "window" HAVING bool_or(reason IS NOT NULL) OR bool_or(meets)""")
def window_walls(spark, sf_dir):
    return windows.window_walls(_table(spark, sf_dir))


@query(f"""WITH {_TABLE} SELECT "window", array_to_string(list_sort(list_distinct(list(snippet))), ',') AS sites, bool_or(snippet IS NULL) AS unplaced FROM lb GROUP BY "window" """)
def window_sites(spark, sf_dir):
    return windows.sites(_table(spark, sf_dir)).withColumn("sites", F.array_join("sites", ","))


@query(f"""WITH {_TABLE} SELECT "window", arg_min(visitor_id || '_' || recorder_slice, (start_ts, end_ts, recorder_slice)) || CASE WHEN count(*) > 1 THEN '_plus' || CAST(count(*) - 1 AS VARCHAR) || '_' ||
 substr(sha1(string_agg(visitor_id || ':' || recorder_slice, '+' ORDER BY visitor_id || ':' || recorder_slice)), 1, 6) ELSE '' END AS name FROM lb GROUP BY "window" """)
def window_names(spark, sf_dir):
    return windows.set_names(_table(spark, sf_dir))


@query(f"WITH {_STATUS} SELECT s.visitor_id, s.recorder_slice, CASE WHEN s.start_ts % 7 = 0 THEN 'unknown' WHEN status <> 'replayable' THEN 'not replayable' END AS reason FROM st s")
def current_slices(spark, sf_dir):
    made = _status(spark, sf_dir)
    return windows.current(made.select(*slices.KEYS), made.where("start_ts % 7 <> 0")).select(*slices.KEYS, "reason")


_HEADS = f"""{ACTS}, hd AS (SELECT visitor_id, recorder_slice, arg_min(url, (timestamp, counter, id)) AS url, min(timestamp) AS head_ts FROM acts WHERE url IS NOT NULL AND url <> '' GROUP BY ALL),
 pl AS (SELECT visitor_id, recorder_slice, url AS page, timestamp AS ts, row_number() OVER (PARTITION BY visitor_id, recorder_slice ORDER BY timestamp, counter, id) AS k FROM acts WHERE type_str = 'PageLoad'),
 av AS (SELECT h.*, CASE WHEN EXISTS (SELECT 1 FROM pl WHERE pl.visitor_id = h.visitor_id AND pl.recorder_slice = h.recorder_slice AND pl.page = h.url) THEN 'page-load' ELSE 'unattested' END AS kind FROM hd h),
 pg AS (SELECT visitor_id, recorder_slice, 0 AS k, url AS page, kind, head_ts AS ts FROM av UNION ALL SELECT pl.visitor_id, pl.recorder_slice, pl.k, pl.page, 'page-load', pl.ts FROM pl JOIN av USING (visitor_id, recorder_slice) WHERE NOT (pl.k = 1 AND pl.page = av.url)),
 pn AS (SELECT *, row_number() OVER (PARTITION BY visitor_id, recorder_slice ORDER BY k) AS place FROM pg)"""


def _referred(spark, sf_dir):
    return acts(spark, sf_dir).withColumn("referrer", F.lit(None).cast("string"))


@query(f"WITH {_HEADS} SELECT visitor_id, recorder_slice, url, head_ts, kind FROM av")
def slice_arrivals(spark, sf_dir):
    return windows.arrivals(_referred(spark, sf_dir)).drop("referrer")


@query(f"WITH {_HEADS} SELECT visitor_id, recorder_slice, page, kind, ts, CAST(place AS INTEGER) AS place FROM pn")
def window_pages(spark, sf_dir):
    e = _referred(spark, sf_dir)
    return windows.pages(e, windows.arrivals(e)).select(*slices.KEYS, "page", "kind", "ts", "place")


_TIMELINE = f"""{_HEADS}, sl AS (SELECT visitor_id, recorder_slice, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n FROM acts GROUP BY ALL),
 tl AS (SELECT sl.visitor_id, sl.recorder_slice, start_ts, end_ts, CASE WHEN n >= 2 THEN 'replayable' ELSE 'discarded' END AS status, kind, url, (SELECT arg_max(page, place) FROM pn WHERE pn.visitor_id = sl.visitor_id AND pn.recorder_slice = sl.recorder_slice) AS tail_url FROM sl LEFT JOIN av USING (visitor_id, recorder_slice)),
 t1 AS (SELECT *, lag(url) OVER w IS NOT DISTINCT FROM url AND lag(start_ts) OVER w IS NOT NULL AS same, lag(tail_url) OVER w AS bt, lag(end_ts) OVER w AS be, lead(url) OVER w AS nurl, lead(start_ts) OVER w AS nst, lead(status) OVER w AS nstatus FROM tl WINDOW w AS (PARTITION BY visitor_id ORDER BY start_ts, recorder_slice)),
 t2 AS (SELECT *, coalesce(kind = 'unattested' AND same, false) AS mid_page, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY visitor_id ORDER BY start_ts, recorder_slice) AS turn FROM t1),
 t3 AS (SELECT *, sum(CASE WHEN mid_page THEN 0 ELSE 1 END) OVER (PARTITION BY visitor_id ORDER BY start_ts, recorder_slice) AS stay FROM t2),
 t4 AS (SELECT visitor_id, turn + 1 AS turn, arg_max(tail_url, (start_ts, recorder_slice)) AS ot, arg_max(end_ts, (start_ts, recorder_slice)) AS oe FROM t3 GROUP BY visitor_id, turn)"""


@query(f"""WITH {_TIMELINE} SELECT t3.visitor_id, recorder_slice, start_ts, end_ts, kind, url, mid_page, min(start_ts) OVER (PARTITION BY t3.visitor_id, stay) AS loaded_ts, CASE WHEN mid_page THEN ot ELSE bt END AS prior_page,
 start_ts - CASE WHEN mid_page THEN oe ELSE be END AS prior_gap_ms, nurl AS next_page, CASE WHEN nst IS NOT NULL THEN greatest(nst - end_ts, 0) END AS next_gap_ms, nstatus = 'discarded' AS next_incomplete FROM t3 LEFT JOIN t4 ON t3.visitor_id = t4.visitor_id AND t3.turn = t4.turn""")
def visitor_timeline(spark, sf_dir):
    made = _slices(spark, sf_dir).withColumn("status", F.when(F.col("n_events") >= 2, "replayable").otherwise("discarded"))
    return windows.timeline(made, _referred(spark, sf_dir)).drop("referrer")


@query()
def session_context(spark, sf_dir):
    made = _slices(spark, sf_dir).withColumn("status", F.when(F.col("n_events") >= 2, "replayable").otherwise("discarded"))
    return windows.context_block(windows.timeline(made, _referred(spark, sf_dir))).select(*slices.KEYS, "context")


@query(f"WITH {ACTS}, r AS (SELECT *, lag(url) OVER (PARTITION BY visitor_id ORDER BY timestamp, counter, id) AS before FROM acts WHERE url IS NOT NULL) SELECT id, url AS route FROM r WHERE before IS DISTINCT FROM url")
def route_changes(spark, sf_dir):
    return windows.route_changes(acts(spark, sf_dir)).select("id", "route")


@query(f"WITH {ACTS} SELECT id, type_str <> 'Mutation' AND NOT (type_str = 'Input' AND k % 2 = 1) OR (type_str = 'Mutation' AND k > 50) AS visible FROM acts")
def stream_visible(spark, sf_dir):
    hidden, diff = (F.col("k") % 2).cast("int"), F.when(F.col("k") > 50, "+ x")
    return acts(spark, sf_dir).select("id", windows.stream_visible("type_str", hidden, diff).alias("visible"))


@query(r"""SELECT doc_id, sha256(regexp_replace(array_to_string(list_filter(string_split(text || chr(10) || '+' || chr(10) || '[a](https://b.test/c?d=1#e)', chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) NOT IN ('', '+', '-')), chr(10)),
 '\]\((https?://[^)?\s]*)\?[^)#\s]*(#[^)\s]*)?\)', '](\1?…\2)', 'g')) AS body FROM documents""")
def stream_bodies(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(windows.stream_body(F.concat("text", F.lit("\n+\n[a](https://b.test/c?d=1#e)"))), 256).alias("body"))


@query(f"""WITH {_TABLE}, w AS (SELECT *, min(start_ts) OVER (PARTITION BY "window", visitor_id) AS opened FROM lb WHERE reason IS NULL),
 ln AS (SELECT visitor_id, recorder_slice, timestamp, 0 AS shot, counter FROM acts UNION ALL SELECT visitor_id, recorder_slice, timestamp, 1, '' FROM acts WHERE type_str = 'Click')
 SELECT "window", label, l.timestamp, l.shot, CAST(row_number() OVER (PARTITION BY "window" ORDER BY opened, w.visitor_id, l.timestamp, l.shot, CAST(substr(label, 2) AS INTEGER), l.counter) AS INTEGER) AS place FROM w JOIN ln l USING (visitor_id, recorder_slice)
 WHERE l.timestamp BETWEEN start_ts AND end_ts""")
def composed_window(spark, sf_dir):
    a = acts(spark, sf_dir).withColumn("line", F.col("type_str"))
    return windows.composed(_table(spark, sf_dir), a, a.where("type_str = 'Click'")).select("window", "label", "timestamp", "shot", "place")


@query(f"""WITH {ACTS}, kinds AS (SELECT visitor_id, type_str, count(*) AS n, min(lpad(CAST(timestamp AS VARCHAR), 20, '0') || counter) AS seen FROM acts GROUP BY ALL),
 dist AS (SELECT visitor_id, string_agg(type_str || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY n DESC, seen) AS d FROM kinds GROUP BY 1), head AS (SELECT visitor_id, min(timestamp) AS a, max(timestamp) AS b, count(*) AS n, (max(timestamp) - min(timestamp) + 50) // 100 AS x FROM acts GROUP BY 1),
 pg AS (SELECT *, row_number() OVER w AS rn, type_str = 'PageLoad' OR lag(url) OVER w IS NULL OR url <> lag(url) OVER w AS came FROM acts WHERE url IS NOT NULL WINDOW w AS (PARTITION BY visitor_id ORDER BY timestamp, counter)),
 cnt AS (SELECT visitor_id, url, count(*) FILTER (WHERE came) AS n, min(rn) FILTER (WHERE came) AS seen, count(*) AS m FROM pg GROUP BY 1, 2), tot AS (SELECT visitor_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS u FROM cnt GROUP BY 1 HAVING sum(m) > 1),
 top AS (SELECT visitor_id, string_agg(chr(10) || '  - ' || url || CASE WHEN n > 1 THEN ' (' || CAST(n AS VARCHAR) || ' arrivals)' ELSE '' END, '' ORDER BY o) AS t FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY n DESC, seen) AS o FROM cnt) WHERE o <= 5 GROUP BY 1)
 SELECT h.visitor_id, '<SUMMARY>' || chr(10) || 'Date Range: ' || strftime(to_timestamp(a // 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') || ' – ' || strftime(to_timestamp(b // 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') || chr(10)
  || 'Recording: ' || CAST(n AS VARCHAR) || ' events over ' || CAST(x // 10 AS VARCHAR) || '.' || CAST(x % 10 AS VARCHAR) || ' seconds' || chr(10) || 'Event Types: ' || d
  || CASE WHEN u IS NULL THEN '' ELSE chr(10) || CASE WHEN u = 1 THEN 'Pages Visited: 1' || CASE WHEN total > 1 THEN ' (' || CAST(total AS VARCHAR) || ' arrivals)' ELSE '' END ELSE 'Pages Visited: ' || CAST(u AS VARCHAR) || ' unique (' || CAST(total AS VARCHAR) || ' total arrivals)' END
  || t || CASE WHEN u > 5 THEN chr(10) || '  ... and ' || CAST(u - 5 AS VARCHAR) || ' more' ELSE '' END END || chr(10) || '</SUMMARY>' AS facts
 FROM head h JOIN dist USING (visitor_id) LEFT JOIN tot USING (visitor_id) LEFT JOIN top USING (visitor_id)""")
def facts_blocks(spark, sf_dir):
    a = acts(spark, sf_dir)
    return windows.facts_block(a, a.where("url is not null").withColumn("loads", F.col("type_str") == "PageLoad"), ("visitor_id",))


@query(SQL["composed_window"])
def event_stream_sql(spark, sf_dir):
    """The same rows by SQL alone, through the table function."""
    a = acts(spark, sf_dir).withColumn("line", F.col("type_str"))
    tables.register(spark)
    windows.stream_lines(_table(spark, sf_dir), a, a.where("type_str = 'Click'")).createOrReplaceTempView("tracewell_lines")
    order = ", ".join(windows.READING)
    return spark.sql(f"SELECT `window`, label, timestamp, shot, place FROM event_stream(TABLE(SELECT * FROM tracewell_lines) PARTITION BY `window` ORDER BY ({order}))")


@query(f"""WITH {_TABLE}, p AS (SELECT "window", label, (end_ts - start_ts) // 1000 + 5 AS tokens FROM lb WHERE reason IS NULL)
 SELECT "window", label, CAST(sum(tokens) AS BIGINT) AS tokens, floor(sum(tokens) * 1000 / 100000.0 + 0.5) / 10 AS percent, sum(tokens) <= 80000 AS fits FROM p GROUP BY GROUPING SETS (("window", label), ("window"))""")
def priced_windows(spark, sf_dir):
    parts = _table(spark, sf_dir).where("reason is null").select("window", "label", F.expr("(end_ts - start_ts) div 1000").alias("text_tokens"), F.lit(5).alias("screenshot_tokens"))
    return windows.priced(parts, 100_000, 0.8)


@query(f"""WITH {_TABLE}, own AS (SELECT * FROM lb WHERE reason IS NULL), al AS (SELECT "window", count(*) AS n, min(start_ts) AS origin, min(label) AS only_ FROM own GROUP BY 1),
 rq AS (SELECT DISTINCT visitor_id AS "window", 'S' || CAST(k % 3 + 1 AS VARCHAR) AS label, k * 60000 - 5 AS offset_ms FROM acts),
 j AS (SELECT rq."window", rq.label, offset_ms, n, origin, o.start_ts, o.end_ts, o.screenshot_start_ts FROM rq JOIN al USING ("window") LEFT JOIN own o ON o."window" = rq."window" AND o.label = rq.label),
 d AS (SELECT *, CASE WHEN n = 1 THEN 'a label for the only slice' WHEN start_ts IS NULL THEN 'unknown label' WHEN offset_ms < 0 THEN 'negative' WHEN NOT (origin + offset_ms BETWEEN start_ts AND end_ts) THEN 'out of bounds' END AS defect FROM j)
 SELECT "window", label, offset_ms, defect, CASE WHEN defect IS NULL THEN greatest(origin + offset_ms, screenshot_start_ts) END AS ts FROM d""")
def requested_moments(spark, sf_dir):
    a = acts(spark, sf_dir)
    asked = a.select(F.col("visitor_id").alias("window"), F.concat(F.lit("S"), (F.col("k") % 3 + 1).cast("string")).alias("label"), (F.col("k") * 60000 - 5).alias("offset_ms"))
    return windows.requested(asked, _table(spark, sf_dir))


@query(f"""WITH {ACTS}, f AS (SELECT 'S' || CAST(k % 4 AS VARCHAR) AS label, id % 3 = 0 AS pulled, timestamp // 3600000 AS ts, id FROM acts),
 p AS (SELECT label, pulled, ts, 'run' || CAST(id % 5 AS VARCHAR) || '/' || label || CASE WHEN pulled THEN '_pulled' ELSE '_activity' END || '_screenshot_' || CAST(ts AS VARCHAR) || '.png' AS path FROM f) SELECT label, ts, arg_max(path, (pulled, path)) AS path FROM p GROUP BY ALL""")
def screenshot_index(spark, sf_dir):
    a = acts(spark, sf_dir)
    name = F.concat(F.lit("run"), (F.col("id") % 5).cast("string"), F.lit("/S"), (F.col("k") % 4).cast("string"), F.when(F.col("id") % 3 == 0, "_pulled").otherwise("_activity"), F.lit("_screenshot_"), F.expr("timestamp div 3600000").cast("string"), F.lit(".png"))
    return windows.screenshot_index(a.select(name.alias("path")).union(a.limit(0).select(F.lit("x").alias("path"))))


# ------------------------------------------------------------------ stores and sweeps
_KEYED = f"""{ACTS}, ky AS (SELECT id, 'site' || snippet AS snippet, 'visitor-' || visitor_id AS visitor_id, lpad(CAST(timestamp AS VARCHAR), 14, '0') || '-ab12' AS recorder_slice, counter, timestamp, k, strftime(to_timestamp(timestamp // 1000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM acts)"""


def _keyed(spark, sf_dir):
    a = acts(spark, sf_dir)
    return a.select("id", F.concat(F.lit("site"), "snippet").alias("snippet"), F.concat(F.lit("visitor-"), "visitor_id").alias("visitor_id"), F.concat(F.lpad(F.col("timestamp").cast("string"), 14, "0"), F.lit("-ab12")).alias("recorder_slice"), "counter", "timestamp", "k")


@query(f"WITH {_KEYED} SELECT id, CASE WHEN k % 9 <> 0 THEN snippet || '/' || day || '/' || visitor_id || '/' || recorder_slice || '/' || counter || '.json.gz' END AS key FROM ky")
def minted_keys(spark, sf_dir):
    return books.minted_keys(_keyed(spark, sf_dir).withColumn("snippet", F.when(F.col("k") % 9 == 0, F.upper("snippet")).otherwise(F.col("snippet")))).select("id", "key")


@query(f"""WITH {_KEYED}, r AS (SELECT snippet, visitor_id, recorder_slice, day, count(*) AS chunks, sum(k) AS bytes, min(timestamp) AS f, max(timestamp) AS l FROM ky WHERE k % 9 <> 0 GROUP BY ALL)
 SELECT count(DISTINCT visitor_id) AS visitors, count(*) AS slices, count(*) FILTER (WHERE day >= '2024-06-01') AS new, count(*) FILTER (WHERE day < '2024-06-01') AS expired, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes,
 min(f) AS first_upload_ms, max(l) AS last_upload_ms, min(f) AS first_ms, max(l) AS last_ms, (SELECT count(*) FROM ky WHERE k % 9 = 0) AS foreign_keys, (SELECT CAST(sum(k) AS BIGINT) FROM ky WHERE k % 9 = 0) AS foreign_bytes FROM r""")
def store_totals(spark, sf_dir):
    minted = books.minted_keys(_keyed(spark, sf_dir))
    objects = books.parsed_keys(minted.select(F.when(F.col("k") % 9 == 0, F.concat(F.lit("notes/"), "key")).otherwise(F.col("key")).alias("key"), F.col("k").alias("bytes"), F.col("timestamp").alias("uploaded_ms")))
    return books.store_totals(books.inventory(objects, minted.limit(0), "2024-06-01"), objects)


@query(f"""WITH {_KEYED}, sw AS (SELECT visitor_id, recorder_slice, min(day) AS day, count(*) AS n FROM ky GROUP BY ALL) SELECT 'events' AS name, (SELECT count(*) FROM ky WHERE day >= '2024-06-01') AS left_over UNION ALL SELECT 'slices', (SELECT count(*) FROM sw WHERE day >= '2024-06-01')
 UNION ALL SELECT 'manifest', (SELECT count(*) FROM ky WHERE day >= '2024-06-01') UNION ALL SELECT 'errors', (SELECT count(*) FROM ky WHERE day >= '2024-06-01') UNION ALL SELECT 'touched', (SELECT count(DISTINCT visitor_id) FROM sw WHERE day < '2024-06-01')""")
def retention_sweep(spark, sf_dir):
    e = books.minted_keys(_keyed(spark, sf_dir))
    made = e.groupBy("visitor_id", "recorder_slice").agg(F.count("*").alias("n")).withColumn("absorbed", F.lit(None).cast("array<string>"))
    left = books.swept("2024-06-01", e, made, e, e.select("key"))
    out = None
    for name, df in left.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("left_over"))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {_SLICES} SELECT visitor_id, recorder_slice FROM sl WHERE (visitor_id, recorder_slice) IN (SELECT (visitor_id, recorder_slice) FROM acts WHERE k > 40)")
def standing_slices(spark, sf_dir):
    return books.standing(_slices(spark, sf_dir), acts(spark, sf_dir).where("k > 40")).select("visitor_id", "recorder_slice")


@query(f"WITH {ACTS}, e AS (SELECT *, sum(k) OVER (PARTITION BY visitor_id ORDER BY timestamp DESC, counter DESC ROWS UNBOUNDED PRECEDING) AS kept FROM acts) SELECT id FROM e WHERE kept > 200")
def evicted_records(spark, sf_dir):
    return books.evicted(acts(spark, sf_dir).withColumn("bytes", F.col("k")), 200, ("visitor_id",), ("timestamp", "counter")).select("id")


@query(f"WITH {ACTS} SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS bytes FROM acts WHERE timestamp + 864000000 > 1717200000000")
def live_upload_bytes(spark, sf_dir):
    return books.live_bytes(acts(spark, sf_dir).select(F.col("timestamp").alias("uploaded_at"), F.col("k").alias("size_bytes")), 1_717_200_000_000, 864_000_000)


@query(f"WITH {ACTS} SELECT visitor_id, recorder_slice, count(*) AS records, min(counter) AS first, max(counter) AS last FROM acts GROUP BY ALL")
def described_records(spark, sf_dir):
    return books.described(acts(spark, sf_dir))


@query(f"WITH {ACTS} SELECT 'c' || CAST(k AS VARCHAR) AS key, arg_max('e' || CAST(id AS VARCHAR), (timestamp, 'e' || CAST(id AS VARCHAR))) AS etag, max(timestamp) AS uploaded_ms FROM acts GROUP BY 1")
def manifest_upsert(spark, sf_dir):
    a = acts(spark, sf_dir).select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("key"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("etag"), F.col("timestamp").alias("uploaded_ms"))
    return books.latest_manifest(a.where("uploaded_ms % 2 = 0"), a.where("uploaded_ms % 2 <> 0"))


# ------------------------------------------------------------------ claims and calls
_CLAIMS = f"""{ACTS}, cl AS (SELECT visitor_id AS answer_id, id AS claim_id, CASE WHEN k % 4 = 0 THEN 'INFERENCE' ELSE 'OBSERVATION' END AS claim_type, k AS pct, k % 5 <> 1 AS cited, CASE WHEN k % 3 = 0 THEN k * 50 END AS distance_ms,
 CASE WHEN k % 4 = 0 THEN CASE k % 8 WHEN 0 THEN [] ELSE [id, id + k // 90] END END AS supporting, 'S' || CAST(k % 6 AS VARCHAR) AS label FROM acts)"""


def _claims(spark, sf_dir):
    k = F.col("k")
    return acts(spark, sf_dir).select(
        F.col("visitor_id").alias("answer_id"), F.col("id").alias("claim_id"), F.when(k % 4 == 0, "INFERENCE").otherwise("OBSERVATION").alias("claim_type"), k.alias("groundedness_pct"), (k % 5 != 1).alias("cited"), F.when(k % 3 == 0, k * 50).alias("distance_ms"),
        F.when(k % 8 == 0, F.array().cast("array<bigint>")).when(k % 4 == 0, F.array("id", F.col("id") + F.expr("k div 90"))).alias("supporting"), F.concat(F.lit("S"), (k % 6).cast("string")).alias("label"),
    )


@query(f"""WITH {_CLAIMS} SELECT answer_id, claim_id, why FROM (SELECT *, CASE WHEN claim_type = 'INFERENCE' AND len(supporting) = 0 THEN 'no support' WHEN claim_type = 'INFERENCE' AND EXISTS (SELECT 1 FROM (SELECT unnest(c.supporting) AS s) u WHERE NOT EXISTS (SELECT 1 FROM cl d WHERE d.answer_id = c.answer_id AND d.claim_id = u.s))
 THEN 'unknown support' WHEN label = 'S5' THEN 'unknown label' END AS why FROM cl c) WHERE why IS NOT NULL""")
def structural_failures(spark, sf_dir):
    labels = spark.range(5).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("label"))
    return books.structural_failures(_claims(spark, sf_dir), labels)


@query(f"""WITH {_CLAIMS}, b AS (SELECT answer_id, claim_type, round(avg(pct), 1) AS m FROM cl GROUP BY ALL), bt AS (SELECT answer_id, string_agg(claim_type || ':' || CAST(m AS VARCHAR), ',' ORDER BY claim_type) AS by_type FROM b GROUP BY 1)
 SELECT answer_id, count(*) AS claims, count(*) FILTER (WHERE claim_type = 'OBSERVATION' AND NOT cited) AS uncited, round(avg(pct), 1) AS mean_pct, min(pct) AS least_pct, round(avg(pct) * sqrt(count(*)) / 100, 2) AS score, count(*) FILTER (WHERE cited) AS with_span,
 count(*) FILTER (WHERE cited AND distance_ms IS NULL) AS no_screenshot, count(*) FILTER (WHERE distance_ms > 2000) AS distant, CAST(round(avg(distance_ms), 0) AS BIGINT) AS mean_distance_ms, any_value(by_type) AS by_type FROM cl JOIN bt USING (answer_id) GROUP BY answer_id""")
def answer_measure(spark, sf_dir):
    rows = books.measured(_claims(spark, sf_dir))
    return rows.withColumn("by_type", F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","))


@query(f"WITH {ACTS} SELECT a.id AS claim_id, a.k AS groundedness_pct FROM acts a JOIN acts b ON a.id = b.id AND b.k % 2 = 0")
def judged_claims(spark, sf_dir):
    c = _claims(spark, sf_dir)
    verdicts = c.where("groundedness_pct % 2 = 0").withColumn("reasoning", F.lit("r"))
    return books.judged(c.drop("groundedness_pct"), verdicts).select("claim_id", "groundedness_pct")


@query(f"WITH {ACTS} SELECT visitor_id AS analysis, arg_max('t/' || visitor_id || '/answer-' || CAST(id AS VARCHAR) || '.json', id) AS path FROM acts GROUP BY 1")
def latest_answers(spark, sf_dir):
    path = F.concat(F.lit("t/"), "visitor_id", F.lit("/answer-"), F.col("id").cast("string"), F.lit(".json"))
    return books.latest_answers(acts(spark, sf_dir).select(F.col("visitor_id").alias("analysis"), path.alias("path")))


@query(f"""WITH {ACTS}, c AS (SELECT id, k % 100 AS s, k * 37 % 1000 AS ms, k % 3 AS l FROM acts) SELECT id, CASE WHEN s > 59 THEN 'form' WHEN l = 2 THEN 'unknown label' WHEN s * 1000 + ms > 30000 THEN 'bounds' END AS why FROM c WHERE s > 59 OR l = 2 OR s * 1000 + ms > 30000""")
def citation_defects(spark, sf_dir):
    k = F.col("k")
    text = F.concat(F.lit("Then [S"), (k % 3).cast("string"), F.format_string(" 00:%02d.%03d] it ended [so].", k % 100, k * 37 % 1000))
    table = spark.range(2).select(F.lit("w").alias("window"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("label"), F.lit(0).cast("long").alias("start_ms"), F.lit(30_000).cast("long").alias("end_ms"))
    return books.citation_defects(acts(spark, sf_dir).select(F.col("id").alias("answer_id"), F.lit("w").alias("window"), text.alias("text")), table).select(F.col("answer_id").alias("id"), "why")


@query("""WITH d AS (SELECT p_brand || '-' || CAST(p_partkey AS VARCHAR) AS model, p_retailprice AS price, p_partkey AS k FROM part) SELECT model, price AS declared, CASE WHEN k % 7 <> 0 THEN price + CASE WHEN k % 5 = 0 THEN 0.5 ELSE 0 END END AS listed FROM d WHERE k % 7 = 0 OR k % 5 = 0""")
def price_drift(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("model"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("k"))
    listed = p.where("k % 7 <> 0").withColumn("price", F.col("price") + F.when(F.col("k") % 5 == 0, 0.5).otherwise(0.0))
    return books.price_drift(p, listed).select("model", "declared", "listed")


@query(f"WITH {ACTS} SELECT CASE WHEN s < 60 THEN format('{{}}s', s) WHEN s < 3600 THEN format('{{}}m', s // 60) WHEN s < 86400 THEN format('{{}}h', s // 3600) ELSE format('{{}}d', s // 86400) END AS age FROM (SELECT (max(timestamp) + 500000 - max(timestamp)) // 1000 AS s FROM acts)")
def freshness(spark, sf_dir):
    a = acts(spark, sf_dir)
    return books.freshness(a, F.max("timestamp") + 500_000)


# ------------------------------------------------------------------ slices
_MADE = f"""{ACTS}, ev AS (SELECT *, CASE WHEN k % 3 = 0 THEN 4 WHEN k % 3 = 1 THEN 2 ELSE 3 END AS type, 'https://a.test/' || CAST(k % 2 AS VARCHAR) AS href, k % 11 AS width, CASE WHEN k % 13 <> 1 THEN k END AS root_id FROM acts),
 nx AS (SELECT *, lead(type) OVER w AS nt, lead(root_id) OVER w AS nr FROM ev WINDOW w AS (PARTITION BY visitor_id, recorder_slice ORDER BY timestamp, counter, id)),
 cv AS (SELECT visitor_id, recorder_slice, arg_min(struct_pack(w := width, r := nr), (timestamp, counter, id)) AS c FROM nx WHERE type = 4 AND nt = 2 GROUP BY ALL),
 md AS (SELECT visitor_id, recorder_slice, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n_events, bool_or(type = 4) AS has_meta, arg_min(href, (timestamp, counter, id)) FILTER (WHERE type = 4) AS url, min(timestamp) FILTER (WHERE type = 4) AS first_meta FROM nx GROUP BY ALL),
 st AS (SELECT md.*, CASE WHEN c IS NULL THEN CASE WHEN has_meta THEN 'orphan' ELSE 'no snapshot' END WHEN coalesce(c.w, 0) = 0 THEN 'zero viewport' WHEN c.r IS NULL THEN 'damaged' END AS reason FROM md LEFT JOIN cv USING (visitor_id, recorder_slice))"""


def _made(spark, sf_dir):
    k = F.col("k")
    e = acts(spark, sf_dir).withColumns({"type": F.when(k % 3 == 0, 4).when(k % 3 == 1, 2).otherwise(3), "href": F.concat(F.lit("https://a.test/"), (k % 2).cast("string")), "width": k % 11, "height": F.lit(9), "root_id": F.when(k % 13 != 1, k)})
    return slices.materialised(e)


@query(f"WITH {_MADE} SELECT visitor_id, recorder_slice, start_ts, end_ts, n_events, url, reason, CASE WHEN reason IS NULL THEN 'replayable' ELSE 'discarded' END AS status FROM st")
def materialised_slices(spark, sf_dir):
    return _made(spark, sf_dir).select("visitor_id", "recorder_slice", "start_ts", "end_ts", "n_events", "url", "reason", "status")


@query(f"WITH {_MADE} SELECT visitor_id, recorder_slice, coalesce(CASE WHEN reason = 'no snapshot' THEN true WHEN reason = 'zero viewport' THEN false ELSE start_ts < first_meta END, false) AS opened FROM st")
def opened_pages(spark, sf_dir):
    return slices.opened_page(_made(spark, sf_dir), F.col("start_ts")).select("visitor_id", "recorder_slice", "opened")


# ------------------------------------------------------------------ stream passes
@query(f"""WITH {ACTS}, e AS (SELECT *, sum(CASE WHEN type_str = 'PageLoad' THEN 1 ELSE 0 END) OVER (PARTITION BY visitor_id ORDER BY timestamp, counter) AS epoch, repeat('ab', CAST(k % 7 AS INTEGER)) AS input FROM acts),
 i AS (SELECT *, lag(input) OVER w AS before, lead(input) OVER w IS NULL AS ends FROM e WHERE type_str = 'Input' WINDOW w AS (PARTITION BY visitor_id, node_id, epoch ORDER BY timestamp, counter))
 SELECT id, before, ends, CASE WHEN starts_with(input, before) THEN substr(input, length(before) + 1) END AS added FROM i""")
def typing_runs(spark, sf_dir):
    return stream.typing_runs(acts(spark, sf_dir).withColumn("input", F.repeat(F.lit("ab"), (F.col("k") % 7).cast("int")))).select("id", "before", "ends", "added")


@query(f"""WITH {ACTS}, e AS (SELECT *, sum(CASE WHEN type_str = 'PageLoad' THEN 1 ELSE 0 END) OVER (PARTITION BY visitor_id ORDER BY timestamp, counter) AS epoch, repeat('ab', CAST(k % 7 AS INTEGER)) AS input FROM acts),
 i AS (SELECT *, lag(input) OVER w AS before, lead(input) OVER w IS NULL AS ends FROM e WHERE type_str = 'Input' WINDOW w AS (PARTITION BY visitor_id, node_id, epoch ORDER BY timestamp, counter)), c AS (SELECT *, least(length(before), length(input)) AS h FROM i)
 SELECT id, CASE WHEN before IS NOT NULL THEN CAST(h AS INTEGER) END AS pos, substr(before, h + 1) AS old, CASE WHEN before IS NOT NULL THEN substr(input, h + 1) END AS new, CASE WHEN ends OR before IS NULL THEN input END AS whole FROM c""")
def typed_changes(spark, sf_dir):
    return stream.typed_changes(acts(spark, sf_dir).withColumn("input", F.repeat(F.lit("ab"), (F.col("k") % 7).cast("int")))).select("id", "pos", "old", "new", "whole")


@query(f"""WITH {ACTS}, d AS (SELECT id, 'abc' || repeat('x', CAST(k % 4 AS INTEGER)) || 'yz' AS a, 'abc' || repeat('x', CAST(k % 3 AS INTEGER)) || 'Qyz' AS b, k % 4 AS m, k % 3 AS n FROM acts)
 SELECT id, CAST(3 + least(m, n) AS INTEGER) AS pos, substr(a, 4 + least(m, n), greatest(m - n, 0)) AS old, substr(b, 4 + least(m, n), greatest(n - m, 0) + 1) AS new FROM d""")
def edit_deltas(spark, sf_dir):
    k = F.col("k")
    a = F.concat(F.lit("abc"), F.repeat(F.lit("x"), (k % 4).cast("int")), F.lit("yz"))
    b = F.concat(F.lit("abc"), F.repeat(F.lit("x"), (k % 3).cast("int")), F.lit("Qyz"))
    return acts(spark, sf_dir).select("id", X.edit_delta(a, b).alias("d")).select("id", F.col("d.at").alias("pos"), "d.old", "d.new")


@query(f"""WITH {ACTS}, g AS (SELECT id, visitor_id, k % 2 AS place, k % 3 AS old, (k + 1) % 3 AS new, timestamp, counter FROM acts), m AS (SELECT *, coalesce(old = lag(new) OVER w, false) AS on_ FROM g WINDOW w AS (PARTITION BY visitor_id, place ORDER BY timestamp, counter)),
 c AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY visitor_id, place ORDER BY timestamp, counter) AS chain FROM m) SELECT visitor_id, place, arg_min(old, (timestamp, counter)) AS old, arg_max(new, (timestamp, counter)) AS new, count(*) AS edits, count(*) >= 3 AS collapsed FROM c GROUP BY visitor_id, place, chain""")
def flip_chains(spark, sf_dir):
    k = F.col("k")
    return stream.flip_chains(acts(spark, sf_dir).select("visitor_id", "timestamp", "counter", (k % 2).alias("place"), (k % 3).alias("old"), ((k + 1) % 3).alias("new")))


@query(f"""SELECT event_id AS id, CASE {_K} % 4 WHEN 0 THEN event_type IN ('view', 'click') WHEN 1 THEN {_K} % 17 IN (1, 3, 4, 6, 7, 12, 14) OR ({_K} % 17 = 2 AND {_K} % 11 NOT IN (5, 6)) OR ({_K} % 17 = 5 AND event_type <> 'error') ELSE false END AS activity FROM events""")
def raw_activity(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    t = F.when(k % 4 == 0, F.when(F.col("event_type") == "view", 69).when(F.col("event_type") == "click", 70).otherwise(71)).when(k % 4 == 1, 3).otherwise(4)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), X.is_activity_raw(t, k % 17, k % 11, F.col("event_type") != "error").alias("activity"))


@query(f"WITH {ACTS} SELECT id, type_str <> 'Mutation' AND NOT (type_str = 'Input' AND k % 2 = 0) AS activity FROM acts")
def scripted_inputs(spark, sf_dir):
    extra = F.to_json(F.struct((F.col("k") % 2 == 1).alias("userTriggered")))
    return acts(spark, sf_dir).select("id", X.is_activity("type_str", extra).alias("activity"))


@query(f"""WITH {ACTS} SELECT id, CASE WHEN m >= 1440 THEN format('{{}}d {{}}h', m // 1440, m // 60 % 24) WHEN m >= 60 THEN format('{{}}h {{}}m', m // 60, m % 60) ELSE format('{{}}m', m) END AS age, strftime(to_timestamp(timestamp // 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM (SELECT *, k * 40 AS m FROM acts)""")
def ages_and_stamps(spark, sf_dir):
    return acts(spark, sf_dir).select("id", X.age(F.col("k") * 40 * 60_000).alias("age"), X.utc_stamp("timestamp").alias("stamp"))


@query(f"""WITH {ACTS} SELECT id, CASE WHEN k % 3 = 0 AND k > 0 THEN timestamp + k ELSE timestamp END AS ts, CAST(floor(value - 50.5 + 0.5) AS BIGINT) AS whole FROM acts""")
def canonical_clock(spark, sf_dir):
    k = F.col("k")
    offsets = F.when(k > 0, F.array(-k, k)).otherwise(F.array().cast("array<bigint>"))
    return acts(spark, sf_dir).select("id", X.canonical_ts(F.lit(3), F.when(k % 3 == 0, 1).otherwise(3), F.col("timestamp"), offsets).alias("ts"), X.rounded(F.col("value") - 50.5).cast("long").alias("whole"))


@query(r"""WITH n AS (SELECT DISTINCT p_partkey AS k, p_type || 'CardNumber' || CAST(p_size AS VARCHAR) || 'HTMLText' AS name FROM part)
 SELECT k, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([\p{Ll}\p{Nd}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ',') AS tokens FROM n""".replace("\\\\", "\\"))
def field_names(spark, sf_dir):
    name = F.concat("p_type", F.lit("CardNumber"), F.col("p_size").cast("string"), F.lit("HTMLText"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(X.field_tokens(name), ",").alias("tokens"))


@query(f"""WITH RECURSIVE {ACTS}, o AS (SELECT visitor_id, counter, k, row_number() OVER (PARTITION BY visitor_id ORDER BY counter) AS n FROM acts), g AS (SELECT visitor_id, counter, k, n, CAST(0 AS BIGINT) AS grp, k AS used FROM o WHERE n = 1 UNION ALL
 SELECT o.visitor_id, o.counter, o.k, o.n, CASE WHEN g.used > 0 AND g.used + o.k > 300 THEN g.grp + 1 ELSE g.grp END, CASE WHEN g.used > 0 AND g.used + o.k > 300 THEN o.k ELSE g.used + o.k END FROM g JOIN o ON o.visitor_id = g.visitor_id AND o.n = g.n + 1) SELECT visitor_id, counter, k, grp AS "group" FROM g""")
def budget_groups(spark, sf_dir):
    return spans.greedy_groups(acts(spark, sf_dir).select("visitor_id", "counter", "k"), ("visitor_id",), ("counter",), "k", 300)


@query(f"""WITH {_SLICES} SELECT m.id, CASE WHEN NOT EXISTS (SELECT 1 FROM sl WHERE sl.visitor_id = m.visitor_id AND sl.start_ts <= m.t) THEN 'outside' WHEN m.t > (SELECT arg_max(end_ts, start_ts) FROM sl WHERE sl.visitor_id = m.visitor_id AND sl.start_ts <= m.t) THEN 'gap'
 WHEN m.t < (SELECT max(start_ts) + 1000 FROM sl WHERE sl.visitor_id = m.visitor_id AND sl.start_ts <= m.t) THEN 'lead' END AS why FROM (SELECT id, visitor_id, timestamp - 1800000 AS t FROM acts) m""")
def showable_moments(spark, sf_dir):
    moments = acts(spark, sf_dir).select("id", "visitor_id", (F.col("timestamp") - 1_800_000).alias("timestamp"))
    return spans.showable(moments, _slices(spark, sf_dir).withColumn("snapshot_ts", F.col("start_ts") + 1000)).select("id", "why")


@query(f"""WITH {ACTS} SELECT id, CASE WHEN k % 5 = 0 THEN 'q' WHEN k % 3 = 0 THEN 'p' END AS level, CASE WHEN k % 3 = 0 THEN '1' END AS email FROM acts""")
def layered_options(spark, sf_dir):
    urls = acts(spark, sf_dir).select("id", F.concat(F.lit("https://a.test/"), F.when(F.col("k") % 3 == 0, "p/").otherwise(""), F.when(F.col("k") % 5 == 0, "q").otherwise("")).alias("url"))
    out = books.layered(urls, [("/p/", {"level": "p", "mask.email": "1"}), ("q$", {"level": "q"})])
    return out.select("id", F.try_element_at("options", F.lit("level")).alias("level"), F.try_element_at("options", F.lit("mask.email")).alias("email"))


@query("""SELECT doc_id, sha256(CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substr(text, 1, 59), '\\s+\\S*$', '') || '…' END) AS cut FROM documents""")
def truncated_words(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.truncate_words("text", 60), 256).alias("cut"))


# ------------------------------------------------------------------ pages as recorded
def _recorded(spark, sf_dir):
    """The driver's acts on a page of ten sections with an anchor each: views show it, errors change a section's class, others act on a node."""
    a = acts(spark, sf_dir)
    k = F.col("k")
    section = lambda i: F.format_string(
        '{"type":2,"id":%d,"tagName":"DIV","attributes":{"class":"c%d"},"childNodes":[{"type":2,"id":%d,"tagName":"A","attributes":{"href":"https://a.test/%d"},"childNodes":[{"type":2,"id":%d,"tagName":"em","attributes":{},"childNodes":[]}]}]}',
        F.lit(100 + i), F.lit(i), F.lit(200 + i), F.lit(i), F.lit(300 + i),
    )
    page = F.concat(F.lit('{"type":2,"data":{"node":{"type":0,"id":1,"childNodes":['), F.concat_ws(",", *(section(i) for i in range(10))), F.lit("]}}}"))
    change = F.format_string('{"type":3,"data":{"source":0,"attributes":[{"id":%d,"attributes":{"class":"m%d"}}]}}', 100 + k % 10, k)
    type_ = F.when(F.col("type_str") == "PageLoad", 2).otherwise(3)
    raw = F.when(F.col("type_str") == "PageLoad", page).when(F.col("type_str") == "Mutation", change)
    e = dom.with_epochs(a.withColumn("type", type_).withColumn("raw", raw))
    return e.withColumn("target_id", F.when(F.col("type_str") == "Click", 100 * (1 + F.col("node_id") % 3) + k % 10)).select("id", *slices.KEYS, "timestamp", "counter", "type", "epoch", "at", "raw", "target_id", "type_str")


_EPOCHS = f"""{ACTS}, ep AS (SELECT *, sum(CASE WHEN type_str = 'PageLoad' THEN 1 ELSE 0 END) OVER (PARTITION BY visitor_id, recorder_slice ORDER BY timestamp, counter, id) AS epoch, row_number() OVER (PARTITION BY visitor_id, recorder_slice ORDER BY timestamp, counter, id) AS rn FROM acts)"""


@query(f"""WITH {_EPOCHS}, c AS (SELECT *, 1 + node_id % 3 AS level, k % 10 AS i FROM ep WHERE type_str = 'Click'), m AS (SELECT c.id, arg_max('m' || CAST(x.k AS VARCHAR), x.rn) AS cls FROM c JOIN ep x ON x.visitor_id = c.visitor_id AND x.recorder_slice = c.recorder_slice AND x.epoch = c.epoch AND x.type_str = 'Mutation' AND x.k % 10 = c.i AND x.rn < c.rn GROUP BY c.id)
 SELECT c.id, CASE WHEN epoch > 0 THEN CASE level WHEN 1 THEN 'div' WHEN 2 THEN 'a' ELSE 'em' END END AS tag, CASE WHEN level = 1 AND epoch > 0 THEN coalesce(m.cls, 'c' || CAST(i AS VARCHAR)) END AS class,
 CASE WHEN epoch > 0 AND level > 1 THEN 'https://a.test/' || CAST(i AS VARCHAR) END AS href FROM c LEFT JOIN m ON m.id = c.id""")
def click_targets(spark, sf_dir):
    e = _recorded(spark, sf_dir)
    clicks = e.where("type_str = 'Click'").drop("raw", "type", "type_str")
    return dom.followed(clicks, dom.packed(e, **dom.OF_LINKS)).select("id", "tag", "class", "href")


def _living(spark, sf_dir):
    """The same page with a text in each section; errors change it, purchases add another, and signups remove the section."""
    a = acts(spark, sf_dir)
    k, i = F.col("k"), F.col("k") % 10
    section = lambda j: (
        f'{{"type":2,"id":{100 + j},"tagName":"DIV","attributes":{{}},"childNodes":[{{"type":2,"id":{200 + j},"tagName":"A","attributes":{{"href":"/{j}"}},"childNodes":[{{"type":2,"id":{300 + j},"tagName":"em","attributes":{{}},"childNodes":'
        f'[{{"type":3,"id":{400 + j},"textContent":"label {j}"}}]}}]}}]}}'
    )
    page = F.lit('{"type":2,"data":{"node":{"type":0,"id":1,"childNodes":[' + ",".join(section(j) for j in range(10)) + "]}}}")
    target = 100 * (1 + F.col("node_id") % 3) + i
    raw = (
        F.when(F.col("type_str") == "PageLoad", page)
        .when(F.col("type_str") == "Mutation", F.format_string('{"type":3,"data":{"source":0,"texts":[{"id":%d,"value":"now %d"}]}}', 400 + i, k))
        .when(F.col("type_str") == "Input", F.format_string('{"type":3,"data":{"source":0,"removes":[{"id":%d}]}}', 100 + i))
        .when(F.col("type_str") == "Selection", F.format_string('{"type":3,"data":{"source":0,"adds":[{"parentId":%d,"nextId":null,"node":{"type":3,"id":%d,"textContent":" more %d"}}]}}', 300 + i, 1000 + k, k))
        .otherwise(F.format_string('{"type":3,"data":{"source":2,"type":2,"id":%d}}', target))
    )
    e = a.withColumn("type", F.when(F.col("type_str") == "PageLoad", 2).otherwise(3)).withColumn("raw", raw)
    return e.withColumn("target_id", F.when(F.col("type_str") == "Click", target)).select("id", *slices.KEYS, "timestamp", "counter", "type", "raw", "target_id", "type_str")


_SECTIONS = f"{_EPOCHS}, se AS (SELECT *, k % 10 AS i FROM ep)"


@query(f"""WITH {_SECTIONS}, c AS (SELECT * FROM se WHERE type_str = 'Click' AND epoch > 0), up AS (SELECT c.id, x.rn, x.k, x.type_str FROM c JOIN se x ON x.visitor_id = c.visitor_id AND x.recorder_slice = c.recorder_slice AND x.epoch = c.epoch AND x.i = c.i AND x.rn < c.rn),
 own AS (SELECT id, bool_or(type_str = 'Input') AS gone, arg_max('now ' || CAST(k AS VARCHAR), rn) FILTER (WHERE type_str = 'Mutation') AS label FROM up GROUP BY id), adds AS (SELECT id, k, max(rn) AS rn FROM up WHERE type_str = 'Selection' GROUP BY ALL),
 more AS (SELECT id, string_agg(' more ' || CAST(k AS VARCHAR), '' ORDER BY rn) AS more FROM adds GROUP BY id),
 t AS (SELECT e.id, CASE WHEN c.id IS NULL OR coalesce(own.gone, false) THEN NULL ELSE coalesce(own.label, 'label ' || CAST(e.i AS VARCHAR)) || coalesce(more.more, '') END AS t FROM se e LEFT JOIN c ON c.id = e.id LEFT JOIN own ON own.id = e.id LEFT JOIN more ON more.id = e.id WHERE e.type_str = 'Click')
 SELECT id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(substr(t, 1, 79), '\\s+\\S*$', '') || '…' END AS text FROM t""")
def click_texts(spark, sf_dir):
    e = dom.with_epochs(_living(spark, sf_dir))
    return dom.with_text(e.where("type_str = 'Click'").drop("raw", "type"), dom.packed(e, **dom.OF_TEXTS)).select("id", "text")


@query(f"""WITH {_SECTIONS}, p AS (SELECT visitor_id, recorder_slice, epoch, 41 + count(*) FILTER (WHERE type_str = 'Selection') AS instances, list(DISTINCT i) FILTER (WHERE type_str = 'Input') AS gone FROM se WHERE epoch > 0 GROUP BY ALL)
 SELECT p.visitor_id, p.recorder_slice, CAST(p.epoch AS BIGINT) AS epoch, p.instances, 41 - 4 * coalesce(len(p.gone), 0) + (SELECT count(DISTINCT x.k) FROM se x WHERE x.visitor_id = p.visitor_id AND x.recorder_slice = p.recorder_slice AND x.epoch = p.epoch AND x.type_str = 'Selection' AND NOT list_contains(coalesce(p.gone, []), x.i)) AS living FROM p""")
def node_lifetimes(spark, sf_dir):
    lives = dom.lifetimes(dom.packed(dom.with_epochs(_living(spark, sf_dir)), **dom.OF_LIVES), ("ends",)).where("epoch > 0")
    return lives.groupBy(*dom.PAGE).agg(F.count("*").alias("instances"), F.count_if(F.col("ends") == dom.NEVER).alias("living"))


@query(f"""WITH {_SECTIONS}, sl AS (SELECT visitor_id, recorder_slice, min(timestamp) AS start_ts FROM acts GROUP BY ALL), r AS (SELECT visitor_id, recorder_slice, lag(recorder_slice) OVER (PARTITION BY visitor_id ORDER BY start_ts) AS into_ FROM sl),
 n AS (SELECT x.*, r.into_ FROM se x JOIN r ON r.visitor_id = x.visitor_id AND r.recorder_slice = x.recorder_slice WHERE r.into_ IS NOT NULL AND x.type_str <> 'PageLoad'),
 shown AS (SELECT visitor_id, recorder_slice, max(epoch) AS epoch FROM se GROUP BY ALL),
 gone AS (SELECT x.visitor_id, x.recorder_slice, x.i FROM se x JOIN shown s ON s.visitor_id = x.visitor_id AND s.recorder_slice = x.recorder_slice AND s.epoch = x.epoch WHERE x.type_str = 'Input'),
 bad AS (SELECT n.*, row_number() OVER (PARTITION BY n.visitor_id, n.recorder_slice ORDER BY n.rn) AS f FROM n JOIN shown s ON s.visitor_id = n.visitor_id AND s.recorder_slice = n.into_ WHERE s.epoch = 0 OR EXISTS (SELECT 1 FROM gone g WHERE g.visitor_id = n.visitor_id AND g.recorder_slice = n.into_ AND g.i = n.i)
  OR EXISTS (SELECT 1 FROM n m WHERE m.visitor_id = n.visitor_id AND m.recorder_slice = n.recorder_slice AND m.type_str = 'Input' AND m.i = n.i AND m.rn < n.rn))
 SELECT visitor_id, recorder_slice, timestamp AS refused_at, 'at ' || CAST(timestamp AS VARCHAR) || ': ' || CASE type_str WHEN 'Click' THEN 'event references unknown node ' || CAST(100 * (1 + node_id % 3) + i AS VARCHAR) WHEN 'Mutation' THEN 'text change on unknown node ' || CAST(400 + i AS VARCHAR)
  WHEN 'Input' THEN 'remove of unknown node ' || CAST(100 + i AS VARCHAR) ELSE 'add never resolved of node ' || CAST(1000 + k AS VARCHAR) END AS reason FROM bad WHERE f = 1""")
def refused_slices(spark, sf_dir):
    e = _living(spark, sf_dir)
    runs = slices.prior_slices(slices.summaries(e)).where("prior_slice is not null").select(*slices.KEYS, F.col("prior_slice").alias("into"))
    return dom.refusals(e, runs)


@query()
def page_diffs(spark, sf_dir):
    md = read(spark, sf_dir, "pages").select("page_id", "url", pages.markdown("html").alias("md"))
    w = Window.partitionBy(X.url_host("url")).orderBy("page_id")
    return diffs.with_diffs(md.withColumn("before", F.lag("md").over(w)), "before", "md").select("page_id", "diff")
