"""Ledgers, telemetry, inventory, retention, status, claims: aggregates over the side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import exprs as X


# ------------------------------------------------------------------ spend
def spend_by_period(ledger: DataFrame, period: str) -> DataFrame:
    """Dollars and calls by UTC day, ISO week or month of ``ts``."""
    if period not in ("day", "week", "month"):
        raise ValueError("a period is a day, a week or a month")
    return ledger.groupBy(F.date_format(F.date_trunc(period, "ts"), "yyyy-MM-dd").alias("period")).agg(F.round(F.sum(F.col("usd").cast("decimal(18,8)")).cast("double"), 2).alias("usd"), F.count("*").alias("calls"))


def wall(ledger: DataFrame, since: Column, cap: float) -> DataFrame:
    """One row: what was spent since then, and whether a call may still be made. A cap of 0 stops all."""
    spent = F.round(F.coalesce(F.sum(F.when(F.col("ts") >= since, F.col("usd"))), F.lit(0.0)), 8)
    return ledger.agg(spent.alias("usd")).withColumn("refused", F.col("usd") >= cap)


def price_drift(declared: DataFrame, listed: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Models whose declared price differs from the listed one by more than the tolerance's share, or that aren't listed."""
    both = declared.select("model", F.col("price").alias("declared")).join(listed.select("model", F.col("price").alias("listed")), "model", "left")
    same = F.abs(F.col("declared") - F.col("listed")) <= tolerance * F.greatest(F.abs("declared"), F.abs("listed"))
    return both.where(~F.coalesce(same, F.lit(False)))


# ------------------------------------------------------------------ telemetry
def rates(points: DataFrame, *by: str) -> DataFrame:
    """Unbiased counts of sampled points: each stands for its sample interval."""
    return points.groupBy(*by).agg(F.sum("_sample_interval").alias("events"), F.max("_sample_interval").alias("coarsest"), F.max("timestamp").alias("latest"))


def running_totals(points: DataFrame, *context: str, value: str) -> DataFrame:
    """Points that report a running total: the largest of each context, never their sum."""
    return points.groupBy(*context).agg(F.max(value).alias(value))


def typed(points: DataFrame, metric: str, blobs: dict[str, str], doubles: dict[str, str]) -> DataFrame:
    """One metric's points with names for its positional columns; -1 stands for no value."""
    named = [F.col(at).alias(name) for at, name in blobs.items()]
    named += [F.nullif(F.col(at), F.lit(-1.0)).alias(name) for at, name in doubles.items()]
    return points.where(F.col("blob1") == metric).select(F.col("index1").alias("snippet"), F.col("blob2").alias("visitor_id"), F.col("blob3").alias("recorder_slice"), "timestamp", "_sample_interval", *named)


def freshness(points: DataFrame, now: Column) -> DataFrame:
    """Age of the latest point in the coarsest unit that fits."""
    s = F.floor((now - F.max("timestamp")) / 1000)
    return points.agg(F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm", F.floor(s / 60))).when(s < 86400, F.format_string("%dh", F.floor(s / 3600))).otherwise(F.format_string("%dd", F.floor(s / 86400))).alias("age"))


def means_nothing(df: DataFrame) -> DataFrame:
    """One row: whether the result has no row with anything in it."""
    return df.agg(F.coalesce(F.bool_and(X.sums_to_nothing(*(F.col(c) for c in df.columns))), F.lit(True)).alias("nothing"))


# ------------------------------------------------------------------ inventory and retention
def parsed_keys(objects: DataFrame) -> DataFrame:
    """objects(key, bytes, uploaded_ms, etag) with snippet, date, visitor_id and recorder_slice; foreign ones have nulls."""
    p = F.split("key", "/")
    good = (F.size(p) == 5) & X.is_slice_id(F.get(p, F.lit(3))) & F.get(p, F.lit(4)).endswith(".json.gz")
    part = lambda i: F.when(good, F.get(p, F.lit(i)))
    return objects.withColumns({"snippet": part(0), "date": part(1), "visitor_id": part(2), "recorder_slice": part(3), "foreign": ~F.coalesce(good, F.lit(False))})


def under_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    """Literal prefixes only; a leading site and day also prune partitions of those names."""
    if any(c in prefix for c in "*?["):
        raise ValueError("a prefix is literal text, not a pattern")
    return objects.where(F.col("key").startswith(prefix))


def inventory(parsed: DataFrame, slices: DataFrame, cutoff: str) -> DataFrame:
    """Stored slices with chunks, bytes and upload times, whether they are loaded, and whether they are past keeping."""
    keys = ["snippet", "visitor_id", "recorder_slice"]
    rows = parsed.where("not foreign").groupBy(*keys, "date").agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"), F.min("uploaded_ms").alias("first_upload_ms"), F.max("uploaded_ms").alias("last_upload_ms"))
    held = slices.select("visitor_id", "recorder_slice").distinct().withColumn("loaded", F.lit(True))
    return rows.join(held, ["visitor_id", "recorder_slice"], "left").withColumn("loaded", F.coalesce("loaded", F.lit(False))).withColumn("expired", F.col("date") < cutoff)


def inventory_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.countDistinct("visitor_id").alias("visitors"),
        F.count("*").alias("slices"),
        F.count_if(F.expr("not loaded and not expired")).alias("new"),
        F.count_if(F.expr("expired")).alias("expired"),
        F.sum("chunks").alias("chunks"),
        F.sum("bytes").alias("bytes"),
        F.min("first_upload_ms").alias("first_upload_ms"),
        F.max("last_upload_ms").alias("last_upload_ms"),
    )


def unloaded(objects: DataFrame, manifest: DataFrame) -> DataFrame:
    """Objects that aren't held in this version: decided before any content is read."""
    return objects.join(manifest.select("key", "etag"), ["key", "etag"], "left_anti")


def latest_manifest(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: of each key the row uploaded last."""
    both = manifest.unionByName(new)
    return both.groupBy("key").agg(F.max_by(F.struct("etag", "uploaded_ms"), F.struct("uploaded_ms", "etag")).alias("r")).select("key", "r.*")


def survivors(slices: DataFrame, open_ms: Column, cutoff: str) -> DataFrame:
    """Slices opened on the cutoff's day or later."""
    return slices.where(X.utc_day(open_ms) >= cutoff)


# ------------------------------------------------------------------ status
def reconciled(events: DataFrame, slices: DataFrame) -> DataFrame:
    """One row: events in all, in replayable slices, dropped with others, and not yet in any."""
    state = events.join(slices.select("visitor_id", "recorder_slice", "status"), ["visitor_id", "recorder_slice"], "left")
    return state.agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == "replayable").alias("analyzable"), F.count_if(F.col("status") != "replayable").alias("dropped"), F.count_if(F.expr("status is null")).alias("unplaced")
    )


def by_status(slices: DataFrame) -> DataFrame:
    return slices.groupBy("status").agg(F.count("*").alias("slices"), F.sum("n_events").alias("events"))


def first_writers(delivered: DataFrame, held: DataFrame) -> DataFrame:
    """New events of a delivery: of equal content of one visitor the one that arrived first, unless already held."""
    w = Window.partitionBy("visitor_id", "content_hash").orderBy("arrival")
    one = delivered.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return one.join(held.select("visitor_id", "content_hash"), ["visitor_id", "content_hash"], "left_anti")


# ------------------------------------------------------------------ claims
CITE = r"\[(?:(S\d+) )?(\d{2,}):(\d{2})\.(\d{3})\]"


def citations(answers: DataFrame) -> DataFrame:
    """Each citation of ``answers(answer_id, text)`` with its label and moment."""
    cites = answers.select("answer_id", F.posexplode(F.regexp_extract_all("text", F.lit(CITE), F.lit(0))).alias("place", "cite"))
    n = lambda k: F.regexp_extract("cite", CITE, k)
    ms = n(2).cast("long") * 60000 + n(3).cast("long") * 1000 + n(4).cast("long")
    return cites.select("answer_id", "place", "cite", F.nullif(n(1), F.lit("")).alias("label"), ms.alias("offset_ms"))


def citation_violations(cites: DataFrame, table: DataFrame) -> DataFrame:
    """Citations that name no slice of ``table(label, start_ms, end_ms)``, or a moment outside of it. A bare one is right only if there is one slice."""
    one = table.agg(F.count("*").alias("n"), F.min("label").alias("only"))
    named = cites.crossJoin(F.broadcast(one)).withColumn("label", F.coalesce("label", F.when(F.col("n") == 1, F.col("only")))).drop("n", "only")  # one row
    joined = named.join(table, "label", "left")
    why = F.when(F.col("label").isNull(), "form").when(F.col("start_ms").isNull(), "label").when(~F.col("offset_ms").between(F.col("start_ms"), F.col("end_ms")), "bounds")
    return joined.withColumn("why", why).where("why is not null").select("answer_id", "place", "cite", "why")


def structural_failures(claims: DataFrame, labels: DataFrame) -> DataFrame:
    """Claims(answer_id, claim_id, claim_type, supporting array<int>, label) that can't stand: inferences without or with unknown support, unknown labels."""
    known = claims.groupBy("answer_id").agg(F.collect_set("claim_id").alias("ids"))
    named = labels.select("label").distinct().withColumn("named", F.lit(True))
    out = claims.join(known, "answer_id").join(named, "label", "left")
    unknown = F.size(F.array_except(F.transform(F.coalesce("supporting", F.array()), lambda x: x.cast("long")), F.transform("ids", lambda x: x.cast("long")))) > 0
    none = (F.col("claim_type") == "INFERENCE") & (F.coalesce(F.size("supporting"), F.lit(0)) <= 0)
    why = F.when(none, "no support").when(unknown, "unknown support").when(F.expr("label is not null and named is null"), "unknown label")
    return out.withColumn("why", why).where("why is not null").select("answer_id", "claim_id", "why")


def groundedness(judged: DataFrame) -> DataFrame:
    """Of each answer: claims, mean and least groundedness, and the score mean * sqrt(n) / 100."""
    return judged.groupBy("answer_id").agg(F.count("*").alias("claims"), F.round(F.avg("groundedness_pct"), 1).alias("mean_pct"), F.min("groundedness_pct").alias("least_pct"), F.round(F.avg("groundedness_pct") * F.sqrt(F.count("*")) / 100, 2).alias("score"))


def judged(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each claim with the verdict it drew."""
    return claims.join(verdicts.select("answer_id", "claim_id", "groundedness_pct", "reasoning"), ["answer_id", "claim_id"])


def measured(rows: DataFrame, distant_ms: int = 2000) -> DataFrame:
    """Of each answer's judged claims all figures: counts, means by type, claims without a citation, and distances to screenshots.

    rows: claim_type, groundedness_pct, cited, and distance_ms, null where no screenshot is near.
    """
    by = rows.groupBy("answer_id", "claim_type").agg(F.round(F.avg("groundedness_pct"), 1).alias("mean")).groupBy("answer_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("claim_type", "mean")))).alias("by_type"))
    out = rows.groupBy("answer_id").agg(
        F.count("*").alias("claims"),
        F.count_if((F.col("claim_type") == "OBSERVATION") & ~F.col("cited")).alias("uncited"),
        F.round(F.avg("groundedness_pct"), 1).alias("mean_pct"),
        F.min("groundedness_pct").alias("least_pct"),
        F.round(F.avg("groundedness_pct") * F.sqrt(F.count("*")) / 100, 2).alias("score"),
        F.count_if(F.col("cited")).alias("with_span"),
        F.count_if(F.col("cited") & F.col("distance_ms").isNull()).alias("no_screenshot"),
        F.count_if(F.col("distance_ms") > distant_ms).alias("distant"),
        F.round(F.avg("distance_ms"), 0).cast("long").alias("mean_distance_ms"),
    )
    return out.join(by, "answer_id")


def citation_defects(answers: DataFrame, table: DataFrame) -> DataFrame:
    """Everything in brackets that looks like a time, and what is wrong with it: form, two slices, label, order or bounds.

    answers: (answer_id, window, text). table: (window, label, start_ms, end_ms), offsets on the window's clock.
    """
    exact = r"^(?:([A-Za-z]\w*) )?(\d{2,}):([0-5]\d)\.(\d{3})(?:,\s*(?:([A-Za-z]\w*) )?(\d{2,}):([0-5]\d)\.(\d{3}))?$"
    cites = answers.select("answer_id", "window", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[([^\[\]]*\d+:\d{2}[^\[\]]*)\]"), F.lit(1)))).alias("cite"))
    part = lambda k: F.nullif(F.regexp_extract("cite", exact, k), F.lit(""))
    ms = lambda k: part(k).cast("long") * 60000 + part(k + 1).cast("long") * 1000 + part(k + 2).cast("long")
    cites = cites.select("*", part(1).alias("label"), part(5).alias("label2"), ms(2).alias("from_ms"), ms(6).alias("to_ms"))
    slices = table.groupBy("window").agg(F.count("*").alias("slices"), F.min("label").alias("only"))
    rows = cites.join(slices, "window").withColumn("of", F.when(F.col("slices") == 1, F.col("only")).otherwise(F.col("label")))
    rows = rows.join(table.select("window", F.col("label").alias("of"), "start_ms", "end_ms"), ["window", "of"], "left")
    out = lambda c: ~F.coalesce(F.col(c).between(F.col("start_ms"), F.col("end_ms")), F.lit(True))
    why = (
        F.when(F.col("from_ms").isNull(), "form")
        .when(F.col("label2").isNotNull() & ~F.col("label2").eqNullSafe(F.col("label")), "two slices")
        .when((F.col("slices") > 1) & F.col("label").isNull(), "no label")
        .when((F.col("slices") == 1) & F.col("label").isNotNull(), "a label for the only slice")
        .when(F.col("start_ms").isNull(), "unknown label")
        .when(F.col("to_ms") < F.col("from_ms"), "order")
        .when(out("from_ms") | out("to_ms"), "bounds")
    )
    return rows.withColumn("why", why).where("why is not null").select("answer_id", "cite", "why")


def latest_answers(transcripts: DataFrame) -> DataFrame:
    """Of each analysis's numbered transcripts the path of the highest number, not of the last name."""
    number = F.regexp_extract("path", r"(\d+)[^/\d]*$", 1).cast("long")
    return transcripts.groupBy("analysis").agg(F.max_by("path", F.struct(number, "path")).alias("path"))


# ------------------------------------------------------------------ stores and sweeps
def minted_keys(chunks: DataFrame) -> DataFrame:
    """Keys of ``chunks(snippet, visitor_id, recorder_slice, counter)``, null where a part hasn't its shape; the day is the slice's own."""
    good = F.col("snippet").rlike(r"\A[a-z0-9]{3,64}\z") & F.col("visitor_id").rlike(r"\A[A-Za-z0-9_-]{8,64}\z") & X.is_slice_id("recorder_slice") & F.col("counter").rlike(r"\A\d{19}\z")
    key = F.concat(F.concat_ws("/", "snippet", X.utc_day(X.slice_open_ms("recorder_slice")), "visitor_id", "recorder_slice", "counter"), F.lit(".json.gz"))
    return chunks.withColumn("key", F.when(good, key))


def store_totals(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """One row over an inventory and its listing: what inventory_totals tells, when slices opened, and what is no recording."""
    foreign = objects.where("foreign").agg(F.count("*").alias("foreign_keys"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("foreign_bytes"))
    opened = X.slice_open_ms("recorder_slice")
    span = rows.agg(F.min(opened).alias("first_ms"), F.max(opened).alias("last_ms"))
    return inventory_totals(rows).crossJoin(span).crossJoin(foreign)  # one row each


def swept(cutoff: str, events: DataFrame, slices: DataFrame, errors: DataFrame, manifest: DataFrame) -> dict[str, DataFrame]:
    """What a retention sweep leaves of each table, and ``touched``, the visitors whose sessions must be derived anew.

    Slices that opened before the cutoff's day go, with the slices they took in, and with the events and errors of both; chunks go by their key's day.
    """
    day = X.utc_day(X.slice_open_ms("recorder_slice"))
    old = slices.where(day < cutoff)
    own = old.select("visitor_id", "recorder_slice")
    taken = old.select("visitor_id", F.explode(F.coalesce("absorbed", F.array().cast("array<string>"))).alias("recorder_slice"))
    gone = own.union(taken).distinct()
    keys = ["visitor_id", "recorder_slice"]
    date = F.get(F.split("key", "/"), F.lit(1))
    return {
        "events": events.join(gone, keys, "left_anti"),
        "slices": slices.join(gone, keys, "left_anti"),
        "errors": errors.join(gone, keys, "left_anti"),
        "manifest": manifest.where(~F.coalesce(date.rlike(r"^\d{4}-\d{2}-\d{2}$") & (date < cutoff), F.lit(False))),
        "touched": own.select("visitor_id").distinct(),
    }


def standing(slices: DataFrame, events: DataFrame) -> DataFrame:
    """Slices that still have events."""
    return slices.join(events.select("visitor_id", "recorder_slice").distinct(), ["visitor_id", "recorder_slice"], "left_semi")


def evicted(records: DataFrame, ceiling: int, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The oldest records that must go so that what is left of each key is no more than the ceiling of bytes."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("kept_bytes", F.sum("bytes").over(newest)).where(F.col("kept_bytes") > ceiling).drop("kept_bytes")


def live_bytes(uploads: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """One row: bytes of uploads that still stand."""
    return uploads.where(F.col("uploaded_at") + ttl_ms > now_ms).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def described(records: DataFrame) -> DataFrame:
    """Of each slice its records and their first and last counters, which are text."""
    return records.groupBy("visitor_id", "recorder_slice").agg(F.count("*").alias("records"), F.min("counter").alias("first"), F.max("counter").alias("last"))


def load_stats(decoded: DataFrame) -> DataFrame:
    """One row over decoded chunks: chunks, corrupt and lossy ones, events and rejects."""
    per = decoded.groupBy("key").agg(F.count_if(F.col("reason").isNull()).alias("events"), F.count_if(F.expr("reason is not null and visitor_id is null")).alias("corrupt"), F.count_if(F.expr("reason not like 'recorder: %' and visitor_id is not null")).alias("lossy"))
    return per.agg(
        F.count("*").alias("chunks"), F.count_if(F.col("corrupt") > 0).alias("corrupt"), F.count_if(F.col("lossy") > 0).alias("lossy"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.coalesce(F.sum("lossy"), F.lit(0)).alias("rejected")
    )


def recorder_errors(decoded: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """What recorders said went wrong, each once: (snippet, visitor_id, recorder_slice, chunk_key, error)."""
    rows = decoded.where("reason like 'recorder: %'").select("snippet", "visitor_id", "recorder_slice", F.col("key").alias("chunk_key"), F.expr("substring(reason, 11)").alias("error"))
    key = ["visitor_id", "chunk_key", "error"]
    one = rows.groupBy(*key).agg(F.min(F.struct("snippet", "recorder_slice")).alias("s")).select("s.snippet", "visitor_id", "s.recorder_slice", "chunk_key", "error")
    return one if held is None else one.join(held.select(*key), key, "left_anti").select(one.columns)


def layered(urls: DataFrame, rules: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """Options of each ``url``: of all rules whose pattern it matches, in order, later ones before earlier ones.

    rules: a regular expression and its options; an option within another is named like mask.email, so it is layered by itself.
    """
    options = F.create_map().cast("map<string,string>")
    for pattern, own in rules:
        new = F.create_map(*(F.lit(x) for p in own.items() for x in p)) if own else F.create_map().cast("map<string,string>")
        over = F.map_concat(F.map_filter(options, lambda k, v: ~k.isin(*own)), new)  # noqa: B023
        options = F.when(F.col("url").rlike(pattern), over).otherwise(options)
    return urls.withColumn("options", options)


def appended(ledger: DataFrame, path: str) -> None:
    """Adds calls to a JSON-lines ledger as files of their own: no writer waits for another, and none rewrites what stands."""
    ledger.write.mode("append").json(path)
