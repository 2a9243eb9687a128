"""The load job and the verbs over small stores."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tracewell.engine import Engine
from tracewell.operators import windows
from tracewell.streaming import ingest

T0 = 1_700_000_000_000
MIN = 60_000


def stamp(ms):
    return f"{ms:014d}-ab12"


class Recorder:
    def __init__(self, root):
        self.root, self.seq = root, 0

    def event(self, t, type_, **data):
        self.seq += 1
        return {"type": type_, "timestamp": t, "counter": f"{t:013d}{self.seq:06d}", "data": data}

    def chunk(self, visitor, slice_, events, site="abc", errors=()):
        self.seq += 1
        path = self.root / site / "2023-11-14" / visitor / slice_ / f"{self.seq:019d}.json.gz"
        path.parent.mkdir(parents=True, exist_ok=True)
        body = {"visitorId": visitor, "sliceId": slice_, "recorderVersion": "1", "envelope": {"language": "en"}, "events": events, "errors": list(errors)}
        path.write_bytes(gzip.compress(json.dumps(body).encode()))


def page(r, t, url="https://a.test/1"):
    return [r.event(t, 4, href=url, width=100, height=50), r.event(t + 1, 2, node={"id": 1}), r.event(t + 50, 69, url=url, referrer="https://b.test/")]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "tables"), str(tmp_path / "store"), buckets=4)


def click(r, t):
    return r.event(t, 3, source=2, type=2, id=5, x=1, y=2)


def test_load_derives_and_loads_nothing_twice(engine, tmp_path):
    r = Recorder(tmp_path / "store")
    one = stamp(T0 - 1)
    r.chunk("visitor01", one, [*page(r, T0), click(r, T0 + 15_000), r.event(T0 + 20 * MIN, 71, url="x"), r.event(T0 + 180 * MIN, 3, source=5, id=1, text="s", userTriggered=False), click(r, T0 + 300 * MIN)], errors=["broke"])
    r.chunk("visitor02", stamp(T0 + 5), [r.event(T0 + 5, 71, url="x")])
    got = engine.load()
    assert (got["chunks"], got["events"], got["new"], got["corrupt"]) == (2, 8, 8, 0)
    found = sorted((s["visitor_id"], s["start_ts"], s["pageviews"]) for s in engine.table("sessions").collect())
    # two visits; the one that left a hidden marker alone is a bounce
    assert found == [("visitor01", T0 + 50, 1), ("visitor01", T0 + 300 * MIN, 0), ("visitor02", T0 + 5, 1)]
    stamps = {e["timestamp"] - T0: e["session_start"] for e in engine.table("events").where("visitor_id = 'visitor01'").collect()}
    assert stamps[0] == stamps[20 * MIN] == T0 + 50 and stamps[180 * MIN] is None and stamps[300 * MIN] == T0 + 300 * MIN
    assert {(s["visitor_id"], s["status"], s["reason"]) for s in engine.table("slices").collect()} == {("visitor01", "replayable", None), ("visitor02", "discarded", "no snapshot")}
    assert [e["error"] for e in engine.table("errors").collect()] == ["broke"]
    assert engine.load()["chunks"] == 0
    assert all(c["ok"] for c in engine.doctor().collect())
    assert engine.sql("select count(*) as n from events where type_str = 'Click'").first()["n"] == 2
    rows, totals = engine.inventory()
    assert rows.count() == 2 and totals.first()["new"] == 0


def test_a_late_chunk_merges_visits(engine, tmp_path):
    r = Recorder(tmp_path / "store")
    s = stamp(T0 - 1)
    r.chunk("visitor01", s, [*page(r, T0), *page(r, T0 + 50 * MIN)])
    engine.load()
    assert engine.table("sessions").count() == 2
    r.chunk("visitor01", s, [click(r, T0 + 25 * MIN)])
    assert engine.load()["new"] == 1
    (one,) = engine.table("sessions").collect()
    assert one["pageviews"] == 2
    assert engine.table("events").count() == 7


def test_corrupt_chunks_are_read_again(engine, tmp_path):
    r = Recorder(tmp_path / "store")
    r.chunk("visitor01", stamp(T0 - 1), [*page(r, T0), {"type": "x"}])
    assert engine.load()["rejected"] == 1
    again = engine.load()
    assert (again["chunks"], again["lossy"], again["new"]) == (1, 1, 0)


def test_expire_takes_events_errors_and_visits(engine, tmp_path):
    r = Recorder(tmp_path / "store")
    r.chunk("visitor01", stamp(T0 - 1), page(r, T0), errors=["old"])
    day = 86_400_000
    r.chunk("visitor01", stamp(T0 + 3 * day), page(r, T0 + 3 * day + 1))
    engine.load()
    out = engine.expire("2023-11-16")
    assert (out["events"], out["visitors"]) == (3, 1)
    assert engine.table("events").count() == 3 and engine.table("sessions").count() == 1 and engine.table("errors").count() == 0
    assert {s["recorder_slice"] for s in engine.table("slices").collect()} == {stamp(T0 + 3 * day)}
    assert all(c["ok"] for c in engine.doctor("2023-11-16").collect())


def test_analyze_composes_a_window(engine, spark, tmp_path):
    r = Recorder(tmp_path / "store")
    a, b = stamp(T0 - 1), stamp(T0 + 10 * MIN)
    r.chunk("visitor01", a, [*page(r, T0), click(r, T0 + 5000)])
    r.chunk("visitor01", b, page(r, T0 + 10 * MIN + 1, "https://a.test/2"))
    engine.load()
    asked = spark.createDataFrame([("w", "visitor01", b), ("w", "visitor01", "nothing")], "window string, visitor_id string, recorder_slice string")
    out = engine.analyze(asked)
    assert {(x["label"], x["reason"]) for x in out["table"].collect()} == {("S1", None), (None, "unknown")}
    context = out["context"].where(F.col("recorder_slice") == b).first()["context"]
    assert context == "Prior page: https://a.test/1, left 9m55s before this recording.\nReferrer: https://b.test/.\nNext page: none recorded."
    lines = [x["line"] for x in out["stream"].orderBy("place").collect()]
    assert lines[0].startswith("Meta https://a.test/2") and "screenshot" in lines
    assert {x["label"] for x in out["price"].collect()} == {"S1", None}


def test_walls(spark):
    rows = [("a", "v", "s1", 0, 10, None), ("a", "v", "s2", 5, 20, None), ("b", "v", "s1", 0, 10, None), ("b", "w", "s3", 30, 40, None), ("c", "v", "s1", 0, 10, "unknown"), ("d", "v", "s1", 0, 10, None)]
    table = spark.createDataFrame(rows, "window string, visitor_id string, recorder_slice string, start_ts long, end_ts long, reason string")
    assert dict(map(tuple, windows.window_walls(table).collect())) == {"a": "slices overlap", "b": "several visitors", "c": "a slice is refused"}


def test_routes_across_batches(spark, tmp_path):
    given = tmp_path / "in"
    rows = lambda *xs: spark.createDataFrame([("v", t, f"{t:019d}", u) for t, u in xs], "visitor_id string, timestamp long, counter string, url string").coalesce(1)
    rows((T0, "https://a.test/1"), (T0 + 1, "https://a.test/1?q=1")).write.mode("append").parquet(str(given))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        source = spark.readStream.schema("visitor_id string, timestamp long, counter string, url string").parquet(str(given))
        ingest.live_routes(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["route"] for r in spark.read.parquet(out).collect())

    assert run() == ["https://a.test/1"]
    rows((T0 + 2, "https://a.test/1"), (T0 + 3, "https://a.test/2")).write.mode("append").parquet(str(given))
    assert run() == ["https://a.test/1", "https://a.test/2"]


def test_an_orphan_goes_on_only_where_all_it_names_is(engine, tmp_path):
    """Three slices on one page: the second names what the first left, the third a node that was never there."""
    r = Recorder(tmp_path / "store")
    a, b, c = stamp(T0 - 1), stamp(T0 + 2000), stamp(T0 + 4000)  # the latter open with a Meta of the same page
    button = {"type": 2, "id": 5, "tagName": "BUTTON", "attributes": {"class": "big"}, "childNodes": [{"type": 3, "id": 6, "textContent": " Buy  now "}]}
    body = {"type": 0, "id": 1, "childNodes": [{"type": 2, "id": 4, "tagName": "A", "attributes": {"href": "/buy"}, "childNodes": [button]}]}
    meta = lambda t: r.event(t, 4, href="https://a.test/1", width=100, height=50)
    r.chunk("visitor01", a, [meta(T0), r.event(T0 + 1, 2, node=body), click(r, T0 + 500)])
    r.chunk("visitor01", b, [meta(T0 + 2000), click(r, T0 + 2100)])
    r.chunk("visitor01", c, [meta(T0 + 4000), r.event(T0 + 4100, 3, source=2, type=2, id=77)])
    engine.load()
    got = {s["recorder_slice"]: (s["status"], s["into"], s["n_events"]) for s in engine.table("slices").collect()}
    assert got == {a: ("replayable", None, 5), b: ("rescued", a, 2), c: ("discarded", None, 2)}
    # clicks of both are on the button, as the second is read where it went on
    of = {(x["recorder_slice"], x["timestamp"] - T0): (x["target_id"], x["tag"], x["class"], x["href"], x["text"]) for x in engine.targets().collect()}
    assert of == {(a, 500): (5, "button", "big", "/buy", "Buy now"), (b, 2100): (5, "button", "big", "/buy", "Buy now")}
    asked = engine.spark.createDataFrame([("visitor01", b)], "visitor_id string, recorder_slice string")
    assert [x["text"] for x in engine.targets(asked).collect()] == ["Buy now"]
