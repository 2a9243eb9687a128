"""Versions of tables: what readers see amid writes, after broken and rival ones, and what is derived anew."""

import pytest
from pyspark.sql import functions as F
from test_engine import MIN, T0, Recorder, click, page, stamp

from tracewell import engine as engines
from tracewell.engine import Engine
from tracewell.operators import books
from tracewell.schema import SessionRule
from tracewell.sources import chunks
from tracewell.sources.snapshots import Conflict, Snapshots

TABLES = ("events", "slices", "sessions", "manifest", "errors")


@pytest.fixture
def loaded(spark, tmp_path):
    r = Recorder(tmp_path / "store")
    for v in range(6):
        r.chunk(f"visitor0{v}", stamp(T0 - 1), [*page(r, T0), click(r, T0 + 15_000), click(r, T0 + 25 * MIN)], errors=["broke"])
    e = Engine(spark, str(tmp_path / "tables"), str(tmp_path / "store"), buckets=3)
    e.load()
    return e, r


def state(e):
    return {name: sorted(map(str, e.table(name).drop("bucket").collect())) for name in TABLES}


def more(r):
    for v in (1, 7):
        r.chunk(f"visitor0{v}", stamp(T0 - 1), [*page(r, T0 + 60 * MIN), click(r, T0 + 61 * MIN)], errors=["again"])


def test_a_reader_keeps_its_version_and_a_dead_writer_leaves_none(loaded, monkeypatch):
    e, r = loaded
    reader, before = e.at(), state(e)
    more(r)
    real = Snapshots.staged

    def dies(self, name, df):
        if name == "sessions":
            assert state(reader) == state(e.at()) == before  # amid the load
            raise KeyboardInterrupt
        return real(self, name, df)

    monkeypatch.setattr(Snapshots, "staged", dies)
    with pytest.raises(KeyboardInterrupt):
        e.load()
    monkeypatch.setattr(Snapshots, "staged", real)
    assert state(e) == before and e.snapshots.latest() == 1
    assert e.load()["new"] == 8
    assert state(reader) == before != state(e)
    assert state(e.at(1)) == before and e.at(1).sql("select count(*) as n from events").first()["n"] == 30
    with pytest.raises(ValueError):
        reader.load()
    # what the dead writer and the first version left goes, what stands stays
    after = state(e)
    assert e.snapshots.vacuum(keep=1, older_than_ms=-60_000) > 0
    assert state(e) == after and e.snapshots.versions() == [2]


def test_two_writers_cannot_take_one_number(loaded, spark):
    e, _ = loaded
    s = e.snapshots
    base = s.latest()
    parts = s.staged("errors", e.table("errors").limit(0))
    assert s.publish(base, {"errors": parts}) == base + 1
    with pytest.raises(Conflict):
        s.publish(base, {"errors": []})
    assert e.table("errors").count() == 0 and e.table("events").count() == 30
    assert {(x["version"], x["table"]) for x in s.history().collect()} == {(v, t) for v in (1, 2) for t in TABLES}


def test_another_rule_derives_sessions_and_stamps_alone(loaded, spark, tmp_path, monkeypatch):
    e, r = loaded
    wider = SessionRule(gap_ms=10 * MIN)
    other = Engine(spark, e.folder, e.store, wider, buckets=3)
    assert list(other.stale()) == ["sessions"] and not e.stale()
    assert dict(map(tuple, other.doctor().collect()))["vintage"] is False
    before, slices_of = e.snapshots.commit(1)["tables"], other.table("slices")
    monkeypatch.setattr(engines, "_flat", None)  # isn't called
    monkeypatch.setattr(Engine, "_slices", None)
    assert sorted(other.refresh()) == ["sessions"]
    monkeypatch.undo()
    after = e.snapshots.commit(2)["tables"]
    assert after["slices"] == before["slices"] and after["manifest"] == before["manifest"]
    assert not set(after["sessions"]) & set(before["sessions"]) and not set(after["events"]) & set(before["events"])
    assert not other.stale() and slices_of.count() == 6
    fresh = Engine(spark, str(tmp_path / "other"), e.store, wider, buckets=3)
    fresh.load()
    ours, theirs = state(other), state(fresh)
    assert ours == theirs and len(ours["sessions"]) == 12
    assert other.refresh() == {} and e.snapshots.latest() == 2


def test_changed_code_runs_again_from_its_stage_on():
    now = {s: "x" for s in engines.STAGES}
    assert engines.stale_stages(now, now) == []
    assert engines.stale_stages(now | {"sessions": "old"}, now) == ["sessions", "stamps"]
    assert engines.stale_stages(now | {"stamps": "old"}, now) == ["stamps"]
    assert engines.stale_stages(now | {"slices": "old"}, now) == ["slices", "sessions", "stamps"]
    assert engines.stale_stages({}, now) == list(engines.STAGES)


def test_the_doctor_heals(loaded):
    e, r = loaded
    want = state(e)
    # one visitor's slices and flat columns go missing
    one = e.table("events").withColumn("type_str", F.when(F.col("visitor_id") != "visitor03", F.col("type_str")))
    parts = {"events": e.snapshots.staged("events", one), "slices": e.snapshots.staged("slices", e.table("slices").where("visitor_id <> 'visitor03'"))}
    e.snapshots.publish(1, parts)
    bad = {c["name"] for c in e.doctor().collect() if not c["ok"]}
    assert {"flat", "slices"} <= bad and len(e.unfinished()) == 1
    assert all(c["ok"] for c in e.doctor(heal=True).collect())
    assert state(e) == want
    old = "2023-11-20"
    assert not all(c["ok"] for c in e.doctor(old).collect())
    assert all(c["ok"] for c in e.doctor(old, heal=True).collect()) and e.table("events").count() == 0


def test_appended_manifests_are_put_together(loaded, monkeypatch):
    e, r = loaded
    monkeypatch.setattr(engines, "FOLDERS", 2)
    for v in range(3):
        r.chunk("visitor00", stamp(T0 - 1), [click(r, T0 + (30 + v) * MIN)])
        assert e.load()["new"] == 1
    assert e.table("manifest").count() == 9 and len(e.snapshots.commit(4)["tables"]["manifest"]) <= 2
    assert e.load()["chunks"] == 0


def test_what_is_observed_while_decoding_equals_load_stats(spark, tmp_path):
    from pyspark.sql import Observation

    r = Recorder(tmp_path / "store")
    r.chunk("visitor01", stamp(T0), [*page(r, T0), {"type": "x"}, {"type": 3}], errors=["a", "b"])
    r.chunk("visitor01", stamp(T0), [click(r, T0)])
    r.chunk("visitor02", stamp(T0), [{"type": "x"}])
    r.chunk("visitor03", stamp(T0), "none")
    (tmp_path / "store" / "abc" / "2023-11-14" / "visitor01" / stamp(T0) / "9.json.gz").write_bytes(b"junk")
    none = spark.createDataFrame([], "key string, etag string, uploaded_ms long")
    told = Observation()
    rows = chunks.decoded(chunks.new_objects(spark, str(tmp_path / "store"), none)).observe(told, *chunks.decode_stats()).cache()
    rows.count()
    assert told.get == books.load_stats(rows).first().asDict() == {"chunks": 5, "corrupt": 2, "lossy": 2, "events": 4, "rejected": 3}
