"""Flat rows and telemetry points against plain versions and worked cases."""

import json
import re

import pytest

from tracewell.operators import flat, telemetry

E = {"type": 3, "timestamp": 1}


def rows(spark, *events):
    df = spark.createDataFrame([(k, e if isinstance(e, str) or e is None else json.dumps(e)) for k, e in enumerate(events)], "id int, raw string")
    return [r.asDict() for r in flat.flattened(df).orderBy("id").collect()]


def test_wrong_types_are_counted_and_dropped(spark):
    a, b, c = rows(
        spark,
        {"type": 4, "data": {"href": {"no": 1}, "width": 10, "title": 5}},
        {**E, "data": {"source": 2, "type": 2, "x": "1", "y": 2.5, "pointerType": "pen"}},
        {**E, "data": {"source": 5, "id": 3, "text": 7, "isChecked": True}},
    )
    assert (a["url"], a["title"], a["extra"], a["wrong_typed"]) == (None, None, '{"width":10}', 2)
    assert (b["type_str"], b["x"], b["y"], b["pointer_type"], b["wrong_typed"]) == ("Click", None, 3, None, 2)
    assert (c["input"], c["extra"], c["wrong_typed"]) == (None, None, 1)


def test_inputs(spark):
    a, b, c, d = rows(
        spark,
        {**E, "data": {"source": 5, "id": 3, "text": "x" * 20_001, "isChecked": False, "userTriggered": False}},
        {**E, "data": {"source": 5, "id": 3, "isChecked": True}},
        {**E, "data": {"source": 5, "id": 3, "text": None, "isChecked": None}},
        {**E, "data": {"source": 5, "id": 3}},
    )
    assert a["input"] == "x" * 19_999 + "…" and json.loads(a["extra"]) == {"userTriggered": False, "input_chars": 20_001}
    assert (b["input"], b["wrong_typed"]) == ("true", 0)
    assert (c["input"], c["wrong_typed"]) == (None, 1)
    assert (d["input"], d["wrong_typed"]) == (None, 0)


def test_moves_stand_where_they_end(spark):
    a, b, c = rows(
        spark,
        {**E, "data": {"source": 1, "positions": [{"x": 1, "y": 1}, {"x": -2.5, "y": 0.4}]}},
        {**E, "data": {"source": 6, "positions": []}},
        {**E, "data": {"source": 12, "positions": [{"x": "far", "y": 1}]}},
    )
    assert (a["type_str"], a["x"], a["y"]) == ("MouseMove", -2, 0)
    assert (b["x"], b["y"]) == (None, None)
    assert (c["x"], c["y"], c["wrong_typed"]) == (None, 1, 1)


def test_kinds_extra_and_broken_events(spark):
    a, b, c, d, e, f = rows(
        spark,
        {"type": 72, "data": {"userId": "u1", "list": [1], "note": "n" * 300}},
        {"type": 5, "data": {"userId": "u1", "image": "data:text/plain;base64," + "A" * 3000, "d": "path", "n": None, "deep": {"a": 1}, "ok": True, "f": 1.5}},
        {**E, "data": {"source": 2, "type": 99}},
        {"type": 88},
        "no json",
        None,
    )
    assert (a["type_str"], a["user_id"]) == ("Identify", "u1") and json.loads(a["extra"]) == {"note": "n" * 199 + "…"}
    extra = json.loads(b["extra"])
    assert b["user_id"] is None and set(extra) == {"userId", "image", "ok", "f"} and len(extra["image"]) == 2000 and extra["f"] == 1.5
    assert (c["type_str"], d["type_str"]) == ("MouseInteraction:99", "88")
    assert all(x["type_str"] is None and x["wrong_typed"] == 0 for x in (e, f))


def cut(blobs, budget):
    out = []
    for b in blobs:
        raw = b.encode()
        kept = raw[:budget].decode("utf-8", "ignore") if budget > 0 else ""
        budget -= len(kept.encode())
        out.append(kept)
    return out


def test_blobs_fit_their_budget(spark):
    cases = [["a" * 10, "é" * 10, "z"], ["€" * 9, "x"], ["\U0001f9ff" * 5, "ab", ""], ["", "", ""], ["a" * 13, "b" * 9, "c"]]
    from pyspark.sql import functions as F

    for budget in (11, 12, 13, 14, 40):
        df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "id int, blobs array<string>")
        got = {r["id"]: r["out"] for r in df.select("id", telemetry.fitted(F.col("blobs"), budget).alias("out")).collect()}
        assert got == {k: cut(c, budget) for k, c in enumerate(cases)}


def test_pings(spark):
    s = "00001700000000-ab12"
    given = [
        ({"metric": "page_load", "sliceId": s, "url": "u", "referrer": "", "spaRoute": True, "ts": 5}, None),
        ({"metric": "page_load", "sliceId": "x", "url": "u", "referrer": "", "spaRoute": True}, "sliceId"),
        ({"metric": "cost_sample", "sliceId": None, "mainThreadMs": 1, "uploadBytes": 2, "heapBytesMax": None}, None),
        ({"metric": "cost_sample", "mainThreadMs": 1, "uploadBytes": 2}, "sliceId"),
        ({"metric": "cost_sample", "sliceId": s, "mainThreadMs": "1", "uploadBytes": 2}, "mainThreadMs"),
        ({"metric": "slice_started", "sliceId": s, "url": "u", "first_slice": True, "internal": False, "recorderVersion": "2"}, None),
        ({"metric": "other"}, "unknown metric"),
        ({"x": 1}, "no metric"),
        ("[", "no object"),
    ]
    rows = [(k, p if isinstance(p, str) else json.dumps(p), "visitor", "abc", "o", "ua", None) for k, (p, _) in enumerate(given)]
    got = telemetry.points(spark.createDataFrame(rows, "id int, ping string, visitor_id string, snippet string, origin string, user_agent string, as_organization string")).orderBy("id").collect()
    assert [r["reason"] for r in got] == [reason for _, reason in given]
    assert got[0]["blobs"] == ["page_load", "visitor", s, "", "o", "ua", "", "u", "", "1"] and got[0]["doubles"] == [5.0]
    assert got[2]["doubles"] == [1.0, 2.0, -1.0, -1.0, -1.0, -1.0, -1.0, -1.0]
    assert got[5]["blobs"][3] == "2" and got[5]["blobs"][7:] == ["u", "1", "", "", "0"] and got[5]["doubles"] == [1_700_000_000.0]


def test_moments_in_sql(spark):
    assert telemetry.expanded_ms("x > ms('2024-01-01') AND y < ms( '1704067200001' )") == "x > 1704067200000 AND y < 1704067200001"
    with pytest.raises(ValueError):
        telemetry.expanded_ms("ms('1704067200')")
    points = spark.createDataFrame([(1_704_067_200_000, 2.0)], "timestamp long, double1 double")
    assert not telemetry.answer(spark, "select sum(double1) as s from telemetry where timestamp >= ms('2024-01-01')", points)["nothing"]
    empty = telemetry.answer(spark, "select count(*) as n from telemetry where timestamp >= ms('2025-01-01')", points)
    assert empty["nothing"] and empty["latest"] == 1_704_067_200_000


def test_fields_are_looked_at_once(spark):
    """Types of fields are told without patterns, and the event's source is taken out once."""
    df = spark.createDataFrame([(1, None)], "id int, raw string")
    plan = flat.flattened(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "schemaOfVariant" in plan
    assert len(re.findall(r"element_at\(_data#\d+, source", plan)) == 1


def test_long_inputs_are_cut_by_characters(spark):
    given = ["é" * 10_001, "é" * 20_000, "\U0001f9ff" * 20_000, "\U0001f9ff" * 20_001, "x" * 19_999 + "éé"]
    for text, out in zip(given, rows(spark, *({**E, "data": {"source": 5, "id": 3, "text": t}} for t in given)), strict=True):
        cut = len(text) > 20_000
        assert out["input"] == (text[:19_999] + "…" if cut else text) and out["extra"] == (f'{{"input_chars":{len(text)}}}' if cut else None)
