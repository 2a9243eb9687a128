from pyspark.sql import functions as F

from tracewell.operators import slices, spans

EVENT = "id long, visitor_id string, recorder_slice string, timestamp long, counter string, type int, href string, width int, height int, root_id int, snippet string"


def events(spark, rows):
    return spark.createDataFrame([(i, "v", s, t, f"{t:013d}{i:06d}", k, h, w, w, r, "s") for i, (s, t, k, h, w, r) in enumerate(rows)], EVENT)


def covered(s, t, href="u"):
    return [(s, t, 4, href, 100, None), (s, t + 1, 2, None, None, 1)]


def test_status_and_reasons(spark):
    rows = covered("a", 10) + [("b", 100, 4, "u", 9, None), ("b", 101, 3, None, None, None)] + [("c", 200, 3, None, None, None)]
    rows += [("d", 300, 4, "u", 0, None), ("d", 301, 2, None, None, 1)] + [("e", 400, 4, "u", 9, None), ("e", 401, 2, None, None, None)]
    rows += [("f", 500, 3, None, None, None), *covered("f", 510)]
    out = {r.recorder_slice: (r.status, r.reason) for r in slices.materialised(events(spark, rows)).collect()}
    assert out == {
        "a": ("replayable", None), "b": ("discarded", slices.ORPHAN), "c": ("discarded", slices.NO_SNAPSHOT), "d": ("discarded", slices.NO_VIEWPORT), "e": ("discarded", slices.DAMAGED), "f": ("replayable", None),
    }


def test_a_chain_of_orphans_is_judged_on_what_grew(spark):
    rows = covered("1", 1000) + [("2", 9000, 4, "u", 9, None)] + [("3", 18000, 4, "u", 9, None)] + [("4", 40000, 4, "u", 9, None)] + [("5", 41000, 4, "x", 9, None)]
    found = slices.opened_page(slices.materialised(events(spark, rows)), F.lit(10**12))
    out = {r.recorder_slice: r for r in slices.rescued(found).collect()}
    assert [out[k].status for k in "12345"] == ["replayable", "rescued", "rescued", "discarded", "discarded"]
    assert out["1"].absorbed == ["2", "3"] and out["1"].end_ts == 18000


def test_forward_fill_ignores_empty_addresses(spark):
    e = events(spark, [("a", 1, 4, None, 1, 1), ("a", 2, 4, "p", 1, 1), ("a", 3, 4, "", 1, 1), ("b", 4, 4, None, 1, 1)]).withColumn("url", F.col("href"))
    assert [r.page_url for r in slices.filled_page_url(e).orderBy("id").collect()] == [None, "p", "p", None]


def test_a_null_stamp_is_an_error(spark):
    import pytest

    with pytest.raises(Exception, match="no slice"):
        slices.materialised(events(spark, [(None, 1, 4, "u", 1, 1)])).collect()


def test_spans_merge_with_their_pads(spark):
    s = spark.createDataFrame([("v", 10000, 11000), ("v", 12000, 13000), ("v", 90000, 90001)], "visitor_id string, start_ts long, end_ts long")
    assert [(r.start_ts, r.end_ts) for r in spans.merged(s, ("visitor_id",)).orderBy("start_ts").collect()] == [(8000, 15000), (88000, 92001)]


def test_lanes_take_the_lowest_that_is_free(spark):
    s = spark.createDataFrame([("v", "a", 0, 10), ("v", "b", 5, 20), ("v", "c", 10, 12), ("v", "d", 11, 30)], "visitor_id string, recorder_slice string, start_ts long, end_ts long")
    assert {r.recorder_slice: r.lane for r in spans.lanes(s).collect()} == {"a": 0, "b": 1, "c": 0, "d": 2}


def test_moments_outside_of_what_was_recorded(spark):
    s = spark.createDataFrame([("v", 100, 200, 110), ("v", 300, 400, 300)], "visitor_id string, start_ts long, end_ts long, snapshot_ts long")
    m = spark.createDataFrame([("v", t) for t in (50, 105, 150, 250, 350)], "visitor_id string, timestamp long")
    assert [r.why for r in spans.showable(m, s).orderBy("timestamp").collect()] == ["outside", "lead", None, "gap", None]


def test_greedy_groups_admit_a_large_row_alone(spark):
    r = spark.createDataFrame([("v", i, n) for i, n in enumerate([3, 3, 9, 2, 2])], "visitor_id string, at int, n long")
    out = spans.greedy_groups(r, ("visitor_id",), ("at",), "n", 6).orderBy("at").collect()
    assert [x.group for x in out] == [0, 0, 1, 2, 2]
