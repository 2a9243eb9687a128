from tracewell.operators import sessions
from tracewell.schema import SessionRule

G = 30 * 60 * 1000


def acts(spark, rows):
    return spark.createDataFrame([(v, s, t, f"{t:019d}", k) for v, s, t, k in rows], "visitor_id string, snippet string, timestamp long, counter string, type_str string")


def test_a_gap_of_exactly_the_threshold_holds(spark):
    out = sessions.sessions(acts(spark, [("v", "s", t, "Click") for t in (0, G, 2 * G + 1)])).orderBy("start_ts").collect()
    assert [(r.start_ts, r.end_ts) for r in out] == [(0, G), (2 * G + 1, 2 * G + 1)]


def test_active_time_adds_stretches(spark):
    out = sessions.sessions(acts(spark, [("v", "s", t, "Click") for t in (0, 4000, 9000, 60000, 62000)])).first()
    assert out.user_activity_ms == 11000


def test_engaged_is_strict_in_time_and_not_in_pages(spark):
    rows = [("a", "s", 0, "PageLoad"), ("a", "s", 10000, "Click"), ("b", "s", 0, "PageLoad"), ("b", "s", 10001, "Click"), ("c", "s", 0, "PageLoad"), ("c", "s", 1, "PageLoad")]
    out = {r.visitor_id: r.engaged for r in sessions.sessions(acts(spark, rows)).collect()}
    assert out == {"a": 0, "b": 1, "c": 1}


def test_a_bridge_merges_two_sessions(spark):
    far = [("v", "s", 0, "PageLoad"), ("v", "s", 50 * 60000, "PageLoad")]
    assert sessions.sessions(acts(spark, far)).count() == 2
    one = sessions.sessions(acts(spark, [*far, ("v", "s", 25 * 60000, "Click")])).collect()
    assert len(one) == 1 and one[0].pageviews == 2


def test_stamps_agree_with_the_range_join_and_null_sites_stay_apart(spark):
    rows = [("v", s, t, "Click") for s in ("s", None) for t in (0, 40 * 60000, 200 * 60000)]
    found = sessions.sessions(acts(spark, rows))
    probe = acts(spark, [("v", s, t, "Mutation") for s in ("s", None) for t in range(-G, 260 * 60000, 7 * 60000)])
    a = {(r.snippet, r.timestamp): r.session_start for r in sessions.stamped(probe, found).collect()}
    b = {(r.snippet, r.timestamp): r.session_start for r in sessions.stamped_by_range(probe, found).collect()}
    assert a == b and None in a.values() and len(set(a.values())) == 4


def test_session_window_agrees(spark):
    rows = [("v", "s", t, "Click") for t in (0, G, 2 * G + 1, 5 * G)]
    a = {(r.start_ts, r.end_ts) for r in sessions.sessions(acts(spark, rows)).collect()}
    assert a == {(r.start_ts, r.end_ts) for r in sessions.by_session_window(acts(spark, rows)).collect()}


def test_the_order_of_arrival_does_not_matter(spark):
    rows = [("v", "s", t * 997 % 90000 * 60, "Click") for t in range(60)]
    a = sorted(map(tuple, sessions.sessions(acts(spark, rows)).collect()))
    assert a == sorted(map(tuple, sessions.sessions(acts(spark, rows[::-1]).repartition(3)).collect()))


def test_rules_refuse_nonsense():
    import pytest

    with pytest.raises(ValueError):
        SessionRule(gap_ms=0)
