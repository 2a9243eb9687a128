"""Scans in stretches against plain windows, with a visitor that holds a third of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import scans, sessions, slices
from tracewell.plans import catalog, evidence  # noqa: F401
from tracewell.schema import SessionRule

SF = "/root/testdata/sf0.001"


@pytest.fixture
def short_stretches(monkeypatch):
    monkeypatch.setattr(scans, "SEGMENT", 40)


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(11)
    out, t = [], {}
    for i in range(1500):
        visitor = r.choice(["hot", None]) if r.random() < 0.5 else f"v{r.randrange(30)}"
        t[visitor] = t.get(visitor, 0) + r.choice([0, 1, 50, 2000, 9000, 40 * 60_000])
        out.append((i, visitor, r.choice(["s", "s", None]) if visitor != "hot" else "s", t[visitor], f"{i:019d}", r.choice(["Click", "PageLoad", "Input"]), r.choice([None, None, None, "", "/a", "/b"]), r.choice([None, 1, 5])))
    return spark.createDataFrame(out, "id long, visitor_id string, snippet string, timestamp long, counter string, type_str string, url string, n long").cache()


def test_scans_equal_plain_windows(rows, short_stretches):
    keys, order = ("visitor_id", "snippet"), ("timestamp", "counter")
    o = scans.Ordered.of(rows, keys, order)
    assert o.long is not None and o.stretches >= 10
    # a visitor's rows lie in as many tasks as it has stretches
    lie = o.long.where("visitor_id = 'hot'").groupBy("_stretch").count().collect()
    assert len(lie) >= 5 and max(x["count"] for x in lie) <= 120
    got = o.with_lag("before", F.col("n")).with_last("known", F.col("url")).with_total("sum", F.col("n")).with_total("place", F.lit(1)).rows()
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("before", F.lag("n").over(w)).withColumn("known", F.last("url", ignorenulls=True).over(upto)).withColumn("sum", F.sum("n").over(upto)).withColumn("place", F.row_number().over(w))
    columns = ["id", "before", "known", "place"]
    a, b = ({x["id"]: tuple(x) for x in df.select(*columns, F.coalesce("sum", F.lit(0)).alias("sum")).collect()} for df in (got, want))
    assert a == b


@pytest.mark.parametrize("name", ["session_summary", "session_gap_12h", "session_stamp", "page_url_ffill", "canonical_order", "viewport_asof"])
def test_queries_are_the_same_in_stretches(spark, monkeypatch, name):
    plain = catalog.QUERIES[name](spark, SF)
    want = sorted(map(str, plain.collect()))
    monkeypatch.setattr(scans, "SEGMENT", 15)
    split = catalog.QUERIES[name](spark, SF)
    assert split.dtypes == plain.dtypes and sorted(map(str, split.collect())) == want


def test_sessions_and_stamps_of_a_hot_visitor(rows, monkeypatch):
    rule = SessionRule()
    plain = sorted(map(str, sessions.sessions(rows, rule).collect()))
    stamps = sorted(map(str, sessions.stamped(rows, sessions.sessions(rows, rule), rule).collect()))
    pages = sorted(map(str, slices.last_known(rows, F.nullif("url", F.lit("")), "page_url", ("visitor_id",)).collect()))
    monkeypatch.setattr(scans, "SEGMENT", 25)
    assert sorted(map(str, sessions.sessions(rows, rule).collect())) == plain
    assert sorted(map(str, sessions.stamped(rows, sessions.sessions(rows, rule), rule).collect())) == stamps
    assert sorted(map(str, slices.last_known(rows, F.nullif("url", F.lit("")), "page_url", ("visitor_id",)).collect())) == pages


def test_many_long_keys_meet_in_a_shuffle(rows, short_stretches, monkeypatch):
    monkeypatch.setattr(scans, "KNOWN", 1)
    got = scans.Ordered.of(rows, ("visitor_id",), ("timestamp", "counter")).with_total("place", F.lit(1)).rows()
    want = rows.withColumn("place", F.row_number().over(Window.partitionBy("visitor_id").orderBy("timestamp", "counter")))
    assert {x["id"]: x["place"] for x in got.collect()} == {x["id"]: x["place"] for x in want.collect()}


def test_short_keys_cost_one_shuffle(spark, rows):
    plan = sessions.with_runs(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan


def test_nothing_gives_nothing(rows, short_stretches):
    assert sessions.sessions(rows.limit(0)).count() == 0
