"""Sessions stitched across micro-batches against the batch job, and the table function against the stream it numbers."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import sessions
from tracewell.streaming import ingest

T0 = 1_700_000_000_000
MIN = 60_000


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old) if old else spark.conf.unset(key)


def test_late_repeated_and_resent_acts_over_three_batches(spark, tmp_path, rocks):
    r = random.Random(4)
    acts = []
    for v in range(6):
        t = T0
        for i in range(40):
            t += r.choice([500, 4000, 12_000, 29 * MIN, 30 * MIN, 31 * MIN])
            acts.append((f"v{v}", r.choice(["s", "s", "t"]), t, f"{t:019d}", r.choice(["PageLoad", "Click", "Input"]), f"{v}-{i}"))
    r.shuffle(acts)  # what comes in a batch may lie anywhere in time
    batches = [acts[:100], acts[80:170] + acts[:10], acts[160:] + acts[100:120]]
    given, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for batch in batches:
        spark.createDataFrame(batch, ingest.EVENT).coalesce(1).write.mode("append").parquet(given)
        source = spark.readStream.schema(ingest.EVENT).parquet(given)
        ingest.stitched(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    want = sessions.sessions(spark.createDataFrame(acts, ingest.EVENT)).drop("run")
    rows = spark.read.parquet(out)
    got = ingest.standing_sessions(rows).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert rows.agg(F.max("turn")).first()[0] == 3


def test_event_stream_numbers_lines_in_order(spark):
    from tracewell.functions import tables

    tables.register(spark)
    rows = [("w", "v", "S1", 5 - k, 0, f"line {k}") for k in range(5)] + [("x", "v", "S1", 1, 1, "other"), (None, "v", "S1", 2, 0, "none")]
    spark.createDataFrame(rows, "window string, visitor_id string, label string, timestamp long, shot int, line string").createOrReplaceTempView("lines_to_number")
    got = spark.sql("SELECT * FROM event_stream(TABLE(SELECT * FROM lines_to_number) PARTITION BY `window` ORDER BY timestamp)").collect()
    assert sorted((x["window"] or "", x["place"], x["line"]) for x in got) == sorted([("w", k + 1, f"line {4 - k}") for k in range(5)] + [("x", 1, "other"), ("", 1, "none")])
    assert spark.sql("SELECT utc_day(1700000000000) AS d, opened_ms('17000000000001-ab12') AS o, route('https://a.test/x?q=1#top') AS r").first().asDict() == {"d": "2023-11-14", "o": 17000000000001, "r": "https://a.test/x#top"}
