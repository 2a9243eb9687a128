"""Row numbers that hold whatever the plan of a scan."""

import pytest

from llm.spark_io import numbered
from llm.suffix_dedup import digests


@pytest.fixture
def split_small(spark):
    """Sets how small a scan is split; the old setting comes back."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, n)
    spark.conf.set(key, old)


def test_two_scan_plans_number_alike(spark, tmp_path, split_small):
    path = str(tmp_path / "t")
    spark.range(20_000, numPartitions=5).selectExpr("id as doc_id", "repeat(cast(id as string), 20) as text").write.option("parquet.block.size", 1 << 16).parquet(path)
    got = []
    for size in ("128m", "20k"):
        split_small(size)
        df = spark.read.parquet(path)
        got.append((df.rdd.getNumPartitions(), {r["row"]: r["doc_id"] for r in numbered(df).select("row", "doc_id").collect()}))
    assert got[0][0] < got[1][0]
    assert got[0][1] == got[1][1] and len(got[0][1]) == 20_000


def test_other_rows_are_numbered_too(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "ROW int, _metadata string")
    out = numbered(df, "row")
    assert out.columns == ["_metadata", "row"]
    rows = out.collect()
    assert len({r["row"] for r in rows}) == 3 and [r["row"] for r in sorted(rows, key=str)] == [r["row"] for r in sorted(out.collect(), key=str)]


def test_files_beyond_the_bound_are_written_first(spark, tmp_path, monkeypatch):
    from llm import spark_io

    monkeypatch.setattr(spark_io, "FILES", 2)
    spark.range(100, numPartitions=4).write.parquet(str(tmp_path / "t"))
    out = numbered(spark.read.parquet(str(tmp_path / "t")))
    assert len({r["row"] for r in out.collect()}) == 100 and sorted(r["id"] for r in out.collect()) == list(range(100))


def test_dedup_is_the_same_under_both_plans(spark, tmp_path, split_small):
    passage = "a passage that is held by many documents, and is longer than fifty bytes by far. "
    rows = [(i, f"{i} {'x' * (i % 7)} " + (passage if i % 3 else "") + f" end {i * i}") for i in range(600)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    out = []
    for size in ("128m", "2k"):
        split_small(size)
        out.append(sorted(map(tuple, digests(spark.read.parquet(path)).collect())))
    assert out[0] == out[1] and sum(r[2] > 0 for r in out[0]) == 399
