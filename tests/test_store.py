"""The store as a data source: what is listed and opened, and streams of what arrives."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringStartsWith

from tracewell.operators import books
from tracewell.sources import chunks, store
from tracewell.streaming import ingest

SLICE = "17000000000001-ab12"


def put(root, site, day, n, visitor="visitor01", first=0):
    folder = root / site / day / visitor / SLICE
    folder.mkdir(parents=True, exist_ok=True)
    for k in range(first, first + n):
        (folder / f"{k:019d}.json.gz").write_bytes(f"{site} {day} {k}".encode())


class Counting:
    """Notes which folders are listed and which objects opened."""

    def __init__(self, monkeypatch):
        self.folders, self.opened = [], []
        real = store.Files

        class Noted(real):
            def folders(own, under):
                self.folders.append(under)
                return super().folders(under)

            def objects(own, under):
                self.folders.append(under)
                return super().objects(under)

            def read(own, key):
                self.opened.append(key)
                return super().read(key)

        monkeypatch.setattr(store, "files_of", Noted)


def keys_of(reader):
    return sorted(k for p in reader.partitions() for b in reader.read(p) for k in b.column("key").to_pylist())


def test_a_prefix_lists_its_folders_alone(tmp_path, monkeypatch):
    for site in ("abc", "abd", "xyz"):
        for day in ("2024-01-01", "2024-01-02", "2024-02-01"):
            put(tmp_path, site, day, 3)
            put(tmp_path, site, day, 2, "visitor02")
    for prefix, below in [
        ("", [f"{s}/{d}" for s in ("abc", "abd", "xyz") for d in ("2024-01-01", "2024-01-02", "2024-02-01")]),
        ("ab", [f"{s}/{d}" for s in ("abc", "abd") for d in ("2024-01-01", "2024-01-02", "2024-02-01")]),
        ("abc/2024-01", ["abc/2024-01-01", "abc/2024-01-02"]),
        ("abc/2024-01-02/visitor0", ["abc/2024-01-02"]),
        ("abc/2024-01-02/visitor02/17", ["abc/2024-01-02/visitor02"]),
        ("none/", []),
    ]:
        seen = Counting(monkeypatch)
        got = keys_of(store.Listing(str(tmp_path), store.Wanted(prefix)))
        every = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.json.gz"))
        assert got == [k for k in every if k.startswith(prefix)]
        assert sorted(f for f in seen.folders if f.count("/")) == below and not seen.opened
        monkeypatch.undo()


def test_filters_leave_fewer_folders(tmp_path, monkeypatch):
    for site in ("abc", "xyz"):
        for day in ("2024-01-01", "2024-01-02", "2024-02-01"):
            put(tmp_path, site, day, 1)
    filters = [EqualTo(("site",), "abc"), GreaterThanOrEqual(("day",), "2024-01-02"), LessThan(("day",), "2024-02-01"), In(("day",), ("2024-01-02", "2024-01-03")), StringStartsWith(("key",), "abc/"), EqualTo(("bytes",), 5)]
    reader = store.Narrowed(str(tmp_path), store.Wanted())
    assert list(reader.pushFilters(filters)) == filters  # and Spark asks again
    seen = Counting(monkeypatch)
    assert [k[:14] for k in keys_of(reader)] == ["abc/2024-01-02"]
    assert [f for f in seen.folders if f.count("/")] == ["abc/2024-01-02"]


def test_spark_pushes_the_filters_and_rows_stay_right(spark, tmp_path):
    for site in ("abc", "xyz"):
        for day in ("2024-01-01", "2024-02-01"):
            put(tmp_path, site, day, 2)
    key = "spark.sql.python.filterPushdown.enabled"
    for on in ("true", "false"):
        spark.conf.set(key, on)
        try:
            rows = store.listed(spark, str(tmp_path)).where("site = 'abc' and day > '2024-01-01'").collect()
            assert sorted((r["site"], r["day"], r["bytes"]) for r in rows) == [("abc", "2024-02-01", 16)] * 2
        finally:
            spark.conf.unset(key)
    assert store.listed(spark, str(tmp_path), since="2024-01-15").count() == 4
    assert store.listed(spark, str(tmp_path / "nothing")).count() == 0


def test_one_fresh_key_of_a_full_day_opens_one_object(spark, tmp_path):
    put(tmp_path, "abc", "2024-01-02", 10_000)
    held = chunks.listing(spark, str(tmp_path)).select("key", "etag", "uploaded_ms").cache()
    assert held.count() == 10_000
    put(tmp_path, "abc", "2024-01-02", 1, first=20_000)
    fresh = chunks.fresh_objects(spark, str(tmp_path), held)
    assert fresh.count() == 1
    # whoever opens another finds nothing there any more
    for p in tmp_path.rglob("*.json.gz"):
        if not p.name.startswith("0000000000000020000"):
            os.remove(p)
    (row,) = chunks.content_of(spark, str(tmp_path), spark.createDataFrame(fresh.collect(), fresh.schema)).collect()
    assert bytes(row["content"]) == b"abc 2024-01-02 20000" and row["snippet"] == "abc"


def test_fetches_are_bounded_and_in_order(tmp_path, monkeypatch):
    put(tmp_path, "abc", "2024-01-02", 300)
    monkeypatch.setattr(store, "HELD", 200)
    monkeypatch.setattr(store, "IN_FLIGHT", 5)
    keys = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.json.gz"))
    got = list(store.in_flight(store.Files(str(tmp_path)), ((k, 1) for k in keys)))
    assert [r[0] for rows, _ in got for r in rows] == keys and len(got) > 10
    assert [c for _, content in got for c in content] == [(tmp_path / k).read_bytes() for k in keys]
    with pytest.raises(FileNotFoundError):
        list(store.in_flight(store.Files(str(tmp_path)), iter([("gone",)])))


def test_unsteady_stores_are_asked_again(tmp_path, monkeypatch):
    put(tmp_path, "abc", "2024-01-02", 1)
    files = store.Files(str(tmp_path))
    (key,) = (k for k, _, _ in files.objects(""))
    real, failures = files.fs, []

    class Unsteady:
        def open_input_stream(self, path, **options):
            if len(failures) < 2:
                failures.append(path)
                raise OSError("try again")
            return real.open_input_stream(path, **options)

    files.fs = Unsteady()
    monkeypatch.setattr(store.time, "sleep", lambda s: None)
    assert files.read(key) == b"abc 2024-01-02 0" and len(failures) == 2


def test_a_stream_takes_what_was_stored_since(spark, tmp_path):
    root, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    day = time.strftime("%Y-%m-%d", time.gmtime())  # within the horizon
    put(root, "abc", day, 3)

    def run():
        source = ingest.chunk_stream(spark, str(root), lag_ms=0)
        source.select("key", "uploaded_ms", F.col("content").cast("string").alias("content")).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(once=True).start().awaitTermination()
        return sorted(r["content"] for r in spark.read.parquet(out).collect())

    first = [f"abc {day} {k}" for k in range(3)]
    assert run() == first
    put(root, "abc", day, 1, first=9)
    (again,) = (p for p in root.rglob("*1.json.gz"))
    again.write_bytes(b"sent again")
    assert run() == sorted([*first, f"abc {day} 9", "sent again"])
    assert run() == sorted([*first, f"abc {day} 9", "sent again"])


def test_horizon_of_a_stream(tmp_path, monkeypatch):
    put(tmp_path, "abc", "2023-12-01", 1)
    put(tmp_path, "abc", "2024-02-20", 1)
    seen = Counting(monkeypatch)
    reader = store.Arrivals(str(tmp_path), store.Wanted(), 30, 0, 0)
    start = 1_709_251_200_000  # 2024-03-01
    parts = reader.partitions({"until_ms": start}, {"until_ms": 1 << 60})
    assert [p.below for p in parts] == [[("abc", "2024-02-20")]]
    assert [b.column("content").to_pylist() for p in reader.partitions({"until_ms": 0}, {"until_ms": 1 << 60}) for b in reader.read(p)] == [[b"abc 2023-12-01 0", b"abc 2024-02-20 0"]]
    assert len(seen.opened) == 2


def test_keys_of_other_shapes_are_listed_as_foreign(spark, tmp_path):
    put(tmp_path, "abc", "2024-01-02", 1)
    odd = tmp_path / "abc" / "2024-01-02" / "x.json.gz"
    odd.write_bytes(b"")
    rows = books.parsed_keys(chunks.listing(spark, str(tmp_path))).collect()
    assert sorted(r["foreign"] for r in rows) == [False, True]
