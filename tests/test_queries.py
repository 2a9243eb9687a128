"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import pytest

from tracewell.plans import catalog, evidence  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, values):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    c = duck.execute(catalog.SQL[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, c.fetchall())


def address(url, cap=2000):
    units = lambda s: len(s.encode("utf-16-le")) // 2
    if url is None or units(url) <= cap:
        return url
    base, mark, rest = url.partition("#")
    path, asked, query = base.partition("?")
    n = units(query)
    shed = f"{path}?… ({f'{n} chars' if n < 1024 else f'{round(n / 1024)}kB'} query){mark}{rest}"
    if asked and units(shed) <= cap:
        return shed
    return url.encode("utf-16-le")[: 2 * cap - 2].decode("utf-16-le", "ignore") + "…"


def test_addresses_of_all_pages_and_long_ones(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    b = "http://a.test/p"
    odd = [None, "", "?" + "q" * 3000, f"{b}?{'q' * 1990}", f"{b}?{'q' * 2560}#f?x", f"{b}{'p' * 3000}", f"{b}?#{'f' * 3000}", f"{b}?x=1#{'f' * 1990}?y", f"{b}#{'?' * 3000}"]
    odd += ["\U0001f9ff" * 1001, "x" + "\U0001f9ff" * 1001, b + "\U0001f9ff" * 990, f"{b}?{'é' * 2100}#a\nb", f"{b}?a?b{'q' * 2000}", f"{b}?{'q' * 1023}{'#' * 1200}", "x" * 2000, "x" * 2001]
    rows = [(r["page_id"], r["url"]) for r in given] + [(-1 - k, u) for k, u in enumerate(odd)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.QUERIES["page_addresses"](spark, str(tmp_path)).collect()
    assert {r["page_id"]: r["described"] for r in got} == {i: address(u) for i, u in rows}
    assert any(u and ("?" in u or "#" in u) for _, u in rows[: len(given)])


def test_acts_are_not_nothing(spark):
    assert not catalog.QUERIES["zero_shaped_acts"](spark, SF).first()["nothing"]


def test_nothing_is_paired_with_everything(spark):
    for name in ("session_summary", "session_stamp", "overlap_concurrent", "nearest_mark", "claim_events"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_the_scan_reads_only_what_is_needed(spark):
    plan = catalog.QUERIES["tpch_rollup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
