"""Line diffs: they turn old into new, report nothing that both hold in one place, and are near the least there could be."""

import difflib
import os
import random

import pytest

from tracewell.operators import diffs
from tracewell.plans import catalog, evidence  # noqa: F401

SF = "/root/testdata/sf0.001"
CASES = [
    ("a\nb\nc", "a\nb\nc", ""),
    ("a\nb\nc", "a\nx\nc", "- b\n+ x"),
    ("", "a", "- \n+ a"),
    ("a\nb", "b\na", "- a\n+ a"),
    ("k\na\nb", "k\nc\nd\ne", "- a\n+ c\n- b\n+ d\n+ e"),
    ("x\nx\nx\ny", "x\nx\ny", "- x"),
    (None, "a", "- \n+ a"),
    ("a\nb", "a", "- b"),
    (None, None, ""),
]


def test_worked_cases_and_repeated_rows(spark):
    rows = [(k % 3, old, new) for k, (old, new, _) in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "id int, old string, new string").selectExpr("*", "1 as diff")
    out = diffs.with_diffs(df, "old", "new")
    assert out.columns == ["id", "old", "new", "diff"]
    got = sorted((r["old"] or "", r["new"] or "", r["diff"]) for r in out.collect())
    assert got == sorted((old or "", new or "", want) for old, new, want in CASES * 2)
    assert diffs.with_diffs(df.limit(0), "old", "new").count() == 0


def applied(old, lone):
    """The new text: old lines without those that left, and those that came at their places."""
    old = (old or "").split("\n")
    left = {r["at"] for r in lone if r["side"] == 0}
    kept = iter([x for k, x in enumerate(old) if k not in left])
    came = {r["at"]: r["line"] for r in lone if r["side"] == 1}
    n = len(old) - len(left) + len(came)
    return "\n".join(came[k] if k in came else next(kept) for k in range(n))


def test_changes_turn_old_into_new_and_are_few(spark):
    r = random.Random(2)
    rows = []
    for key in range(150):
        old = [r.choice("abcdefghijklmnopqrstuvwxyz"[: r.choice([2, 4, 26])]) for _ in range(r.randrange(25))]
        new = [r.choice("xyz") if r.random() < 0.2 else x for x in old if r.random() < 0.85]
        if r.random() < 0.3:
            r.shuffle(new)
        rows.append((key, "\n".join(old), "\n".join(new)))
    lone = diffs.changed_lines(spark.createDataFrame(rows, "key long, old string, new string"), "old", "new").collect()
    shared = all_ = 0
    for key, old, new in rows:
        own = [x for x in lone if x["key"] == key]
        if old == new:
            assert not own
            continue
        assert applied(old, own) == new
        all_ += len(old.split("\n")) - sum(x["side"] == 0 for x in own)
        m = difflib.SequenceMatcher(None, old.split("\n"), new.split("\n"), autojunk=False)
        shared += sum(b.size for b in m.get_matching_blocks())
        # no gap holds a line on both sides
        for gap in {x["gap"] for x in own}:
            assert not {x["line"] for x in own if x["gap"] == gap and x["side"] == 0} & {x["line"] for x in own if x["gap"] == gap and x["side"] == 1}
    assert all_ >= 0.95 * shared


def test_a_text_of_fifty_thousand_lines(spark):
    r = random.Random(3)
    old = [f"line {k} {r.randrange(9)}" if r.random() < 0.7 else r.choice(["", "}", "end"]) for k in range(50_000)]
    new = [x for x in old if r.random() > 0.002]
    for _ in range(100):
        new.insert(r.randrange(len(new)), r.choice(["", "fresh", "end"]))
    df = spark.createDataFrame([(1, "\n".join(old), "\n".join(new))], "key long, old string, new string")
    lone = diffs.changed_lines(df, "old", "new").collect()
    assert applied("\n".join(old), lone) == "\n".join(new)
    assert len(lone) <= 1.3 * (len(old) - len(new) + 200)


def test_long_lines_keep_only_what_is_beside_a_change(spark):
    words = " ".join(f"word{k}" for k in range(100))
    cases = [(words + " end", words + " END more"), ("short a", "short b"), (f"x {words} y", f"z {words} w"), (f"{words} m {words} x", f"{words} n {words} x"), (words, "")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "key long, old string, new string")
    got = {(x["key"], x["side"]): x["line"] for x in diffs.shortened(df).collect()}
    tail = words[-39:] + " "
    assert (got[0, 0], got[0, 1]) == (f"…{tail}end", f"…{tail}END more")
    assert (got[1, 0], got[1, 1]) == cases[1]
    assert (got[2, 0], got[2, 1]) == (f"x {words[:39]}…{tail}y", f"z {words[:39]}…{tail}w")
    assert got[3, 0] == f"…{tail}m {words[:39]}…"
    assert got[4, 0] == words and got[4, 1] == ""
    out = diffs.with_diffs(df, "old", "new").where("key = 0").first()["diff"]
    assert out == f"- …{tail}end\n+ …{tail}END more"


@pytest.mark.parametrize(("values", "length"), [([], 0), ([3], 1), ([1, 0], 1), ([2, 1, 3, 0, 4], 3), ([5, 4, 3], 1), ([0, 1, 2], 3)])
def test_longest_rising(values, length):
    at = diffs.longest_rising(values)
    assert len(at) == length and at == sorted(at) and [values[k] for k in at] == sorted(values[k] for k in at)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_diffs_of_all_pages(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tracewell.functions import exprs as X
    from tracewell.operators import pages

    md = spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id").alias("key"), pages.markdown("html").alias("new"), X.url_host("url").alias("host"))
    df = md.withColumn("old", F.lag("new").over(Window.partitionBy("host").orderBy("key"))).select("key", "old", "new").cache()
    lone = diffs.changed_lines(df, "old", "new").collect()
    for row in df.collect():
        own = [x for x in lone if x["key"] == row["key"]]
        assert applied(row["old"], own) == row["new"]
    assert catalog.QUERIES["page_diffs"](spark, SF).count() == df.count()


def test_texts_move_as_rows_of_lines(spark):
    """Words and lines are compared where both texts stand: two shuffles of pairs and their changed lines, and those of the join back; nothing is written down between."""
    df = spark.createDataFrame([(1, "a", "b")], "id int, old string, new string")
    plan = diffs.with_diffs(df, "old", "new")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 3 and "ExistingRDD" not in plan.replace("Scan ExistingRDD[id", "")
    plan = diffs.shortened(df.withColumnRenamed("id", "key"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange " not in plan
