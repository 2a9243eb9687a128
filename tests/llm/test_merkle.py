"""Merkle fingerprints against plain edits of the texts."""

import difflib
import hashlib
import random

import pytest

from llm.merkle import alike, differences, edits, fingerprint, parse


def edited(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        out[i] = (t, t[: len(t) - n] + after[:n], after)
    return out


def likeness(a, b):
    """Twice the bytes of the words that stand in both, in order, over all bytes."""
    if a == b:
        return 1.0
    x, y = a.split(" "), b.split(" ")
    same = difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
    common = sum(len(w.encode()) + 1 for m in same for w in x[m.a : m.a + m.size] if m.size > 1)
    return 2 * common / (len(a.encode()) + len(b.encode()))


def test_edits(docs, rows, spark):
    want = edited(rows)
    got = {r["doc_id"]: r for r in edits(docs).collect()}
    assert set(got) == set(want)
    texts = spark.createDataFrame([(i, t) for i, (_, t, _) in want.items()], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint(texts).collect()}
    off = []
    for i, (text, new, after) in want.items():
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["edited_fingerprint"] == prints[i]
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == new)
        assert r["near_edited"] == alike(r["fingerprint"], r["edited_fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if 1000 <= len(text) < 5000 and 1000 <= len(after) < 5000:
            off += [abs(r["near_edited"] - likeness(text, new)), abs(r["near_next"] - likeness(text, after))]
    assert len(off) > 20 and max(off) < 0.15 and sum(off) / len(off) < 0.03


def of(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["fingerprint"] for r in fingerprint(rows.coalesce(1)).orderBy("doc_id").collect()]


def test_fingerprints_locate_edits(spark):
    r = random.Random(3)
    lines = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20)) for _ in range(40)]
    old = "\n".join(lines[:20]) + "\n\n" + "\n".join(lines[20:])
    at = old.index(lines[30])
    new = old[:at] + "CHANGED" + old[at:]
    a, b, c = of(spark, old, new, "\n\n" + old)
    assert differences(a, a) == [] and alike(a, a) == 1.0
    (x, y), *more = differences(a, b)
    assert not more and x <= at and at + 7 <= y and y - x <= 200
    assert 0.95 < alike(a, b) < 1
    assert differences(a, c) == [(0, 2)]
    root, tree = parse(a)
    assert root == a.split(":")[0] and tree.sizes(0).tolist() == [len(old)] and len(tree.sizes(1)) == 2 and len(tree.sizes(2)) == 41


def test_texts_without_borders(spark):
    a, b, c, empty = of(spark, "x" * 5000, "x" * 4000 + "y" * 1000, "漢字" * 900, None)
    assert alike(a, b) == pytest.approx(0.8, abs=0.05)
    assert alike(a, c) == alike(a, empty) == alike(empty, a) == 0 and alike(empty, empty) == 1
    assert differences(empty, a) == [(0, 5000)]


def test_edges(spark):
    df = spark.createDataFrame([(1, "abcd efgh"), (1, "abcd efgh"), (None, None), (2, "")], "doc_id long, text string").selectExpr("*", "1 as part", "2 as late", "3 as fingerprint")
    assert edits(df).count() == 4
    one = edits(df.where("doc_id = 2")).first()
    assert (one["n_chars"], one["near_edited"], one["near_next"]) == (0, 1.0, 1.0)
    assert edits(df.limit(0)).count() == 0
    assert fingerprint(df).columns.count("fingerprint") == 1
