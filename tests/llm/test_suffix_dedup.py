"""Suffix-array dedup against a table of all strings of 50 bytes."""

import hashlib

import numpy as np

from llm.suffix_dedup import digests, without_repeats
from llm.suffix_sort import sort_strings


def brute(rows, length=50):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, sha256 of what stays); a null id comes after all others."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: 1 << 63 if i is None else i
    first = {}
    for i, b in texts:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, 1 << 64), order(i))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 2, int)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < order(i):
                gone[k + 1 : k + 1 + length] = 1
        n_spans = int((np.diff(gone) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((i, len(b), len(b) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in digests(docs).collect()), key=str)


def test_equal_to_brute_force(spark, rows):
    short = [(i, t and t[:20_000]) for i, t in rows]
    assert got(spark.createDataFrame(short, "doc_id long, text string").repartition(5)) == brute(short)


def test_periods_borders_and_odd_rows(spark):
    p = "The quick brown fox jumps over the lazy dog again and again, "
    rows = [(5, "ab" * 200), (7, "x" + "ab" * 60), (9, "ba" * 24 + "b"), (9, "ba" * 24 + "bab"), (None, p), (1, "é" + p + p), (2, p[:49]), (3, p[:50]), (3, p[:50]), (4, "q" * 49), (6, "q" * 400), (8, None), (10, ""), (11, p + "ü" * 80), (12, "ü" * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as part", "3 as kept").repartition(4)
    assert got(df) == brute(rows)


def test_a_short_line_in_many_surroundings(spark, monkeypatch):
    from llm import suffix_dedup

    r = np.random.default_rng(3)
    word = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    line = "0123456789 a line that many documents ho"
    ends = [(word(40), word(40)) for _ in range(200)]  # some surroundings come again
    rows = [(int(i), a + line + b) for i in r.permutation(900) for a, b in [ends[i % 200] if i < 300 else (word(40), word(40))]]
    seen, sort = [], suffix_dedup.sort_strings
    monkeypatch.setattr(suffix_dedup, "sort_strings", lambda data, start, length, group: seen.append(len(start)) or sort(data, start, length, group))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for alike, suffixes in ((suffix_dedup.ALIKE, 500), (20, 500), (20, 1 << 19)):
        monkeypatch.setattr(suffix_dedup, "ALIKE", alike)
        monkeypatch.setattr(suffix_dedup, "SUFFIXES", suffixes)
        assert got(df.repartition(3)) == want
    # one bucket, as a task of step 2 sees it: no more than SUFFIXES are sorted at once, and all stretches go on
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", 500)
    texts = [t.encode() for _, t in rows]
    at = [t.index(line.encode()) for t in texts]
    spans = [t[k - 10 : k + 74] for t, k in zip(texts, at, strict=True)]
    n, u = len(spans), suffix_dedup.squeezed
    columns = [np.zeros(n, np.uint32), np.full(n, 84, np.uint8), np.arange(n), np.ones(n, np.uint32), np.arange(n), np.zeros(n, np.uint32)]
    bucket = suffix_dedup._row(suffix_dedup.SPANS, 0, *map(u, columns), suffix_dedup.zstandard.compress(b"".join(spans)))
    seen.clear()
    out = list(suffix_dedup._removed(4)(iter([bucket])))
    assert max(seen, default=0) <= 500
    assert suffix_dedup.STRETCHES in {b.column("kind")[0].as_py() for b in out}


def test_colliding_hashes_do_no_harm(spark, rows, monkeypatch):
    from llm import suffix_dedup

    short = [(i, t and t[:3000]) for i, t in rows]
    equals = suffix_dedup._equals
    met = []

    def poor(same, order, data, base, size):
        met.append(len(same))
        return equals(same & np.uint64(255), order, data, base, size)

    monkeypatch.setattr(suffix_dedup, "_equals", poor)
    df = spark.createDataFrame(short, "doc_id long, text string").repartition(2)
    assert got(df) == brute(short)
    spans = np.frombuffer(b"aaaabbbbaaaacccc", np.uint8)
    by, first = equals(np.zeros(4, np.uint64), np.array([3, 1, 2, 0]), spans, np.array([0, 4, 8, 12]), np.full(4, 4))
    groups = sorted(g.tolist() for g in np.split(by, first[1:]))
    assert groups == [[1], [2, 0], [3]]


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sort_equals_plain_sort():
    r = np.random.default_rng(1)
    data = np.concatenate([r.integers(0, 3, 400), np.tile(r.integers(0, 2, 30), 20)]).astype(np.uint8)
    start = r.permutation(len(data) - 49)
    order, group = sort_strings(data, start, 50)
    strings = [data[s : s + 50].tobytes() for s in start[order]]
    assert strings == sorted(strings)
    assert [a == b for a, b in zip(strings, strings[1:], strict=False)] == (np.diff(group) == 0).tolist()
