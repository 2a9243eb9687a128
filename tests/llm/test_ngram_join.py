"""The n-gram Jaccard join against all pairs."""

import re

import numpy as np

from llm.ngram_join import block_links, ngram_components


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (set sizes of its rows, component) by comparing every pair of rows."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted((i, len(s), root(i)) for i, s in sets)


def test_components_equal_brute_force(docs, rows):
    got = sorted(tuple(r) for r in ngram_components(docs).collect())
    assert got == brute(rows)


def test_large_groups_are_cut_into_blocks(docs, rows):
    got = sorted(tuple(r) for r in ngram_components(docs, block=3).collect())
    assert got == brute(rows)


def test_repeated_ids_nulls_and_clashing_columns(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, text), (1, text), (2, text + " more"), (None, text), (3, None), (4, "x y"), (5, "X\tY"), (1, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as n", "8 as token", "9 as class")
    got = sorted((tuple(r) for r in ngram_components(df).collect()), key=str)
    assert got == sorted([(1, 22, 1), (1, 22, 1), (2, 23, 1), (None, 22, None), (3, 0, 3), (4, 1, 1), (5, 1, 1), (1, 1, 1)], key=str)


def test_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_links_what_pairs_link():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 4000, 60)).astype(np.uint64) for _ in range(12)]
    sets = [np.unique(np.r_[b[: len(b) - k], r.integers(5000, 9000, k).astype(np.uint64)]) for b in base for k in (0, 2, 5, 9)]
    links = block_links(sets, np.full(len(sets), 2))
    for i, j in links:
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        assert 100 * len(a & b) >= 80 * len(a | b)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        up[max(root(i), root(j))] = min(root(i), root(j))
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 100 * len(a & b) >= 80 * len(a | b):
                assert root(i) == root(j)
