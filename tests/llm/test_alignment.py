"""Cross-tokenizer alignment against the libraries on whole texts, and plain searches over the overlap graph."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from llm import alignment
from llm.alignment import Aligner, aligned, connected, grouped, pair_counts, token_groups

ODD = ["", " ", "  ", "a  b", "   x   ", " lead", "trail ", "\t\n", "a \n b", "x▁y z", "▁", "<s> <|endoftext|> <unk> <0x41>", "x" * 3000, "日本語" * 400, "a" + " " * 40 + "b"]
ODD += ["\U0001f9ff ሴ ᠎ b ​ c d   e", "\x00 \x1c \x85   q", "don't I'll 12345 9 ' s", "é́ ﬁ ﻿ z", "a\nb\nc" * 200, "\r\n \r\n"]


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


def libraries(files):
    """text -> (ids and bytes of a, ids and bytes of b), whole texts at once."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    byte = alignment.letters_of_bytes()

    def both(text):
        x = a.encode(" " + text, add_special_tokens=False)
        y = b.encode(text)
        pieces = [b.id_to_piece(i) for i in y]
        return x.ids, [bytes(byte[c] for c in t) for t in x.tokens], y, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(y, pieces, strict=True)]

    return both


def plain(text, both):
    """(ids of a, ids of b, groups, links) of a text, or None."""
    if not text:
        return None
    a, bytes_a, b, bytes_b = both(text)
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    spans = []
    for own in (bytes_a, bytes_b):
        at = np.cumsum([0, *map(len, own)]).tolist()
        spans.append(list(zip(at, at[1:], strict=False)))
    links, j = [], 0
    for i, (p, q) in enumerate(spans[0]):
        while spans[1][j][1] <= p:
            j += 1
        k = j
        while k < len(b) and spans[1][k][0] < q:
            links.append((i, k))
            k += 1
    ends = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
    groups, i, j = [], 0, 0
    for e in ends:
        x = [t for t in range(i, len(a)) if spans[0][t][1] <= e] if len(a) < 500 else None
        if x is None:
            x, t = [], i
            while t < len(a) and spans[0][t][1] <= e:
                x.append(t)
                t += 1
        y, t = [], j
        while t < len(b) and spans[1][t][1] <= e:
            y.append(t)
            t += 1
        groups.append(",".join(str(a[t]) for t in x) + "|" + ",".join(str(b[t]) for t in y))
        i, j = i + len(x), j + len(y)
    return a, b, groups, [(a[i], b[k]) for i, k in links]


def expected(rows, files):
    both = libraries(files)
    got = [(i, plain(t, both)) for i, t in rows]
    holders = Counter(pair for _, g in got if g for pair in set(g[3]))
    best = defaultdict(int)
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    out = []
    for i, g in got:
        if not g:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = g
        n_best = sum(holders[p] == best[p[0]] for p in links)
        out.append((i, len(a), len(b), len(groups), len(links), n_best, sum(holders[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, holders, best


def test_rows_equal_plain_search(spark, docs, rows, files):
    more = [(2_000_000 + k, t) for k, t in enumerate(ODD)] + [(5, "twice the same id"), (None, "no id"), (None, None)]
    df = docs.union(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("*", "'x' as block", "1 as PAIRS", "2 as n_a")
    want, holders, best = expected([*rows, *more], files)
    out = aligned(df, *files)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    counts = {(r["a"], r["b"]): (r["n_docs"], r["best"]) for r in pair_counts(df, *files).collect()}
    assert counts == {p: (n, n == best[p[0]]) for p, n in holders.items()}


def test_forgotten_parts_are_aligned_again(docs, rows, files, monkeypatch):
    want, *_ = expected(rows, files)
    aligner = Aligner(*files)
    monkeypatch.setattr(alignment, "KEPT", 50)
    texts = [t or "" for _, t in rows]
    got = [aligner.align([t])[0] for t in texts]
    assert [(g[0], g[1], g[2], len(g[4])) for g in got] == [w[1:5] for w in want]


def test_edges(spark, files):
    kind = "doc_id long, text string"
    assert aligned(spark.createDataFrame([], kind), *files).count() == 0
    out = aligned(spark.createDataFrame([(1, None), (2, ""), (3, "▁")], kind), *files).collect()
    assert sorted(map(tuple, out)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
    r = token_groups(spark.createDataFrame([(1, "hello world")], kind), *files).first()
    assert r["n_a"] == 2 and r["groups"].count(";") == r["groups"].count("|") - 1


def test_components_are_those_of_a_plain_search():
    r = random.Random(3)
    for _ in range(50):
        n = r.randint(1, 40)
        u, v = np.array([[r.randrange(n), r.randrange(n)] for _ in range(r.randint(1, 40))]).T
        got = connected(n, u, v)
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(u, v, strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert got.tolist() == want


def test_groups_of_a_long_chain():
    """Borders that never meet until the end make one group of all tokens."""
    n = 20_000
    a, b, group_a, group_b = grouped(np.append(np.arange(1, n) * 2, 2 * n + 1), np.append(np.arange(n) * 2 + 1, 2 * n + 1))
    assert set(group_a.tolist()) == set(group_b.tolist()) == {0}
    assert len(a) == len(b) == 2 * n + 1 - 1


def test_registered_query_equals_plain_search(spark, files):
    from llm.catalog import op11_cross_tokenizer_alignment

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op11_cross_tokenizer_alignment(spark, sf).collect())) == sorted(expected(rows, files)[0])
