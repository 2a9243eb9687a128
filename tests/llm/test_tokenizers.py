"""Byte-level BPE, token counts and packing against the tokenizer libraries and plain dynamic programming."""

import base64
import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from llm import packing
from llm.bpe import Vocabulary, bpe_decode, bpe_encode, read_ranks, round_trip
from llm.token_counts import MARK, Counter, merge_counts, read_pieces, token_counts


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def encoding(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(docs, rows, ranks):
    known = encoding(ranks)
    got = {r["doc_id"]: r for r in round_trip(docs, ranks, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = np.array(known.encode_ordinary(text or ""), "<u4").tobytes()
        assert got[i]["n_tokens"] == len(ids) // 4
        assert got[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_long_and_short_pieces_merge_alike(ranks):
    v = Vocabulary(ranks)
    pieces = [b"ab", b"aaaaaaaa", b"the them then", "größer".encode(), b"xyzzyxyzzyxyzzyxyzzyxyzzyxyzzy12"]
    assert v.merge_many(pieces) == [v.merge_one(p) for p in pieces]


def test_bpe_columns(spark, ranks):
    df = spark.createDataFrame([(1, None, b"x"), (1, None, b"x"), (2, "a b", b"y")], "doc_id long, text string, IDS binary")
    out = bpe_decode(bpe_encode(df, ranks, public_tokenizers.PATTERN), ranks)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in out.collect()) == [(1, b""), (1, b""), (2, b"a b")]
    assert round_trip(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def plain_viterbi(text, pieces, unknown):
    best, count = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
    longest = max(map(len, pieces))
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            piece = text[start:end]
            if piece in pieces and best[start] + pieces[piece] > best[end]:
                best[end], count[end] = best[start] + pieces[piece], count[start] + 1
        c = text[end - 1]
        if c not in pieces and best[end - 1] + unknown > best[end]:
            best[end], count[end] = best[end - 1] + unknown, count[end - 1] + len(c.encode())
    return count[-1], best[-1]


def test_counts_equal_plain_dynamic_programming(docs, rows):
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in token_counts(docs, pieces).collect()}
    unknown = Counter(pieces).unknown
    assert len(got) == len(rows)
    for i, text in sorted(rows, key=lambda r: r[0])[::6] + [r for r in rows if r[0] > 900_000]:
        if text and len(text) > 6000:
            continue
        n, score = plain_viterbi(MARK + text.replace(" ", MARK), pieces, unknown) if text else (0, 0.0)
        assert got[i]["n_tokens"] == n, text
        assert got[i]["log_score"] == pytest.approx(score)


def test_count_ties_go_to_the_piece_that_starts_first():
    c = Counter({"a": -1.0, "b": -1.0, "ab": -2.0, MARK: -1.0})
    assert c.count("ab") == (2, -3.0)
    assert token_counts  # the column form is tested above


def test_counts_equal_the_library(spark, docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["", " ", "  ", "a  b", "   x   ", " lead", "trail ", "\t\n", "▁a ▁▁ b", "\U0001f9ff ሴ", "<s> <0x41>", "x" * 3000, "日本語" * 400, "a" + " " * 40 + "b"]
    more = [*rows, *((2_000_000 + k, t) for k, t in enumerate(odd))]
    table = docs.union(spark.createDataFrame(more[len(rows) :], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in merge_counts(table, read_pieces(path)).collect()}
    assert {i: got[i]["n_tokens"] for i, _ in more} == {i: len(library.encode(t or "")) for i, t in more}
    viterbi = {r["doc_id"]: (r["n_tokens"], r["log_score"]) for r in token_counts(table, read_pieces(path)).collect()}
    assert {i: (r["n_viterbi"], r["log_score"]) for i, r in got.items()} == viterbi


def definition():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def check_packing(out, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition())
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want = [(p, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in out)
    whole = sum(r["length"] == 4096 for r in out)
    assert len(bins) <= max(-(-total // 4096) * 1.03 + 1, whole + 1)


def test_pieces_and_sequences(docs, rows):
    check_packing(packing.packed_documents(docs, definition()).collect(), rows)


def test_lengths_that_go_with_partitions_pack_as_well_as_mixed_ones(spark):
    n = 4000
    items = spark.range(2 * n, numPartitions=40).selectExpr("id as item", f"if(id < {n}, 2500L, 1500L) as length")
    out = packing.pack(items).collect()
    assert len(out) == len({r["item"] for r in out}) == 2 * n
    assert len({r["sequence_id"] for r in out}) <= 1.03 * n


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string").selectExpr("*", "1 as item", "2 as length")
    out = packing.packed_documents(df, definition()).collect()
    assert sorted(r["length"] for r in out) == [1, 2, 2, 2]
    assert sorted((r["offset"], r["length"]) for r in out)[-1][0] + 0 <= 6 and len({r["sequence_id"] for r in out}) == 1
    assert packing.packed_documents(df.limit(0), definition()).count() == 0


def test_best_fit_takes_the_tightest_bin():
    where, offset, fill = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert fill.tolist() == [10, 10] and where.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 8]
