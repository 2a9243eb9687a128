"""Count-only Viterbi against the library's own unigram model over the same vocabulary, and its odd rows."""

import random

import public_tokenizers
import pytest

from llm.token_counts import Counter, merge_counts, read_pieces, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
#: In place of the placeholder score of runs of the mark, which the library's own search treats unlike its n-best one.
MARK_SCORE = -40_000.0


def field(data, at):
    """One field of a serialised message: number, kind, where its value begins and ends."""

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    key, at = varint(at)
    kind = key & 7
    if kind == 0:
        _, end = varint(at)
    elif kind == 5:
        end = at + 4
    elif kind == 1:
        end = at + 8
    else:
        n, at = varint(at)
        end = at + n
    return key >> 3, kind, at, end


def framed(number, body):
    out, n = bytearray([number << 3 | 2]), len(body)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n]) + body


def as_unigram(model):
    """The model as type unigram: pieces (field 1) with MARK_SCORE for the placeholder, the trainer's type (field 2, 3) set to 1."""
    import struct

    out, at = b"", 0
    while at < len(model):
        start = at
        number, _, a, at = field(model, at)
        body = model[a:at]
        if number == 1:
            new, k = b"", 0
            while k < len(body):
                begin = k
                n, kind, x, k = field(body, k)
                if n == 2 and kind == 5 and struct.unpack("<f", body[x:k])[0] < -1e8:
                    new += body[begin:x] + struct.pack("<f", MARK_SCORE)
                else:
                    new += body[begin:k]
            out += framed(1, new)
        elif number == 2:
            new, k = b"", 0
            while k < len(body):
                begin = k
                n, _, x, k = field(body, k)
                new += body[begin:k] if n != 3 else b""
            out += framed(2, new + bytes([3 << 3, 1]))
        else:
            out += model[start:at]
    return out


def test_viterbi_equals_the_library_as_a_unigram_model():
    import sentencepiece

    with open(PATH, "rb") as f:
        library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(f.read()))
    counter = Counter({p: max(s, MARK_SCORE) for p, s in read_pieces(PATH).items()})
    r = random.Random(5)
    words = "the house of a river stands near old people, and walks: 12,345 naïve größer über señor ... x-ray".split()
    texts = [" ".join("".join(r.choice([w, w[:3], w.upper()]) for w in r.choices(words, k=1)) for _ in range(r.randint(1, 60))) for _ in range(300)]
    assert [counter.count(t)[0] for t in texts] == [len(library.encode(t)) for t in texts]


def test_odd_rows(spark):
    pieces = read_pieces(PATH)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the house"), (3, "the house"), (None, "x" * 20_000)], "doc_id long, text string").selectExpr("*", "7 as N_TOKENS", "8 as log_score")
    for made in (token_counts, merge_counts):
        out = made(df, pieces)
        assert [c.lower() for c in out.columns].count("n_tokens") == 1
        got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out.collect())
        assert len(got) == 5 and got[1:3] == [(1, 0), (2, 0)] and got[3] == got[4] and got[0][1] > 0
        assert made(df.limit(0), pieces).count() == 0


@pytest.mark.parametrize("text", ["x" * 30_000, "ab" * 20_000, "漢" * 5000])
def test_texts_without_spaces(text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert Counter(read_pieces(PATH)).counts(text)[0] == len(library.encode(text))
