"""Byte-level BPE encoding and decoding.

Every match of the split pattern is encoded on its own: while any neighbouring pair of tokens
has a rank, the leftmost pair of the least rank merges. A segment tree over a piece's byte positions holds
at its root the least ``rank * width + position``, so the next merge is one look-up and its three
changed leaves (the merged token's pair, the live neighbour's before it, and the swallowed position) take a logarithmic
number of updates. ``merge_many`` runs the same tree for thousands of short pieces
in step, one numpy row a piece; ``merge_one`` takes a long piece, in O(n log n) whatever its length.

A task cuts its texts at single spaces (always a border of the pattern's matches) and keeps the ids of the
parts it has met in a bounded table, so common words are merged once.

A null text counts as empty and gives no ids. Ids of a row are little-endian unsigned 32-bit integers in one binary value,
a quarter of its length of them. Rows keep all other columns; a column of the new one's name is replaced; repeated rows stay repeated.
Texts of any length are encoded whole. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .spark_io import extended, lean

#: Parts whose ids a worker keeps, and their letters; beyond either it starts anew.
KEPT, LETTERS = 250_000, 4_000_000
#: Bytes of text handled at once.
CHUNK = 1 << 19
#: Longest piece that the step-by-step rows take.
SHORT = 32
NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 token, space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ids = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank
        known = sorted((left << 32 | right, rank) for (left, right), rank in self.pairs.items())
        self.keys = np.array([k for k, _ in known] + [NONE], np.int64)
        self.values = np.array([v for _, v in known] + [NONE], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, or NONE; a token below 0 has no pair."""
        key = np.where((left < 0) | (right < 0), NONE - 1, left << 32 | right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of 2 to SHORT bytes."""
        longest = max(map(len, pieces))
        w = 1 << (longest - 1).bit_length()
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        token = np.full((n, w + 2), -1, np.int64)  # a spare place each for "none before" and "none after"
        inside = np.arange(w) < size[:, None]
        token[:, :w][inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, w + 3), (n, 1))
        after[np.arange(w + 2) >= size[:, None] - 1] = w
        before = np.tile(np.arange(-1, w + 1), (n, 1))
        before[:, 0] = w + 1
        tree = np.full((n, 2 * w), NONE, np.int64)

        def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank == NONE, NONE, np.minimum(rank, NONE // w - 1) * w + at)

        right = np.where(np.arange(w) + 1 < size[:, None], token[:, 1 : w + 1], -1)
        tree[:, w:] = leaf(self.rank_of(token[:, :w].ravel(), right.ravel()).reshape(n, w), np.arange(w))
        for v in range(w - 1, 0, -1):
            tree[:, v] = np.minimum(tree[:, 2 * v], tree[:, 2 * v + 1])
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], w)
            gone = after[rows, at]
            next_ = after[rows, gone]
            prev = before[rows, at]
            token[rows, at], token[rows, gone] = rank, -1
            after[rows, at], before[rows, next_] = next_, at
            token[rows, w], token[rows, w + 1] = -1, -1
            changed = (
                (at, leaf(self.rank_of(rank, token[rows, next_]), at)),
                (gone, np.full(len(rows), NONE)),
                (np.minimum(prev, w - 1), leaf(self.rank_of(token[rows, prev], rank), prev)),
            )
            for k, (place, value) in enumerate(changed):
                r = rows
                if k == 2:  # the first token has none before it
                    some = prev < w
                    r, place, value = rows[some], place[some], value[some]
                v = place + w
                tree[r, v] = value
                while len(v) and v[0] > 1:
                    v = v >> 1
                    tree[r, v] = np.minimum(tree[r, 2 * v], tree[r, 2 * v + 1])
            rows = rows[tree[rows, 1] != NONE]
        live = (token[:, :w] >= 0) & inside
        ids = token[:, :w][live].astype("<u4").tobytes()
        bound = np.cumsum([0, *(live.sum(1) * 4)])
        return [ids[bound[i] : bound[i + 1]] for i in range(n)]

    def merge_one(self, piece: bytes) -> bytes:
        """Ids of a piece of any length of 2 or more bytes."""
        n = len(piece)
        w = 1 << (n - 1).bit_length()
        pairs, none = self.pairs, 1 << 62
        token = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        tree = [none] * (2 * w)
        for i in range(n - 1):
            rank = pairs.get((token[i], token[i + 1]))
            if rank is not None:
                tree[w + i] = rank * w + i
        for v in range(w - 1, 0, -1):
            tree[v] = min(tree[2 * v], tree[2 * v + 1])

        def put(i: int, value: int) -> None:
            v = w + i
            tree[v] = value
            while v > 1:
                v >>= 1
                least = min(tree[2 * v], tree[2 * v + 1])
                if tree[v] == least:
                    break
                tree[v] = least

        while tree[1] != none:
            rank, i = divmod(tree[1], w)
            gone, prev = after[i], before[i]
            next_ = after[gone]
            token[i], token[gone] = rank, -1
            after[i] = next_
            if next_ >= 0:
                before[next_] = i
            r = pairs.get((rank, token[next_])) if next_ >= 0 else None
            put(gone, none)
            put(i, none if r is None else r * w + i)
            if prev >= 0:
                r = pairs.get((token[prev], rank))
                put(prev, none if r is None else r * w + prev)
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces."""
        out = {p: self.ids[p] for p in pieces if p in self.ids}
        rest = [p for p in pieces if p not in out]
        by_width: dict[int, list[bytes]] = {}
        for p in rest:
            if len(p) <= SHORT:
                by_width.setdefault((len(p) - 1).bit_length(), []).append(p)
            else:
                out[p] = self.merge_one(p)
        for same in by_width.values():
            for k in range(0, len(same), 1 << 14):
                some = same[k : k + (1 << 14)]
                out.update(zip(some, self.merge_many(some), strict=True))
        return out


class Encoder:
    """Texts to ids, with a bounded table of the parts it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.odd = regex.compile(r" (?:\s|$)").search
        self.kept: dict[str, bytes] = {}
        self.letters = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        parted = [self._parts(t) for t in texts]
        if len(self.kept) > KEPT or self.letters > LETTERS:
            self.kept, self.letters = {}, 0
        kept = self.kept
        new = set().union(*parted).difference(kept)
        if new:
            self.letters += sum(map(len, new))
            # a space and letters are one match
            pieces = {part: [part.encode()] if part[1:].isalpha() and part[0] == " " else [p.encode() for p in self.split(part)] for part in new}
            ids = self.vocabulary.encode_pieces(list(set().union(*pieces.values())))
            for part, own in pieces.items():
                kept[part] = b"".join([ids[p] for p in own])
        return [b"".join(map(kept.__getitem__, parts)) for parts in parted]

    def _parts(self, text: str) -> list[str]:
        if not text:
            return []
        if self.odd(text):
            return self.split(text)
        first, *rest = text.split(" ")
        return [first, *(" " + r for r in rest)] if first else [" " + r for r in rest]


#: A worker's encoder, kept between tasks under the digest of its vocabulary and pattern.
_encoders: dict[str, Encoder] = {}


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the binary column ``ids`` of each text's token ids.

    ranks: of fixed size, sent to each executor once.
    """
    source, schema = extended(docs, **{ids: "binary"})
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(*sent.value)
        encoder = _encoders[name]
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, off = K.flat(column)
            for a, b in K.blocks(off, CHUNK):
                own = [t or "" for t in column.slice(a, b - a).to_pylist()]
                part = batch.slice(a, b - a)
                yield part.append_column(ids, pa.array(encoder.encode(own), pa.binary()))

    return source.mapInArrow(lean(run), schema)


def bpe_decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the binary column ``decoded``: the bytes of the tokens in ``ids``; null ids count as none."""
    source, schema = extended(docs, **{decoded: "binary"})
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [b""] * (max(sent.value.values()) + 1)
        for token, rank in sent.value.items():
            tokens[rank] = token
        get: Callable[[int], bytes] = tokens.__getitem__
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            out = [b"".join(map(get, np.frombuffer(x or b"", "<u4").tolist())) for x in column.to_pylist()]
            yield batch.append_column(decoded, pa.array(out, pa.binary()))

    return source.mapInArrow(lean(run), schema)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    encoded = bpe_encode(docs.select("doc_id", "text"), ranks, pattern).select("doc_id", "ids")
    return bpe_decode(encoded, ranks).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
