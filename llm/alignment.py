"""Cross-tokenizer alignment: the smallest groups of tokens of two tokenizers that cover the same bytes, and which tokens go together.

Tokens of both are the two sides of a graph, with an edge wherever their byte ranges overlap. Union-find over all edges of a batch at once
(every root hooks to the smallest root that an edge shows it, then paths are halved until they are flat) gives its connected
components, and these are the smallest groups: a place where both have a border is crossed by no edge, and any other border lies within a
token of the other side. Two ranges overlap in one stretch without a border, so the members of a component
expand to one link for each such stretch.

A text is cut at single spaces between characters that aren't white space. Both tokenizers start a token there (``Aligner`` refuses piece models in which one could
span it), so groups of parts are groups of the text, and a task keeps those of parts it has met in a bounded table. A part may be as
long as the text.

Documents travel as blocks: one row for some megabytes of text, with each document's linked id pairs as indexes into the block's
list of distinct pairs. Only these lists are shuffled, a row for each pair and block: by pair, to add up in how many documents it
is; and back by block, with that count. A pair that all documents hold is a row a block, not a row a document. What is best for each id of the first
tokenizer is as long as its vocabulary, and broadcast.

Null and empty texts, and texts whose joined token bytes differ from space + text (those that hold the space mark U+2581 themselves), have no
tokens: zeros, and an empty digest. Ids of documents may be null or repeat: each row counts as a document of its own, and has a row in the
result. Texts of any length are encoded whole. An empty table gives no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .spark_io import checkpointed, lean

MARK = "▁"
#: Parts of a generation, and their letters; a worker keeps two generations.
KEPT, LETTERS = 200_000, 4_000_000
#: Bytes of text handled at once, and in a block.
CHUNK, BLOCK = 1 << 19, 1 << 23
#: White space, and what has been white space in some version of Unicode.
_WHITE = r"\s\u180e\u200b\u2060\ufeff"
_ODD = re.compile(rf" (?=[{_WHITE}]|$)|(?<=[{_WHITE}]) |^ ")
_CUT = re.compile(rf"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
BLOCKS = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "pairs binary, holders binary, which binary, times binary, bounds binary"
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def letters_of_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def connected(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by union-find over all edges (u, v) at once."""
    parent = np.arange(n)
    while True:
        low, high = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
        if (low == high).all():
            return parent
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in a, place in b) of all pairs of tokens that overlap, in order. ends: rising, alike at the last."""
    border = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, border), np.searchsorted(ends_b, border)


def grouped(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The overlapping pairs, and the group of each token of a and of b, counted from 0."""
    a, b = overlaps(ends_a, ends_b)
    # nodes are numbered by the first stretch that they cover, so that each hooks to one before it
    node_a, node_b = 2 * np.searchsorted(a, np.arange(len(ends_a))), 2 * np.searchsorted(b, np.arange(len(ends_b))) + 1
    root = connected(2 * len(a), node_a[a], node_b[b])
    _, group = np.unique(np.concatenate([root[node_a], root[node_b]]), return_inverse=True)
    return a, b, group[: len(ends_a)], group[len(ends_a) :]


class Aligner:
    """Two tokenizers, and the groups of the parts of text met so far."""

    def __init__(self, first: str, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        byte = letters_of_bytes()
        tokens = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes_a[i] = bytes(byte[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds the mark after another character")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        #: Each id as text behind each sign, of one width.
        self.text_a, self.text_b = (np.array([[f"{sign}{i}" for i in range(len(t))] for sign in signs], "S") for signs, t in ((",;", self.bytes_a), (",|", self.bytes_b)))
        self.kept: dict[str, tuple[int, int, int, bytes, bytes] | None] = {}
        self.before: dict[str, tuple[int, int, int, bytes, bytes] | None] = {}
        self.letters = 0

    @staticmethod
    def parts(text: str) -> list[str]:
        """Parts whose tokens are those of the text; a space before each but the first is left out."""
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def learn(self, parts: list[str]) -> None:
        """Align parts not met before: (tokens of a and of b, groups, groups as text with a semicolon before each, linked id pairs), or None if bytes aren't kept."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        ids_b = self.b.encode(parts, num_threads=1)
        want = [(" " + p).encode() for p in parts]
        if any(b"".join([table[i] for own in ids for i in own]) != b"".join(want) for ids, table in ((ids_a, self.bytes_a), (ids_b, self.bytes_b))):
            same = [b"".join([self.bytes_a[i] for i in x]) == b"".join([self.bytes_b[i] for i in y]) == w for x, y, w in zip(ids_a, ids_b, want, strict=True)]
            self.kept.update((p, None) for p, good in zip(parts, same, strict=True) if not good)
            parts, ids_a, ids_b = ([x for x, good in zip(own, same, strict=True) if good] for own in (parts, ids_a, ids_b))
        if not parts:
            return
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.array([i for own in ids for i in own], np.int64) for ids in (ids_a, ids_b))
        a, b, group_a, group_b = grouped(np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b]))
        # a group's text: its ids of a, the first behind a semicolon, then those of b, the first behind a bar
        width = max(self.text_a.itemsize, self.text_b.itemsize)
        first_a, first_b = (np.diff(g, prepend=-1).astype(bool).astype(np.int64) for g in (group_a, group_b))
        texts = np.concatenate([self.text_a[first_a, flat_a].astype(f"S{width}"), self.text_b[first_b, flat_b].astype(f"S{width}")])
        text = texts[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tobytes()
        link = (flat_a.astype(np.uint64)[a] << np.uint64(32) | flat_b.astype(np.uint64)[b]).tobytes()
        last_a = np.cumsum(n_a)
        groups, links, tokens = [0, *(group_a[last_a - 1] + 1).tolist()], [0, *(8 * np.searchsorted(a, last_a)).tolist()], [0, *(width * np.cumsum(n_a + n_b)).tolist()]
        for k, (p, x, y) in enumerate(zip(parts, n_a.tolist(), n_b.tolist(), strict=True)):
            self.kept[p] = (x, y, groups[k + 1] - groups[k], text[tokens[k] : tokens[k + 1]].replace(b"\0", b""), link[links[k] : links[k + 1]])

    def align(self, texts: list[str]) -> list[tuple[int, int, int, bytes, np.ndarray]]:
        """(tokens of a, of b, groups, groups as text, linked id pairs) of each text."""
        parted = [self.parts(t) if t else [] for t in texts]
        if len(self.kept) > KEPT or self.letters > LETTERS:
            self.before, self.kept, self.letters = self.kept if self.letters <= 2 * LETTERS else {}, {}, 0
        met = set().union(*parted).difference(self.kept)
        self.letters += sum(map(len, met))
        again = [p for p in met if p in self.before]
        self.kept.update((p, self.before[p]) for p in again)
        new = list(met.difference(again))
        start = size = 0
        for k, p in enumerate(new):  # so that no call of the libraries takes much more than a chunk
            size += len(p)
            if size > CHUNK or k == len(new) - 1:
                self.learn(new[start : k + 1])
                start, size = k + 1, 0
        out = []
        for parts in parted:
            got = [self.kept[p] for p in parts]
            if not got or None in got:
                out.append((0, 0, 0, b"", np.zeros(0, np.uint64)))
                continue
            n_a, n_b, n_groups, groups, links = zip(*got, strict=True)
            out.append((sum(n_a), sum(n_b), sum(n_groups), b"".join(groups)[1:], np.frombuffer(b"".join(links), np.uint64)))
        return out


_aligners: dict[str, Aligner] = {}


def _aligner(name: str, files: tuple[str, bytes]) -> Aligner:
    if name not in _aligners:
        _aligners.clear()
        _aligners[name] = Aligner(*files)
    return _aligners[name]


def _aligned_texts(docs: DataFrame, first: str, second: bytes, run_texts, schema: str) -> DataFrame:
    """``run_texts(aligner, batches)`` over (doc_id, text). first, second: the tokenizers' files, of fixed size, sent to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast((first, second))
    name = hashlib.sha256(first.encode() + second).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run_texts(_aligner(name, sent.value), batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


def _in_chunks(aligner: Aligner, batches: Iterator[pa.RecordBatch]):
    """(doc_id, bytes of text, alignment) of each document."""
    for batch in batches:
        column = batch.column("text")
        for a, b in K.blocks(K.flat(column)[1], CHUNK):
            texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
            yield from zip(batch.column("doc_id").slice(a, b - a).to_pylist(), map(len, texts), aligner.align(texts), strict=True)


def token_groups(docs: DataFrame, first: str, second: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, groups): each text's groups as text, ids of a before a bar and those of b behind it, groups between semicolons."""

    def run(aligner: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, _, (n_a, n_b, _, text, _) in _in_chunks(aligner, batches):
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([n_a], pa.int64()), pa.array([n_b], pa.int64()), pa.array([text.decode()])], ["doc_id", "n_a", "n_b", "groups"])

    return _aligned_texts(docs, first, second, run, "doc_id long, n_a long, n_b long, groups string")


def _block(number: int, rows: list[tuple]) -> pa.RecordBatch:
    """One row of a block's documents. rows: (doc_id, n_a, n_b, n_groups, n_links, digest, distinct pairs, times of each)."""
    pairs, which = np.unique(np.concatenate([r[6] for r in rows]), return_inverse=True)
    bounds = np.cumsum([0, *(len(r[6]) for r in rows)]).astype(np.int64)
    packed = [pairs, np.bincount(which, minlength=len(pairs)).astype(np.int64), which.astype(np.uint32), np.concatenate([r[7] for r in rows]).astype(np.uint32), bounds]
    kinds = [pa.int64()] * 5 + [pa.string()]
    plain = [pa.array([[r[k] for r in rows]], pa.list_(kind)) for k, kind in enumerate(kinds)]
    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "holders", "which", "times", "bounds"]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *plain, *(pa.array([K.squeezed(c)], pa.binary()) for c in packed)], names)


def blocks(docs: DataFrame, first: str, second: bytes) -> DataFrame:
    """Aligned documents, some megabytes of text a row. A block is numbered by its task: write it before its number is relied on."""

    def run(aligner: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        rows, size = [], 0
        for doc, length, (n_a, n_b, n_groups, text, links) in _in_chunks(aligner, batches):
            pairs, times = np.unique(links, return_counts=True)
            rows.append((doc, n_a, n_b, n_groups, len(links), hashlib.sha256(text).hexdigest() if n_a else "", pairs, times))
            size += length
            if size >= BLOCK:
                yield _block(task, rows)
                task, rows, size = task + 1, [], 0
        if rows:
            yield _block(task, rows)

    return _aligned_texts(docs, first, second, run, BLOCKS)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct pair of a block, with the number of its documents that hold it."""
    for batch in batches:
        for block, pairs, holders in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "holders")), strict=True):
            p, n = K.expanded(pairs, "<u8"), K.expanded(holders, "<i8")
            a, b = (p >> np.uint64(32)).astype(np.int32), (p & np.uint64(0xFFFFFFFF)).astype(np.int32)
            for k in range(0, len(p), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p[part]), block)), pa.array(a[part]), pa.array(b[part]), pa.array(n[part])], ["block", "a", "b", "n"])


def counted(own: DataFrame) -> DataFrame:
    """(block, a, b, n_docs, best): each pair of each block with the number of all documents that hold it, and whether that is its a's highest. own: written blocks."""
    rows = own.select("block", "pairs", "holders").mapInArrow(lean(_listed), "block long, a int, b int, n long")
    rows = checkpointed(rows.select("block", "a", "b", F.sum("n").over(Window.partitionBy("a", "b")).alias("n_docs")))
    highest = rows.groupBy("a").agg(F.max("n_docs").alias("highest"))  # no more rows than the first vocabulary has tokens
    return rows.join(F.broadcast(highest), "a").select("block", "a", "b", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))


def pair_counts(docs: DataFrame, first: str, second: bytes) -> DataFrame:
    """(a, b, n_docs, best): in how many documents tokens a and b overlap, and whether no other b does in more: a token map from the first vocabulary to the second."""
    return counted(checkpointed(blocks(docs, first, second))).groupBy("a", "b").agg(F.first("n_docs").alias("n_docs"), F.first("best").alias("best"))


def _told(own: pa.Table, told: pa.Table) -> pa.Table:
    """A block's documents with the counts of their links."""
    out = []
    key = told["a"].to_numpy().astype(np.uint64) << np.uint64(32) | told["b"].to_numpy().astype(np.uint64)
    order = np.argsort(key)
    n, best = told["n_docs"].to_numpy()[order], told["best"].to_numpy()[order].astype(np.int64)
    for row in own.to_pylist():
        which, times, bounds = K.expanded(row["which"], "<u4"), K.expanded(row["times"], "<u4").astype(np.int64), K.expanded(row["bounds"], "<i8")
        at = lambda x: np.concatenate([[0], np.cumsum(x)])[bounds]
        sums = [np.diff(at(times * best[which])), np.diff(at(times * n[which]))]
        plain = [pa.array(row[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        out.append(pa.table([*plain, *map(pa.array, sums), pa.array(row["groups_sha256"], pa.string())], names=[f.split()[0] for f in ALIGNED.split(", ")]))
    return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 7 + [pa.array([], pa.string())], names=[f.split()[0] for f in ALIGNED.split(", ")])


def aligned(docs: DataFrame, first: str, second: bytes) -> DataFrame:
    """Counts of each document's tokens, groups and links, of links that are best corpus-wide and of documents over its links, and the digest of its groups."""
    own = checkpointed(blocks(docs, first, second))
    return own.groupBy("block").cogroup(counted(own).groupBy("block")).applyInArrow(_told, ALIGNED)
