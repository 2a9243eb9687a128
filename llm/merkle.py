"""Document fingerprints: a Merkle tree over each text's sections and paragraphs.

A section ends after blank lines, a paragraph after its line end. Below the paragraphs stand leaves of ``MOST`` bytes at most: they end
where the hash of the last ``WINDOW`` bytes of the text says so, so an edit moves the borders beside it alone. A paragraph's hash is
that of its bytes, a section's that of its paragraphs' hashes, the root's that of the sections' hashes: equal texts have equal roots.

A fingerprint is the root and the tree's leaves, each with a short hash and its size; ``;`` stands between sections and ``,`` between paragraphs,
whose hashes follow from those of their leaves. Two fingerprints alone tell where texts differ and how alike they are: both trees are
descended together, branches that occur in both count whole, and only the others are entered (``likeness``, ``differences``).
The likeness is twice the bytes of what both hold over the bytes of both, 1 for equal roots.

Null text counts as empty, with a likeness of 0 to all but other empty texts. Repeated rows and extra columns do no harm.

An empty table gives no rows. A fingerprint is about a third as long as its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .spark_io import extended, lean, partitions_for

#: Bytes whose hash ends a leaf, one in ``EVERY`` times; bytes of a leaf at most, so that its size is one digit.
WINDOW, EVERY, MOST = 8, 16, 63
_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_VALUES = np.zeros(256, np.int64)
_VALUES[_DIGITS] = np.arange(64)
#: Digits of a leaf's hash, and of a leaf with its size.
HASH, LEAF = 4, 5
_LINE, _SECTION = ord(","), ord(";")


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _joined(child: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each run of children, in their order; first: where each run begins, and the end."""
    if len(first) < 2:
        return np.zeros(0, np.uint64)
    place = np.arange(len(child)) - np.repeat(first[:-1], np.diff(first))
    return K.mix(np.add.reduceat(K.mix(child.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), first[:-1]))


class Forest:
    """The trees of several texts, level by level: documents, sections, paragraphs, leaves.

    first[k]: where the children of each node of level k begin among those of level k + 1, and their end; hashes and sizes by level from 1 on.
    """

    def __init__(self, leaf: np.ndarray, size: np.ndarray, paragraphs: np.ndarray, sections: np.ndarray, docs: np.ndarray):
        """leaf: short hashes; the others but size: where children begin, and their end."""
        self.first = [docs, sections, paragraphs]
        lines = _joined(leaf << 6 | size, paragraphs)
        self.hashes = [None, _joined(lines, sections), lines, (leaf << 6 | size).astype(np.uint64)]
        upto = np.append(0, np.cumsum(size))
        self.bounds = [upto[paragraphs[sections[docs]]], upto[paragraphs[sections]], upto[paragraphs], upto]
        self.leaf, self.size = leaf, size

    def sizes(self, level: int) -> np.ndarray:
        return np.diff(self.bounds[level])

    def written(self) -> list[str]:
        """Fingerprints without their roots."""
        docs, sections, paragraphs = self.first
        n = len(self.leaf)
        digits = np.empty((n, LEAF), np.uint8)
        for k in range(HASH):
            digits[:, k] = _DIGITS[(self.leaf >> (6 * k)) & 63]
        digits[:, HASH] = _DIGITS[self.size]
        sign = np.zeros(n + 1, np.uint8)  # before each leaf
        sign[paragraphs[:-1]] = _LINE
        sign[paragraphs[sections[:-1]]] = _SECTION
        begins = paragraphs[sections[docs]]
        sign[begins] = 0
        width = LEAF + (sign[:-1] != 0)
        at = np.append(0, np.cumsum(width))
        out = np.empty(at[-1], np.uint8)
        out[at[:-1][sign[:-1] != 0]] = sign[:-1][sign[:-1] != 0]
        out[(at[1:] - LEAF)[:, None] + np.arange(LEAF)] = digits
        whole, cut = out.tobytes().decode("ascii"), at[begins]
        return [whole[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def parse(fingerprint: str) -> tuple[str, Forest]:
    """The root and the tree that a fingerprint holds."""
    root, _, body = fingerprint.partition(":")
    data = np.frombuffer(body.encode("ascii"), np.uint8)
    sign = (data == _LINE) | (data == _SECTION)
    values = _VALUES[data[~sign]].reshape(-1, LEAF)
    leaf = (values[:, :HASH] << (6 * np.arange(HASH))).sum(1)
    place = np.flatnonzero(sign)
    leaves = (place - np.arange(len(place))) // LEAF  # before each sign
    n = len(leaf)
    paragraphs = np.concatenate([[0], leaves, [n]]) if n else np.zeros(1, np.int64)
    sections = np.concatenate([[0], np.flatnonzero(data[place] == _SECTION) + 1, [len(paragraphs) - 1]]) if n else np.zeros(1, np.int64)
    return root, Forest(leaf, values[:, HASH], paragraphs, sections, np.array([0, len(sections) - 1]))


def grown(data: np.ndarray, off: np.ndarray) -> tuple[Forest, list[bytes]]:
    """The trees of a block of texts, and their roots. off: relative to data."""
    n = len(data)
    s = K.prefix_hash(data)
    cut = np.zeros(n + 1, bool)
    if n > WINDOW:
        at = np.arange(WINDOW, n)
        h = K.mix((s[WINDOW:n] - s[: n - WINDOW]) * K.powers(len(s))[1][: n - WINDOW])
        cut[at] = (h % np.uint64(EVERY)) == 0
        for d in off[:-1]:  # a window lies within one text
            cut[d : d + WINDOW] = False
    line = data == ord("\n")
    cut[1:] |= line
    cut[off] = True
    begin = np.flatnonzero(cut[:n])
    length = np.diff(np.append(begin, n))
    parts = -(-length // MOST)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(begin, parts) + MOST * inner
    size = np.diff(np.append(begin, n))
    leaf = (K.mix(K.span_hash(s, begin, begin + size)) >> np.uint64(64 - 6 * HASH)).astype(np.int64)

    top = np.zeros(n + 1, bool)  # where paragraphs begin
    top[1:] = line
    top[off] = True
    text = np.flatnonzero(top[:n])
    paragraphs = np.append(np.searchsorted(begin, text), len(begin))
    blank = np.add.reduceat(~np.isin(data, np.frombuffer(b" \t\r\n", np.uint8)), text, dtype=np.int64) == 0 if len(text) else np.zeros(0, bool)
    new = np.isin(text, off)
    new[1:] |= blank[:-1] & ~blank[1:]
    heads = np.flatnonzero(new)
    sections = np.append(heads, len(text))
    docs = np.searchsorted(text[heads], off)
    raw = data.tobytes()
    ends = np.append(text[1:], n)[: len(text)]
    lines = [digest(raw[a:b]) for a, b in zip(text.tolist(), ends.tolist(), strict=True)]
    tops = [digest(b"".join(lines[a:b])) for a, b in zip(sections[:-1].tolist(), sections[1:].tolist(), strict=True)]
    roots = [digest(b"root" + b"".join(tops[a:b])) for a, b in zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True)]
    return Forest(leaf, size, paragraphs, sections, docs), roots


def _children(first: np.ndarray, node: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = first[node + 1] - first[node]
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[node], n), np.repeat(pair, n)


def _matched(ha: np.ndarray, pa_: np.ndarray, hb: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes (hash, pair) of either side, which have a counterpart on the other; a node answers for one."""
    h, p, side = np.concatenate([ha, hb]), np.concatenate([pa_, pb]), np.repeat(np.array([0, 1]), [len(ha), len(hb)])
    order = np.lexsort((side, h, p))
    h, p, side = h[order], p[order], side[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    of_a = np.bincount(group, side == 0, len(begin)).astype(np.int64)
    of_b = np.bincount(group, side == 1, len(begin)).astype(np.int64)
    rank = np.arange(len(h)) - begin[group] - np.where(side == 1, of_a[group], 0)
    out = np.zeros(len(h), bool)
    out[order] = rank < np.minimum(of_a, of_b)[group]
    return out[: len(ha)], out[len(ha) :]


def descend(a: Forest, in_a: np.ndarray, b: Forest, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both trees of each pair of texts together: bytes in common by pair, and the leaves (pair, leaf of b) that a doesn't hold."""
    pair = np.arange(len(in_a))
    shared = np.zeros(len(in_a), np.int64)
    (na, qa), (nb, qb) = (in_a, pair), (in_b, pair)
    for level in (1, 2, 3):
        na, qa = _children(a.first[level - 1], na, qa)
        nb, qb = _children(b.first[level - 1], nb, qb)
        same_a, same_b = _matched(a.hashes[level][na], qa, b.hashes[level][nb], qb)
        shared += np.bincount(qb[same_b], b.sizes(level)[nb[same_b]], len(pair)).astype(np.int64)
        na, qa, nb, qb = na[~same_a], qa[~same_a], nb[~same_b], qb[~same_b]
    return shared, qb, nb


def likeness(a: Forest, in_a: np.ndarray, roots_a: list, b: Forest, in_b: np.ndarray, roots_b: list) -> list[float]:
    """For each pair of texts, by place in a and b: twice the bytes in common over the bytes of both; 1 for equal roots."""
    shared, _, _ = descend(a, in_a, b, in_b)
    both = a.sizes(0)[in_a] + b.sizes(0)[in_b]
    return [1.0 if roots_a[i] == roots_b[j] else float(x) for i, j, x in zip(in_a, in_b, 2 * shared / np.maximum(both, 1), strict=True)]


def alike(old: str, new: str) -> float:
    """Likeness of two fingerprints."""
    (r, a), (q, b) = parse(old), parse(new)
    one = np.zeros(1, np.int64)
    return likeness(a, one, [r], b, one, [q])[0]


def differences(old: str, new: str) -> list[tuple[int, int]]:
    """Byte ranges of the new fingerprint's text whose leaves the old one doesn't hold; equal branches aren't entered."""
    (r, a), (q, b) = parse(old), parse(new)
    if r == q:
        return []
    one = np.zeros(1, np.int64)
    _, _, leaf = descend(a, one, b, one)
    out: list[tuple[int, int]] = []
    for x, y in zip(b.bounds[3][leaf].tolist(), b.bounds[3][leaf + 1].tolist(), strict=True):
        if out and out[-1][1] == x:
            out[-1] = (out[-1][0], y)
        else:
            out.append((x, y))
    return out


def _grown(texts: list[str]) -> tuple[Forest, list[bytes], list[str]]:
    data, off = K.flat(pa.array(texts, pa.string()))
    forest, roots = grown(data[off[0] : off[-1]], off - off[0])
    return forest, roots, [f"{r.hex()}:{x}" for r, x in zip(roots, forest.written(), strict=True)]


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in K.blocks(K.flat(column)[1]):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                yield batch.slice(a, b - a).append_column("fingerprint", pa.array(_grown(texts)[2], pa.string()))

    source, schema = extended(docs, fingerprint="string")
    return source.mapInArrow(lean(run), schema)


def _parts(bounds: list[int], first: dict[int, int] | None):
    """Adds each row's part by ``bounds``; the first rows of a part also go to the part before it, as ``late`` rows."""
    edges = np.array(bounds, np.int64)
    order = sorted(first) if first else []
    before = {first[p]: order[k - 1] for k, p in enumerate(order)} if first else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            part = np.searchsorted(edges, ids, "right")
            heads = np.flatnonzero(np.isin(ids, list(before))) if before else []
            yield batch.append_column("part", pa.array(part, pa.int32())).append_column("late", pa.array(np.zeros(len(ids), bool)))
            if len(heads):
                again = batch.take(pa.array(heads))
                to = pa.array([before[int(i)] for i in ids[heads]], pa.int32())
                yield again.append_column("part", to).append_column("late", pa.array(np.ones(len(heads), bool)))

    return run


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """``run(rows)`` over ``docs(doc_id, text)`` in order of doc_id, then text (nulls first), each row followed by its successor.

    run takes an iterator of (doc_id array, text array, part array, late array) and gives batches of ``schema``. Each part of the order
    ends with late copies of the rows that begin the next part; the last part's are those of the first.
    """
    n = partitions_for(docs.sparkSession, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(cuts or []))
    parted = ids.mapInArrow(lean(_parts(bounds, None)), "doc_id long, part int, late boolean")
    lowest = F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("low")
    first = {r["part"]: r["low"] for r in parted.groupBy("part").agg(lowest).collect()}  # a row a part
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spread = source.mapInArrow(lean(_parts(bounds, first)), "doc_id long, text string, part int, late boolean")
    return spread.repartitionById(n, "part").sortWithinPartitions("part", "late", "doc_id", "text").mapInArrow(lean(run), schema)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left: pa.RecordBatch | None = None
    for batch in batches:
        for a, b in K.blocks(K.flat(batch.column("text"))[1]):
            rows = pa.Table.from_batches([batch.slice(a, b - a)] if left is None else [left, batch.slice(a, b - a)]).combine_chunks()
            left = rows.slice(rows.num_rows - 1).to_batches()[0]
            if rows.num_rows > 1:
                yield _edited(rows)


def _edited(rows: pa.Table) -> pa.RecordBatch:
    """All rows but the last and the late ones, each against the row after it."""
    texts = rows["text"].to_pylist()
    part, late = rows["part"].to_numpy(), rows["late"].to_numpy()
    own = [i for i in range(len(texts) - 1) if not late[i]]
    assert all(part[i] == part[i + 1] for i in own)
    edited = []
    for i in own:
        k = len(texts[i]) // 4
        edited.append(texts[i][: len(texts[i]) - k] + texts[i + 1][:k])
    forest, roots, prints = _grown(texts)
    new_forest, new_roots, new_prints = _grown(edited)
    at = np.array(own, np.int64)
    near = likeness(forest, at, roots, new_forest, np.arange(len(own)), new_roots)
    next_ = likeness(forest, at, roots, forest, at + 1, roots)
    return pa.RecordBatch.from_arrays(
        [
            rows["doc_id"].combine_chunks().take(pa.array(own, pa.int64())),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([prints[i] for i in own], pa.string()),
            pa.array(new_prints, pa.string()),
            pa.array(near, pa.float64()),
            pa.array(next_, pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint against that of its edited text and of the next document.

    The edited text: the last floor(n_chars / 4) code points give way to the first as many (or all) of the next document's.
    """
    return with_next(docs, _compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
