"""Suffix-array dedup: removes every byte covered by a string of ``LENGTH`` bytes that also starts in an earlier document.

1. Each stretch of LENGTH bytes has an anchor, a 16-byte gram that equal stretches choose alike (``llm.anchors``). Tasks send
   the hashes of their documents' anchors to buckets; an anchor found in one document alone can't be part of a repeat and
   is dropped. A task answers for the anchors that several of its own documents share and sends one row for each of them.
2. Documents' bytes meet the anchors that are left. A stretch holds 17 bytes more on the left or on the right of its anchor; with
   these it is dealt to a bucket, so that a common gram in ever other surroundings spreads over all of them. Each task combines equal spans
   of stretches first (found by a hash, compared byte by byte): all but those of its earliest document are repeats already, and one copy of each span goes on, so a
   passage held by a third of all documents sends a row a task. In each bucket equal spans are combined once more; then the suffixes that start in the spans
   are put in order by deep-shallow sorting (``llm.suffix_sort``); of equal ones, those of documents after the earliest are removed.
   Spans that are dealt alike but differ, as around a short line that many documents hold, aren't gathered: where a task has more than ``ALIKE``
   of them, or a bucket more than SUFFIXES suffixes, they are broken into their stretches, and these are dealt by their own hashes, of 128 bits as their bytes
   don't travel. A task keeps those of its earliest document; equal ones meet in one more shuffle. A bucket thus holds ALIKE spans a task of one deal at most.
3. Documents' bytes meet their removed ranges and are put together.

Texts are UTF-8 bytes; null counts as empty. Documents are ordered by id; a null id comes after all others. Repeated rows of one id are
no earlier than each other, so neither removes the other's bytes. Extra columns are ignored, and an empty table gives no rows. Texts of any length are cut
into overlapping stretches, and no document or passage is gathered with all of its repeats.

Rows are told apart by a number, never by a hash. All of it is one chain of shuffles without intermediate files; rows that travel are packed and compressed, so they stay few and
small, and the texts are shuffled once for steps 2 and 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textkit as K
from .anchors import anchors
from .spark_io import lean, numbered, partitions_for, tidy
from .suffix_sort import sort_strings
from .textkit import expanded, squeezed

LENGTH, GRAM = 50, 16
#: Bytes beside the anchor that deal a stretch to its bucket.
BESIDE = (LENGTH - GRAM) // 2
#: Kinds of packed rows.
ASKED, KNOWN, CANDIDATES, TEXTS, SPANS, RANGES, BROKEN, STRETCHES = range(8)
#: Suffixes sorted at once in a bucket, and bytes of text packed at once.
SUFFIXES, PACKED = 1 << 19, 1 << 25
#: Different spans that a task sends dealt alike, and stretches that it breaks spans into at once.
ALIKE, BREAK = 256, 1 << 22
#: Bytes compared at once.
COMPARED = 1 << 20
LAST = (1 << 63) - 1

_CELLS = [f"c{k}" for k in range(7)]
SCHEMA = "part int, kind int, " + ", ".join(f"{c} binary" for c in _CELLS)


def _row(kind: int, part: int, *blobs: bytes) -> pa.RecordBatch:
    cells = [pa.array([b], pa.binary()) for b in blobs] + [pa.nulls(1, pa.binary())] * (len(_CELLS) - len(blobs))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), *cells], ["part", "kind", *_CELLS])


def _split(part: np.ndarray, n_parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and the places of its rows, in their order."""
    order = np.argsort(part, kind="stable")
    bound = np.searchsorted(part[order], np.arange(n_parts + 1))
    for k in np.flatnonzero(np.diff(bound)):
        yield int(k), order[bound[k] : bound[k + 1]]


def _rows(kind: int, part: np.ndarray, n_parts: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k, at in _split(part, n_parts):
        yield _row(kind, k, *(squeezed(c[at]) for c in columns))


class _Pile:
    """Packed rows of one kind, unpacked into arrays."""

    def __init__(self, *types: str):
        self.types, self.got = types, [[np.zeros(0, t)] for t in types]

    def add(self, row: dict) -> None:
        for k, t in enumerate(self.types):
            self.got[k].append(expanded(row[f"c{k}"], t))

    def arrays(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in self.got]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _stretches(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a block; a text longer than a block is cut into overlapping pieces."""
    if len(data) <= 2 * K.BLOCK:
        yield anchors(data, off, LENGTH, GRAM)
        return
    for at in range(0, max(1, len(data) - LENGTH + 1), K.BLOCK):
        end = min(len(data), at + K.BLOCK + LENGTH - 1)
        inner = np.unique(np.clip(off, at, end)) - at
        place, h, first, last = anchors(data[at:end], inner, LENGTH, GRAM)
        yield place + at, h, first + at, last + at


def _asked(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[] for _ in range(6)]
        for batch in batches:
            data, off = K.flat(batch.column("text"))
            keys, orders = batch.column("key").to_numpy(), batch.column("ord").to_numpy()
            for a, b in K.blocks(off):
                own = off[a : b + 1] - off[a]
                for place, h, first, last in _stretches(data[off[a] : off[b]], own):
                    doc = np.searchsorted(own, place, "right") - 1
                    row = (h, keys[a:b][doc], orders[a:b][doc], (place - own[doc]).astype(np.uint32), (place - first).astype(np.uint8), (place - last).astype(np.uint8))
                    for x, column in zip(got, row, strict=True):
                        x.append(column)
        if not got[0]:
            return
        h, key, order, place, first, last = (np.concatenate(x) for x in got)
        del got
        by = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(h[by]) != 0]) if len(h) else np.zeros(0, np.int64)
        if not len(at):
            return
        many = np.minimum.reduceat(order[by], at) != np.maximum.reduceat(order[by], at)
        shared = np.zeros(len(h), bool)
        shared[by] = np.repeat(many, np.diff(np.append(at, len(h))))
        known = h[by][at[many]]
        one = np.flatnonzero(~shared)
        low, high = (h >> np.uint64(16)).astype(np.uint32), (h >> np.uint64(48)).astype(np.uint16)
        bucket = (h % np.uint64(n_parts)).astype(np.int64)
        yield from _rows(ASKED, bucket[one], n_parts, low[one], high[one], key[one], place[one], first[one], last[one])
        yield from _rows(KNOWN, (known % np.uint64(n_parts)).astype(np.int64), n_parts, (known >> np.uint64(16)).astype(np.uint32), (known >> np.uint64(48)).astype(np.uint16))
        yield from _rows(CANDIDATES, key[shared] % n_parts, n_parts, key[shared], place[shared], first[shared], last[shared])

    return run


def _shared(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = _Pile("u4", "u2", "i8", "u4", "u1", "u1"), _Pile("u4", "u2")
        for row in _each(batches):
            if row["kind"] == ASKED:
                asked.add(row)
            elif row["kind"] == KNOWN:
                known.add(row)
            else:
                yield _row(row["kind"], row["part"], *(row[c] for c in _CELLS if row[c] is not None))
        low, high, key, place, first, last = asked.arrays()
        h = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        klow, khigh = known.arrays()
        k = np.unique(klow.astype(np.uint64) | (khigh.astype(np.uint64) << np.uint64(32)))
        del asked, known, low, high
        if not len(h):
            return
        by = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(h[by]) != 0])
        many = np.minimum.reduceat(key[by], at) != np.maximum.reduceat(key[by], at)
        if len(k):
            here = np.minimum(np.searchsorted(k, h[by][at]), len(k) - 1)
            many |= k[here] == h[by][at]
        kept = np.sort(by[np.repeat(many, np.diff(np.append(at, len(h))))])
        yield from _rows(CANDIDATES, key[kept] % n_parts, n_parts, key[kept], place[kept], first[kept], last[kept])

    return run


def _packed(n_parts: int):
    """Documents' bytes, compressed, for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            _, off = K.flat(batch.column("text"))
            for a, b in K.blocks(off, PACKED):
                some = batch.slice(a, b - a)
                key = some.column("key").to_numpy()
                texts = some.column("text").cast(pa.large_binary()).to_pylist()
                order, null = some.column("ord").to_numpy(), some.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                for k, at in _split(key % n_parts, n_parts):
                    own = [texts[i] for i in at]
                    yield _row(TEXTS, k, key[at].tobytes(), order[at].tobytes(), null[at].tobytes(), np.array([len(t) for t in own], np.int64).tobytes(), pack(b"".join(own)))

    return run


def _unpacked(row: dict) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of whole documents: bytes, offsets, key, order, null."""
    key, order, null, size = (np.frombuffer(row[f"c{k}"], t) for k, t in enumerate(("i8", "i8", "?", "i8")))
    off = np.cumsum(np.append(0, size))
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["c4"], max_output_size=max(1, int(off[-1]))), np.uint8) if off[-1] else np.zeros(0, np.uint8)
    for a, b in K.blocks(off):
        yield data[off[a] : off[b]], off[a : b + 1] - off[a], key[a:b], order[a:b], null[a:b]


def _ranges_of(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: places of all rows of each wanted key, and which wanted one each is of."""
    lo, hi = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
    n = hi - lo
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), np.repeat(np.arange(len(wanted)), n)


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]


def _broken(data: np.ndarray, base: np.ndarray, size: np.ndarray, order: np.ndarray, key: np.ndarray, start: np.ndarray, n_parts: int) -> Iterator[pa.RecordBatch]:
    """Stretches of spans, dealt by their hashes, those of the earliest document; the others have been met before and go."""
    some = np.cumsum(size - LENGTH + 1) // BREAK
    for _, at in _split(some, int(some[-1]) + 1 if len(some) else 0):
        n = size[at] - LENGTH + 1
        of = np.repeat(at, n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.cumsum(size[at]) - size[at]
        bytes_ = _gathered(data, base[at], size[at])
        place = np.repeat(own, n) + inner
        h, again = (K.mix(K.span_hash(K.prefix_hash(bytes_, t), place, place + LENGTH)) for t in (K.BYTES, K.OTHER_BYTES))
        row = (h, again, order[of], key[of], (start[of] + inner).astype(np.uint32))
        yield from _earliest(*row, n_parts, STRETCHES)


def _earliest(h: np.ndarray, again: np.ndarray, order: np.ndarray, key: np.ndarray, start: np.ndarray, n_parts: int, kind: int | None) -> Iterator[pa.RecordBatch]:
    """Of equal stretches, those of the earliest document as rows of the kind, if any; the ranges of the others go."""
    by = np.lexsort((start, key, order, again, h))
    h, again, order, key, start = h[by], again[by], order[by], key[by], start[by]
    at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (again[1:] != again[:-1])]) if len(h) else np.zeros(0, np.int64)
    late = order != np.repeat(order[at], np.diff(np.append(at, len(h))))
    if kind is not None:
        # a document's stretch counts once for what others are compared with, but each of its places may go
        yield from _rows(kind, (h[~late] % np.uint64(n_parts)).astype(np.int64), n_parts, h[~late], again[~late], order[~late], key[~late], start[~late])
    key, start = key[late], start[late].astype(np.int64)
    by = np.lexsort((start, key))
    key, start = key[by], start[by]
    if len(key):  # runs of stretches side by side are one range, of the 255 bytes at most that its size can tell
        new = np.r_[True, (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)]
        run = np.flatnonzero(new)
        new |= (start - np.repeat(start[run], np.diff(np.append(run, len(key))))) % (255 - LENGTH) == 0
        run = np.flatnonzero(new)
        end = start[np.append(run[1:], len(key)) - 1] + LENGTH
        yield from _rows(RANGES, key[run] % n_parts, n_parts, key[run], start[run].astype(np.uint32), (end - start[run]).astype(np.uint8))


def _spans(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates, texts = _Pile("i8", "u4", "u1", "u1"), []
        for row in _each(batches):
            if row["kind"] == TEXTS:
                texts.append(row)
            else:
                candidates.add(row)
        key, place, first, last = candidates.arrays()
        by = np.argsort(key, kind="stable")
        key, place, first, last = key[by], place[by].astype(np.int64), first[by].astype(np.int64), last[by].astype(np.int64)
        got: list[list[np.ndarray]] = [[] for _ in range(7)]
        while texts:
            for data, off, keys, orders, _ in _unpacked(texts.pop()):
                at, doc = _ranges_of(key, keys)
                if not len(at):
                    continue
                s = K.prefix_hash(data)
                anchor = off[doc] + place[at]
                for left in (True, False):
                    # starts of the stretches that have BESIDE bytes left of the anchor, or else right of it
                    lo, hi = anchor - first[at], anchor - last[at]
                    lo, hi = (lo, np.minimum(hi, anchor - BESIDE)) if left else (np.maximum(lo, anchor - BESIDE + 1), hi)
                    some = lo <= hi
                    lo, hi, mid, of = lo[some], hi[some] + LENGTH, anchor[some], doc[some]
                    deal = K.span_hash(s, mid - BESIDE, mid + GRAM) if left else K.span_hash(s, mid, mid + GRAM + BESIDE)
                    deal = K.mix(deal + np.uint64(left))
                    same = K.mix(K.span_hash(s, lo, hi) + (hi - lo).astype(np.uint64)) ^ deal
                    row = (same, deal, keys[of], orders[of], (lo - off[of]).astype(np.uint32), (hi - lo).astype(np.uint8), _gathered(data, lo, hi - lo))
                    for x, column in zip(got, row, strict=True):
                        x.append(column)
        if not got[0]:
            return
        same, deal, key, order, start, size = (np.concatenate(x) for x in got[:6])
        data = np.concatenate(got[6])
        del got
        base = np.cumsum(size, dtype=np.int64) - size
        by, at = _equals(same, order, data, base, size.astype(np.int64))
        length = np.diff(np.append(at, len(by)))
        earliest = order[by] == np.repeat(order[by][at], length)
        gone = by[~earliest]  # an earlier document of this task has the whole span
        yield from _rows(RANGES, key[gone] % n_parts, n_parts, key[gone], start[gone], size[gone])
        holder = by[earliest]
        holders = np.add.reduceat(earliest.astype(np.int64), at).astype(np.uint32)
        head, group_of = by[at], np.repeat(np.arange(len(at)), holders)
        deals, which, alike = np.unique(deal[head], return_inverse=True, return_counts=True)
        hot = alike[which] > ALIKE
        if hot.any():
            yield from _rows(BROKEN, (deals[alike > ALIKE] % np.uint64(n_parts)).astype(np.int64), n_parts, (deals[alike > ALIKE] >> np.uint64(32)).astype(np.uint32))
            out = holder[hot[group_of]]
            yield from _broken(data, base[out], size[out].astype(np.int64), order[out], key[out], start[out], n_parts)
        pack = zstandard.ZstdCompressor(level=1).compress
        cool = np.flatnonzero(~hot)
        for k, own in _split((deal[head[cool]] % np.uint64(n_parts)).astype(np.int64), n_parts):
            own = cool[own]
            own = own[np.lexsort((start[head[own]], key[head[own]], order[head[own]]))]  # a document's spans lie side by side
            h = head[own]
            held = holder[_ranges_of(group_of, own)[0]]
            span = pack(_gathered(data, base[h], size[h].astype(np.int64)).tobytes())
            sub = (deal[h] >> np.uint64(32)).astype(np.uint32)
            yield _row(SPANS, k, *map(squeezed, (sub, size[h], order[h], holders[own], key[held], start[held])), span)

    return run


def _equals(same: np.ndarray, order: np.ndarray, data: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans by groups of equal bytes, of each the earliest first, and where groups begin. same: hashes, which only propose groups: spans
    that differ from the first of theirs are proposed again by themselves."""
    while True:
        by = np.lexsort((order, same))
        new = np.ones(len(by), bool)
        new[1:] = same[by[1:]] != same[by[:-1]]
        first = np.flatnonzero(new)
        head = by[first][np.cumsum(new) - 1]
        bad = size[by] != size[head]
        check = np.flatnonzero((by != head) & ~bad)
        for some in np.split(check, np.flatnonzero(np.diff(np.cumsum(size[by[check]]) // COMPARED)) + 1) if len(check) else []:
            n = size[by[some]]
            differs = _gathered(data, base[by[some]], n) != _gathered(data, base[head[some]], n)
            bad[some] = np.add.reduceat(differs, np.cumsum(n) - n, dtype=np.int64) > 0
        if not bad.any():
            return by, first
        same[by[bad]] = K.mix(same[by[bad]] + np.uint64(1))


def removed_stretches(data: np.ndarray, base: np.ndarray, size: np.ndarray, order: np.ndarray, length: int, deal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (span, from, to) of bytes in strings of ``length`` that also start in a span of smaller order; equal ones are dealt alike."""
    n = size - length + 1
    span = np.repeat(np.arange(len(n)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    by, group = sort_strings(data, base[span] + inner, length, deal[span])
    if not len(by):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.flatnonzero(np.r_[True, np.diff(group) != 0])
    least = np.minimum.reduceat(order[span[by]], first)
    late = np.zeros(len(by), bool)
    late[by] = order[span[by]] > np.repeat(least, np.diff(np.append(first, len(by))))
    at = np.flatnonzero(late)
    new = np.ones(len(at), bool)
    new[1:] = (span[at[1:]] != span[at[:-1]]) | (at[1:] != at[:-1] + 1)
    begin = at[new]
    end = at[np.append(new[1:], True)] if len(at) else at
    return span[begin], inner[begin], inner[end] + length


def _span_hashes(data: bytes, size: np.ndarray) -> np.ndarray:
    s = K.prefix_hash(np.frombuffer(data, np.uint8))
    end = np.cumsum(size, dtype=np.int64)
    return K.mix(K.span_hash(s, end - size, end) + size.astype(np.uint64))


def _removed(n_parts: int):
    """Combines the equal spans of all tasks as each task has combined its own; what is left and dealt alike is sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile, spans, hashes, broken = _Pile("u4", "u1", "i8", "u4", "i8", "u4"), [], [], _Pile("u4")
        unpack = zstandard.ZstdDecompressor().decompress
        for row in _each(batches):
            if row["kind"] == SPANS:
                pile.add(row)
                spans.append(unpack(row["c6"]))
                hashes.append(_span_hashes(spans[-1], pile.got[1][-1]))
            elif row["kind"] == BROKEN:
                broken.add(row)
            else:
                yield _row(row["kind"], row["part"], *(row[c] for c in _CELLS if row[c] is not None))
        sub, size, order, holders, key, start = pile.arrays()
        if not len(sub):
            return
        data = np.frombuffer(b"".join(spans), np.uint8)
        del spans
        size = size.astype(np.int64)
        base = np.cumsum(size) - size
        hold_at = np.cumsum(holders, dtype=np.int64) - holders

        def ranges(span: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Bytes a to b of each span go, in all documents that hold it."""
            n = holders[span].astype(np.int64)
            held = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(hold_at[span], n)
            k = key[held]
            yield from _rows(RANGES, k % n_parts, n_parts, k, (start[held] + np.repeat(a, n)).astype(np.uint32), np.repeat(b - a, n).astype(np.uint8))

        same = np.concatenate(hashes) ^ K.mix(sub.astype(np.uint64))
        by, first = _equals(same, order, data, base, size)
        later = order[by] > np.repeat(order[by][first], np.diff(np.append(first, len(by))))
        gone = by[later]  # an earlier document has the whole span
        yield from ranges(gone, np.zeros(len(gone), np.int64), size[gone])
        by = by[~later]
        by = by[np.argsort(sub[by], kind="stable")]
        alone = np.r_[True, np.diff(sub[by]) != 0] & np.r_[np.diff(sub[by]) != 0, True] if len(by) else np.zeros(0, bool)
        hot = np.isin(sub[by], broken.arrays()[0])  # other tasks have broken theirs
        by, few = by[~alone | hot], hot[~alone | hot]  # nothing else in the corpus is dealt like the others
        if len(by):
            group = np.cumsum(np.r_[True, np.diff(sub[by]) != 0]) - 1
            few |= np.bincount(group, size[by] - LENGTH + 1)[group] > SUFFIXES
        out, by = by[few], by[~few]
        if len(out):
            n = holders[out].astype(np.int64)
            held = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(hold_at[out], n)
            of = np.repeat(out, n)
            yield from _broken(data, base[of], size[of], order[of], key[held], start[held], n_parts)
        work = np.cumsum(size[by] - LENGTH + 1)
        at = 0
        while at < len(by):  # whole groups of what is dealt alike, about SUFFIXES at once
            end = int(np.searchsorted(work, (work[at - 1] if at else 0) + SUFFIXES, "right"))
            end = int(np.searchsorted(sub[by], sub[by][min(max(end - 1, at), len(by) - 1)], "right"))
            own = by[at:end]
            at = end
            span, a, b = removed_stretches(data, base[own], size[own], order[own], LENGTH, sub[own])
            yield from ranges(own[span], a, b)

    return run


def _settled(n_parts: int):
    """The ranges of stretches that have met; other rows are not for this step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile = _Pile("u8", "u8", "i8", "i8", "u4")
        for row in _each(batches):
            if row["kind"] == STRETCHES:
                pile.add(row)
        yield from _earliest(*pile.arrays(), n_parts, None)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges, texts = _Pile("i8", "u4", "u1"), []
    for row in _each(batches):
        if row["kind"] == TEXTS:
            texts.append(row)
        elif row["kind"] == RANGES:
            ranges.add(row)
    key, start, size = ranges.arrays()
    by = np.argsort(key, kind="stable")
    key, start, size = key[by], start[by].astype(np.int64), size[by].astype(np.int64)
    while texts:
        for data, off, keys, orders, null in _unpacked(texts.pop()):
            at, doc = _ranges_of(key, keys)
            edge = np.bincount(off[doc] + start[at], minlength=len(data) + 1) - np.bincount(off[doc] + start[at] + size[at], minlength=len(data) + 1)
            gone = np.cumsum(edge)[: len(data)] > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[off[:-1][off[:-1] < len(data)]] = gone[off[:-1][off[:-1] < len(data)]]
            n = np.diff(off)
            upto, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(begins))
            n_gone, n_spans = upto[off[1:]] - upto[off[:-1]], spans[off[1:]] - spans[off[:-1]]
            left = data[~gone].tobytes()
            cut = off - upto[off]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys),
                    pa.array(np.where(null, 0, orders), pa.int64(), mask=null),
                    pa.array(n, pa.int64()),
                    pa.array(n_gone, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array([left[cut[i] : cut[i + 1]] for i in range(len(n))], pa.binary()),
                ],
                ["key", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def _beside(rows: DataFrame, texts: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the rows and the texts of each part. The texts' shuffle is one and the same each time."""
    empty = T._parse_datatype_string(schema)
    kinds = to_arrow_schema(empty)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = iter([*left.to_batches(), *right.to_batches()])
        del left, right
        return pa.Table.from_batches(list(lean(run)(rows)), kinds)

    return rows.groupBy("part").cogroup(texts.groupBy("part")).applyInArrow(both, schema)


def without_repeats(docs: DataFrame, number: str | None = None) -> DataFrame:
    """(key, doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs(doc_id, text)``; kept: the bytes that stay.

    number: a column that numbers the rows, each differently and alike when they are computed again, as ``spark_io.numbered`` adds; it becomes the key.
    Without one they are numbered here.
    """
    if number is None:
        docs, number = numbered(docs.select("doc_id", "text"), "key"), "key"
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    doc_id = F.col("doc_id").cast("long")
    tidy(docs.sparkSession)
    docs = docs.select(doc_id.alias("doc_id"), F.col(number).cast("long").alias("key"), F.coalesce(doc_id, F.lit(LAST)).alias("ord"), text)
    n = partitions_for(docs.sparkSession, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    texts = docs.mapInArrow(lean(_packed(n)), SCHEMA)
    asked = docs.select("key", "ord", "text").mapInArrow(lean(_asked(n)), SCHEMA)
    candidates = asked.repartitionById(n, "part").mapInArrow(lean(_shared(n)), SCHEMA)
    spans = _beside(candidates, texts, _spans(n), SCHEMA)
    ranges = spans.repartitionById(n, "part").mapInArrow(lean(_removed(n)), SCHEMA).repartition(n, "part")  # one shuffle for both uses
    ranges = ranges.union(ranges.mapInArrow(lean(_settled(n)), SCHEMA).repartition(n, "part"))
    return _beside(ranges, texts, _kept, "key long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, number: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    return without_repeats(docs, number).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
