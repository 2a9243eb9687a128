"""Best-fit packing of tokenized documents into sequences by hierarchical residual packing.

Documents become ids plus an end id; only longer ones are cut, into full pieces and a rest. The pieces' ids and lengths
are spread over the first tasks by a hash, so that each meets the corpus's mix of lengths wherever its documents lie. Each task packs its own pieces
best-fit, longest first. Bins that are nearly full are final. The others go up a tree: a node
takes the underfull bins of ``FAN`` nodes below it, packs them best-fit as if each were one piece, and
passes on what is still underfull, until one node is left.

No node's input grows with the corpus, and yet no merge is lost. A merge takes at least one bin that is half full or less, and best-fit leaves a
node one such bin at most. So the nodes above a node, ``FAN`` bins of that kind below each, can use no more than FAN of its fuller bins at each level, and where they can use one,
a bin with as much room or more will do. A node therefore passes on its emptiest bins, FAN for each level above it and one; all others are final.

Null text counts as empty and packs as its end id alone. Repeated rows are packed each for itself; rows with a null id too. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .spark_io import checkpointed, lean

CAPACITY, END = 4096, 1
#: A bin with this little room is final.
SLACK = 16
FAN = 8
#: Pieces that a first task packs.
SPREAD = 1 << 15
#: Words of a table, and their letters.
KEPT, LETTERS = 120_000, 4_000_000
CHUNK = 1 << 18
SIGNS = ".,;:!?-%$#&*|)]}"
_CONTROL = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Words:
    """Ids of texts by a word-level BPE tokenizer whose tokens never span white space.

    Words met before come from a table of two generations of ``KEPT`` each, so a long task needs no more memory. A word of letters, lower-cased as the tokenizer
    does, goes straight to its BPE model; anything else through the whole tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.bytes_of = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.letters_kept = 0

    def ids(self, texts: list[str]) -> list[bytes]:
        # str.split also cuts at these four, which are no white space to the tokenizer
        parted = [t.split() if not _CONTROL.search(t) else t.split(" ") for t in texts]
        if len(self.kept) > KEPT or self.letters_kept > LETTERS:
            self.before, self.kept, self.letters_kept = self.kept if self.letters_kept <= 2 * LETTERS else {}, {}, 0
        new = set().union(*parted).difference(self.kept)
        if new:
            self._meet(new)
            self.letters_kept += sum(map(len, new))
        get = self.kept.__getitem__
        return [b"".join(map(get, parts)) for parts in parted]

    def _word(self, low: str) -> bytes:
        got = self.kept.get(low) or self.before.get(low)
        if got is None:
            bytes_of = self.bytes_of
            written = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            got = b"".join([bytes_of[t.id] for t in self.model.tokenize(written)])
        return got

    def _meet(self, new: set[str]) -> None:
        """Letters followed by signs are tokens of their own, so a part is its letters' ids and then its signs'."""
        kept, before, odd = self.kept, self.before, []
        for part in new:
            got = before.get(part)
            if got is None:
                core = part.rstrip(SIGNS)
                low = core.lower()
                if low.isalpha() and (low.isascii() or ("Σ" not in core and unicodedata.is_normalized("NFC", core))):
                    got = self._word(low)
                    if core is not part and len(core) < len(part):
                        tail = part[len(core) :]
                        sign = kept.get(tail) or before.get(tail)
                        if sign is None:
                            sign = kept[tail] = self._whole([tail])[0]
                        got += sign
                    elif core != low:
                        kept[low] = got
                else:
                    odd.append(part)
                    continue
            kept[part] = got
        for k in range(0, len(odd), 4096):
            kept.update(zip(odd[k : k + 4096], self._whole(odd[k : k + 4096]), strict=True))

    def _whole(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]


_words: dict[str, Words] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, definition: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of ``docs(doc_id, text)``.

    definition: a tokenizer file's content, of fixed size, sent to each executor once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    name = hashlib.sha256(definition.encode()).hexdigest()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _words:
            _words.clear()
            _words[name] = Words(sent.value)
        for batch in batches:
            column, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            _, off = K.flat(column)
            for a, b in K.blocks(off, CHUNK):
                rows = []
                for i, raw in zip(ids[a:b], _words[name].ids([t or "" for t in column.slice(a, b - a).to_pylist()]), strict=True):
                    raw += last
                    for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        rows.append((i, p, at // 4, len(own) // 4, zlib.crc32(own)))
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lean(run), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first, each into the bin with the least room that holds it: (bin, offset) of each, fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, fill = 0, []  # bit r of some: a bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        above = some >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            bins = room[r]
            k = bins.pop()
            if not bins:
                some ^= 1 << r
        else:
            k, r = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = k, fill[k]
        fill[k] += n
        r -= n
        if r:
            room[r].append(k)
            some |= 1 << r
    return where, offset, np.array(fill, np.int64)


def _packed(item: np.ndarray, length: np.ndarray, node: int, level: int, capacity: int, passed: int) -> list[np.ndarray]:
    """Columns item, bin, offset, fill, open."""
    where, offset, fill = best_fit(length, capacity)
    rank = np.empty(len(fill), np.int64)
    rank[np.argsort(fill, kind="stable")] = np.arange(len(fill))
    goes = (fill < capacity - SLACK) & (rank < passed)
    return [item, (level << 58) + (node << 32) + where, offset, fill[where], goes[where]]


PLACES = "item long, bin long, offset long, fill long, open boolean"
_NAMES = ["item", "bin", "offset", "fill", "open"]


def _node(level: int, capacity: int, passed: int):
    def merged(bins: pa.Table) -> pa.Table:
        return pa.table([pa.array(c) for c in _packed(bins["bin"].to_numpy(), bins["fill"].to_numpy(), bins["node"][0].as_py(), level, capacity, passed)], _NAMES)

    return merged


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, sequence_id, offset) for ``items(item long, length long)``, whose rows must not change when computed again."""
    whole = items.where(F.col("length") >= capacity).select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("open"))
    rest = items.where(F.col("length") < capacity).select("item", "length")
    nodes, levels = max(1, -(-rest.count() // SPREAD)), 1
    while FAN**levels < nodes:
        levels += 1

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("item").to_numpy(), b.column("length").to_numpy()) for b in batches]
        if got:
            item, length = (np.concatenate(x) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _packed(item, length, TaskContext.get().partitionId(), 0, capacity, FAN * levels + 1)], _NAMES)

    bottom = placed = checkpointed(rest.repartition(nodes, "item").mapInArrow(lean(first), PLACES))
    moved = None  # where the bins that went up came to lie
    for level in range(1, levels + 1):
        under = placed.where("open").select("bin", "fill", F.expr(f"((bin >> 32) & 67108863) div {FAN}").alias("node")).distinct()
        placed = checkpointed(under.groupBy("node").applyInArrow(_node(level, capacity, FAN * (levels - level) + 1), PLACES))
        up = placed.select(F.col("item").alias("into"), F.col("bin").alias("above"), F.col("offset").alias("more"))
        if moved is None:
            moved = up.select(F.col("into").alias("bin"), F.col("above").alias("into"), F.col("more").alias("shift"))
        else:
            moved = moved.join(up, "into", "left").select("bin", F.coalesce("above", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
    final = bottom.select("item", "bin", "offset").join(moved, "bin", "left")
    final = final.select("item", F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    # a whole piece's sequence is named by the piece, below zero so that no bin has that name
    return whole.select("item", (-1 - F.col("item")).alias("sequence_id"), "offset").union(final.select("item", F.col("bin").alias("sequence_id"), "offset"))


def packed_documents(docs: DataFrame, definition: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    cut = checkpointed(pieces(docs, definition, capacity)).withColumn("item", F.monotonically_increasing_id())
    # numbered from the files, so a lost task numbers its rows alike again
    places = pack(cut.select("item", "length"), capacity)
    return cut.join(places, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
