"""N-gram Jaccard join: near-duplicate groups by a prefix-tree join of word shingle sets.

A document's set holds the hashes of its distinct five-word shingles, in one global order that puts shingles
common in the corpus last. Two sets of similarity t or more share an element among their first
``n - ceil(t n) + 1`` ones, so documents without a shared prefix element of compatible size can't be linked.

1. One scan adds up a sketch of shingle counts (a counter for every 200 bytes of text, 16 million at most; it only fixes the
   order, never the result) and takes each document's set size and signature; equal sets form a class, represented by its smallest id.
2. One scan emits prefix elements. Documents of compatible sizes that share one form a run. In a short run they meet
   pair by pair; a pair goes on only if it shares as many prefix elements as a link needs. In a long run each is tied
   to a leader instead, but for those that no other of the run can need the element for: the place of an element in a set bounds
   the size that a partner may have. Each task first combines its own long runs, so an element held by a third of all
   documents sends a few rows a task, not one a document, and no pairs.
3. Components of these ties are groups outside which no link can exist. A group of up to ``block`` documents and ``ELEMENTS``
   elements is a block, a task of its own. Larger ones are cut by size bands and hashed chunks; each chunk meets
   itself and ``PIVOTS`` members of its own and the neighbouring bands. Of what that leaves unlinked to the group's largest component,
   each chunk then meets every chunk of compatible sizes: two members of one component need not meet, so a large group
   of copies of one text costs as many blocks as it has chunks, not as pairs of chunks. Size bands that can't link are never paired.
4. In each block the sets form a trie, which all members walk together (``llm.trie``): this decides each pair exactly
   on the hashed sets. Links become components.

Set elements are 56-bit hashes. Null or blank texts have empty sets and link with nothing.
Rows with a null id are returned with their set's size and a null component. Rows that repeat an id are all returned; they
count as one document with several texts. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .spark_io import checkpointed, components, in_lanes, join_unique, lean, partitions_for, release
from .textkit import expanded
from .trie import SetTrie

#: Words of a shingle, and the similarity that links: PART / WHOLE.
WIDTH, PART, WHOLE = 5, 80, 100
#: Bytes of text for each counter of the sketch, bounds of the counters' number (as powers of two), and rows in which they travel.
BYTES_EACH, SKETCH_LEAST, SKETCH_MOST, SKETCH_PARTS = 200, 16, 24, 256
#: Bits of the filter that spares unlinked documents a shuffle.
FILTER_BITS = 1 << 23
#: Documents of a block, and elements of all of them.
BLOCK, ELEMENTS = 512, 1 << 19
#: Members of a large group's size band that each of its chunks meets first.
PIVOTS = 16
#: Documents of compatible sizes that share a prefix element meet pair by pair up to this number, beyond it in a group.
SHORT_RUN = 8
#: Rows of one element that a task sends where they can't be combined without ties.
ROWS = 256
#: Kinds of rows that the reducers give.
EDGE, TOKENS, PAIR = 0, 1, 2
#: Sets that walk a trie together, and they times the vocabulary.
WALKING, CELLS = 64, 1 << 22


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (hashes, first of each document and end, row numbers)."""
    data, off = K.flat(batch.column("text"))
    for a, b in K.blocks(off):
        o = off[a : b + 1] - off[a]
        w, doc, _, _ = K.folded_word_hashes(data[off[a] : off[b]], o)
        h, d = K.shingle_hashes(w, doc, b - a, width)
        yield h, np.searchsorted(d, np.arange(b - a + 1)), np.arange(a, b)


def _cell(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _scan(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            n, sig_a, sig_b = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for h, bound, rows in _sets(batch, width):
                cells, times = np.unique(_cell(h, bits), return_counts=True)
                counts[cells] += times.astype(np.int32)
                for i, r in enumerate(rows):
                    s = h[bound[i] : bound[i + 1]]
                    if len(s):
                        s = np.unique(s)
                        n[r] = len(s)
                        sig_a[r] = K.mix(s).sum().view(np.int64)
                        sig_b[r] = K.mix(s ^ np.uint64(0x5BD1E9955BD1E995)).sum().view(np.int64)
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(sig_a), pa.array(sig_b), *none], ["doc_id", "n", "sig_a", "sig_b", "part", "counts"])
        rows = [_narrow(x) for x in np.split(counts, SKETCH_PARTS)] if counts.any() else []
        longs = [pa.nulls(len(rows), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*longs, pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "n", "sig_a", "sig_b", "part", "counts"])

    return run


def _narrow(counts: np.ndarray) -> bytes:
    """Counters in as few bytes each as the largest needs, which the first byte tells, compressed."""
    kind = next(k for k in ("u1", "u2", "u4") if counts.max(initial=0) <= np.iinfo(k).max)
    return kind[1:].encode() + zstandard.compress(counts.astype("<" + kind).tobytes(), 3)


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob[1:]), "<u" + blob[:1].decode()).astype(np.int64)


def _added(sketch: pa.Table) -> pa.Table:
    total = np.minimum(sum(_wide(x.as_py()) for x in sketch["counts"]), (1 << 31) - 1)  # more would be the same level
    return pa.table({"part": sketch["part"][:1].cast(pa.int32()), "counts": pa.array([_narrow(total)], pa.binary())})


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How common the shingles of each counter are, in quarters of a power of two."""
    for batch in batches:
        levels = [np.minimum(255, np.round(4 * np.log2(np.maximum(_wide(x), 1)))).astype(np.uint8) for x in batch.column("counts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([zstandard.compress(x.tobytes(), 3) for x in levels], pa.binary())], ["part", "levels"])


def _ordered(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Elements that sort by how common the shingle is, then by hash."""
    return np.unique((levels[_cell(h, len(levels).bit_length() - 1)].astype(np.uint64) << np.uint64(56)) | (h & np.uint64((1 << 56) - 1)))


def _reach(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The size up to which a partner of a set of n elements may need the element at a place in it.

    Of a pair that links, the first common element stands where either set still has as many elements left as the two must share.
    """
    return (n - place) * (PART + WHOLE) // PART - n


def _runs(token: np.ndarray, lo: np.ndarray, hi: np.ndarray, ub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by token and size; in it first row and length of each run, rows of one token that sizes which could link hold together;
    and for each row whether a tie begins with it: rows whose reach doesn't meet the next one's size can't link with what follows."""
    order = np.lexsort((ub, lo, token))
    token, lo, hi, ub = token[order], lo[order], hi[order], ub[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    which = np.cumsum(new) << 40
    last = (1 << 40) - 1
    tie = new.copy()
    new[1:] |= (np.maximum.accumulate(which + hi)[:-1] & last) * WHOLE < lo[1:] * PART
    tie |= new
    tie[1:] |= (np.maximum.accumulate(which + ub)[:-1] & last) < lo[1:]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(token))), tie


def _counted(*columns: np.ndarray) -> np.ndarray:
    """Distinct rows of the columns, with how often each occurs."""
    rows = np.stack(columns, 1)
    rows = rows[np.lexsort(columns[::-1])]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)]) if len(rows) else np.zeros(0, np.int64)
    return np.column_stack([rows[first], np.diff(np.append(first, len(rows)))])


def _notes(doc: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """Rows kind, a, b, c for the members of long runs: an edge to the leader, and a token counted for the member."""
    edges, tokens = _counted(doc, leader), _counted(doc)
    edges = edges[edges[:, 0] != edges[:, 1]]
    edges = np.column_stack([np.full(len(edges), EDGE), edges])
    return np.concatenate([edges, np.column_stack([np.full(len(tokens), TOKENS), tokens[:, 0], tokens[:, 0], tokens[:, 1]])])


#: Prefix rows of one document each, packed by bucket: token, document's number and the element's place; the documents' ids and sizes. Then rows
#: that stand for several: token, least and largest size, reach, least id, number of rows. Then notes.
_OWN = {"token": "<u8", "number": "<i4", "place": "<i4", "ids": "<i8", "sizes": "<i4"}
_TIED = {"tokens": "<u8", "lo": "<i4", "hi": "<i4", "ub": "<i4", "doc": "<i8", "count": "<i4"}
_PREFIXES = "bucket int, " + ", ".join(f"{c} binary" for c in (*_OWN, *_TIED, "notes"))


def _prefix_row(bucket: int, **blobs: bytes) -> pa.RecordBatch:
    names = [*_OWN, *_TIED, "notes"]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([blobs.get(c)], pa.binary()) for c in names)], ["bucket", *names])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(bucket[at[0]]), at


def _prefixes(width: int, levels, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        tokens, ids, sizes, met = [], [], [], set()
        for batch in batches:
            of = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for h, bound, rows in _sets(batch, width):
                for i, r in enumerate(rows):
                    if bound[i] < bound[i + 1]:
                        s = _ordered(h[bound[i] : bound[i + 1]], level)
                        n = len(s)
                        whole = (n, int(s.sum()), int(K.mix(s).sum()))
                        if whole in met:  # of equal sets one goes on; classes join the others to it
                            continue
                        met.add(whole)
                        tokens.append(s[: n - -(-PART * n // WHOLE) + 1])
                        ids.append(of[r])
                        sizes.append(n)
        if not tokens:
            return
        many = np.array([len(t) for t in tokens])
        ids, sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
        number = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(number)) - np.repeat(np.cumsum(many) - many, many)
        token = np.concatenate(tokens)
        del tokens
        ub = _reach(sizes[number], place)
        order, first, length, tie = _runs(token, sizes[number], sizes[number], ub)
        token, number, place, ub = token[order], number[order], place[order], ub[order]
        lo, doc = sizes[number], ids[number]
        # ties of a long run become a row each; where even these are many, documents of one size are tied as well
        members = np.repeat(length > SHORT_RUN, length)
        run_of = np.repeat(np.arange(len(first)), length)
        crowded = np.bincount(run_of, tie)[run_of] > ROWS
        tie &= ~crowded | np.r_[True, (run_of[1:] != run_of[:-1]) | (lo[1:] != lo[:-1])]
        bucket = (K.mix(token) % np.uint64(n_buckets)).astype(np.int64)
        own = np.flatnonzero(~members)
        for k, at in _by_bucket(bucket[own]):
            at = own[at]
            docs, which = np.unique(number[at], return_inverse=True)
            columns = zip(_OWN.items(), (token[at], which, place[at], ids[docs], sizes[docs]), strict=True)
            yield _prefix_row(k, **{name: K.squeezed(c.astype(kind)) for (name, kind), c in columns})
        begin = np.flatnonzero(tie & members)
        if not len(begin):
            return
        # rows of long runs alone, so that each tie ends where the next one begins
        long_ = np.flatnonzero(members)
        at = np.searchsorted(long_, begin)
        n = np.diff(np.append(at, len(long_)))
        leader = np.minimum.reduceat(doc[long_], at)
        rows = (token[begin], lo[begin], np.maximum.reduceat(lo[long_], at), np.maximum.reduceat(ub[long_], at), leader, length[run_of[begin]])
        for k, at in _by_bucket(bucket[begin]):
            yield _prefix_row(k, **{name: K.squeezed(c[at].astype(kind)) for (name, kind), c in zip(_TIED.items(), rows, strict=True)})
        notes = _notes(doc[long_], np.repeat(leader, n))
        for k, at in _by_bucket((K.mix(notes[:, 1].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)):
            yield _prefix_row(k, notes=K.squeezed(notes[at].T.ravel()))

    return run


def _met(n_buckets: int):
    """Packed rows kind, a, b, c: pairs met in short runs and how often; edges and token counts of long runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _found(batches)
        bucket = (K.mix(K.mix(found[:, 1].astype(np.uint64)) + found[:, 2].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        for k, at in _by_bucket(bucket):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([K.squeezed(found[at].T.ravel())], pa.binary())], ["bucket", "met"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows kind, a, b, c of all tasks, c added up: a pair that shares many elements met in as many buckets."""
    rows = np.concatenate([np.zeros((0, 4), np.int64), *(expanded(x, "<i8").reshape(4, -1).T for batch in batches for x in batch.column("met").to_pylist())])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]) if len(rows) else np.zeros(0, np.int64)
    c = np.add.reduceat(rows[:, 3], first) if len(rows) else rows[:, 3]
    yield pa.RecordBatch.from_arrays([pa.array(rows[first, 0].astype(np.int32)), *(pa.array(x) for x in (rows[first, 1], rows[first, 2], c))], ["kind", "a", "b", "c"])


def _found(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    got, notes = [[np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 5]], [np.zeros((0, 4), np.int64)]
    for batch in batches:
        for row in batch.to_pylist():
            if row["notes"] is not None:
                notes.append(expanded(row["notes"], "<i8").reshape(4, -1).T)
            elif row["token"] is not None:
                token, number, place, ids, sizes = (expanded(row[c], kind) for c, kind in _OWN.items())
                n = sizes.astype(np.int64)[number]
                got.append([token, n, n, _reach(n, place.astype(np.int64)), ids[number], np.ones(len(n), np.int64)])
            else:
                token, *rest = (expanded(row[c], kind) for c, kind in _TIED.items())
                got.append([token, *(c.astype(np.int64) for c in rest)])
    token, lo, hi, ub, doc, count = (np.concatenate(c) for c in zip(*got, strict=True))
    del got
    if len(token):
        order, first, length, tie = _runs(token, lo, hi, ub)
        lo, doc, count = lo[order], doc[order], count[order]
        short = np.add.reduceat(count, first) <= SHORT_RUN
        members = np.repeat(~short, length)
        begin = np.flatnonzero(tie)
        leader = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, len(tie))))
        notes.append(_notes(doc[members], leader[members]))
        run = np.repeat(np.arange(len(first)), length)
        keep = np.repeat(short & (length > 1), length)
        run, lo, doc = run[keep], lo[keep], doc[keep]
        pairs = []
        for k in range(1, SHORT_RUN):
            both = (run[k:] == run[:-k]) & (lo[:-k] * WHOLE >= lo[k:] * PART)
            pairs.append(np.sort(np.stack([doc[:-k][both], doc[k:][both]], 1), axis=1))
        pairs = np.concatenate(pairs)
        pairs = _counted(*pairs[pairs[:, 0] != pairs[:, 1]].T)
        notes.append(np.column_stack([np.full(len(pairs), PAIR), pairs]))
    return np.concatenate(notes)


def _candidates(met: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between classes, outside whose components no link can exist.

    Two linked sets share at least ``need`` prefix elements. Those in short runs were counted for the pair;
    more can only be elements that both hold in long runs.
    """
    tokens = met.where(F.col("kind") == TOKENS).select("a", F.col("c").alias("long_tokens"))
    known = classes.groupBy("doc_id").agg(F.max("n").alias("n"), F.min("class").alias("class"), F.min("n").alias("least"))
    known = known.join(tokens, known["doc_id"] == tokens["a"], "left").select("doc_id", "n", "least", "class", F.coalesce("long_tokens", F.lit(0)).alias("t"))
    a, b = (known.select(F.col("doc_id").alias(x), *(F.col(c).alias(c + x) for c in ("n", "least", "class", "t"))) for x in "ab")
    pairs = met.where(F.col("kind") == PAIR).select("a", "b", "c").join(a, "a").join(b, "b")
    beyond = F.expr(f"greatest(ceil({PART} * na / {WHOLE}), ceil({PART} * nb / {WHOLE})) - 1")
    need = F.ceil(F.expr(f"{PART} * (na + nb) / ({PART} + {WHOLE})")) - beyond
    # an id with several texts of different sizes has no single need
    pairs = pairs.where((F.col("c") + F.least("ta", "tb") >= need) | F.expr("na <> leasta or nb <> leastb"))
    edges = met.where(F.col("kind") == EDGE).select("a", "b").join(a, "a").join(b, "b")
    return pairs.select("classa", "classb").union(edges.select("classa", "classb")).toDF("a", "b")


def _members(width: int, levels, members):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, bits = np.frombuffer(levels.value, np.uint8), np.frombuffer(members.value, np.uint8)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at = (K.mix(ids.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
            ids = batch.column("doc_id")
            sets = []
            for h, bound, rows in _sets(batch, width):
                sets += [_ordered(h[bound[i] : bound[i + 1]], level).tobytes() for i in range(len(rows))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], ["doc_id", "elements"])

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter's bytes that this task's ids set, in pieces of 32 KB."""
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        bits[(K.mix(ids.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
    pieces = np.split(np.packbits(bits, bitorder="little"), FILTER_BITS >> 18)
    kept = [k for k, x in enumerate(pieces) if x.any()]
    yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([zlib.compress(pieces[k].tobytes(), 1) for k in kept], pa.binary())], ["part", "bits"])


def _ored(parts: pa.Table) -> pa.Table:
    total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in parts["bits"]])
    return pa.table({"part": parts["part"][:1].cast(pa.int32()), "bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def block_links(sets: list[np.ndarray], side: np.ndarray, part: int = PART, whole: int = WHOLE) -> list[tuple[int, int]]:
    """Links that connect what a block's sets link, as index pairs: a spanning forest of them.

    side: 0 and 1 are to be compared with each other alone; 2 with all.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    vocabulary, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
    n_tokens = int((count > 1).sum())
    bound = np.cumsum([0, *sizes])
    tokens = [number[inverse[bound[i] : bound[i + 1]]] for i in range(len(sets))]
    tokens = [t[t >= 0] for t in tokens]
    stored = [i for i in range(len(sets)) if side[i] != 1]
    probing = [i for i in range(len(sets)) if side[i] != 0 and len(tokens[i])]
    trie = SetTrie([tokens[i] for i in stored], sizes[stored])
    up = list(range(len(sets)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    out = []
    step = max(1, min(WALKING, CELLS // max(1, n_tokens)))
    while probing:
        linked = {root(i) for i in stored}
        if len(linked) == 1:  # what all stored sets are linked with has nothing to find
            probing = [i for i in probing if root(i) not in linked]
        some, probing = probing[:step], probing[step:]
        for p, s in zip(*trie.join([tokens[i] for i in some], sizes[some], n_tokens, part, whole), strict=True):
            i, j = some[p], stored[s]
            a, b = root(i), root(j)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _linked(block: pa.Table) -> pa.Table:
    block = block.combine_chunks()
    ids = block["doc_id"].to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in block["elements"]]
    pairs = block_links(sets, block["side"].to_numpy()) if len(sets) > 1 else []
    if block.nbytes > 1 << 22:
        del sets
        release()
    return pa.table({"a": pa.array([ids[i] for i, _ in pairs], pa.int64()), "b": pa.array([ids[j] for _, j in pairs], pa.int64())})


def _key(root: str, *rest) -> F.Column:
    names = ("u", "i", "v", "j")
    return F.struct(F.col(root).alias("root"), *((F.lit(0) if c is None else F.col(c)).cast("int").alias(x) for x, c in zip(names, rest, strict=True)))


def _chunk(chunks: str):
    return F.pmod(F.xxhash64("doc_id"), F.col(chunks)).cast("int")


def _first_blocks(members: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, side): groups of one block, and chunks of larger ones with the pivots of their own and the next bands;
    and the large groups' members, (doc_id, root, band, chunks, chunk)."""
    band = F.floor(F.log(F.col("n")) / F.lit(float(np.log(WHOLE / PART))) + 1e-9).cast("int")
    size = members.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("elements"))
    sized = join_unique(members, size, ["root"], "size").withColumn("band", band)
    one = f"size <= {block} and elements <= {ELEMENTS}"
    alone = sized.where(one).select("doc_id", _key("root", None, None, None, None).alias("key"), F.lit(2).alias("side"))
    large = sized.where(f"not ({one})")
    # a band next to the rounding of the logarithm is paired with its neighbours all the same: bands two apart can't link
    bands = large.groupBy("root", "band").agg(F.count("*").alias("in_band"), F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("n") / F.lit(ELEMENTS))).cast("int").alias("chunks"))
    large = join_unique(large.select("doc_id", "n", "root", "band"), bands, ["root", "band"], "in_band").withColumn("chunk", _chunk("chunks"))
    large = checkpointed(large.select("doc_id", "n", "root", "band", "chunks", "chunk"))
    bands = large.groupBy("root", "band").agg(F.max("chunks").alias("chunks"))
    own = large.select("doc_id", _key("root", "band", "chunk", "band", "chunk").alias("key"), F.lit(2).alias("side"))
    pivots = large.groupBy("root", "band", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PIVOTS)).alias("of")).agg(F.min("doc_id").alias("doc_id"))
    pivots = pivots.select("doc_id", "root", F.col("band").alias("from"), F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band")).join(bands, ["root", "band"])
    pivots = pivots.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).where(~((F.col("from") == F.col("band")) & (F.col("chunk") == _chunk("chunks"))))
    pivots = pivots.select("doc_id", _key("root", "band", "chunk", "band", "chunk").alias("key"), F.lit(0).alias("side"))
    return alone.union(own).union(pivots), large


def _second_blocks(large: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """Blocks of what isn't linked to its group's largest component yet, in chunks, each with every chunk of all that it could link with."""
    part = large.withColumnRenamed("root", "group").join(found.select(F.col("node").alias("doc_id"), F.col("root").alias("linked")), "doc_id", "left")
    part = checkpointed(part.withColumn("linked", F.coalesce("linked", "doc_id")))
    sizes = part.groupBy("group", "linked").agg(F.count("*").alias("of"))
    most = sizes.groupBy("group").agg(F.max_by("linked", F.struct("of", "linked")).alias("most"), F.sum("of").alias("size"))
    part = join_unique(part, most, ["group"], "size")
    open_ = part.where("linked <> most").select("doc_id", "n", "group", "band")
    rest = open_.groupBy("group", "band").agg(F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("n") / F.lit(ELEMENTS))).cast("int").alias("rests"))
    chunks = large.select(F.col("root").alias("group"), "band", "chunks").distinct()
    near = F.explode(F.expr("array(band - 1, band, band + 1)"))
    open_ = open_.join(rest, ["group", "band"]).withColumn("rest", _chunk("rests"))
    asking = open_.select("doc_id", "group", F.col("band").alias("own"), "rest", near.alias("band")).join(chunks, ["group", "band"])
    asking = asking.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).select("doc_id", _key("group", "own", "rest", "band", "chunk").alias("key"), F.lit(1).alias("side"))
    asked = large.select("doc_id", F.col("root").alias("group"), F.col("band").alias("from"), "chunk", near.alias("band")).join(rest, ["group", "band"])
    asked = asked.withColumn("rest", F.explode(F.expr("sequence(0, rests - 1)"))).select("doc_id", _key("group", "band", "rest", "from", "chunk").alias("key"), F.lit(0).alias("side"))
    return asking.union(asked)


def ngram_components(docs: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)``: (doc_id, n_shingles, component_id) for every row.

    component_id is the smallest id that links reach, the row's own included.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((size // BYTES_EACH).bit_length(), SKETCH_LEAST), SKETCH_MOST)
    scan = checkpointed(docs.mapInArrow(lean(_scan(width, bits)), "doc_id long, n long, sig_a long, sig_b long, part int, counts binary"))
    rows = scan.where("part is null").select("doc_id", "n", "sig_a", "sig_b")
    sketch = in_lanes(scan.where("part is not null").select("part", "counts"), "part", _added, "part int, counts binary")
    parts = {r["part"]: zstandard.decompress(bytes(r["levels"])) for r in sketch.mapInArrow(lean(_levels), "part int, levels binary").collect()}  # 2**bits bytes in all
    levels = spark.sparkContext.broadcast(b"".join(parts.get(k, bytes((1 << bits) // SKETCH_PARTS)) for k in range(SKETCH_PARTS)))

    known = rows.where("doc_id is not null and n > 0")
    least = known.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("class"), F.count("*").alias("copies"))
    classes = checkpointed(join_unique(known, least, ["sig_a", "sig_b"], "copies").select("doc_id", "n", "class"))

    n_buckets = partitions_for(spark, size)
    named = docs.where("doc_id is not null")
    prefixes = named.mapInArrow(lean(_prefixes(width, levels, n_buckets)), _PREFIXES)
    met = prefixes.repartitionById(n_buckets, "bucket").mapInArrow(lean(_met(n_buckets)), "bucket int, met binary")
    met = checkpointed(met.repartitionById(n_buckets, "bucket").mapInArrow(lean(_summed), "kind int, a long, b long, c long"))
    groups = checkpointed(components(_candidates(met, classes)))

    heads = classes.where("doc_id = class").select("doc_id", "n").groupBy("doc_id").agg(F.max("n").alias("n"))
    members = checkpointed(heads.join(groups, heads["doc_id"] == groups["node"]).select("doc_id", "n", "root"))
    bits = in_lanes(members.select("doc_id").mapInArrow(lean(_bits), "part int, bits binary"), "part", _ored, "part int, bits binary")
    parts = {r["part"]: zlib.decompress(bytes(r["bits"])) for r in bits.collect()}  # FILTER_BITS / 8 bytes in all
    chosen = spark.sparkContext.broadcast(b"".join(parts.get(k, bytes(1 << 15)) for k in range(FILTER_BITS >> 18)))
    sets = named.mapInArrow(lean(_members(width, levels, chosen)), "doc_id long, elements binary")

    def links(blocks: DataFrame) -> DataFrame:
        return checkpointed(blocks.join(sets, "doc_id").groupBy("key").applyInArrow(_linked, "a long, b long"))

    # rows that repeat an id make one document of the classes of their texts
    repeats = classes.where("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    repeats = repeats.join(classes.groupBy("doc_id").agg(F.countDistinct("class").alias("k")).where("k > 1").select(F.col("doc_id").alias("a")), "a", "left_semi")
    blocks, large = _first_blocks(members, block)
    found = components(links(blocks).union(repeats))
    if not large.isEmpty():
        more = links(_second_blocks(large, found, block))
        if not more.isEmpty():
            found = components(more.union(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))

    copies = classes.groupBy(F.col("class").alias("node")).agg(F.count("*").alias("copies")).join(found, "node")
    label = join_unique(classes.select("doc_id", "n", F.col("class").alias("node")), copies, ["node"], "copies", "left")
    label = label.groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("component"))
    return rows.join(label, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
