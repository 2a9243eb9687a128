"""Approximate nearest neighbours by inner product: an NN-descent graph, searched greedily.

Equal vectors form a class that stands in the graph once. Classes are dealt to shards by the hash of their id. The graph is built by
NN-descent in rounds of Spark shuffles between the shards: every class hands its sampled neighbours, and those that have it as a
neighbour, to each other with their vectors (of one byte a component); each learns of neighbours of neighbours
and keeps the ``NEIGHBOURS`` best. Senders sample what goes to one class, so a hub that all others point to stays small.

A query starts at its own class and at ``ENTRIES`` classes sampled from all shards, as its part of the graph may lack links to its true neighbours, and keeps a pool of the ``POOL`` best classes seen; each round expands the best ``EXPANDED``
of them not yet expanded, by a join of these with the graph that gives back neighbours above the pool's floor. It ends
when all of the pool is expanded, which it is in the end: the floor only rises, so what a pool has dropped can't come back. The best of the pool are scored again on the original vectors in
double precision.

Vectors that are null, hold a null or a component that isn't finite, are zero, or differ in length from most vectors take no part: they
are neither candidates nor queries. Ties go to the smaller id. Rows that repeat an id count once for each different vector; extra columns are ignored.

An empty table, or one without a vector that takes part, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .spark_io import checkpointed, join_unique, lean

NEIGHBOURS, SAMPLED, ROUNDS = 20, 20, 7
POOL, EXPANDED, ENTRIES = 800, 200, 8
#: Classes of a shard. Shards follow the input, not the session's partitions, so that few rows carry what they send each other.
SHARD = 2048
#: Candidates that a task gathers before it keeps the best of them.
HELD = 1 << 20
SEED, STATE, CANDIDATE, REVERSE, FORWARD, TIED, GRAPH, QUERY, EXPAND, REPLY, ENTER = range(11)

_CELLS = [f"c{k}" for k in range(6)]
SCHEMA = "shard int, kind int, " + ", ".join(f"{c} binary" for c in _CELLS)


def _row(kind: int, shard: int, *blobs: bytes) -> pa.RecordBatch:
    cells = [pa.array([b], pa.binary()) for b in blobs] + [pa.nulls(1, pa.binary())] * (len(_CELLS) - len(blobs))
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), *cells], ["shard", "kind", *_CELLS])


def _send(kind: int, shard: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(shard, kind="stable")
    bound = np.searchsorted(shard[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(bound)):
        at = order[bound[k] : bound[k + 1]]
        yield _row(kind, int(k), *(np.ascontiguousarray(c[at]).tobytes() for c in columns))


def _shard(ids: np.ndarray, n: int) -> np.ndarray:
    return (K.mix(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte a component, and each vector's scale."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127 if len(x) else np.zeros(0)
    return np.round(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


class _Inbox:
    """Packed rows of a shard's task, by kind."""

    def __init__(self, batches: Iterator[pa.RecordBatch], width: int):
        self.rows: dict[int, list[dict]] = {}
        self.width = width
        for batch in batches:
            for row in batch.to_pylist():
                self.rows.setdefault(row["kind"], []).append(row)

    def get(self, kind: int, *types: str) -> list[np.ndarray]:
        """Columns of all rows of a kind; "v" is a vector, "k" a row of NEIGHBOURS ids, "s" of scores, "b" of flags."""
        shapes = {"v": (np.int8, self.width), "k": (np.int64, NEIGHBOURS), "s": (np.float32, NEIGHBOURS), "b": (np.bool_, NEIGHBOURS)}
        out = []
        for j, t in enumerate(types):
            kind_, wide = shapes.get(t, (t, 0))
            parts = [np.frombuffer(r[f"c{j}"], kind_) for r in self.rows.get(kind, [])]
            x = np.concatenate(parts) if parts else np.zeros(0, kind_)
            out.append(x.reshape(-1, wide) if wide else x)
        return out


def _sampled(group: np.ndarray, first: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Places of at most ``most`` random rows a group among those that ``first`` marks, and as many of the others."""
    order = np.lexsort((rng.random(len(group)), first, group))
    g, f = group[order], first[order]
    at = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (f[1:] != f[:-1])]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(at, np.diff(np.append(at, len(g))))
    return order[rank < most]


def _seeded(n: int, seed: int):
    """Each class goes to random shards, to be a first neighbour of a random class there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            x = np.array(batch.column("embedding").to_pylist(), float)
            q, scale = quantised(x)
            m = len(ids)
            free = [np.full((m, NEIGHBOURS), -1, np.int64), np.full((m, NEIGHBOURS), -np.inf, np.float32), np.zeros((m, NEIGHBOURS), bool)]
            yield from _send(STATE, _shard(ids, n), n, ids, q, scale, *free)
            rng = np.random.default_rng([seed, int(ids[0]) & 0x7FFFFFFF])
            each = np.repeat(np.arange(m), NEIGHBOURS)
            yield from _send(SEED, rng.integers(0, n, len(each)), n, ids[each], q[each], scale[each])

    return run


def _merged(box: _Inbox, rng: np.random.Generator) -> list[np.ndarray]:
    """The shard's state with all candidates merged in: ids (rising), vectors, scales, neighbours, scores, flags of new ones."""
    ids, q, scale, near, score, new = box.get(STATE, "i8", "v", "f4", "k", "s", "b")
    by = np.argsort(ids, kind="stable")
    ids, q, scale, near, score, new = (c[by] for c in (ids, q, scale, near, score, new))
    who, what, how = box.get(CANDIDATE, "i8", "i8", "f4")
    sid, sq, sscale = box.get(SEED, "i8", "v", "f4")
    if len(sid) and len(ids):
        at = rng.integers(0, len(ids), len(sid))
        dot = (q[at].astype(np.float32) * sq).sum(1) * scale[at] * sscale
        who, what, how = np.concatenate([who, ids[at]]), np.concatenate([what, sid]), np.concatenate([how, dot.astype(np.float32)])
    place = np.searchsorted(ids, who)
    some = what != who
    place, what, how = place[some], what[some], how[some]
    m = len(ids)
    u = np.concatenate([np.repeat(np.arange(m), NEIGHBOURS), place])
    v, s = np.concatenate([near.ravel(), what]), np.concatenate([score.ravel(), how])
    fresh = np.concatenate([new.ravel(), np.ones(len(what), bool)])
    real = v >= 0
    u, v, s, fresh = u[real], v[real], s[real], fresh[real]
    order = np.lexsort((fresh, v, u))  # what is known already stays known
    u, v, s, fresh = u[order], v[order], s[order], fresh[order]
    first = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
    u, v, s, fresh = u[first], v[first], s[first], fresh[first]
    order = np.lexsort((v, -s, u))
    u, v, s, fresh = u[order], v[order], s[order], fresh[order]
    rank = np.arange(len(u)) - np.searchsorted(u, np.arange(m))[u]
    top = rank < NEIGHBOURS
    near, score, new = np.full((m, NEIGHBOURS), -1, np.int64), np.full((m, NEIGHBOURS), -np.inf, np.float32), np.zeros((m, NEIGHBOURS), bool)
    near[u[top], rank[top]], score[u[top], rank[top]], new[u[top], rank[top]] = v[top], s[top], fresh[top]
    return [ids, q, scale, near, score, new]


def _rng(batch_seed: int) -> np.random.Generator:
    from pyspark import TaskContext

    return np.random.default_rng([batch_seed, TaskContext.get().partitionId()])


def _reversed(n: int, width: int, seed: int, last: bool = False):
    """Merge candidates, then tell each neighbour who has it; the last time, to all and not only what is new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = _rng(seed)
        ids, q, scale, near, score, new = _merged(_Inbox(batches, width), rng)
        u, k = np.nonzero(near >= 0)
        v, fresh = near[u, k], new[u, k]
        kept = _sampled(v, ~fresh, 2 * NEIGHBOURS if last else SAMPLED, rng)
        kept.sort()
        floor = score[:, -1]
        yield from _send(REVERSE, _shard(v[kept], n), n, v[kept], ids[u[kept]], fresh[kept], q[u[kept]], scale[u[kept]], floor[u[kept]])
        yield from _send(STATE, _shard(ids, n), n, ids, q, scale, near, score, new)

    return run


def _answered(n: int, width: int, seed: int):
    """Each class answers those that have it with its vector, and keeps its own sample of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = _rng(seed)
        box = _Inbox(batches, width)
        ids, q, scale, near, score, new = _merged(box, rng)
        v, u, fresh, uq, uscale, ufloor = box.get(REVERSE, "i8", "i8", "?", "v", "f4", "f4")
        kept = _sampled(v, ~fresh, SAMPLED, rng)
        yield from _send(TIED, _shard(v[kept], n), n, v[kept], u[kept], fresh[kept], uq[kept], uscale[kept], ufloor[kept])
        at = np.searchsorted(ids, v)
        yield from _send(FORWARD, _shard(u, n), n, u, v, fresh, q[at], scale[at], score[at, -1])
        yield from _send(STATE, _shard(ids, n), n, ids, q, scale, near, score, new)

    return run


def _around(box: _Inbox) -> tuple[np.ndarray, ...]:
    """What each class knows around it: (class, neighbour, new, vector, scale, floor), one row for each pair, sorted by class."""
    sides = [box.get(kind, "i8", "i8", "?", "v", "f4", "f4") for kind in (FORWARD, TIED)]
    u, v, fresh, q, scale, floor = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.lexsort((~fresh, v, u))
    u, v = u[order], v[order]
    first = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
    order = order[first]
    return u[first], v[first], fresh[order], q[order], scale[order], floor[order]


def _best(who: np.ndarray, what: np.ndarray, how: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each class's candidates, each once, the NEIGHBOURS best: a further one can't become a neighbour."""
    order = np.lexsort((what, who))
    who, what, how = who[order], what[order], how[order]
    first = np.r_[True, (who[1:] != who[:-1]) | (what[1:] != what[:-1])] & (who != what) if len(who) else np.zeros(0, bool)
    who, what, how = who[first], what[first], how[first]
    order = np.lexsort((-how, who))
    who, what, how = who[order], what[order], how[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    return who[rank < NEIGHBOURS], what[rank < NEIGHBOURS], how[rank < NEIGHBOURS]


def _joined(n: int, width: int, seed: int):
    """Local joins: the neighbours of one class are proposed to each other where they beat the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Inbox(batches, width)
        ids, q, scale, near, score, new = _merged(box, _rng(seed))
        u, v, fresh, vq, vscale, floor = _around(box)
        bound = np.searchsorted(u, np.append(ids, np.iinfo(np.int64).max))
        who, what, how, held, most = [], [], [], 0, HELD
        for k in np.flatnonzero(np.diff(bound) > 1):
            a, b = bound[k], bound[k + 1]
            mine = np.flatnonzero(fresh[a:b]) + a
            if not len(mine):
                continue
            x = vq[a:b].astype(np.float32) * vscale[a:b, None]
            dot = x[mine - a] @ x.T
            i, j = np.nonzero(dot > floor[a:b][None, :])
            who.append(v[a + j]), what.append(v[mine[i]]), how.append(dot[i, j])
            i, j = np.nonzero(dot > floor[mine][:, None])
            who.append(v[mine[i]]), what.append(v[a + j]), how.append(dot[i, j])
            held += len(who[-1]) + len(who[-2])
            if held > most:
                who, what, how = ([c] for c in _best(*(np.concatenate(c) for c in (who, what, how))))
                held = len(who[0])
                most = held + HELD
        if who:
            who, what, how = _best(*(np.concatenate(c) for c in (who, what, how)))
            yield from _send(CANDIDATE, _shard(who, n), n, who, what, how.astype(np.float32))
        yield from _send(STATE, _shard(ids, n), n, ids, q, scale, near, score, np.zeros_like(new))

    return run


def _graph(n: int, width: int, seed: int):
    """The finished graph: each class with its neighbours on both sides and their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, _, q, scale, _ = _around(_Inbox(batches, width))
        yield from _send(GRAPH, _shard(u, n), n, u, v, q, scale)

    return run


def build(classes: DataFrame, width: int, n: int, rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """The neighbour graph of ``classes(id, embedding)``: packed rows of (class, neighbour, its vector, its scale), partitioned by shard, of which there are n."""

    def step(df: DataFrame, run) -> DataFrame:
        return df.repartitionById(n, "shard").mapInArrow(lean(run), SCHEMA)

    now = classes.mapInArrow(lean(_seeded(n, seed)), SCHEMA)
    for k in range(rounds):
        now = step(now, _reversed(n, width, seed + 10 * k))
        now = step(now, _answered(n, width, seed + 10 * k + 1))
        now = checkpointed(step(now, _joined(n, width, seed + 10 * k + 2)))
    now = step(now, _reversed(n, width, seed - 1, last=True))
    now = step(now, _answered(n, width, seed - 2))
    return checkpointed(step(now, _graph(n, width, seed - 3)).repartition(n, "shard"))


def _started(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            q, scale = quantised(np.array(batch.column("embedding").to_pylist(), float))
            yield from _send(EXPAND, _shard(ids, n), n, ids, ids, q, scale, np.full(len(ids), -np.inf, np.float32))
            # a shard knows its classes, so a query names a shard and a number that it takes one of them by
            rng = np.random.default_rng([len(ids), int(ids[0]) & 0x7FFFFFFF])
            each = np.repeat(np.arange(len(ids)), ENTRIES)
            yield from _send(ENTER, rng.integers(0, n, len(each)), n, rng.integers(0, 1 << 62, len(each)), ids[each], q[each], scale[each])
            yield from _send(QUERY, _shard(ids, n), n, ids, q, scale, np.ones(len(ids), np.int32), *_pool(ids))

    return run


def _pool(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools that hold the query's own class alone, expanded. Flagged scores: places, and scores with what is expanded."""
    kind = np.dtype([("id", "<i8"), ("score", "<f4"), ("done", "?")])
    pool = np.zeros(len(ids), kind)
    pool["id"], pool["score"], pool["done"] = ids, np.inf, True
    return pool.view(np.uint8).reshape(len(ids), kind.itemsize), np.zeros(len(ids), np.uint8)


_POOLED = np.dtype([("id", "<i8"), ("score", "<f4"), ("done", "?")])


def _expanded(n: int, width: int):
    def run(graph: pa.Table, asked: pa.Table) -> pa.Table:
        """Neighbours, above the floor, of the classes that queries expand in this shard."""
        g, e = _Inbox(graph.to_batches(), width), _Inbox(asked.to_batches(), width)
        u, v, q, scale = g.get(GRAPH, "i8", "i8", "v", "f4")
        node, query, qq, qscale, floor = e.get(EXPAND, "i8", "i8", "v", "f4", "f4")
        draw, *entering = e.get(ENTER, "i8", "i8", "v", "f4")
        if len(u) and len(draw):
            here = np.unique(u)
            more = (here[draw % len(here)], *entering, np.full(len(draw), -np.inf, np.float32))
            node, query, qq, qscale, floor = (np.concatenate(x) for x in zip((node, query, qq, qscale, floor), more, strict=True))
        out = []
        if len(u) and len(node):
            order = np.argsort(u, kind="stable")
            u, v, q, scale = u[order], v[order], q[order], scale[order]
            by = np.argsort(query, kind="stable")
            node, query, qq, qscale, floor = node[by], query[by], qq[by], qscale[by], floor[by]
            lo, hi = np.searchsorted(u, node), np.searchsorted(u, node, "right")
            first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
            bound = np.append(first, len(query))
            whose, what, how = [], [], []
            for a, b in zip(bound[:-1], bound[1:], strict=True):
                at = np.concatenate([np.arange(x, y) for x, y in zip(lo[a:b], hi[a:b], strict=True)])
                if not len(at):
                    continue
                at = at[np.unique(v[at], return_index=True)[1]]
                dot = (q[at].astype(np.float32) @ qq[a].astype(np.float32)) * scale[at] * qscale[a]
                good = dot > floor[a]
                whose.append(np.full(good.sum(), query[a])), what.append(v[at[good]]), how.append(dot[good])
            if whose:
                whose, what, how = (np.concatenate(c) for c in (whose, what, how))
                out = list(_send(REPLY, _shard(whose, n), n, whose, what, how.astype(np.float32)))
        return pa.Table.from_batches(out, _row(0, 0).schema)

    return run


def _updated(n: int, width: int):
    """Queries take in what was found and choose what to expand next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Inbox(batches, width)
        query, q, scale, size = box.get(QUERY, "i8", "v", "f4", "i4")
        if not len(query):
            return
        pool = np.concatenate([np.frombuffer(r["c4"], _POOLED) for r in box.rows[QUERY]])
        owner = np.repeat(np.arange(len(query)), size)
        rank_of = np.argsort(query, kind="stable")
        whose, what, how = box.get(REPLY, "i8", "i8", "f4")
        new = np.zeros(len(what), _POOLED)
        new["id"], new["score"] = what, how
        owner = np.concatenate([owner, rank_of[np.searchsorted(query[rank_of], whose)]])
        pool = np.concatenate([pool, new])
        order = np.lexsort((~pool["done"], pool["id"], owner))
        owner, pool = owner[order], pool[order]
        first = np.r_[True, (owner[1:] != owner[:-1]) | (pool["id"][1:] != pool["id"][:-1])]
        owner, pool = owner[first], pool[first]
        order = np.lexsort((pool["id"], -pool["score"], owner))
        owner, pool = owner[order], pool[order]
        start = np.searchsorted(owner, np.arange(len(query)))
        keep = np.arange(len(owner)) - start[owner] < POOL + 1
        owner, pool = owner[keep], pool[keep].copy()
        start = np.searchsorted(owner, np.arange(len(query) + 1))
        size = np.diff(start).astype(np.int32)
        floor = np.where(size > POOL, pool["score"][start[1:] - 1], -np.inf).astype(np.float32)
        waiting = np.flatnonzero(~pool["done"])
        o = owner[waiting]
        go = waiting[np.arange(len(o)) - np.searchsorted(o, o) < EXPANDED]
        pool["done"][go] = True
        shard = _shard(query, n)
        for k in np.unique(shard):
            at = np.flatnonzero(shard == k)
            rows = np.concatenate([pool[start[i] : start[i + 1]] for i in at])
            yield _row(QUERY, int(k), query[at].tobytes(), q[at].tobytes(), scale[at].tobytes(), size[at].tobytes(), rows.tobytes())
        o = owner[go]
        yield from _send(EXPAND, _shard(pool["id"][go], n), n, pool["id"][go], query[o], q[o], scale[o], floor[o])

    return run


def _found(most: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Inbox(batches, width)
        for row in box.rows.get(QUERY, []):
            query, size = np.frombuffer(row["c0"], np.int64), np.frombuffer(row["c3"], np.int32)
            pool = np.frombuffer(row["c4"], _POOLED)
            start = np.append(0, np.cumsum(size))
            own = [pool["id"][start[i] : start[i + 1]][:most] for i in range(len(query))]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query, [len(x) for x in own])), pa.array(np.concatenate(own))], ["query_class", "class"])

    return run


def search(graph: DataFrame, queries: DataFrame, width: int, most: int, n: int) -> DataFrame:
    """(query_class, class): the best ``most`` classes found for each of ``queries(id, embedding)``, classes of the graph; its own included."""
    now = checkpointed(queries.mapInArrow(lean(_started(n)), SCHEMA))
    while True:
        asked = now.where(F.col("kind").isin(EXPAND, ENTER))
        if asked.isEmpty():
            break
        found = graph.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_expanded_typed(n, width), SCHEMA)
        now = checkpointed(now.where(F.col("kind") == QUERY).unionAll(found).repartitionById(n, "shard").mapInArrow(lean(_updated(n, width)), SCHEMA))
    return now.where(F.col("kind") == QUERY).mapInArrow(lean(_found(most, width)), "query_class long, class long")


def _expanded_typed(n: int, width: int):
    run = _expanded(n, width)

    def expanded(graph: pa.Table, asked: pa.Table) -> pa.Table:
        return run(graph, asked)

    return expanded


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``vectors(vec_id, embedding)`` whose id ``every`` divides.

    The row itself is left out.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    )
    lengths = usable.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return usable.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "0D as score").limit(0)
    width = lengths["width"]
    usable = usable.where(F.size("embedding") == width).distinct()
    # of equal vectors a query can want no more than the k + 1 smallest ids: its own may be one of them
    least = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    per_task = usable.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("salt")).agg(least.alias("ids"), F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = per_task.groupBy("embedding").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.min("id").alias("id"), F.sum("copies").alias("copies"))
    classes = checkpointed(classes.select("id", "embedding", "ids", "copies"))
    n = -(-classes.count() // SHARD)
    graph = build(classes.select("id", "embedding"), width, n)
    asking = usable.where(F.col("vec_id") % every == 0)
    of = checkpointed(join_unique(asking, classes.select("embedding", "id", "copies"), ["embedding"], "copies").select(F.col("vec_id").alias("query_id"), "id"))
    queries = classes.select("id", "embedding").join(of.select("id").distinct(), "id", "left_semi")
    found = checkpointed(search(graph, queries, width, 3 * k + 1, n))
    own = classes.select(F.col("id").alias("query_class"), F.col("embedding").alias("x"))
    theirs = classes.select(F.col("id").alias("class"), F.col("embedding").alias("y"), "ids")
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    scored = found.join(own, "query_class").join(theirs, "class").select("query_class", dot.alias("score"), "ids")
    # a class gives k candidates at most, so k classes are enough
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("ids")[0].alias("first"), "ids"))), 1, k + 1)
    lists = scored.groupBy("query_class").agg(best.alias("best"))
    rows = of.join(lists, of["id"] == lists["query_class"]).select("query_id", F.explode("best").alias("b"))
    rows = rows.select("query_id", (-F.col("b.far")).alias("score"), F.explode("b.ids").alias("vec_id")).where("vec_id <> query_id")
    top = rows.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "t.vec_id", (-F.col("t.far")).alias("score"))
