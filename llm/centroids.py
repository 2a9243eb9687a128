"""Centroid clustering in exact integer arithmetic, with sort-means.

A component x becomes the integer floor(scale * x). Each round orders, for every centroid, the others by their distance from it. A
vector then starts at the centroid it had: at distance d, a centroid further than 2d from that one is further than d from the
vector, by the triangle inequality. So the vector meets the others in that order, up to the first that is strictly
beyond twice d; one at just 2d may tie, and of equal distances the smaller number wins. The assignment is that of a full
search, while vectors that sit well within their cluster meet few centroids.

Vectors lie in the shared folder as bytes, with their assignment, and are read and written once a round. A task sends one row of sums a
centroid; these are added up 64 tasks at a time (``in_lanes``), so a cluster of a third of all rows costs no more than any other. The
driver holds centroids only.

Kept are vectors of exactly ``width`` components, none null or non-finite; null vectors, empty ones and others go. Repeated rows and ids stay,
each a vector of its own. A null id counts as an empty text in the start's hash; equal
hashes (repeated ids) start in the order of their vectors. With fewer kept vectors than centroids each of them is a centroid; with none, the
result is empty. Integers and sums are exact at any magnitude; a distance or inertia that a long can't hold is null. Other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import checkpointed, in_lanes, lean

#: Magnitude below which squared distances of a few thousand components can't leave 64 bits.
NARROW = 1 << 25
LONG = (1 << 63) - 1
#: Vectors handled at once.
ROWS = 1 << 13
PARTS = "cluster int, n long, sums array<string>, inertia string"


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    scaled = x * scale
    return math.floor(scaled) if math.isfinite(scaled) else int(x) * scale  # a product beyond all doubles is of a whole x


def packed(vector: list[int]) -> bytes:
    """Four bytes for each integer, or text where one needs more: never as long as the former."""
    if all(abs(c) < NARROW for c in vector):
        return np.array(vector, "<i4").tobytes()
    text = json.dumps(vector).encode()
    return text + b" " * (len(text) == 4 * len(vector))


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    """A matrix of packed vectors: of 64-bit integers, or of Python's if any needs them."""
    if all(len(r) == 4 * width for r in rows):
        return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), width).astype(np.int64)
    out = np.empty((len(rows), width), object)
    for i, r in enumerate(rows):
        out[i] = np.frombuffer(r, "<i4").tolist() if len(r) == 4 * width else json.loads(r)
    return out


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of rows to a centroid, exact."""
    apart = vectors - centroid
    return (apart * apart).sum(1)


class Centroids:
    """Centroids of one round, and for each the others by distance from it."""

    def __init__(self, rows: list[list[int]]):
        small = all(abs(c) < NARROW for row in rows for c in row)
        self.rows = np.array(rows, np.int64 if small else object)
        apart = [[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in rows] for x in rows]
        self.others = [sorted((d, j) for j, d in enumerate(own) if j != i) for i, own in enumerate(apart)]

    def nearest(self, vectors: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each vector. before: where each starts."""
        rows = self.rows
        cluster, distance = before.copy(), np.zeros(len(vectors), object if object in (rows.dtype, vectors.dtype) else np.int64)
        for start in np.unique(before):
            mine = np.flatnonzero(before == start)
            own = squared(vectors[mine], rows[start])
            best, chosen = own.copy(), np.full(len(mine), start)
            live = np.arange(len(mine))
            for apart, j in self.others[start]:
                live = live[np.array(apart <= 4 * own[live], bool)]  # squares: beyond twice the distance is beyond four times its square
                if not len(live):
                    break
                d = squared(vectors[mine[live]], rows[j])
                closer = np.array((d < best[live]) | ((d == best[live]) & (j < chosen[live])), bool)
                best[live[closer]], chosen[live[closer]] = d[closer], j
            cluster[mine], distance[mine] = chosen, best
        return cluster, distance


def _assigned(table: DataFrame, centroids: Centroids, width: int) -> DataFrame:
    """table(vec_id, v, cluster) with each vector's nearest centroid, and its squared distance as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = unpacked(part.column("v").to_pylist(), width)
                cluster, distance = centroids.nearest(vectors, part.column("cluster").to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("v"), pa.array(cluster, pa.int32()), pa.array([str(d) for d in distance.tolist()], pa.string())],
                    ["vec_id", "v", "cluster", "squared"],
                )

    return table.mapInArrow(lean(run), "vec_id long, v binary, cluster int, squared string")


def _added(rows: pa.Table) -> pa.Table:
    """One row of the sums of several tasks."""
    sums = [str(sum(map(int, own))) for own in zip(*rows["sums"].to_pylist(), strict=True)]
    inertia = str(sum(map(int, rows["inertia"].to_pylist())))
    n = sum(rows["n"].to_pylist())
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string()]
    return pa.table([pa.array([x], k) for x, k in zip((rows["cluster"][0].as_py(), n, sums, inertia), kinds, strict=True)], names=["cluster", "n", "sums", "inertia"])


def sums(table: DataFrame, width: int) -> dict[int, tuple[int, list[int], int]]:
    """(vectors, sum of each component, sum of squared distances) of each cluster that has any: bounded by the number of centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = unpacked(part.column("v").to_pylist(), width)
                cluster = part.column("cluster").to_numpy()
                squares = list(map(int, part.column("squared").to_pylist()))
                for c in np.unique(cluster).tolist():
                    mine = np.flatnonzero(cluster == c)
                    n, own, inertia = total.setdefault(c, [0, [0] * width, 0])
                    more = vectors[mine].sum(0).tolist()
                    total[c] = [n + len(mine), [a + b for a, b in zip(own, more, strict=True)], inertia + sum(squares[i] for i in mine)]
        for c, (n, own, inertia) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([n], pa.int64()), pa.array([list(map(str, own))], pa.list_(pa.string())), pa.array([str(inertia)], pa.string())],
                ["cluster", "n", "sums", "inertia"],
            )

    parts = table.select("v", "cluster", "squared").mapInArrow(lean(run), PARTS)
    return {r["cluster"]: (r["n"], list(map(int, r["sums"])), int(r["inertia"])) for r in in_lanes(parts, "cluster", _added, PARTS).collect()}


def taking_part(embeddings: DataFrame, width: int) -> DataFrame:
    """(vec_id, x): vectors of the width whose components are all finite, as doubles."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    return rows.where((F.size("x") == width) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))


def integers(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v, cluster) of taking_part's rows: packed integers, all starting at centroid 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                v = [packed([whole(c, scale) for c in x]) for x in part.column("x").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(v, pa.binary()), pa.array([0] * len(v), pa.int32())], ["vec_id", "v", "cluster"])

    return rows.mapInArrow(lean(run), "vec_id long, v binary, cluster int")


def starts(rows: DataFrame, k: int, scale: int, seed: str) -> list[list[int]]:
    """The k vectors of least hash."""
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[whole(c, scale) for c in r["x"]] for r in rows.select("x", order.alias("h")).orderBy("h", "x").limit(k).collect()]


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """Each kept vector's cluster: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_cluster).

    distance is squared; the inertias are sums of it. Rounds end early once no centroid moves, since all later ones would repeat the last.
    """
    spark = embeddings.sparkSession
    rows = taking_part(embeddings, width)
    table, now = checkpointed(integers(rows, scale)), starts(rows, k, scale, seed)
    totals: dict[int, tuple[int, list[int], int]] = {}
    if now:
        for left in range(rounds, -1, -1):
            table = checkpointed(_assigned(table, Centroids(now), width))
            totals = sums(table, width)
            moved = [[c // totals[i][0] for c in totals[i][1]] if i in totals else row for i, row in enumerate(now)]
            if not left or moved == now:
                break
            now = moved
    else:
        table = table.withColumn("squared", F.lit("0"))

    def held(x: int) -> int | None:
        return x if x <= LONG else None

    total = held(sum(inertia for _, _, inertia in totals.values()))
    digests = [(i, n, held(inertia), hashlib.sha256(",".join(map(str, now[i])).encode()).hexdigest()) for i, (n, _, inertia) in totals.items()]
    of_cluster = spark.createDataFrame(digests, "cluster int, n_cluster long, cluster_inertia long, centroid_sha256 string")  # k rows at most
    return table.join(F.broadcast(of_cluster), "cluster").select(
        "vec_id",
        "cluster",
        F.expr("try_cast(squared as bigint)").alias("distance"),
        "cluster_inertia",
        F.lit(total).cast("long").alias("inertia"),
        "centroid_sha256",
        "n_cluster",
    )
