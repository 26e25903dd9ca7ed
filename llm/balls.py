"""k-means on integer vectors, exact, with ball trees that assign whole groups of vectors at once.

Vectors are laid down once in blocks of a bounded number; a block carries its own metric tree:
per ball a centre, a radius, the number of vectors and their integer sum.  In a round every block
is filtered by the centroids: where the triangle inequality shows that one centroid is nearest to
all of a ball, the ball's count and sum are taken as they are; else its halves are looked at with
the centroids that are still possible, and leaves are compared exactly.  Only counts and sums per
centroid and component are shuffled, and only the centroids (k vectors) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Vectors of one block (one tree) and of a leaf.
BLOCK, LEAF = 4096, 32
#: Components up to this size keep squared distances of up to 2**8 components within 64 bits.
LIMIT = 1 << 26
#: What floating-point radii and distances may be off by, relative and absolute (of distances, not squares).
SLACK = 1e-9, 1e-6


def quantised(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """id and v array<bigint>: floor(scale * x) of every vector of exactly `dims` components, none null, NaN or infinite; the rest is left out.

    A component of LIMIT or more in size stops the job with a message, as distances would not fit."""
    q = f"`{vec_col}`"
    good = f"size({q}) = {dims} AND forall({q}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(cast(x AS double)) < cast('Infinity' AS double))"
    whole = f"if(abs(cast(x AS double)) * {scale} < {LIMIT}, cast(floor({scale} * cast(x AS double)) AS bigint), cast(raise_error('vector component too large') AS bigint))"
    return vectors.where(F.expr(f"coalesce({good}, false)")).select(F.col(f"`{id_col}`").alias("id"), F.expr(f"transform({q}, x -> {whole})").alias("v"))


class Tree:
    """Balls over the rows of x (integers), which it puts in its own order."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.begin, self.end, self.left, self.right = [], [], [], []
        self.radius, self.sums = [], []
        f = x.astype(np.float64)
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(self.begin)
            if parent >= 0:
                (self.right if side else self.left)[parent] = me
            rows = self.order[a:b]
            total = x[rows].sum(axis=0)
            centre = total / (b - a)
            away = np.sqrt(((f[rows] - centre) ** 2).sum(axis=1))
            self.begin.append(a), self.end.append(b), self.left.append(-1), self.right.append(-1)
            self.radius.append(away.max() * (1 + SLACK[0]) + SLACK[1]), self.sums.append(total)
            if b - a > leaf and (f[rows] != f[rows[0]]).any():
                # Halves along the line between two far vectors.
                one = f[rows[away.argmax()]]
                two = f[rows[((f[rows] - one) ** 2).sum(axis=1).argmax()]]
                half = (b - a) // 2
                self.order[a:b] = rows[np.argpartition((f[rows] - one) @ (two - one), half)]
                todo += [(a, a + half, me, 0), (a + half, b, me, 1)]

    def columns(self) -> dict[str, bytes]:
        ints = lambda v: np.array(v, dtype="<i8").tobytes()
        return {"nodes": ints([self.begin, self.end, self.left, self.right]), "radius": np.array(self.radius, dtype="<f8").tobytes(), "sums": ints(self.sums)}


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """One written row per block of up to `size` vectors (id, v) of a partition: ids, the vectors in the tree's order, and the tree."""
    kind = dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0

        def block() -> pa.RecordBatch:
            x = np.concatenate(parts)
            tree = Tree(x)
            keys = pa.concat_arrays(ids).take(pa.array(tree.order))
            cols = {"vectors": x[tree.order].astype("<i8").tobytes(), **tree.columns()}
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), keys), *(pa.array([c], pa.binary()) for c in cols.values())], names=["ids", *cols])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - held)
                at, held = at + part.num_rows, held + part.num_rows
                ids.append(part.column(0))
                parts.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                if held == size:
                    yield block()
                    ids, parts, held = [], [], 0
        if held:
            yield block()

    return written(vectors.mapInArrow(run, f"ids array<{kind}>, vectors binary, nodes binary, radius binary, sums binary"), "balls")


def nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest of some centroids (ascending numbers: the smallest on ties) and the squared distance, exact."""
    d = np.stack([((x - centroids[c]) ** 2).sum(axis=1) for c in among], axis=1)
    best = d.argmin(axis=1)
    return among[best], d[np.arange(len(x)), best]


def assign(row: dict, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """(begin, end, node, centroids): a node of balls wholly at one centroid, or the rows of a leaf with the centroids left."""
    begin, end, left, right = np.frombuffer(row["nodes"], "<i8").reshape(4, -1)
    radius = np.frombuffer(row["radius"], "<f8")
    sums = np.frombuffer(row["sums"], "<i8").reshape(len(radius), -1)
    c = centroids.astype(np.float64)
    todo = [(0, np.arange(len(c)))]
    while todo:
        node, among = todo.pop()
        centre = sums[node] / (end[node] - begin[node])
        d = np.sqrt(((c[among] - centre) ** 2).sum(axis=1))
        far = (d.min() + radius[node]) * (1 + SLACK[0]) + SLACK[1]
        # By the triangle inequality no vector of the ball is nearer to the others than to the nearest one.
        among = among[(d - radius[node]) * (1 - SLACK[0]) - SLACK[1] <= far]
        if len(among) == 1 or left[node] < 0:
            yield int(begin[node]), int(end[node]), node, among
        else:
            todo += [(left[node], among), (right[node], among)]


def _round(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of the vectors nearest to each centroid; k * dims partial sums leave a partition."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x, sums = np.frombuffer(row["vectors"], "<i8").reshape(-1, dims), np.frombuffer(row["sums"], "<i8").reshape(-1, dims)
                for a, b, node, among in assign(row, centroids):
                    if len(among) == 1:
                        n[among[0]] += b - a
                        total[among[0]] += sums[node]
                    else:
                        at, _ = nearest(x[a:b], centroids, among)
                        n += np.bincount(at, minlength=k)
                        np.add.at(total, at, x[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), dims), pa.int32()), pa.array(np.tile(np.arange(dims), k), pa.int32()), pa.array(np.repeat(n, dims)), pa.array(total.ravel())], names=["c", "dim", "n", "total"])

    sums = table.select("vectors", "nodes", "radius", "sums").mapInArrow(run, "c int, dim int, n long, total long")
    # Decimals, so that sums over any number of vectors stay exact.
    wide = sums.groupBy("c", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in wide.collect():  # k * dims rows
        n, t = out.setdefault(r.c, (r.n, [0] * dims))
        t[r.dim] = int(r.total)
    return out


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of the smallest sha256 of seed and id (equal ones by their components); null ids come last.  k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: str = "3:", block: int = BLOCK) -> DataFrame:
    """id, cluster int, distance long (squared), cluster_inertia and inertia long, centroid array<bigint>, centroid_sha256 per kept vector.

    See `quantised` for what is kept.  Rows of one id are vectors of their own.  Fewer than k
    vectors give as many centroids; an empty table gives no row.  A centroid without vectors stays."""
    spark = vectors.sparkSession
    kept = quantised(vectors, id_col, vec_col, dims, scale)
    table = blocks(kept, block)
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, total) in _round(table, centroids).items():
            if n:
                centroids[c] = [t // n for t in total]
    fixed = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.select(["vectors", "nodes", "radius", "sums"]).to_pylist()[0]
                x = np.frombuffer(row["vectors"], "<i8").reshape(-1, dims)
                at, away = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
                for a, b, _, among in assign(row, fixed):
                    at[a:b], away[a:b] = nearest(x[a:b], fixed, among)
                yield pa.RecordBatch.from_arrays([one.column(0).flatten(), pa.array(at), pa.array(away)], names=["id", "cluster", "distance"])

    kind = dict(kept.dtypes)["id"]
    found = written(table.mapInArrow(run, f"id {kind}, cluster int, distance long"), "ball-clusters")
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    rows = [(i, [int(x) for x in c], hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = spark.createDataFrame(rows, "cluster int, centroid array<bigint>, centroid_sha256 string")
    # Both tables hold k rows.
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    figures = per.join(F.broadcast(names), "cluster").join(F.broadcast(total))
    out = found.join(F.broadcast(figures), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
