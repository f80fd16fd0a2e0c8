"""Centroid clustering with ball trees.

Every task packs its vectors of integers into metric trees of up to TREE_ROWS
vectors and stores them. A node knows its ball, that is a centre and a radius,
and of its vectors the count, the integer sum and the sum of squares. To assign
vectors, a round walks each tree from the root: by the triangle inequality a
centroid much farther from the centre than another can't be nearest to anything
in the ball and is dropped below it; a ball with one centroid left goes to it as a
whole, by count and sums; a leaf with several compares its vectors one by one, in
exact integers. A round sends its centroids out and gets a count and a sum per
centroid back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafacet.llm.shared import slices, stored

#: Vectors of a tree and of a leaf, at most.
TREE_ROWS, LEAF_ROWS = 4096, 32
#: Components of a larger amount would let a squared distance leave 64 bits.
MOST_COMPONENT = 1 << 26
#: A part of a distance that rounding in doubles may hide.
ROUNDING = 1e-9
TREES = "ids array<long>, points binary, centre binary, radius binary, begin binary, past binary, child binary, sums binary, squares binary"


def whole_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of the vectors with `dim` components, none of them null or not finite."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    kept = vectors.where((F.size("embedding") == dim) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def build(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of points (rows) in leaves and the nodes of their tree: halves along the widest component, level by level."""
    order = np.arange(len(points))
    begin, past, child, at = [0], [len(points)], [-1], 0
    centre, radius, sums, squares = [], [], [], []
    while at < len(begin):
        a, b = begin[at], past[at]
        mine = points[order[a:b]]
        total = mine.sum(axis=0)
        middle = total / (b - a)
        away = np.sqrt(((mine - middle) ** 2).sum(axis=1))
        centre.append(middle)
        radius.append(away.max())
        sums.append(total)
        squares.append(int((mine * mine).sum()))
        spread = mine.max(axis=0) - mine.min(axis=0)
        if b - a > LEAF_ROWS and spread.any():
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(mine[:, int(spread.argmax())], half)]
            child[at] = len(begin)
            begin += [a, a + half]
            past += [a + half, b]
            child += [-1, -1]
        at += 1
    ints = {"begin": begin, "past": past, "child": child}
    nodes = {name: np.array(v, np.int64) for name, v in ints.items()}
    return order, nodes | {"centre": np.array(centre), "radius": np.array(radius), "sums": np.array(sums, np.int64), "squares": np.array(squares, np.int64)}


def build_trees(kept: DataFrame, dim: int) -> DataFrame:
    """The stored trees (TREES) of vectors (vec_id, v), packed where they are, without a shuffle. Equal points stay in one leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TREE_ROWS):
            v = batch.column("v")
            points = v.flatten().to_numpy().astype(np.int64).reshape(-1, dim)
            if len(points) and np.abs(points).max() > MOST_COMPONENT:
                raise ArithmeticError(f"a component is beyond {MOST_COMPONENT}; squared distances wouldn't fit into 64 bits")
            order, nodes = build(points)
            ids = batch.column("vec_id").take(pa.array(order))
            row = {name: x.tobytes() for name, x in nodes.items()} | {"ids": ids.to_pylist(), "points": points[order].astype("<i4").tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("ids", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("points", "centre", "radius", "begin", "past", "child", "sums", "squares")]))

    return stored(kept.mapInArrow(run, TREES), "ball-trees")


@dataclass
class Tree:
    """A stored tree, read back."""

    ids: pa.Array
    points: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    past: np.ndarray
    child: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, dim: int) -> Tree:
        raw = {c: batch.column(c)[0].as_buffer() for c in ("points", "centre", "radius", "begin", "past", "child", "sums", "squares")}
        of = lambda name, kind: np.frombuffer(raw[name], kind)
        ints = {c: of(c, np.int64) for c in ("begin", "past", "child", "squares")}
        return cls(batch.column("ids")[0].values, of("points", "<i4").reshape(-1, dim), of("centre", np.float64).reshape(-1, dim), of("radius", np.float64), sums=of("sums", np.int64).reshape(-1, dim), **ints)

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
        """(nodes, centroid of each) of the balls that go whole, and (rows, centroid of each) of the points compared one by one."""
        whole, single = [], []
        nodes, may = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(nodes):
            away = np.sqrt(((self.centre[nodes][:, None, :] - centroids) ** 2).sum(axis=2))
            away[~may] = np.inf
            least = away.min(axis=1)
            # nothing in the ball is nearer to a centroid that is more than two radii farther from the centre than another
            may = away <= (least + 2 * self.radius[nodes] + ROUNDING * (1 + least + self.radius[nodes]))[:, None]
            one = may.sum(axis=1) == 1
            whole.append((nodes[one], may[one].argmax(axis=1)))
            nodes, may = nodes[~one], may[~one]
            leaf = self.child[nodes] < 0
            if leaf.any():
                rows = np.concatenate([np.arange(self.begin[n], self.past[n]) for n in nodes[leaf]])
                own = np.repeat(may[leaf], self.past[nodes[leaf]] - self.begin[nodes[leaf]], axis=0)
                far = squared_distances(self.points[rows], centroids)
                far[~own] = np.iinfo(np.int64).max
                single.append((rows, far.argmin(axis=1)))  # the first of equal ones
            nodes, may = nodes[~leaf], np.repeat(may[~leaf], 2, axis=0)
            nodes = (self.child[nodes][:, None] + np.arange(2)).ravel()
        return whole, single

    def labels(self, centroids: np.ndarray) -> np.ndarray:
        """The nearest centroid of every point."""
        out = np.zeros(len(self.points), np.int32)
        whole, single = self.assign(centroids)
        for nodes, nearest in whole:
            for node, c in zip(nodes, nearest):
                out[self.begin[node] : self.past[node]] = c
        for rows, nearest in single:
            out[rows] = nearest
        return out


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by centroid: by products of doubles where no sum leaves their 53 bits, else by integers."""
    points = points.astype(np.int64)
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * points.shape[1] * largest**2 < 1 << 53:
        product = (points.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
        return (points**2).sum(axis=1)[:, None] - 2 * product + (centroids**2).sum(axis=1)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def tallies(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Of every centroid with vectors: their number, the sum of their squares and their sums by component."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, squares, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in slices(batches, 1):
            tree = Tree.read(batch, dim)
            whole, single = tree.assign(centroids)
            for nodes, nearest in whole:
                np.add.at(count, nearest, tree.past[nodes] - tree.begin[nodes])
                np.add.at(squares, nearest, tree.squares[nodes])
                np.add.at(sums, nearest, tree.sums[nodes])
            for rows, nearest in single:
                points = tree.points[rows].astype(np.int64)
                np.add.at(count, nearest, 1)
                np.add.at(squares, nearest, (points**2).sum(axis=1))
                np.add.at(sums, nearest, points)
        every = np.concatenate([count[:, None], squares[:, None], sums], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), dim + 2)), pa.array(np.tile(np.arange(dim + 2, dtype=np.int32), k)), pa.array(every)], names=["cluster", "place", "value"])

    parts = trees.mapInArrow(run, "cluster int, place int, value long")
    found = parts.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # k * (dim + 2) rows
    table = {(r.cluster, r.place): int(r.value) for r in found}
    return {c: (table[c, 0], table[c, 1], [table[c, 2 + j] for j in range(dim)]) for c in range(k) if table.get((c, 0))}


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of least sha256 of `seed`:vec_id; those without a vec_id aren't chosen, equal ids go by their components."""
    hashed = kept.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r.v for r in hashed.orderBy("h", "v").limit(k).collect()], np.int64)  # k rows


def cluster(vectors: DataFrame, dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable row of `vectors` (vec_id, embedding).

    Vectors of another number of components or with null or non-finite ones take
    no part; the others are floor(scale * x). Repeated rows count as often as they
    stand there. Rows without a vec_id are clustered too. With fewer than k vectors
    there are as many centroids; without any, no rows. Ties go to the smaller
    number; an empty cluster keeps its centroid. Other columns aren't read. A
    component beyond MOST_COMPONENT raises an error.
    """
    kept = whole_vectors(vectors, dim, scale)
    centroids = first_centroids(kept, k, seed)
    spark, schema = vectors.sparkSession, "vec_id long, cluster int, distance long"
    if not len(centroids):
        empty = spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
        return empty
    trees = build_trees(kept, dim)
    for _ in range(rounds):
        for c, (count, _, sums) in tallies(trees, centroids).items():
            centroids[c] = [s // count for s in sums]
    final, shares = centroids.copy(), {}
    for c, (count, squares, sums) in tallies(trees, final).items():
        own = [int(x) for x in final[c]]
        shares[c] = squares - 2 * sum(s * z for s, z in zip(sums, own)) + count * sum(z * z for z in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            tree = Tree.read(batch, dim)
            label = tree.labels(final)
            far = ((tree.points.astype(np.int64) - final[label]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([tree.ids, pa.array(label), pa.array(far)], names=["vec_id", "cluster", "distance"])

    def of_cluster(values: dict[int, object]) -> Column:
        return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("cluster")]

    digests = {c: hashlib.sha256(",".join(map(str, final[c].tolist())).encode()).hexdigest() for c in shares}
    return trees.mapInArrow(run, schema).select(
        "vec_id", "cluster", "distance", of_cluster(shares).cast("long").alias("cluster_inertia"), F.lit(sum(shares.values())).cast("long").alias("inertia"), of_cluster(digests).alias("centroid_sha256")
    )


def oracle(dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1") -> str:
    """DuckDB SQL with the same rows: every vector against every centroid in each round."""
    parts = [
        f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x AS double)) AS bigint)) AS v FROM embeddings
          WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v AS z FROM kept ORDER BY c LIMIT {k})",
    ]
    squared = "list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for n in range(rounds + 1):
        parts.append(f"a{n} AS (SELECT vec_id, v, arg_min(c, {squared} * 1000 + c) AS c, cast(min({squared}) AS bigint) AS d FROM kept, c{n} GROUP BY vec_id, v)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT c, i, cast(sum(v[i]) AS bigint) AS s, count(*) AS n FROM a{n}, range(1, {dim + 1}) AS r(i) GROUP BY c, i)")
            parts.append(f"m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS z FROM s{n} GROUP BY c)")
            parts.append(f"c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.z, c{n}.z) AS z FROM c{n} LEFT JOIN m{n} USING (c))")
    return (
        "WITH "
        + ",\n".join(parts)
        + f""" SELECT vec_id, cast(c AS int) AS cluster, d AS distance, cast(sum(d) OVER (PARTITION BY c) AS bigint) AS cluster_inertia,
        cast(sum(d) OVER () AS bigint) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""
    )
