"""Approximate nearest neighbours by a navigable small-world graph per shard.

Rows with equal vectors form a class, since copies of one vector would fill each
other's neighbour lists. Classes are dealt to shards of about SHARD_ROWS by the
hash of their vector; each shard is built as a hierarchical graph in one task and
stored as flat arrays: vectors, the levels' node lists, and their neighbours,
padded with -1. Query blocks meet every shard; what the shards find is scored
exactly on the original vectors and merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafacet.llm.shared import slices, stored

SHARD_ROWS, BLOCK_QUERIES = 8192, 16384
LINKS, LOWEST_LINKS = 16, 32
EF_BUILD, EF_SEARCH = 80, 80
INDEX = "dim int, shard int, ids array<array<long>>, vectors binary, levels array<binary>, links array<binary>"


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths of vectors of whatever magnitude."""
    most = np.abs(vectors).max(1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(1))


class Graph:
    """Unit vectors and, for each level, the neighbours of its nodes; level 0 holds all."""

    def __init__(self, vectors: np.ndarray):
        self.unit = (vectors / norms(vectors)[:, None]).astype(np.float32)
        self.links: list[dict[int, list[int]]] = []
        self.entry = 0

    def build(self, seed: int = 5) -> Graph:
        random = np.random.default_rng(seed)
        heights = (-np.log(1 - random.random(len(self.unit))) / math.log(LINKS)).astype(int).tolist()
        for node, height in enumerate(heights):
            self.insert(node, height)
        return self

    def insert(self, node: int, height: int) -> None:
        top = len(self.links) - 1
        if top < 0:
            self.links, self.entry = [{node: []} for _ in range(height + 1)], node
            return
        query = self.unit[node]
        near = [(1 - float(self.unit[self.entry] @ query), self.entry)]
        for level in range(top, height, -1):
            near = self.search_level(query, near, 1, level)
        for level in range(min(top, height), -1, -1):
            near = self.search_level(query, near, EF_BUILD, level)
            most = LINKS if level else LOWEST_LINKS
            links = self.links[level]
            links[node] = self.select(near, LINKS)
            for other in links[node]:
                links[other].append(node)
                if len(links[other]) > most:
                    far = (1 - self.unit[links[other]] @ self.unit[other]).tolist()
                    links[other] = self.select(sorted(zip(far, links[other])), most)
        for _ in range(top + 1, height + 1):
            self.links.append({node: []})
            self.entry = node

    def select(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates, nearest first, those nearer to the node than to one chosen; then the nearest others."""
        nodes = [j for _, j in near]
        if len(nodes) <= most // 2:
            return nodes
        vectors = self.unit[nodes]
        alike = (1 - vectors @ vectors.T).tolist()
        chosen: list[int] = []
        for k, (far, _) in enumerate(near):
            row = alike[k]
            if all(row[c] > far for c in chosen):
                chosen.append(k)
                if len(chosen) == most:
                    break
        rest = [k for k in range(len(nodes)) if k not in set(chosen)]
        return [nodes[k] for k in chosen + rest[: most - len(chosen)]]

    def search_level(self, query: np.ndarray, near: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest nodes of a level that are found from `near`, nearest first."""
        links = self.links[level]
        seen = {j for _, j in near}
        open_, best = list(near), [(-d, j) for d, j in near]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            far, node = heapq.heappop(open_)
            if far > -best[0][0] and len(best) >= ef:
                break
            new = [j for j in links[node] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for d, j in zip((1 - self.unit[new] @ query).tolist(), new):
                if len(best) < ef or d < -best[0][0]:
                    heapq.heappush(open_, (d, j))
                    heapq.heappush(best, (-d, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, j) for d, j in best)

    def search(self, query: np.ndarray, ef: int) -> list[int]:
        """About the ef nearest nodes of a unit vector, nearest first."""
        near = [(1 - float(self.unit[self.entry] @ query), self.entry)]
        for level in range(len(self.links) - 1, 0, -1):
            near = self.search_level(query, near, 1, level)
        return [j for _, j in self.search_level(query, near, ef, 0)]

    def flat(self) -> tuple[list[bytes], list[bytes]]:
        """Each level's nodes and its neighbour matrix, as int32 bytes; the entry comes first on the highest level."""
        levels, flat = [], []
        for level, links in enumerate(self.links):
            nodes = sorted(links, key=lambda j: (j != self.entry, j))
            matrix = np.full((len(nodes), LINKS if level else LOWEST_LINKS), -1, np.int32)
            for row, node in zip(matrix, nodes):
                row[: len(links[node])] = links[node]
            levels.append(np.array(nodes, np.int32).tobytes())
            flat.append(matrix.tobytes())
        return levels, flat

    def load(self, levels: list[bytes], flat: list[bytes]) -> Graph:
        for level, (nodes, links) in enumerate(zip(levels, flat)):
            matrix = np.frombuffer(links, np.int32).reshape(-1, LINKS if level else LOWEST_LINKS)
            self.links.append({n: row[: row.index(-1)] if row[-1] < 0 else row for n, row in zip(np.frombuffer(nodes, np.int32).tolist(), matrix.tolist())})
        self.entry = int(np.frombuffer(levels[-1], np.int32)[0])
        return self


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (double) of the rows that can take part: all components there and finite, one of them not zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).distinct()


def build_index(rows: DataFrame, copies: int) -> DataFrame:
    """The stored index of all usable rows: INDEX, a row per shard; of equal vectors the `copies` least ids stand in it."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= copies)
    classes = stored(first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "hnsw-classes")
    shards = max(1, -(-classes.count() // SHARD_ROWS))
    dealt = classes.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), "ids", "embedding")

    def build(group: pa.Table) -> pa.Table:
        order = np.argsort([x[0] for x in group.column("ids").to_pylist()], kind="stable")
        group = group.take(pa.array(order))
        dim = group.column("dim")[0].as_py()
        vectors = np.concatenate([np.asarray(x, np.float64) for x in group.column("embedding").to_numpy()]).reshape(-1, dim)
        levels, flat = Graph(vectors).build().flat()
        row = {"dim": dim, "shard": group.column("shard")[0].as_py(), "ids": group.column("ids").to_pylist(), "vectors": vectors.tobytes(), "levels": levels, "links": flat}
        return pa.Table.from_pylist([row], pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.list_(pa.list_(pa.int64()))), ("vectors", pa.binary()), ("levels", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]))

    return stored(dealt.groupBy("dim", "shard").applyInArrow(build, INDEX), "hnsw-index")


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In double precision: sums are rounded once; numbers far from 1 are scaled by powers of two first, which is exact."""
    a, b = (np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) if not 1e-60 < np.abs(x).max() < 1e60 else x for x in (a, b))
    return math.fsum((a * b).tolist()) / (math.sqrt(math.fsum((a * a).tolist())) * math.sqrt(math.fsum((b * b).tolist())))


def search_index(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each usable query, its own id left out.

    Queries go in blocks to every shard of their dimension. Ties go to the smaller vec_id.
    """
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    dealt = queries.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.struct("vec_id", "embedding").alias("q"))
    packed = dealt.groupBy("dim", "block").agg(F.collect_list("q").alias("queries"))  # about BLOCK_QUERIES
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    aimed = packed.join(F.broadcast(shards), "dim").select("dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), "queries")  # a row per dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            graph = Graph(vectors).load(row["levels"], row["links"])
            lengths = norms(vectors)
            found = []
            for query in row["queries"]:
                vector = np.array(query["embedding"], np.float64)
                unit = vector / norms(vector[None])[0]
                near = np.array(graph.search(unit.astype(np.float32), ef))
                alike = (vectors[near] / lengths[near, None]) @ unit
                least = np.sort(alike)[-min(len(near), k + 1)] - 1e-12  # what may tie with the last, the query's own class beside
                for node in near[alike >= least].tolist():
                    score = exact_cosine(vector, vectors[node])
                    found += [(query["vec_id"], i, score) for i in row["ids"][node] if i != query["vec_id"]]
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = aimed.join(index, ["dim", "shard"]).mapInArrow(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of `vectors` (vec_id, embedding) by cosine for each row of `queries`, approximately.

    Vectors that are null, zero, or hold null or non-finite components take no
    part; vectors of different lengths don't meet. Repeated rows count once.
    """
    return search_index(build_index(usable(vectors), k + 1), usable(queries), k)
