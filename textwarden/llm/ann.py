"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Vectors are dealt into shards of bounded size by hash. Each shard's graph is built in one task and
stored as flat neighbour arrays, one row a shard, in a written table. Queries visit every shard, and
the shards' best are merged. Nearness is the largest inner product: graphs are built on vectors
lengthened by one component so that all have the shard's largest norm, where the nearest by distance
is the one of the largest product. Final scores are in double precision on the original vectors.

Equal vectors are one entry of the graph that holds their ``k + 1`` smallest ids; a result of k rows
can use no more of them. Every row is indexed this way, none is sampled.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows without an id; vectors are compared with those of their own length; rows that repeat id and
vector count once, and a query never finds its own id; an empty table gives an empty table; columns
beside id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import materialize, tidied

#: A shard holds so many vectors, or fewer if they are long: as many as a task builds a graph of in some
#: minutes. Every query visits every shard, so few large shards cost less than many small ones.
SHARD_ROWS = 65_536
SHARD_BYTES = 64_000_000
LINKS = 16
BUILD_BEAM = 64
SEARCH_BEAM = 420
#: Points that are inserted, or queries that are searched, in step.
STEP = 256
#: Candidates that one round of a search opens.
OPENED = 4

INDEX_SCHEMA = "shard int, dim int, ids array<array<long>>, vectors array<float>, layer_sizes array<int>, neighbours array<array<int>>"


class Graph:
    """Points in insertion order, highest layer first: layer j holds the first sizes[j] points."""

    def __init__(self, points: np.ndarray, sizes: list[int], neighbours: list[np.ndarray]):
        self.points, self.sizes, self.neighbours = points, sizes, neighbours
        self.square = np.einsum("ij,ij->i", points, points)

    def distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances, less the queries' own squares, to (queries, n) ids; -1 is far away."""
        d = self.square[ids] - 2 * np.einsum("qd,qnd->qn", queries, self.points[ids])
        d[ids < 0] = np.inf
        return d

    def beam(self, queries: np.ndarray, starts: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The width nearest found in a layer, nearest first, and their distances."""
        links = self.neighbours[layer]
        n = len(queries)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.points)), bool)
        ids = np.full((n, width), -1)
        ids[:, : starts.shape[1]] = starts
        dist = self.distances(queries, ids)
        seen[rows, starts] = True
        open_ = ids >= 0
        while True:
            waiting = np.where(open_, dist, np.inf)
            pick = np.argsort(waiting, axis=1)[:, :OPENED]
            usable = np.isfinite(np.take_along_axis(waiting, pick, 1))
            live = usable.any(axis=1)
            if not live.any():
                break
            if not live.all():
                at = np.flatnonzero(live)
            else:
                at = rows[:, 0]
            near = links[np.where(usable[at], ids[at[:, None], pick[at]], -1)].reshape(len(at), -1)
            near[np.repeat(~usable[at], links.shape[1], axis=1)] = -1
            open_[at[:, None], pick[at]] = False
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[at[:, None], near] & (near >= 0)] = -1
            keep = (near >= 0).any(axis=0)
            near = near[:, keep]
            if not near.size:
                continue
            r, c = np.nonzero(near >= 0)
            seen[at[r], near[r, c]] = True
            all_ids = np.concatenate((ids[at], near), axis=1)
            all_dist = np.concatenate((dist[at], self.distances(queries[at], near)), axis=1)
            all_open = np.concatenate((open_[at], near >= 0), axis=1)
            best = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
            ids[at], dist[at], open_[at] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_dist, all_open))
            ids[at] = np.where(np.isfinite(dist[at]), ids[at], -1)
            open_[at] &= ids[at] >= 0
        return ids, dist

    def search(self, queries: np.ndarray, width: int, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """From the top layer down, one nearest point a layer, and a beam in the last."""
        starts = np.zeros((len(queries), 1), np.int64)
        top = len(self.sizes) - 1
        for layer in range(top, down_to, -1):
            starts = self.beam(queries, starts, layer, 4)[0][:, :1]
        return self.beam(queries, starts, down_to, width)

    def diverse(self, base: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, nearest first, those nearer to the base than to any taken one, then the nearest rest."""
        vectors = self.points[ids]
        own = np.einsum("bd,bd->b", base, base)
        apart = self.square[ids][:, :, None] + self.square[ids][:, None] - 2 * vectors @ vectors.transpose(0, 2, 1)
        to_base = dist + own[:, None]
        taken = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            blocked = (taken & (apart[:, c] < to_base[:, c, None])).any(axis=1)
            taken[:, c] = ~blocked & (ids[:, c] >= 0) & (taken.sum(axis=1) < most)
        order = np.argsort(np.where(ids >= 0, np.where(taken, 0, 1), 2), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, order, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def lengthened(vectors: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
    rest = np.sqrt(np.maximum(square.max() - square, 0)) if len(vectors) else square
    return np.hstack([vectors, rest[:, None]]).astype(np.float32)


def build(vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 5) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """The insertion order of vectors, the layers' sizes, and each layer's neighbour array (-1: none)."""
    n = len(vectors)
    draw = np.random.default_rng(seed).random(n)
    level = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(links)), 8).astype(int)
    order = np.argsort(-level, kind="stable")
    level = level[order]
    sizes = [int((level >= j).sum()) for j in range(level[0] + 1)]
    caps = [2 * links] + [links] * level[0]
    graph = Graph(lengthened(vectors[order]), sizes, [np.full((s, c), -1, np.int64) for s, c in zip(sizes, caps)])
    for layer in range(level[0], -1, -1):
        cap, table, done = caps[layer], graph.neighbours[layer], 1
        while done < sizes[layer]:
            new = np.arange(done, min(sizes[layer], done + min(STEP, done)))
            queries = graph.points[new]
            if layer < level[0]:
                starts = graph.search(queries, 4, layer + 1)[0][:, :1]
            else:
                starts = np.zeros((len(new), 1), np.int64)
            starts = np.where((starts >= 0) & (starts < done), starts, 0)
            ids, dist = graph.beam(queries, starts, layer, beam)
            beside = np.where(np.tri(len(new), k=-1, dtype=bool), new[None], -1)
            both = np.concatenate((ids, beside), axis=1)
            both_dist = np.concatenate((dist, graph.distances(queries, beside)), axis=1)
            first = np.argsort(both_dist, axis=1, kind="stable")[:, :beam]
            chosen = graph.diverse(queries, np.take_along_axis(both, first, 1), np.take_along_axis(both_dist, first, 1), links)
            table[new, :links] = chosen
            _link_back(graph, layer, new, chosen, cap)
            done = int(new[-1]) + 1
    return order, sizes, graph.neighbours


def _link_back(graph: Graph, layer: int, new: np.ndarray, chosen: np.ndarray, cap: int) -> None:
    """Adds the reverse of new links; a point with more than cap keeps a diverse choice."""
    table = graph.neighbours[layer]
    target = chosen.ravel()
    source = np.repeat(new, chosen.shape[1])[target >= 0]
    target = target[target >= 0]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    at, start, count = np.unique(target, return_index=True, return_counts=True)
    if not len(at):
        return
    extra = np.full((len(at), count.max()), -1)
    extra[np.repeat(np.arange(len(at)), count), np.arange(len(target)) - np.repeat(start, count)] = source
    every = np.concatenate((table[at], extra), axis=1)
    every.sort(axis=1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
    full = (every >= 0).sum(axis=1) > cap
    room = -np.sort(-every[~full], axis=1)[:, :cap]
    table[at[~full], : room.shape[1]] = room
    if full.any():
        base, ids = graph.points[at[full]], every[full]
        dist = graph.distances(base, ids)
        first = np.argsort(dist, axis=1, kind="stable")[:, : max(2 * cap, 64)]
        table[at[full]] = graph.diverse(base, np.take_along_axis(ids, first, 1), np.take_along_axis(dist, first, 1), cap)


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def entries(df: DataFrame, vec_id: str, vector: str, k: int) -> DataFrame:
    """Distinct usable vectors with the k + 1 smallest ids of their rows.

    row_number() <= k + 1 is applied in each map task first, so a vector that many rows hold does
    not send them all to one task.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector")).filter(F.col("id").isNotNull() & usable("vector"))
    rank = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("r", rank).filter(F.col("r") <= k + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def index(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The written index: a row for each shard and vector length (INDEX_SCHEMA)."""
    distinct = materialize(entries(df, vec_id, vector, k), "ann-entries")
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector")).alias("components")).first()
    shards = max(1, math.ceil(size.n / shard_rows), math.ceil(4 * (size.components or 0) / SHARD_BYTES))
    dealt = distinct.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dim"), "vector", "ids")

    def graph(table: pa.Table) -> pa.Table:
        ids = table["ids"].to_pylist()
        dim = table["dim"][0].as_py()
        vectors = np.array(table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)
        by_id = np.argsort([x[0] for x in ids], kind="stable")
        order, sizes, neighbours = build(vectors[by_id])
        order = by_id[order]
        columns = [
            pa.array([table["shard"][0].as_py()], pa.int32()),
            pa.array([dim], pa.int32()),
            pa.array([[ids[i] for i in order]], pa.list_(pa.list_(pa.int64()))),
            pa.array([vectors[order].ravel()], pa.list_(pa.float32())),
            pa.array([sizes], pa.list_(pa.int32())),
            pa.array([[x.ravel().astype(np.int32) for x in neighbours]], pa.list_(pa.list_(pa.int32()))),
        ]
        return pa.table(columns, names=["shard", "dim", "ids", "vectors", "layer_sizes", "neighbours"])

    return materialize(dealt.groupBy("shard", "dim").applyInArrow(graph, INDEX_SCHEMA), "ann-index")


def search(indexed: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query, other ids alone.

    The shards' keys, as many as shards, are broadcast to the queries; each task holds one shard's
    graph and a batch of queries at a time.
    """
    asked = queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast("array<float>").alias("query")).filter(F.col("query_id").isNotNull() & usable("query")).distinct()
    keys = indexed.select("shard", "dim")
    visits = asked.join(F.broadcast(keys), F.size("query") == F.col("dim"))
    blank = [F.lit(None).cast(t).alias(n) for n, t in (c.split(" ") for c in INDEX_SCHEMA.split(", ")[2:])]
    rows = indexed.select("shard", "dim", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<float>").alias("query"), "ids", "vectors", "layer_sizes", "neighbours")
    rows = rows.unionByName(visits.select("shard", "dim", "query_id", "query", *blank))
    placed = rows.repartition("shard", "dim").sortWithinPartitions("shard", "dim", F.col("query_id").asc_nulls_first())

    def visit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, ids, own = None, [], np.zeros((0, 0))
        for batch in it:
            shard_rows = [i for i, q in enumerate(batch.column("query_id").to_pylist()) if q is None]
            edges = sorted({0, *shard_rows, batch.num_rows})
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if a in shard_rows:
                    row = part.slice(0, 1).to_pylist()[0]
                    ids, sizes = row["ids"], row["layer_sizes"]
                    own = np.array(row["vectors"], np.float32).reshape(len(ids), -1)
                    graph = Graph(lengthened(own), sizes, [np.array(x, np.int64).reshape(s, -1) for x, s in zip(row["neighbours"], sizes)])
                    part = part.slice(1)
                for at in range(0, part.num_rows, STEP):
                    some = part.slice(at, STEP)
                    yield from _answers(graph, ids, own, some, k, beam)

    found = placed.mapInArrow(tidied(visit), "query_id long, score double, ids array<long>")
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(graph: Graph, ids: list[list[int]], own: np.ndarray, some: pa.RecordBatch, k: int, beam: int) -> Iterator[pa.RecordBatch]:
    queries = np.array(some.column("query").to_pylist(), np.float32)
    names = np.array(some.column("query_id").to_pylist())
    longer = np.hstack([queries, np.zeros((len(queries), 1), np.float32)])
    near, _ = graph.search(longer, beam)
    scores = np.einsum("qd,qnd->qn", queries.astype(np.float64), own[near].astype(np.float64))
    scores[near < 0] = -np.inf
    # where scores tie at the end of the list the smaller ids must stay, so equal ones all do
    last = -np.sort(-scores, axis=1)[:, min(k, scores.shape[1] - 1)]
    q, c = np.nonzero(np.isfinite(scores) & (scores >= last[:, None]))
    columns = [pa.array(names[q], pa.int64()), pa.array(scores[q, c], pa.float64()), pa.array([ids[i] for i in near[q, c]], pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "score", "ids"])
