"""Approximate nearest neighbours by inner product over robust-pruned graphs.

Vectors are dealt over shards of bounded size, those of like length together. A shard's
graph connects directions (the vectors at length one) and starts from their medoid: for
each a greedy search proposes neighbours, and pruning keeps one only if no kept one is
much closer to it, which leaves short and long edges. A beam search along the edges,
led by the inner product with the vectors themselves, answers a query in each shard; the
best of all shards are its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purchase_insights.sources.scratch import materialize

INSERTED_AT_ONCE = 256


class Graph(NamedTuple):
    points: np.ndarray  # the directions
    edges: np.ndarray  # row per point, -1 where there are fewer
    entry: int


def directions(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length one; none is zero."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def beam_search(graph: Graph, queries: np.ndarray, beam: int, vectors: np.ndarray | None = None) -> np.ndarray:
    """The ``beam`` points found for each query with the largest inner products, largest first (-1: none).

    The products are those with ``vectors``, one per point, by default the points
    themselves. All queries take a step together: each looks at the neighbours of its
    best point not looked at yet, until its whole beam has been.
    """
    points, edges, entry = graph
    vectors = points if vectors is None else vectors
    n_queries, n_points = len(queries), len(points)
    found = np.full((n_queries, beam), -1)
    products = np.full((n_queries, beam), -np.inf)
    found[:, 0] = entry
    products[:, 0] = queries @ vectors[entry]
    done = np.zeros((n_queries, beam), bool)
    done[:, 1:] = True
    seen = np.zeros((n_queries, n_points), bool)
    seen[:, entry] = True
    active = np.arange(n_queries)
    while len(active):
        open_at = np.argmin(done[active], axis=1)
        done[active, open_at] = True
        near = edges[found[active, open_at]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        rows, columns = np.nonzero(fresh)
        targets = near[rows, columns]
        seen[active[rows], targets] = True
        new = np.full(near.shape, -np.inf)
        new[rows, columns] = np.einsum("ij,ij->i", vectors[targets], queries[active[rows]])
        all_products = np.concatenate([products[active], new], axis=1)
        order = np.argsort(-all_products, axis=1, kind="stable")[:, :beam]
        products[active] = np.take_along_axis(all_products, order, 1)
        found[active] = np.take_along_axis(np.concatenate([found[active], near], axis=1), order, 1)
        expanded = np.concatenate([done[active], ~fresh], axis=1)
        done[active] = np.take_along_axis(expanded, order, 1)
        active = active[~done[active].all(axis=1)]
    return np.where(np.isneginf(products), -1, found)


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point ``of`` from its row of candidates (-1: none).

    The closest candidate is kept, and those go that are ``relax`` times closer to it
    than to the point; then the closest of the rest, and so on.
    """
    own = points[of]
    rows = np.arange(len(of))
    chosen = points[candidates]  # -1 reads the last point, masked below
    squares = (chosen**2).sum(axis=2)
    distance = squares - 2 * np.einsum("qcd,qd->qc", chosen, own) + (own**2).sum(axis=1)[:, None]
    order = np.argsort(candidates, axis=1, kind="stable")
    ordered = np.take_along_axis(candidates, order, 1)
    again = np.zeros(candidates.shape, bool)
    np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
    distance[(candidates < 0) | (candidates == of[:, None]) | again] = np.inf
    between = squares[:, :, None] + squares[:, None, :] - 2 * chosen @ chosen.transpose(0, 2, 1)
    kept = np.full((len(of), degree), -1)
    limit = distance / relax**2  # distances are squared
    for k in range(degree):
        best = np.argmin(distance, axis=1)
        alive = np.isfinite(distance[rows, best])
        if not alive.any():
            break
        kept[alive, k] = candidates[alive, best[alive]]
        gone = between[rows, best] <= limit
        gone[rows, best] = True
        distance[gone] = np.inf
    return kept


def build_graph(vectors: np.ndarray, degree: int, beam: int, relax: float, seed: int = 3) -> Graph:
    """Insert the directions in random order, growing batches at a time, and link both ways."""
    points = directions(vectors)
    n = len(points)
    entry = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    graph = Graph(points, np.full((n, degree), -1), entry)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        batch = order[at : at + max(1, min(INSERTED_AT_ONCE, at // 2))]
        at += len(batch)
        found = beam_search(graph, points[batch], beam)
        # points of one batch don't find each other, so a few of them are proposed as well
        found = np.column_stack([found, batch[np.argsort(_squared(points[batch]), axis=1)[:, 1:9]]])
        edges = robust_prune(points, batch, found, degree, relax)
        graph.edges[batch] = edges
        sources, targets = np.repeat(batch, degree), edges.ravel()
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        _link_back(graph, sources, targets, degree, relax)
    return graph


def _squared(points: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(axis=1)
    return squares[:, None] + squares - 2 * points @ points.T


def _link_back(graph: Graph, sources: np.ndarray, targets: np.ndarray, degree: int, relax: float) -> None:
    """Add an edge from each target to its source; prune where there are too many."""
    by_target = np.argsort(targets, kind="stable")
    sources, targets = sources[by_target], targets[by_target]
    points, starts, counts = np.unique(targets, return_index=True, return_counts=True)
    for low in range(0, len(points), INSERTED_AT_ONCE):
        some = slice(low, low + INSERTED_AT_ONCE)
        width = counts[some].max()
        place = starts[some][:, None] + np.arange(width)
        new = np.where(np.arange(width) < counts[some][:, None], sources[np.minimum(place, len(sources) - 1)], -1)
        joined = np.column_stack([graph.edges[points[some]], new])
        known = (graph.edges[points[some]][:, None, :] == new[:, :, None]).any(axis=2)
        joined[:, degree:][known] = -1
        full = (joined >= 0).sum(axis=1) > degree
        packed = np.take_along_axis(joined, np.argsort(joined < 0, axis=1, kind="stable"), 1)
        graph.edges[points[some]] = packed[:, :degree]
        for part in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) * width // 8192)):
            if len(part):
                graph.edges[points[some][part]] = robust_prune(graph.points, points[some][part], packed[part], degree, relax)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    vector = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    rows = embeddings.select(F.col("vec_id").cast("bigint"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _smallest_ids(embeddings: DataFrame, n: int) -> DataFrame:
    """vec_id, vector: the n smallest ids of each vector; repeated rows go before a window gathers them."""
    rows = _usable(embeddings).dropDuplicates(["vec_id", "vector"])
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= n)


#: Bands of length: so far apart are the lengths in one, about, and so many there are at most.
BAND_RATIO, MOST_BANDS = 1.25, 8
QUERIES_AT_ONCE = 256


def shard_size_for(n: int) -> int:
    """Vectors per shard for n in all: few shards make few searches, and a graph has to fit a task."""
    return int(np.clip(32 * n**0.5, 8192, 65536))


def _sharded(classes: DataFrame, n: int, shard_size: int) -> tuple[DataFrame, int]:
    """``classes`` with a shard for each vector, and the number of shards.

    Lengths are cut at their quantiles into as many bands as their spread asks for, and a
    band by a hash of the vector into shards of about the same size.
    """
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    sized = classes.withColumn("length", length)
    spread = sized.agg(F.percentile_approx("length", [0.01, 0.99], 1000).alias("at")).first()["at"]
    low, high = max(spread[0], 1e-300), max(min(spread[1], 1e300), 1e-300)
    n_bands = int(np.clip(np.ceil(np.log(high / low) / np.log(BAND_RATIO)), 1, MOST_BANDS))
    cuts = [k / n_bands for k in range(1, n_bands)]
    bounds = sized.agg(F.percentile_approx("length", cuts, 1000).alias("at")).first()["at"] if cuts else []
    band = sum(((F.col("length") > bound).cast("int") for bound in bounds), F.lit(0))
    banded = sized.withColumn("band", band).drop("length")
    counts = {r["band"]: r["n"] for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    shard, first = F.lit(None).cast("bigint"), 0
    for of_band, size in sorted(counts.items()):
        pieces = -(-size // shard_size)
        shard = F.when(F.col("band") == of_band, first + F.pmod(F.xxhash64("vector"), F.lit(pieces))).otherwise(shard)
        first += pieces
    return banded.withColumn("shard", shard).drop("band"), first


def nearest(
    embeddings: DataFrame,
    queries: DataFrame,
    k: int = 20,
    shard_size: int | None = None,
    degree: int = 32,
    build_beam: int = 48,
    beam: int = 100,
    relax: float = 1.2,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found for each query.

    ``embeddings`` and ``queries`` have vec_id and embedding; other columns are
    ignored. Nearness is the inner product in double precision, the largest first, ties
    by the smaller vec_id; a query's own row is no candidate. Rows without vec_id and
    vectors that are missing, empty, zero or hold a missing or non-finite component
    take no part; repeated rows count once. Vectors are compared with those of their
    dimension only. Fewer candidates than ``k`` are all returned; no queries give no rows.

    Every vector is indexed, equal ones once with their k + 1 smallest ids (no larger
    one can be among k answers, as ties go to the smaller id). Shards have ``shard_size``
    vectors in expectation, by default as ``shard_size_for`` finds fit.
    """
    spark = embeddings.sparkSession
    classes = _smallest_ids(embeddings, k + 1).groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = materialize(classes, "vector-classes")
    asked = materialize(_usable(queries).dropDuplicates(["vec_id", "vector"]), "queries")
    # the shards of each dimension; there is one as a rule
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    asked_sizes = {r["d"]: r["n"] for r in asked.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    answers = None
    for d in sorted(sizes.keys() & asked_sizes.keys()):
        sharded, n_shards = _sharded(classes.where(F.size("vector") == d), sizes[d], shard_size or shard_size_for(sizes[d]))
        graphs = index(sharded, n_shards, degree, build_beam, relax)
        n_blocks = -(-asked_sizes[d] // QUERIES_AT_ONCE)
        found = search(graphs, n_shards, asked.where(F.size("vector") == d), n_blocks, k, beam)
        answers = found if answers is None else answers.union(found)
    if answers is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def index(sharded: DataFrame, n_shards: int, degree: int, build_beam: int, relax: float) -> DataFrame:
    """The graph of each shard, a row each, written to the shared folder."""

    def build(shard: pa.Table) -> pa.Table:
        vectors = _matrix(shard["vector"])
        graph = build_graph(vectors, degree, build_beam, relax)
        return pa.table({
            "shard": shard["shard"].slice(0, 1),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "edges": pa.array([graph.edges.astype(np.int32).tobytes()], pa.binary()),
            "entry": pa.array([graph.entry], pa.int32()),
            "ids": pa.array([shard["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))),
        })

    schema = "shard bigint, vectors binary, edges binary, entry int, ids array<array<bigint>>"
    # by ranges, as a hash would bring some shards together in a task
    dealt = sharded.repartitionByRange(n_shards, "shard")
    return materialize(dealt.groupBy("shard").applyInArrow(build, schema), "graphs")


def search(graphs: DataFrame, n_shards: int, asked: DataFrame, n_blocks: int, k: int, beam: int) -> DataFrame:
    """query_id, vec_id, score: the best ``k`` of each shard for each query.

    Queries travel in blocks to every shard, a graph to one task, which reads the blocks
    after it one by one.
    """

    def pack(block: pa.Table) -> pa.Table:
        return pa.table({
            "query_ids": pa.array([block["vec_id"].to_pylist()], pa.list_(pa.int64())),
            "vectors": pa.array([_matrix(block["vector"]).tobytes()], pa.binary()),
        })

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, vectors, ids = None, None, []
        types = (pa.int64(), pa.int64(), pa.float64())
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch[name][at].as_py() for name in ("query_ids", "vectors")}
                if row["query_ids"] is None:
                    ids, edges = batch["ids"][at].as_py(), np.frombuffer(batch["edges"][at].as_py(), np.int32)
                    vectors = np.frombuffer(row["vectors"]).reshape(len(ids), -1)
                    graph = Graph(directions(vectors), edges.reshape(len(ids), -1), batch["entry"][at].as_py())
                    continue
                queries = np.frombuffer(row["vectors"]).reshape(len(row["query_ids"]), -1)
                found = beam_search(graph, queries, max(beam, k + 1), vectors)
                out: list[tuple[int, int, float]] = []
                for query_id, query, near in zip(row["query_ids"], queries, found):
                    near = near[near >= 0]
                    scores = (vectors[near] * query).sum(axis=1)
                    best = [(-s, i) for s, p in zip(scores.tolist(), near.tolist()) for i in ids[p] if i != query_id]
                    out += [(query_id, i, -s) for s, i in sorted(best)[:k]]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query_id", "vec_id", "score"])

    blocked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    blocks = materialize(blocked.groupBy("block").applyInArrow(pack, "query_ids array<bigint>, vectors binary"), "query-blocks")
    shards = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_shards - 1).cast("bigint")))
    both = graphs.unionByName(blocks.withColumn("shard", shards), allowMissingColumns=True)
    dealt = both.repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", F.col("query_ids").isNotNull())
    return dealt.mapInArrow(answer, "query_id bigint, vec_id bigint, score double")
