"""Approximate nearest neighbours by a robust-pruned directed graph.

Equal vectors are one point, which holds its smallest ids. The points are dealt into shards by a
hash, each of about ``SHARD`` points, and every shard gets a graph of its own. Points enter in batches that double: each searches the graph so far, greedily
and with a beam, and takes the visited points as candidates. Relaxed pruning keeps the nearest
candidate, drops those that it is closer to (by the factor ``ALPHA``) than the point itself, and
goes on, so that few and diverse edges remain. Edges are added in both directions and a list that
overflows is pruned again. A query searches every shard's graph with a beam; the nearest found are
measured anew in double precision, expanded by their ids and merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SHARD = 4096  # points of a shard, on average
NEIGHBOURS = 10  # that an index is made for
DEGREE = 32
BUILD_BEAM = 48
QUERY_BEAM = 128
ALPHA = 1.2
QUERY_BLOCK = 4096  # queries that search a shard in one group
LOCKSTEP = 512  # searches that advance together
SEEDS = 8  # entry points of a shard's graph
FARTHEST = 1e100  # from the centre, in units of the scale


def _distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances, less the query's own norm, of each query to its row of ``ids``."""
    return norms[ids] - 2 * np.einsum("qd,qkd->qk", q, x[ids])


def search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, entries: np.ndarray,
           queries: np.ndarray, beam: int, visits: bool = False) -> tuple[np.ndarray, ...]:
    """Beam search of all ``queries`` in step. Returns the beams' points and distances, nearest
    first, -1 and infinity where a beam isn't full; with ``visits`` also the points expanded.

    ``graph`` holds a row of out-neighbours per point, -1 where there are fewer.
    """
    m, n = len(queries), len(x)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # what -1 stands for
    start = np.broadcast_to(entries, (m, len(entries)))
    seen[:, entries] = True
    width = max(beam, len(entries))
    ids = np.full((m, width), -1, np.int64)
    near = np.full((m, width), np.inf)
    near[:, :len(entries)] = _distances(x, norms, queries, start)
    ids[:, :len(entries)] = start
    order = np.argsort(near, axis=1)
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    done = ids < 0
    path: list[np.ndarray] = []
    live = np.arange(m)
    while len(live):
        first = np.argmin(done[live], axis=1)
        going = ~done[live, first]
        live, first = live[going], first[going]
        if not len(live):
            break
        here = ids[live, first]
        done[live, first] = True
        if visits:
            step = np.full(m, -1, np.int64)
            step[live] = here
            path.append(step)
        nexts = graph[here]
        new = ~seen[live[:, None], nexts]
        nexts = np.where(new, nexts, -1)
        seen[live[:, None], nexts] = True
        far = np.where(new, _distances(x, norms, queries[live], nexts), np.inf)
        all_near = np.concatenate([near[live], far], axis=1)
        keep = np.argpartition(all_near, width - 1, axis=1)[:, :width]
        best = np.take_along_axis(all_near, keep, 1)
        order = np.argsort(best, axis=1, kind="stable")
        keep = np.take_along_axis(keep, order, 1)
        near[live] = np.take_along_axis(all_near, keep, 1)
        all_ids = np.concatenate([ids[live], nexts], axis=1)
        all_done = np.concatenate([done[live], ~new], axis=1)
        ids[live] = np.take_along_axis(all_ids, keep, 1)
        done[live] = np.take_along_axis(all_done, keep, 1) | np.isinf(near[live])
    visited = np.stack(path, axis=1) if path else np.full((m, 0), -1, np.int64)
    return ids, near, visited


def prune(x: np.ndarray, norms: np.ndarray, points: np.ndarray, candidates: np.ndarray,
          degree: int, alpha: float) -> np.ndarray:
    """Relaxed pruning for all ``points`` in step: rows of at most ``degree`` kept candidates."""
    own = points[:, None]
    gap = norms[own] + _distances(x, norms, x[points], candidates)
    gap[(candidates < 0) | (candidates == own)] = np.inf
    width = min(candidates.shape[1], 6 * degree)
    near = np.argpartition(gap, width - 1, axis=1)[:, :width]
    candidates, gap = np.take_along_axis(candidates, near, 1), np.take_along_axis(gap, near, 1)
    vectors = x[candidates]
    kept = np.full((len(points), degree), -1, np.int64)
    rows, factor = np.arange(len(points)), alpha * alpha
    left = np.maximum(gap, 0)
    for slot in range(degree):
        pick = np.argmin(left, axis=1)
        alive = np.isfinite(left[rows, pick])
        if not alive.any():
            break
        chosen = candidates[rows, pick]
        kept[alive, slot] = chosen[alive]
        between = (norms[chosen][:, None] + norms[candidates]
                   - 2 * np.einsum("pd,pkd->pk", x[chosen], vectors))
        left[factor * between <= gap] = np.inf
        left[candidates == chosen[:, None]] = np.inf
    return kept


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA
          ) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) of the rows of ``x``, in whose order they enter."""
    n = len(x)
    norms = np.einsum("nd,nd->n", x, x)
    graph = np.full((n + 1, degree), -1, np.int64)
    spread = [int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
    far = np.full(n, np.inf)
    for _ in range(min(SEEDS, n) - 1):  # entry points far from one another
        far = np.minimum(far, norms + norms[spread[-1]] - 2 * x @ x[spread[-1]])
        spread.append(int(np.argmax(far)))
    entries = np.unique(spread)
    graph[entries, :min(degree, len(entries))] = entries[:degree]
    order = np.concatenate([entries, np.setdiff1d(np.arange(n), entries)])
    begin = len(entries)
    while begin < n:
        size = max(1, min(begin, LOCKSTEP, n - begin))
        batch = order[begin:begin + size]
        ids, _, visited = search(x, norms, graph, entries, x[batch], beam, visits=True)
        mates = np.broadcast_to(batch, (size, size)) if size <= degree else \
            batch[(np.arange(size)[:, None] + np.arange(1, degree + 1)) % size]
        graph[batch] = prune(x, norms, batch, np.concatenate([ids, visited, mates], axis=1),
                             degree, alpha)
        _reverse(x, norms, graph, batch, degree, alpha)
        begin += size
    return graph, entries


def _reverse(x, norms, graph, batch, degree, alpha) -> None:
    """Add the edges back from the neighbours of ``batch``; overfull lists are pruned."""
    ends = graph[batch]
    source = np.repeat(batch, degree)[ends.ravel() >= 0]
    target = ends.ravel()[ends.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    points, first, counts = np.unique(target, return_index=True, return_counts=True)
    incoming = np.full((len(points), counts.max(initial=1)), -1, np.int64)
    at = np.arange(len(target)) - np.repeat(first, counts)
    incoming[np.repeat(np.arange(len(points)), counts), at] = source
    merged = np.concatenate([graph[points], incoming], axis=1)
    # Repeated neighbours count once.
    merged = -np.sort(-merged, axis=1)
    merged[:, 1:][merged[:, 1:] == merged[:, :-1]] = -1
    merged = -np.sort(-merged, axis=1)
    over = (merged >= 0).sum(axis=1) > degree
    graph[points[~over]] = np.pad(merged[~over], ((0, 0), (0, max(0, degree - merged.shape[1]))),
                                  constant_values=-1)[:, :degree]
    for at in range(0, int(over.sum()), LOCKSTEP):
        some = np.flatnonzero(over)[at:at + LOCKSTEP]
        graph[points[some]] = prune(x, norms, points[some], merged[some], degree, alpha)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _frame(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and scale of a shard's points by medians, so that a common offset takes no digits and
    a few far points leave the others as they are."""
    centre = np.median(x, axis=0)
    with np.errstate(over="ignore"):
        sizes = np.abs(x - centre).max(axis=1)
    scale = np.median(sizes)
    if not scale > 0:
        scale = sizes[sizes > 0].min(initial=np.inf)
    return centre, float(scale) if np.isfinite(scale) else 1.0


def _scaled(x: np.ndarray, frame: tuple[np.ndarray, float]) -> np.ndarray:
    """``x`` about the centre, within a range whose squares are finite; only proposals are made
    from it."""
    centre, scale = frame
    with np.errstate(over="ignore"):
        return np.clip((x - centre) / scale, -FARTHEST, FARTHEST)


def valid(vector: Column) -> Column:
    """Not null or empty, every component finite, not all zero."""
    limit = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _built(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("vec_id", kind="stable")
    frame = frame.iloc[np.random.default_rng(7).permutation(len(frame))]
    x = _matrix(frame["vector"])
    graph, entries = build(_scaled(x, _frame(x)))
    return frame.assign(node=np.arange(len(x)), entry=np.isin(np.arange(len(x)), entries),
                        edges=[row[row >= 0] for row in graph[:-1]])


def index(vectors: DataFrame, identity: str = "vec_id", vector: str = "embedding",
          shard: int = SHARD, k: int = NEIGHBOURS) -> DataFrame:
    """(part, vec_id, vector, ids, most, node, entry, edges): every point in its shard's graph, for
    searches of up to ``k`` = ``most`` neighbours.

    Equal vectors are one point. ``ids`` holds its ``k`` + 1 smallest ids in order, one of which
    may be the query's own, each as often as it has rows, but at most ``k`` times; ``vec_id`` is
    the smallest. Vectors of another length are in graphs of their own. Rows without a valid
    vector or an id are left out. A vector's ids are cut in each task before they are shuffled.
    """
    counted = (
        vectors.select(F.col(identity).alias("vec_id"),
                       F.col(vector).cast("array<double>").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & valid(F.col("vector")))
        .groupBy("vector", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n")))
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    least = F.array_sort(F.collect_list(F.struct("vec_id", F.col("n").cast("int").alias("n"))))
    points = checkpointed(
        counted.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
        .groupBy("vector").agg(least.alias("least"))
        .select("vector", F.flatten(F.transform("least", lambda r: F.array_repeat(
            r["vec_id"], r["n"]))).alias("ids")))
    parts = max(1, math.ceil(points.count() / shard))
    dealt = points.withColumn("part", F.pmod(F.xxhash64("vector"), F.lit(parts)).cast("int")
                              ).withColumn("length", F.size("vector")).withColumn(
        "vec_id", F.get("ids", F.lit(0))).withColumn("most", F.lit(k))
    return checkpointed(
        dealt.repartition(parts, "part").groupBy("part", "length").applyInPandas(
            _built, "part int, length int, vec_id long, vector array<double>, ids array<long>, "
                    "most int, node int, entry boolean, edges array<int>"))


def _found(k: int, beam: int):
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(asked):
            return empty
        points = points.sort_values("node")
        x = _matrix(points["vector"])
        sizes = points["ids"].map(len).to_numpy()
        ids = np.concatenate(points["ids"].to_list()), np.cumsum(sizes) - sizes, sizes
        scale = _frame(x)
        small = _scaled(x, scale)
        norms = np.einsum("nd,nd->n", small, small)
        graph = np.full((len(x) + 1, DEGREE), -1, np.int64)
        for row, edges in enumerate(points["edges"]):
            graph[row, :len(edges)] = edges
        entries = np.flatnonzero(points["entry"].to_numpy())
        return pd.concat([empty, *_answers(asked, x, ids, small, norms, graph, entries, scale)])

    def _answers(asked, x, ids, small, norms, graph, entries, scale) -> Iterator[pd.DataFrame]:
        for at in range(0, len(asked), LOCKSTEP):
            part = asked.iloc[at:at + LOCKSTEP]
            q, names = _matrix(part["query"]), part["query_id"].to_numpy()
            rows, _, _ = search(small, norms, graph, entries, _scaled(q, scale), beam)
            exact = np.sqrt(((x[rows] - q[:, None]) ** 2).sum(axis=2))
            asker, slot = np.nonzero(rows >= 0)
            point = rows[asker, slot]
            held, first, sizes = ids  # of all points in turn; a point's first one, and how many
            times = sizes[point]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            found = held[np.repeat(first[point], times) + within]
            score, asker = np.repeat(exact[asker, slot], times), np.repeat(asker, times)
            other = found != names[asker]
            found, score, asker = found[other], score[other], asker[other]
            order = np.lexsort((found, score, asker))
            found, score, asker = found[order], score[order], asker[order]
            best = np.arange(len(asker)) - np.searchsorted(asker, asker) < k
            yield pd.DataFrame({"query_id": names[asker[best]], "vec_id": found[best],
                                "score": score[best]})

    return run


def nearest(graph: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, beam: int = QUERY_BEAM
            ) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row of ``queries``
    (query_id, query), by Euclidean distance, ties to the smaller id; never the query's own id.

    Queries are cut into blocks, and a block searches a shard in one group. An id that asks more
    than once asks with its smallest vector. ``graph`` is what :func:`index` returns for ``k``
    or more.
    """
    last, most = graph.agg(F.max("part"), F.min("most")).first()
    if most is not None and most < k:
        raise ValueError(f"the index is made for {most} neighbours, not for {k}")
    asked = checkpointed(
        queries.filter(F.col("query_id").isNotNull() & valid(F.col("query")))
        .groupBy("query_id").agg(F.min("query").alias("query")))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    parts = graph.select("part", "length").distinct().toDF("part", "length")
    keyed = asked.withColumn("length", F.size("query")).withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    tasks = max(1, last or 0) + 1
    keys = ["part", "length", "block"]
    right = keyed.join(parts, "length").repartition(tasks * blocks, *keys)
    left = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
                            ).repartition(tasks * blocks, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _found(k, max(beam, 2 * k)), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
