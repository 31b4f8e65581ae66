"""Embedding near-dedup by dual traversal of a cover tree.

Within a label, vectors of length one are put into a tree whose levels have halving radii: a node
with more than ``LEAF`` vectors gets children around centres that lie further apart than the
level's radius, and every vector goes to the nearest centre of its node. What a node truly covers,
the largest distance of its vectors to its centre, is measured. Pairs of nodes are then descended
together, level by level: a pair is dropped when the centres are further apart than both covering
radii and the threshold distance. What remains are pairs of leaves, compared cell by cell with the
same bound and at last vector by vector, so exactly the pairs at the threshold are found.

Equal vectors are one class and are not compared. Links are counted, and passed on as a spanning
forest of each pair of leaves, never listed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann_graph import valid
from .common import checkpointed, let
from .components import components

THRESHOLD = 0.98
LEAF = 4096  # classes of a leaf
FANOUT = 32  # children of a node
SAMPLE = 256  # vectors of a node among which centres are looked for
DEALT = 20_000  # vectors of a node that one group assigns
DEPTH = 24  # levels; a node that is still too large then is cut by a hash
BLOCK = 512  # rows compared at once
SLACK = 1e-9


def _matrix(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=float) for v in column])
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def net(x: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, float]:
    """Rows of ``x`` that are further apart than ``radius``, or than the first of its halves at
    which there are two; at most ``most``."""
    while radius > 1e-7:
        near = np.full(len(x), np.inf)
        chosen = []
        while len(chosen) < most:
            at = int(np.argmax(near))
            if near[at] <= radius:
                break
            chosen.append(at)
            near = np.minimum(near, np.sqrt(np.maximum(0, 2 - 2 * x @ x[at])))
        if len(chosen) > 1:
            return np.array(chosen), radius
        radius /= 2
    return np.array([0]), 0.0


def _centres(frame: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(frame["vector"])
    size = int(frame["size"].iloc[0])
    rows, radius = net(x, float(frame["radius"].iloc[0]) / 2,
                       min(FANOUT, max(2, math.ceil(2 * size / LEAF))))
    return pd.DataFrame({"node": frame["node"].iloc[:1].tolist(), "size": [size],
                         "radius": [radius], "centres": [x[rows].ravel().tolist()]})


def _assigned(vectors: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(vectors["vector"]) if len(vectors) else np.zeros((0, 1))
    if not len(vectors):
        return pd.DataFrame({"node": [], "child": [], "id": [], "radius": []})
    c = np.array(centres["centres"].iloc[0]).reshape(-1, x.shape[1])
    best = np.argmax(x @ c.T, axis=1)
    return pd.DataFrame({"node": vectors["node"], "id": vectors["id"], "child": best,
                         "radius": centres["radius"].iloc[0]})


def _cells(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Cells of a leaf one level down: their rows, centres and covering radii."""
    rows, _ = net(x, 0.5, 16)
    owner = np.argmax(x @ x[rows].T, axis=1)
    members = [np.flatnonzero(owner == i) for i in range(len(rows))]
    radii = np.array([np.sqrt(max(0, 2 - 2 * (x[m] @ x[c]).min())) for m, c in zip(members, rows)])
    return members, x[rows], radii


def _hooked(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The forest ``parent`` with the trees of each ``i`` and ``j`` joined, flat."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _compared(threshold: float):
    bound = math.sqrt(2 - 2 * threshold)

    def run(both: pd.DataFrame) -> pd.DataFrame:
        """Links between the classes of two leaves, or within one if there is one side only."""
        left, right = both[both["side"] == 0], both[both["side"] == 1]
        alone = not len(right)
        x, n = _matrix(left["vector"]), left["copies"].to_numpy()
        y, m = (x, n) if alone else (_matrix(right["vector"]), right["copies"].to_numpy())
        shift = 0 if alone else len(x)
        parent = np.arange(shift + len(y))
        counts = np.zeros(shift + len(y), np.int64)
        cells, centre, radius = _cells(x)
        others, far, reach = (cells, centre, radius) if alone else _cells(y)
        gap = np.sqrt(np.maximum(0, 2 - 2 * centre @ far.T))
        for a, rows in enumerate(cells):
            close = np.flatnonzero(gap[a] <= radius[a] + reach + bound + 1e-6)
            if not len(close):
                continue
            columns = np.sort(np.concatenate([others[b] for b in close]))
            for at in range(0, len(rows), BLOCK):
                some = rows[at:at + BLOCK]
                linked = x[some] @ y[columns].T
                unsure = np.argwhere(np.abs(linked - threshold) < SLACK)
                linked = linked >= threshold
                for i, j in unsure:  # settled by the plain formula on the given numbers
                    u = np.asarray(left["vector"].iloc[some[i]], dtype=float)
                    v = np.asarray((left if alone else right)["vector"].iloc[columns[j]], dtype=float)
                    linked[i, j] = u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= threshold
                if alone:
                    linked &= columns[None, :] != some[:, None]
                counts[some] += linked @ m[columns]
                if not alone:
                    counts[shift + columns] += n[some] @ linked
                i, j = np.nonzero(linked)
                parent = _hooked(parent, some[i], shift + columns[j])
        ids = left["id"].to_numpy() if alone else np.concatenate(
            [left["id"].to_numpy(), right["id"].to_numpy()])
        hit = counts > 0
        return pd.DataFrame({"id": ids[hit], "links": counts[hit], "root": ids[parent[hit]]})

    return run


def _gap(a: str, b: str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _lowest(rows: DataFrame, group: list[str], seed: int) -> DataFrame:
    """The ``SAMPLE`` rows of each group that are first by a hash."""
    draw = Window.partitionBy(*group).orderBy(F.xxhash64("id", F.lit(seed)), "id")
    return rows.withColumn("draw", F.row_number().over(draw)).filter(F.col("draw") <= SAMPLE)


def _tree(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, node): the leaf of every class; and per level (parent, node, centre, cover), where a
    node that isn't divided has itself as its only child."""
    state = classes.select("id", "vector", F.xxhash64("label", F.size("vector")).alias("node"),
                           F.lit(2.0).alias("radius"))
    done: list[DataFrame] = []
    levels: list[DataFrame] = []
    for depth in range(DEPTH):
        sizes = checkpointed(state.groupBy("node").agg(
            F.count(F.lit(1)).alias("size"), F.first("radius").alias("radius")))
        large = sizes.filter((F.col("size") > LEAF) & (F.col("radius") > 0))
        if large.isEmpty():
            break
        inner = state.drop("radius").join(large, "node")
        salts = F.ceil(F.col("size") / F.lit(DEALT)).cast("long")
        inner = inner.withColumn("salt", F.pmod(F.xxhash64("id"), salts)).repartition("node", "salt")
        centres = checkpointed(
            _lowest(_lowest(inner, ["node", "salt"], depth), ["node"], depth)
            .groupBy("node").applyInPandas(
                _centres, "node long, size long, radius double, centres array<double>"))
        dealt = inner.select("node", "id", "vector", "salt")
        spread = centres.withColumn(
            "salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        moved = (
            dealt.groupBy("node", "salt").cogroup(spread.groupBy("node", "salt"))
            .applyInPandas(_assigned, "node long, id long, child int, radius double")
            .select("id", F.col("node").alias("parent"), "radius",
                    F.xxhash64("node", "child", F.lit(depth)).alias("node"))
        )
        rest = state.join(large.select("node"), "node", "left_anti")
        state = checkpointed(
            moved.join(classes.select("id", "vector"), "id")
            .select("id", "vector", "node", "radius", "parent")
            .unionByName(rest.select("id", "vector", "node", "radius",
                                     F.col("node").alias("parent"))))
        levels.append(_covers(state))
        state = state.drop("parent")
    # Nodes whose vectors lie too close to be divided are cut by a hash; centre and cover hold.
    sizes = state.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.col("size") / F.lit(LEAF))
    state = checkpointed(state.join(sizes, "node").select(
        "id", "vector", F.col("node").alias("parent"),
        F.xxhash64("node", F.pmod(F.xxhash64("id", F.lit("leaf")), parts)).alias("node")))
    levels.append(_covers(state))
    return state.select("id", "node"), levels


def _unit(vector: Column) -> Column:
    def divided(v: Column, by: Column) -> Column:
        return let(by, lambda b: F.transform(v, lambda x: x / b))

    largest = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    return let(divided(vector, largest), lambda v: divided(
        v, F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))))


def _covers(state: DataFrame) -> DataFrame:
    """(parent, node, centre, cover): the vector of the smallest id as a centre of each node, and
    how far its vectors are from it."""
    centre = state.groupBy("parent", "node").agg(F.min_by("vector", "id").alias("centre"))
    return checkpointed(
        state.join(centre, ["parent", "node"])
        .select("parent", "node", _unit(F.col("centre")).alias("centre"),
                _unit(F.col("vector")).alias("vector"))
        .groupBy("parent", "node").agg(F.first("centre").alias("centre"),
                                       F.max(_gap("centre", "vector")).alias("cover")))


def linked(vectors: DataFrame, threshold: float = THRESHOLD, identity: str = "vec_id",
           vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``vectors``.

    Vectors are linked when their labels are equal and not null, their lengths agree and their
    cosine in double precision is at least ``threshold``. Vectors that are null, empty, zero or
    hold null or non-finite components have no links and are their own component. Repeated rows
    are vectors of their own that share an id; a null id takes part, and component_id is the
    smallest id that is not null. An empty table gives no rows.
    """
    all_rows = vectors.select(F.col(identity).alias("vec_id"), F.col(label).alias("label"),
                              F.col(vector).cast("array<double>").alias("vector"))
    fit = valid(F.col("vector")) & F.col("label").isNotNull()
    rows = checkpointed(all_rows.withColumn("fit", fit))
    classes = checkpointed(
        rows.filter("fit").groupBy("label", "vector")
        .agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
        .withColumn("id", F.monotonically_increasing_id()))  # settled by the checkpoint
    leaves, levels = _tree(classes)
    reach = F.lit(math.sqrt(2 - 2 * threshold) + 1e-6)
    root = levels[0].select("parent").distinct()
    pairs = root.select(F.col("parent").alias("a"), F.col("parent").alias("b"))
    for level in levels:
        left = level.toDF("a", "a_node", "a_centre", "a_cover")
        right = level.toDF("b", "b_node", "b_centre", "b_cover")
        near = _gap("a_centre", "b_centre") <= F.col("a_cover") + F.col("b_cover") + reach
        # Children of the same node are paired once.
        once = (F.col("a") != F.col("b")) | (F.col("a_node") <= F.col("b_node"))
        pairs = checkpointed(
            pairs.join(left, "a").join(right, "b").filter(once & near)
            .select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    points = classes.select("id", "vector", "copies").join(leaves, "id")
    tasks = max(2, pairs.count())
    sides = pairs.select("a", "b", F.col("a").alias("node"), F.lit(0).alias("side")).unionByName(
        pairs.filter("a != b").select("a", "b", F.col("b").alias("node"), F.lit(1).alias("side")))
    found = checkpointed(
        sides.join(points, "node").repartition(min(tasks, 10_000), "a", "b").groupBy("a", "b")
        .applyInPandas(_compared(threshold), "id long, links long, root long"))
    grouped = components(found.filter("id != root").select(
        F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = (
        classes.join(counts, "id", "left")
        .join(grouped.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    lowest = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    named = joined.join(lowest, "component").select(
        "label", "vector", "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    inside = rows.filter("fit").join(named, ["label", "vector"]).select(
        "vec_id", "n_links", "component_id")
    outside = rows.filter(~F.col("fit")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(outside).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
