"""Shards by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards; a shard's weight counts for its rack and region. A row
draws one hash per child at each level, -ln(uniform) / weight, and goes down to the smallest. If a
weight changes, draws of other children stay as they are, so rows move only into a child that
gained or out of one that lost, and only within the subtrees on its path. Places for shards to come
have names and weights from the start; filling one moves rows into it alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, let, ranked, uniform


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    filled: bool = True  # a place that is not filled is kept for a shard to come


def planned(shards: int, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """``shards`` equal shards in whole regions; the last region's places may be kept free.

    Every node has the same name and weight for any number of shards, so that a shard that is
    added only fills its place.
    """
    per_region = racks * per_rack
    places = -(-shards // per_region) * per_region
    return [Leaf(s // per_region, s % per_region // per_rack, s, filled=s < shards)
            for s in range(places)]


def _smallest(draws: list[Column], nodes: list[int]) -> Column:
    """The node of the smallest draw; ties go to the first."""
    if len(draws) == 1:
        return F.lit(nodes[0])
    return F.array_min(F.array(*[
        F.struct(d.alias("draw"), F.lit(i).alias("place"), F.lit(node).alias("value"))
        for i, (d, node) in enumerate(zip(draws, nodes))]))["value"]


def shard_of(key: Column, tree: list[Leaf], seed: int = 42) -> Column:
    """The shard of ``key``. Each level draws anew; only the rack and region chosen are descended.

    In a region with places to be filled every leaf has its own time: a node's time goes on to the
    child of the smallest draw, and any other child comes later by a draw of its own weight. As
    exponential times forget, these are the times of independent leaves, whichever are filled; the
    first filled one stands for the region, and filling a place moves rows into it alone.

    A null key is a key like any other. Weights must be positive.
    """
    if not any(leaf.filled for leaf in tree) or any(leaf.weight <= 0 for leaf in tree):
        raise ValueError("a tree needs shards, all of a positive weight")
    levels = ["region", "rack", "shard"]

    def draw(kind: str, node: int, weight: float) -> Column:
        return -F.ln(uniform(F.lit(f"{seed}/{kind}/{node}"), key)) / F.lit(float(weight))

    def children(leaves: list[Leaf], level: str) -> dict[int, list[Leaf]]:
        groups: dict[int, list[Leaf]] = {}
        for leaf in leaves:
            groups.setdefault(getattr(leaf, level), []).append(leaf)
        return groups

    def drawn(groups: dict[int, list[Leaf]], path: str, level: str) -> list[Column]:
        return [draw(f"{path}/{level}", node, sum(x.weight for x in same))
                for node, same in groups.items()]

    def within(leaves: list[Leaf], depth: int, path: str) -> Column:
        """The shard below a node all of whose places are filled."""
        if depth == len(levels):
            return F.lit(leaves[0].shard)
        groups = children(leaves, levels[depth])
        chosen = _smallest(drawn(groups, path, levels[depth]), list(groups))
        # `switch` evaluates only the branch of the chosen child.
        return _switch(chosen, {node: within(same, depth + 1, f"{path}/{node}")
                                for node, same in groups.items()})

    def times(leaves: list[Leaf], depth: int, path: str, time: Column) -> Column:
        """(time, shard) of the first filled leaf below a node of ``time``."""
        if depth == len(levels):
            return F.struct(time.alias("time"), F.lit(leaves[0].shard).alias("shard"))
        level = levels[depth]
        groups = children(leaves, level)

        def below(own: Column, chosen: Column) -> Column:
            found = []
            for node, same in groups.items():
                if any(leaf.filled for leaf in same):
                    later = draw(f"{path}/later/{level}", node, sum(x.weight for x in same))
                    at = own + F.when(chosen == node, F.lit(0.0)).otherwise(later)
                    found.append(times(same, depth + 1, f"{path}/{node}", at))
            return F.array_min(F.array(*found))

        chosen = _smallest(drawn(groups, path, level), list(groups))
        return let(F.struct(time.alias("time"), chosen.alias("chosen")),
                   lambda at: below(at["time"], at["chosen"]))

    regions = children(tree, "region")
    regions = {node: same for node, same in regions.items() if any(x.filled for x in same)}
    firsts = []
    for node, same in regions.items():
        time = draw("/region", node, sum(x.weight for x in same))
        first = (F.struct(time.alias("time"), F.lit(None).cast("int").alias("shard"))
                 if all(x.filled for x in same) else times(same, 1, f"/{node}", time))
        firsts.append(F.struct(first["time"].alias("time"), F.lit(len(firsts)).alias("place"),
                               F.lit(node).alias("node"), first["shard"].alias("shard")))

    def descended(first: Column) -> Column:
        return _switch(first["node"], {
            node: (within(same, 1, f"/{node}") if all(x.filled for x in same) else first["shard"])
            for node, same in regions.items()})

    return let(F.array_min(F.array(*firsts)), descended)


def _switch(choice: Column, branches: dict[int, Column]) -> Column:
    """The branch of ``choice``, which is computed once."""
    def pick(value: Column) -> Column:
        picked = None
        for node, branch in branches.items():
            test = value == node
            picked = F.when(test, branch) if picked is None else picked.when(test, branch)
        return picked

    return let(choice, pick)


def sharded(docs: DataFrame, shards: int = 16, identity: str = "doc_id", text: str = "text",
            seed: int = 42) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row per row of ``docs``.

    The id and the number of shards decide (law ``key``); ``grown_shard`` is the shard with one
    more, which takes rows only into itself, for any number. ``slot`` numbers a shard's rows from
    0 by a hash of their ids. Rows that share an id share a shard and have slots of their own; a
    null id is an id; a null text has size 1 and the crc32 of no bytes.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = checkpointed(docs.select(
        F.col(identity).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        shard_of(F.col(identity), planned(shards), seed).alias("shard"),
        shard_of(F.col(identity), planned(shards + 1), seed).alias("grown_shard")))
    return ranked(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"),
        "slot", F.col("grown_shard").cast("int"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, identity: str = "doc_id",
                 seed: int = 42) -> None:
    """Write ``docs`` as Parquet folders ``shard=<n>`` below ``path``."""
    name, = fresh(docs.columns, "shard")
    (docs.withColumn(name, shard_of(F.col(identity), planned(shards), seed))
     .write.partitionBy(name).parquet(path))
