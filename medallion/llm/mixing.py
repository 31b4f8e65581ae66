"""Mixing sources to target weights by dependent rounding (pivotal method). DataFrame only.

Every document of a source should be taken target / size of the source times. The whole part is
taken at once; the fractions are rounded against each other. Two documents are paired and words
are moved from one to the other, in a random direction whose chances keep both expectations, until
one of them is taken or left. The sum of words of a pair never changes. What is left of the other
is paired with the next document; in groups first, then among the groups' residuals, and so on: a
reduction tree, each level a shuffle of a ``FAN``-th of the rows of the one before. One document
per source is left at the end, so the words of a source miss its target by less than the size of
one document; long documents are paired first, so that it tends to be a short one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, count_words, fresh, uniform

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
FAN = 64  # documents of a group of the tree, on average
SEED = 42


def sizes(docs: DataFrame, identity: str = "doc_id", source: str = "source",
          text: str = "text") -> DataFrame:
    return docs.select(F.col(identity).alias("doc_id"), F.col(source).alias("source"),
                       count_words(F.col(text)).alias("size"))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            cap: float = CAP) -> DataFrame:
    """(source, place, source_size, target), a row per source; null is a source, the last one.

    Sources in order take the weights in turn. They share ``share`` times all words by weight,
    none more than ``cap`` times its own: sources reach that limit in the order of size to
    weight, so one running sum over the sources finds which do, and the rest share what is left.
    The input is one row per source and task, so the sums over all sources are small.
    """
    by_place, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights))
    first_full = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.col("total") - F.coalesce(F.sum("limit").over(first_full), F.lit(0.0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(first_full), F.lit(0.0))
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_place))
        .withColumn("weight", weight)
        .withColumn("limit", F.lit(cap) * F.col("source_size"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("level", left / weight_left)
        .withColumn("full", F.col("level") >= F.col("ratio"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(all_rows))
        .select("source", "place", "source_size",
                F.when(F.col("full"), F.col("limit"))
                .otherwise(F.col("level") * F.col("weight")).alias("target"))
    )


def _paired(state: Column, unit: Column) -> Column:
    """One step: the carried document and the next; decides one, carries the other."""
    carried, a, x = state["carried"], state["size"], state["part"]
    b, y = unit["size"].cast("double"), unit["part"]
    up, down = F.least(a * (1 - x), b * y), F.least(a * x, b * (1 - y))  # words that can move
    to_carried = unit["draw"] * (up + down) < down
    carried_ends = F.when(to_carried, a * (1 - x) <= b * y).otherwise(a * x <= b * (1 - y))
    bit = F.when(carried_ends == to_carried, 1).otherwise(0)
    decided = F.struct(F.when(carried_ends, carried).otherwise(unit["at"]).alias("at"),
                       bit.alias("bit"))
    moved = F.when(to_carried, -up).otherwise(down)  # words that the new document gains
    part = F.when(carried_ends, y + moved / b).otherwise(x - moved / a)
    return F.when(
        carried < 0,
        F.struct(state["done"].alias("done"), unit["at"].alias("carried"), b.alias("size"),
                 y.alias("part")),
    ).otherwise(F.struct(
        F.concat(state["done"], F.array(decided)).alias("done"),
        F.when(carried_ends, unit["at"]).otherwise(carried).alias("carried"),
        F.when(carried_ends, b).otherwise(a).alias("size"),
        F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)).alias("part")))


def _level(units: DataFrame, level: int, seed: int) -> DataFrame:
    """The units of one level with ``bit`` (taken or left; null: carried on) and the new part."""
    key = [F.lit(f"{seed}/{level}"), F.col("doc_id"), F.col("source"), F.col("size")]
    counts = units.groupBy("place").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(FAN)).alias("groups"))
    dealt = (
        units.join(counts, "place")
        .withColumn("hash", F.xxhash64(*key))
        .withColumn("group", F.pmod(F.xxhash64("hash"), F.col("groups")))
        .withColumn("draw", uniform(F.lit("draw"), *key))
        .repartition("place", "group")  # the join may have dealt a hot source to one task
    )
    # Repeated rows share a hash: a group that they overfill is cut by position.
    order = Window.partitionBy("place", "group").orderBy("hash", "doc_id", "size", "part")
    rows = (
        dealt.withColumn("piece", F.floor((F.row_number().over(order) - 1) / F.lit(8 * FAN)))
        .groupBy("place", "group", "piece")
        .agg(F.sort_array(F.collect_list(F.struct(
            (-F.col("size")).alias("first"), "hash", "doc_id", "size", "part", "draw", "source",
            "whole"))).alias("units"))
        .withColumn("units", F.transform("units", lambda u, i: F.struct(
            i.cast("int").alias("at"), u["doc_id"].alias("doc_id"), u["size"].alias("size"),
            u["part"].alias("part"), u["draw"].alias("draw"), u["source"].alias("source"),
            u["whole"].alias("whole"))))
    )
    start = F.struct(
        F.expr("cast(array() AS array<struct<at:int,bit:int>>)").alias("done"),
        F.lit(-1).alias("carried"), F.lit(0.0).alias("size"), F.lit(0.0).alias("part"))
    folded = rows.withColumn("end", F.aggregate("units", start, _paired))
    carry = F.array(F.struct(F.col("end.carried").alias("at"), F.lit(None).cast("int").alias("bit")))
    one = folded.select("place", "units", F.col("end.part").alias("rest"),
                        F.explode(F.concat("end.done", carry)).alias("one"))
    unit = F.get("units", F.col("one.at"))
    return one.select("place", unit["doc_id"].alias("doc_id"), unit["source"].alias("source"),
                      unit["size"].alias("size"), unit["whole"].alias("whole"),
                      F.col("rest").alias("part"), F.col("one.bit").alias("bit"))


def copies(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
           cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row per row of ``sized``.

    The draws depend on ids, sizes and ``seed`` only, so reruns agree. Documents without words
    weigh nothing and are rounded alone. Null ids, repeated rows and a null source are rows like
    any other; no word at all gives targets of 0. ``sized`` is read several times.
    """
    goal = checkpointed(targets(sized, weights, share, cap))
    part = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = checkpointed(
        sized.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("part", part)
        .withColumn("whole", F.floor("part").cast("int"))
        .select("place", "doc_id", "source", "size", "whole",
                (F.col("part") - F.col("whole")).alias("part")))
    fixed = (F.col("size") <= 0) | (F.col("part") <= 0)
    alone = uniform(F.lit(f"{seed}/alone"), F.col("doc_id"), F.col("source")) < F.col("part")
    decided = [rows.filter(fixed).withColumn("bit", alone.cast("int"))]
    units, level = rows.filter(~fixed), 0
    while True:
        largest = units.groupBy("place").count().agg(F.max("count")).first()[0] or 0
        if largest <= 1:
            break
        done = checkpointed(_level(units, level, seed))
        decided.append(done.filter("bit IS NOT NULL"))
        units, level = done.filter("bit IS NULL").drop("bit"), level + 1
    decided.append(units.withColumn("bit", alone.cast("int")))
    names = ["place", "doc_id", "size", (F.col("whole") + F.col("bit")).alias("copies")]
    together = decided[0].select(*names)
    for more in decided[1:]:
        together = together.unionByName(more.select(*names))
    return together.join(goal, "place").select(
        "doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, identity: str = "doc_id", source: str = "source", text: str = "text",
          **options) -> DataFrame:
    """``docs`` with every row left out, kept or repeated as :func:`copies` says.

    Rows that agree in id, source and size share their copies evenly; the odd ones go to the
    first of them in the order of their texts.
    """
    sized = checkpointed(sizes(docs, identity, source, text))
    plan = copies(sized, **options).groupBy("doc_id", "source", "size").agg(
        F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n")).filter("all > 0")
    names = fresh(docs.columns, "_id", "_source", "_size", "_all", "_n", "_words", "_at")
    key, origin, size, total, n, words, at = names
    plan = plan.toDF(key, origin, size, total, n)
    same = (F.col(identity).eqNullSafe(F.col(key)) & F.col(source).eqNullSafe(F.col(origin))
            & (F.col(words) == F.col(size)))
    found = docs.withColumn(words, count_words(F.col(text))).join(plan, same)

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return (rows.filter(times > 0).withColumn(at, F.explode(F.sequence(F.lit(1), times)))
                .select(*docs.columns))

    one = repeated(found.filter(F.col(n) == 1), F.col(total).cast("int"))
    order = Window.partitionBy(key, origin, size).orderBy(text)
    share = (F.floor(F.col(total) / F.col(n)).cast("int")
             + (F.col(at) <= F.col(total) % F.col(n)).cast("int"))
    several = found.filter(F.col(n) > 1).withColumn(at, F.row_number().over(order))
    return one.unionByName(repeated(several.withColumn(n, share), F.col(n)))
