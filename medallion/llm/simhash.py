"""SimHash near-dedup by deletion variants of few segments.

A text's fingerprint has a bit set where more than half of its word shingles' 64-bit hashes have
it. With at most ``max_distance`` differing bits and ``max_distance // 2 + 1`` segments, one
segment of two near fingerprints differs by one bit at most. Each segment is indexed under all its
variants with one bit deleted; equal variants are joined and the whole fingerprints compared.

Distinct fingerprints are compared, copies are not. Variants that more than ``BUCKET`` fingerprints
share are not paired: their members are indexed again under all deletions of ``max_distance`` bits
of the whole fingerprint. Members of such a variant differ by ``max_distance`` bits at most, so
each is linked with the smallest one: the same components, and no pair is listed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh
from .components import components

SEED = 42
BUCKET = 128  # fingerprints of a variant that are paired directly
BLOCK = 65_536  # shingles counted at once


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text; null and a text without words have 0.

    A-Z are lower-cased; fewer words than ``shingle`` make one shingle of all words.
    """
    words = text.lower().split() if text else []
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n < 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[shingle - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(
            starts[at:at + BLOCK], ends[at:at + BLOCK])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, identity: str = "doc_id", text: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(id, fp): a row per row of ``docs``, with the fingerprint as a signed long."""
    kind = docs.schema[identity].dataType

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)],
                              dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))],
                                  names=["id", "fp"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(identity).alias("id"), F.col(text).cast("binary").alias("text")
                       ).mapInArrow(run, schema)


def _variants(max_distance: int) -> list[tuple[int, int]]:
    """(offset and width as a mask, mask of the kept bits) per segment and deleted bit."""
    segments = max_distance // 2 + 1
    edges = [64 * i // segments for i in range(segments + 1)]
    masks = []
    for low, high in itertools.pairwise(edges):
        segment = sum(1 << b for b in range(low, high))
        masks += [segment & ~(1 << bit) for bit in range(low, high)]
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _indexed(prints: DataFrame, masks: list[int]) -> DataFrame:
    """A row per fingerprint and mask: (slot, value, fp)."""
    table = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    return (
        prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("slot"))
        .select("slot", F.col("fp").bitwiseAND(F.get(table, F.col("slot"))).alias("value"), "fp")
    )


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, max_distance: int = 2) -> DataFrame:
    """(a, b) with a < b: links of distinct fingerprints ``fp`` that connect exactly those that
    chains of pairs with at most ``max_distance`` differing bits connect; every row is such a
    pair. ``prints`` is read twice and must hold each fingerprint once."""
    indexed = _indexed(prints, _variants(max_distance))
    shared = checkpointed(indexed.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
                          .filter("n > 1"))
    members = indexed.join(shared, ["slot", "value"])
    few = (
        members.filter(F.col("n") <= BUCKET)
        .groupBy("slot", "value").agg(F.sort_array(F.collect_list("fp")).alias("all"))
        .select("all", F.posexplode("all").alias("at", "a"))
    )
    near = F.filter(F.slice("all", F.col("at") + 2, F.greatest(F.size("all") - F.col("at") - 1, F.lit(0))),
                    lambda b: _distance(F.col("a"), b) <= max_distance)
    paired = few.select("a", F.explode(near).alias("b"))
    whole = [(1 << 64) - 1 - sum(1 << b for b in bits)
             for bits in itertools.combinations(range(64), max_distance)]
    many = members.filter(F.col("n") > BUCKET).select("fp").distinct()
    again = _indexed(many, whole)
    lowest = again.groupBy("slot", "value").agg(F.min("fp").alias("a"), F.max("fp").alias("z"))
    # Only variants with two members link anything; the smallest member stands for the others.
    starred = (
        again.join(lowest.filter("a < z").drop("z"), ["slot", "value"])
        .filter("fp > a").select("a", F.col("fp").alias("b"))
    )
    return paired.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, identity: str = "doc_id", text: str = "text",
                    shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """(id, fp, component_id): a row per row of ``docs``; component_id is the smallest id that
    chains of near fingerprints reach.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows are
    equal rows of the result. Rows with a null id take part; component_id is null only where no
    row of the component has an id. No other column of ``docs`` is read; an empty table gives
    no rows.
    """
    rows = checkpointed(fingerprints(docs, identity, text, shingle))
    classes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("low")))
    grouped = components(links(classes.select("fp"), max_distance)).withColumnRenamed("node", "fp")
    labelled = classes.join(grouped, "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    named = labelled.join(lowest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, identity: str = "doc_id", text: str = "text",
             shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """``docs`` with one document of each group: the one whose id is the component's.

    Columns are kept as they are. Of rows that share that id one stays; which, is settled by
    their columns, and only such rows are compared. A row without an id can't be named as a
    copy and stays.
    """
    found = near_duplicates(docs, identity, text, shingle, max_distance)
    wanted = (
        found.filter(F.col("id") == F.col("component_id"))
        .groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    )
    key, times = fresh(docs.columns, "_id", "_n")
    kept = docs.join(wanted.select(F.col("id").alias(key), F.col("n").alias(times)),
                     F.col(identity) == F.col(key), "left")
    single = kept.filter((F.col(times) == 1) | F.col(identity).isNull()).select(*docs.columns)
    repeated = kept.filter(F.col(times) > 1).select(*docs.columns)
    return single.unionByName(repeated.groupBy(identity).agg(
        F.min(F.struct(*[c for c in docs.columns if c != identity])).alias(key)
    ).select(*[F.col(identity) if c == identity else F.col(f"{key}.`{c}`").alias(c)
               for c in docs.columns]))
