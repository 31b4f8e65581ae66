"""The registered queries of the operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann_graph, collocations, context_mixing, conversation_repair, cover_tree, language,
               line_dedup, mixing, packing, private_data, quality, sharding, simhash)
from .common import checkpointed


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pivotal_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix by source weight takes of every document."""
    sized = checkpointed(mixing.sizes(_table(spark, folder, "documents")))
    return mixing.copies(sized).select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op2_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's links of the same label, its group and whether it stays."""
    return cover_tree.linked(_table(spark, folder, "embeddings"))


def op3_context_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score under the mixed model and under single words."""
    return context_mixing.scored(_table(spark, folder, "documents"))


def op4_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard and slot, and its shard with one shard more."""
    return sharding.sharded(_table(spark, folder, "documents"))


def op5_evidence_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's language; trigrams are learnt from all labelled documents."""
    names, model = language.learnt(_table(spark, folder, "documents"))
    return language.identified(_table(spark, folder, "pages"), names, model)


def op6_pruned_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one, among all others."""
    vectors = _table(spark, folder, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))
    return ann_graph.nearest(ann_graph.index(vectors), queries)


def op7_deletion_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and group."""
    return simhash.near_duplicates(_table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), simhash.hexadecimal(F.col("fp")).alias("fingerprint"),
        "component_id")


def op8_histogram_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.pack(_table(spark, folder, "documents"))


def op9_positive_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality score."""
    return quality.scored(_table(spark, folder, "documents"), _table(spark, folder, "labels")
                          ).withColumnRenamed("id", "doc_id")


def op10_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text without repeated chunks of lines, grown to whole passages."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs, removed="removed_lines", passages=True)


def op11_suffix_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every language's first 2000 collocations."""
    return collocations.collocations(_table(spark, folder, "documents"))


def op12_bidirectional_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation's faults, its cheapest repair and a digest of the repaired rows."""
    whole = _table(spark, folder, "conversations")
    repair = conversation_repair.repair(conversation_repair.damaged(whole))
    digests = conversation_repair.digests(repair.rows)
    zero = F.lit(0).cast("long")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = whole.select("conv_id").unionByName(repair.report, allowMissingColumns=True).unionByName(
        digests, allowMissingColumns=True)
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), zero).alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_anchor_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base kinds, and all spans."""
    found = private_data.detected(_table(spark, folder, "documents"))
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*private_data.BASE))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
              for kind in private_data.BASE]
    return found.select(
        F.col("id").alias("doc_id"), *counts,
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"))


QUERIES = {q.__name__: q for q in (
    op1_pivotal_mix, op2_cover_tree, op3_context_mix, op4_hash_tree_shards, op5_evidence_fusion,
    op6_pruned_graph, op7_deletion_variants, op8_histogram_packs,
    op9_positive_unlabelled, op10_line_chunks, op11_suffix_groups, op12_bidirectional_repair,
    op13_anchor_spans)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL: dict[str, str] = {"op11_suffix_groups": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
           '[.,;:!?
-
]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS part
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM words, range(1, 6) AS sizes(k) WHERE len(w) >= k)),
counts AS (
  SELECT lang, k, array_to_string(part, ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
  FROM grams GROUP BY ALL HAVING count(*) >= 100),
sizes AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY 1),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, s.n, c.cut, 1000 * c.f * s.n // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
  JOIN sizes s ON s.lang = c.lang),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
covered AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i
        FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates WHERE k > 2))
  GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))
         AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best LEFT JOIN covered USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000"""}
