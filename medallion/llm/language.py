"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior: the likelihood of the visible text under byte
trigrams learnt from labelled texts, the language that the markup declares, the last label of the
address, and the host. How far a declaration can be trusted, and which languages an address suffix,
a domain and a host carry, is estimated from the texts' own posteriors by grouped aggregation;
each level is smoothed towards the one above it, and a page's own share is taken out of its counts.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import SCHEMA, packed, summed, unpacked
from .common import checkpointed

BUCKETS = 1 << 14  # of hashed trigrams
EVIDENCE = 100  # trigrams that the longest text counts as; neighbours are not independent
STRENGTH = 5.0  # pages that the level above is worth

_KEPT = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
              for b in range(256))
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I)
         for name in ("script", "style", "noscript", "template")} | {None: re.compile("-->")}
_HIDDEN = re.compile(r"<(?:(script|style|noscript|template)\b|!--)", re.I)
_TAG = re.compile(r"<[^>]*>")


def visible(page: str | None) -> str:
    """The text of a page without markup, scripts and comments. An opening without an end hides
    nothing. Linear in the page: an end that is missing once is not looked for again."""
    if not page:
        return ""
    shown, at, begin, endless = [], 0, _HIDDEN.search(page), set()
    while begin:
        name, after = begin[1] and begin[1].lower(), begin.end()
        end = None if name in endless else _ENDS[name].search(page, after)
        if end:
            shown += [page[at:begin.start()], " "]
            at = after = end.end()
        else:
            endless.add(name)
        begin = _HIDDEN.search(page, after)
    text = "".join([*shown, page[at:]])
    last = text.rfind(">") + 1  # behind it every tag is open, and each would be read to the end
    return html.unescape(_TAG.sub(" ", text[:last]) + text[last:])


def trigrams(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams of the letters, words padded by single blanks."""
    letters = b" " + b" ".join((text or "").encode("utf-8", "replace").translate(_KEPT).split()) + b" "
    b = np.frombuffer(letters, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    hashed = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.bincount(hashed, minlength=BUCKETS)


def learnt(texts: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each trigram): all labelled rows of ``texts`` count; a null
    label or text teaches nothing."""
    known = texts.select(F.col(label).alias("label"), F.col(text).alias("text")).dropna()
    names = sorted(r[0] for r in known.select("label").distinct().collect())
    place = {name: i for i, name in enumerate(names)}

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for language, value in zip(batch.column(0), batch.column(1)):
                key = place[language.as_py()]
                found = trigrams(value.as_py())
                counts[key] = counts[key] + found if key in counts else found
        yield pa.record_batch([pa.array(list(counts), pa.int64()),
                               pa.array([packed(c) for c in counts.values()], pa.binary())],
                              names=["key", "blob"])

    total = np.zeros((max(1, len(names)), BUCKETS))
    for r in summed(known.mapInArrow(run, SCHEMA), "i8").collect():
        total[r["key"]] = unpacked(r["blob"], "i8")
    return names, np.log((total + 0.5) / (total + 0.5).sum(axis=1, keepdims=True))


def identified(pages: DataFrame, names: list[str], model: np.ndarray, identity: str = "page_id",
               url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host), a row per row of ``pages``.

    A page without text is judged by the other evidence, one without any by what is common; no
    declaration and no host are values of their own. Repeated rows are pages of their own, null
    ids too. Without languages there is nothing to tell: lang is null. Ties go to the language
    that is first by name.
    """
    kind = pages.schema[identity].dataType
    if not names:
        return pages.select(F.col(identity).alias("page_id"), *[
            F.lit(None).cast(t).alias(c) for c, t in (
                ("lang", "string"), ("confidence", "double"), ("text_lang", "string"),
                ("declared", "string"), ("host", "string"))])

    def run(batches):
        for batch in batches:
            scores = []
            for value in batch.column(2):
                counts = trigrams(visible(value.as_py()))
                used = np.flatnonzero(counts)
                n = counts.sum()
                score = model[:, used] @ counts[used] * (min(n, EVIDENCE) / max(1, n))
                scores.append((score - score.max()).tolist())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3),
                                   pa.array(scores, pa.list_(pa.float64()))],
                                  names=["page_id", "host", "declared", "text"])

    host = F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("")))
    tag = F.regexp_extract(F.col(page), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1)
    rows = checkpointed(pages.select(
        F.col(identity).alias("page_id"), host.alias("host"), F.col(page).alias("html"),
        F.lower(F.coalesce(tag, F.lit(""))).alias("declared"),
    ).mapInArrow(run, T.StructType([
        T.StructField("page_id", kind), T.StructField("host", T.StringType()),
        T.StructField("declared", T.StringType()),
        T.StructField("text", T.ArrayType(T.DoubleType()))])))
    labels = F.split(F.col("host"), r"\.")
    weights = F.transform("text", lambda x: F.exp(x))
    long = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .withColumn("all", F.aggregate(weights, F.lit(0.0), lambda s, x: s + x))
        .withColumn("suffix", F.element_at(labels, -1))
        .withColumn("domain", F.array_join(F.slice(
            labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
        .select("*", F.posexplode("text").alias("k", "ll"))
        .withColumn("p", F.exp("ll") / F.col("all"))
        .select("row", "host", "domain", "suffix", "declared", "k", "ll", "p")
    )

    def sums(*keys: str, name: str) -> DataFrame:
        return long.groupBy(*keys).agg(F.sum("p").alias(name), F.count(F.lit(1)).alias(f"{name}_n"))

    common = sums("k", name="all")
    declared = sums("declared", "k", name="said")
    kinds = F.lit(declared.select("declared").distinct().count())
    found = (
        long.join(common, "k").join(declared, ["declared", "k"])
        .join(sums("suffix", "k", name="by_suffix"), ["suffix", "k"])
        .join(sums("domain", "k", name="by_domain"), ["domain", "k"])
        .join(sums("host", "k", name="by_host"), ["host", "k"])
    )

    def smoothed(level: str, above) -> object:
        """Share of the language among the level's other pages, smoothed towards ``above``."""
        own = F.greatest(F.col(level) - F.col("p"), F.lit(0.0))
        return (own + STRENGTH * above) / (F.col(f"{level}_n") - 1 + STRENGTH)

    prior = (F.col("all") + 1) / (F.col("all_n") + len(names))
    for level in ("by_suffix", "by_domain", "by_host"):
        prior = smoothed(level, prior)
    trust = (F.greatest(F.col("said") - F.col("p"), F.lit(0.0)) + 0.5) / (
        F.greatest(F.col("all") - F.col("p"), F.lit(0.0)) + 0.5 * kinds)
    weighed = found.select("row", "k", "ll", (
        F.col("ll") + F.log(prior) + F.log(trust)).alias("score"))
    best = weighed.groupBy("row").agg(
        F.max(F.struct(F.col("score"), (-F.col("k")).alias("k"))).alias("top"),
        F.max(F.struct(F.col("ll"), (-F.col("k")).alias("k"))).alias("text_top"),
        F.max("score").alias("high"), F.collect_list("score").alias("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("high")))
    table = F.array(*[F.lit(n) for n in names])
    return rows.withColumn("row", F.monotonically_increasing_id()).join(best, "row").select(
        "page_id", F.get(table, -F.col("top.k")).alias("lang"), (1 / total).alias("confidence"),
        F.get(table, -F.col("text_top.k")).alias("text_lang"), "declared", "host")
