"""Quality classifier from positive and unlabelled texts.

Trusted good texts (P) and unlabelled web texts (U) share one linear model z over coarse measures
of a text. With the class prior pi and the loss l(z) = (1 - z)^2 / 4, the risk is
pi E_P[l(z)] + max(0, E_U[l(-z)] - pi E_P[l(-z)]): the bad texts' risk is what U has beyond its
good share, and never below zero. This risk depends on the texts only through the first and second
moments of P and U, so one aggregation over *all* training rows gives it exactly; nothing is
sampled, and the driver descends on matrices whose size is the number of measures.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import SCHEMA, packed, summed, unpacked
from .common import checkpointed, fold, fresh

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
RIDGE = 0.02

# Bounds of the steps into which each measure is cut.
SHARES = (0.001, 0.003, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.75)
EDGES = {
    "bytes": (1, 50, 100, 200, 500, 1000, 3000, 10_000, 50_000),
    "words": (1, 3, 10, 30, 100, 300, 1000, 5000),
    "upper": SHARES, "digits": SHARES, "stops": SHARES, "marks": SHARES, "bars": SHARES,
    "symbols": SHARES, "high": SHARES, "other": SHARES,
    "word_bytes": (2, 3, 4, 5, 6, 7, 8, 10, 15),
    "distinct": (0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.99),
    "repeats": SHARES, "top_word": SHARES, "line_repeats": SHARES,
    "line_words": (1, 3, 10, 30, 100, 300),
}
MEASURES = list(EDGES)
WIDTH = 1 + sum(len(e) for e in EDGES.values())

_CLASS = np.zeros(256, np.int8)  # of a byte
for _name, _bytes in enumerate((
        bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" \t\n\x0b\x0c\r",
        b".,;:'\"()-", b"!?", b"|", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256)))):
    _CLASS[list(_bytes)] = _name + 1


def measures(text: bytes | None) -> list[float]:
    """The measures of a UTF-8 text; null and empty texts have zeros."""
    if not text:
        return [0.0] * len(MEASURES)
    size = len(text)
    counts = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10)
    other, upper, lower, digits, _, stops, marks, bars, symbols, high = counts.tolist()
    words = text.split()
    n = len(words) or 1
    frequent = Counter(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        size, len(words), upper / max(1, upper + lower), digits / size, stops / size,
        marks / size, bars / size, symbols / size, high / size, other / size,
        (size - n) / n, len(frequent) / n, repeats / n,
        max(frequent.values(), default=0) / n if n >= 20 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, n / max(1, len(lines)),
    ]


def steps(values: list[float]) -> bytes:
    """How many bounds of each measure a text has passed."""
    return bytes(sum(v >= e for e in edges) for v, edges in zip(values, EDGES.values()))


def _expanded(levels: np.ndarray) -> np.ndarray:
    """0/1 columns, one per bound, and a constant one."""
    parts = [np.ones((len(levels), 1))]
    for i, edges in enumerate(EDGES.values()):
        parts.append((levels[:, i:i + 1] > np.arange(len(edges))).astype(float))
    return np.concatenate(parts, axis=1)


def described(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, steps): the steps of every whole text, a few bytes a row."""
    kind = docs.schema[identity].dataType

    def run(batches):
        for batch in batches:
            found = [steps(measures(x.as_py())) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())],
                                  names=["id", "steps"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("steps", T.BinaryType())])
    return docs.select(F.col(identity).alias("id"), F.col(text).cast("binary").alias("text")
                       ).mapInArrow(run, schema)


def _moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Second moments (the constant column makes them hold the first) of U (0) and P (1), not yet
    divided by their counts; rows: (steps, trusted)."""
    def run(frames):
        total = {0: np.zeros((WIDTH, WIDTH)), 1: np.zeros((WIDTH, WIDTH))}
        for frame in frames:
            if len(frame):
                levels = np.frombuffer(b"".join(frame["steps"]), np.uint8).reshape(len(frame), -1)
                x, trusted = _expanded(levels), frame["trusted"].to_numpy(bool)
                total[0] += x.T @ x
                total[1] += x[trusted].T @ x[trusted]
        yield pd.DataFrame({"key": [0, 1], "blob": [packed(total[0]), packed(total[1])]})

    sums = summed(rows.select("steps", "trusted").mapInPandas(run, SCHEMA), "f8").collect()
    found = {r["key"]: unpacked(r["blob"], "f8").reshape(WIDTH, WIDTH) for r in sums}
    return {k: found.get(k, np.zeros((WIDTH, WIDTH))) for k in (0, 1)}


def fit(unlabelled: np.ndarray, trusted: np.ndarray, prior: float, rounds: int = 2000,
        ridge: float = RIDGE) -> np.ndarray:
    """Weights of least non-negative risk; all zero if there are no trusted texts."""
    if trusted[0, 0] < 1 or unlabelled[0, 0] < 1:
        return np.zeros(WIDTH)
    u, p = unlabelled / unlabelled[0, 0], trusted / trusted[0, 0]
    mean_u, mean_p = u[0], p[0]
    eye = np.eye(WIDTH)
    eye[0, 0] = 0
    # Where the bad texts' risk is positive, the least risk solves a linear system.
    w = np.linalg.solve(u + 4 * ridge * eye + 1e-9 * np.eye(WIDTH), 2 * prior * mean_p - mean_u)
    step = 1 / (np.linalg.norm(u, 2) + np.linalg.norm(p, 2))

    def bad_risk(w):
        return (1 + 2 * w @ mean_u + w @ u @ w) / 4 - prior * (1 + 2 * w @ mean_p + w @ p @ w) / 4

    for _ in range(rounds):
        if bad_risk(w) >= 0:
            gradient = (mean_u + u @ w) / 2 - prior * mean_p + 2 * ridge * eye @ w
            if np.abs(gradient).max() < 1e-9:
                break
            w = w - step * gradient
        else:  # go back to where it is not negative
            w = w + step * ((mean_u + u @ w) / 2 - prior * (mean_p + p @ w) / 2)
    return w


def scored(docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text",
           label_id: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD
           ) -> DataFrame:
    """(id, held_out, score, predicted), a row per row of ``docs``.

    Trusted texts are training rows labelled 1; all training rows are the unlabelled texts; the
    prior is the share of 1 among the labelled training rows. An id with several labels counts
    as 1 only if all say so; a null label or id labels nothing. A null id is a training row
    without a label. Null and empty texts are scored like any other. Without trusted texts every
    score is 0.5; empty tables give no rows.
    """
    rows = checkpointed(described(docs, identity, text).withColumn(
        "held_out", fold(F.col("id"), FOLDS) == HELD_OUT))
    marked = (
        labels.select(F.col(label_id).alias("_id"), F.col(label).alias("_label"))
        .filter("_id IS NOT NULL AND _label IS NOT NULL")
        .filter(fold(F.col("_id"), FOLDS) != HELD_OUT)
        .groupBy("_id").agg(F.min("_label").alias("_label"))
    )
    train = rows.filter(~F.col("held_out")).join(marked, F.col("id") == F.col("_id"), "left")
    share = marked.agg(F.avg((F.col("_label") == 1).cast("double"))).first()[0]
    sums = _moments(train.withColumn("trusted", F.coalesce(F.col("_label") == 1, F.lit(False))))
    weights = fit(sums[0], sums[1], share or 0.0)

    def run(batches):
        for batch in batches:
            raw = batch.column("steps").to_pylist()
            levels = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
            z = _expanded(levels) @ weights
            score = (np.clip(z, -1, 1) + 1) / 2
            yield pa.record_batch(
                [batch.column("id"), batch.column("held_out"), pa.array(score),
                 pa.array((score >= threshold).astype(np.int32))],
                names=["id", "held_out", "score", "predicted"])

    schema = T.StructType([
        rows.schema["id"], T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text",
             **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns are kept as they are.

    A row is rejected with its id: rows that share one go if any of their texts is rejected. A row
    without an id is kept.
    """
    rejected = (
        scored(docs, labels, identity, text, **options).filter("predicted = 0 AND id IS NOT NULL")
        .select("id").distinct()
    )
    key, = fresh(docs.columns, "_id")
    return docs.join(rejected.withColumnRenamed("id", key), F.col(identity) == F.col(key),
                     "left_anti")
