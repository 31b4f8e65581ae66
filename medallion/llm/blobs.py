"""Sums of equally long numeric arrays that tasks have gathered, by key."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key long, blob binary"


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def unpacked(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=dtype)


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _restored(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], size, codec="zstd", asbytes=True) if size else b""


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


def packed_planes(values: np.ndarray) -> bytes:
    """64-bit integers, all their first bytes before the second ones: most of these are alike."""
    return _squeezed(_planes(values))


def unpacked_planes(blob: bytes) -> np.ndarray:
    return _unplaned(_restored(blob))


def packed_counts(values: np.ndarray) -> bytes:
    """Numbers from 0 on, most of them small: a byte each, and the large ones once more."""
    large = values[values >= 255].astype(np.int64)
    small = np.minimum(values, 255).astype(np.uint8)
    return _squeezed(len(values).to_bytes(8, "little") + _planes(large) + small.tobytes())


def unpacked_counts(blob: bytes) -> np.ndarray:
    raw = _restored(blob)
    small = len(raw) - int.from_bytes(raw[:8], "little")
    values = np.frombuffer(raw, np.uint8, offset=small).astype(np.int64)
    values[values == 255] = _unplaned(raw[8:small])
    return values


def _sum(dtype: str):
    def run(frames):
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for key, blob in zip(frame["key"], frame["blob"]):
                part = unpacked(blob, dtype)
                if key in sums:
                    sums[key] += part
                else:
                    sums[key] = part.copy()
        if sums:
            yield pd.DataFrame({"key": list(sums), "blob": [packed(a) for a in sums.values()]})

    return run


def summed(parts: DataFrame, dtype: str, salts: int = 16) -> DataFrame:
    """One row per key with the sum of its arrays. A task holds one array per key it is dealt;
    a key that many tasks have written is summed in ``salts`` parts first."""
    run = _sum(dtype)
    return (
        parts.withColumn("salt", F.spark_partition_id() % salts).repartition("key", "salt")
        .select("key", "blob").mapInPandas(run, SCHEMA)
        .repartition("key").mapInPandas(run, SCHEMA)
    )
