"""Hash embeddings of texts and an order-sensitive digest, for which Spark has no built-in functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.session import ship

DIMENSIONS = 128
# Offset and prime of this hash, and what tells n-gram sizes apart.
OFFSET = 1469598103934665603
PRIME = 1099511628211
GOLDEN = 0x9E3779B97F4A7C15


def hash_embedding(text: str, size: int = DIMENSIONS) -> np.ndarray:
    """Character 1- to 3-grams hashed with a sign to `size` places, of length 1 (all 0 for an empty text)."""
    out = np.zeros(size)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint8).reshape(-1, 4).astype(np.uint64)
    h = np.full(len(codes), OFFSET, np.uint64)
    for n in range(1, 4):
        count = len(codes) - n + 1
        if count <= 0:
            break
        h = h[:count]
        for b in range(4):
            h = (h ^ codes[n - 1 :, b][:count]) * np.uint64(PRIME)
        mixed = h ^ np.uint64(n * GOLDEN % 2**64)
        np.add.at(out, (mixed % np.uint64(size)).astype(np.int64), np.where(mixed >> np.uint64(63), -1.0, 1.0))
    length = np.sqrt((out**2).sum())
    return (out / length if length > 1e-9 else out).astype(np.float32)


def embed(df: DataFrame, text: Column, name: str = "embedding", size: int = DIMENSIONS) -> DataFrame:
    """Adds hash embeddings (null text: of the empty text), batch by batch through Arrow."""
    ship(df.sparkSession)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(texts: pa.Array) -> pa.Array:
        made = [hash_embedding(x or "", size) for x in texts.to_pylist()]
        return pa.array(made, pa.list_(pa.float32()))

    return df.withColumn(name, run(text))
