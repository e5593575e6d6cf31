"""Texts as vectors: a hook for any embedder, and one by hashing that needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from quillmatch.functions.ship import ship

#: What makes a matrix with a row of unit length for each text; it is sent to workers and called with BATCH texts at a time.
Embedder = Callable[[Sequence[str]], np.ndarray]
BATCH, DIMENSIONS = 64, 64
WORD = re.compile("[a-z0-9]+")


def hashing_embedder(texts: Sequence[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Each word of letters and digits adds or takes one at a place that its MD5 tells; then rows are scaled to unit length.

    It says which texts share words, not which are alike in meaning. A text without words has a row of zeros.
    """
    out = np.zeros((len(texts), dimensions))
    for i, text in enumerate(texts):
        for w in WORD.findall((text or "").lower()):
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            out[i, (h >> 1) % dimensions] += 1 if h & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def embedded(rows: DataFrame, text: str, embedder: Embedder | None = hashing_embedder, column: str = "embedding", batch: int = BATCH) -> DataFrame:
    """rows with the vector of each text; null, and so no semantic pass, without an embedder. A null text counts as empty."""
    if embedder is None:
        return rows.withColumn(column, F.lit(None).cast("array<float>"))
    ship(rows.sparkSession)
    kept = rows.drop(column)
    at, out = kept.columns.index(text), StructType([*kept.schema, *StructType().add(column, ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, batch):
                part = b.slice(first, batch)
                vectors = np.asarray(embedder([t or "" for t in part.column(at).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(vectors), pa.list_(pa.float32()))], names=out.fieldNames())

    return kept.mapInArrow(run, out)
