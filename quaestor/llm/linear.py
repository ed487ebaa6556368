"""Hashed byte trigrams of whole texts and linear models on them, shared by the two classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 12
#: Bytes hashed at a time; texts of any length are read piece by piece.
PIECE = 1 << 20
#: Letters of ASCII as lower case, all else in ASCII a blank; other bytes stay.
LETTERS = bytes(ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))


def trigram_vector(text: str, table: bytes | None = None) -> np.ndarray:
    """Square roots of the trigram counts, scaled to length 1; zeros for a text under three bytes."""
    data = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(data.translate(table) if table else data, dtype=np.uint8)
    counts = np.zeros(1 << BITS)
    for at in range(0, max(0, len(data) - 2), PIECE):
        b = data[at : at + PIECE + 2].astype(np.uint32)
        code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
        counts += np.bincount(code >> np.uint32(32 - BITS), minlength=1 << BITS)
    counts = np.sqrt(counts)
    return (counts / max(np.sqrt(counts @ counts), 1e-12)).astype(np.float32)


def vectors(df: DataFrame, label: str, kind: str, table: bytes | None = None) -> tuple[np.ndarray, list]:
    """Vectors (computed on the executors) and labels of a bounded sample, on the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [trigram_vector(t.as_py() or "", table).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary())], ["label", "x"])

    rows = df.select(F.col(label).alias("label"), "text").mapInArrow(each, f"label {kind}, x binary").collect()
    rows.sort(key=lambda r: (str(r.label), bytes(r.x)))
    return np.array([np.frombuffer(r.x, dtype=np.float32) for r in rows]).reshape(-1, 1 << BITS), [r.label for r in rows]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights of a linear support vector machine (y is -1 or 1), the bias last; accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w = np.zeros(x.shape[1])
    ahead, momentum = w, 1.0
    rate = 1.0 / (2 * 2 * weight.sum() + reg)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (reg * ahead - 2 * ((weight * slack * y) @ x))
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / grown * (new - w), new, grown
    return w
