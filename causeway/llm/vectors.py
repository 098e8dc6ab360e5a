"""Vectors of whole numbers, packed.

A vector of floats becomes floor(scale * c) per entry, kept as one binary
value: a tag byte (4 or 8) and the entries as little-endian integers of that
many bytes, the smaller size if all fit.  Equal vectors have equal bytes.
Entries beyond the range of a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOP = 2.0 ** 63


def pack(row: np.ndarray) -> bytes:
    """Bytes of one vector of longs."""
    if not len(row) or (row.min() >= -2 ** 31 and row.max() < 2 ** 31):
        return b"\x04" + row.astype("<i4").tobytes()
    return b"\x08" + row.astype("<i8").tobytes()


def unpack(values: list[bytes], dim: int) -> np.ndarray:
    """Rows of longs, those shorter than ``dim`` filled up with zeros."""
    out = np.zeros((len(values), dim), np.int64)
    for i, v in enumerate(values):
        row = np.frombuffer(v, "<i4" if v[0] == 4 else "<i8", offset=1)
        out[i, :len(row)] = row
    return out


def _whole(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        kept, packed, squares, norms = [], [], [], []
        flat = lists.values
        bad_entry = np.zeros(len(flat) + 1, np.int64)
        values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
        np.cumsum(~np.isfinite(values), out=bad_entry[1:])
        x = np.floor(scale * np.where(np.isfinite(values), values, 0.0))
        inside = np.clip(x, -_TOP, np.nextafter(_TOP, 0)).astype(np.int64)
        inside[x >= _TOP] = np.iinfo(np.int64).max
        offsets = lists.offsets.to_numpy()
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(valid).tolist():
            a, b = int(offsets[i]), int(offsets[i + 1])
            if bad_entry[b] == bad_entry[a]:
                row = inside[a:b]
                kept.append(i)
                packed.append(pack(row))
                f = row.astype(np.float64)
                s = float(f @ f)
                norms.append(s ** 0.5)
                squares.append(int(s) if s < 2 ** 53 else min(sum(v * v for v in row.tolist()), 2 ** 63 - 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(packed, pa.binary()),
             pa.array(squares, pa.int64()), pa.array(norms, pa.float64())], names=["vec_id", "v", "square", "norm"])


def whole_vectors(vectors: DataFrame, scale: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, square, norm): one row per vector of finite entries, packed, the
    sum of its squares (at most the greatest long) and its length.  A null vector and one with
    a null or non-finite entry have no row."""
    narrow = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("c"))
    return narrow.mapInArrow(lambda batches: _whole(batches, scale), "vec_id long, v binary, square long, norm double")
