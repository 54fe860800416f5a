"""Adding up arrays of counts that every task fills on its own.

A task sends its array in blocks; blocks of one number meet in one place and are added as they
arrive, so that no task holds more than its own blocks.  Rows are ``block int, data binary`` with
little-endian 64-bit numbers inside, compressed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "block int, data binary"
#: Numbers in a block.
WIDTH = 1 << 14


def send(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of an array that hold anything."""
    for at in range(0, len(counts), WIDTH):
        part = counts[at : at + WIDTH]
        if part.any():
            data = zlib.compress(part.astype("<i8").tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([at // WIDTH], pa.int32()), pa.array([data], pa.binary())],
                ["block", "data"])


def added(sent: DataFrame, partitions: int = 16) -> DataFrame:
    """One row per block: the sum over all tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(data.as_py()), "<i8")
                k = block.as_py()
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()),
                 pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "data"])

    return sent.repartition(partitions, "block").mapInArrow(add, SCHEMA)


def gathered(sent: DataFrame, size: int) -> np.ndarray:
    """The whole sum on the driver; ``size`` is fixed by the caller and does not grow with rows."""
    out = np.zeros(-(-size // WIDTH) * WIDTH, np.int64)
    for row in added(sent).collect():
        part = np.frombuffer(zlib.decompress(row.data), "<i8")
        out[row.block * WIDTH : row.block * WIDTH + len(part)] = part
    return out[:size]
