"""Shared pieces: shipping the package to workers, scratch tables and Arrow helpers."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession

from .. import workers
from ..scratch import saved, scratch_dir


__all__ = ["Rows", "packed", "parts", "rows_of", "saved", "scratch_dir", "ship", "text_key", "unpacked"]

BATCH_ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers and keeps the Arrow batches between them and the JVM small:
    ten thousand texts a batch, the default, are held several times over. Once a session."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return workers.ship(spark)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batches, *names):
    """Python tuples of the named columns, one at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


class Rows:
    """Collects rows and gives them out as Arrow batches of about `limit` bytes."""

    def __init__(self, schema: pa.Schema, limit: int = 4 << 20):
        self.schema, self.limit = schema, limit
        self.reset()

    def reset(self):
        self.columns, self.weight = [[] for _ in self.schema], 0

    def add(self, *values, weight: int = 64) -> bool:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.weight += weight
        return self.weight >= self.limit

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema
        )
        self.reset()
        return out


def text_key(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)
