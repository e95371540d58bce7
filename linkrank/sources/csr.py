"""The binary compressed-row format as a Spark data source, with checks that name the file and the place."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.graph import Graph, renumbered, row_pointers
from ..workers import ship

# Fixed values of the format.
MAGIC = b"PRCSR001"
HEADER_BYTES = 24
MOST_NODES = 2**32 - 1

SCHEMAS = {"edges": "src long, dst long", "vertices": "id long, in_deg long, out_deg long", "row_ptr": "id long, in_deg long", "ids": "node long, orig_id long"}


@dataclass
class Header:
    path: str
    n: int
    m: int

    @property
    def columns_at(self) -> int:
        return HEADER_BYTES + 8 * (self.n + 1)

    @property
    def degrees_at(self) -> int:
        return self.columns_at + 4 * self.m


def _read(path: str, at: int, count: int, kind: str) -> np.ndarray:
    out = np.fromfile(path, kind, count, offset=at)
    if len(out) != count:
        raise ValueError(f"{path}: {count} values wanted at byte {at}, {len(out)} there")
    return out


def header(path: str) -> Header:
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        start = f.read(HEADER_BYTES)
    if start[:8] != MAGIC or len(start) < HEADER_BYTES:
        raise ValueError(f"{path}: not a {MAGIC.decode()} file")
    n, m = np.frombuffer(start, "<u8", 2, 8).tolist()
    if not 0 < n <= MOST_NODES or m > size // 4:
        raise ValueError(f"{path}: implausible counts {n} and {m}")
    h = Header(path, n, m)
    if size != h.degrees_at + 4 * n:
        raise ValueError(f"{path}: {size} bytes, {h.degrees_at + 4 * n} wanted")
    return h


def checked_pointers(h: Header, first: int, last: int) -> np.ndarray:
    """The pointers first..last of the rows between; where they are the file's ends, they must be 0 and the number of edges."""
    p = _read(h.path, HEADER_BYTES + 8 * first, last - first + 1, "<u8").astype(np.int64)
    if first == 0 and p[0] != 0 or last == h.n and p[-1] != h.m:
        raise ValueError(f"{h.path}: row pointers run from {p[0]} to {p[-1]}, not from 0 to {h.m}")
    if (fall := np.flatnonzero(np.diff(p) < 0)).size:
        raise ValueError(f"{h.path}: row {first + fall[0]} ends before it begins")
    return p


def row_of_edge(h: Header, edge: int) -> int:
    """The first row that ends beyond an edge, by bisection in the file: no task and no driver reads all pointers for it."""
    low, high = 0, h.n
    with open(h.path, "rb") as f:
        while low < high:
            middle = (low + high) // 2
            f.seek(HEADER_BYTES + 8 * (middle + 1))
            if int.from_bytes(f.read(8), "little") <= edge:
                low = middle + 1
            else:
                high = middle
    return low


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CsrReader(DataSourceReader):
    """columns=edges gives src, dst; columns=vertices gives id, in_deg, out_deg; columns=row_ptr gives id, in_deg and reads nothing but the pointers. Partitions
    hold about as many edges each. columns=ids reads a file of original ids."""

    def __init__(self, options):
        self.path, self.columns = options["path"].removeprefix("file://"), options.get("columns", "edges")
        self.parts = int(options.get("partitions", "8"))

    def partitions(self):
        if self.columns == "ids":
            size = os.path.getsize(self.path)
            if size % 8:
                raise ValueError(f"{self.path}: {size} bytes are no whole number of ids")
            cuts = sorted({size // 8 * i // self.parts for i in range(self.parts + 1)})
        else:
            h = header(self.path)
            checked_pointers(h, 0, 0)
            checked_pointers(h, h.n, h.n)
            cuts = sorted({0, h.n, *(row_of_edge(h, h.m * i // self.parts) for i in range(1, self.parts))})
        return [Rows(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] or [Rows(0, 0)]

    def read(self, part):
        for a in range(part.first, part.last, 1 << 20):
            yield from self._slice(a, min(a + (1 << 20), part.last))

    def _slice(self, first, last):
        ids = np.arange(first, last)
        if self.columns == "ids":
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_read(self.path, 8 * first, last - first, "<i8"))], names=["node", "orig_id"])
            return
        h = header(self.path)
        p = checked_pointers(h, first, last)
        if self.columns == "row_ptr":
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(p))], names=["id", "in_deg"])
            return
        if self.columns == "vertices":
            out = _read(self.path, h.degrees_at + 4 * first, len(ids), "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(p)), pa.array(out)], names=["id", "in_deg", "out_deg"])
            return
        before = -1
        for at in range(int(p[0]), int(p[-1]), 1 << 20):  # a long row comes in several pieces
            count = min(1 << 20, int(p[-1]) - at)
            src = _read(self.path, h.columns_at + 4 * at, count, "<u4").astype(np.int64)
            dst = first + np.searchsorted(p, np.arange(at, at + count), "right") - 1
            if (bad := np.flatnonzero(src >= h.n)).size:
                raise ValueError(f"{self.path}: edge {at + bad[0]} comes from node {src[bad[0]]} of {h.n}")
            key = dst * h.n + src if h.n < 1 << 31 else None
            rising = np.diff(key, prepend=before) > 0 if key is not None else (np.diff(src, prepend=-1) > 0) | (np.diff(dst, prepend=-1) > 0)
            if not rising.all():
                raise ValueError(f"{self.path}: row {dst[np.flatnonzero(~rising)[0]]} does not ascend")
            before = int(key[-1]) if key is not None else -1
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])


class CsrSource(DataSource):
    """spark.dataSource.register(CsrSource); spark.read.format("csr").option("columns", ...).load(path). The path must be visible to all executors."""

    @classmethod
    def name(cls):
        return "csr"

    def schema(self):
        return SCHEMAS[self.options.get("columns", "edges")]

    def reader(self, schema):
        return CsrReader(self.options)


def read_csr(spark: SparkSession, path: str, columns: str = "edges", partitions: int | None = None) -> DataFrame:
    ship(spark).dataSource.register(CsrSource)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.format("csr").option("columns", columns).option("partitions", parts).load(path)


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(read_csr(spark, path, "vertices"), read_csr(spark, path))


def read_ids(spark: SparkSession, path: str, n: int) -> DataFrame:
    """node, orig_id: as many as the graph has nodes."""
    size = os.path.getsize(path.removeprefix("file://"))
    if size != 8 * n:
        raise ValueError(f"{path}: {size} bytes are not the ids of {n} nodes")
    return read_csr(spark, path, "ids")


def _put(values: DataFrame, path: str, base: int, kind: str) -> None:
    """values(pos, value) into the file at path, at base + pos times the size of kind, by the tasks that have them."""
    size = np.dtype(kind).itemsize

    def put(batches):
        with open(path, "r+b") as f:
            for b in batches:
                at, v = np.asarray(b.column(0)), np.asarray(b.column(1)).astype(kind)
                order = np.argsort(at)
                at, v = at[order], v[order]
                for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    if len(run):
                        f.seek(base + size * int(at[run[0]]))
                        f.write(v[run].tobytes())
        yield from ()

    values.select("pos", "value").mapInArrow(put, "pos long, value long").foreach(lambda r: None)


def write_csr(indexed: Graph, n: int, path: str) -> None:
    """Export of a graph over nodes 0..n-1. Tasks write their ranges into one file of known size, which must be visible to all; the driver
    holds the header alone."""
    path = path.removeprefix("file://")
    m = indexed.edges.count()
    h = Header(path, n, m)
    with open(path, "wb") as f:
        f.write(MAGIC + np.array([n, m, 0], "<u8").tobytes())
        f.truncate(h.degrees_at + 4 * n)
    edges = renumbered(indexed.edges.select("dst", "src"), ["dst", "src"], "pos")
    _put(edges.select("pos", F.col("src").alias("value")), path, h.columns_at, "<u4")
    ends = row_pointers(indexed)
    _put(ends.select(F.col("id").alias("pos"), F.col("row_end").alias("value")).repartitionByRange("pos").sortWithinPartitions("pos"), path, HEADER_BYTES + 8, "<u8")
    _put(indexed.vertices.select(F.col("id").alias("pos"), F.col("out_deg").alias("value")).repartitionByRange("pos").sortWithinPartitions("pos"), path, h.degrees_at, "<u4")


def write_ids(ids: DataFrame, path: str) -> None:
    """Original ids in node order: ids(node, id)."""
    path = path.removeprefix("file://")
    with open(path, "wb") as f:
        f.truncate(8 * ids.count())
    _put(ids.select(F.col("node").alias("pos"), F.col("id").alias("value")).repartitionByRange("pos").sortWithinPartitions("pos"), path, 0, "<i8")


def with_ids(ranks: DataFrame, ids: DataFrame) -> DataFrame:
    return ranks.join(ids.select(F.col("node").alias("id"), "orig_id"), "id")
