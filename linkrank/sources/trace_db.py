"""Profiler traces in SQLite files as Spark tables."""

from __future__ import annotations

import os
import sqlite3
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..workers import ship

# Fixed names of the format: our name, the file's table, its columns and their types here.
TABLES = {
    "strings": ("StringIds", "id long, value string"),
    "calls": ("CUPTI_ACTIVITY_KIND_RUNTIME", "start long, end long, nameId long, correlationId long"),
    "kernels": ("CUPTI_ACTIVITY_KIND_KERNEL", "start long, end long, shortName long, correlationId long"),
    "memcpys": ("CUPTI_ACTIVITY_KIND_MEMCPY", "start long, end long, copyKind int, bytes long, correlationId long"),
}
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
SLICE = 1_000_000  # rowids in a partition


class RowIds(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class TraceReader(DataSourceReader):
    """Partitions are ranges of rowids, so that a large trace is read by many tasks."""

    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.table, ddl = TABLES[options["table"]]
        self.columns = [tuple(c.split()) for c in ddl.split(", ")]

    def _open(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        db = self._open()
        least, most = db.execute(f"select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from {self.table}").fetchone()
        db.close()
        return [RowIds(a, min(a + SLICE, most + 1)) for a in range(least, most + 1, SLICE)] or [RowIds(0, 0)]

    def read(self, part):
        schema = pa.schema([(n, TYPES[t]) for n, t in self.columns])
        db = self._open()
        rows = db.execute(f"select {', '.join(f'\"{n}\"' for n, _ in self.columns)} from {self.table} where rowid >= ? and rowid < ?", (part.first, part.last))
        while some := rows.fetchmany(10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
        db.close()


class TraceSource(DataSource):
    """spark.read.format("trace_db").option("table", "calls").load(path). The path must be visible to all executors."""

    @classmethod
    def name(cls):
        return "trace_db"

    def schema(self):
        return TABLES[self.options["table"]][1].replace("end long", "`end` long")

    def reader(self, schema):
        return TraceReader(self.options)


def read_trace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """calls(start, end, name, correlationId), their names cut at the version suffix, and work(start, end, name, bytes, correlationId). A copy is named
    by its direction, and replaces a kernel with its correlation id; a kernel has no bytes."""
    ship(spark).dataSource.register(TraceSource)
    read = lambda table: spark.read.format("trace_db").option("table", table).load(path)
    names = read("strings").withColumnsRenamed({"id": "nameId", "value": "name"})
    calls = read("calls").join(names, "nameId").select("start", "end", F.substring_index("name", "_v", 1).alias("name"), "correlationId")
    copies = read("memcpys")
    kernels = read("kernels").join(names, F.col("shortName") == F.col("nameId")).join(copies.select("correlationId"), "correlationId", "left_anti")
    kind = F.when(F.col("copyKind") == 1, "H2D").when(F.col("copyKind") == 2, "D2H").otherwise(F.col("copyKind").cast("string"))
    work = kernels.select("start", "end", "name", F.lit(0).cast("long").alias("bytes"), "correlationId")
    return calls, work.unionByName(copies.select("start", "end", kind.alias("name"), "bytes", "correlationId"))


def write_trace(path: str, strings, calls, kernels, memcpys) -> None:
    """A small trace file, for tests: rows as TABLES has their columns."""
    write_rows(path, [("strings", strings), ("calls", calls), ("kernels", kernels), ("memcpys", memcpys)])


def write_rows(path: str, groups) -> None:
    """A trace file of groups (our table name, rows), one held at a time."""
    db = sqlite3.connect(path)
    for pragma in ("journal_mode = off", "synchronous = off", "cache_size = -65536"):  # a new file: nothing to roll back to
        db.execute(f"pragma {pragma}")
    inserts = {}
    for name, (table, ddl) in TABLES.items():
        columns = ddl.split(", ")
        db.execute(f"create table {table} ({', '.join(f'\"{c.split()[0]}\"' for c in columns)})")
        inserts[name] = f"insert into {table} values ({', '.join('?' * len(columns))})"
    for name, rows in groups:
        db.executemany(inserts[name], rows)
    db.commit()
    db.close()


def save_trace(path: str, strings: list[tuple[int, str]], rows: DataFrame) -> None:
    """A trace file of any size: rows(table, and the columns by place), by our table names, pass through one task, as the format is one file. The path must be
    visible to all executors; an attempt of the task that doesn't finish leaves no file at it."""
    path = path.removeprefix("file://")

    def write(batches):
        beside = f"{path}-{uuid.uuid4().hex}"

        def groups():
            yield "strings", strings
            for batch in batches:
                for name in ("calls", "kernels", "memcpys"):
                    part = batch.filter(pc.equal(batch.column(0), name))
                    yield name, zip(*(c.to_pylist() for c in part.columns[1 : 1 + len(TABLES[name][1].split(", "))]), strict=True)

        write_rows(beside, groups())
        os.replace(beside, path)
        yield from ()

    ship(rows.sparkSession)
    rows.coalesce(1).mapInArrow(write, "done boolean").collect()
