"""Files and folders through Spark's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those that exist; missing ones are skipped."""
    return [p for p in paths if exists(spark, p)]


def remove(spark: SparkSession, paths: list[str]) -> int:
    """Deletes files or whole folders; how many there were."""
    there = present(spark, paths)
    for path in there:
        p, fs = _path(spark, path)
        fs.delete(p, True)
    return len(there)


def replaced(spark: SparkSession, path: str, rows: DataFrame, schema: StructType | str) -> DataFrame:
    """Writes rows as CSV in place of the folder at path, which they may be read from: beside it first, then under its name."""
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(beside)
    remove(spark, [path])
    p, fs = _path(spark, beside)
    if not fs.rename(p, _path(spark, path)[0]):
        raise OSError(f"{beside} could not be renamed to {path}")
    return spark.read.schema(schema).option("header", True).csv(path)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path and name of every file below a folder; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1))


def natural(name: Column) -> Column:
    """A sort key under which machine2 comes before machine10: digits as numbers padded to 20 places."""
    return F.concat_ws("", F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)))


def machine_label(folder: Column) -> Column:
    """Machine N for a folder machineN, else its name."""
    return F.regexp_replace(folder, r"^machine(\d+)$", "Machine $1")


def measured_machines(spark: SparkSession, results: str) -> DataFrame:
    """folder, label of those below results that hold a run log, in natural order."""
    folder = F.element_at(F.split("path", "/"), -2)
    return listed(spark, results).filter("name = 'bench.csv'").select(folder.alias("folder")).select("folder", machine_label(F.col("folder")).alias("label")).orderBy(natural(F.col("folder")))


def touch(spark: SparkSession, paths: list[str]) -> None:
    """Files of one empty line; Spark lists no empty ones."""
    for path in paths:
        p, fs = _path(spark, path)
        out = fs.create(p)
        out.write(10)
        out.close()
