"""Tables that cut lineage, in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


FOLDER = "linkrank.scratch.folder"


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the session's folder below spark.checkpoint.dir, which driver and executors share. Only where the session names none and runs on
    this machine alone is a local folder chosen; on a cluster that is an error. The path always names its file system, file:// for those of a machine,
    also where spark.checkpoint.dir doesn't. The session's folder is deleted when the driver ends."""
    folder = spark.conf.get(FOLDER, None)
    if not folder:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.conf.get("spark.master", "")
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="linkrank-")
        folder = f"{root.rstrip('/')}/linkrank-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        folder = files.makeQualified(path).toString()
        if folder.startswith("file:"):
            folder = "file://" + folder.removeprefix("file:").removeprefix("//")
        spark.conf.set(FOLDER, folder)
    return f"{folder}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back: later jobs start from files that outlive
    any executor, and its lineage ends here. Compressed, unlike a checkpoint of internal rows."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Bucketed:
    """The rows, written once to the shared folder in as many buckets by `column` as there are shuffle partitions, and sorted by it: joins and sums by it need
    no exchange. drop() forgets the table's name, and deletes its files if asked; `plain` reads its files without it."""

    def __init__(self, df: DataFrame, column: str):
        spark = df.sparkSession
        self.spark, self.path, self.name = spark, scratch_dir(spark), f"linkrank_{uuid.uuid4().hex}"
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(parts, column).sortBy(column).option("path", self.path).option("compression", "zstd").format("parquet").saveAsTable(self.name)
        self.rows = spark.table(self.name)

    def drop(self, files: bool = False) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        if files:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def plain(self) -> DataFrame:
        return self.spark.read.schema(self.rows.schema).parquet(self.path)
