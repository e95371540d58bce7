"""Graphs made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_seq(spark: SparkSession, d: str) -> DataFrame:
    """Each part of an order to the next one."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).filter("dst is not null")


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """Parts to next parts, parts to suppliers, customers to parts; ids are told apart by their remainder by 3."""
    items = table(spark, d, "lineitem")
    seq = part_seq(spark, d).select((F.col("src") * 3).alias("src"), (F.col("dst") * 3).alias("dst"))
    supply = items.select((F.col("l_partkey") * 3).alias("src"), (F.col("l_suppkey") * 3 + 1).alias("dst"))
    bought = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 3 + 2).alias("src"), (F.col("l_partkey") * 3).alias("dst"))
    return seq.unionByName(supply).unionByName(bought)
