"""How far apart the entries of a row lie, over 0-based node numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved


SPAN = 1 << 20  # of source numbers that one window sorts together
WIDTH = 1 << 16  # gaps counted together first


def gaps(indexed: DataFrame) -> DataFrame:
    """gap, n: how often each difference of neighbouring sources within a row occurs. A long row is cut into spans of sources, so that no task
    sorts a hub; where spans meet, their last and first sources are neighbours."""
    part = F.expr(f"src div {SPAN}").alias("part")
    cut = indexed.select("dst", "src", part)
    inside = cut.select((F.col("src") - F.lag("src").over(Window.partitionBy("dst", "part").orderBy("src"))).alias("gap"))
    ends = cut.groupBy("dst", "part").agg(F.min("src").alias("first"), F.max("src").alias("last"))
    between = ends.select((F.col("first") - F.lag("last").over(Window.partitionBy("dst").orderBy("part"))).alias("gap"))
    return inside.unionByName(between).filter("gap is not null").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def median_gap(indexed: DataFrame) -> DataFrame:
    """Median difference of neighbouring sources within a row; null if no row has two. Counts of ranges of gaps first tell which ranges hold
    the middle, so only their gaps are looked at one by one."""
    spark = indexed.sparkSession
    counted = saved(gaps(indexed))
    ranges = sorted(counted.groupBy(F.expr(f"gap div {WIDTH}").alias("r")).agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in ranges)
    if not total:
        return spark.createDataFrame([(None,)], "median_gap double")

    def value(place):
        """The gap at a place from 0 among all in order."""
        before = 0
        for r, n in ranges:
            if before + n > place:
                break
            before += n
        for gap, n in sorted(counted.filter(F.expr(f"gap div {WIDTH}") == r).collect()):  # WIDTH rows at most
            if before + n > place:
                return gap
            before += n

    return spark.createDataFrame([((value((total - 1) // 2) + value(total // 2)) / 2,)], "median_gap double")


def distinct_lines(indexed: DataFrame, n: int, element_bytes: int = 8, line_bytes: int = 64, chunk_rows: int = 256) -> DataFrame:
    """Cache lines of the contribution vector that each chunk of rows touches, summed, with the ratios to the edges of a graph of n nodes, and the vector's size."""
    shift = (line_bytes // element_bytes).bit_length() - 1
    lines = indexed.select(F.expr(f"dst div {chunk_rows}").alias("chunk"), F.shiftright("src", shift).alias("line")).distinct().agg(F.count(F.lit(1)).alias("lines"))
    edges = indexed.agg(F.count(F.lit(1)).alias("edges"))
    m = F.col("edges").cast("double")
    return lines.join(edges).select(
        "lines", "edges", F.round(F.try_divide(m, F.lit(n)), 9).alias("mean_row"), F.round(F.lit(n * element_bytes / (1 << 20)), 9).alias("contrib_mib"),
        F.round(F.try_divide(F.col("lines").cast("double"), m), 9).alias("lines_per_edge"), F.round(F.try_divide(m, F.col("lines")), 9).alias("edges_per_line"),
        F.round(F.col("lines") * float(line_bytes) / (1 << 20), 9).alias("mib_per_iteration"),
    )


def approximate_lines(indexed: DataFrame, shift: int = 3, chunk_rows: int = 256) -> DataFrame:
    return indexed.groupBy(F.expr(f"dst div {chunk_rows}").alias("chunk")).agg(F.approx_count_distinct(F.shiftright("src", shift)).alias("lines")).agg(F.sum("lines").alias("lines"))
