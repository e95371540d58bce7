"""Row classes by length, the split of work by a cumulative budget, and the split gather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import PageRankParams
from .graph import Graph, renumbered

LABELS = ("host", "thread", "warp", "block")


def host_threshold(graph: Graph, share: float) -> DataFrame:
    """min_len, host_edges: whole lengths, longest first, while their edges stay within share of all; up to the first that does not fit.
    The window runs over distinct lengths, of which there are few."""
    lengths = graph.vertices.filter("in_deg > 0").groupBy("in_deg").agg(F.sum("in_deg").alias("e"))
    whole = Window.orderBy(F.desc("in_deg")).rowsBetween(Window.unboundedPreceding, 0)
    lengths = lengths.withColumn("cum", F.sum("e").over(whole)).withColumn("m", F.sum("e").over(Window.partitionBy()))
    over = F.col("cum") > F.lit(share) * F.col("m")
    return lengths.agg(F.coalesce(F.max(F.when(over, F.col("in_deg"))) + 1, F.lit(1)).cast("long").alias("min_len"), F.coalesce(F.sum(F.when(~over, F.col("e"))), F.lit(0)).cast("long").alias("host_edges"))


def row_class(length: Column, params: PageRankParams, min_len: Column | int | None = None) -> Column:
    plain = F.when(length <= params.thread_max, "thread").when(length <= params.warp_max, "warp").otherwise("block")
    return plain if min_len is None else F.when((length > 0) & (length >= min_len), "host").otherwise(plain)


def classified(graph: Graph, params: PageRankParams, share: float = 0.0) -> DataFrame:
    """id, in_deg, class."""
    least = host_threshold(graph, share).first()["min_len"] if share > 0 else None
    return graph.vertices.select("id", "in_deg", row_class(F.col("in_deg"), params, least).alias("class"))


def class_shares(rows: DataFrame, labels=LABELS) -> DataFrame:
    """class, rows, edges and their shares in percent; classes without rows are kept."""
    spark = rows.sparkSession
    seen = rows.groupBy("class").agg(F.count(F.lit(1)).alias("rows"), F.sum("in_deg").alias("edges"))
    all_ = spark.createDataFrame([(x,) for x in labels], "class string").join(seen, "class", "left").na.fill(0)
    total = Window.partitionBy()
    pct = lambda c: F.round(F.try_divide(F.lit(100.0) * F.col(c), F.sum(c).over(total)), 6)
    return all_.select("class", "rows", "edges", pct("rows").alias("rows_pct"), pct("edges").alias("edges_pct"))


def grouped_rows(rows: DataFrame) -> DataFrame:
    """class, pos, id: rows in id order within each class, numbered from 0; none where all rows are of the thread class, which needs no lists. No task sees
    a whole class: rows are numbered over all, and each class's first number is taken off."""
    if rows.filter("class <> 'thread'").isEmpty():
        rows = rows.limit(0)
    numbered = renumbered(rows.select("class", "id"), ["class", "id"], "number")
    first = numbered.groupBy("class").agg(F.min("number").alias("first"))
    return numbered.join(F.broadcast(first), "class").select("class", (F.col("number") - F.col("first")).alias("pos"), "id")


def split_gather(edges: DataFrame, contrib: DataFrame, rows: DataFrame) -> DataFrame:
    """id, total by class-wise gathers put together: the same as one gather."""
    from .pagerank import gather

    out = None
    for label in LABELS:
        ids = rows.filter(F.col("class") == label).select(F.col("id").alias("dst"))
        part = gather(edges.join(ids, "dst", "left_semi"), contrib, False)
        out = part if out is None else out.unionByName(part)
    return out


def host_predecessors(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct sources of edges into host rows, and their share of all nodes."""
    ids = rows.filter("class = 'host'").select(F.col("id").alias("dst"))
    found = edges.join(ids, "dst", "left_semi").select("src").distinct().agg(F.count(F.lit(1)).alias("predecessors"))
    share = F.round(F.try_divide(F.col("predecessors").cast("double"), F.col("n")), 9).alias("share")
    return found.join(rows.agg(F.count(F.lit(1)).alias("n"))).select("predecessors", share)
