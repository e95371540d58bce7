"""Graphs from raw edges: deduplication, degrees, renumbering, statistics and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved


@dataclass(frozen=True)
class Graph:
    """edges(src, dst) without repeats; vertices(id, out_deg, in_deg) with all ids of the raw edges."""

    vertices: DataFrame
    edges: DataFrame


def unique_edges(raw: DataFrame, drop_self_loops: bool = False) -> DataFrame:
    edges = raw.select("src", "dst")
    return (edges.filter("src <> dst") if drop_self_loops else edges).distinct()


def nodes(raw: DataFrame) -> DataFrame:
    """Ids at either end of some raw edge, self-loops included."""
    return raw.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """ids with out_deg and in_deg, 0 where there is no edge: one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.unionByName(ids.select("id", F.lit(0).alias("o"), F.lit(0).alias("i"))).groupBy("id").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"))


def from_edges(raw: DataFrame, drop_self_loops: bool = False, keep: bool = False) -> Graph:
    """keep: writes edges and vertices out once, for runs that read them many times."""
    edges = unique_edges(raw, drop_self_loops)
    if keep:
        edges = saved(edges)
    ids = nodes(raw) if drop_self_loops else edges.select("src", "dst").limit(0).select(F.col("src").alias("id"))
    vertices = degrees(ids, edges)
    return Graph(saved(vertices) if keep else vertices, edges)


def edge_stats(raw: DataFrame, drop_self_loops: bool = False) -> DataFrame:
    """n_raw, n_unique, self_loops (raw rows, dropped or not) and duplicates_removed."""
    each = raw.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    loop = F.col("src") == F.col("dst")
    left = ~loop if drop_self_loops else F.lit(True)
    return each.agg(
        F.sum("c").alias("n_raw"), F.count_if(left).alias("n_unique"), F.coalesce(F.sum(F.when(loop, F.col("c"))), F.lit(0)).alias("self_loops"),
        (F.sum(F.when(left, F.col("c")).otherwise(0)) - F.count_if(left)).alias("duplicates_removed"),
    )


def convert_stats(raw: DataFrame, drop_self_loops: bool = False) -> DataFrame:
    """What a conversion reports, in one row: edge_stats and graph_info."""
    return edge_stats(raw, drop_self_loops).join(graph_info(from_edges(raw, drop_self_loops)))


def renumbered(ids: DataFrame, by: str | list[str] = "id", name: str = "node") -> DataFrame:
    """0-based place of each row in ascending order, without one task for all: range partitions, places in them, and a sum of partition counts."""
    by = [by] if isinstance(by, str) else by
    placed = saved(ids.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.monotonically_increasing_id()))
    part = F.shiftright("__p", 33)
    before, first = 0, []
    for p, c in sorted(placed.groupBy(part.alias("p")).count().collect()):  # as many rows as partitions
        first.append((p, before))
        before += c
    starts = ids.sparkSession.createDataFrame(first, "__part long, __first long")
    at = F.col("__first") + F.col("__p").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), part == F.col("__part")).withColumn(name, at).drop("__p", "__part", "__first")


def indexed(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph over 0-based node numbers, written out, and (node, id)."""
    numbered = saved(renumbered(graph.vertices))
    ids = numbered.select("node", "id")
    src, dst = ids.withColumnsRenamed({"id": "s", "node": "src_node"}), ids.withColumnsRenamed({"id": "d", "node": "dst_node"})
    e = graph.edges
    edges = e.join(src, e["src"] == src["s"]).join(dst, e["dst"] == dst["d"]).select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    return Graph(numbered.select(F.col("node").alias("id"), "out_deg", "in_deg"), saved(edges)), ids


def row_pointers(graph: Graph) -> DataFrame:
    """node, row_end: cumulative in-degrees in node order, from per-block sums so that no task sees all nodes."""
    numbered = renumbered(graph.vertices.select("id", "in_deg"))
    numbered = saved(numbered.withColumn("block", F.expr("node div 65536")))
    sums = numbered.groupBy("block").agg(F.sum("in_deg").alias("s"))
    before = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("before"))
    within = F.sum("in_deg").over(Window.partitionBy("block").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.join(before, "block").select("node", "id", (F.col("before") + within).alias("row_end"))


def adjacency(graph: Graph) -> DataFrame:
    """dst, in_nbrs (ascending) of every row that has some."""
    return graph.edges.groupBy("dst").agg(F.sort_array(F.collect_list("src")).alias("in_nbrs"))


def graph_info(graph: Graph, thread_max: int = 16, warp_max: int = 256) -> DataFrame:
    """One row: nodes, edges, dangling, no_in_edges, max_in_deg, max_out_deg, max_in_node (the smallest of ties), rows and edges by length."""
    v, d = graph.vertices, F.col("in_deg")
    bins = [("thread", d <= thread_max), ("warp", (d > thread_max) & (d <= warp_max)), ("block", d > warp_max)]
    top = F.max(F.struct("in_deg", (-F.col("id")).alias("neg")))
    return v.agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("in_deg").alias("edges"), F.count_if(F.col("out_deg") == 0).alias("dangling"), F.count_if(d == 0).alias("no_in_edges"),
        F.max("in_deg").alias("max_in_deg"), F.max("out_deg").alias("max_out_deg"), (-top["neg"]).alias("max_in_node"),
        *(F.count_if(c).alias(f"{n}_rows") for n, c in bins), *(F.sum(F.when(c, d).otherwise(0)).alias(f"{n}_edges") for n, c in bins),
    )


def longest_row_share(graph: Graph) -> DataFrame:
    """How much of all edges the longest row has, in percent; null without edges."""
    return graph.vertices.agg(F.round(F.try_divide(F.lit(100.0) * F.max("in_deg"), F.sum("in_deg")), 6).alias("longest_row_pct"))


def degree_histogram(graph: Graph) -> DataFrame:
    return graph.vertices.filter("in_deg > 0").groupBy("in_deg").agg(F.count(F.lit(1)).alias("n"))


def validate(graph: Graph) -> DataFrame:
    """check, ok, measured: the conditions that a loaded graph must meet."""
    v, e = graph.vertices, graph.edges
    totals = v.agg(F.sum("in_deg").alias("i"), F.sum("out_deg").alias("o"), F.count(F.lit(1)).alias("n"), F.min("in_deg").alias("low"))
    m = e.agg(F.count(F.lit(1)).alias("m"))
    lost = e.join(v.select(F.col("id").alias("src")), "src", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    again = e.groupBy("src", "dst").count().filter("count > 1").agg(F.count(F.lit(1)).alias("again"))
    row = totals.join(m).join(lost).join(again)  # four single rows
    checks = [("nodes_positive", F.col("n") > 0, F.col("n")), ("row_end_is_edges", F.col("i") == F.col("m"), F.col("i")), ("out_degrees_sum_to_edges", F.col("o") == F.col("m"), F.col("o")),
              ("row_lengths_not_negative", F.col("low") >= 0, F.col("low")), ("sources_known", F.col("lost") == 0, F.col("lost")), ("edges_unique", F.col("again") == 0, F.col("again"))]
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), ok.alias("ok"), x.cast("long").alias("measured")) for n, ok, x in checks))).alias("c")).select("c.*")
