"""Comparisons of two rank tables."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import PageRankParams
from ..scratch import saved
from .graph import Graph, indexed
from .pagerank import pagerank, top_k

DENSE_NODES, DENSE_EDGES = 5_000, 500_000  # a matrix of 200 MB on the driver
PIECE = 262_144  # matrix entries in a row of the stored matrix
PIECES = pa.schema([("first", pa.int64()), ("lengths", pa.binary()), ("src", pa.binary())])
SUMS = pa.schema([("first", pa.int64()), ("sums", pa.binary())])
VERDICT = "check string, ok boolean, measured double, message string"


def worst_difference(got: DataFrame, want: DataFrame) -> DataFrame:
    """max_diff, at_id (the smallest of ties), only_got, only_want."""
    both = got.select("id", F.col("rank").alias("g")).join(want.select("id", F.col("rank").alias("w")), "id", "full")
    d = F.abs(F.col("g") - F.col("w"))
    top = F.max(F.struct(d.alias("d"), (-F.col("id")).alias("neg")))
    return both.agg(top["d"].alias("max_diff"), (-top["neg"]).alias("at_id"), F.count_if(F.col("w").isNull()).alias("only_got"), F.count_if(F.col("g").isNull()).alias("only_want"))


def _placed(ranks: DataFrame, k: int, digits: int | None) -> DataFrame:
    return top_k(ranks, k, digits).select("id", "rank", F.row_number().over(Window.orderBy(F.desc("rank"), "id")).alias("pos"))  # k rows


def order_differences(got: DataFrame, want: DataFrame, k: int = 100, digits: int | None = None) -> DataFrame:
    """differing (places of the top k with other ids), missing (ids of one side only), worst_gap (of the reference ranks at such places) and max_value_diff."""
    g = _placed(got, k, digits).withColumnsRenamed({"id": "gid", "rank": "gr"})
    w = _placed(want, k, digits).withColumnsRenamed({"id": "wid", "rank": "wr"})
    ref = want.select(F.col("id").alias("gid"), F.col("rank").alias("own"))
    pairs = g.join(w, "pos", "full").join(ref, "gid", "left")
    missing = g.join(w, g["gid"] == w["wid"], "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    differ = ~F.col("gid").eqNullSafe(F.col("wid"))
    return pairs.agg(F.count_if(differ).alias("differing"), F.coalesce(F.max(F.when(differ, F.abs(F.col("own") - F.col("wr")))), F.lit(0.0)).alias("worst_gap"), F.max(F.abs(F.col("gr") - F.col("wr"))).alias("max_value_diff")).join(missing)


def verify(got: DataFrame, want: DataFrame, k: int = 100, tolerance: float = 1e-8, converged: bool = True) -> DataFrame:
    """check, ok, measured, message; swaps in the top k pass if the ids agree and the reference ranks at those places lie within tolerance."""
    w, o = worst_difference(got, want).first(), order_differences(got, want, k).first()
    total = got.agg(F.sum("rank")).first()[0]
    rows = [
        ("converged", converged, float(converged), "stopped by the tolerance" if converged else "ran into the iteration limit"),
        ("top_order", o["differing"] == 0 or (o["missing"] == 0 and o["worst_gap"] <= tolerance), float(o["differing"]), f"{o['differing']} of {k} places differ"),
        ("top_values", (o["max_value_diff"] or 0.0) <= tolerance, float(o["max_value_diff"] or 0.0), "largest difference in the top"),
        ("all_values", (w["max_diff"] or 0.0) <= tolerance and not w["only_got"] and not w["only_want"], float(w["max_diff"] or 0.0), f"largest difference at {w['at_id']}"),
        ("rank_sum", abs(total - 1) <= 1e-6, float(total), "sum of ranks"),
    ]
    return got.sparkSession.createDataFrame(rows, VERDICT)


def dense_ranks(graph: Graph, damping: float = 0.85, tol: float = 1e-15, max_iters: int = 1000) -> DataFrame:
    """id, rank by an independent way: the column-stochastic matrix times the vector. A small graph's matrix lies dense on the driver; that of any other is
    stored in pieces of its rows, without zeros, and the driver holds vectors alone, some 60 bytes a node."""
    n, m = graph.vertices.agg(F.count(F.lit(1)), F.sum("in_deg")).first()
    if n > DENSE_NODES or (m or 0) > DENSE_EDGES:
        return _ranks_by_pieces(graph, n, damping, tol, max_iters)
    ids = np.array(sorted(r[0] for r in graph.vertices.select("id").collect()))
    edges = np.array(graph.edges.select("src", "dst").collect(), np.int64).reshape(-1, 2)
    matrix = np.zeros((n, n))
    matrix[np.searchsorted(ids, edges[:, 1]), np.searchsorted(ids, edges[:, 0])] = 1.0
    out = matrix.sum(axis=0)
    matrix[:, out == 0] = 1.0 / n
    matrix /= np.where(out > 0, out, 1.0)
    rank = np.full(n, 1.0 / n)
    for _ in range(max_iters):
        new = (1 - damping) / n + damping * (matrix @ rank)
        moved, rank = np.abs(new - rank).sum(), new
        if moved < tol:
            break
    return graph.vertices.sparkSession.createDataFrame(list(zip(ids.tolist(), rank.tolist(), strict=True)), "id long, rank double")


def _stored_matrix(edges: DataFrame) -> DataFrame:
    """edges(src, dst) over node numbers -> first, lengths, src: entries in row order, PIECE at most together, with the first row's number and the rows' lengths.
    A long row may lie in many pieces."""

    def piece(dst, src):
        return pa.RecordBatch.from_pylist([{"first": int(dst[0]), "lengths": np.bincount(dst - dst[0]).astype(np.int32).tobytes(), "src": src.tobytes()}], PIECES)

    def pack(batches):
        held, size = [], 0
        for b in batches:
            held.append((np.asarray(b.column(0)), np.asarray(b.column(1))))
            size += b.num_rows
            if size >= PIECE:
                yield piece(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield piece(*map(np.concatenate, zip(*held, strict=True)))

    return saved(edges.select("dst", "src").repartitionByRange("dst", "src").sortWithinPartitions("dst", "src").mapInArrow(pack, "first long, lengths binary, src binary"))


def _ranks_by_pieces(graph: Graph, n: int, damping: float, tol: float, max_iters: int) -> DataFrame:
    spark = graph.vertices.sparkSession
    numbered, ids = indexed(graph)
    matrix = _stored_matrix(numbered.edges)

    def vector(rows: DataFrame) -> np.ndarray:
        """Sums of the parts(first, sums), which may overlap."""
        out = np.zeros(n)
        for first, sums in rows.collect():
            part = np.frombuffer(sums)
            out[first : first + len(part)] += part
        return out

    def degrees(batches):
        for b in batches:
            node, deg = (np.asarray(b.column(i)) for i in range(2))
            if len(node):
                low = int(node.min())
                yield pa.RecordBatch.from_pylist([{"first": low, "sums": np.bincount(node - low, deg.astype(float)).tobytes()}], SUMS)

    out = vector(numbered.vertices.repartitionByRange("id").sortWithinPartitions("id").select("id", "out_deg").mapInArrow(degrees, "first long, sums binary"))
    share = np.where(out > 0, 1.0 / np.maximum(out, 1.0), 0.0)
    rank = np.full(n, 1.0 / n)
    for _ in range(max_iters):
        given = spark.sparkContext.broadcast(rank * share)

        def times(batches):
            for b in batches:
                for first, lengths, src in zip(*(b.column(i) for i in range(3)), strict=True):
                    lengths, src = np.frombuffer(lengths.as_buffer(), np.int32).astype(np.int64), np.frombuffer(src.as_buffer(), np.int64)
                    sums, rows = np.zeros(len(lengths)), np.flatnonzero(lengths)
                    sums[rows] = np.add.reduceat(given.value[src], (np.cumsum(lengths) - lengths)[rows])
                    yield pa.RecordBatch.from_pylist([{"first": first.as_py(), "sums": sums.tobytes()}], SUMS)

        new = (1 - damping) / n + damping * (vector(matrix.mapInArrow(times, "first long, sums binary")) + rank[out == 0].sum() / n)
        given.destroy()
        moved, rank = np.abs(new - rank).sum(), new
        if moved < tol:
            break
    ranks = spark.sparkContext.broadcast(rank)

    def named(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(ranks.value[np.asarray(b.column(0))])], ["id", "rank"])

    return ids.select("node", "id").mapInArrow(named, "id long, rank double")


def reference(graph: Graph, params: PageRankParams) -> tuple[DataFrame, str]:
    """What ranks are compared with, and its name: the dense matrix where it fits, else a run of the engine to a tolerance far below the compared one's."""
    if graph.vertices.count() <= DENSE_NODES:
        return dense_ranks(graph, params.damping), "dense"
    return pagerank(graph, replace(params, tol=min(params.tol, 1e-12), precision="double", max_iters=1000))[0], "engine"


def demand(verdicts: DataFrame) -> None:
    failed = verdicts.filter("not ok").collect()
    if failed:
        raise AssertionError("; ".join(f"{r['check']}: {r['message']} ({r['measured']})" for r in failed))
