"""Link ranking by power iteration."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..params import PageRankParams, PageRankStats
from ..scratch import Bucketed, saved
from .classes import LABELS, classified, host_threshold
from .graph import Graph

BROADCAST_NODES = 2_000_000  # contributions of 16 bytes each: 32 MB
TASK_EDGES = 5_000_000  # a graph of so many edges, some 200 MB with its indices, is iterated over in one task
RUN = pa.schema([("t", pa.int32()), ("id", pa.int64()), ("value", pa.float64()), ("dangling", pa.float64()), ("total", pa.float64()), ("seconds", pa.float64())])
RUN_DDL = "t int, id long, value double, dangling double, total double, seconds double"


def contributions(state: DataFrame, precision: str = "double") -> DataFrame:
    """src, contrib of nodes with out-edges; projected before the join, so that each node divides once."""
    return state.filter("out_deg > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("out_deg")).cast(precision).alias("contrib"))


def dangling_mass(state: DataFrame) -> DataFrame:
    return state.agg(F.coalesce(F.sum(F.when(F.col("out_deg") == 0, F.col("rank"))), F.lit(0.0)).alias("dangling"))


def gather(edges: DataFrame, contrib: DataFrame, small: bool) -> DataFrame:
    """id, total: what each row's in-neighbours give. Partial sums before the exchange take a hub's load off one task."""
    return edges.join(F.broadcast(contrib) if small else contrib, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("contrib").alias("total"))


def step(edges: DataFrame, state: DataFrame, base: float, params: PageRankParams, small: bool) -> DataFrame:
    """The next state(id, out_deg, class, rank, prev); rows without in-edges get exactly base. Edges dealt by src meet contributions
    dealt alike, so only the partial sums move."""
    sums = gather(edges, contributions(state, params.precision), small)
    old = state.select("id", "out_deg", "class", F.col("rank").alias("prev"))
    new = (F.lit(base) + F.lit(params.damping) * F.coalesce("total", F.lit(0.0))).cast(params.precision)
    return old.join(sums, "id", "left").select("id", "out_deg", "class", new.alias("rank"), "prev")


def _in_one_task(vertices: DataFrame, edges: DataFrame, params: PageRankParams) -> DataFrame:
    """RUN rows: the ranks (t = 0), and the error, dangling mass, sum and time of every iteration. vertices(id, out_deg, class)."""
    damping, tol, most, real = params.damping, params.tol, params.max_iters, np.float64 if params.precision == "double" else np.float32
    both = vertices.select("id", F.col("out_deg").alias("x"), "class").unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("x"), F.lit(-1).alias("class")))

    def run(batches):
        parts = [[np.asarray(b.column(i)) for i in range(3)] for b in batches]
        ids, x, kind = (np.concatenate(c) for c in zip(*parts, strict=True))
        is_edge = kind < 0
        order = np.argsort(ids[~is_edge])
        node, out, cls = ids[~is_edge][order], x[~is_edge][order], kind[~is_edge][order]
        dst, src = np.searchsorted(node, ids[is_edge]), np.searchsorted(node, x[is_edge])
        order = np.argsort(dst, kind="stable")
        src = src[order].astype(np.int32)
        lengths = np.bincount(dst, minlength=len(node))
        rows = np.flatnonzero(lengths)
        first = (np.cumsum(lengths) - lengths)[rows]
        n, free = len(node), out == 0
        share = np.where(free, 0.0, 1.0 / np.maximum(out, 1))
        rank = np.full(n, 1.0 / n, real)
        lost, t = float(rank[free].sum(dtype=np.float64)), 0
        begun = time.perf_counter()
        while t < most:
            t += 1
            contrib = (rank.astype(np.float64) * share).astype(real)
            total = np.zeros(n)
            if len(rows):
                total[rows] = np.add.reduceat(contrib[src], first, dtype=np.float64)
            new = ((1 - damping) / n + damping * lost / n + damping * total).astype(real)
            err = float(np.bincount(cls, np.abs(new.astype(np.float64) - rank), minlength=1).sum())  # the classes' partial errors
            rank = new
            lost = float(rank[free].sum(dtype=np.float64))
            yield pa.RecordBatch.from_pydict({"t": [t], "id": [None], "value": [err], "dangling": [lost], "total": [float(rank.sum(dtype=np.float64))], "seconds": [time.perf_counter() - begun]}, RUN)
            if err < tol:
                break
        for a in range(0, n, 65_536):
            b = min(a + 65_536, n)
            none = pa.nulls(b - a, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int32)), pa.array(node[a:b]), pa.array(rank[a:b].astype(np.float64)), none, none, none], schema=RUN)

    return saved(both.repartition(1).mapInArrow(run, RUN_DDL))


def pagerank(graph: Graph, params: PageRankParams = PageRankParams(), hybrid: bool = False) -> tuple[DataFrame, PageRankStats, list[tuple[int, float, float, float]]]:
    """ranks(id, rank), statistics, and (iteration, error, dangling, sum) of every iteration.

    Graphs of a counted size up to TASK_EDGES edges are iterated over in one task. Beyond, one job an iteration: the edges lie in buckets by src and the
    state in as many by id, the new ranks are written to the shared folder, and the same job's observed sums give the error and the next dangling
    mass. The loop reads its state from files, so plans stay small and no executor holds the only copy of anything. The contributions are broadcast only
    up to BROADCAST_NODES nodes. hybrid: rows are told apart by class (params.host_share for the host), and the error is put together from the classes'
    partial errors; ranks are the same, and the statistics tell what the host class took."""
    n, dangling_nodes, m = graph.vertices.agg(F.count(F.lit(1)), F.count_if(F.col("out_deg") == 0), F.sum("in_deg")).first()
    if not n:
        raise ValueError("empty graph")
    vertices, host = graph.vertices.select("id", "out_deg", F.lit(0).alias("class")), (0, 0, 0)
    if hybrid:
        number = F.coalesce(*(F.when(F.col("class") == x, i) for i, x in enumerate(LABELS)))
        rows = classified(graph, params, params.host_share)
        vertices = saved(graph.vertices.select("id", "out_deg").join(rows.select("id", number.alias("class")), "id"))
        if params.host_share > 0:
            least = host_threshold(graph, params.host_share).first()
            taken = rows.filter("class = 'host'").agg(F.count(F.lit(1)), F.coalesce(F.sum("in_deg"), F.lit(0))).first()
            host = (taken[0], taken[1], least["min_len"] if taken[0] else 0)
    if m <= TASK_EDGES:
        out = _in_one_task(vertices, graph.edges, params)
        trace = sorted(tuple(r) for r in out.filter("t > 0").select("t", "value", "dangling", "total", "seconds").collect())
        ranks = out.filter("t = 0").select("id", F.col("value").cast(params.precision).alias("rank"))
        t, err, *_, seconds = trace[-1]
        return ranks, PageRankStats(t, err, seconds, err < params.tol, *host), [x[:4] for x in trace]
    edges = Bucketed(graph.edges.select("src", "dst"), "src")
    state = Bucketed(vertices.withColumn("rank", F.lit(1.0 / n).cast(params.precision)), "id")
    dangling, trace, err, converged, begun = dangling_nodes / n, [], float("inf"), False, time.perf_counter()
    for t in range(1, params.max_iters + 1):
        base = (1 - params.damping) / n + params.damping * dangling / n
        seen = Observation()
        rank = F.col("rank").cast("double")
        away = F.abs(rank - F.col("prev").cast("double"))
        partial = [F.coalesce(F.sum(F.when(F.col("class") == i, away)), F.lit(0.0)).alias(f"err{i}") for i in range(len(LABELS))]
        new = step(edges.rows, state.rows, base, params, n <= BROADCAST_NODES)
        new = new.observe(seen, *partial, F.sum(F.when(F.col("out_deg") == 0, rank).otherwise(0.0)).alias("dangling"), F.sum(rank).alias("total"))
        old, state = state, Bucketed(new.drop("prev"), "id")
        old.drop()
        err, dangling = sum(seen.get[f"err{i}"] for i in range(len(LABELS))), seen.get["dangling"]
        trace.append((t, err, dangling, seen.get["total"]))
        if err < params.tol:
            converged = True
            break
    edges.drop()
    state.drop()
    return state.plain().select("id", "rank"), PageRankStats(len(trace), err, time.perf_counter() - begun, converged, *host), trace


def rank_sum(ranks: DataFrame) -> float:
    """The sum of all ranks to 24 decimals; a plain sum of doubles depends on their order, by 1e-11 and more among a million nodes."""
    return float(ranks.agg(F.sum(F.col("rank").cast("decimal(38,24)"))).first()[0] or 0)


def top_k(ranks: DataFrame, k: int = 10, digits: int | None = None, alike: int | None = None) -> DataFrame:
    """The k highest ranks, smaller ids first among equals; without a full sort. digits rounds first, for comparisons across engines. With `alike`, ranks
    count as equal that agree to so many decimals of the mean rank, which doesn't depend on how many nodes there are, and stay unrounded."""
    if alike is not None:
        return ranks.select("id", "rank").orderBy(F.desc(F.round(F.col("rank") * ranks.count(), alike)), "id").limit(k)
    rank = F.col("rank") if digits is None else F.round("rank", digits)
    return ranks.select("id", rank.alias("rank")).orderBy(F.desc("rank"), "id").limit(k)
