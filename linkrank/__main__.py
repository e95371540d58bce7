"""Command line: convert, info, run and verify over edge lists or binary graphs; report over run logs."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import benchlog, graph, pagerank, verify
from .params import PageRankParams
from .sources import csr, files, tables


def classes(text: str) -> tuple[int, int]:
    thread, _, warp = text.partition(",")
    return int(thread), int(warp)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkrank")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("convert", "info", "run", "verify"):
        c = commands.add_parser(name)
        c.add_argument("graph", help="edge text, or a binary graph (.csr)")
        c.add_argument("--drop-self-loops", action="store_true")
        if name == "convert":
            c.add_argument("out", help="a .csr file, with original ids beside it, or a folder for edges and vertices as Parquet")
        else:
            c.add_argument("-i", "--ids", help="original ids of a binary graph")
        if name in ("run", "verify"):
            c.add_argument("-d", "--damping", type=float, default=0.85)
            c.add_argument("-t", "--tol", type=float, default=1e-6)
            c.add_argument("-m", "--max-iters", type=int, default=100)
            c.add_argument("-p", "--precision", default="double")
            c.add_argument("-k", "--top", type=int, default=10)
            c.add_argument("-s", "--share", type=float, help="share of the edges that the host class takes: rows are told apart by class")
            c.add_argument("-b", "--classes", type=classes, default=(16, 256), help="T,W: lengths up to which rows are of the thread and the warp class")
        if name == "run":
            c.add_argument("-o", "--ranks")
            c.add_argument("-c", "--log")
        if name == "verify":
            c.add_argument("ranks")
    commands.add_parser("report").add_argument("log")
    return top


def report(spark: SparkSession, log: str) -> None:
    best = benchlog.best_per_config(tables.read_run_log(spark, log).withColumn("graph", benchlog.graph_stem(F.col("graph"))))
    shares = sorted(r[0] for r in best.filter("build = 'hybrid'").select("cpu_share").distinct().collect())
    if shares:
        benchlog.printed_table(benchlog.share_table(best, shares)).show(1000, False)
    else:
        print("no hybrid runs yet")
    curve = benchlog.speedups(best)
    curve.select("graph", "threads", benchlog.decimal_comma(F.col("speedup")).alias("speedup"), benchlog.percent(F.col("efficiency")).alias("efficiency")).orderBy("graph", "threads").show(1000, False)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("linkrank").getOrCreate()
    if a.command == "report":
        return report(spark, a.log)
    if not files.exists(spark, a.graph):
        raise SystemExit(f"{a.graph}: no such graph")
    ids = None
    if a.graph.endswith(".csr"):
        g = csr.read_graph(spark, a.graph)
        ids = csr.read_ids(spark, a.ids, g.vertices.count()) if getattr(a, "ids", None) else None
        stats = graph.graph_info(g)
    else:
        raw = tables.read_edges(spark, a.graph)
        g = graph.from_edges(raw, a.drop_self_loops, keep=True)
        stats = graph.edge_stats(raw, a.drop_self_loops).join(graph.graph_info(g))
    if a.command in ("convert", "info"):
        stats.show(vertical=True)
    if a.command == "info":
        return None
    if a.command == "convert":
        if a.out.endswith(".csr"):
            numbered, ids = graph.indexed(g)
            csr.write_csr(numbered, ids.count(), a.out)
            csr.write_ids(ids, f"{a.out[:-4]}.ids")
        else:
            g.edges.repartition("src").sortWithinPartitions("src", "dst").write.parquet(f"{a.out}/edges")
            g.vertices.write.parquet(f"{a.out}/vertices")
        return None
    params = PageRankParams(a.damping, a.tol, a.max_iters, *a.classes, 0.5 if a.share is None else a.share, a.precision)
    ranks, stats, trace = pagerank.pagerank(g, params, a.share is not None)
    if a.command == "verify":
        want, name = verify.reference(g, params)
        print(f"reference: {name}")
        got = tables.read_ranks(spark, a.ranks, g.vertices) if ids is None else tables.read_ranks(spark, a.ranks, ids.select(F.col("orig_id").alias("id")))
        want = want if ids is None else csr.with_ids(want, ids).select(F.col("orig_id").alias("id"), "rank")
        verdicts = verify.verify(got, want, a.top, converged=stats.converged)
        verdicts.show(truncate=False)
        return verify.demand(verdicts)
    n, m = g.vertices.count(), g.edges.count()
    build, workers = "spark" if a.share is None else "hybrid", spark.sparkContext.defaultParallelism
    top = pagerank.top_k(ranks, a.top)
    named = top.withColumn("orig_id", F.lit(None).cast("long")) if ids is None else csr.with_ids(top, ids)
    rows = [(r["id"], r["orig_id"], r["rank"]) for r in named.orderBy(F.desc("rank"), "id").collect()]
    print(f"device     Spark {spark.version}, {workers} workers")
    print("\n".join(tables.report_lines(a.graph, n, m, build, workers, params, stats, trace[-1][3], rows)))
    if a.ranks:
        out = ranks if ids is None else csr.with_ids(ranks, ids).select(F.col("orig_id").alias("id"), "rank")
        tables.write_ranks(out, a.ranks, {"nodes": n, "edges": m, "build": build, "precision": params.precision, "damping": params.damping, "tolerance": params.tol, "iterations": stats.iterations, "converged": int(stats.converged), "rank_sum": trace[-1][3]})
    if a.log:
        tables.append_run(spark, a.log, a.graph, n, m, build, workers, params, stats, trace[-1][3])


if __name__ == "__main__":
    main()
