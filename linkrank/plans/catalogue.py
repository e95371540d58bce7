"""The engine's queries over the test tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import benchlog, classes, graph, locality, pagerank, trace, verify
from ..params import PageRankParams
from .sql import RAW, SEQ, graph_sql, ranks_sql
from .stored import STORED
from .tables import mixed, part_seq, table

PARAMS = PageRankParams()


def mixed_graph(spark: SparkSession, d: str, keep: bool = False) -> graph.Graph:
    return graph.from_edges(mixed(spark, d), keep=keep)


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Events read as a run log: the event type is the graph, the user gives the configuration, the value the time."""
    u = F.col("user_id")
    build = F.when(u % 3 == 0, "seq").when(u % 3 == 1, "omp").otherwise("hybrid")
    return table(spark, d, "events").select(
        F.col("event_type").alias("graph"), build.alias("build"), F.lit("double").alias("precision"),
        F.when(build == "omp", F.expr("shiftleft(1, cast(user_id % 5 as int))")).otherwise(1).cast("int").alias("threads"),
        F.when(build == "hybrid", (u % 5) / F.lit(4.0)).otherwise(1.0).alias("cpu_share"), F.col("value").alias("seconds_total"),
        (u % 7).cast("int").alias("iterations"), F.col("event_id").alias("line_no"),
    )


RUNS = """select event_type graph, case user_id % 3 when 0 then 'seq' when 1 then 'omp' else 'hybrid' end build, 'double' "precision",
  case user_id % 3 when 1 then (1::bigint << (user_id % 5)::int)::int else 1 end threads, case user_id % 3 when 2 then (user_id % 5) / 4.0::double else 1.0::double end cpu_share,
  value seconds_total, (user_id % 7)::int iterations, event_id line_no from events"""
BEST = f"with r as ({RUNS}), best as (select graph, build, \"precision\", threads, cpu_share, min(seconds_total) as seconds, min(line_no) as first_line from r group by all)"
SHARES = [0.0, 0.25, 0.5, 0.75, 1.0]


def _ranks(spark, d, digits=10, raw=mixed, **params):
    ranks, _, _ = pagerank.pagerank(graph.from_edges(raw(spark, d), keep=True), PageRankParams(**params))
    return ranks.select("id", F.round(F.col("rank").cast("double"), digits).alias("rank"))


def _trace(spark, d):
    _, _, rows = pagerank.pagerank(mixed_graph(spark, d, True))
    return spark.createDataFrame([(t, round(e, 9), round(g, 9), round(s, 9)) for t, e, g, s in rows], "iteration int, error double, dangling double, rank_sum double")


def _stats(spark, d):
    _, s, rows = pagerank.pagerank(mixed_graph(spark, d, True))
    return spark.createDataFrame([(s.iterations, s.converged, round(rows[-1][3], 9))], "iterations int, converged boolean, rank_sum double")


def _state(spark, d):
    g = mixed_graph(spark, d, True)
    n = g.vertices.count()
    return g, g.vertices.select("id", "out_deg", F.lit(1.0 / n).alias("rank")), n


def _spmv(spark, d, split=False):
    g, state, n = _state(spark, d)
    contrib = pagerank.contributions(state)
    if split:
        sums = classes.split_gather(g.edges, contrib, classes.classified(g, PARAMS, 0.25))
    else:
        sums = pagerank.gather(g.edges, contrib, n <= pagerank.BROADCAST_NODES)
    return g.vertices.select("id").join(sums, "id", "left").select("id", F.round(F.coalesce("total", F.lit(0.0)), 10).alias("total"))


def _thresholds(spark, d):
    g, out = mixed_graph(spark, d, True), None
    for share in (0.0, 0.05, 0.25, 0.5, 1.0):
        row = classes.host_threshold(g, share).select(F.lit(share).alias("share"), "min_len", "host_edges")
        out = row if out is None else out.unionByName(row)
    return out


def _indexed(spark, d):
    return graph.indexed(mixed_graph(spark, d, True))[0]


def _lines(spark, d, size):
    g = _indexed(spark, d)
    return locality.distinct_lines(g.edges, g.vertices.count(), size)


def _two_ranks(spark, d):
    g = mixed_graph(spark, d, True)
    return tuple(pagerank.pagerank(g, PageRankParams(tol=0.0, max_iters=k))[0] for k in (10, 20))


def _max_diff(spark, d):
    a, b = _two_ranks(spark, d)
    a, b = (x.select("id", F.round("rank", 10).alias("rank")) for x in (a, b))
    w = verify.worst_difference(a, b)
    return w.select(F.round("max_diff", 10).alias("max_diff"), "at_id", "only_got", "only_want")


def _order(spark, d):
    a, b = _two_ranks(spark, d)
    o = verify.order_differences(a, b, 100, 10)
    return o.select("differing", "missing", F.round("worst_gap", 9).alias("worst_gap"), F.round("max_value_diff", 9).alias("max_value_diff"))


def _checks(spark, d):
    a, b = _two_ranks(spark, d)
    return verify.verify(a, b).select("check", "ok")


def _reference(spark, d):
    g = graph.from_edges(part_seq(spark, d), keep=True)
    want, name = verify.reference(g, PARAMS)
    got, stats, _ = pagerank.pagerank(g, PageRankParams(tol=1e-12, max_iters=200))
    return verify.verify(got, want, converged=stats.converged).filter("check = 'all_values'").select("check", "ok", F.lit(name).alias("against"))


def _hybrid(spark, d):
    return pagerank.pagerank(mixed_graph(spark, d, True), PageRankParams(host_share=0.25), hybrid=True)


def _hybrid_stats(spark, d):
    s = _hybrid(spark, d)[1]
    return spark.createDataFrame([(s.iterations, s.host_rows, s.host_edges, s.host_min_len)], "iterations int, host_rows long, host_edges long, host_min_len long")


def _calls(spark, d):
    """Events as calls of one trace per user: a purchase launches an iteration."""
    return table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), F.col("event_id").alias("correlationId"), "event_type", "value")


def _launch():
    return F.col("event_type") == "purchase"


def _phases(spark, d):
    rows = trace.segments(_calls(spark, d), _launch(), ["user_id"])
    kind = lambda t: F.col("event_type") == t
    return trace.phases(rows, ["user_id"], {
        "calls": F.count(F.lit(1)), "views": F.sum(F.when(kind("view"), F.col("value"))), "first_click": F.min(F.when(kind("click"), F.col("start"))) - F.min("start"),
        "largest": F.max_by("event_type", F.struct("value", "correlationId")),
    })


def _trace_join(spark, d):
    e = table(spark, d, "events")
    work = e.filter("event_type in ('click', 'view')").select(F.col("event_id").alias("correlationId"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1000).cast("long")).alias("end"))
    return trace.joined(_calls(spark, d), work).select("correlationId", "start", (F.col("w_end") - F.col("w_start")).alias("w_time"))


def _best(spark, d):
    return benchlog.best_per_config(runs(spark, d))


def _overwrite(spark, d):
    r = runs(spark, d)
    new = r.filter("graph = 'click' and build = 'hybrid' and cpu_share = 0.5").withColumn("seconds_total", F.round(F.col("seconds_total") * 2, 6)).withColumn("line_no", F.col("line_no") + 1_000_000)
    return benchlog.overwrite(r, new, ["click", "view"], ["seq", "hybrid"], [0.5])


def _match(spark, d):
    reps = benchlog.repetitions(runs(spark, d))
    reports = reps.filter("line_no % 10 <> 0").withColumn("iterations", F.when(F.col("line_no") % 11 == 0, -1).otherwise(F.col("iterations")))
    return benchlog.match_reports(runs(spark, d), reports)


def _rounded(df, *columns):
    return df.select(*(F.round(c, 9).alias(c) if c in columns else c for c in df.columns))


G = graph_sql()
BINS = "case when idg <= 16 then 'thread' when idg <= 256 then 'warp' else 'block' end"


INFO = """ select count(*) nodes, sum(idg)::bigint edges, count(*) filter (od = 0) dangling, count(*) filter (idg = 0) no_in_edges, max(idg) max_in_deg, max(od) max_out_deg,
  min(id) filter (idg = (select max(idg) from v)) max_in_node, """ + ", ".join(f"count(*) filter ({BINS} = '{b}') {b}_rows, coalesce(sum(idg) filter ({BINS} = '{b}'), 0)::bigint {b}_edges" for b in ("thread", "warp", "block")) + " from v"


def host_cte(share: float, name: str = "h") -> str:
    return f"""{name}a as (select idg len, sum(idg) e from v where idg > 0 group by 1), {name}c as (select *, sum(e) over (order by len desc) cum, sum(e) over () m from {name}a),
{name} as (select {share}::double share, coalesce(max(len) filter (cum > {share}::double*m) + 1, 1)::bigint min_len, coalesce(sum(e) filter (cum <= {share}::double*m), 0)::bigint host_edges from {name}c)"""


CLASS = f"c as (select id, idg, case when idg > 0 and idg >= (select min_len from h) then 'host' else {BINS} end class from v)"

#: name: (callable(spark, sf_dir), SQL or None)
CATALOGUE = {
    "edges_dedup": (lambda s, d: graph.unique_edges(part_seq(s, d)), f"select distinct s src, d dst from ({SEQ})"),
    "edge_stats": (
        lambda s, d: graph.edge_stats(part_seq(s, d)),
        f"select count(*) n_raw, count(distinct (s, d)) n_unique, count(*) filter (s = d) self_loops, count(*) - count(distinct (s, d)) duplicates_removed from ({SEQ})",
    ),
    "edge_stats_no_loops": (
        lambda s, d: graph.edge_stats(part_seq(s, d), True),
        f"select count(*) n_raw, count(distinct (s, d)) filter (s <> d) n_unique, count(*) filter (s = d) self_loops, count(*) filter (s <> d) - count(distinct (s, d)) filter (s <> d) duplicates_removed from ({SEQ})",
    ),
    "edges_drop_self_loops": (lambda s, d: graph.unique_edges(part_seq(s, d), True), f"select distinct s src, d dst from ({SEQ}) where s <> d"),
    "nodes_drop_self_loops": (
        lambda s, d: graph.from_edges(part_seq(s, d), True).vertices,
        f"""with raw as ({SEQ}), n as (select s id from raw union select d from raw), e as (select distinct s, d from raw where s <> d)
select id, (select count(*) from e where s = id)::bigint out_deg, (select count(*) from e where d = id)::bigint in_deg from n""",
    ),
    "node_remap": (lambda s, d: graph.renumbered(graph.nodes(mixed(s, d))), G + " select id, node::bigint node from v"),
    "in_degree": (lambda s, d: mixed_graph(s, d).vertices.select("id", "in_deg"), G + " select id, idg in_deg from v"),
    "out_degree": (lambda s, d: mixed_graph(s, d).vertices.select("id", "out_deg"), G + " select id, od out_deg from v"),
    "row_pointers": (lambda s, d: graph.row_pointers(graph.from_edges(part_seq(s, d))), graph_sql(SEQ) + " select node::bigint node, id, sum(idg) over (order by node)::bigint row_end from v"),
    "adjacency_rows": (
        lambda s, d: graph.adjacency(graph.from_edges(part_seq(s, d))).select("dst", F.concat_ws(",", "in_nbrs").alias("in_nbrs")),
        f"select d dst, string_agg(s::varchar, ',' order by s) in_nbrs from (select distinct s, d from ({SEQ})) group by 1",
    ),
    "rows_exploded": (lambda s, d: graph.adjacency(graph.from_edges(part_seq(s, d))).select(F.explode("in_nbrs").alias("src"), "dst"), f"select distinct s src, d dst from ({SEQ})"),
    "validate_graph": (
        lambda s, d: graph.validate(mixed_graph(s, d, True)),
        G + """ select * from (select unnest(['nodes_positive','row_end_is_edges','out_degrees_sum_to_edges','row_lengths_not_negative','sources_known','edges_unique']) "check",
  true ok, unnest([count(*), sum(idg)::bigint, sum(od)::bigint, min(idg), 0, 0]) measured from v)""",
    ),
    "graph_info": (lambda s, d: graph.graph_info(mixed_graph(s, d)), G + INFO),
    "row_class_histogram": (
        lambda s, d: classes.class_shares(classes.classified(mixed_graph(s, d), PARAMS), ("thread", "warp", "block")),
        G + f""", t as (select unnest(['thread','warp','block']) class), x as (select {BINS} class, count(*) r, sum(idg)::bigint e from v group by 1)
select class, coalesce(r, 0)::bigint "rows", coalesce(e, 0)::bigint edges, round(100.0::double*coalesce(r, 0)/sum(coalesce(r, 0)) over (), 6) rows_pct, round(100.0::double*coalesce(e, 0)/sum(coalesce(e, 0)) over (), 6) edges_pct from t left join x using (class)""",
    ),
    "degree_histogram": (lambda s, d: graph.degree_histogram(mixed_graph(s, d)), G + " select idg in_deg, count(*) n from v where idg > 0 group by 1"),
    "dangling_nodes": (lambda s, d: mixed_graph(s, d).vertices.filter("out_deg = 0").select("id"), G + " select id from v where od = 0"),
    "source_nodes": (lambda s, d: mixed_graph(s, d).vertices.filter("in_deg = 0").select("id"), G + " select id from v where idg = 0"),
    "contrib_once": (lambda s, d: pagerank.contributions(_state(s, d)[1]).select("src", F.round("contrib", 10).alias("contrib")), G + " select id src, round(1.0::double/nn/od, 10) contrib from v where od > 0"),
    "dangling_mass_once": (lambda s, d: pagerank.dangling_mass(_state(s, d)[1]).select(F.round("dangling", 10).alias("dangling")), G + " select round(coalesce(sum(1.0::double/nn) filter (od = 0), 0), 10) dangling from v"),
    "spmv_once": (_spmv, SPMV := G + " select id, round(coalesce(t, 0), 10) total from v left join (select e.d id, sum(1.0::double/w.nn/w.od) t from e join v w on w.id = e.s group by 1) using (id)"),
    "split_gather_equals_full": (lambda s, d: _spmv(s, d, True), SPMV),
    "pagerank_1": (lambda s, d: _ranks(s, d, tol=0.0, max_iters=1), ranks_sql(1) + " select id, round(r, 10) rank from pr where it = 1"),
    "pagerank_20": (lambda s, d: _ranks(s, d, tol=0.0, max_iters=20), ranks_sql(20) + " select id, round(r, 10) rank from pr where it = 20"),
    "pagerank_converged": (_ranks, ranks_sql() + " select id, round(r, 10) rank from pr where it = (select it from stop)"),
    "pagerank_damping_50": (lambda s, d: _ranks(s, d, damping=0.5), ranks_sql(damping=0.5) + " select id, round(r, 10) rank from pr where it = (select it from stop)"),
    "pagerank_cap_3": (lambda s, d: _ranks(s, d, max_iters=3), ranks_sql(3) + " select id, round(r, 10) rank from pr where it = 3"),
    "pagerank_float": (lambda s, d: _ranks(s, d, 5, part_seq, precision="float"), ranks_sql(raw=SEQ) + " select id, round(r, 5) rank from pr where it = (select it from stop)"),
    "pagerank_trace": (
        _trace,
        ranks_sql() + " select err.it::int iteration, round(l1, 9) error, round(sum(r) filter (od = 0), 9) dangling, round(sum(r), 9) rank_sum from err join pr using (it) join v using (id) where err.it <= (select it from stop) group by err.it, l1",
    ),
    "pagerank_stats": (_stats, ranks_sql() + " select it::int iterations, (select l1 < 1e-6 from err where err.it = stop.it) converged, (select round(sum(r), 9) from pr where pr.it = stop.it) rank_sum from stop"),
    "pagerank_topk": (lambda s, d: pagerank.top_k(_ranks(s, d), 10), ranks_sql() + " select id, round(r, 10) rank from pr where it = (select it from stop) order by 2 desc, 1 limit 10"),
    "host_threshold": (
        _thresholds,
        G + ", " + ", ".join(host_cte(x, f"h{i}") for i, x in enumerate((0.0, 0.05, 0.25, 0.5, 1.0))) + " " + " union all ".join(f"select share, min_len, host_edges from h{i}" for i in range(5)),
    ),
    "row_class_with_share": (
        lambda s, d: classes.classified(mixed_graph(s, d, True), PARAMS, 0.25).groupBy("class").agg(F.count(F.lit(1)).alias("rows"), F.sum("in_deg").alias("edges")),
        G + f', {host_cte(0.25)}, {CLASS} select class, count(*) "rows", sum(idg)::bigint edges from c group by 1',
    ),
    "group_rows": (lambda s, d: classes.grouped_rows(classes.classified(mixed_graph(s, d, True), PARAMS, 0.25)), G + f", {host_cte(0.25)}, {CLASS} select class, row_number() over (partition by class order by id) - 1 pos, id from c"),
    "host_predecessors": (
        lambda s, d: classes.host_predecessors((g := mixed_graph(s, d, True)).edges, classes.classified(g, PARAMS, 0.25)),
        G + f", {host_cte(0.25)}, {CLASS} select count(distinct s) predecessors, round(count(distinct s)::double/(select count(*) from v), 9) share from e join c on c.id = e.d where class = 'host'",
    ),
    "longest_row": (lambda s, d: graph.longest_row_share(mixed_graph(s, d)), G + " select round(100.0::double*max(idg)/sum(idg), 6) longest_row_pct from v"),
    "hybrid_ranks": (lambda s, d: _hybrid(s, d)[0].select("id", F.round("rank", 10).alias("rank")), ranks_sql() + " select id, round(r, 10) rank from pr where it = (select it from stop)"),
    "hybrid_stats": (
        _hybrid_stats,
        ranks_sql() + f", {host_cte(0.25)}, {CLASS} select (select it::int from stop) iterations, count(*) host_rows, coalesce(sum(idg), 0)::bigint host_edges, case when count(*) > 0 then (select min_len from h) else 0 end host_min_len from c where class = 'host'",
    ),
    "convert_stats": (
        lambda s, d: graph.convert_stats(part_seq(s, d)),
        f"select * from (select count(*) n_raw, count(distinct (s, d)) n_unique, count(*) filter (s = d) self_loops, count(*) - count(distinct (s, d)) duplicates_removed from ({SEQ})) x, ({graph_sql(SEQ)} {INFO}) y",
    ),
    "median_gap": (
        lambda s, d: locality.median_gap(_indexed(s, d).edges),
        G + ", i as (select a.node s, b.node d from e join v a on a.id = e.s join v b on b.id = e.d), g as (select s - lag(s) over (partition by d order by s) gap from i) select median(gap)::double median_gap from g where gap is not null",
    ),
    **{
        f"distinct_lines_{b}": (
            lambda s, d, b=b: _lines(s, d, b),
            G + f""", i as (select a.node s, b.node d from e join v a on a.id = e.s join v b on b.id = e.d), l as (select count(*) n from (select distinct d // 256, s >> {3 if b == 8 else 4} from i)), m as (select count(*) m from i), w as (select count(*) w from v)
select n lines, m edges, round(m::double/w, 9) mean_row, round(w*{b}/1048576.0::double, 9) contrib_mib, round(n::double/m, 9) lines_per_edge, round(m::double/n, 9) edges_per_line, round(n*64.0::double/1048576, 9) mib_per_iteration from l, m, w""",
        )
        for b in (8, 4)
    },
    "locality_lines_approx": (lambda s, d: locality.approximate_lines(_indexed(s, d).edges), None),
    "verify_max_diff": (_max_diff, ranks_sql(20) + ", q as (select id, abs(round(a.r, 10) - round(b.r, 10)) x from pr a join pr b using (id) where a.it = 10 and b.it = 20) select round(max(x), 10) max_diff, min(id) filter (x = (select max(x) from q)) at_id, 0::bigint only_got, 0::bigint only_want from q"),
    "verify_topk_order": (
        _order,
        ranks_sql(20) + """, k as (select it, id, round(r, 10) r, row_number() over (partition by it order by round(r, 10) desc, id) p from pr where it in (10, 20)),
a as (select * from k where it = 10 and p <= 100), b as (select * from k where it = 20 and p <= 100)
select count(*) filter (a.id <> b.id) differing, (select count(*) from a where id not in (select id from b)) missing,
  round(coalesce(max(abs(w.r - b.r)) filter (a.id <> b.id), 0), 9) worst_gap, round(max(abs(a.r - b.r)), 9) max_value_diff from a join b using (p) join (select id, r from pr where it = 20) w on w.id = a.id""",
    ),
    "verify_checks": (
        _checks,
        ranks_sql(20) + """, k as (select it, id, r, row_number() over (partition by it order by r desc, id) p from pr where it in (10, 20)), a as (select * from k where it = 10), b as (select * from k where it = 20),
t as (select a.id <> b.id x, abs(a.r - b.r) y, abs(w.r - b.r) g, a.id not in (select id from b where p <= 100) z from a join b using (p) join b w on w.id = a.id where p <= 100)
select 'converged' "check", true ok union all select 'top_order', count(*) filter (x) = 0 or (count(*) filter (z) = 0 and max(g) filter (x) <= 1e-8) from t union all select 'top_values', max(y) <= 1e-8 from t
union all select 'all_values', max(abs(a.r - b.r)) <= 1e-8 from a join b using (id) union all select 'rank_sum', abs(sum(r) - 1) <= 1e-6 from a""",
    ),
    "verify_dense": (
        lambda s, d: verify.dense_ranks(graph.from_edges(part_seq(s, d), keep=True)).select("id", F.round("rank", 10).alias("rank")),
        ranks_sql(60, raw=SEQ) + " select id, round(r, 10) rank from pr where it = 60",
    ),
    "verify_reference": (_reference, "select 'all_values' \"check\", true ok, 'dense' against"),
    "verify_rank_sum": (lambda s, d: _ranks(s, d, 15).agg((F.abs(F.sum("rank") - 1) <= 1e-6).alias("ok")), ranks_sql() + " select abs(sum(r) - 1) <= 1e-6 ok from pr where it = (select it from stop)"),
    "bench_min_per_config": (_best, BEST + " select * from best"),
    "bench_graph_order": (lambda s, d: benchlog.graph_order(runs(s, d)), f"select graph, min(line_no) first_line from ({RUNS}) group by 1"),
    "bench_pivot": (
        lambda s, d: benchlog.share_table(_best(s, d), SHARES),
        BEST + ", o as (select graph, \"precision\", min({'s': seconds, 't': threads}) b from best where build = 'omp' group by all) select graph, \"precision\", "
        + ", ".join(f"min(seconds) filter (build = 'hybrid' and cpu_share = {x}) share_{f'{x:g}'.replace('.', '_')}" for x in SHARES)
        + ", any_value(b.s) omp_seconds, any_value(b.t) omp_threads from best left join o using (graph, \"precision\") where build = 'hybrid' group by all",
    ),
    "bench_best_threads": (lambda s, d: benchlog.best_threads(_best(s, d), "first_line"), BEST + " select graph, \"precision\", min(seconds) omp_seconds, arg_min(threads, seconds) omp_threads from best where build = 'omp' group by all"),
    "bench_threads_measured": (lambda s, d: runs(s, d).filter("build = 'omp'").select("graph", "threads").distinct(), f"select distinct graph, threads from ({RUNS}) where build = 'omp'"),
    "bench_speedup_efficiency": (
        lambda s, d: _rounded(benchlog.speedups(_best(s, d)), "speedup", "efficiency").drop("first_line"),
        SPEED := BEST + ", q as (select graph, min(seconds) t1 from best where build = 'seq' group by 1) select graph, threads, round(t1/t, 9) speedup, round(t1/t/threads, 9) efficiency from (select graph, threads, min(seconds) t from best where build = 'omp' group by all) join q using (graph)",
    ),
    "bench_speedup_peak": (
        lambda s, d: benchlog.peak(_rounded(benchlog.speedups(_best(s, d)), "speedup"), "graph", "threads", "speedup", "first_line"),
        f"select graph, arg_max(threads, speedup) threads, max(speedup) speedup from ({SPEED}) group by 1",
    ),
    "bench_share_speedup": (
        lambda s, d: _rounded(benchlog.share_speedups(_best(s, d)), "speedup"),
        SHARE := BEST + ", h as (select graph, \"precision\", cpu_share, min(seconds) t from best where build = 'hybrid' group by all) select h.graph, h.\"precision\", h.cpu_share, round(b.t/h.t, 9) speedup from h join h b on b.graph = h.graph and b.\"precision\" = h.\"precision\" and b.cpu_share = 0",
    ),
    "bench_best_share": (
        lambda s, d: benchlog.best_share(_rounded(benchlog.share_speedups(_best(s, d)), "speedup")),
        TOP := f"select graph, \"precision\", case when max(speedup) > 1.01 then arg_max(cpu_share, {{'a': speedup, 'b': -cpu_share}}) end cpu_share, case when max(speedup) > 1.01 then max(speedup) end gain from ({SHARE}) group by all",
    ),
    "bench_real_gains": (
        lambda s, d: benchlog.real_gains(_rounded(benchlog.share_speedups(_best(s, d)), "speedup")),
        f"select graph, \"precision\", cpu_share, speedup from (select *, max(speedup) over (partition by graph, \"precision\") top from ({SHARE})) where top > 1.1",
    ),
    "bench_measured": (lambda s, d: benchlog.measured(_best(s, d), ["seq", "hybrid", "cuda"]), BEST + " select b build, b in (select build from best) measured from (select unnest(['seq', 'hybrid', 'cuda']) b)"),
    "bench_ns_per_edge": (
        lambda s, d: benchlog.ns_per_edge(runs(s, d).withColumn("edges", F.col("line_no") % 1000 + 1)).withColumn("ns_per_edge", F.round("ns_per_edge", 2)),
        f"select graph, build, \"precision\", threads, cpu_share, round(min(case when iterations > 0 then seconds_total*1e9::double/(iterations*(line_no % 1000 + 1)) end), 2) ns_per_edge from ({RUNS}) group by all",
    ),
    "bench_printed": (
        lambda s, d: benchlog.printed_table(benchlog.share_table(_best(s, d), SHARES)),
        BEST + ", o as (select graph, \"precision\", min({'s': seconds, 't': threads}) b from best where build = 'omp' group by all) select graph, \"precision\", "
        + ", ".join(f"coalesce(printf('%.4f', min(seconds) filter (build = 'hybrid' and cpu_share = {x})), '-') share_{f'{x:g}'.replace('.', '_')}" for x in SHARES)
        + ", coalesce(printf('%.4f', any_value(b.s)), '-') omp_seconds, coalesce(any_value(b.t)::varchar, '-') omp_threads from best left join o using (graph, \"precision\") where build = 'hybrid' group by all",
    ),
    "bench_formats": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", benchlog.decimal_comma(F.col("n_nationkey") / F.lit(7.0)).alias("comma"), benchlog.percent(F.col("n_nationkey") / F.lit(7.0)).alias("pct"), benchlog.shortest(F.col("n_nationkey") / F.lit(4.0)).alias("short")),
        "select n_nationkey, replace(printf('%.2f', n_nationkey/7.0::double), '.', ',') comma, printf('%.0f%%', n_nationkey/7.0::double*100) pct, regexp_replace(printf('%.6f', n_nationkey/4.0::double), '\\.?0+$', '') short from nation",
    ),
    "bench_stems": (
        lambda s, d: runs(s, d).select("line_no", benchlog.graph_stem(F.concat_ws("", F.lit("data/big.v2/"), "graph", F.lit(".csr"))).alias("stem")),
        "select event_id line_no, event_type stem from events",
    ),
    "bench_near_maxima": (
        lambda s, d: benchlog.near_maxima(benchlog.best_share(_rounded(benchlog.share_speedups(_best(s, d)), "speedup"), 0.0).withColumnRenamed("gain", "speedup"), 4.0),
        f"with p as ({TOP.replace('> 1.01', '> 0')}) select a.graph a, b.graph b, a.cpu_share q from p a join p b on a.cpu_share = b.cpu_share and a.graph < b.graph and abs(log2(a.gain/b.gain)) < 4.0",
    ),
    "bench_time_ratio": (
        lambda s, d: _rounded(benchlog.time_ratio(_best(s, d).filter("build = 'omp' and threads = 1"), _best(s, d).filter("build = 'seq'"), ["graph", "precision"]), "ratio"),
        BEST + " select graph, \"precision\", round(a.seconds/b.seconds, 9) ratio from best a join best b using (graph, \"precision\") where a.build = 'omp' and a.threads = 1 and b.build = 'seq'",
    ),
    "bench_selective_overwrite": (
        _overwrite,
        f"""with r as ({RUNS}) select * from r where not (graph in ('click', 'view') and build in ('seq', 'hybrid') and (build <> 'hybrid' or cpu_share = 0.5)) union all
select * replace (round(seconds_total*2, 6) as seconds_total, line_no + 1000000 as line_no) from r where graph = 'click' and build = 'hybrid' and cpu_share = 0.5""",
    ),
    "bench_rep_match": (
        _match,
        f"select count(*) filter (line_no % 10 <> 0) matched, count(*) filter (line_no % 10 = 0) without_report, 0::bigint without_run, count(*) filter (line_no % 10 <> 0 and line_no % 11 = 0) iteration_mismatch from ({RUNS})",
    ),
    "sweep_grid": (
        lambda s, d: benchlog.sweep(table(s, d, "region").select(F.col("r_name").alias("graph")), 3, benchlog.thread_list(6, 12), SHARES),
        """with b as (select 'seq' build, 1 threads, 1.0::double cpu_share, 'double' "precision" union all select 'omp', unnest([1, 2, 4, 6, 8, 12]), 1.0, 'double'
union all select 'hybrid', 1, unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double, 'double' union all select 'hybrid', 1, unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double, 'float')
select r_name graph, unnest([1, 2, 3]) rep, b.* from region, b""",
    ),
    "trace_join": (
        _trace_join,
        "select event_id \"correlationId\", epoch_us(ts) start, case when event_type in ('click', 'view') then round(value*1000)::bigint end w_time from events",
    ),
    "trace_segments": (
        lambda s, d: trace.segments(_calls(s, d), _launch(), ["user_id"]).select("correlationId", "user_id", "seg"),
        (SEGMENTS := "with c as (select *, epoch_us(ts) start, sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id) seg, sum((event_type = 'purchase')::int) over (partition by user_id) launches from events), g as (select * from c where launches >= 4 and seg between 2 and launches - 1)")
        + ' select event_id "correlationId", user_id, seg::bigint seg from g',
    ),
    "trace_phases": (
        lambda s, d: _rounded(_phases(s, d), "views"),
        (PHASES := SEGMENTS + ", p as (select user_id, seg::bigint seg, min(start) seg_start, count(*) calls, round(sum(value) filter (event_type = 'view'), 9) views, min(start) filter (event_type = 'click') - min(start) first_click, max({'v': value, 'i': event_id, 'e': event_type}).e largest from g group by all)")
        + " select *, lead(seg_start) over (partition by user_id order by seg) - seg_start iter_time from p",
    ),
    "trace_phase_medians": (
        lambda s, d: trace.phase_medians(_rounded(_phases(s, d), "views"), ["user_id"], ["calls", "views", "iter_time"]).select("user_id", "segments", "calls", F.round("views", 6).alias("views"), "iter_time"),
        PHASES + ", q as (select *, lead(seg_start) over (partition by user_id order by seg) - seg_start iter_time from p) select user_id, count(*) segments, median(calls)::double calls, round(median(views), 6) views, median(iter_time)::double iter_time from q group by 1",
    ),
    "trace_outer_transfers": (
        lambda s, d: _rounded(trace.outer_transfers(_calls(s, d), _launch(), ["user_id"], "value"), "before", "after"),
        "with m as (select *, min(ts) filter (event_type = 'purchase') over (partition by user_id) a, max(ts) filter (event_type = 'purchase') over (partition by user_id) b from events) select user_id, round(coalesce(sum(value) filter (ts < a), 0), 9) \"before\", round(coalesce(sum(value) filter (ts > b), 0), 9) \"after\" from m group by 1",
    ),
}
CATALOGUE |= STORED  # what is written and read back
