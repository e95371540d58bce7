"""Queries that write the engine's formats to the scratch folder and read them back, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import graph, pagerank, trace
from ..operators.benchlog import overwrite
from ..params import PageRankParams, PageRankStats
from ..scratch import saved, scratch_dir
from ..sources import csr, files, tables, trace_db
from .sql import RAW, SEQ, graph_sql, ranks_sql
from .tables import mixed, part_seq, table


def local_file(spark: SparkSession, name: str) -> str:
    """A file in a new scratch folder, for formats that tasks write by place; the folder must be mounted everywhere."""
    folder = scratch_dir(spark)
    files.touch(spark, [f"{folder}/{name}"])
    return f"{folder.removeprefix('file://')}/{name}"


def _edge_text(spark, d, compression, glob=""):
    """With comments, tabs, blanks and a third column."""
    path = scratch_dir(spark)
    e = part_seq(spark, d).withColumn("odd", F.col("src") % 2 == 1)
    line = F.when(F.col("odd"), F.concat_ws("\t", "src", "dst")).otherwise(F.concat(F.lit("  "), F.col("src").cast("string"), F.lit("   "), F.col("dst").cast("string"), F.lit(" 7 # seen")))
    spark.range(3).select(F.concat(F.lit("# line "), F.col("id").cast("string")).alias("value")).unionByName(e.select(line.alias("value"))).write.option("compression", compression).text(path)
    return tables.read_edges(spark, path + glob)


def _seq_csr(spark, d, raw=part_seq):
    """A graph's file, its node numbers and how many there are."""
    g, ids = graph.indexed(graph.from_edges(raw(spark, d), keep=True))
    n, path = ids.count(), local_file(spark, "g.csr")
    csr.write_csr(g, n, path)
    return path, ids, n


def _csr(columns):
    return lambda spark, d: csr.read_csr(spark, _seq_csr(spark, d)[0], columns)


def _ids(spark, d):
    _, ids, n = _seq_csr(spark, d)
    path = local_file(spark, "g.ids")
    csr.write_ids(ids, path)
    return csr.read_ids(spark, path, n)


def _csr_ranks(spark, d):
    path, ids, n = _seq_csr(spark, d)
    names = local_file(spark, "g.ids")
    csr.write_ids(ids, names)
    ranks = pagerank.pagerank(csr.read_graph(spark, path))[0]
    return csr.with_ids(ranks, csr.read_ids(spark, names, n)).select(F.col("orig_id").alias("id"), F.round("rank", 10).alias("rank"))


#: Where bytes of a small file's copy are changed, and to what; None cuts or adds one.
DEFECTS = {
    "none": (0, b""), "magic": (0, b"X"), "truncated": (None, -1), "too_long": (None, 1), "no_nodes": (8, (0).to_bytes(8, "little")), "huge_edges": (16, (2**40).to_bytes(8, "little")),
    "first_pointer": (24, (1).to_bytes(8, "little")), "last_pointer": (64, (7).to_bytes(8, "little")), "falling_pointer": (32, (6).to_bytes(8, "little")), "unknown_source": (72, (9).to_bytes(4, "little")),
}
SMALL = [(1, 0), (4, 0), (0, 1), (2, 1), (0, 2), (1, 2), (4, 2), (1, 3)]


def _rejects(spark, d):
    """Each defect of a file and whether reading it fails."""
    path = local_file(spark, "small.csr")
    csr.write_csr(graph.from_edges(spark.createDataFrame(SMALL, "src long, dst long"), keep=True), 5, path)
    with open(path, "rb") as f:
        good = f.read()
    out = []
    for name, (at, data) in DEFECTS.items():
        bad = (good[:-1] if data < 0 else good + b"\0") if at is None else good[:at] + data + good[at + len(data) :]
        copy = local_file(spark, f"{name}.csr")
        with open(copy, "wb") as f:
            f.write(bad)
        try:
            out.append((name, csr.read_csr(spark, copy, partitions=2).count() != len(SMALL)))
        except Exception:
            out.append((name, True))
    return spark.createDataFrame(out, "defect string, rejected boolean")


def _rank_dump(spark, d):
    ranks, stats, rows = pagerank.pagerank(graph.from_edges(part_seq(spark, d), keep=True))
    path = scratch_dir(spark)
    tables.write_ranks(ranks, path, {"nodes": ranks.count(), "iterations": stats.iterations, "rank_sum": rows[-1][3]})
    return tables.read_ranks(spark, path, ranks).select("id", F.round("rank", 10).alias("rank"))


def _report(spark, d):
    """The console report of a run, and what is read out of it. Ranks that only the order of summing tells apart count as equal, so the smaller ids go first."""
    g = graph.from_edges(mixed(spark, d), keep=True)
    ranks, stats, _ = pagerank.pagerank(g)
    best = saved(pagerank.top_k(ranks, alike=9))
    node = {r["id"]: r["node"] for r in graph.renumbered(ranks.select("id")).join(best.select("id"), "id").collect()}
    top = [(node[r["id"]], r["id"], r["rank"]) for r in best.collect()]
    lines = tables.report_lines("mixed", ranks.count(), g.edges.count(), "spark", 8, PageRankParams(), stats, pagerank.rank_sum(ranks), top)
    path = scratch_dir(spark)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return tables.parse_report(spark.read.text(path))


def _run_log(spark, d):
    path = scratch_dir(spark)
    for key, name in sorted(map(tuple, table(spark, d, "region").select("r_regionkey", "r_name").collect())):  # 5 rows
        stats = PageRankStats(key + 1, 1e-7, 2.0 * (key + 1), True)
        tables.append_run(spark, path, f"data/{name}.csr", key, 2 * key, "hybrid" if key % 2 else "omp", 4, PageRankParams(host_share=0.25), stats, 1.0)
    return tables.read_run_log(spark, path).select("graph", "nodes", "edges", "build", "iterations", "converged", "seconds_per_iter", "cpu_share", "classes")


def _log_replaced(spark, d):
    """A log whose rows of one region are measured again, in place."""
    schema = "graph string, build string, cpu_share double, seconds_total double"
    rows = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("graph"), F.lit("hybrid").alias("build"), (F.col("n_nationkey") % 5 / 4).alias("cpu_share"), F.col("n_nationkey").cast("double").alias("seconds_total"))
    path = scratch_dir(spark)
    rows.write.option("header", True).csv(path)
    old = spark.read.schema(schema).option("header", True).csv(path)
    new = old.filter("graph = '1' and cpu_share = 0.5").withColumn("seconds_total", F.col("seconds_total") + 100)
    return files.replaced(spark, path, overwrite(old, new, ["1", "9"], ["hybrid", "seq"], [0.50]), schema)


def _report_files(spark, d):
    """Empty report files, and others, below a new folder."""
    folder = scratch_dir(spark)
    names = [r[0].lower().replace(" ", "-") for r in table(spark, d, "region").select("r_name").collect()]
    made = [f"{n}-{p}-s{s:g}-r{r}.nsys-rep" for n in names for p in ("double", "float") for s in (0.0, 0.5) for r in (1, 2, 10)]
    files.touch(spark, [f"{folder}/{n}" for n in [*made, "notes.txt", "asia-half-s0.5-r1.nsys-rep"]])
    return folder, made


def _report_listing(spark, d):
    folder, _ = _report_files(spark, d)
    order = table(spark, d, "region").filter("r_regionkey > 0").select(F.lower(F.regexp_replace("r_name", " ", "-")).alias("graph"), (-F.col("r_regionkey")).alias("first_line"))
    found = tables.report_order(tables.report_names(files.listed(spark, folder)), order)
    rows = [(i, r["graph"], r["precision"], r["cpu_share"], r["rep"]) for i, r in enumerate(found.collect())]
    return spark.createDataFrame(rows, "place int, graph string, precision string, cpu_share double, rep int")


def _reports_deleted(spark, d):
    folder, made = _report_files(spark, d)
    gone = files.remove(spark, [f"{folder}/{n}" for n in made if "-s0.5-" in n and n.startswith("asia-")] + [f"{folder}/missing"])
    left = files.listed(spark, folder).agg(F.count(F.lit(1)).alias("left_over")).first()[0]
    whole = files.remove(spark, [folder])
    return spark.createDataFrame([(gone, left, whole, files.exists(spark, folder))], "gone int, left_over long, whole int, there boolean")


def _machines(spark, d):
    folder = scratch_dir(spark)
    numbers = [r[0] for r in table(spark, d, "region").select("r_regionkey").collect()]
    files.touch(spark, [f"{folder}/machine{1 + 3 * k}/bench.csv" for k in numbers] + [f"{folder}/laptop/bench.csv", f"{folder}/machine99/other.csv"])
    rows = [(i, *r) for i, r in enumerate(files.measured_machines(spark, folder).collect())]
    return spark.createDataFrame(rows, "place int, folder string, label string")


def _trace_file(spark, d):
    """Events as a profiler's trace: a purchase starts an iteration, views are kernels, clicks are copies, signups and errors are waits. Some copies have
    a kernel with their correlation id beside them."""
    names = {1: "cudaLaunchKernel_v7000", 2: "cudaMemcpyAsync_v3020", 3: "cudaMemcpy_v3020", 4: "cudaEventSynchronize_v3020", 5: "cudaStreamSynchronize_v3020", 10: "contrib_kernel", 11: "accumulate_thread", 12: "gather_block", 13: "scatter_host_ranks"}
    e = table(spark, d, "events").select(F.col("event_id").alias("c"), F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), F.col("event_type").alias("k"), F.round(F.col("value") * 100).cast("long").alias("v"))
    c, s, k, v = (F.col(x) for x in "cskv")
    row = lambda table, *fields: F.struct(F.lit(table).alias("table"), *(F.lit(x).cast("long").alias(n) for x, n in zip((*fields, None), "abcde")))  # noqa: E731, B905
    name = F.when(k.isin("purchase", "view"), 1).when(k == "signup", 4).when(k == "error", 5).when(c % 5 == 0, 3).otherwise(2)
    kernel = F.when(k == "purchase", row("kernels", s + 2, s + 40 + c % 11, 10, c)).when(k == "view", row("kernels", s + 1, s + 9 + c % 13, 11 + c % 3, c)).when((k == "click") & (c % 4 == 0), row("kernels", s + 1, s + 5, 11, c))
    copy = F.when(k == "click", row("memcpys", s + 1, s + 2 + v % 17, 1 + c % 3 % 2, v, c))
    rows = e.select(F.explode(F.array_compact(F.array(row("calls", s, s + 3 + c % 7, name, c), kernel, copy))).alias("x")).select("x.*")
    path = local_file(spark, "trace.sqlite")
    trace_db.save_trace(path, list(names.items()), rows)
    return path


def _trace(spark, d):
    calls, work = trace_db.read_trace(spark, _trace_file(spark, d))
    run = F.lit("mixed").alias("graph")
    return saved(calls.select(run, "*")), saved(work.select(run, "*"))


def _phases(spark, d):
    rows = trace.run_phases(*_trace(spark, d), ["graph"])
    return rows.select("seg", *(F.round(c, 6).alias(c) for c in trace.PHASE_COLUMNS))


def _phase_table(spark, d):
    """The run's summary, written as the phase table and read back."""
    found = trace.run_summary(*_trace(spark, d), ["graph"])
    path = scratch_dir(spark)
    given = found.select("*", F.lit("double").alias("precision"), F.lit(0.5).alias("cpu_share"), F.lit(1).alias("rep"), F.lit(None).cast("double").alias("seconds_total")).withColumn("iterations", F.col("iterations").cast("int"))
    tables.write_phases(given.coalesce(1), path)
    return tables.read_phases(spark, path).select("graph", "precision", "cpu_share", "rep", "seconds_total", "iterations", *(F.round(c, 3).alias(c) for c in [*trace.PHASE_COLUMNS, "upload_ms", "upload_mb", "download_ms"]))


TRACE = """with t as (select event_id c, epoch_us(ts) s, event_type k, round(value*100)::bigint v from events),
j as (select c, s, s + 3 + c % 7 e, case when k in ('purchase', 'view') then 'cudaLaunchKernel' when k = 'signup' then 'cudaEventSynchronize' when k = 'error' then 'cudaStreamSynchronize'
    when c % 5 = 0 then 'cudaMemcpy' else 'cudaMemcpyAsync' end n,
  case k when 'purchase' then 'contrib_kernel' when 'view' then ['accumulate_thread', 'gather_block', 'scatter_host_ranks'][1 + (c % 3)::int] when 'click' then ['H2D', 'D2H'][1 + (c % 3 % 2)::int] end op,
  case k when 'purchase' then s + 2 when 'view' then s + 1 when 'click' then s + 1 end os, case k when 'purchase' then s + 40 + c % 11 when 'view' then s + 9 + c % 13 when 'click' then s + 2 + v % 17 end oe,
  case when k = 'click' then v when k in ('purchase', 'view') then 0 end b from t),
g as (select *, sum((op = 'contrib_kernel')::int) over (order by s, c) seg, sum((op = 'contrib_kernel')::int) over () launches from (select * replace (coalesce(op, '') as op) from j)),
l as (select seg - 1 seg, os nxt from g where op = 'contrib_kernel'),
a as (select seg, max(os) filter (op = 'contrib_kernel') begun, max(oe - os) filter (op = 'contrib_kernel') contrib,
  coalesce(max(oe) filter (b = 0 and (op like 'accumulate%' or op like 'gather%')) - min(os) filter (b = 0 and (op like 'accumulate%' or op like 'gather%')), 0) gathered,
  max({'b': b, 's': -s, 'ns': oe - os}) filter (op = 'D2H') cp, min({'s': s, 'c': c, 'e': e}) filter (n = 'cudaEventSynchronize') w, min({'s': s, 'c': c, 'ns': oe - os, 'b': b}) filter (op = 'H2D') h,
  max({'s': s, 'c': c, 'ns': oe - os}) filter (b = 0 and op = 'scatter_host_ranks') x, min({'s': s, 'c': c, 'ns': e - s}) filter (n = 'cudaStreamSynchronize') y
  from g where launches >= 4 and seg between 2 and launches - 1 group by seg),
p as (select seg::bigint seg, (nxt - begun)/1e6::double iter_ms, contrib/1e6::double contrib_ms, gathered/1e6::double gpu_accumulate_ms,
  case when w is not null then cp.ns/1e6::double end copy_ms, case when w is not null then cp.b/1e6::double end copy_mb, case when w is not null then cp.b::double/cp.ns end copy_gbs,
  case when w is not null then (w.e - w.s)/1e6::double end wait_copy_ms, case when w is not null then (h.s - w.e)/1e6::double end cpu_accumulate_ms, case when w is not null then h.ns/1e6::double end back_ms,
  case when w is not null then h.b/1e6::double end back_mb, case when w is not null then x.ns/1e6::double end scatter_ms, y.ns/1e6::double wait_gpu_ms from a join l using (seg))"""
CSR = graph_sql(SEQ) + ", i as (select a.node s, b.node d from e join v a on a.id = e.s join v b on b.id = e.d)"
SEQ_RANKS = ranks_sql(raw=SEQ) + " select id, round(r, 10) rank from pr where it = (select it from stop)"
REGION = "lower(replace(r_name, ' ', '-'))"

#: name: (callable(spark, sf_dir), SQL)
STORED = {
    "edge_text_scan": (lambda s, d: _edge_text(s, d, "none"), f"select s src, d dst from ({SEQ})"),
    "edge_gzip_scan": (lambda s, d: _edge_text(s, d, "gzip", "/*.gz"), f"select s src, d dst from ({SEQ})"),
    "csr_edges": (_csr("edges"), CSR + " select s::bigint src, d::bigint dst from i"),
    "csr_vertices": (_csr("vertices"), CSR + " select node::bigint id, idg in_deg, od out_deg from v"),
    "csr_row_lengths": (_csr("row_ptr"), CSR + " select node::bigint id, idg in_deg from v"),
    "csr_ids": (_ids, CSR + " select node::bigint node, id orig_id from v"),
    "csr_info": (
        lambda s, d: graph.graph_info(csr.read_graph(s, _seq_csr(s, d)[0])).select("nodes", "edges", "dangling", "no_in_edges", "max_in_deg", "max_out_deg", "max_in_node", "thread_rows"),
        CSR + " select count(*) nodes, sum(idg)::bigint edges, count(*) filter (od = 0) dangling, count(*) filter (idg = 0) no_in_edges, max(idg) max_in_deg, max(od) max_out_deg, min(node) filter (idg = (select max(idg) from v)) max_in_node, count(*) filter (idg <= 16) thread_rows from v",
    ),
    "csr_ranks_with_ids": (_csr_ranks, SEQ_RANKS),
    "csr_rejects": (_rejects, f"select unnest({list(DEFECTS)}) defect, unnest({[str(x != 'none').lower() for x in DEFECTS]})::boolean rejected"),
    "rank_dump_scan": (_rank_dump, SEQ_RANKS),
    "console_report": (
        _report,
        ranks_sql(raw=RAW) + """, z as (select id, r from pr where it = (select it from stop))
select 'top' kind, id::varchar "key", printf('%.9f', r) "value" from (select * from z order by r desc, id limit 10) union all select 'sum', '', printf('%.12f', sum(r)) from z
union all select 'converged', '', (select (l1 < 1e-6)::varchar from err where err.it = stop.it) from stop union all select 'iterations', '', it::varchar from stop""",
    ),
    "run_log_scan": (
        _run_log,
        """select 'data/' || r_name || '.csr' graph, r_regionkey::bigint nodes, 2*r_regionkey::bigint edges, case when r_regionkey % 2 = 1 then 'hybrid' else 'omp' end build, (r_regionkey + 1)::int iterations, 1 converged,
  2.0::double seconds_per_iter, case when r_regionkey % 2 = 1 then 0.25 else 1.0 end::double cpu_share, case when r_regionkey % 2 = 1 then '16/256' end classes from region""",
    ),
    "run_log_replaced": (
        _log_replaced,
        "select n_regionkey::varchar graph, 'hybrid' build, (n_nationkey % 5)/4.0::double cpu_share, n_nationkey::double + case when n_regionkey = 1 and n_nationkey % 5 = 2 then 100 else 0 end seconds_total from nation",
    ),
    "report_listing": (
        _report_listing,
        f"""with f as (select {REGION} graph, r_regionkey k, p "precision", s::double cpu_share, r rep from region, (select unnest(['double', 'float']) p), (select unnest([0.0, 0.5]) s), (select unnest([1, 2, 10]) r))
select (row_number() over (order by k = 0, -k, cpu_share, "precision", rep) - 1)::int place, graph, "precision", cpu_share, rep from f""",
    ),
    "report_deletion": (_reports_deleted, "select 6 gone, (select count(*)*12 + 2 - 6 from region) left_over, 1 whole, false there"),
    "machine_listing": (
        _machines,
        """select (row_number() over (order by k) - 1)::int place, folder, label from (select -1 k, 'laptop' folder, 'laptop' label union all select r_regionkey, 'machine' || (1 + 3*r_regionkey), 'Machine ' || (1 + 3*r_regionkey) from region)""",
    ),
    "trace_db_phases": (_phases, TRACE + " select seg, " + ", ".join(f"round({c}, 6) {c}" for c in trace.PHASE_COLUMNS) + " from p"),
    "trace_phase_table": (
        _phase_table,
        TRACE + f""", q as (select {', '.join(f"median({c}) {c}" for c in trace.PHASE_COLUMNS)} from p), m as (select min(s) filter (op = 'contrib_kernel') f, max(s) filter (op = 'contrib_kernel') l from g),
o as (select coalesce(sum(oe - os) filter (s < f and op = 'H2D'), 0)/1e6::double upload_ms, coalesce(sum(b) filter (s < f and op = 'H2D'), 0)/1e6::double upload_mb, coalesce(sum(oe - os) filter (s > l and op = 'D2H'), 0)/1e6::double download_ms
  from g, m where n = 'cudaMemcpy')
select 'mixed' graph, 'double' "precision", 0.5::double cpu_share, 1 rep, null::double seconds_total, (select max(launches) from g)::int iterations, """
        + ", ".join(f"round(round({c}, 4), 3) {c}" for c in [*trace.PHASE_COLUMNS, "upload_ms", "upload_mb", "download_ms"]) + " from q, o",
    ),
}
