import math

import numpy as np
import pytest

from linkrank.__main__ import main
from linkrank.operators import benchlog, classes, graph, locality, pagerank, trace, verify
from linkrank.params import PageRankParams
from linkrank.plans import stored
from linkrank.scratch import Bucketed, scratch_dir
from linkrank.sources import csr, files, tables, trace_db

G5 = [(1, 0), (4, 0), (0, 1), (2, 1), (0, 2), (1, 2), (4, 2), (1, 3)]
G5_RANKS = [0.179992724774516, 0.351028561813352, 0.256489587813111, 0.155973619801018, 0.056515505798004]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def ranks_of(df):
    return {r["id"]: r["rank"] for r in df.collect()}


def dense(pairs, n, damping=0.85, iters=200):
    pairs = sorted(set(pairs))
    out = np.bincount([s for s, _ in pairs], minlength=n)
    r = np.full(n, 1 / n)
    for _ in range(iters):
        new = np.full(n, (1 - damping) / n + damping * r[out == 0].sum() / n)
        for s, d in pairs:
            new[d] += damping * r[s] / out[s]
        r = new
    return r


def test_worked_example(spark):
    ranks, stats, trace = pagerank.pagerank(graph.from_edges(edges(spark, G5), keep=True))
    got = ranks_of(ranks)
    assert stats.iterations == 15 and stats.converged and math.isclose(stats.error, 3.24287e-07, rel_tol=1e-4)
    assert np.allclose([got[i] for i in range(5)], G5_RANKS, atol=1e-12)
    assert all(abs(total - 1) < 1e-12 for *_, total in trace)
    assert [r["id"] for r in pagerank.top_k(ranks, 3).collect()] == [1, 2, 0]


def test_report_sum_doesnt_depend_on_the_order_of_summing(spark):
    """A million ranks: added one by one, they give 1.000000000008."""
    ranks = spark.range(0, 1_000_000, 1, 1).selectExpr("id", "1e-6D rank")
    assert f"{ranks.groupBy().sum('rank').first()[0]:.12f}" == "1.000000000008"
    assert f"{pagerank.rank_sum(ranks):.12f}" == "1.000000000000"
    assert f"{pagerank.rank_sum(ranks.limit(0)):.12f}" == "0.000000000000"


@pytest.mark.parametrize("nodes", [10, 10_000_000_000_000])
def test_report_tells_ranks_apart_in_graphs_of_any_size(spark, nodes):
    """Three ranks that differ, two of them by rounding alone, and a rank that isn't rounded on its way to the report."""
    mean = 1.0 / nodes
    rows = [(1, 1.2 * mean), (2, 1.3 * mean), (4, 1.4 * mean * (1 - 2e-16)), (3, 1.4 * mean * (1 - 4e-16)), (5, 1.1 * mean)]
    ranks = spark.createDataFrame(rows, "id long, rank double")
    ranks.count = lambda: nodes
    got = pagerank.top_k(ranks, 4, alike=9).collect()
    assert [r["id"] for r in got] == [3, 4, 2, 1] and all(r["rank"] == dict(rows)[r["id"]] for r in got)
    edge = spark.createDataFrame([(1, 0.30000000049999996), (2, 0.7)], "id long, rank double")  # to 13 decimals first, it would be 0.300000001 in nine
    assert [f"{r['rank']:.9f}" for r in pagerank.top_k(edge, alike=9).collect()] == ["0.700000000", "0.300000000"]


def test_cap_is_not_convergence(spark):
    _, stats, _ = pagerank.pagerank(graph.from_edges(edges(spark, G5), keep=True), PageRankParams(max_iters=3))
    assert stats.iterations == 3 and not stats.converged


@pytest.mark.parametrize("pairs", [[(7, 7)], [(1, 0), (2, 0)], [(0, 1), (1, 2), (2, 0)]])
def test_small_graphs_sum_to_one(spark, pairs):
    ranks, stats, _ = pagerank.pagerank(graph.from_edges(edges(spark, pairs), keep=True))
    assert stats.converged and math.isclose(sum(ranks_of(ranks).values()), 1, abs_tol=1e-12)


def test_against_dense_iteration_and_float(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (150, 2))] + [(i, 0) for i in range(40)]
    g = graph.from_edges(edges(spark, pairs + pairs[:20]), keep=True)
    got = ranks_of(pagerank.pagerank(g, PageRankParams(tol=1e-12, max_iters=500))[0])
    assert np.allclose([got[i] for i in range(40)], dense(pairs, 40), atol=1e-10)
    near = ranks_of(pagerank.pagerank(g, PageRankParams(precision="float"))[0])
    assert np.allclose([near[i] for i in range(40)], dense(pairs, 40), atol=1e-5)


def test_reference_ranks_of_a_graph_too_large_for_a_dense_matrix(spark, monkeypatch):
    """Rows that lie in many pieces, rows without entries, nodes without edges: without a dense matrix the ranks are the same."""
    rng = np.random.default_rng(5)
    pairs = [(int(a) * 7, int(b) * 7) for a, b in rng.integers(0, 60, (200, 2))] + [(i * 7, 0) for i in range(60)]
    g = graph.from_edges(edges(spark, [*pairs, (500, 500)]), drop_self_loops=True, keep=True)
    want = ranks_of(verify.dense_ranks(g))
    monkeypatch.setattr(verify, "DENSE_NODES", 10)
    monkeypatch.setattr(verify, "PIECE", 16)
    monkeypatch.setattr(verify.np, "zeros", lambda shape, *a, f=np.zeros, **k: f(shape, *a, **k) if np.isscalar(shape) else pytest.fail("a dense matrix"))
    got = ranks_of(verify.dense_ranks(g))
    assert len(got) == 61 and got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-14) for i in want)


def test_duplicates_and_loops(spark):
    raw = edges(spark, [(5, 9)] * 3 + [(9, 5)] + [(9, 9)] * 2)
    assert tuple(graph.edge_stats(raw).first()) == (6, 3, 2, 3)
    assert tuple(graph.edge_stats(raw, True).first()) == (6, 2, 2, 2)
    alone = graph.from_edges(edges(spark, [(7, 7)]), True)
    assert [tuple(r) for r in alone.vertices.select("id", "out_deg", "in_deg").collect()] == [(7, 0, 0)]


def test_renumbering_and_row_pointers(spark):
    g = graph.from_edges(edges(spark, [(1000000, 3), (3, 40)]))
    assert {r["id"]: r["node"] for r in graph.renumbered(g.vertices.select("id")).collect()} == {3: 0, 40: 1, 1000000: 2}
    g5 = graph.from_edges(edges(spark, G5))
    assert [r["row_end"] for r in graph.row_pointers(g5).orderBy("node").collect()] == [2, 4, 7, 8, 8]


def test_median_gap_keeps_the_last_gap(spark):
    assert locality.median_gap(edges(spark, [(0, 5), (0, 6), (5, 6)])).first()[0] == 5.0
    assert locality.median_gap(edges(spark, [(0, 1)])).first()[0] is None and locality.median_gap(edges(spark, [])).first()[0] is None


def test_edgeless_lines_are_null(spark):
    row = locality.distinct_lines(edges(spark, []), 0).first()
    assert row["lines"] == 0 and row["lines_per_edge"] is None


def test_host_threshold_like_a_loop(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b * b // 9)) for a, b in rng.integers(0, 30, (200, 2))})
    g = graph.from_edges(edges(spark, pairs))
    lengths = sorted(np.unique([d for _, d in pairs], return_counts=True)[1].tolist(), reverse=True)
    for share in (0.0, 0.1, 0.3, 0.7, 1.0):
        taken, least = 0, 1
        for n in sorted(set(lengths), reverse=True):
            if taken + n * lengths.count(n) > share * len(pairs):
                least = n + 1
                break
            taken += n * lengths.count(n)
        assert tuple(classes.host_threshold(g, share).first()) == (least, taken)


def test_hub_classes_keep_empty_bins(spark):
    g = graph.from_edges(edges(spark, [(i, 0) for i in range(1, 301)] + [(0, 1)]))
    rows = {r["class"]: r["rows"] for r in classes.class_shares(classes.classified(g, PageRankParams())).collect()}
    assert rows == {"host": 0, "thread": 300, "warp": 0, "block": 1}


def test_verify(spark):
    a = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "id long, rank double")
    b = spark.createDataFrame([(0, 0.5), (1, 0.2), (2, 0.3)], "id long, rank double")
    verify.demand(verify.verify(a, a, 3))
    failed = {r["check"] for r in verify.verify(b, a, 3).collect() if not r["ok"]}
    assert failed == {"top_order", "all_values"}
    with pytest.raises(AssertionError, match="all_values"):
        verify.demand(verify.verify(b, a, 3))


@pytest.mark.parametrize("bad", [{"damping": 1.0}, {"damping": math.nan}, {"max_iters": 0}, {"host_share": 1.5}, {"precision": "half"}])
def test_params_are_checked(bad):
    with pytest.raises(ValueError):
        PageRankParams(**bad)


def test_empty_graph(spark):
    with pytest.raises(ValueError, match="empty"):
        pagerank.pagerank(graph.from_edges(edges(spark, [])))


def test_edge_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n1\t2\n 3   4 9 # tail\n\n")
    assert sorted(map(tuple, tables.read_edges(spark, str(tmp_path / "a.txt")).collect())) == [(1, 2), (3, 4)]
    (tmp_path / "b.txt").write_text("1 x\n")
    with pytest.raises(Exception, match="not an edge"):
        tables.read_edges(spark, str(tmp_path / "b.txt")).collect()


def test_csr_round_trip_and_bad_files(spark, tmp_path):
    path = tmp_path / "g.csr"
    csr.write_csr(graph.from_edges(edges(spark, G5), keep=True), 5, str(path))
    good = path.read_bytes()
    assert np.frombuffer(good, "<u8", 6, 24).tolist() == [0, 2, 4, 7, 8, 8] and np.frombuffer(good, "<u4", 13, 72).tolist() == [1, 4, 0, 2, 0, 1, 4, 1, 2, 3, 1, 0, 2]
    for parts in (1, 3, 50):
        read = lambda columns="edges", p=parts: csr.read_csr(spark, str(path), columns, p)
        assert sorted(map(tuple, read().collect())) == sorted(G5)
        assert sorted(map(tuple, read("vertices").collect())) == [(0, 2, 2), (1, 2, 3), (2, 3, 1), (3, 1, 0), (4, 0, 2)]
        assert sorted(map(tuple, read("row_ptr").collect())) == [(0, 2), (1, 2), (2, 3), (3, 1), (4, 0)]
    swap = lambda at, data: good[:at] + data + good[at + len(data) :]
    u8 = lambda x: np.array([x], "<u8").tobytes()
    for bad in (b"X" + good[1:], good[:-1], good + b"\0", swap(8, u8(0)), swap(16, u8(2**40)), swap(24, u8(1)), swap(64, u8(7)), swap(32, u8(6)), swap(72, np.array([9], "<u4").tobytes())):
        path.write_bytes(bad)
        with pytest.raises(Exception):
            csr.read_csr(spark, str(path), partitions=2).collect()


def test_ids_file(spark, tmp_path):
    ids = spark.createDataFrame([(i, 10**12 - 7 * i) for i in range(500)], "node long, id long").repartition(3)
    csr.write_ids(ids, str(tmp_path / "ids"))
    assert np.fromfile(tmp_path / "ids", "<i8").tolist() == [10**12 - 7 * i for i in range(500)]
    assert sorted(map(tuple, csr.read_ids(spark, str(tmp_path / "ids"), 500).collect())) == sorted(map(tuple, ids.collect()))
    with pytest.raises(ValueError, match="not the ids"):
        csr.read_ids(spark, str(tmp_path / "ids"), 499)


@pytest.mark.parametrize("broadcast", [0, 10**6])
@pytest.mark.parametrize("precision", ["double", "float"])
def test_many_tasks_and_one_give_the_same(spark, monkeypatch, broadcast, precision):
    """The loop over bucketed tables, with a hub, against the loop in one task; nothing but partial sums and broadcasts is exchanged."""
    rng = np.random.default_rng(9)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (300, 2))} | {(i, 0) for i in range(1, 60)})
    g = graph.from_edges(edges(spark, pairs), keep=True)
    params = PageRankParams(precision=precision, host_share=0.3)
    one = pagerank.pagerank(g, params, hybrid=True)
    monkeypatch.setattr(pagerank, "TASK_EDGES", 0)
    monkeypatch.setattr(pagerank, "BROADCAST_NODES", broadcast)
    many = pagerank.pagerank(g, params, hybrid=True)
    a, b = ranks_of(one[0]), ranks_of(many[0])
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-5 if precision == "float" else 1e-12) for i in a)
    assert one[1].iterations == many[1].iterations and [x[0] for x in one[2]] == [x[0] for x in many[2]]
    assert all(math.isclose(x, y, rel_tol=1e-2 if precision == "float" else 1e-6, abs_tol=1e-12) for p, q in zip(one[2], many[2], strict=True) for x, y in zip(p[1:], q[1:], strict=True))
    stats = [(s.host_rows, s.host_edges, s.host_min_len) for s in (one[1], many[1])]
    lengths = np.bincount([d for _, d in pairs])
    long = lengths[lengths >= stats[0][2]]
    assert stats[0] == stats[1] and stats[0][:2] == (len(long), long.sum()) and 0 < long.sum() <= 0.3 * len(pairs)
    assert not spark.catalog.listTables()


def test_an_iteration_moves_partial_sums_alone(spark):
    g = graph.from_edges(edges(spark, G5), keep=True)
    e, state = Bucketed(g.edges, "src"), Bucketed(g.vertices.selectExpr("id", "out_deg", "0 class", "0.2D rank"), "id")
    plan = pagerank.step(e.rows.hint("merge"), state.rows.hint("merge"), 0.1, PageRankParams(), False)._jdf.queryExecution().executedPlan().toString()
    e.drop(), state.drop()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan[plan.index("Exchange") :]


def test_command_line(spark, tmp_path, capsys):
    """Text to a binary graph with its ids, a hybrid run over it, and its ranks verified under the original ids."""
    (tmp_path / "g.txt").write_text("".join(f"{10 * s}\t{10 * d}\n" for s, d in G5))
    path = f"{tmp_path}/g"
    main(["convert", f"{path}.txt", f"{path}.csr"])
    main(["info", f"{path}.csr"])
    main(["run", f"{path}.csr", "-i", f"{path}.ids", "-s", "0.4", "-b", "1,2", "-k", "3", "-o", f"{path}.ranks", "-c", f"{path}.log", "-t", "1e-12"])
    shown = capsys.readouterr().out
    assert "cpu took   1 rows of 3 in-neighbours or more, 37.5% of the edges" in shown and "1. node         1  SNAP id        10" in shown
    got = tables.parse_report(spark.createDataFrame([(x,) for x in shown.splitlines()], "value string")).collect()
    assert [(r["kind"], r["key"]) for r in got] == [("converged", ""), ("iterations", ""), ("sum", ""), ("top", "10"), ("top", "20"), ("top", "0")]
    main(["verify", f"{path}.csr", f"{path}.ranks", "-i", f"{path}.ids", "-k", "5"])
    main(["report", f"{path}.log"])
    shown = capsys.readouterr().out
    assert "reference: dense" in shown and "share_0_4" in shown
    log = tables.read_run_log(spark, f"{path}.log").first()
    assert (log["build"], log["classes"], log["cpu_share"]) == ("hybrid", "1/2", 0.4)
    with pytest.raises(SystemExit, match="no such graph"):
        main(["info", f"{path}.missing"])


def test_trace_file(spark, tmp_path):
    """Five iterations by hand: names cut at their version, a copy in place of a kernel with its correlation id, phases null where the host had no rows."""
    names = [(1, "cudaLaunchKernel_v7000"), (2, "cudaMemcpy_v3020"), (3, "cudaEventSynchronize_v3020"), (4, "cudaStreamSynchronize_v3020"), (5, "contrib_kernel"), (6, "gather_warp"), (7, "scatter_host_ranks")]
    calls, kernels, copies = [(0, 5, 2, 1)], [], [(1, 4, 1, 2_000_000, 1)]
    for i in range(5):
        t = 1000 * (i + 1)
        calls += [(t, t + 5, 1, 10 * t), (t + 10, t + 12, 1, 10 * t + 1), (t + 20, t + 25, 2, 10 * t + 2), (t + 60, t + 65, 2, 10 * t + 4), (t + 70, t + 72, 1, 10 * t + 5), (t + 80, t + 89, 4, 0)]
        calls += [(t + 30, t + 50, 3, -1)] if i % 2 else []
        kernels += [(t + 1, t + 8, 5, 10 * t), (t + 11, t + 18 + i, 6, 10 * t + 1), (t + 71, t + 75, 7, 10 * t + 5), (t + 21, t + 22, 6, 10 * t + 2)]
        copies += [(t + 21, t + 31, 2, 5_000, 10 * t + 2), (t + 61, t + 63, 1, 3_000, 10 * t + 4)]
    calls += [(9000, 9005, 2, 3)]
    copies += [(9001, 9007, 2, 10, 3)]
    trace_db.write_trace(f"{tmp_path}/t.sqlite", names, calls, kernels, copies)
    c, w = trace_db.read_trace(spark, f"{tmp_path}/t.sqlite")
    assert c.count() == len(calls) and w.count() == len({x[-1] for x in kernels + copies}) and c.filter(files.F.col("name").contains("_v")).isEmpty()
    rows = {r["seg"]: r.asDict() for r in trace.run_phases(c, w, []).collect()}
    assert sorted(rows) == [2, 3, 4]
    assert rows[2] == {"seg": 2, "iter_ms": 1e-3, "contrib_ms": 7e-6, "gpu_accumulate_ms": 8e-6, "copy_ms": 1e-5, "copy_mb": 5e-3, "copy_gbs": 500.0, "wait_copy_ms": 2e-5, "cpu_accumulate_ms": 1e-5, "back_ms": 2e-6, "back_mb": 3e-3, "scatter_ms": 4e-6, "wait_gpu_ms": 9e-6}
    assert rows[3]["copy_ms"] is None and rows[3]["scatter_ms"] is None and rows[3]["gpu_accumulate_ms"] == 9e-6
    s = trace.run_summary(c.selectExpr("'g' graph", "*"), w.selectExpr("'g' graph", "*"), ["graph"]).first()
    assert (s["iterations"], s["upload_ms"], s["upload_mb"], s["download_ms"], s["wait_gpu_ms"]) == (5, 3e-6, 2.0, 16e-6, 9e-6)


def test_trace_file_is_written_without_its_rows_on_the_driver(spark, tmp_path, monkeypatch):
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "collect", lambda self, f=frame.collect: rows if len(rows := f(self)) < 5 else pytest.fail("rows on the driver"))
    kinds = ["purchase", "view", "click", "signup", "error"]
    spark.range(40).selectExpr("id event_id", "timestamp_micros(id * 100) ts", f"array({str(kinds)[1:-1]})[id % 5] event_type", "id / 4 value").write.parquet(f"{tmp_path}/events.parquet")
    calls, work = trace_db.read_trace(spark, stored._trace_file(spark, str(tmp_path)))
    assert calls.count() == 40 and work.count() == 24 and work.filter("name = 'contrib_kernel'").agg({"start": "sum"}).toPandas().iloc[0, 0] == sum(100 * i + 2 for i in range(0, 40, 5))


def test_times_of_zero_and_equal_times(spark):
    """Over 0 a speed-up is infinite, of 0 and 0 not a number; among equals the earliest in the log counts, in the share table fewer threads."""
    rows = [("a", "hybrid", 1, 0.0, 3.0, 1), ("a", "hybrid", 1, 0.5, 0.0, 2), ("a", "hybrid", 1, 1.0, 6.0, 3), ("b", "hybrid", 1, 0.0, 0.0, 4), ("b", "hybrid", 1, 0.5, 0.0, 5)]
    rows += [("a", "seq", 1, 1.0, 4.0, 6), ("a", "omp", 4, 1.0, 2.0, 7), ("a", "omp", 1, 1.0, 2.0, 8), ("b", "seq", 1, 1.0, 0.0, 9), ("b", "omp", 8, 1.0, 0.0, 10), ("b", "omp", 2, 1.0, 1.0, 11)]
    log = spark.createDataFrame([(g, b, "double", t, c, s, n) for g, b, t, c, s, n in rows], "graph string, build string, precision string, threads int, cpu_share double, seconds_total double, line_no long")
    best = benchlog.best_per_config(log)
    curve = benchlog.share_speedups(best)
    speed = {(r["graph"], r["cpu_share"]): r["speedup"] for r in curve.collect()}
    assert (speed["a", 0.0], speed["a", 0.5], speed["a", 1.0]) == (1.0, math.inf, 0.5) and math.isnan(speed["b", 0.0]) and math.isnan(speed["b", 0.5])
    top = {r["graph"]: r for r in benchlog.best_share(curve).collect()}
    assert (top["a"]["cpu_share"], top["a"]["gain"]) == (0.5, math.inf) and top["b"]["cpu_share"] == 0.0
    assert benchlog.real_gains(curve).count() == 5
    peaks = {r["graph"]: r for r in benchlog.peak(benchlog.speedups(best), "graph", "threads", "speedup", "first_line").collect()}
    assert (peaks["a"]["threads"], peaks["a"]["speedup"], peaks["b"]["threads"]) == (4, 2.0, 8) and math.isnan(peaks["b"]["speedup"])
    assert {r["graph"]: r["omp_threads"] for r in benchlog.best_threads(best, "first_line").collect()} == {"a": 4, "b": 8}
    assert {r["graph"]: r["omp_threads"] for r in benchlog.share_table(best, [0.0]).collect()} == {"a": 1, "b": 8}


def test_report_puts_smaller_ids_first_among_ranks_that_rounding_tells_apart(spark, monkeypatch):
    ring = edges(spark, [(i, (i + 1) % 12) for i in range(12)])
    found = spark.createDataFrame([(i, 1 / 12 + (i % 3) * 1e-16) for i in range(12)], "id long, rank double")
    assert found.select("rank").distinct().count() > 1
    monkeypatch.setattr(stored, "mixed", lambda *_: ring)
    monkeypatch.setattr(stored.pagerank, "pagerank", lambda g: (found, stored.PageRankStats(1, 0.0, 0.0, True), [(1, 0.0, 0.0, 1.0)]))
    assert [r["key"] for r in stored._report(spark, "").filter("kind = 'top'").collect()] == [str(i) for i in range(10)]


def test_median_gap_across_spans(spark, monkeypatch):
    monkeypatch.setattr(locality, "SPAN", 4)
    monkeypatch.setattr(locality, "WIDTH", 3)
    rng = np.random.default_rng(11)
    for n in (1, 5, 60):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (n, 2))}, key=lambda p: (p[1], p[0]))
        want = [b[0] - a[0] for a, b in zip(pairs, pairs[1:], strict=False) if a[1] == b[1]]
        assert locality.median_gap(edges(spark, pairs)).first()[0] == (float(np.median(want)) if want else None)


def test_rows_of_the_thread_class_alone_need_no_lists(spark):
    g = graph.from_edges(edges(spark, G5), keep=True)
    assert classes.grouped_rows(classes.classified(g, PageRankParams())).count() == 0
    rows = classes.grouped_rows(classes.classified(g, PageRankParams(thread_max=1, warp_max=2))).collect()
    assert sorted(map(tuple, rows)) == [("block", 0, 2), ("thread", 0, 3), ("thread", 1, 4), ("warp", 0, 0), ("warp", 1, 1)]


def test_scratch_folder_on_a_cluster(spark, monkeypatch):
    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session())


def test_rank_dump_and_run_log(spark, tmp_path):
    ranks = spark.createDataFrame([(2, 0.1), (0, 1 / 3)], "id long, rank double")
    tables.write_ranks(ranks, str(tmp_path / "r"), {"nodes": 2})
    assert ranks_of(tables.read_ranks(spark, str(tmp_path / "r"), ranks)) == ranks_of(ranks)
    with pytest.raises(ValueError, match="not those"):
        tables.read_ranks(spark, str(tmp_path / "r"), ranks.limit(1))
    _, stats, _ = pagerank.pagerank(graph.from_edges(edges(spark, G5), keep=True))
    for _ in range(2):
        tables.append_run(spark, str(tmp_path / "log"), "g5.csr", 5, 8, "omp", 4, PageRankParams(), stats, 1.0)
    log = tables.read_run_log(spark, str(tmp_path / "log"))
    assert log.count() == 2 and log.first()["iterations"] == 15 and benchlog.repetitions(log).agg({"rep": "max"}).first()[0] == 2


def test_report_names(spark):
    names = ["g-x-double-s0.5-r10.nsys-rep", "g-x-double-s0.5-r2", "g-float-s1-r1.sqlite", "other.txt", "g_double_s0.5_r1"]
    got = tables.report_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert sorted(tuple(r)[1:] for r in got) == [("g", "float", 1.0, 1), ("g-x", "double", 0.5, 2), ("g-x", "double", 0.5, 10)]
    order = spark.createDataFrame([("machine10",), ("machine2",), ("laptop",)], "n string").orderBy(files.natural(files.F.col("n"))).collect()
    assert [r["n"] for r in order] == ["laptop", "machine2", "machine10"]
    assert benchlog.thread_list(6, 12) == [1, 2, 4, 6, 8, 12]
