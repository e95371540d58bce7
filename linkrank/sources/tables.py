"""Readers and writers of text formats, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import PageRankStats

RUN_LOG = "graph string, nodes long, edges long, build string, precision string, threads int, damping double, tolerance double, iterations int, converged int, seconds_total double, seconds_per_iter double, rank_sum double, cpu_share double, classes string"
# Fixed columns of the phase table.
PHASES = """graph string, precision string, cpu_share double, rep int, seconds_total double, iterations int,
iter_ms double, contrib_ms double, gpu_accumulate_ms double, copy_ms double, copy_mb double, copy_gbs double,
wait_copy_ms double, cpu_accumulate_ms double, back_ms double, back_mb double, scatter_ms double,
wait_gpu_ms double, upload_ms double, upload_mb double, download_ms double"""


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of whitespace-separated text, gzip by suffix; text after # is a comment, further columns are ignored, anything else is an error. A gzip
    file comes as one partition, so its rows are dealt out."""
    line = F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"\s+", " "))
    fields = F.split(line, " ")
    number = lambda i: F.coalesce(F.try_element_at(fields, F.lit(i)).try_cast("long"), F.raise_error(F.concat(F.lit("not an edge: "), F.col("value"))).cast("long"))
    rows = spark.read.text(path).filter(line != "").select(number(1).alias("src"), number(2).alias("dst"))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if path.rstrip("/").endswith(".gz") else rows


def read_ranks(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """id, rank of a dump; with `known`(id), the ids must be exactly these."""
    fields = F.split(F.trim("value"), r"\s+")
    ranks = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(fields[0].cast("long").alias("id"), fields[1].cast("double").alias("rank"))
    if known is not None:
        extra = ranks.join(known.select("id"), "id", "left_anti").limit(1).count()
        missing = known.select("id").join(ranks, "id", "left_anti").limit(1).count()
        if extra or missing or ranks.count() != known.count():
            raise ValueError(f"{path}: its ids are not those of the graph")
    return ranks


def write_ranks(ranks: DataFrame, path: str, header: dict[str, object]) -> None:
    """One text file in id order: `# key value` lines, then ids and ranks, which read back exactly."""
    head = ranks.sparkSession.createDataFrame([(i, f"# {k} {v}") for i, (k, v) in enumerate(header.items())], "at long, value string").select(F.lit(0).alias("part"), "at", "value")
    body = ranks.select(F.lit(1).alias("part"), F.col("id").alias("at"), F.concat_ws(" ", F.col("id").cast("string"), F.col("rank").cast("string")).alias("value"))
    head.unionByName(body).orderBy("part", "at").coalesce(1).select("value").write.text(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """A run log with line_no, its order in the file: the n-th row of a configuration is repetition n."""
    return spark.read.schema(RUN_LOG).option("header", True).option("enforceSchema", False).csv(path).coalesce(1).withColumn("line_no", F.monotonically_increasing_id())


def append_run(spark: SparkSession, path: str, graph: str, n: int, m: int, build: str, threads: int, params, stats: PageRankStats, rank_sum: float) -> None:
    """Adds a row to the log (a folder of CSV files, each with a header); a failure to write is an error."""
    row = (graph, n, m, build, params.precision, threads, params.damping, params.tol, stats.iterations, int(stats.converged), stats.seconds, stats.seconds / max(1, stats.iterations), rank_sum, params.host_share if build == "hybrid" else 1.0, class_label(params) if build == "hybrid" else None)
    spark.createDataFrame([row], RUN_LOG).coalesce(1).write.mode("append").option("header", True).csv(path)


def class_label(params) -> str:
    return f"{params.thread_max}/{params.warp_max}"


def write_phases(rows: DataFrame, path: str) -> None:
    """The phase table as CSV: missing values empty, numbers with four decimals as they are printed."""
    names = [c.split() for c in PHASES.replace("\n", " ").split(", ")]
    shown = [F.format_string("%.4f", n).alias(n) if t == "double" and n != "cpu_share" else F.col(n) for n, t in names]
    rows.select(*(F.when(F.col(n).isNotNull(), c).alias(n) for (n, _), c in zip(names, shown, strict=True))).write.option("header", True).csv(path)


def read_phases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PHASES).option("header", True).csv(path)


def report_lines(name: str, n: int, m: int, build: str, threads: int, params, stats: PageRankStats, rank_sum: float, top: list[tuple[int, int | None, float]]) -> list[str]:
    """The console report of a run, in the form that parse_report reads; top has (node, original id or None, rank)."""
    out = [f"graph      {name}", f"           {n} nodes, {m} edges", f"precision  {params.precision}", f"threads    {threads} ({build})"]
    if build == "hybrid":
        out.append(f"classes    {class_label(params)}; the host takes the longest rows, up to {100 * params.host_share:g}% of the edges")
    end = "converged" if stats.converged else "STOPPED at the iteration limit"
    out += [f"damping    {params.damping:g}, tolerance {params.tol:g}, max iterations {params.max_iters}", "", f"{end} after {stats.iterations} iterations (final L1 change {stats.error:.3e})"]
    out.append(f"time       {stats.seconds:.4f} s total, {stats.seconds / max(1, stats.iterations):.4f} s per iteration")
    if build == "hybrid":
        share = 100 * stats.host_edges / max(m, 1)
        out.append(f"cpu took   {stats.host_rows} rows of {stats.host_min_len} in-neighbours or more, {share:.1f}% of the edges" if stats.host_rows else "cpu took   no rows")
    out += [f"rank sum   {rank_sum:.12f}", "", f"top {len(top)} nodes:"]
    return out + [f"  {i:2d}. node {v:9d}{'' if orig is None else f'  SNAP id {orig:9d}'}   {x:.9f}" for i, (v, orig, x) in enumerate(top, 1)]


def parse_report(lines: DataFrame) -> DataFrame:
    """kind, key, value of a console report's lines(value): a row `top` for each ranked node (its original id if there is one), `sum`, and `converged` (true or
    false) and `iterations` from the line that tells both."""
    top, total, stop = r"^ *\d+\. node +(\d+)(?: +SNAP id +(\d+))? +(\S+)$", r"^rank sum +(\S+)$", r"^(converged|STOPPED) .*?(\d+) iterations "
    v = F.col("value")
    entry = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    node = F.coalesce(F.nullif(F.regexp_extract(v, top, 2), F.lit("")), F.regexp_extract(v, top, 1))
    found = (
        F.when(v.rlike(top), F.array(entry("top", node, F.regexp_extract(v, top, 3))))
        .when(v.rlike(total), F.array(entry("sum", F.lit(""), F.regexp_extract(v, total, 1))))
        .when(v.rlike(stop), F.array(entry("converged", F.lit(""), v.startswith("converged").cast("string")), entry("iterations", F.lit(""), F.regexp_extract(v, stop, 2))))
    )
    return lines.select(F.explode(found).alias("x")).select("x.*")


def report_names(files: DataFrame) -> DataFrame:
    """files(name, ..) with graph, precision, cpu_share, rep of names `graph-precision-sSHARE-rREP`, whatever their suffix; other names are left out."""
    pattern = r"^(.+)-(double|float)-s([0-9.]+)-r([0-9]+)(\.[a-z][a-z-]*)?$"
    part = lambda i: F.regexp_extract("name", pattern, i)
    return files.filter(F.col("name").rlike(pattern)).withColumns({"graph": part(1), "precision": part(2), "cpu_share": part(3).cast("double"), "rep": part(4).cast("int")})


def report_order(reports: DataFrame, graphs: DataFrame) -> DataFrame:
    """Reports in the order of the sweep: graphs(graph, first_line) as the log has them, others last, then share, precision and repetition."""
    return reports.join(F.broadcast(graphs.select("graph", "first_line")), "graph", "left").orderBy(F.asc_nulls_last("first_line"), "cpu_share", "precision", "rep").drop("first_line")
