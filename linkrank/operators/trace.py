"""Analytics over execution traces: calls joined with the work they start, cut into iterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined(calls: DataFrame, work: DataFrame) -> DataFrame:
    """Each call with the operations that carry its correlation id, if any."""
    return calls.join(work.withColumnsRenamed({"start": "w_start", "end": "w_end"}), "correlationId", "left")


def segments(calls: DataFrame, launch: Column, keys: list[str]) -> DataFrame:
    """Complete iterations alone: seg counts launches so far; what stands before the second launch or after the last one goes. A trace of fewer than
    4 launches has no segment."""
    order = Window.partitionBy(*keys).orderBy("start", "correlationId")
    whole = Window.partitionBy(*keys)
    flagged = calls.withColumn("is_launch", launch.cast("int"))
    cut = flagged.withColumn("seg", F.sum("is_launch").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("launches", F.sum("is_launch").over(whole))
    return cut.filter((F.col("launches") >= 4) & (F.col("seg") >= 2) & (F.col("seg") <= F.col("launches") - 1))


def phases(rows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """A row per segment: its measures, and iter_time up to the next segment's start (null for the last)."""
    out = rows.groupBy(*keys, "seg").agg(F.min("start").alias("seg_start"), *(c.alias(n) for n, c in measures.items()))
    return out.withColumn("iter_time", F.lead("seg_start").over(Window.partitionBy(*keys).orderBy("seg")) - F.col("seg_start"))


def phase_medians(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"), *(F.median(c).alias(c) for c in columns))


def outer_transfers(rows: DataFrame, launch: Column, keys: list[str], size: str) -> DataFrame:
    """What is moved before the first and after the last launch."""
    first, last = F.min(F.when(launch, F.col("start"))), F.max(F.when(launch, F.col("start")))
    w = Window.partitionBy(*keys)
    marked = rows.withColumn("a", first.over(w)).withColumn("b", last.over(w))
    return marked.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("start") < F.col("a"), F.col(size))), F.lit(0.0)).alias("before"), F.coalesce(F.sum(F.when(F.col("start") > F.col("b"), F.col(size))), F.lit(0.0)).alias("after"))


LAUNCHED, EVENT_WAIT, STREAM_WAIT, PLAIN_COPY = "cudaLaunchKernel", "cudaEventSynchronize", "cudaStreamSynchronize", "cudaMemcpy"  # fixed names of calls
ITERATION, SCATTER, GATHERING = "contrib_kernel", "scatter_host_ranks", ("accumulate_", "gather_")  # and of kernels
PHASE_COLUMNS = [
    "iter_ms", "contrib_ms", "gpu_accumulate_ms", "copy_ms", "copy_mb", "copy_gbs", "wait_copy_ms",
    "cpu_accumulate_ms", "back_ms", "back_mb", "scatter_ms", "wait_gpu_ms",
]


def to_ms(ns: Column) -> Column:
    return ns / F.lit(1e6)


def to_mb(size: Column) -> Column:
    return size / F.lit(1e6)


def run_phases(calls: DataFrame, work: DataFrame, keys: list[str]) -> DataFrame:
    """A row per complete iteration of each run: keys, seg and PHASE_COLUMNS. calls(keys, start, end, name, correlationId), work(keys, start, end, name, bytes,
    correlationId), as sources.trace_db reads them. A call without a correlation id started no work.

    An iteration begins where its first kernel is launched. Gathering lasts from the first such kernel's start to the last one's end, 0 without any. Of the
    copies back the largest counts, of the copies there the first. Without an event wait the host had no rows, and its phases are null."""
    ops = work.select(*keys, "correlationId", F.col("start").alias("os"), F.col("end").alias("oe"), F.col("name").alias("op"), "bytes")
    rows = calls.join(ops, [*keys, "correlationId"], "left")
    kernel = F.col("bytes") == 0
    cut = segments(rows, F.coalesce((F.col("name") == LAUNCHED) & (F.col("op") == ITERATION), F.lit(False)), keys)
    gathering = kernel & (F.col("op").startswith(GATHERING[0]) | F.col("op").startswith(GATHERING[1]))
    order, took = F.struct("start", "correlationId"), F.col("oe") - F.col("os")
    first = lambda what, when: F.min_by(F.when(when, what), F.when(when, order))
    last = lambda what, when: F.max_by(F.when(when, what), F.when(when, order))
    back, there = F.col("op") == "D2H", F.col("op") == "H2D"
    largest = F.max_by(F.when(back, F.struct(took.alias("ns"), F.col("bytes").alias("size"))), F.when(back, F.struct(F.col("bytes").alias("b"), (-F.col("start")).alias("s"))))
    wait, sync = F.col("name") == EVENT_WAIT, F.col("name") == STREAM_WAIT
    each = cut.groupBy(*keys, "seg").agg(
        last(F.col("os"), kernel & (F.col("op") == ITERATION)).alias("begun"), last(took, kernel & (F.col("op") == ITERATION)).alias("contrib"),
        F.coalesce(F.max(F.when(gathering, F.col("oe"))) - F.min(F.when(gathering, F.col("os"))), F.lit(0)).alias("gathered"), largest.alias("copy"),
        first(F.struct("start", "end"), wait).alias("wait"), first(F.struct("start", took.alias("ns"), "bytes"), there).alias("send"),
        last(took, kernel & (F.col("op") == SCATTER)).alias("scatter"), first(F.col("end") - F.col("start"), sync).alias("sync"),
    )
    launches = rows.filter((F.col("name") == LAUNCHED) & (F.col("op") == ITERATION)).select(*keys, "start", "correlationId", "os")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "correlationId"))
    following = launches.select(*keys, (number - 1).alias("seg"), F.col("os").alias("next"))  # a row per iteration
    had = F.col("wait").isNotNull()
    host = lambda c: F.when(had, c)
    return each.join(following, [*keys, "seg"]).select(
        *keys, "seg", to_ms(F.col("next") - F.col("begun")).alias("iter_ms"), to_ms(F.col("contrib")).alias("contrib_ms"), to_ms(F.col("gathered")).alias("gpu_accumulate_ms"),
        host(to_ms(F.col("copy.ns"))).alias("copy_ms"), host(to_mb(F.col("copy.size"))).alias("copy_mb"), host(F.try_divide("copy.size", "copy.ns")).alias("copy_gbs"),
        host(to_ms(F.col("wait.end") - F.col("wait.start"))).alias("wait_copy_ms"), host(to_ms(F.col("send.start") - F.col("wait.end"))).alias("cpu_accumulate_ms"),
        host(to_ms(F.col("send.ns"))).alias("back_ms"), host(to_mb(F.col("send.bytes"))).alias("back_mb"), host(to_ms(F.col("scatter"))).alias("scatter_ms"), to_ms(F.col("sync")).alias("wait_gpu_ms"),
    )


def run_summary(calls: DataFrame, work: DataFrame, keys: list[str]) -> DataFrame:
    """A row per run of 4 launches or more: iterations, the medians of PHASE_COLUMNS, and what plain copies moved before the first and after the last launch."""
    medians = phase_medians(run_phases(calls, work, keys), keys, PHASE_COLUMNS).drop("segments")
    ops = work.select(*keys, "correlationId", F.col("name").alias("op"), (F.col("end") - F.col("start")).alias("ns"), "bytes")
    rows = calls.join(ops, [*keys, "correlationId"], "left")
    launch = (F.col("name") == LAUNCHED) & (F.col("op") == ITERATION)
    ends = rows.filter(launch).groupBy(*keys).agg(F.min("start").alias("a"), F.max("start").alias("b"), F.count(F.lit(1)).alias("iterations"))
    moved = rows.join(F.broadcast(ends), keys).filter(F.col("name") == PLAIN_COPY)
    up, down = (F.col("start") < F.col("a")) & (F.col("op") == "H2D"), (F.col("start") > F.col("b")) & (F.col("op") == "D2H")
    total = lambda when, what: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0))
    outer = moved.groupBy(*keys).agg(to_ms(total(up, "ns")).alias("upload_ms"), to_mb(total(up, "bytes")).alias("upload_mb"), to_ms(total(down, "ns")).alias("download_ms"))
    return medians.join(ends.select(*keys, "iterations"), keys).join(outer, keys, "left").na.fill(0.0, ["upload_ms", "upload_mb", "download_ms"])
