"""Substring deduplication by prefix-partitioned suffix trees over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import EMPTY, LAST, Stretch, Units, repeats

WINDOW = 50
WORDS = Units("words", WINDOW, 20, 32, (8, 1))
GROUP = 40_000  # suffixes whose subtree is built at a time


def prefix_groups(symbols: np.ndarray, starts: np.ndarray, depth: int, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """(prefix length, suffixes): prefixes grow, a symbol at a time, until `limit` suffixes at most share one, or to `depth`."""
    todo = [(0, starts)]
    while todo:
        length, group = todo.pop()
        if len(group) <= limit or length == depth:
            yield length, group
            continue
        here = symbols[group + length]
        order = np.argsort(here, kind="stable")
        cut = np.flatnonzero(np.diff(here[order])) + 1
        small: list[np.ndarray] = []
        for part in np.split(group[order], cut):
            if len(part) > limit:
                todo.append((length + 1, part))
            elif small and len(small[-1]) + len(part) <= limit:
                small[-1] = np.concatenate((small[-1], part))
            else:
                small.append(part)
        for part in small:  # neighbours under one parent share a task
            yield length, part


def subtree(symbols: np.ndarray, leaves: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree below one prefix of `length` symbols, as its leaves in order and the branching depth between each and the one before it (0 for
    the first). The suffix from leaves[i] ends before stops[i], its text's end; a suffix that another one begins with stands before it."""
    sizes = stops - leaves - length
    width = int(sizes.max(initial=0))
    offset = np.arange(width)
    rows = np.where(offset < sizes[:, None], symbols[np.minimum(leaves[:, None] + length + offset, len(symbols) - 1)] + 1, 0).astype(">u4")
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{4 * width}").ravel(), kind="stable") if width else np.arange(len(leaves))
    rows, sizes = rows[order], sizes[order]
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(len(leaves) - 1, np.int64)
    return leaves[order], np.concatenate(([0], length + np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))))


def maximal_repeats(leaves: np.ndarray, depths: np.ndarray, before: np.ndarray, lows: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, leaves, low) of the internal nodes of `least` symbols or more, deepest first: a node is a longest run of leaves that branch no earlier than
    its depth. Nodes all of whose leaves follow one symbol (before; -1 at a text's start) can be extended to the left, so they are no maximal repeat and
    are left out. low is the least of lows over a node's leaves."""
    edge = depths >= least
    deep = edge | np.append(edge[1:], False)
    leaves, depths, before, lows = leaves[deep], depths[deep], before[deep], lows[deep]
    for depth in np.unique(depths[depths >= least])[::-1].tolist():
        first = np.flatnonzero(depths < depth)
        run = np.cumsum(depths < depth) - 1
        here = np.zeros(len(first), bool)
        here[run[depths == depth]] = True
        small, large = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
        here &= (small != large) | (small < 0)
        mine = here[run]
        yield depth, leaves[mine], np.minimum.reduceat(lows, first)[run[mine]]


def judge(stretches: list[Stretch]) -> Iterator[tuple[int, list[int]]]:
    """Windows of 50 words with a smaller least doc_id than some text that has them: those inside maximal repeats, from the deep
    nodes of the subtrees, and stretches that several texts have whole. Words are told apart by their bytes."""
    names: dict[bytes, int] = {}
    texts = [[names.setdefault(w, len(names)) for w in s.content.split()] for s in stretches]
    sizes = np.array([len(t) for t in texts])
    symbols = np.array([x for t in texts for x in t], np.int64)
    first = np.cumsum(sizes) - sizes
    counts = np.array([s.starts for s in stretches])
    owner = np.repeat(np.arange(len(stretches)), counts)
    starts = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    lows, highs = np.array([s.low for s in stretches]), np.array([s.high for s in stretches])
    of = np.repeat(np.arange(len(stretches)), sizes)
    before = np.append(-1, symbols[:-1])
    before[first] = -1
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    several = lows < highs
    for size in np.unique(sizes[several]).tolist():
        at = several & (sizes == size)
        found.setdefault(size, []).append((first[at], lows[at]))
    for length, group in prefix_groups(symbols, starts, WINDOW, GROUP):
        if len(group) > 1:
            leaves, depths = subtree(symbols, group, (first + sizes)[of[group]], length)
            for depth, places, low in maximal_repeats(leaves, depths, before[leaves], lows[of[leaves]], WINDOW):
                found.setdefault(depth, []).append((places, low))
    least = np.full(len(symbols), LAST)
    for depth in range(max(found, default=0), WINDOW - 1, -1):  # a repeat of one word more covers its own window and the next
        least[1:] = np.minimum(least[1:], least[:-1])
        for places, low in found.get(depth, ()):
            np.minimum.at(least, places, low)
    for i, s in enumerate(stretches):
        low = least[first[i] : first[i] + s.starts]
        edges = np.flatnonzero(np.diff(low, prepend=-1, append=-1))
        runs = [x for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if low[a] < highs[i] for x in (a, b, int(low[a]))]
        if runs:
            yield i, runs


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that a document with a smaller doc_id has. Null and empty texts have no words; a null doc_id
    is larger than any other; rows with one doc_id don't count against each other."""
    listed, texts = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), WORDS, False, judge)
    joined = listed.join(texts.select("key", "low", "n_removed", "kept"), "key")
    whole = (F.coalesce("doc_id", F.lit(LAST)) > F.col("low")) & (F.col("n") >= WINDOW)
    return joined.select(
        "doc_id", F.col("n").alias("n_words"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.lower(F.hex(F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept", "plain")))).alias("kept_sha256"),
    )


OP5_SQL = r"""
with d as (select row_number() over () r, doc_id, coalesce(doc_id, 9223372036854775807) o, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select r, o, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) h from (select r, o, w, unnest(range(len(w) - 49)) s from d where len(w) >= 50)),
low as (select h, min(o) lo from g group by h),
cov as (select distinct r, unnest(range(s, s + 50)) p from g join low using (h) where lo < o),
kept as (select r, string_agg(w[p + 1], ' ' order by p) t from (select r, w, unnest(range(len(w))) p from d where r in (select r from cov)) anti join cov using (r, p) group by r),
gone as (select r, count(*) n from cov group by r)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(case when n is null then array_to_string(w, ' ') else coalesce(t, '') end) kept_sha256
from d left join gone using (r) left join kept using (r)
"""
