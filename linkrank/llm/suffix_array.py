"""Suffix-array deduplication: repeated byte strings by column-wise construction over many texts."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, saved, scratch_dir, unpacked
from .repeats import EMPTY, Stretch, Units, repeats
from .symbols import grams

WINDOW = 200
BYTES = Units("bytes", WINDOW, 96, 105, (16, 1))
IN_MEMORY = 64 << 20


class Columns:
    """Byte sequences that each round reads through once and writes anew: in memory, or, if they may become large, in files of a folder."""

    def __init__(self, count: int, total: int, folder: str | None = None):
        self.folder = folder if folder and total > IN_MEMORY else None
        self.held = [np.empty(0, np.uint8) for _ in range(count)]

    def _empty(self, n: int) -> np.ndarray:
        if not self.folder:
            return np.empty(n, np.uint8)
        os.makedirs(self.folder, exist_ok=True)
        with tempfile.TemporaryFile(dir=self.folder) as f:  # the mapping keeps it until the next round
            f.truncate(max(n, 1))
            return np.memmap(f, np.uint8, "r+", shape=(max(n, 1),))[:n]

    def merge(self, at: np.ndarray, *values: np.ndarray) -> None:
        """Puts each sequence's values at places `at` of its new form; the rest keeps its order."""
        n = len(self.held[0]) + len(at)
        old = np.ones(n, bool)
        old[at] = False
        for i, v in enumerate(values):
            new = self._empty(n)
            new[old] = self.held[i]
            new[at] = v
            self.held[i] = new


def range_minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of each values[a:b], b > a, from minima over powers of two."""
    out = np.empty(len(a), np.uint8)
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        m = np.flatnonzero(level == k)
        out[m] = np.minimum(table[a[m]], table[b[m] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def collection_arrays(texts: list[bytes], most: int = WINDOW, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, suffix length and common prefix with the suffix before (up to `most`) of all suffixes in order.

    Each round inserts one symbol of every text, from its end: the suffix that is longer by that symbol goes to the place which the
    counts of symbols in the transform so far give, and the symbol before it is written there. Its common prefix with a neighbour is one
    more than the least between the two neighbours' tails. The transform and the prefixes are read and written in sequence each round."""
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    symbols = np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
    columns = Columns(2, int(ends[-1]) + n if n else 0, folder)

    def preceding(who: np.ndarray, length: int) -> np.ndarray:
        at = ends[who] - 1 - length
        return np.where(lengths[who] > length, symbols[np.maximum(at, 0)], 0).astype(np.uint8)

    live = place = np.arange(n)  # the texts in the order of their last suffixes, and these suffixes' places
    symbol = preceding(live, 0)
    counts = np.bincount(symbol, minlength=256)
    columns.merge(place, symbol, np.zeros(n, np.uint8))
    for length in range(1, int(lengths.max(initial=0)) + 1):
        transform, common = columns.held
        keep = symbol > 0
        by = np.argsort(symbol[keep], kind="stable")
        live, place, symbol = live[keep][by], place[keep][by], symbol[keep][by].astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(counts)))
        order = np.argsort(transform, kind="stable")
        rank = np.empty(len(place), np.int64)
        cut = np.flatnonzero(np.diff(symbol, prepend=-1, append=-1))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            first, last = starts[symbol[a]], starts[symbol[a] + 1]
            rank[a:b] = first + np.searchsorted(order[first:last], place[a:b])
        has_left, has_right = np.flatnonzero(rank > starts[symbol]), np.flatnonzero(rank + 1 < starts[symbol + 1])
        low = np.concatenate((order[rank[has_left] - 1], place[has_right])) + 1
        high = np.concatenate((place[has_left], order[rank[has_right] + 1])) + 1
        more = np.minimum(range_minima(common, low, high), most - 1) + np.uint8(1)
        left = np.zeros(len(place), np.uint8)
        left[has_left] = more[: len(has_left)]
        place = n + rank - counts[0]
        symbol = preceding(live, length)
        counts += np.bincount(symbol, minlength=256)
        columns.merge(place, symbol, left)
        columns.held[1][place[has_right] + 1] = more[len(has_left) :]
    before, common = columns.held
    transform = before
    order = np.argsort(transform, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order)) + n - np.count_nonzero(transform == 0)
    owner, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    live, place = np.arange(n), np.arange(n)
    for length in range(int(lengths.max(initial=0)) + 1):
        owner[place], size[place] = live, length
        keep = lengths[live] > length
        live, place = live[keep], back[place[keep]]
    return owner, size, common


def _neighbour_prefix(group: np.ndarray, data: np.ndarray, at: np.ndarray, step: int, size: np.ndarray) -> np.ndarray:
    """For rows of `size` bytes read from `at` in direction `step`: the longest prefix that each shares with another of its group."""
    most = int(size.max(initial=0))
    if not most:
        return np.zeros(len(group), np.int64)
    offset = np.arange(most)
    rows = np.where(offset < size[:, None], data[np.clip(at[:, None] + step * offset, 0, len(data) - 1)] + np.uint8(1), 0).astype(np.uint8)  # UTF-8 has no byte 255
    keyed = np.hstack((group.astype(">u4")[:, None].view(np.uint8), rows))
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1]}").ravel(), kind="stable")
    rows, size, group = rows[order], size[order], group[order]
    differ = rows[1:] != rows[:-1]
    both = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    both = np.where(group[1:] == group[:-1], np.minimum(both, np.minimum(size[1:], size[:-1])), 0)
    longest = np.zeros(len(group), np.int64)
    longest[order] = np.maximum(np.append(both, 0), np.concatenate(([0], both)))
    return longest


def trimmed(stretches: list[Stretch]) -> tuple[np.ndarray, np.ndarray]:
    """From where to where each stretch can have a repeated window. All such windows contain the anchor's gram, so what no other stretch of the anchor shares
    to its left or right is cut off. Where an anchor stands twice in a stretch, its stretches stay whole."""
    gram = BYTES.gram
    sizes = np.array([len(s.content) for s in stretches])
    first = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(s.content for s in stretches), np.uint8)
    group = np.unique([s.anchor for s in stretches], return_inverse=True)[1]
    hashes = grams(data.astype(np.uint16) + 1, gram)
    bounds = np.column_stack((first, np.minimum(first + sizes - gram + 1, len(hashes) - 1))).ravel()
    least = np.minimum(np.minimum.reduceat(hashes, bounds)[::2], hashes[np.minimum(first + sizes - gram, len(hashes) - 1)])
    owner = np.repeat(np.arange(len(stretches)), sizes)[: len(hashes)]
    place = np.flatnonzero((hashes == least[owner]) & (np.arange(len(hashes)) <= (first + sizes - gram)[owner]))
    count = np.bincount(owner[place], minlength=len(stretches))
    at = np.zeros(len(stretches), np.int64)
    at[owner[place[::-1]]] = place[::-1]
    own = np.array([s.times for s in stretches]) > 1
    reach = WINDOW - gram
    before, after = np.minimum(at - first, reach), np.minimum(first + sizes - at - gram, reach)
    left = np.where(own, before, _neighbour_prefix(group, data, at - 1, -1, before))
    right = np.where(own, after, _neighbour_prefix(group, data, at + gram, 1, after))
    whole = (np.bincount(group, count != 1) > 0)[group]
    return np.where(whole, 0, at - left - first), np.where(whole, sizes, at + gram + right - first)


def judge(stretches: list[Stretch], folder: str | None = None) -> Iterator[tuple[int, list[int]]]:
    """Window starts whose 200 bytes stand at two places at least. Stretches that stand twice themselves are known; they go into the arrays
    only for the sake of others under their anchor."""
    open_anchors = {s.anchor for s in stretches if s.times < 2}
    for i, s in enumerate(stretches):
        if s.times > 1:
            yield i, [0, s.starts, 0]
    numbers = [i for i, s in enumerate(stretches) if s.anchor in open_anchors]
    if not numbers:
        return
    begin, end = trimmed([stretches[i] for i in numbers])
    held = [(i, a, stretches[i].content[a:b]) for i, a, b in zip(numbers, begin.tolist(), end.tolist(), strict=True) if b - a >= WINDOW]
    texts = [t for _, _, t in held]
    owner, size, common = collection_arrays(texts, folder=folder)
    window = size >= WINDOW
    same = np.cumsum(common < WINDOW)[window]  # windows with one number are equal
    owner, start = owner[window], np.array([len(t) for t in texts], np.int64)[owner[window]] - size[window]
    times = np.bincount(same, np.array([stretches[i].times for i, _, _ in held], float)[owner])
    twice = times[same] >= 2
    owner, start = owner[twice], start[twice]
    if not len(owner):
        return
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    runs: dict[int, list[int]] = {}
    for a, b in zip(new.tolist(), np.append(new[1:], len(start)).tolist(), strict=True):
        i, shift, _ = held[owner[a]]
        if stretches[i].times < 2:
            runs.setdefault(i, []).extend((int(start[a]) + shift, int(start[a]) + shift + b - a, 0))
    yield from runs.items()


def repeated_bytes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    shared = scratch_dir(docs.sparkSession)  # where it is a folder that tasks can open, large columns lie there
    return repeats(docs, BYTES, True, partial(judge, folder=shared.removeprefix("file://") if shared.startswith("file://") else None))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without the bytes that op9 removes. A character of which a byte goes, goes whole; n_chars,
    where there is one, follows the text. Null texts stay null, and documents of which nothing is left stay as empty texts."""
    import pyarrow as pa

    at, size, blob = "__linkrank_key", "__linkrank_copies", "__linkrank_blob"
    _, texts = repeated_bytes(docs.select("doc_id", "text"))
    changed = texts.filter((F.col("copies") > 1) | F.col("blob").isNotNull()).select(F.col("key").alias(at), F.col("copies").alias(size), F.col("blob").alias(blob))
    keyed = docs.withColumn(at, F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    joined = keyed.join(saved(changed), at, "left")
    names = docs.columns

    def replace(batches):
        for batch in batches:
            texts = []
            for text, copies, left in rows_of([batch], "text", size, blob):
                if copies is not None and text is not None:
                    if copies > 1 and len(text.encode()) >= WINDOW:
                        text = ""
                    elif left is not None:
                        text = unpacked(left).decode("utf-8", "ignore")
                texts.append(text)
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_pydict(columns)

    return joined.drop(at).mapInArrow(replace, docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Every document: what of it stands nowhere else. Null and empty texts have no bytes, equal rows are copies of each other,
    a text shorter than the window stays whole."""
    listed, texts = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    whole = (F.col("copies") > 1) & (F.col("n") >= WINDOW)
    joined = listed.join(texts.select("key", "copies", "n_removed", "n_spans", "kept"), "key")
    return joined.select(
        "doc_id", F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.lower(F.hex(F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept", "plain")))).alias("kept_sha256"),
    )


OP9_SQL = r"""
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) x from documents),
g as (select r, s, md5_number(substr(x, 2*s + 1, 400)) h from (select r, x, unnest(range(len(x)//2 - 199)) s from d where len(x) >= 400)),
hit as (select r, s from g where h in (select h from g group by h having count(*) > 1)),
run as (select r, s, sum((s - before > 200 or before is null)::int) over (partition by r order by s) k from (select r, s, lag(s) over (partition by r order by s) before from hit)),
span as (select r, k, min(s) a, max(s) + 200 b from run group by r, k),
left_over as (select r, string_agg(substr(x, 2*f + 1, 2*(a - f)), '' order by f) t, sum(b - a) n, count(*) - 1 spans from (
  select r, x, a, b, coalesce(lag(b) over (partition by r order by a), 0) f from (select r, a, b from span union all select r, len(x)//2, len(x)//2 from d where r in (select r from span)) join d using (r)) group by r)
select doc_id, (len(x)//2)::bigint n_bytes, coalesce(n, 0)::bigint n_removed, coalesce(spans, 0)::bigint n_spans, sha256(unhex(coalesce(t, x))) kept_sha256 from d left join left_over using (r)
"""
