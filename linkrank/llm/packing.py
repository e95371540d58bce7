"""Packing token sequences by the sum-of-squares rule."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, parts, rows_of, saved

END_ID = 0
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = pa.schema([("item", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64())])
PLACED_DDL = "item long, bin long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """text -> uint32 ids of the byte-level vocabulary at path. The same merges as ranks run four times as fast as the JSON form."""
    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
    return lambda text: coder.encode_to_numpy(text, allowed_special="all")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones, but for the first, which takes the rest."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n > first else [(0, n)]


def pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> a row per piece. Null text is empty, so its one piece is the end id."""

    def cut(batches):
        encode, out = encoder(path or tokenizer_path()), Rows(PIECES)
        for doc, text in rows_of(batches, "doc_id", "text"):
            ids = np.append(encode(text or ""), END_ID).astype("<u4")
            for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                if out.add(doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())):
                    yield out.take()
        yield out.take()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES_DDL)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each size, and each bin's fill. Longest first; of the open bins with room, a size goes to one that makes the sum, over
    gaps above 0, of the squared number of open bins with that gap smallest, with ties to the smallest gap; a new bin is opened only where none has
    room. Equal sizes are placed in their order."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, fill = np.empty(len(sizes), np.int64), []
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        gap, here = capacity, count[s:capacity]
        if here.any():
            delta = count[: capacity - s] - here  # half of what the sum of squares gains, less one
            delta = 2 * delta + 2
            delta[0] = 1 - 2 * here[0]
            delta[here == 0] = np.iinfo(np.int64).max
            gap = s + int(delta.argmin())
        if gap == capacity:
            b = len(fill)
            fill.append(0)
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i] = b
        fill[b] += s
        left = gap - s
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return bins, np.array(fill, np.int64)


def refitted(sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, or with fewer bins: sizes up to capacity / 32, / 16, .. / 2 are lifted and put back, longest first, each where the least room is left, and the
    first such try that saves a bin is taken. The sum of squares keeps gaps of all sizes open to the end, so its last bins are loose."""
    for limit in (capacity >> k for k in range(5, 0, -1)):
        items = np.flatnonzero(sizes <= limit)
        items = items[np.argsort(-sizes[items], kind="stable")]
        trial, new = bins.copy(), fill.copy()
        np.subtract.at(new, bins[items], sizes[items])
        gaps = sorted((capacity - f, b) for b, f in enumerate(new.tolist()) if f and f < capacity)
        unused = np.flatnonzero(new == 0).tolist()
        for i in items.tolist():
            s = int(sizes[i])
            at = bisect_left(gaps, (s, -1))
            if at == len(gaps):
                if not unused:
                    break
                gaps.append((capacity, unused.pop()))
            gap, b = gaps.pop(at)
            trial[i] = b
            new[b] += s
            if gap > s:
                insort(gaps, (gap - s, b))
        else:
            if unused:
                keep = np.flatnonzero(new)
                number = np.zeros(len(new), np.int64)
                number[keep] = np.arange(len(keep))
                return number[trial], new[keep]
    return bins, fill


def offsets(sizes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Where each size begins in its bin, in their order."""
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    out = np.empty(len(sizes), np.int64)
    out[order] = before - np.repeat(before[first], np.diff(np.append(first, len(order))))
    return out


def pack(items: DataFrame, capacity: int = 2048, group_rows: int = 32_768) -> DataFrame:
    """items(item long, length long) -> item, bin, offset. Items are dealt to groups of about group_rows by a hash of
    `item`, so no task sees all of them; a group leaves a few open bins at most, which is all that splitting costs."""
    groups = max(1, -(-items.count() // group_rows))

    def place(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, [("length", "descending"), ("item", "ascending")])
        table = table.take(order)
        sizes = table["length"].to_numpy()
        bins, _ = refitted(sizes, *sum_of_squares(sizes, capacity), capacity)
        first = table["g"][0].as_py() << 32
        return pa.table([table["item"].combine_chunks(), pa.array(bins + first), pa.array(offsets(sizes, bins))], schema=PLACED)

    dealt = items.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("g")).repartition(min(groups, parts(items.sparkSession)), "g")
    return dealt.groupBy("g").applyInArrow(place, PLACED_DDL)


def packed_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> its pieces with sequence_id and offset. Whole pieces fill a sequence each; the rest is packed.
    Null or repeated doc_ids, equal rows and empty texts each keep their own pieces; an empty table gives no pieces."""
    cut = saved(pieces(docs, capacity, path).withColumn("item", F.monotonically_increasing_id()))
    rest = cut.filter(F.col("length") < capacity)
    placed = pack(rest.select("item", "length"), capacity)
    put = rest.join(placed, "item").select(*PIECES.names, (F.col("bin") * 2 + 1).alias("sequence_id"), "offset")
    return cut.filter(F.col("length") == capacity).select(*PIECES.names, (F.col("item") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(put)


def op4(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
