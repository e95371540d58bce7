"""What the two repeat operators share: which windows could repeat, each distinct stretch of them once, and what is left of each text.

A window's anchor is its least gram hash, so equal windows meet under one anchor. Anchors that occur once rule their windows out
without moving any text. The others' stretches are keyed by content: a passage that a third of the texts carry is one row,
however often it stands. A method (suffix arrays or suffix trees) then says which windows of the distinct stretches repeat.

An anchor with more than CROWD distinct stretches (a passage among very many surroundings) isn't judged in one task: its windows are dealt
by where in them the anchor's gram stands, and by what lies around it, in finer and finer ranges of places until no group is crowded."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, packed, parts, rows_of, saved, text_key, unpacked
from .symbols import SPACED, anchored_runs, grams, words

LAST = (1 << 63) - 1  # stands for a null doc_id: larger than any other
EMPTY = hashlib.sha256(b"").digest()
CROWD = 1024  # distinct stretches of an anchor that one task judges together
BROADCAST_ANCHORS = 1_000_000
SALTS = 32


@dataclass(frozen=True)
class Units:
    """Bytes or words, the window and gram sizes in them, how many window starts a stretch may have, and how many places of the gram
    go together when the windows of a crowded anchor are dealt out; 1, the last, leaves a single window in each group."""

    kind: str
    window: int
    gram: int
    longest: int
    ranges: tuple[int, ...]

    def cut(self, data: bytes) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """The text's symbols, and where each begins and ends (None: each is a byte)."""
        if self.kind == "bytes":
            return np.frombuffer(data, np.uint8).astype(np.uint16) + 1, None, None
        starts, ends, hashes = words(data, SPACED)
        return hashes, starts, ends

    def content(self, data: bytes, begin, end, a: int, b: int) -> bytes:
        """What the windows that start at a..b-1 cover."""
        last = b + self.window - 1
        return data[a:last] if begin is None else data[begin[a] : end[last - 1]]

    def kept(self, data: bytes, starts, ends, removed: np.ndarray) -> bytes:
        if self.kind == "bytes":
            return np.frombuffer(data, np.uint8)[~removed].tobytes()
        return b" ".join(data[a:b] for a, b in zip(starts[~removed].tolist(), ends[~removed].tolist(), strict=True))


SCAN = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("plain", pa.binary()), ("lead", pa.bool_()), ("anchors", pa.list_(pa.int64())), ("inner", pa.list_(pa.int64()))])
SCAN_DDL = "doc_id long, key binary, n long, plain binary, lead boolean, anchors array<long>, inner array<long>"
BLOB = pa.schema([("key", pa.binary()), ("blob", pa.binary())])
STRETCH = pa.schema([("anchor", pa.int64()), ("content", pa.binary()), ("starts", pa.int32()), ("times", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
STRETCH_DDL = "anchor long, content binary, starts int, times long, low long, high long"
PIECE = pa.schema([("whole", pa.binary()), ("shift", pa.int64()), ("cid", pa.binary()), *STRETCH])
PIECE_DDL = f"whole binary, shift long, cid binary, {STRETCH_DDL}"
SUSPECT = pa.schema([("key", pa.binary()), ("low", pa.int64()), ("blob", pa.binary()), ("first", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("anchor", pa.list_(pa.int64())), ("cid", pa.list_(pa.binary()))])
SUSPECT_DDL = "key binary, low long, blob binary, first array<int>, starts array<int>, anchor array<long>, cid array<binary>"
VERDICT = pa.schema([("cid", pa.binary()), ("runs", pa.list_(pa.int64()))])
LEFT = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("blob", pa.binary())])


@dataclass
class Stretch:
    """Distinct content with `starts` window starts: how often it stands, and the least and largest doc_id with it."""

    anchor: int
    content: bytes
    starts: int
    times: int
    low: int
    high: int


def _scan(docs: DataFrame, units: Units, within: bool) -> DataFrame:
    def scan(batches):
        out, seen = Rows(SCAN), set()
        for doc, text in rows_of(batches, "doc_id", "text"):
            data = (text or "").encode()
            key = text_key(data)
            symbols, starts, ends = units.cut(data)
            plain = key if units.kind == "bytes" else text_key(units.kept(data, starts, ends, np.zeros(len(symbols), bool)))
            lead = key not in seen
            seen.add(key)
            anchors, inner = (), ()
            if lead:
                anchors, _, _, inner = anchored_runs(symbols, units.window, units.gram, within)
                anchors = anchors.view(np.int64)
                inner = anchors[inner]
            if out.add(doc, key, len(symbols), plain, lead, anchors, inner, weight=200 + 8 * len(anchors)):
                yield out.take()
        yield out.take()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCAN_DDL)


def _blobs(docs: DataFrame) -> DataFrame:
    def scan(batches):
        out, seen = Rows(BLOB), set()
        for (text,) in rows_of(batches, "text"):
            data = (text or "").encode()
            key = text_key(data)
            if key not in seen:
                seen.add(key)
                blob = packed(data)
                if out.add(key, blob, weight=64 + len(blob)):
                    yield out.take()
        yield out.take()

    return docs.select("text").mapInArrow(scan, "key binary, blob binary").dropDuplicates(["key"])


def _content_id(anchor: int, content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16, key=anchor.to_bytes(8, "little", signed=True)).digest()


def _cut(batches, units: Units):
    """Of each suspect text, the stretches, of `longest` starts at most, of its marked runs."""
    out = Rows(SUSPECT)
    for key, low, blob, marks in rows_of(batches, "key", "low", "blob", "marks"):
        data = unpacked(blob)
        symbols, begin, end = units.cut(data)
        anchors, first, stop, _ = anchored_runs(symbols, units.window, units.gram)
        found = []
        for run in sorted(m for m in marks if m < len(anchors)):
            anchor = int(anchors[run].view(np.int64))
            for a in range(int(first[run]), int(stop[run]), units.longest):
                b = min(a + units.longest, int(stop[run]))
                found.append((a, b - a, anchor, _content_id(anchor, units.content(data, begin, end, a, b))))
        if out.add(key, low, blob, *([list(c) for c in zip(*found, strict=True)] or [[], [], [], []]), weight=200 + len(blob) + 60 * len(found)):
            yield out.take()
    yield out.take()


def _pieces(batches, units: Units, places: int):
    """The windows of each stretch, cut by where their first gram with the least hash begins, `places` of it a piece. Equal windows have it at the same
    place, so they meet in the pieces that share the symbols which all windows of these places have around the gram."""
    out = Rows(PIECE)
    for anchor, content, times, low, high in rows_of(batches, "anchor", "content", "times", "low", "high"):
        symbols, begin, end = units.cut(content)
        whole, start = _content_id(anchor, content), np.arange(len(symbols) - units.window + 1)
        hashes = grams(symbols, units.gram)
        found = np.flatnonzero(hashes == hashes.min())  # all windows of a stretch have one anchor
        gram = found[np.searchsorted(found, start)]
        part = (gram - start) // places
        cuts = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(start)], strict=True):
            at, least = int(gram[a]), int(part[a]) * places
            core = symbols[at - least : at + units.gram + max(0, units.window - units.gram - least - places + 1)]
            name = hashlib.blake2b(core.tobytes(), digest_size=8, key=b"%d %d %d" % (anchor, least, places)).digest()
            name = int.from_bytes(name, "little", signed=True)
            last = b + units.window - 1
            piece = content[a:last] if begin is None else b" ".join(content[x:y] for x, y in zip(begin[a:last].tolist(), end[a:last].tolist(), strict=True))
            if out.add(whole, a, _content_id(name, piece), name, piece, b - a, times, low, high, weight=200 + len(piece)):
                yield out.take()
    yield out.take()


def _verdicts(batches, judge, batch_bytes: int):
    """What the method says of the stretches, of one or more whole anchors at a time."""
    out = Rows(VERDICT)

    def settle(group):
        for i, runs in judge(group):
            if out.add(_content_id(group[i].anchor, group[i].content), runs, weight=40 + 8 * len(runs)):
                yield out.take()

    def groups():
        """The stretches of each anchor; equal content of several tasks becomes one."""
        now, same = None, {}
        for anchor, content, starts, times, low, high in rows_of(batches, "anchor", "content", "starts", "times", "low", "high"):
            if anchor != now:
                if same:
                    yield same
                now, same = anchor, {}
            if x := same.get(content):
                x.times, x.low, x.high = x.times + times, min(x.low, low), max(x.high, high)
            else:
                same[content] = Stretch(anchor, content, starts, times, low, high)
        if same:
            yield same

    batch, size = [], 0
    for same in groups():
        more = sum(len(c) for c in same)
        if batch and size + more > batch_bytes:
            yield from settle(batch)
            batch, size = [], 0
        batch += same.values()
        size += more
    if batch:
        yield from settle(batch)
    yield out.take()


def _judged(stretches: DataFrame, named: DataFrame, units: Units, judge, batch_bytes: int, ranges: tuple[int, ...]) -> DataFrame:
    """(cid, runs) of the stretches; `named` has the anchor and cid of each. Crowded anchors are dealt out by the next of the ranges."""

    def settled(table):
        dealt = table.select(*STRETCH.names).repartition(parts(table.sparkSession), "anchor").sortWithinPartitions("anchor")
        return saved(dealt.mapInArrow(lambda batches: _verdicts(batches, judge, batch_bytes), "cid binary, runs array<long>"))

    if not ranges:
        return settled(stretches)
    crowded = named.distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD)
    crowded = saved(crowded.select("anchor", F.lit(True).alias("busy")))
    n = crowded.count()
    if not n:
        return settled(stretches)
    if n <= BROADCAST_ANCHORS:
        flagged = stretches.join(F.broadcast(crowded), "anchor", "left")
    else:  # by shuffle, with the rows of an anchor spread over salts
        salted = crowded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        flagged = stretches.withColumn("salt", F.pmod(F.xxhash64("content"), F.lit(SALTS)).cast("int")).join(salted, ["anchor", "salt"], "left")
    flagged = saved(flagged.select(*STRETCH.names, "busy"))
    busy = flagged.filter("busy").select("anchor", "content", "times", "low", "high")
    pieces = saved(busy.mapInArrow(lambda batches: _pieces(batches, units, ranges[0]), PIECE_DDL))
    merged = pieces.groupBy("anchor", "content").agg(F.min("starts").alias("starts"), F.sum("times").alias("times"), F.min("low").alias("low"), F.max("high").alias("high"))
    inner = _judged(merged, pieces.select("anchor", "cid"), units, judge, batch_bytes, ranges[1:])
    moved = F.transform("runs", lambda x, i: F.when(i % 3 < 2, x + F.col("shift")).otherwise(x))
    back = pieces.select("whole", "shift", "cid").distinct().join(inner, "cid").select(F.col("whole").alias("cid"), moved.alias("runs"))
    return settled(flagged.filter("busy is null")).unionByName(back)


def repeats(docs: DataFrame, units: Units, within: bool, judge: Callable[[list[Stretch]], Iterator[tuple[int, list[int]]]], batch_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, key, n, plain) of every document, and per distinct text key: copies, low (least doc_id), and, where part of it
    goes, n_removed, n_spans, kept (digest) and blob (what is left, compressed).

    within: a window may also repeat inside one text. judge(stretches of one or more whole anchors) yields (index, flat
    [first start, end, low] triples): windows that stand twice at least, with the least doc_id that has them. A window counts
    against a text if that doc_id is smaller than the text's own, or, where `within` holds, always."""
    scanned = saved(_scan(docs, units, within))
    listed = scanned.select("doc_id", "key", "n", "plain")
    texts = saved(scanned.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("low"), F.count(F.lit(1)).alias("copies")))
    short = F.xxhash64("key")
    spread = scanned.filter("lead").select(short.alias("k"), F.posexplode("anchors").alias("run", "anchor"))
    where = F.xxhash64("k", "run") if within else F.col("k")
    seen = spread.select("anchor", where.alias("w"))
    if within:
        seen = seen.unionByName(scanned.filter("lead").select(F.explode("inner").alias("anchor"), F.xxhash64("key", F.lit("inner")).alias("w")))
    again = seen.groupBy("anchor").agg(F.min("w").alias("a"), F.max("w").alias("b")).filter("a != b").select("anchor")
    marks = spread.join(saved(again), "anchor").groupBy("k").agg(F.collect_set("run").alias("marks"))
    marks = saved(marks.join(texts.select("key", "low", short.alias("k")), "k").select("key", "low", "marks"))
    suspects = _blobs(docs).join(marks, "key").mapInArrow(lambda batches: _cut(batches, units), SUSPECT_DDL)
    suspects = saved(suspects.withColumn("sid", F.monotonically_increasing_id()))

    def stretch(batches):
        found: dict[bytes, list] = {}
        out = Rows(STRETCH)
        size = 0
        for low, blob, *stretches in rows_of(batches, "low", "blob", "first", "starts", "anchor", "cid"):
            data = unpacked(blob)
            _, begin, end = units.cut(data)
            for first, starts, anchor, cid in zip(*stretches, strict=True):
                if cid in found:
                    x = found[cid]
                    x[3], x[4], x[5] = x[3] + 1, min(x[4], low), max(x[5], low)
                else:
                    content = units.content(data, begin, end, first, first + starts)
                    found[cid] = [anchor, content, starts, 1, low, low]
                    size += len(content) + 300
                if size > 32 << 20:
                    for x in found.values():
                        if out.add(*x, weight=100 + len(x[1])):
                            yield out.take()
                    found, size = {}, 0
        for x in found.values():
            if out.add(*x, weight=100 + len(x[1])):
                yield out.take()
        yield out.take()

    stretches = suspects.select("low", "blob", "first", "starts", "anchor", "cid").mapInArrow(stretch, STRETCH_DDL)
    named = suspects.select(F.explode(F.arrays_zip("anchor", "cid")).alias("x")).select("x.anchor", "x.cid")
    judged = _judged(stretches, named, units, judge, batch_bytes, units.ranges)

    places = suspects.select("sid", F.explode(F.arrays_zip("first", "cid")).alias("x")).select("sid", "x.first", "x.cid")
    gone = places.join(judged, "cid").groupBy("sid").agg(F.collect_list(F.struct("first", "runs")).alias("gone"))

    def strip(batches):
        out = Rows(LEFT)
        for key, low, blob, gone in rows_of(batches, "key", "low", "blob", "gone"):
            data = unpacked(blob)
            symbols, begin, end = units.cut(data)
            edge = np.zeros(len(symbols) + 1, np.int64)
            for x in gone:
                r = np.array(x["runs"], np.int64).reshape(-1, 3)
                if not within:
                    r = r[r[:, 2] < low]
                np.add.at(edge, r[:, 0] + x["first"], 1)
                np.add.at(edge, r[:, 1] + x["first"] + units.window - 1, -1)
            removed = np.cumsum(edge[:-1]) > 0
            if not removed.any():
                continue
            spans = int(np.count_nonzero(np.diff(np.concatenate(([False], removed)).astype(np.int8)) == 1))
            left = units.kept(data, begin, end, removed)
            rest = packed(left)
            if out.add(key, int(removed.sum()), spans, text_key(left), rest, weight=150 + len(rest)):
                yield out.take()
        yield out.take()

    left = suspects.join(gone, "sid").select("key", "low", "blob", "gone").mapInArrow(strip, "key binary, n_removed long, n_spans long, kept binary, blob binary")
    return listed, saved(texts.join(left, "key", "left"))
