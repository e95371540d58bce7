"""Media columns: payloads as image files, kept as content-defined chunks of which equal ones are stored once."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, packed, rows_of, saved, unpacked

SIDE = 24
UNIT = SIDE * SIDE
MASK = np.uint32(((1 << 11) - 1) << 21)  # cuts about every 2 KB
SHORTEST, LONGEST = 512, 8192
HOT = 1000  # places of a chunk beyond which its bytes go to several tasks
SALTS = 32


def payload(text: str | None) -> bytes:
    """UTF-8 of the text, with 255 up to a positive multiple of UNIT."""
    data = (text or "").encode()
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_media(data: bytes) -> bytes:
    """A grey-scale image file (binary PGM), one 8-bit sample a byte."""
    return b"P5\n%d %d\n255\n" % (SIDE, len(data) // SIDE) + data


def from_media(media: bytes) -> bytes:
    magic, sizes, most, data = media.split(b"\n", 3)
    width, height = map(int, sizes.split())
    if magic != b"P5" or most != b"255" or width * height != len(data):
        raise ValueError("not a whole 8-bit grey-scale image")
    return data


def features(data: bytes) -> str:
    """Size, mean, deviation and entropy of the samples, and the mean of each quarter of the rows."""
    samples = np.frombuffer(data, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    seen = share[share > 0]
    quarters = ",".join(f"{q.mean():.3f}" for q in np.array_split(samples, 4))
    return f"{SIDE}x{len(samples) // SIDE} mean={samples.mean():.3f} std={samples.std():.3f} entropy={-(seen * np.log2(seen)).sum():.3f} quarters={quarters}"


def gear() -> np.ndarray:
    """A random 32-bit number for each byte, from a digest of it."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


GEAR = gear()


def chunk_ends(data: bytes) -> list[int]:
    """Where chunks end. The rolling gear hash of the last 32 bytes, here by doubling, decides, between SHORTEST and LONGEST bytes after the cut before."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for bit in range(5):
        step = 1 << bit
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    ends, at = [], 0
    for place in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while place - at > LONGEST:
            at += LONGEST
            ends.append(at)
        if place - at >= SHORTEST:
            ends.append(place)
            at = place
    while len(data) - at > LONGEST:
        at += LONGEST
        ends.append(at)
    if at < len(data):
        ends.append(len(data))
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = chunk_ends(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


CATALOG = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("media_bytes", pa.int64()), ("lead", pa.bool_()), ("digests", pa.list_(pa.binary()))])
CATALOG_DDL = "doc_id long, n_bytes long, media binary, media_bytes long, lead boolean, digests array<binary>"
BLOBS = pa.schema([("media", pa.binary()), ("blob", pa.binary())])
STORE = pa.schema([("media", pa.binary()), ("whole", pa.bool_()), ("digests", pa.list_(pa.binary())), ("chunks", pa.list_(pa.binary())), ("lent", pa.list_(pa.bool_()))])
STORE_DDL = "media binary, whole boolean, digests array<binary>, chunks array<binary>, lent array<boolean>"
READ = pa.schema([("media", pa.binary()), ("data", pa.binary())])


def catalog(docs: DataFrame) -> DataFrame:
    """A row per document: its media's digest and ordered chunk digests. `lead` marks the first of equal ones in a task."""

    def scan(batches):
        out, seen = Rows(CATALOG), set()
        for doc, text in rows_of(batches, "doc_id", "text"):
            data = payload(text)
            media = to_media(data)
            key = hashlib.sha256(media).digest()
            lead = key not in seen
            seen.add(key)
            names = [digest(c) for c in chunks(media)] if lead else None
            if out.add(doc, len((text or "").encode()), key, len(media), lead, names, weight=200 + 20 * len(names or ())):
                yield out.take()
        yield out.take()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, CATALOG_DDL)


def _blobs(docs: DataFrame) -> DataFrame:
    def scan(batches):
        out, seen = Rows(BLOBS), set()
        for (text,) in rows_of(batches, "text"):
            media = to_media(payload(text))
            key = hashlib.sha256(media).digest()
            if key not in seen:
                seen.add(key)
                blob = packed(media)
                if out.add(key, blob, weight=len(blob) + 64):
                    yield out.take()
        yield out.take()

    return docs.select("text").mapInArrow(scan, "media binary, blob binary").dropDuplicates(["media"])


def store(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """The chunk store: a row per distinct media with its chunk list and the bytes of those chunks that it owns. A chunk that
    several media have is owned by that with the smallest digest, at its first place; the others have null there and
    find it by its digest. The joins are over digests; bytes move once, compressed, to the row that keeps them."""
    places = listed.filter("lead").select("media", F.posexplode("digests").alias("place", "name"))
    owners = places.groupBy("name").agg(F.min(F.struct("media", "place")).alias("owner"), F.max(F.struct("media", "place")).alias("last"))
    shared = saved(owners.filter("owner != last").select("name", "owner"))
    held = places.join(shared, "name").select("media", "place", (F.struct("media", "place") == F.col("owner")).alias("own")).distinct()
    held = saved(held.groupBy("media").agg(F.collect_list(F.struct("place", "own")).alias("held")))
    joined = _blobs(docs).join(held, "media", "left")

    def cut(batches):
        out = Rows(STORE)
        for key, blob, held in rows_of(batches, "media", "blob", "held"):
            pieces = chunks(unpacked(blob))
            names, lent = [digest(c) for c in pieces], [False] * len(pieces)
            for x in held or ():
                if x["own"]:
                    lent[x["place"]] = True
                else:
                    pieces[x["place"]] = None
            size = sum(len(c) for c in pieces if c is not None)
            if out.add(key, None not in pieces, names, pieces, lent, weight=size + 100):
                yield out.take()
        yield out.take()

    return saved(joined.mapInArrow(cut, STORE_DDL))


def hot_chunks(listed: DataFrame) -> DataFrame:
    """name, hot: chunks that stand at more than HOT places."""
    places = listed.filter("lead").select(F.explode("digests").alias("name"))
    return saved(places.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("name", F.lit(True).alias("hot")))


def reconstruct(kept: DataFrame, hot: DataFrame, columns: pa.Schema, ddl: str, make) -> DataFrame:
    """make(media digest, media bytes) -> a row, for each media of the store. Its chunks are put together in order; a media without
    its own digest is an error. Those that own all their chunks need no shuffle; for the others the missing ones are fetched, hot ones
    from one of SALTS copies."""

    def build(key, pieces):
        media = b"".join(pieces)
        if hashlib.sha256(media).digest() != key:
            raise ValueError(f"chunks of {key.hex()} don't give its media")
        return make(key, media)

    def whole(batches):
        out = Rows(columns)
        for key, pieces in rows_of(batches, "media", "chunks"):
            if out.add(*(row := build(key, pieces)), weight=400 + max(len(x) if isinstance(x, bytes) else 0 for x in row)):
                yield out.take()
        yield out.take()

    def mended(batches):
        out = Rows(columns)
        for key, pieces, found in rows_of(batches, "media", "chunks", "found"):
            for x in found:
                pieces[x["place"]] = x["chunk"]
            if out.add(*(row := build(key, pieces)), weight=400 + max(len(x) if isinstance(x, bytes) else 0 for x in row)):
                yield out.take()
        yield out.take()

    partial = kept.filter(~F.col("whole"))
    each = F.posexplode(F.arrays_zip("digests", "chunks", "lent"))
    asked = partial.select("media", each.alias("place", "x")).filter("x.chunks is null").select("media", "place", F.col("x.digests").alias("name"))
    lenders = kept.filter(F.exists("lent", lambda x: x)).select(each.alias("at", "x")).filter("x.lent").select(F.col("x.digests").alias("name"), F.col("x.chunks").alias("chunk"))
    if not hot.isEmpty():
        asked = asked.join(hot, "name", "left").select("media", "place", "name", F.when(F.col("hot"), F.pmod(F.xxhash64("media"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
        every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        lenders = lenders.join(hot, "name", "left").select("name", "chunk", F.explode(every).alias("salt"))
    found = asked.join(lenders, ["name", "salt"] if "salt" in asked.columns else "name").groupBy("media").agg(F.collect_list(F.struct("place", "chunk")).alias("found"))
    first = kept.filter("whole").select("media", "chunks").mapInArrow(whole, ddl)
    return first.unionByName(partial.select("media", "chunks").join(found, "media").mapInArrow(mended, ddl))


FEATURES = pa.schema([("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())])


def media_features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> a row per document with what was read back from the store. Null text is empty, equal texts have equal
    values, repeated rows and null doc_ids keep their rows; an empty table gives an empty result."""

    def measure(key, media):
        data = from_media(media)
        return key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), features(data)

    listed = saved(catalog(docs))
    kept = store(docs, listed)
    seen = saved(reconstruct(kept, hot_chunks(listed), FEATURES, "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string", measure))
    return listed.select("doc_id", "n_bytes", "media", "media_bytes").join(seen, "media").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature"
    )


def op6(spark, sf_dir: str) -> DataFrame:
    return media_features(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
