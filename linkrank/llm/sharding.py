"""Sharding by a keyed permutation of global row numbers, in DataFrame expressions only."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, saved

PRIME = 2_147_483_647
ROUNDS = 6
WALKS = 16


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """A key for each round, from the seed by a multiplicative generator; all below PRIME."""
    keys, x = [], seed % (PRIME - 1) + 1
    for _ in range(rounds):
        x = x * 48_271 % PRIME
        keys.append(x)
    return keys


def domain(n: int) -> tuple[int, int]:
    """The sides of the smallest near-square grid with at least n cells."""
    a = max(1, isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def _mixed(v, k):
    """Non-linear in v; every product stays below 2**62, so no 64-bit arithmetic overflows."""
    y = (v + k) % PRIME
    return (((y * y + k) % PRIME) * 69_621 + v) % PRIME


def permute(i: int, n: int, seed: int) -> int:
    """Where row number i of n goes: the same arithmetic as the DataFrame form, for one number."""
    a, b = domain(n)
    while True:
        x, y = i % a, i // a
        for r, k in enumerate(round_keys(seed)):
            if r % 2:
                y = (y + _mixed(x, k)) % b
            else:
                x = (x + _mixed(y, k)) % a
        i = y * a + x
        if i < n:
            return i


def unpermute(i: int, n: int, seed: int) -> int:
    """The row number that goes to i."""
    a, b = domain(n)
    keys = round_keys(seed)
    while True:
        x, y = i % a, i // a
        for r in range(len(keys) - 1, -1, -1):
            if r % 2:
                y = (y - _mixed(x, keys[r])) % b
            else:
                x = (x - _mixed(y, keys[r])) % a
        i = y * a + x
        if i < n:
            return i


def _once(i: Column, a: int, b: int, seed: int) -> Column:
    keys = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(r % 2).alias("odd")) for r, k in enumerate(round_keys(seed))))
    start = F.struct((i % a).alias("x"), _div(i, a).alias("y"))
    step = lambda s, r: F.struct(
        F.when(r["odd"] == 0, (s["x"] + _mixed(s["y"], r["k"])) % a).otherwise(s["x"]).alias("x"),
        F.when(r["odd"] == 1, (s["y"] + _mixed(s["x"], r["k"])) % b).otherwise(s["y"]).alias("y"),
    )
    return F.aggregate(keys, start, step, lambda s: s["y"] * a + s["x"])


def _div(i: Column, a: int) -> Column:
    return F.call_function("div", i, F.lit(a).cast("long"))


ADDED = ("row_no", "shuffled", "shard", "slot")


def row_numbers(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(row, row_no): each row whole, as a struct, and its global number from 0 in the given order, without one task that sees all rows: a range partitioning,
    positions within each partition, and a cumulative sum of as many counts as there are partitions.
    Rows that agree in the whole order are told apart by their place in the input, so a repeated row can't fill one range."""
    keys = [f"key{i}" for i in range(len(order))] + ["at"]
    held = rows.select(F.struct(*(F.col(c) for c in rows.columns)).alias("row"), *(F.col(c).alias(k) for c, k in zip(order, keys, strict=False)), F.monotonically_increasing_id().alias("at"))
    dealt = held.repartitionByRange(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = saved(dealt.select("row", F.monotonically_increasing_id().alias("place")))
    part = F.shiftright("place", 33)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before, first = 0, []
    for p, c in counts:
        first.append((p, before))
        before += c
    starts = rows.sparkSession.createDataFrame(first, "part long, first long")
    numbered = placed.join(F.broadcast(starts), part == F.col("part"))
    return numbered.select("row", (F.col("first") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("row_no")), before


def feistel_shards(rows: DataFrame, order: list[str], n_shards: int = 16, seed: int = 20_240_501) -> DataFrame:
    """The rows with `row_no`, `shuffled` (its place in the shuffle), `shard` and `slot`.

    The global row number goes through a Feistel network on a near-square grid; a number that lands beyond the
    last row walks its cycle until it lands inside, so the result is a permutation of 0..n-1. shard = place mod
    n_shards and slot = place div n_shards: counts differ by one at most, slots have no gaps, and either direction
    is computable for a single row (permute, unpermute) without the table.

    A column of `rows` with the name of an added one is replaced by it, though the order may go by it; null order values come first; repeated rows
    each get a place of their own; an empty table stays empty."""
    numbered, n = row_numbers(rows, order)
    a, b = domain(n)
    walk = lambda s, _: F.when(s < n, s).otherwise(_once(s, a, b, seed))
    steps = F.sequence(F.lit(1), F.lit(WALKS))
    out = numbered.withColumn("shuffled", F.aggregate(steps, _once(F.col("row_no"), a, b, seed), walk))
    while n and a * b > n and out.filter(F.col("shuffled") >= n).limit(1).count():  # a walk may be longer
        out = saved(out.withColumn("shuffled", F.aggregate(steps, F.col("shuffled"), walk)))
    kept = [F.col("row").getField(c).alias(c) for c in rows.columns if c.lower() not in ADDED]
    return out.select(*kept, "row_no", "shuffled", (F.col("shuffled") % n_shards).cast("int").alias("shard"), _div(F.col("shuffled"), n_shards).alias("slot"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = feistel_shards(narrow, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql(n_shards: int = 16, seed: int = 20_240_501) -> str:
    """The same in SQL: CRC-32 by its table of 256 entries, the network a subquery a round, the walk a recursion."""

    def once(source):
        out = f"select r, v % a x, v // a y, a, b from {source}"
        for i, k in enumerate(round_keys(seed)):
            mixed = lambda v: f"(((({v} + {k}) % {PRIME}) * (({v} + {k}) % {PRIME}) + {k}) % {PRIME} * 69621 + {v}) % {PRIME}"  # noqa: E731, B023
            out = f"select r, x, (y + {mixed('x')}) % b y, a, b from ({out})" if i % 2 else f"select r, (x + {mixed('y')}) % a x, y, a, b from ({out})"
        return f"select r, y*a + x v from ({out})"

    return f"""
with recursive tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
bytes as (select row_number() over () k, doc_id, hex(encode(coalesce(text, ''))) x from documents),
sized as (select k, doc_id, (len(x)//2 + 1)::bigint size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(x)//2), lambda i: ('0x' || substr(x, 2*i + 1, 2))::bigint)),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::bigint) text_crc32 from bytes, tab),
d as (select *, row_number() over (order by doc_id nulls first, size, text_crc32, k) - 1 r from sized),
side as (select count(*) n, greatest(1, floor(sqrt(greatest(count(*), 1))))::bigint a from d),
grid as (select n, a, (n + a - 1)//a b from side),
walk(r, v) as ({once("(select r, r v, a, b from d, grid)")} union all {once("(select r, v, a, b from walk, grid where v >= n)")})
select doc_id, size, text_crc32, 'rows' law, (v % {n_shards})::int shard, (v // {n_shards})::bigint slot, null::int grown_shard from walk join d using (r), grid where v < n
"""


OP7_SQL = _sql()
