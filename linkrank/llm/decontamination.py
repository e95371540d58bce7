"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3  # words of the shingles that windows are found by
BROADCAST_CANDIDATES = 200_000  # places to look at in texts, of some 20 bytes each, that are broadcast at most
BROADCAST_WINDOWS = 1_000_000  # shingles or windows, of some 20 bytes each, that are broadcast at most


def bench_words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, with A-Z lowered; none for null."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), GAPS), "")


def text_sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, win (array of words): all windows of `size` words; a shorter item is one window, an item without words has none."""
    w = F.col("words")
    starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).when(F.size(w) > 0, F.array(F.lit(0)))
    cut = items.select("item_id", bench_words(F.col("text")).alias("words")).select("item_id", "words", F.explode(starts).alias("s"))
    return cut.select("item_id", F.slice(w, F.col("s") + 1, size).alias("win")).distinct()


def shingles(words: Column, k: int) -> Column:
    """A 64-bit hash of the k words from each place on; none where fewer are left."""
    some = F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(some, lambda w, i: F.xxhash64(w, *(F.element_at(words, i + j + 1) for j in range(1, k))))


def _spread(words: DataFrame, k: int) -> DataFrame:
    """words(key, words) -> key, len, pos, token: the same hashes, a row each; generated code all through, unlike a lambda."""
    w, names = F.col("words"), [f"w{j}" for j in range(k)]
    zipped = F.arrays_zip(*(F.slice(w, F.lit(j + 1), F.size(w)).alias(n) for j, n in enumerate(names)))
    rows = words.select("key", F.size(w).alias("len"), F.posexplode(zipped).alias("pos", "x")).filter(F.col("pos") + k <= F.col("len"))
    return rows.select("key", "len", "pos", F.xxhash64(*(F.col("x")[n] for n in names)).alias("token"))


def _small(df: DataFrame, n: int) -> DataFrame:
    """The benchmark's side of a join: broadcast up to a counted number of rows, each of a fixed size, else left to a shuffled join."""
    return F.broadcast(df) if n <= BROADCAST_WINDOWS else df


def occurrences(docs: DataFrame, items: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(key, wid, a, b): each place a..b-1 of each distinct text, by its SHA-256, where a window occurs; and (wid, item_id) of the windows' items.

    Distinct windows are searched once, whoever has them. The tokens of a window are its shingles, ordered by how often they stand in all documents;
    a text containing it must have each of them, so its rarest one is prefix enough. A shingle of a text that is some window's prefix makes a candidate
    if the window would begin and end inside the text, and a candidate counts if the text has exactly the window's words there."""
    cut = saved(windows(items, size))
    wins = saved(cut.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()).withColumn("n", F.size("win")))
    owners = saved(cut.join(wins, "win").select("wid", "item_id"))
    lengths = sorted(r[0] for r in wins.select(F.least("n", F.lit(SHINGLE))).distinct().collect())  # SHINGLE values at most
    tokens = lambda words, n: F.coalesce(*(F.when(n == k if k < SHINGLE else n >= k, shingles(words, k)) for k in lengths or [1]))
    parts = saved(wins.select("wid", "n", F.posexplode(tokens(F.col("win"), F.col("n"))).alias("off", "token")))
    vocabulary = saved(parts.select("token").distinct())
    words = docs.select(text_sha(F.col("text")).alias("key"), bench_words(F.col("text")).alias("words"))
    seen = None
    for k in lengths or [1]:
        spread = _spread(words, k)
        seen = spread if seen is None else seen.unionByName(spread)
    hits = saved(seen.join(_small(vocabulary, vocabulary.count()), "token").select("key", "len", "pos", "token"))
    counts = saved(hits.groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    least = parts.join(counts, "token", "left").groupBy("wid", "n").agg(F.count("count").alias("known"), F.count(F.lit(1)).alias("all"), F.min(F.struct("count", "token", "off")).alias("least"))
    prefix = saved(least.filter("known = all").select("wid", "n", F.col("least.token").alias("token"), F.col("least.off").alias("off")))  # a shingle in no document rules its window out
    start = F.col("pos") - F.col("off")
    found = hits.join(_small(prefix, prefix.count()), "token").filter((start >= 0) & (start + F.col("n") <= F.col("len")))
    found = saved(found.groupBy("key").agg(F.collect_set(F.struct("wid", start.alias("a"), "n")).alias("found")))
    places = found.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    here = words.join(F.broadcast(found) if places <= BROADCAST_CANDIDATES else found, "key").dropDuplicates(["key"])
    cuts = F.transform("found", lambda x: F.struct(x["wid"], x["a"], F.slice("words", x["a"] + 1, x["n"]).alias("win")))
    whole = here.select("key", F.explode(cuts).alias("x")).select("key", "x.wid", "x.a", "x.win").join(wins, ["wid", "win"])
    return saved(whole.select("key", "wid", "a", (F.col("a") + F.col("n")).alias("b"))), owners


def hit_texts(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(key, n_hit, items) of each distinct text in which a window occurs."""
    places, owners = occurrences(docs, items, size)
    spans = places.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    cover = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")),
        lambda s: s["n"],
    )
    listed = places.select("key", "wid").distinct().join(owners.filter("item_id is not null"), "wid").groupBy("key").agg(F.collect_set("item_id").alias("ids"))
    ids = F.coalesce(F.array_sort(F.transform("ids", lambda i: i.cast("string"))), F.array().cast("array<string>"))
    return saved(spans.select("key", cover.alias("n_hit")).join(listed, "key", "left").select("key", "n_hit", ids.alias("items")))


def clean_documents(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents in which no window occurs, with all their columns."""
    name = "__linkrank_key"
    hits = saved(occurrences(docs.select("text"), items, size)[0].select(F.col("key").alias(name)).distinct())
    return docs.withColumn(name + "_", text_sha(F.col("text"))).join(hits, F.col(name + "_") == F.col(name), "left_anti").drop(name + "_")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of an item's window is hit. Texts stand for themselves, so equal texts share one
    search and null or repeated doc_ids keep their rows. Null and empty texts have no words and no hits. An item with a null id
    hits words like any other, but is neither listed nor counted; items without words never occur; an empty benchmark leaves every document clean."""
    hits = hit_texts(docs, items, size)
    every = docs.select("doc_id", text_sha(F.col("text")).alias("key"), F.size(bench_words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return every.join(hits, "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP1_SQL = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
win as (select distinct item_id, least(10, len(w)) n, array_to_string(w[s + 1 : s + 10], ' ') g
        from (select item_id, w, unnest(range(greatest(len(w) - 9, 1))) s from i where len(w) > 0)),
sizes as (select distinct n from win),
g as (select r, s, n, array_to_string(w[s + 1 : s + n], ' ') g
      from (select r, w, n, unnest(range(len(w) - n + 1)) s from d, sizes where len(w) >= n)),
hit as (select r, s, n, item_id from g join win using (n, g)),
cov as (select r, count(distinct p) n_hit from (select r, unnest(range(s, s + n)) p from hit) group by r),
ids as (select r, count(*) n_items, string_agg(x, ',' order by x) xs from (select distinct r, item_id::varchar x from hit where item_id is not null) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(xs, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join cov using (r) left join ids using (r)
"""
